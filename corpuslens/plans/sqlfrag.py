"""SQL fragments for the DuckDB oracle (independent re-statement of each key in SQL)."""

from __future__ import annotations

from corpuslens.functions import text as T
from corpuslens.operators.minhash import PRIME, permutations


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def collapse(expr: str) -> str:
    return f"trim({rr(expr, T.SPACE_RUN, ' ')})"


def strip(expr: str) -> str:
    return rr(expr, f"^{T.SPACE}+|{T.SPACE}+$", "")


def norm_minhash(c: str) -> str:
    t = f"lower({c})"
    t = rr(t, T.URL_HTTP, "URL")
    t = rr(t, T.MENTION, "@USER")
    t = rr(t, T.NUMBER_INT, "NUM")
    t = rr(t, T.PUNCT_RUN, " ")
    return collapse(t)


def norm_predict(c: str) -> str:
    t = f"lower({c})"
    t = rr(t, T.URL_HTTP_OR_WWW, " <url> ")
    t = rr(t, T.MENTION, "@user")
    t = rr(t, T.HASHTAG_UNWRAP, "\\1")
    return collapse(t)


def norm_classical(c: str, n: int | None = None) -> str:
    t = f"lower(coalesce({c}, ''))"
    t = rr(t, T.URL_HTTP_OR_WWW, "<url>")
    t = rr(t, T.MENTION, "<user>")
    t = rr(t, "#", "")
    t = rr(t, T.NUMBER_DECIMAL, "<num>")
    t = collapse(t)
    return f"left({t}, {n})" if n else t


def norm_basic(c: str, n: int | None = None) -> str:
    t = rr(c, T.URL_HTTP, "URL")
    t = rr(t, T.MENTION, "@USER")
    t = collapse(t)
    return f"left({t}, {n})" if n else t


def words(nt: str) -> str:
    return f"list_filter(string_split({nt}, ' '), lambda x: length(x) > 0)"


def shingles(w: str, k: int = 4) -> str:
    """``w`` must be a column of an earlier CTE (lambdas re-evaluate inlined expressions)."""
    return (f"(CASE WHEN len({w}) <= {k} THEN [array_to_string({w}, ' ')] "
            f"ELSE list_transform(range(1, len({w}) - {k - 2}), lambda i: array_to_string({w}[i:i + {k - 1}], ' ')) END)")


def hash32(s: str) -> str:
    return f"('0x' || substr(md5({s}), 1, 8))::BIGINT"


def perms_values(num_perm: int = 64) -> str:
    rows = ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(permutations(num_perm)))
    return f"(VALUES {rows}) AS p(i, a, b)"


def minhash_ctes(source: str, id_col: str, text_col: str, bands: int, rows: int,
                 num_perm: int = 64, p: str = "") -> str:
    """CTEs {p}sh(id, hs), {p}sig(id, i, v), {p}bnd(id, band, key), {p}edges(src, dst) over ``source``."""
    return f"""
{p}nw AS (SELECT {id_col} AS id, {words(norm_minhash(text_col))} AS w FROM {source}),
{p}sh AS (SELECT id, list_distinct(list_transform({shingles('w')}, lambda s: {hash32('s')})) AS hs FROM {p}nw),
{p}hx AS (SELECT id, unnest(hs) AS h FROM {p}sh),
{p}sig AS (SELECT hx.id, p.i, min((p.a * hx.h + p.b) % {PRIME}) AS v
        FROM {p}hx hx CROSS JOIN {perms_values(num_perm)} GROUP BY hx.id, p.i),
{p}bnd AS (SELECT id, (i // {rows})::INTEGER AS band,
               md5(((i // {rows})::INTEGER)::VARCHAR || ':' || string_agg(v::VARCHAR, ',' ORDER BY i)) AS key
        FROM {p}sig WHERE i < {bands * rows} GROUP BY id, i // {rows}),
{p}bmin AS (SELECT band, key, min(id) AS dst FROM {p}bnd GROUP BY band, key),
{p}edges AS (SELECT DISTINCT b.id AS src, m.dst FROM {p}bnd b JOIN {p}bmin m USING (band, key) WHERE b.id <> m.dst)"""


def components_ctes(vertex_source: str, id_col: str) -> str:
    """Recursive CTE comps(id, root) over ``edges(src, dst)`` (undirected)."""
    return f"""
und AS (SELECT src, dst FROM edges UNION SELECT dst AS src, src AS dst FROM edges),
reach(id, lab) AS (
  SELECT {id_col}, {id_col} FROM {vertex_source}
  UNION
  SELECT u.dst, r.lab FROM reach r JOIN und u ON u.src = r.id),
comps AS (SELECT id, min(lab) AS root FROM reach GROUP BY id)"""


POSTS_FX = """
posts_fx AS (
  SELECT d.doc_id AS seq, CAST(d.doc_id AS VARCHAR) AS id, d.source AS university, d.lang AS "group",
         d.text || ' @' || d.source || ' #' || d.lang || ' http://t.example/' || CAST(d.doc_id AS VARCHAR)
           || '?q=1 www.x.example ' || CAST(d.n_chars AS VARCHAR) || ',5' AS text,
         CASE WHEN d.doc_id % 2 = 0 THEN strftime(e.ts, '%a %b %d %H:%M:%S +0000 %Y')
              ELSE strftime(e.ts, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS createdAt,
         e.ts AS ts
  FROM documents d JOIN events e ON e.event_id = d.doc_id)"""

LABELED_FX = """
labeled_fx AS (
  SELECT d.doc_id, d.text, d.source, l.toxic AS label,
         CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS is_synth
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""

LABEL3_FX = """
label3_fx AS (
  SELECT d.doc_id, d.text, d.source AS universite,
         CASE WHEN l.quality = 0 THEN 9 ELSE l.toxic END AS label
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""

SCORES_FX = """
scores_fx AS (
  SELECT vec_id, label % 2 AS y, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS is_synth,
         1.0 / (1.0 + exp(-8.0 * CAST(embedding[1] AS DOUBLE))) AS prob_pos
  FROM embeddings)"""

LOGITS3_FX = """
logits3_fx AS (
  SELECT vec_id, label % 3 AS y,
         [4.0 * CAST(embedding[1] AS DOUBLE), 4.0 * CAST(embedding[2] AS DOUBLE),
          4.0 * CAST(embedding[3] AS DOUBLE)] AS logits
  FROM embeddings)"""

SENTIMENT_FX = """
sentiment_fx AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, 'u' || CAST(user_id % 14 AS VARCHAR) AS university,
         CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 9 END AS tags, value
  FROM events)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n"
