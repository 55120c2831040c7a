"""DuckDB statements of the queries that SQL can express on whole tables."""

ORACLE: dict[str, str] = {}

ORACLE["op6_exact_dedup"] = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n"""

ORACLE["op9_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM w)),
hit AS (SELECT doc_id, p FROM win JOIN (SELECT k, min(doc_id) AS m FROM win GROUP BY k) USING (k) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM hit),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""


# Fixed values of op11: seed, block, rows a shard, weights and repeats are those of the operator.
ORACLE["op11_mixing"] = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS name,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
h AS (SELECT *, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size) AS digest FROM d),
r AS (SELECT *, ('0x' || digest[1:7])::BIGINT % greatest(1, (SELECT (count(*) + 2047) // 2048 FROM d)) AS shard FROM h),
s AS (SELECT name, sum(size)::BIGINT AS size, [5, 2, 1][(row_number() OVER (ORDER BY name) - 1) % 3 + 1]::BIGINT AS w
      FROM r GROUP BY name),
o AS (SELECT *, sum(size) OVER () AS total, sum(w) OVER () AS heavy,
             coalesce(sum(3 * size) OVER before, 0) AS stopped, coalesce(sum(w) OVER before, 0) AS gone, 3.0::DOUBLE * size / w AS spot
      FROM s WINDOW before AS (ORDER BY 3.0::DOUBLE * size / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT (total - stopped)::BIGINT AS l, (heavy - gone)::BIGINT AS g FROM o
          WHERE w * (total - stopped) <= 3 * size * (heavy - gone) ORDER BY spot, name LIMIT 1),
t AS (SELECT name, size, CASE WHEN w * l > 3 * size * g THEN (3 * size)::DOUBLE ELSE (w * l)::DOUBLE / g::DOUBLE END AS target,
             (CASE WHEN w * l > 3 * size * g THEN 3 * size * g ELSE w * l END)::DOUBLE AS votes FROM s, level),
b AS (SELECT ((2 * sum(size) + 32) // 64)::BIGINT AS n FROM s),
q AS (SELECT name, votes / (2 * unnest(range(0, (SELECT n FROM b))) + 1)::DOUBLE AS q FROM t WHERE votes > 0),
won AS (SELECT name, count(*) AS seats FROM (SELECT name, row_number() OVER (ORDER BY q DESC, name) AS rn FROM q)
        WHERE rn <= (SELECT n FROM b) GROUP BY name),
u AS (SELECT name, shard, sum(size)::BIGINT AS su FROM r GROUP BY name, shard),
uq AS (SELECT name, shard, seats, su::DOUBLE / (2 * unnest(range(0, seats)) + 1)::DOUBLE AS q FROM u JOIN won USING (name) WHERE su > 0),
uw AS (SELECT name, shard, count(*) AS quota FROM (
         SELECT name, shard, seats, row_number() OVER (PARTITION BY name ORDER BY q DESC, shard) AS rn FROM uq)
       WHERE rn <= seats GROUP BY name, shard),
p AS (SELECT name, shard, su, least(coalesce(quota, 0) * 32, 3 * su) AS words FROM u LEFT JOIN uw USING (name, shard)),
pp AS (SELECT *, CASE WHEN su > 0 THEN words // su ELSE 0 END AS rounds, CASE WHEN su > 0 THEN words % su ELSE 0 END AS rest,
              su // 32 AS whole, ('0x' || md5('mix-1:' || name || ':' || shard)[8:14])::BIGINT AS shift FROM p),
l AS (SELECT *, row_number() OVER () AS rid,
             (sum(size) OVER (PARTITION BY name, shard ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS spot
      FROM r JOIN pp USING (name, shard)),
blocks AS (SELECT *, unnest(range(spot // 32, (spot + size - 1) // 32 + 1)) AS i FROM l WHERE size > 0 AND rest > 0),
reach AS (SELECT rid, greatest(0, least(spot + size, i * 32 + CASE
            WHEN i >= whole THEN greatest(rest - whole * 32, 0)
            WHEN (i * 2147483647 + shift) % greatest(whole, 1) < rest // 32 THEN 32
            WHEN (i * 2147483647 + shift) % greatest(whole, 1) = rest // 32 THEN rest % 32 ELSE 0 END) - greatest(spot, i * 32)) AS n
          FROM blocks),
extra AS (SELECT rid, sum(n) AS n FROM reach GROUP BY rid)
SELECT doc_id, l.size::BIGINT AS size, t.size AS source_size, target, (rounds * l.size + coalesce(n, 0))::BIGINT AS taken
FROM l JOIN t USING (name) LEFT JOIN extra USING (rid)"""

ORACLE["op13_ranked_search"] = r"""
WITH f AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low,
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), term) AS t FROM documents, f),
n AS (SELECT rid, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), up, low), term)) AS term FROM benchmark, f),
s AS (SELECT item_id, doc_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN w USING (term) JOIN n USING (rid), g GROUP BY item_id, doc_id, rid)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


def _edit(state: str, cost: str, letter: str) -> str:
    """A state, nine digits of cost before the edits so far, after one more edit; null stays null."""
    return f"lpad((left({state}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{letter}'"


# The least string of cost and edits per state of the pattern and row: 0 nothing yet, 1 system, 2 user, 3 assistant.
ORACLE["op12_conversation_repair"] = rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS h FROM raw, tab),
dam AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
               CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc WHERE h <> 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM dam),
f AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tr,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM ord),
k AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
             CASE WHEN tr = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(tr, 1) NOT IN ('.', '!', '?') THEN 'truncated'
                  ELSE '' END AS fault FROM f),
e AS (SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more, fault NOT IN ('blank', 'duplicate') AS free FROM k),
dp(conv_id, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, '000000003I', '000000006II' FROM k
  UNION ALL
  SELECT conv_id, i, n0, n1, u, least(n3, {_edit('u', '3', 'I')}) FROM (
    SELECT *, least(n2, {_edit('n0', '3', 'I')}, {_edit('n1', '3', 'I')}, {_edit('n3', '3', 'I')}) AS u FROM (
      SELECT e.conv_id, e.i, {_edit('s0', '4', 'D')} AS n0,
             least({_edit('s1', '4', 'D')}, CASE WHEN free AND ini = 's' THEN {_edit('s0', 'more', 'K')} END) AS n1,
             least({_edit('s2', '4', 'D')}, {', '.join(f"CASE WHEN free THEN {_edit(q, '3 + more', 'R')} END, CASE WHEN free AND ini = 'u' THEN {_edit(q, 'more', 'K')} END" for q in ('s0', 's1', 's3'))}) AS n2,
             least({_edit('s3', '4', 'D')}, CASE WHEN free THEN {_edit('s2', '3 + more', 'R')} END,
                   CASE WHEN free AND ini = 'a' THEN {_edit('s2', 'more', 'K')} END) AS n3
      FROM dp JOIN e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.i = dp.i + 1))),
best AS (SELECT conv_id, arg_max(least(s0, s3), i) AS b FROM dp GROUP BY conv_id),
l AS (SELECT conv_id, p, substr(b, p + 9, 1) AS c FROM (SELECT conv_id, b, unnest(range(1, length(b) - 8)) AS p FROM best)),
m AS (SELECT *, sum((c <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS i,
             sum((c <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS o FROM l),
r AS (SELECT m.*, k.role, k.text, k.ini FROM m LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM m.conv_id AND k.i = m.i AND m.c <> 'I'
      WHERE m.c <> 'D'),
w AS (SELECT *, o - max((o = 1 AND c = 'K' AND ini = 's')::INT) OVER (PARTITION BY conv_id) AS spot FROM r),
lines AS (SELECT conv_id, p, CASE WHEN c = 'K' THEN role WHEN spot % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
                 || coalesce(text, '') AS line FROM w),
done AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY p)) AS sha FROM lines GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
             count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
             count(*) FILTER (WHERE before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(b, 9)::BIGINT, 0) AS cost,
       coalesce(substr(b, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id"""
