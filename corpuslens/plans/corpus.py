"""Registered keys over ``documents``: exact and near de-duplication, shingles, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.text import normalize_minhash, shingles, split_words
from corpuslens.operators import components as C
from corpuslens.operators import dedupe as D
from corpuslens.operators import minhash as M
from corpuslens.plans import sqlfrag as S
from corpuslens.plans.fixtures import documents
from corpuslens.session import reliable_checkpoint
from corpuslens.sources import sinks as W

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("dedupe_exact_first", "SELECT doc_id, source FROM documents WHERE doc_id IN "
          "(SELECT min(doc_id) FROM documents GROUP BY text)")
def dedupe_exact_first(spark, sf):
    d = documents(spark, sf).select("doc_id", "text", "source")
    return D.dedupe_exact_first(d, "text", "doc_id").select("doc_id", "source")


@register("dedupe_report", """
SELECT count(*) AS rows_before,
       count(*) - (count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END)) AS rows_removed,
       count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS rows_after
FROM documents""")
def dedupe_report(spark, sf):
    return D.dedupe_report(documents(spark, sf).select("text"))


@register("word_counts", f"""
SELECT doc_id, len(string_split({S.norm_minhash('text')}, ' '))::BIGINT AS n_words FROM documents""")
def word_counts(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", F.size(F.split(normalize_minhash(F.col("text")), " ")).cast("bigint").alias("n_words"))


@register("shingles", S.with_(f"""nw AS (SELECT doc_id, {S.words(S.norm_minhash('text'))} AS w FROM documents)""",
                                f"""sh AS (SELECT doc_id, {S.shingles('w')} AS s FROM nw)""") + """
SELECT doc_id, len(s)::BIGINT AS n_shingles, len(list_distinct(s))::BIGINT AS n_distinct,
       s[1] AS first_shingle, s[len(s)] AS last_shingle FROM sh""")
def shingles_key(spark, sf):
    w = M.with_words(documents(spark, sf), "text", keep=("doc_id",))
    d = w.select("doc_id", shingles(F.col("w")).alias("s"))
    return d.select("doc_id", F.size("s").cast("bigint").alias("n_shingles"),
                    F.size(F.array_distinct("s")).cast("bigint").alias("n_distinct"),
                    F.col("s")[0].alias("first_shingle"), F.element_at("s", -1).alias("last_shingle"))


def _sigs(spark, sf):
    return M.with_signatures(documents(spark, sf), "doc_id", "text")


def _bands(spark, sf):
    """Written once: the bucket minima, the large buckets and the join all read them."""
    return W.written(M.band_keys(_sigs(spark, sf), M.COMPAT_BANDS, M.COMPAT_ROWS), "bands")


@register("minhash_signatures", S.with_(S.minhash_ctes("documents", "doc_id", "text", 5, 12)) + """
SELECT id AS doc_id, string_agg(v::VARCHAR, ',' ORDER BY i) AS sig FROM sig GROUP BY id""")
def minhash_signatures(spark, sf):
    s = _sigs(spark, sf)
    return s.select(F.col("id").alias("doc_id"), F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


@register("lsh_candidate_pairs", S.with_(S.minhash_ctes("documents", "doc_id", "text", 5, 12)) + """
SELECT src, dst FROM edges""")
def lsh_candidate_pairs(spark, sf):
    return M.star_edges(_bands(spark, sf))


# all in-bucket pairs of documents with different shingle sets; of equal sets the smallest id stands for all
_PAIRS_SQL = S.with_(S.minhash_ctes("documents", "doc_id", "text", M.RECALL_BANDS, M.RECALL_ROWS).replace(
    "edges AS (SELECT DISTINCT", "star AS (SELECT DISTINCT"), f"""
cls AS (SELECT id, hs, min(id) OVER (PARTITION BY list_sort(hs)) AS rep FROM sh),
rep_bnd AS (SELECT b.* FROM bnd b JOIN cls c ON c.id = b.id AND c.rep = b.id),
cand AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM rep_bnd a JOIN rep_bnd b USING (band, key) WHERE a.id > b.id),
jac AS (
  SELECT e.src, e.dst,
         len(list_intersect(a.hs, b.hs)) / len(list_distinct(list_concat(a.hs, b.hs))) AS jaccard
  FROM cand e JOIN sh a ON a.id = e.src JOIN sh b ON b.id = e.dst),
edges AS (SELECT src, dst, jaccard FROM jac WHERE jaccard >= {M.DEFAULT_THRESHOLD}
          UNION ALL SELECT id, rep, 1.0 FROM cls WHERE id <> rep)""")


@register("near_dup_pairs", _PAIRS_SQL + "SELECT src, dst, round(jaccard, 6) AS jaccard FROM edges")
def near_dup_pairs(spark, sf):
    """Links between documents with different shingle sets (16 x 4 bands, exact Jaccard >= 0.82), and of each
    document to the first with an equal set."""
    # one pass over the text: shingle-hash sets, materialised in the shared checkpoint folder and
    # read by the classes, the signatures and the verification
    sets = W.written(M.shingle_sets(documents(spark, sf), "doc_id", "text"), "sets")
    classes = reliable_checkpoint(M.set_classes(sets))
    own, buckets = M.class_buckets(sets, classes)
    pairs = W.written(M.bucket_pairs(W.written(buckets, "buckets")), "pairs")
    links = M.verify_edges(pairs, own)
    copies = classes.where(F.col("id") != F.col("rep"))
    return (links.select("src", "dst", F.round("jaccard", 6).alias("jaccard"))
            .unionByName(copies.select(F.col("id").alias("src"), F.col("rep").alias("dst"), F.lit(1.0).alias("jaccard"))))


def _components(spark, sf):
    d = documents(spark, sf)
    return C.connected_components(d.select(F.col("doc_id").alias("id")), M.star_edges(_bands(spark, sf)))


_CC_SQL = S.with_(S.minhash_ctes("documents", "doc_id", "text", 5, 12), S.components_ctes("documents", "doc_id"))


@register("near_dup_clusters", _CC_SQL + "SELECT id AS doc_id, root FROM comps")
def near_dup_clusters(spark, sf):
    return _components(spark, sf).select(F.col("id").alias("doc_id"), "root")


@register("cluster_ids", _CC_SQL + """
SELECT id AS doc_id, (dense_rank() OVER (ORDER BY root) - 1)::BIGINT AS cluster_id FROM comps""")
def cluster_ids(spark, sf):
    return C.cluster_ids(_components(spark, sf)).select(F.col("id").alias("doc_id"), "cluster_id")


@register("cluster_sizes", _CC_SQL + """
, sz AS (SELECT root, count(*) AS size FROM comps GROUP BY root)
SELECT size, count(*) AS n_clusters FROM sz GROUP BY size""")
def cluster_sizes(spark, sf):
    return C.cluster_sizes(_components(spark, sf))


@register("near_dedupe_keep_first", _CC_SQL + """
SELECT d.doc_id, d.source FROM documents d JOIN comps c ON c.id = d.doc_id WHERE c.root = d.doc_id""")
def near_dedupe_keep_first(spark, sf):
    comps = _components(spark, sf)
    d = documents(spark, sf).select("doc_id", "source")
    keep = comps.where(F.col("id") == F.col("root")).select(F.col("id").alias("doc_id"))
    return d.join(keep, "doc_id", "left_semi")


_VCC_SQL = _PAIRS_SQL.rstrip() + "," + S.components_ctes("documents", "doc_id") + "\n"


@register("near_dup_clusters_verified", _VCC_SQL + "SELECT id AS doc_id, root FROM comps")
def near_dup_clusters_verified(spark, sf):
    """Clusters over verified edges only (16 x 4 bands, exact Jaccard >= 0.82 on shingle-hash sets)."""
    from corpuslens.operators.splits import near_dup_components
    d = documents(spark, sf)
    comps = near_dup_components(d, "doc_id", "text", M.RECALL_BANDS, M.RECALL_ROWS, verify=True)
    return comps.select(F.col("id").alias("doc_id"), "root")
