"""Leakage-free splits: whole near-duplicate clusters go to exactly one split.

Random choices are replaced by a seeded md5 order of the cluster root, so the result does not
depend on partitioning or input order. Ranking distinct clusters uses the distributed
``row_index`` (range partitions + offsets), never a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.arrays import seeded_order
from corpuslens.operators import components as C
from corpuslens.operators import minhash as M
from corpuslens.operators.ranking import row_index, running_sum
from corpuslens.session import reliable_checkpoint
from corpuslens.sources.sinks import written


def target_size(total: int, ratio: float) -> int:
    """``int(round(total * ratio))`` (half-even), at least 1 when ratio > 0."""
    if ratio <= 0:
        return 0
    return max(1, int(round(total * ratio)))


def near_dup_components(df: DataFrame, id_col: str, text_col: str, bands: int = M.COMPAT_BANDS,
                        rows: int = M.COMPAT_ROWS, max_chars: int | None = None,
                        verify: bool = False, threshold: float = M.DEFAULT_THRESHOLD,
                        signatures: DataFrame | None = None) -> DataFrame:
    """``(id, root)`` over LSH star edges.

    ``verify=False`` is the reference behaviour (every bucket member joins the bucket). With
    ``verify=True`` the components are those of all in-bucket pairs whose exact Jaccard reaches
    ``threshold`` (use ``RECALL_BANDS``, ``RECALL_ROWS``): documents with equal sets count as one,
    each is verified against its bucket's minimum, and buckets that still span several components
    have all pairs across these verified. ``signatures(id, sig)`` of these rows, where they are written
    already, spare a reading of the texts (for ``verify=False``).
    """
    vertices = df.select(F.col(id_col).alias("id"))
    if not verify:
        if signatures is None:
            signatures = M.with_signatures(df, id_col, text_col, max_chars=max_chars)
        keys = written(M.band_keys(signatures.select("id", "sig"), bands, rows), "bands")
        return C.connected_components(vertices, M.star_edges(keys))
    sets = written(M.shingle_sets(df, id_col, text_col, max_chars=max_chars), "sets")
    classes = reliable_checkpoint(M.set_classes(sets))
    own, buckets = M.class_buckets(sets, classes, bands, rows)
    buckets = reliable_checkpoint(buckets)
    star = reliable_checkpoint(M.star_edges(buckets.select("id", "band", "key")))
    copies = classes.where(F.col("id") != F.col("rep")).select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    links = reliable_checkpoint(M.verify_edges(star, own, threshold).select("src", "dst").unionByName(copies))
    rooted = reliable_checkpoint(buckets.join(C.connected_components(vertices, links), "id"))
    split = (rooted.groupBy("band", "key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"))
             .where("_lo < _hi").select("band", "key"))
    rest = reliable_checkpoint(M.bucket_pairs(rooted.join(split, ["band", "key"], "left_semi"), threshold))
    more = M.verify_edges(rest, own, threshold).select("src", "dst")
    return C.connected_components(vertices, links.unionByName(more))


def pick_groups(groups: DataFrame, n: int, seed: int, stage: str, unit: str = "groups") -> DataFrame:
    """Groups (column ``root``) in seeded pseudo-random order: exactly ``n`` groups
    (``unit="groups"``), or the shortest prefix holding at least ``n`` rows (``unit="rows"``,
    needs a ``size`` column)."""
    ordered = groups.withColumn("_h", seeded_order(seed, stage, F.col("root")))
    if unit == "groups":
        ranked = row_index(ordered, ["_h", "root"], name="_rn")
        return ranked.where(F.col("_rn") <= n).select("root")
    if unit == "rows":
        cum = running_sum(ordered, ["_h", "root"], "size", name="_cum")
        return cum.where(F.col("_cum") - F.col("size") < n).select("root")
    raise ValueError("unit must be 'groups' or 'rows'")


class SplitError(ValueError):
    pass


def split_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", test: float = 0.10,
                 val: float = 0.10, seed: int = 42, synth_keep: float = 1.0,
                 max_chars: int | None = None, unit: str = "groups", verify: bool = False,
                 signatures: DataFrame | None = None) -> DataFrame:
    """Assign ``split`` in {train, val, test}: val/test from real rows only, whole clusters each.

    Targets are derived from the total row count as in the reference and count clusters
    (``unit="groups"``, compatible) or rows (``unit="rows"``: whole clusters until the row
    target is reached). Synthetic rows go to train (optionally an exact seeded sample).
    ``signatures(id, sig)`` of the real rows may be given, see ``near_dup_components``.
    """
    real = df.where(F.col("is_synth") == 0)
    synth = df.where(F.col("is_synth") == 1)
    counts = df.agg(F.count(F.lit(1)).alias("n"),
                    F.count(F.when(F.col("is_synth") == 0, 1)).alias("real"),
                    F.count(F.when(F.coalesce(~F.col("is_synth").isin(0, 1), F.lit(True)), 1)).alias("bad")).first()
    if counts["bad"]:
        raise SplitError(f"{counts['bad']} rows have is_synth outside {{0, 1}}")
    test_n, val_n = target_size(counts["n"], test), target_size(counts["n"], val)
    comps = reliable_checkpoint(near_dup_components(real, id_col, text_col, max_chars=max_chars, verify=verify,
                                                    signatures=signatures))
    roots = comps.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    n_clusters = roots.count()
    capacity = n_clusters if unit == "groups" else counts["real"]
    if test_n + val_n > capacity:
        raise SplitError(f"test_n({test_n}) + val_n({val_n}) exceeds the {capacity} real {unit}")
    test_roots = pick_groups(roots, test_n, seed, "test", unit)
    rest = roots.join(test_roots, "root", "left_anti")
    val_roots = pick_groups(rest, val_n, seed, "val", unit)
    assign = (comps.join(test_roots.withColumn("split", F.lit("test")), "root", "left")
              .join(val_roots.withColumn("_v", F.lit("val")), "root", "left")
              .select(F.col("id").alias(id_col), "root",
                      F.coalesce("split", "_v", F.lit("train")).alias("split")))
    real_out = real.join(assign, id_col)
    if synth_keep < 1.0:
        synth = sample_exact(synth, id_col, synth_keep, seed)
    synth_out = synth.withColumn("root", F.lit(None).cast("bigint")).withColumn("split", F.lit("train"))
    out = real_out.unionByName(synth_out)
    return out.withColumn("is_synth", F.when(F.col("split").isin("val", "test"), F.lit(0))
                          .otherwise(F.col("is_synth")))


def sample_exact(df: DataFrame, id_col: str, ratio: float, seed: int = 42, stage: str = "synth") -> DataFrame:
    """Exactly ``round(n * clamp(ratio, 0, 1))`` rows (half-even), chosen by seeded hash order."""
    n = df.count()
    keep = int(round(n * max(0.0, min(1.0, ratio))))
    ordered = df.withColumn("_h", seeded_order(seed, stage, F.col(id_col)))
    return row_index(ordered, ["_h", id_col], name="_rn").where(F.col("_rn") <= keep).drop("_h", "_rn")


def split_stratified(df: DataFrame, id_col: str, label_col: str, test: float = 0.15, val: float = 0.15,
                     seed: int = 42) -> DataFrame:
    """Per-class quotas: test share ``test``, then val share ``val / (1 - test)`` of the remainder."""
    # one row per class (the label domain is validated upstream), so broadcasting it is bounded
    q = (df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
         .withColumn("_nt", F.bround(F.col("_n") * F.lit(test), 0).cast("long"))
         .withColumn("_nv", F.bround((F.col("_n") - F.col("_nt")) * F.lit(val / (1 - test)), 0).cast("long"))
         .drop("_n"))
    ordered = df.withColumn("_h", seeded_order(seed, "strat", F.col(id_col)))
    ranked = row_index(ordered, ["_h", id_col], group_cols=[label_col], name="_rn")
    ranked = ranked.join(F.broadcast(q), label_col)
    split = (F.when(F.col("_rn") <= F.col("_nt"), "test")
             .when(F.col("_rn") <= F.col("_nt") + F.col("_nv"), "val").otherwise("train"))
    return ranked.withColumn("split", split).drop("_h", "_rn", "_nt", "_nv")
