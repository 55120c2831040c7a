"""Connected components by iterative minimum-label propagation with pointer jumping.

Every round is one DataFrame job (join + partial min-aggregate); the label table is cut from
its lineage with a reliable ``checkpoint()`` into ``spark.checkpoint.dir`` so a lost executor
recomputes at most one round. The loop stops when no label changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.joins import salted_join
from corpuslens.operators.ranking import dense_index
from corpuslens.session import ensure_checkpoint_dir, reliable_checkpoint


# Vertices with more edges (or roots with more members) than this are salted in the joins.
HOT_ROWS = 100_000
HOT_SALTS = 64


def connected_components(vertices: DataFrame, edges: DataFrame,
                         hot_rows: int = HOT_ROWS, salts: int = HOT_SALTS) -> DataFrame:
    """``(id, root)`` with root = smallest id in the component; isolated vertices are their own root.

    ``vertices`` has column ``id``; ``edges`` has ``src``, ``dst`` (direction ignored). Star edges
    give a bucket minimum a huge degree: the neighbour-label join is salted for such vertices
    (``operators.joins.salted_join``; the hot set is found once, the edges never change). A
    giant component's root is hot in the pointer-jumping join: its vertices are dealt over sub-keys
    and each sub-key looks its root up, so a hop never sends one root's vertices to one task. Roots are
    counted for this only where there are vertices enough for a hot one.
    """
    ensure_checkpoint_dir(vertices.sparkSession)
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    und = reliable_checkpoint(edges.select(both.alias("e")).select("e.src", "e.dst").distinct())
    hot_src = reliable_checkpoint(und.groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
                                  .where(F.col("_n") > hot_rows).select("src"))
    n_hot = hot_src.count()
    labels = reliable_checkpoint(vertices.select("id", F.col("id").alias("root")).distinct())
    many = labels.count() > hot_rows
    while True:  # labels only fall, so the fixed point is reached on every graph
        # neighbour labels; the previous label rides along so "changed" needs no extra join
        cand = salted_join(und, labels.withColumnRenamed("id", "src"), ["src"], hot_src, salts, F.col("dst"), n_hot)
        cand = cand.select(F.col("dst").alias("id"), "root", F.lit(None).cast("long").alias("old"))
        agg = (labels.select("id", "root", F.col("root").alias("old")).unionByName(cand)
               .groupBy("id").agg(F.min("root").alias("root"), F.max("old").alias("old")))
        # pointer jumping: adopt the label of your label
        agg = reliable_checkpoint(agg) if many else agg
        jumps = agg.select(F.col("id").alias("root"), F.col("root").alias("root2"))  # every root is a vertex
        hop = hop_over(agg, jumps, hot_rows, salts) if many else agg.join(jumps, "root")
        new = reliable_checkpoint(hop.select("id", F.least("root", "root2").alias("root"), "old"))
        changed = new.where(F.col("root") != F.col("old")).limit(1).count()  # reads the checkpoint
        labels = new.select("id", "root")
        if changed == 0:
            return labels


def hop_over(labels: DataFrame, jumps: DataFrame, hot_rows: int, salts: int) -> DataFrame:
    """``labels(id, root, ...)`` with ``root2``, the root of their root, vertices of a hot root dealt over sub-keys."""
    hot = labels.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select("root")
    return salted_join(labels, jumps, ["root"], hot, salts, F.col("id"))


def cluster_ids(components: DataFrame) -> DataFrame:
    """Dense 0-based cluster ids in order of first occurrence (root = smallest member id)."""
    idx = dense_index(components, "root", name="cluster_id")
    return components.join(idx, "root").select("id", "root", "cluster_id")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Histogram: how many clusters have each size."""
    return (clusters.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
            .groupBy("size").agg(F.count(F.lit(1)).alias("n_clusters")))
