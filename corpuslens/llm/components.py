"""Connected components by alternating large-star and small-star (Kiveris et al., 2014).

Each star is a minimum per vertex and a join of it with the edges. The minima of up to ``SMALL_EDGES`` edges,
counted, are broadcast; those of more are joined by salted shuffle. Every star, and the result, is cut with a
table written to the shared folder: a plan that held two stars would hold the edges many times over, and the driver
keeps several texts of a plan at each of its adaptive steps. Rounds go on until every component is one star.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import stored, with_group_stats


SMALL_EDGES = 500_000


def _with_lowest(edges: DataFrame, few: bool) -> DataFrame:
    """Edges with ``_min``, the smallest ``dst`` of their ``src``."""
    if few:
        return edges.join(F.broadcast(edges.groupBy("src").agg(F.min("dst").alias("_min"))), "src")
    return with_group_stats(edges, ["src"], {"_min": ("min", "dst")}, F.xxhash64("dst"))


def _both(first: tuple[str, str], second: tuple[str, str], names: tuple[str, str] = ("src", "dst")) -> Column:
    """Two rows of each, read from one scan: the columns ``first`` and the columns ``second`` under ``names``."""
    return F.inline(F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(pair, names)]) for pair in (first, second)]))


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest member of its neighbourhood."""
    known = _with_lowest(edges.select(_both(("src", "dst"), ("dst", "src"))), few)
    hub = F.least("src", "_min")
    return known.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), hub.alias("dst")).distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Link every smaller neighbour of a vertex, and the vertex, to the smallest of them."""
    known = _with_lowest(edges, few)
    return known.select(_both(("src", "_min"), ("dst", "_min"))).where("src <> dst").distinct()


def _is_final(edges: DataFrame) -> bool:
    """Has every vertex with a link one link only, to a vertex without one? Then the stars are final."""
    ends = edges.withColumns({"one": F.lit(1), "none": F.lit(0)}).select(_both(("src", "one"), ("dst", "none"), ("v", "n")))
    role = ends.groupBy("v").agg(F.sum("n").alias("n"), F.min("n").alias("below"))
    return role.where("n > 1 or (n = 1 and below = 0)").isEmpty()


def star_components(links: DataFrame) -> DataFrame:
    """``(id, root)`` for every vertex that has a link to another; ``root`` is the smallest id in
    its component. ``links`` has ``src`` and ``dst``, direction and repeats do not matter; rows with
    a null end or two equal ends are left out."""
    edges = stored(links.where("src <> dst").select(F.greatest("src", "dst").alias("src"),
                                                    F.least("src", "dst").alias("dst")).distinct(), "edges")
    few = False
    while not _is_final(edges):
        few = few or edges.count() <= SMALL_EDGES  # no star has more edges than it was made from
        edges = stored(_small_star(stored(_large_star(edges, few), "stars"), few), "edges")
    return stored(edges.select(_both(("src", "dst"), ("dst", "dst"), ("id", "root"))).distinct(), "roots")
