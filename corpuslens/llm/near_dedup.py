"""Near-duplicate documents: MinHash with banding, exact verification, connected components.

1. Each document gets the set of its distinct word shingles, 128 universal-hash minima of it and 32
   band keys of four minima. Two sets of similarity 0.8 share no band with a probability of
   (1 - 0.8**4)**32, 5e-8.
2. Documents with the same set become one vertex (128-bit set fingerprint), so groups of copies
   cost one row each.
3. Star round: every vertex of a band bucket is paired with the bucket's smallest id. A second round
   pairs the buckets still split over several components with a few more shared hubs.
4. Buckets still split after that are settled exactly: every vertex outside the bucket's largest
   component is compared with all vertices of other components.
5. Signature verification, part of the join that forms the pairs: of the 128 minima, kept as one byte
   each, so many must agree that a true link falls short with a chance below 1e-9. The sizes must allow the
   threshold, and so must a parity sketch: 1,024 bits, each flipped by the shingles that hash to it. Two
   sketches differ in at most as many bits as the sets have shingles apart; these two tests lose no link.
6. Every pair left is confirmed on the full shingle sets: 100 * |A and B| >= threshold * |A or B|.
7. Buckets of more than ``HOT`` rows are dealt over sub-keys in all joins on the band, and copies over
   sub-keys where components come back to the rows.

Buckets, components and pairs have no caps. Pairs inside a component that is already connected are
never formed, because only the components are asked for.

Words are runs of characters other than ASCII white space with A-Z lower-cased. A text with fewer
words than a shingle gives its whole sequence as one shingle; null and wordless texts have an empty
set and link with nothing, as do rows with a null id. Rows that share an id are one vertex that
links by any of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import SALTS, as_bytes, by_bytes, in_python, join_back, stored, with_group_stats
from corpuslens.llm.components import star_components
from corpuslens.llm.tokens import U64, mix, numbers, shingle_hashes, word_hashes
from corpuslens.operators.joins import salted_join

BANDS, ROWS = 32, 4
SKETCH = 16  # longs of 64 bits
SIGNS = BANDS * ROWS // 8  # longs of eight minima, one byte of each
LOST = 1e-9  # bound of the chance that signature verification turns down a pair at the threshold
EXTRA_HUBS = 16
HOT = 256  # rows of a bucket from which its joins with single rows are dealt over sub-keys
PART = 1024  # rows of a bucket whose pairs with all of the bucket one task forms

INFO = ("n", "sketch", "signs")  # what the tests before the exact one need of a vertex


def minima(shingles: np.ndarray, n_hashes: int) -> np.ndarray:
    """The minimum of each universal hash a * x + b (modulo 2**64) over a set, upper 32 bits."""
    a, b = numbers(11, n_hashes) | U64(1), numbers(12, n_hashes)
    low = np.full(n_hashes, np.iinfo(np.uint64).max, dtype=U64)
    for at in range(0, len(shingles), 2048):  # bounded memory for long texts
        block = np.multiply.outer(a, shingles[at:at + 2048])
        block += b[:, None]
        np.minimum(low, block.min(axis=1), out=low)
    return (low >> U64(32)).astype(np.uint32)


def _band_keys(signature: np.ndarray) -> np.ndarray:
    weights = numbers(13, ROWS)
    grouped = (signature.astype(U64).reshape(BANDS, ROWS) * weights).sum(axis=1, dtype=U64)
    return mix(grouped + numbers(14, BANDS)).view(np.int64)


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of shingles hash to it."""
    bits = 64 * SKETCH
    odd = np.bincount((shingles & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def least_agreement(percent: int, n_hashes: int = BANDS * ROWS, lost: float = LOST) -> int:
    """The number of minima that two sets of similarity ``percent`` share at least, but for a chance of ``lost``."""
    p, below = percent / 100, 0.0
    for agree in range(n_hashes + 1):
        below += comb(n_hashes, agree) * p ** agree * (1 - p) ** (n_hashes - agree)
        if below > lost:
            return agree
    return n_hashes


def _total(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, parts)


def _apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return _total([F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH)])


def _disagree(a: str, b: str) -> Column:
    """Minima in which two signatures differ: bytes of the exclusive or with any bit set, each folded to its lowest."""
    folded = []
    for i in range(SIGNS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        folded.append(F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101))))
    return _total(folded)


def _possible(a: str, b: str, percent: int) -> Column:
    """Can the vertices whose columns end in ``a`` and ``b`` reach the threshold? Sets of similarity t or more differ
    in size by a factor t at most, and in at most (1 - t) / (1 + t) of the sum of their sizes."""
    n_a, n_b = f"n{a}", f"n{b}"
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent
    close = _apart(f"sketch{a}", f"sketch{b}") * (100 + percent) <= (F.col(n_a) + F.col(n_b)) * (100 - percent)
    # the cheaper test first; the next is evaluated only where it holds
    return sizes & close & (_disagree(f"signs{a}", f"signs{b}") <= BANDS * ROWS - least_agreement(percent))


def _sets(frames: Iterator[pd.DataFrame], k: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    for frame in by_bytes(frames, "text"):
        words, at = word_hashes([as_bytes(t).lower() for t in frame["text"]])
        yield frame, [shingle_hashes(words[at[i]:at[i + 1]], k) for i in range(len(frame))]


def signatures(docs: DataFrame, k: int = 2) -> DataFrame:
    """``id, n, fp1, fp2, sketch, signs, bands`` of ``docs(id, text)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, sets in _sets(frames, k):
            signs = [minima(s, BANDS * ROWS) if len(s) else None for s in sets]
            yield pd.DataFrame({
                "id": frame["id"], "n": [len(s) for s in sets],
                "fp1": [int(s.sum(dtype=U64).view(np.int64)) for s in sets],
                "fp2": [int(mix(s).sum(dtype=U64).view(np.int64)) for s in sets],
                "sketch": [parity_sketch(s) if len(s) else None for s in sets],
                "signs": [None if g is None else g.astype(np.uint8).view(np.int64) for g in signs],
                "bands": [None if g is None else _band_keys(g) for g in signs],
            })

    return in_python(docs, run, "id long, n long, fp1 long, fp2 long, sketch array<long>, signs array<long>, bands array<long>")


def shingle_sets(docs: DataFrame, k: int = 2) -> DataFrame:
    """``id, shingles`` (64-bit hashes) of ``docs(id, text)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, sets in _sets(frames, k):
            yield pd.DataFrame({"id": frame["id"], "shingles": [s.view(np.int64) for s in sets]})

    return in_python(docs, run, "id long, shingles array<long>")


def _named(rows: DataFrame, suffix: str, *names: str, plain: list[str] = ()) -> DataFrame:
    return rows.select(*plain, *[F.col(c).alias(f"{c}{suffix}") for c in (*names, *INFO)])


def _passing(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """The pairs ``src, dst`` that pass the tests before the exact one."""
    with_dst = pairs.join(_named(vertices, "_b", "id"), F.col("dst") == F.col("id_b"))
    both = with_dst.join(_named(vertices, "_a", "id"), (F.col("src") == F.col("id_a")) & _possible("_a", "_b", percent))
    return both.select("src", "dst")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``src, dst`` of the pairs whose full sets reach the threshold."""
    sa = sets.select(F.col("id").alias("src"), F.col("shingles").alias("set_a"))
    sb = sets.select(F.col("id").alias("dst"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    return pairs.join(sb, "dst").join(sa, "src").where(both * 100 >= either * percent).select("src", "dst")


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("id_a", "id_b").alias("src"), F.greatest("id_a", "id_b").alias("dst")).distinct()


def _still_open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets with their component; buckets inside one component are left out."""
    now = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    now = stored(now.select("band", "id", "root"), "placed")
    bounds = with_group_stats(now, ["band"], {"_lo": ("min", "root"), "_hi": ("max", "root")}, F.xxhash64("id"))
    return bounds.where("_lo < _hi").drop("_lo", "_hi")


def _hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs, of different components, of every member with the same few members of its bucket: those lowest in a
    fixed pseudo-random order of ids, so that the buckets of one group agree on them."""
    order = F.struct(F.xxhash64(F.col("id") + 1).alias("h"), *[F.col(c) for c in ("id", "root", *INFO)])
    hubs = (rows.select("band", order.alias("o"), F.pmod(F.xxhash64("id"), F.lit(EXTRA_HUBS)).alias("_lane"))
            .groupBy("band", "_lane").agg(F.min_by("o", F.struct("o.h", "o.id")).alias("o"), F.count(F.lit(1)).alias("m")))
    hot = hubs.groupBy("band").agg(F.sum("m").alias("m")).where(F.col("m") > HOT).select("band")
    hubs = hubs.select("band", "o.*")
    pairs = salted_join(_named(rows, "_a", "id", "root", plain=["band"]), _named(hubs, "_b", "id", "root", plain=["band"]),
                        ["band"], hot, SALTS, F.xxhash64("id_a"))
    return _ordered(pairs.where((F.col("root_a") != F.col("root_b")) & _possible("_a", "_b", percent)))


def _rest_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components in a bucket that can reach the threshold; each has a vertex outside the
    bucket's largest component. Those vertices are dealt over sub-keys of about ``PART`` rows."""
    sizes = rows.groupBy("band", "root").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("band").agg(F.max_by("root", F.struct("m", "root")).alias("_big"),
                                        F.ceil(F.sum("m") / PART).cast("long").alias("_parts"))
    placed = join_back(rows, stored(largest, "largest"), ["band"], F.xxhash64("id"))
    placed = placed.withColumn("_out", F.col("root") != F.col("_big"))
    part = F.pmod(F.xxhash64("id"), F.col("_parts"))
    a = _named(placed.where("_out").withColumn("part", part), "_a", "id", "root", plain=["band", "part"])
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
    b = _named(placed.withColumn("part", every), "_b", "id", "root", plain=["band", "part", "_out"])
    pairs = a.join(b, ["band", "part"]).where((F.col("root_a") != F.col("root_b"))
                                              & (~F.col("_out") | (F.col("id_a") < F.col("id_b")))
                                              & _possible("_a", "_b", percent))
    return _ordered(pairs)


def near_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 2,
                    percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` and ``kept``."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    signed = stored(signatures(source, k), "signatures")
    linkable = signed.where("n > 0 and id is not null")
    same = with_group_stats(linkable.select("id", "n", "fp1", "fp2"), ["fp1", "fp2", "n"], {"rep": ("min", "id")},
                            F.xxhash64("id"))
    same = stored(same, "sets")
    reps = same.where("id = rep").select("id", "fp1", "fp2").distinct()
    vertices = (linkable.join(reps, ["id", "fp1", "fp2"]).select("id", *INFO, "bands")
                .dropDuplicates(["id", "n", "sketch"]))
    banded = vertices.select("id", F.explode("bands").alias("band"))
    shared = stored(banded.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("_hi"), F.count(F.lit(1)).alias("m"))
                    .where("hub < _hi").select("band", "hub", "m"), "bands")
    hot = shared.where(F.col("m") > HOT).select("band")
    members = stored(salted_join(banded, shared.select("band", "hub"), ["band"], hot, SALTS, F.xxhash64("id")), "buckets")
    near = members.select("id").distinct()
    sets = stored(shingle_sets(source.join(near, "id", "left_semi"), k), "shingles")
    vertices = stored(vertices.select("id", *INFO).join(near, "id", "left_semi"), "vertices")

    first = members.where("id <> hub").select(F.col("hub").alias("src"), F.col("id").alias("dst")).distinct()
    # pairs are written before they are confirmed, two numbers each: one plan of both steps is several times as long
    roots = star_components(_confirmed(stored(_passing(first, vertices, percent), "pairs"), sets, percent))
    for more in (_hub_pairs, _rest_pairs):
        members = stored(_still_open(members.select("band", "id"), roots).join(vertices, "id"), "open")
        pairs = stored(more(members, percent), "pairs")
        stars = roots.select(F.col("id").alias("src"), F.col("root").alias("dst"))
        roots = star_components(stars.unionByName(_confirmed(pairs, sets, percent)))

    whole = same.select("rep").distinct().join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
    found = (join_back(same, whole, ["rep"], F.xxhash64("id"))
             .select("id", "n", F.coalesce("root", "rep").alias("component_id")))
    empty = signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(empty).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5,
               percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id."""
    dropped = near_components(docs.select(id_col, text), id_col, text, k, percent).where(~F.col("kept"))
    dropped = stored(dropped.select(id_col).distinct(), "dropped")
    names = [f"_c{i}" for i in range(len(docs.columns))]  # columns of any name cannot clash with the key
    ident = names[docs.columns.index(id_col)]
    rows = docs.toDF(*names).join(dropped.select(F.col(id_col).alias(ident)), ident, "left_anti")
    return rows.select(*names).toDF(*docs.columns)
