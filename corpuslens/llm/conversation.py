"""Conversation structure repair by an auction algorithm for shortest paths.

A repaired conversation has the roles ``(system? (user assistant)+)?``. Each row may be kept, given
another role, or deleted, and empty rows may be inserted; a row's kind says what each edit costs. The
cheapest edits are a shortest path through a lattice of (rows read, state of the role pattern).

1. Spark puts all rows in order by range partitions, so that one conversation may lie in many tasks,
   finds each row's fault, and cuts the rows into segments of at most ``SEGMENT`` rows.
2. Bertsekas's auction algorithm works on the lattice of one segment: every node has a price, the path
   from the origin is extended along an arc whose cost equals the difference of the prices, or else its
   last node's price is raised to the cheapest way on and the path contracted. Prices never break
   ``price(i) <= cost(i, j) + price(j)``; when the path reaches the sink, the origin's price is its
   distance. Costs are integers, so prices rise by whole steps.
3. A conversation of several segments needs the distances from each of the four states at a segment's
   start to each at its end. Read from its last segment to its first, these give the price of every state
   at every border; one row of sixteen numbers per segment passes there.
4. Arcs that the converged prices leave tight (``price(i) = cost + price(j)``) and that lead to the sink
   by tight arcs hold all shortest paths. No node has two arcs of the same letter, so walking the least
   letter first gives the least string of edits. Inserts at a border belong to the next segment.
5. A sorted stream over the rows of each conversation applies the edits and hashes the lines. SHA-256 reads
   a conversation from its first line to its last, so this one step takes one task per conversation, in
   memory that does not grow with the number of lines but for the string of edits that is returned.

Rows with the same conversation and turn are taken by role, then text. Null roles, texts, and nulls
in the damage key are read as one space; rows with a null conversation are one conversation; null turns
come first. An empty role begins with no letter, so such a row cannot be kept. Conversations without rows
have zeros and empty strings; an empty table gives an empty result. Columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import in_python, stored, with_group_stats

SEGMENT = 32
SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired roles so far end with
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
ACCEPTED = (0, None, None, 0)  # a conversation may end empty or after an assistant
Arc = tuple[str, int, int]  # letter, node, cost


def _other(state: int) -> int:
    """The state after a row whose role is chosen freely."""
    return ASSISTANT if state == USER else USER


def lattice(kinds: str, ends: tuple, last: bool) -> list[list[Arc]]:
    """Arcs of the nodes 4 * rows + state of one segment; the last node is the sink.

    ``kinds`` has a letter per row: s, u, a or x (another role), upper case if truncated, d if it must be
    deleted. ``ends`` gives the price of each state behind the segment, None where there is no way on."""
    n = len(kinds)
    sink = 4 * (n + 1)
    arcs: list[list[Arc]] = [[] for _ in range(sink + 1)]
    for i in range(n + 1):
        for state in range(4):
            out = arcs[4 * i + state]
            if i < n or last:
                out.append(("I", 4 * i + _other(state), INSERT))
            if i == n:
                if ends[state] is not None:
                    out.append(("", sink, ends[state]))
                continue
            below = 4 * (i + 1)
            out.append(("D", below + state, DELETE))
            if kinds[i] == "d":
                continue
            more = TRUNCATED if kinds[i].isupper() else 0
            out.append(("R", below + _other(state), REROLE + more))
            if state in KEEPS.get(kinds[i].lower(), {}):
                out.append(("K", below + KEEPS[kinds[i].lower()][state], more))
    return _leading(arcs, lambda arc, node: True)


def _leading(arcs: list[list[Arc]], use) -> list[list[Arc]]:
    """The arcs, among those that ``use`` allows, that end where such arcs lead on to the last node."""
    into: list[list[int]] = [[] for _ in arcs]
    for node, out in enumerate(arcs):
        for arc in out:
            if use(arc, node):
                into[arc[1]].append(node)
    good, todo = {len(arcs) - 1}, [len(arcs) - 1]
    while todo:
        for node in into[todo.pop()]:
            if node not in good:
                good.add(node)
                todo.append(node)
    return [[arc for arc in out if arc[1] in good and use(arc, node)] for node, out in enumerate(arcs)]


def auction(arcs: list[list[Arc]], origin: int, price: list[int]) -> int | None:
    """The distance from ``origin`` to the last node, None if there is no way. ``price`` must fulfil
    price(i) <= cost + price(j) for all arcs, as zeros do; it is raised in place and serves further origins."""
    sink = len(arcs) - 1
    if not arcs[origin]:
        return None
    path = [origin]
    while path[-1] != sink:
        node = path[-1]
        level, best = min((cost + price[to], to) for _, to, cost in arcs[node])
        if price[node] < level:
            price[node] = level
            if node != origin:
                path.pop()
        else:
            path.append(best)
    return price[origin] - price[sink]


@lru_cache(maxsize=1 << 15)
def distances(kinds: str, last: bool) -> tuple:
    """Sixteen distances of a segment, entry by exit; None where there is no way. Behind the last segment
    the exits are the accepted ends."""
    table: list[int | None] = [None] * 16
    for out in range(4):
        if last and ACCEPTED[out] is None:
            continue
        arcs = lattice(kinds, tuple(0 if q == out else None for q in range(4)), last)
        price = [0] * len(arcs)
        for state in range(4):
            table[4 * state + out] = auction(arcs, state, price)
    return tuple(table)


@lru_cache(maxsize=1 << 15)
def edits(kinds: str, ends: tuple, last: bool) -> tuple[tuple, tuple, tuple]:
    """For each entry state: the cost to the end of the conversation, the exit state of the segment and the
    least string of edits; None, -1 and an empty string where there is no way."""
    arcs = lattice(kinds, ends, last)
    price = [0] * len(arcs)
    cost = tuple(auction(arcs, state, price) for state in range(4))
    tight = _leading(arcs, lambda arc, node: price[node] == arc[2] + price[arc[1]])
    exits, letters = [], []
    for state in range(4):
        node, audit = state, []
        if cost[state] is not None:
            while (step := min(tight[node]))[1] != len(arcs) - 1:
                audit.append(step[0])
                node = step[1]
        exits.append(node % 4 if cost[state] is not None else -1)
        letters.append("".join(audit))
    return cost, tuple(exits), tuple(letters)


def _known(values) -> tuple:
    return tuple(None if v is None or v != v or v < 0 else int(v) for v in values)


def _ends(segments: DataFrame) -> DataFrame:
    """``key, seg, ends``: the price of each state behind every segment. Segments of a conversation pass from the
    last to the first, one row of sixteen numbers each."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            table = [[-1 if d is None else d for d in distances(k, bool(z))] for k, z in zip(frame["kinds"], frame["last"])]
            yield pd.DataFrame({"key": frame["key"], "seg": frame["seg"], "last": frame["last"], "table": table})

    def back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after: tuple = ACCEPTED
        for frame in frames:
            ends = []
            for is_last, table in zip(frame["last"], frame["table"]):
                after = ACCEPTED if is_last else after
                ends.append([-1 if e is None else e for e in after])
                way = _known(table)
                after = tuple(min((way[4 * q + z] + after[z] for z in range(4)
                                   if way[4 * q + z] is not None and after[z] is not None), default=None)
                              for q in range(4))
            yield pd.DataFrame({"key": frame["key"], "seg": frame["seg"], "ends": ends})

    tables = in_python(segments, solve, "key string, seg long, last boolean, table array<int>")
    rows = tables.repartition("key").sortWithinPartitions("key", F.desc("seg"))
    return in_python(rows, back, "key string, seg long, ends array<int>")


def _solved(segments: DataFrame) -> DataFrame:
    """``key, idx, cost, exits, letters`` of every segment, by entry state."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [edits(k, _known(e), bool(z)) for k, e, z in zip(frame["kinds"], frame["ends"], frame["last"])]
            yield pd.DataFrame({"key": frame["key"], "idx": frame["idx"],
                                "cost": [[-1 if c is None else c for c in f[0]] for f in found],
                                "exits": [list(f[1]) for f in found], "letters": [list(f[2]) for f in found]})

    one = segments.where("first and last").withColumn("ends", F.array(*[F.lit(-1 if e is None else e) for e in ACCEPTED]))
    many = segments.where("not (first and last)")
    joined = many.join(_ends(many.select("key", "seg", "kinds", "last")), ["key", "seg"])
    names = ["key", "idx", "kinds", "last", "ends"]
    return in_python(one.select(*names).unionByName(joined.select(*names)), run,
                     "key string, idx long, cost array<int>, exits array<int>, letters array<string>")


class _Reader:
    """Applies a conversation's edits to its rows as they pass and hashes the repaired lines."""

    def __init__(self, key: str):
        self.key, self.state, self.cost, self.illegal = key, START, None, 0
        self.before: str | None = None
        self.audit: list[str] = []
        self.todo: Iterator[str] = iter("")
        self.entry, self.lines, self.sha = START, 0, hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.sha.update(b"\n" * (self.lines > 0) + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _free(self) -> str:
        self.state = _other(self.state)
        return "assistant" if self.state == ASSISTANT else "user"

    def segment(self, cost, exits, letters) -> None:
        if self.cost is None:
            self.cost = int(cost[START])
        self.audit.append(letters[self.entry])
        self.todo = iter(letters[self.entry])
        self.entry = int(exits[self.entry])

    def row(self, role: str, text: str) -> None:
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        for letter in self.todo:
            if letter == "I":
                self._line(self._free(), "")
                continue
            if letter == "R":
                self._line(self._free(), text)
            elif letter == "K":
                self.state = KEEPS[role[:1]][self.state]
                self._line(role, text)
            return

    def result(self) -> tuple:
        for _ in self.todo:  # inserts behind the last row
            self._line(self._free(), "")
        return self.key, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _read(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """``key, illegal, cost, audit, repaired_sha256``: one sorted stream per conversation."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "illegal", "cost", "audit", "repaired_sha256"]
        now: _Reader | None = None
        for frame in frames:
            done = []
            for key, flag, role, text, cost, exits, letters in zip(*[frame[c] for c in (
                    "key", "flag", "role", "text", "cost", "exits", "letters")]):
                if now is None or now.key != key:
                    if now is not None:
                        done.append(now.result())
                    now = _Reader(key)
                if flag == 0:
                    now.segment(cost, exits, letters)
                else:
                    now.row(role, text)
            if done:
                yield pd.DataFrame(done, columns=names)
        if now is not None:
            yield pd.DataFrame([now.result()], columns=names)

    plans = solved.select("key", "idx", F.lit(0).alias("flag"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("string").alias("text"), "cost", "exits", "letters")
    texts = rows.select("key", "idx", F.lit(1).alias("flag"), "role", "text",
                        *[F.lit(None).cast(plans.schema[c].dataType).alias(c) for c in ("cost", "exits", "letters")])
    both = plans.unionByName(texts).repartition("key").sortWithinPartitions("key", "idx", "flag")
    return in_python(both, run, "key string, illegal long, cost long, audit string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that the CRC-32 of ``conv_id:turn`` names."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")), F.lit(20))
    hurt = rows.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"),
                       kind.alias("_kind")).where("_kind <> 0")
    text = (F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _key(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text)`` that has rows: ``key`` (its id as text behind
    a plus sign, or a minus sign for null), ``gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``."""
    source = rows.select(_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"),
                         *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # idx rises over the whole table; written once, since range bounds are sampled
    ordered = stored(source.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                     .withColumn("idx", F.monotonically_increasing_id()), "conversations")
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    seen = ordered.select("key", "turn", "idx", F.substring("role", 1, 1).alias("initial"),
                          F.sha2(F.concat("role", F.lit("\x00"), "text"), 256).alias("dig"),
                          (end == "").alias("is_blank"), (~end.isin(".", "!", "?")).alias("is_cut"))
    seen = with_group_stats(seen, ["key", "dig"], {"_first": ("min", "idx")}, F.col("idx"))
    fault = (F.when(F.col("is_blank"), "blank").when(F.col("idx") > F.col("_first"), "duplicate")
             .when(F.col("is_cut"), "truncated").otherwise("none"))
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("x"))
    kind = (F.when(F.col("fault").isin("blank", "duplicate"), F.lit("d"))
            .when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter))
    narrow = stored(seen.withColumn("fault", fault).select("key", "turn", "idx", "fault", kind.alias("kind")), "kinds")

    counts = narrow.groupBy("key").agg(
        *[F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.min("idx").alias("_lo"), F.max("idx").alias("_hi"))
    turns = (narrow.where("turn is not null").select("key", "turn").distinct().groupBy("key")
             .agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps")))
    counts = stored(counts.join(turns, "key", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0))), "counts")
    segments = (narrow.groupBy("key", F.floor(F.col("idx") / SEGMENT).alias("seg"))
                .agg(F.min("idx").alias("idx"), F.max("idx").alias("_end"), F.sort_array(F.collect_list(F.struct("idx", "kind"))).alias("k")))
    segments = segments.select("key", "seg", "idx", "_end", F.concat_ws("", F.col("k.kind")).alias("kinds"))
    bounds = counts.select("key", "_lo", "_hi")
    segments = stored(segments.join(bounds, "key").select(
        "key", "seg", "idx", "kinds", (F.col("idx") == F.col("_lo")).alias("first"),
        (F.col("_end") == F.col("_hi")).alias("last")), "segments")
    read = _read(ordered, _solved(segments))
    return counts.join(read, "key").select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                           "repaired_sha256")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The contract's columns for every conversation of the table, damaged first."""
    table = conversations.select("conv_id", "turn", "role", "text")
    every = table.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    done = every.join(repair(damage(table)), "key", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return done.select("conv_id", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers],
                       F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
