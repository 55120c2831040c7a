"""Ordered page ingest: shuffled, repeated, missing and forked pages, and restarts."""

import json
import random

import pytest

from corpuslens.streaming import pages as PG
from corpuslens.streaming.streams import read_stream


def page(chain, at, n, size=2, **over):
    cursor = lambda i: "" if i == 0 else f"{chain}-{i}"
    return {"chain": chain, "cursor": cursor(at), "has_next_page": at < n - 1, "next_cursor": cursor(at + 1) if at < n - 1 else None,
            "tweets": [{"id": f"{chain}:{at}:{i}", "text": "t"} for i in range(size)]} | over


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def emitted(feed):
    out = {}
    for r in sorted(feed.posts().collect(), key=lambda r: (r.chain, r.page_rank, r.pos)):
        out.setdefault(r.chain, []).append(r.id)
    return out


def in_order(chain, pages):
    return [f"{chain}:{p}:{i}" for p in range(pages) for i in range(2)]


def test_pages_in_any_order_are_emitted_once_in_chain_order(spark, tmp_path):
    rnd = random.Random(6)
    rows = [page("a", i, 9) for i in range(9)] + [page("b", i, 5) for i in range(5) if i != 2] + [page("c", 0, 1)]
    rows += [page("a", 3, 9), page("b", 0, 5)]  # landed twice
    rnd.shuffle(rows)
    feed = PG.PageFeed(spark, str(tmp_path / "feed"))
    for lot in range(4):  # a new query each time, over the same folders
        land(tmp_path / "in", lot, rows[lot::4])
        feed.drain(read_stream(spark, str(tmp_path / "in"), PG.PAGE, "json"), str(tmp_path / "ckpt"))
    assert emitted(feed) == {"a": in_order("a", 9), "b": in_order("b", 2), "c": in_order("c", 1)}
    report = {r.chain: tuple(r)[1:] for r in feed.report().collect()}
    assert report == {"a": (10, 1, 0, 0, 9, 0), "b": (5, 1, 0, 1, 2, 2), "c": (1, 0, 0, 0, 1, 0)}
    land(tmp_path / "in", 9, [page("b", 2, 5)])  # the missing page
    feed.drain(read_stream(spark, str(tmp_path / "in"), PG.PAGE, "json"), str(tmp_path / "ckpt"))
    assert emitted(feed)["b"] == in_order("b", 5)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    feed = PG.PageFeed(spark, str(tmp_path / "feed"))
    lots = [[page("a", 1, 3)], [page("a", 0, 3), page("a", 2, 3)]]
    for n, rows in enumerate(lots):
        df = spark.createDataFrame(rows, PG.PAGE)
        feed.append(df, n)
        once = emitted(feed)
        feed.append(df, n)
        assert emitted(feed) == once
    assert once == {"a": in_order("a", 3)}


def test_forks_circles_and_odd_pages(spark, tmp_path):
    rows = [page("f", 0, 3), page("f", 0, 3, next_cursor="x", tweets=[]), page("f", 1, 3), page("f", 2, 3),
            page("o", 0, 4), page("o", 1, 4, next_cursor="o-2"), page("o", 2, 4, next_cursor="o-1"),
            {**page("n", 0, 2), "tweets": None}, page("n", 1, 2, next_cursor=None, has_next_page=True), {**page("z", 0, 1), "chain": None}]
    feed = PG.PageFeed(spark, str(tmp_path / "feed"))
    feed.append(spark.createDataFrame(rows, PG.PAGE), 0)
    got = emitted(feed)
    assert got["f"] == in_order("f", 3) and got["n"] == ["n:1:0", "n:1:1"] and set(got) == {"f", "o", "n"}
    report = {r.chain: r for r in feed.report().collect()}
    assert report["f"].forks == 1 and report["f"].gaps == 1 and None not in report
    feed.append(spark.createDataFrame([], PG.PAGE), 1)
    assert emitted(feed) == got


@pytest.mark.parametrize("size", [1, 2, 7, 33])
def test_runs_by_pointer_doubling(spark, size):
    rows = [("c", str(i), str(i + 1)) for i in range(size)] + [("d", "x", "y"), ("d", "y", "x"), ("d", "0", None), ("c", "tail", "0")]
    runs = PG.link_runs(spark.createDataFrame(rows, "chain string, cursor string, next_cursor string"))
    got = {(r.chain, r.cursor): (r.head, r.steps) for r in runs.collect()}
    assert got["c", str(size - 1)] == ("tail", size) and got["c", "tail"] == ("tail", 0) and got["d", "0"] == ("0", 0)
    assert got["d", "x"][0] is None and got["d", "y"][0] is None
