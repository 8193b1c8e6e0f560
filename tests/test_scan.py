"""Ordered scans against plain loops, on groups that lie in one range and in many."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import corrections, library, segment, state
from scriptorium.operators.scan import placed


@pytest.fixture
def rows():
    rng = random.Random(2)
    keys = ["hot"] * 3000 + [None] * 200 + [f"g{n}" for n in range(50) for _ in range(rng.randrange(1, 6))]
    out = [(k, n, rng.choice(["narrator", "dialogue", None]), rng.randrange(10)) for n, k in enumerate(keys)]
    rng.shuffle(out)
    return out


def by_group(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_scans_equal_loops(spark, rows):
    df = spark.createDataFrame(rows, "k string, n long, type string, v long")
    p = placed(df, ["k"], [F.col("n")])
    assert p.rows.where("k = 'hot'").select("__range").distinct().count() > 1
    got = p.with_neighbours(F.col("type"), "prev", "next").with_running_sum(F.col("v"), "total").with_chain(F.col("n") * 3, F.col("v"), "start").result()
    want = set()
    for group in by_group(rows).values():
        total, free = 0, None
        for i, (k, n, kind, v) in enumerate(group):
            total += v
            start = 3 * n if free is None else max(3 * n, free)
            free = start + v
            want.add((k, n, kind, v, group[i - 1][2] if i else None, group[i + 1][2] if i + 1 < len(group) else None, total, start))
    assert {tuple(r) for r in got.select("k", "n", "type", "v", "prev", "next", "total", "start").collect()} == want


def test_islands_over_many_ranges(spark, rows):
    df = spark.createDataFrame([(k, n, kind) for k, n, kind, _ in rows], "chapter string, block_index long, type string")
    want = set()
    for group in by_group(rows).values():
        island, kinds = 0, [r[2] for r in group]
        for i, (k, n, kind, _) in enumerate(group):
            same_before, same_after = i > 0 and kinds[i - 1] == kind, i + 1 < len(kinds) and kinds[i + 1] == kind
            island += not same_before
            want.add((k, n, island, kind == "narrator" and same_before, kind == "narrator" and same_after))
    got = segment.islands(df).select("chapter", "block_index", "island", "merge_top", "merge_bottom")
    assert {tuple(r) for r in got.collect()} == want


def test_ends_context_numbers_and_neighbours(spark, rows):
    df = spark.createDataFrame([(k, n) for k, n, _, _ in rows], "k string, n long")
    ends = {(r["k"], r["n"]): r["end"] for r in segment.boundaries_with_ends(df, "k", "n", F.lit(-1)).collect()}
    index = {(r["k"], r["n"]): r["index"] for r in segment.renumbered(df, "k", "n", F.col("n") % 2 == 0).collect()}
    context = {(r["chapter"], r["block_index"]): r["context_json"] for r in corrections.with_context(df.toDF("chapter", "block_index")).collect()}
    ids = df.select(F.col("n").alias("id"), F.col("k").alias("novel_id"), F.col("n").alias("chapter_index"))
    near = {(r["novel_id"], r["id"]): (r["prev_id"], r["next_id"]) for r in library.neighbour_ids(ids).collect()}
    for k, group in by_group(rows).items():
        places = [r[1] for r in group]
        for i, n in enumerate(places):
            before, after = places[i - 1] if i else None, places[i + 1] if i + 1 < len(places) else None
            assert ends[k, n] == (-1 if after is None else after) and near[k, n] == (before, after)
            parts = [f'"{name}":{{"block_index":{x}}}' for name, x in (("preceding", before), ("following", after)) if x is not None]
            assert context[k, n] == "{" + ",".join(parts) + "}"
        assert [index[k, n] for n in places if n % 2 == 0] == list(range(sum(n % 2 == 0 for n in places)))


def test_pacing_with_and_without_durations(spark):
    calls = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 1, None), ("a", 3, 100, 1), ("b", 4, 5, 2)], "g string, id long, t long, took long")
    start = lambda df: {r["id"]: r["start"] for r in df.collect()}
    assert start(state.paced(calls, ["g"], "t", 4, "took")) == {1: 0, 2: 14, 3: 100, 4: 5}
    assert start(state.paced(calls, ["g"], "t", 4)) == {1: 0, 2: 4, 3: 100, 4: 5}
    assert state.paced(calls.limit(0), ["g"], "t", 4).count() == 0
