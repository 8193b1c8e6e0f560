"""Operators on small frames: ties, nulls, repeated keys, odd patterns."""

import datetime

from pyspark.sql import functions as F

from scriptorium.functions import misc, names, text
from scriptorium.operators import glossary, library, segment, state


def chapters(spark, rows, **options):
    found = segment.split_chapters(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    return sorted((r["doc_id"], r["index"], r["title"], r["content"]) for r in found)


def test_islands_with_ties(spark):
    rows = [(1, 0, "narrator", "b"), (1, 0, "narrator", "a"), (1, 0, "dialogue", "c"), (1, 1, "narrator", None), (1, 1, "narrator", None), (1, 2, None, "z"), (1, 2, None, "z")]
    got = segment.islands(spark.createDataFrame(rows, "chapter long, block_index int, type string, speaker string")).collect()
    by = sorted((r["block_index"], r["type"] or "", r["island"], r["merge_top"], r["merge_bottom"]) for r in got)
    assert by == [
        (0, "dialogue", 1, False, False), (0, "narrator", 2, False, True), (0, "narrator", 2, True, True), (1, "narrator", 2, True, False), (1, "narrator", 2, True, True),
        (2, "", 3, False, False), (2, "", 3, False, False),
    ]


def test_texts_of_one_key_stay_apart(spark):
    a, b = "x\nChapter 1\none\nCh. 2 Two\ntwo", "Episode 9\nnine"
    rows = [(7, a), (7, b), (7, a)]
    one = [(7, 0, "Chapter 1", "Chapter 1\none"), (7, 1, "Ch. 2 Two", "Ch. 2 Two\ntwo")]
    assert chapters(spark, rows) == sorted([*one, *one, (7, 0, "Episode 9", "Episode 9\nnine")])
    found = segment.split_chapters(spark.createDataFrame([(None, "a"), (None, None), (1, "")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["title"], r["content"]) for r in found) == [("1", "Chapter 1", ""), ("None", "Chapter 1", ""), ("None", "Chapter 1", "a")]


def test_markers_numbers_and_patterns(spark):
    assert chapters(spark, [(1, "chapter\n\n12 x\nbody")]) == [(1, 0, "chapter", "chapter\n\n12 x\nbody")]
    assert chapters(spark, [(1, "pre\n007\na\n 8 \nb\n10\nc")]) == [(1, 0, "7", "007\na"), (1, 1, "8", "8 \nb\n10\nc")]
    assert chapters(spark, [(1, "5\na\n7\nb")]) == [(1, 0, "Chapter 1", "5\na\n7\nb")]
    assert chapters(spark, [(1, "in\nsee Part 1 and part 2\nx\nPart 3\ny")], pattern=r"Part \d+") == [
        (1, 0, "see Part 1 and part 2", "see Part 1 and part 2\nx"), (1, 1, "Part 3", "Part 3\ny"),
    ]
    assert chapters(spark, [(1, "a\n***\nTitle\nb")], pattern=r"^\*+\n\w+$") == [(1, 0, "***", "***\nTitle\nb")]
    assert chapters(spark, [(1, "\x01\x02 a\nChapter 1\n\x01\x03")]) == [(1, 0, "Chapter 1", "Chapter 1\n\x01\x03")]
    assert "Exchange" not in segment.split_chapters(spark.range(1).selectExpr("id doc_id", "'x' text"))._jdf.queryExecution().executedPlan().toString()


def test_sections(spark):
    rows = [(1, "pre\n\nChapter 1\none\n== x\n2. y\n\nend\n"), (1, "Chapter 2"), (2, None), (2, ""), (3, "\n")]
    found = segment.split_sections(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["index"], r["title"], r["content"]) for r in found) == [
        (1, 0, "Chapter 1", "pre\n"), (1, 1, "Chapter 1", "one"), (1, 2, "2. y", "\nend\n"), (3, 0, "Chapter 1", "\n"),
    ]


def test_states_without_status_and_repeated_changes(spark):
    rows = spark.createDataFrame([("html",), ("failed",), (None,)], "status string")
    assert {r["status"] for r in state.eligible(rows, "json").collect()} == {"failed", None}
    table = spark.createDataFrame([(1, None, "a", "x")], "id long, novel_id long, phase string, status string")
    changes = spark.createDataFrame([(None, "a", "y"), (None, "a", "z"), (5, "a", "p"), (5, "a", "q")], "novel_id long, phase string, status string")
    got = library.upsert(table, changes, ["novel_id", "phase"])
    assert sorted((r["id"], r["novel_id"], r["status"]) for r in got.collect()) == [(1, None, "z"), (2, 5, "q")]


def test_issue_numbers_within_a_day(spark):
    ts = lambda d, h: datetime.datetime(2024, 1, d, h)
    rows = [(ts(1, 5), 1, "c", "p", "k"), (ts(1, 6), 2, "c", "p", "k"), (ts(1, 4), 3, "d", "p", "k"), (ts(2, 1), 4, "e", "p", "k")]
    got = state.number_issues(spark.createDataFrame(rows, "ts timestamp, id long, chapter string, phase string, kind string")).collect()
    assert {r["id"]: r["issue_id"] for r in got} == {3: "ISSUE-2024-01-01-001", 1: "ISSUE-2024-01-01-002", 4: "ISSUE-2024-01-02-001"}


def test_totals_tell_a_null_category_from_the_sum(spark):
    rows = spark.createDataFrame([("a",), (None,), (None,)], "category string")
    assert {(r["category"], r["entries"], r["is_total"]) for r in glossary.totals(rows).collect()} == {("a", 1, False), (None, 2, False), (None, 3, True)}


def test_update_and_belonging(spark):
    rows = spark.createDataFrame([(1, "a", "s", "t")], "id long, title string, status string, updated_at string")
    assert library.update_fields(rows, 1, ["title"], F.lit("now"), id=9) is rows
    assert tuple(library.update_fields(rows, 1, ["title"], F.lit("now"), title="b", status="no").first()) == (1, "b", "s", "now")
    own = spark.createDataFrame([(1, 5), (2, None)], "id long, novel_id long")
    asked = spark.createDataFrame([(5, 1), (None, 2), (5, 2)], "novel_id long, chapter_id long")
    assert {(r["novel_id"], r["chapter_id"], r["found"]) for r in library.belonging(asked, own).collect()} == {(5, 1, True), (None, 2, False), (5, 2, False)}


def test_odd_pages_and_payloads(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(misc.series_page(F.lit("<p>none</p>"))) is None and one(misc.series_page(F.lit(None).cast("string"))) is None
    page = one(misc.series_page(F.lit('<h1 class="series-title">T</h1>')))
    assert (page["title"], page["author"], page["tags"], page["status"]) == ("T", None, [], "active")
    assert one(misc.series_record(F.lit("[]"), "https://x.y")) is None
    record = one(misc.series_record(F.lit('{"data": [{"title": "A", "coverUrl": "http://c"}, {"title": "B"}]}'), "https://x.y"))
    assert (record["title"], record["cover_url"], record["tags"]) == ("A", "http://c", [])


def test_small_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.clean_text(F.lit(None).cast("string"))) == ""
    assert one(text.clean_text(F.lit("\n  a\u3000\n \t\n b \n\n"))) == "a\n\nb"
    assert one(text.paragraph_count(F.lit("a\n \n\u3000b\n"))) == 2 and one(text.word_count(F.lit(" a\u3000b\n"))) == 2
    assert one(names.suffix(F.lit("x/y.tar.GZ"))) == ".GZ"
