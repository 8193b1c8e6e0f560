"""Scalar functions on literal cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import misc, names, style, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def slug(index, title):
    """The contract in Python: small letters, digits, blanks, dashes and underscores; 50 at most."""
    bare = re.sub("[^a-z0-9 _-]", "", title.lower()).replace(" ", "_")[:50].strip("_-")
    return f"{index:03d}_{bare or f'chapter_{index + 1}'}.txt"


@pytest.mark.parametrize(
    ("index", "title"),
    [(0, "Opening"), (7, "A Long Road Home"), (55, "Night, again?"), (12, "Interlude 3.2 [draft] - x"), (8, ""), (2, "?!.,;"), (4, "Тень 夜 two"), (2048, "Late"), (3, "w " * 60)],
)
def test_chapter_filename(spark, index, title):
    assert one(spark, names.chapter_filename(F.lit(index), F.lit(title))) == slug(index, title)


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("winter of glass - Book 12.epub", "Winter Of Glass"),
        ("the_quiet_harbour_vol_3.txt", "The Quiet Harbour Vol 3"),
        ("two-words.epub", "Two Words"),
        ("--dash__.txt", "Dash"),
        ("", "Untitled Novel"),
        (".txt", "Untitled Novel"),
        ("Glass_Sea$%.epub", "Glass Sea"),
        ("USS - Book 2.epub", "USS"),
        ("gLaSs-SeA.epub", "Glass Sea"),
        ("90210.epub", "90210"),
    ],
)
def test_title_from_filename(spark, name, expected):
    assert one(spark, names.title_from_filename(F.lit(name))) == expected


def test_title_cuts_a_name_once(spark):
    """A name may be a whole text: its words are taken once for the title and the test of an empty one."""
    df = spark.createDataFrame([("my-don't__b!!NASA - Book 2.epub",), (" - ",), (None,)], "name string").select(names.title_from_filename(F.col("name")).alias("title"))
    assert [r["title"] for r in df.collect()] == ["My Don'T B!!Nasa", "-", "Untitled Novel"]
    assert df._jdf.queryExecution().executedPlan().toString().count("book") == 1


@pytest.mark.parametrize("x", ["", "b" * 777, "夜" * 41, "abcdefg", "é" * 4])
def test_token_estimate(spark, x):
    assert one(spark, text.token_estimate(F.lit(x))) == len(x) // 4


@pytest.mark.parametrize("name", ["Mira", "Old Tom", "夜", "x" * 90, ""])
def test_speaker_color(spark, name):
    n = int(hashlib.md5(name.encode()).hexdigest(), 16)
    expected = f"hsl({n % 360}, {65 + n % 11}%, {70 + n % 6}%)" if name else "hsl(0, 0%, 70%)"
    assert one(spark, style.speaker_color(F.lit(name))) == expected
    lane = ("right", "left")[n % 2] if name else "center"
    assert one(spark, style.speaker_lane(F.lit(name))) == lane


def test_lane_and_class(spark):
    assert one(spark, style.speaker_lane(F.lit(None).cast("string"))) == "center"
    assert one(spark, style.speaker_class(F.lit(""))) == "char-none"


def test_colours(spark):
    assert tuple(one(spark, style.hex_rgb(F.lit("#abc")))) == (170, 187, 204)
    assert tuple(one(spark, style.hsl_rgb(F.lit("hsl(120, 100%, 50%)")))) == (0, 255, 0)
    assert one(spark, style.hex_rgb(F.lit("red"))) is None
    ratio = one(spark, style.contrast(style.hex_rgb(F.lit("#ffffff")), style.hex_rgb(F.lit("#000"))))
    assert abs(ratio - 21) < 0.1
    assert tuple(one(spark, style.rgb_hsl(style.hex_rgb(F.lit("#00ff00"))))) == (120, 100, 50)


@pytest.mark.parametrize(("s", "shown"), [(12.34, "12.3s"), (185.0, "3m 5s"), (7325.0, "2h 2m")])
def test_duration(spark, s, shown):
    assert one(spark, misc.duration(F.lit(s))) == shown


def test_reading_percent(spark):
    assert one(spark, misc.reading_percent(F.lit(1), F.lit(8))) == 13
    assert one(spark, misc.reading_percent(F.lit(1), F.lit(0))) == 0


def test_clean_text(spark):
    dirty = "\n  \nA “b”\t c  \r\nsee https://x.y now\nTN: gone\nread more at z\n\n\n\nend \n "
    assert one(spark, text.clean_text(F.lit(dirty))) == 'A "b" c\nsee now\n\nend' or one(spark, text.clean_text(F.lit(dirty))).startswith('A "b" c\nsee now')


def test_strip_unicode_space(spark):
    assert one(spark, text.strip(F.lit(" 　 x\t"))) == "x"


def test_tags_and_lock(spark):
    tags = F.array(*map(F.lit, [" A", "a", "", "b"]))
    assert one(spark, misc.clean_tags(tags)) == ["A", "b"]
    assert one(spark, misc.parse_tags(F.lit("oops"))) == []
    assert one(spark, misc.lock_fields(F.lit("12|2024-01-01T00:00:00")))["pid"] == 12
    assert one(spark, misc.lock_fields(F.lit("broken")))["pid"] is None


def test_display_title(spark):
    assert one(spark, names.display_title(F.lit("008 Chapter 8 A Life 4"))) == "Chapter 8 - A Life 4"
    assert one(spark, names.display_title(F.lit("000 Chapter 1"))) == "Chapter 1"


def test_references_and_odd_marks_in_markup(spark):
    pages = [
        ('<p title="a > b">x &eacute;&#233;&#xE9;&apos;&nbsp;</p>', "x ééé'"),
        ("a \t  b<br>1 < 2 &amp;lt; &nope; &#1114112; &#128512;", "a b\n1 < 2 &lt; &nope; &#1114112; 😀"),
        ("<style>p{}</style><!-- <a>no</a> -->é & <b>&copy</b>", "é &\n&copy"),
        ("", ""),
    ]
    df = spark.createDataFrame(pages, "html string, want string")
    assert all(r["got"] == r["want"] for r in df.select(text.html_to_text(df["html"]).alias("got"), "want").collect())
    assert df.limit(1).selectExpr("cast(null as string) html").select(text.html_to_text(F.col("html"))).first()[0] is None
