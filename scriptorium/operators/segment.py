"""Texts into chapters and blocks.

A text is cut inside its own row: headers get a mark by one regular expression, the text is
split at the marks, and the parts become rows. Nothing is shuffled, so texts with equal,
repeated or null keys stay apart. The marks begin with a control character that is escaped
in the text before and put back after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import strip
from scriptorium.operators.ranking import rank_in_groups
from scriptorium.operators.scan import placed

# What marks a chapter.
MARKER = r"^[ \t]*(?:chapter|ch\.?|episode|ep\.?)\s+\d+.*$"
NUMBER_LINE = r"^[ \t]*(\d+)[ \t]*$"
SECTION_HEADERS = r"chapter[^\S\n]+\d+|第[一二三四五六七八九十百千]+章|\d+\.|==+"

_ESCAPE, _ESCAPED, _HIT, _HEAD = "\x01", "\x01\x02", "\x01\x03", "\x01\x04"


def lines_of(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, line) of ``texts(key, text)``."""
    return texts.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _escaped(text: str) -> Column:
    return F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(_ESCAPE), F.lit(_ESCAPED))


def _unescaped(part: Column) -> Column:
    return F.replace(part, F.lit(_ESCAPED), F.lit(_ESCAPE))


def _cut_at_lines(text: Column, pattern: str) -> Column:
    """The text split before each line in which a match of ``pattern`` begins."""
    hit = F.regexp_replace(text, f"(?dim){pattern}", f"{_HIT}$0")
    head = F.regexp_replace(hit, f"(?dm)^(?=.*{_HIT})", _HEAD)
    return F.split(F.replace(head, F.lit(_HIT), F.lit("")), _HEAD)


def number_run(text: Column) -> Column:
    """How many standalone numbers, from the first of the text on, rise by exactly one; 0 if
    there are fewer than two."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(f"(?dm){NUMBER_LINE}")), lambda n: F.try_to_number(n, F.lit("9" * 38)))
    steps = F.transform(numbers, lambda n, i: n - i)
    broken = F.array_position(F.transform(steps, lambda n: F.coalesce(n == F.get(steps, F.lit(0)), F.lit(False))), False)
    run = F.when(broken > 0, broken - 1).otherwise(F.size(numbers))
    return F.when(run >= 2, run).otherwise(0).cast("int")


def split_chapters(texts: DataFrame, key: str = "doc_id", pattern: str | None = None) -> DataFrame:
    """(key, index, title, content): chapters from 0, each from the start of its header line.

    Headers are chapter markers, or the matches of ``pattern`` in any case and with ``^`` and
    ``$`` at lines; a match may begin inside a line and go over several. Without any marker,
    a run of standalone numbers. Text before the first header is dropped; a text without
    headers, or no text, is one chapter ``Chapter 1``. Several matches in one line are one
    header.
    """
    numbered = pattern is None
    rows = texts.select(key, _escaped("text").alias("text")).withColumn("parts", _cut_at_lines(F.col("text"), MARKER if numbered else f"(?:{pattern})"))
    if numbered:
        rows = rows.withColumn("run", F.when(F.size("parts") > 1, 0).otherwise(number_run(F.col("text"))))
        at = _cut_at_lines(F.col("text"), NUMBER_LINE)
        cut_ = F.concat(F.slice(at, 1, F.col("run")), F.array(F.array_join(F.slice(at, F.col("run") + 1, F.size(at)), "")))
        rows = rows.withColumn("parts", F.when(F.col("run") > 0, cut_).otherwise(F.col("parts")))
    first = lambda p: strip(_unescaped(F.substring_index(p, "\n", 1)))
    title = (lambda p: F.when(F.col("run") > 0, F.regexp_replace(first(p), r"^0+(?=\d)", "")).otherwise(first(p))) if numbered else first
    chapters = F.transform(F.slice("parts", 2, F.size("parts")), lambda p: F.struct(title(p).alias("title"), strip(_unescaped(p)).alias("content")))
    whole = F.array(F.struct(F.lit("Chapter 1").alias("title"), strip(_unescaped(F.col("text"))).alias("content")))
    return rows.select(key, F.posexplode(F.when(F.size("parts") > 1, chapters).otherwise(whole)).alias("index", "c")).select(key, "index", "c.title", "c.content")


def split_sections(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, index, title, content): sections whose header lines are not content; text before
    the first header is "Chapter 1"; a header without content is lost; a text without
    sections is one, an empty or null text none."""
    header = rf"(?dimU)^[^\S\n]*(?:{SECTION_HEADERS}).*$"
    rows = texts.select(key, _escaped("text").alias("text")).where("text <> ''")
    marked = F.regexp_replace(F.concat("text", F.lit("\n")), header, f"{_HIT}$0{_HEAD}")
    rows = rows.withColumn("parts", F.split(marked, _HIT))
    lines = lambda p: F.substring_index(p, _HEAD, -1)
    before = F.element_at("parts", 1)
    preamble = F.struct(F.lit("Chapter 1").alias("title"), F.concat(F.lit("\n"), before).alias("lines"))
    later = F.transform(F.slice("parts", 2, F.size("parts")), lambda p: F.struct(strip(_unescaped(F.substring_index(p, _HEAD, 1))).alias("title"), lines(p).alias("lines")))
    found = F.filter(F.concat(F.array(preamble), later), lambda s: F.length(s["lines"]) > 1)
    each = rows.select(key, F.posexplode(found).alias("index", "s"))
    body = F.substring("s.lines", F.lit(2), F.length("s.lines") - 2)
    return each.select(key, "index", "s.title", _unescaped(body).alias("content"))


def boundaries_with_ends(marks: DataFrame, key: str, start: str, length: Column) -> DataFrame:
    """Adds ``end`` to boundaries: the next one's start, or the text's length."""
    return placed(marks, [key], [F.col(start)]).with_neighbours(F.col(start), None, "__next").with_columns({"end": F.coalesce(F.col("__next"), length)}).result().drop("__next")


def renumbered(rows: DataFrame, key: str, order: str, keep: Column) -> DataFrame:
    """Rows that pass ``keep``, with ``index`` from 0 without gaps."""
    kept = rank_in_groups(rows.where(keep), [key], [F.col(order)], "__nth")
    return kept.withColumn("index", (F.col("__nth") - 1).cast("int")).drop("__nth")


def islands(blocks: DataFrame, key: str = "chapter", order: str = "block_index", kind: str = "narrator") -> DataFrame:
    """Adds ``island`` (consecutive blocks of one type share it), ``merge_top`` and
    ``merge_bottom`` (a block of ``kind`` with one of its island before or after it).
    Blocks of equal ``order`` come by type and then by their other columns."""
    rest = [c for c in blocks.columns if c not in (key, order, "type")]
    ordered = placed(blocks, [key], [F.col(c) for c in (order, "type", *rest)])
    near = ordered.with_neighbours(F.struct("type"), "__prev", "__next")  # a struct, as a type may be null
    same = lambda c: F.coalesce(F.col(c).isNotNull() & F.col("type").eqNullSafe(F.col(c)["type"]), F.lit(False))
    of_kind = F.coalesce(F.col("type") == kind, F.lit(False))
    flagged = near.with_columns({"merge_top": of_kind & same("__prev"), "merge_bottom": of_kind & same("__next"), "__new": (~same("__prev")).cast("long")})
    return flagged.with_running_sum(F.col("__new"), "island").result().drop("__prev", "__next", "__new")


def block_stats(blocks: DataFrame, words: Column) -> DataFrame:
    """(chapter, type, blocks, words), and of each chapter its totals."""
    counted = blocks.groupBy("chapter", "type").agg(F.count("*").alias("blocks"), F.sum(words).alias("words"))
    all_ = Window.partitionBy("chapter")
    return counted.withColumns({"total_blocks": F.sum("blocks").over(all_), "total_words": F.sum("words").over(all_)})
