"""Names of files, chapters and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import strip

UNTITLED = "Untitled Novel"
# The patterns of this module (extensions, "- Book N", "_chapter_N", "Chapter N",
# the characters of a slug and its 50) decide results.


def basename(path: Column) -> Column:
    """After the last slash, without a fragment."""
    return F.substring_index(F.substring_index(path, "/", -1), "#", 1)


def stem(path: Column) -> Column:
    """The base name without its last extension (a leading dot starts none)."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(F.substring_index(path, "/", -1), r".(\.[^.]*)$", 1)


def title_case(x: Column) -> Column:
    """A capital after any character that is no letter, small letters else."""
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
    runs = F.regexp_extract_all(x, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.when(F.rlike(x, F.lit(r"\P{L}")), F.array_join(F.transform(runs, capital), "")).otherwise(capital(x))


def humanise(name: Column) -> Column:
    """Underscores and hyphens as spaces."""
    return F.translate(name, "_-", "  ")


def title_from_filename(name: Column) -> Column:
    """A readable title: no extension, nothing from "- Book N" on, marks at the ends of words
    off, words in title case but for acronyms of up to four letters."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\.(?:epub|txt|pdf|mobi)$", "")
    cut = F.regexp_replace(bare, r"(?is)(?<!\s)\s*-\s*book\s+\d+.*$", "")
    # Words lie between spaces, underscores and hyphens; each is taken from its first to its last letter or digit.
    words = F.regexp_extract_all(cut, F.lit(r"(?U)[a-zA-Z0-9](?:[^\s_-]*[a-zA-Z0-9])?"), 0)
    acronym = lambda w: (F.length(w) <= 4) & (w == F.upper(w)) & (w != F.lower(w))
    titled = F.array_join(F.transform(words, lambda w: F.when(acronym(w), w).otherwise(title_case(w))), " ")
    return F.coalesce(F.nullif(titled, F.lit("")), F.nullif(strip(bare), F.lit("")), F.lit(UNTITLED))


def chapter_filename(index: Column, title: Column) -> Column:
    """``NNN_slug.txt`` with a slug of up to 50 characters, or ``chapter_{index + 1}``."""
    slug = F.regexp_replace(F.lower(title), r"[^a-z0-9 _-]", "")
    slug = F.regexp_replace(F.substring(F.replace(slug, F.lit(" "), F.lit("_")), 1, 50), r"^[_-]+|[_-]+$", "")
    named = F.coalesce(F.nullif(slug, F.lit("")), F.concat(F.lit("chapter_"), (index + 1).cast("string")))
    return F.concat(F.format_string("%03d", index), F.lit("_"), named, F.lit(".txt"))


def chapter_index_of(filename: Column) -> Column:
    """The number after ``_chapter_``, or null."""
    return F.nullif(F.regexp_extract(filename, r"_chapter_(\d+)", 1), F.lit("")).try_cast("int")


def natural_key(filename: Column) -> Column:
    """(first, last) run of digits; (0, n) for one run, (0, 0) for none."""
    runs = F.regexp_extract_all(filename, F.lit(r"(\d+)"), 1)
    n = F.size(runs)
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    return F.struct(
        F.when(n > 1, number(F.get(runs, F.lit(0)))).otherwise(F.lit(0)).cast("long").alias("volume"),
        number(F.get(runs, F.greatest(n - 1, F.lit(0)))).alias("chapter"),
    )


def display_title(title: Column) -> Column:
    """Without a leading number; ``Chapter N`` gets a dash before further text."""
    bare = F.regexp_replace(title, r"^\d+\s+", "")
    return F.regexp_replace(bare, r"^(Chapter\s+\d+)\s+(?!-)(.+)$", "$1 - $2")


def json_filename(name: Column) -> Column:
    """``.json`` in place of ``.xhtml`` or ``.html``, or appended."""
    swapped = F.regexp_replace(name, r"\.x?html$", ".json")
    return F.when(F.endswith(swapped, F.lit(".json")), swapped).otherwise(F.concat(swapped, F.lit(".json")))


def chapter_path(phase: Column, novel_id: Column, filename: Column) -> Column:
    """``data/{phase}[/novel_{id}]/{filename}``."""
    folder = F.when(novel_id.isNull(), F.lit("")).otherwise(F.concat(F.lit("/novel_"), novel_id.cast("string")))
    return F.concat(F.lit("data/"), phase, folder, F.lit("/"), filename)
