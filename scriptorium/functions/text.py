"""Text cleaning and measuring as column expressions.

Patterns keep UNIX line ends: ``(?d)`` lets ``.`` and ``$`` stop at a newline only.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that decide results.
URL = r"(?i)(?:https?://|www\.)\S*"
NOTE = r"(?dim)(?:translator'?s?\s*note|tn)\s*:.*$"
WATERMARK = r"(?dim)read\s+(?:more\s+)?(?:at|on)\b.*$"
CURLY, STRAIGHT = "“”‘’", "\"\"''"
SAFETY_TOKENS = 50_000


def strip(x: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def remove_urls(x: Column) -> Column:
    return F.regexp_replace(x, URL, "")


def remove_notes(x: Column) -> Column:
    """Without translator notes, to the end of their lines."""
    return F.regexp_replace(x, NOTE, "")


def remove_watermarks(x: Column) -> Column:
    """Without "read (more) at/on ...", to the end of the line."""
    return F.regexp_replace(x, WATERMARK, "")


def normalise_space(x: Column) -> Column:
    """CRLF and CR as newline, runs of spaces and tabs as one space, at most one empty line."""
    x = F.regexp_replace(x, r"\r\n|\r", "\n")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return F.regexp_replace(x, r"\n{3,}", "\n\n")


def normalise_quotes(x: Column) -> Column:
    return F.translate(x, CURLY, STRAIGHT)


def clean_text(x: Column) -> Column:
    """Quotes, links, notes, watermarks, space; then every line stripped, without blank lines at
    the ends. Null becomes empty."""
    x = normalise_space(remove_watermarks(remove_notes(remove_urls(normalise_quotes(F.coalesce(x, F.lit("")))))))
    return F.regexp_replace(F.regexp_replace(x, r"(?dmU)^[^\S\n]+|[^\S\n]+$", ""), r"^\n+|\n+$", "")


def sanitise_chapter(x: Column) -> Column:
    """Light cleaning: CRLF, runs of spaces, empty lines, ends; links and notes stay."""
    x = F.regexp_replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), r"[ \t]+", " ")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def content_tags(x: Column) -> Column:
    """``litrpg`` and ``stat_sheet`` where the text has their words."""
    low = F.lower(x)
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return F.array_compact(
        F.array(F.when(has("status window", "level up", "[system]"), "litrpg"), F.when(has("status window", "status:"), "stat_sheet"))
    )


def token_estimate(x: Column) -> Column:
    """A quarter of the code points, rounded down."""
    return F.floor(F.length(x) / 4)


def beyond_safety_limit(x: Column) -> Column:
    return token_estimate(x) > SAFETY_TOKENS


def word_count(x: Column) -> Column:
    """Words between white space (Unicode)."""
    return F.regexp_count(x, F.lit(r"(?U)\S+"))


def strip_code_fence(x: Column) -> Column:
    """A model's answer without a thinking part and without a fence around it. The whole line of
    an opening fence goes, whatever language it names; without a second line, only its marks."""
    x = strip(F.regexp_replace(x, r"(?is)<think>.*?</think>", ""))
    x = F.regexp_replace(x, r"^```(?:[^\n]*\n)?", "")
    return strip(F.regexp_replace(x, r"```\z", ""))


def paragraphs(x: Column) -> Column:
    """Non-blank lines."""
    return F.filter(F.split(x, "\n"), lambda p: strip(p) != "")


def paragraph_count(x: Column) -> Column:
    """The number of non-blank lines."""
    return F.regexp_count(x, F.lit(r"(?U)\S[^\n]*"))


def source_hash(x: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(x.cast("binary"), 256)


def fits_search(title: Column, number: Column, query: str) -> Column:
    """A chapter whose title (any case) or number holds the query."""
    by_title = F.contains(F.lower(title), F.lit(query.lower()))
    return F.coalesce(by_title, F.lit(False)) | F.contains(number.cast("string"), F.lit(query))


def fits_any(query: str, *texts: Column) -> Column:
    """True if one of the texts, in any case, holds the query; null texts do not."""
    hits = [F.coalesce(F.contains(F.lower(t), F.lit(query.lower())), F.lit(False)) for t in texts]
    out = hits[0]
    for h in hits[1:]:
        out |= h
    return out


def highlight(x: Column, keywords: list[str], style: str = "keyword") -> Column:
    """Whole keywords, in any case, wrapped in a span; the longest fits first."""
    if not keywords:
        return x
    quoted = [_quoted(k) for k in sorted(keywords, key=lambda k: (-len(k), k))]
    return F.regexp_replace(x, rf"(?i)\b({'|'.join(quoted)})\b", f'<span class="{style}">$1</span>')


def _quoted(word: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and ord(c) < 128 else c for c in word)


def resolve_references(x: Column) -> Column:
    """Character references (``&eacute;``, ``&#233;``, ``&#xe9;``) as characters; names are those of
    HTML 4, unknown ones and numbers beyond Unicode stay as they are."""
    names = F.create_map(*[F.lit(v) for name, point in sorted(name2codepoint.items()) for v in (name, chr(point))], F.lit("apos"), F.lit("'"))
    of_point = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    sound = lambda n: F.when((n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF), n)

    def part(p: Column) -> Column:
        name = F.regexp_extract(p, r"^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        point = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 9))
        char = F.coalesce(of_point(sound(point.try_cast("long"))), F.try_element_at(names, name))
        return F.coalesce(F.concat(char, F.substr(p, F.length(name) + 2)), F.concat(F.lit("&"), p))

    parts = F.split(x, "&")
    resolved = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), part), ""))
    return F.when(F.contains(x, F.lit("&")), resolved).otherwise(x)


def html_to_text(html: Column) -> Column:
    """Visible text of markup, one line a text between tags: without script, style, comments and
    tags (a ``>`` in quotes ends none, and a ``<`` before a blank is text), with character
    references resolved, runs of blanks as one and empty lines dropped."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    x = F.regexp_replace(x, r"""<[a-zA-Z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", "\n")
    x = resolve_references(F.regexp_replace(x, r"<[a-zA-Z/!?][^>]*>", "\n"))
    lines = F.filter(F.transform(F.split(x, "\n"), lambda p: strip(F.regexp_replace(p, r"[ \t]+", " "))), lambda p: p != "")
    return F.array_join(lines, "\n")
