"""Durations, status words, links, schedules, error kinds and record checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of other sites and of services, and what they mean here.
SERIES_STATUS = {"ongoing": "active", "completed": "completed", "hiatus": "dropped", "discontinued": "dropped"}
BLOCK_TYPES = ["narrator", "dialogue", "thought", "monologue", "action", "sfx", "system_notification"]
SPEAKING = ["dialogue", "thought", "monologue"]
BACKOFF_CAPS = {"default": 10, "compatible": 30}


def duration(seconds: Column) -> Column:
    """``12.3s``, ``3m 5s`` or ``2h 2m``."""
    whole = F.floor(seconds).cast("long")
    return (
        F.when(seconds < 60, F.concat(F.format_number(seconds, 1), F.lit("s")))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60)))
    )


def log_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def series_status(word: Column) -> Column:
    """What another site's status means; ``active`` for unknown words."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SERIES_STATUS.items() for x in kv]), F.lower(F.trim(word))), F.lit("active"))


def parse_tags(text: Column) -> Column:
    """A JSON array of texts; anything else is no tags."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def clean_tags(tags: Column, most: int | None = None) -> Column:
    """Stripped, without blanks; the first of tags that differ in case alone; at most ``most`` before that."""
    bare = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")
    if most is not None:
        bare = F.slice(bare, 1, most)
    none = F.array().cast("array<string>")
    known = lambda acc, t: F.exists(acc, lambda x: F.lower(x) == F.lower(t))
    return F.aggregate(bare, none, lambda acc, t: F.when(known(acc, t), acc).otherwise(F.array_append(acc, t)))


def absolute_url(url: Column, base: str) -> Column:
    return F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit(base), url))


def series_id(url: Column) -> Column:
    """The identifier in a link to a series page of the two known sites, or null."""
    # The two patterns.
    by_name = F.regexp_extract(url, r"novelupdates\.com/series/([^/]+)/", 1)
    by_number = F.regexp_extract(url, r"royalroad\.com/fiction/(\d+)", 1)
    return F.nullif(F.concat(by_name, F.when(by_name == "", by_number).otherwise("")), F.lit(""))


# Where a series page of the known site has its fields.
SERIES_FIELDS = {
    "title": r'<h1[^>]*class="series-title"[^>]*>([^<]+)</h1>',
    "author": r'<span[^>]*class="author"[^>]*><a[^>]*>([^<]+)</a></span>',
    "cover_url": r'<img[^>]*id="series_image"[^>]*src="([^"]+)"',
    "synopsis": r'<div[^>]*id="editdescription"[^>]*>([^<]+)',
}
SERIES_TAG = r'<a[^>]*class="genre"[^>]*>([^<]+)</a>'
SERIES_STATE = r'<span[^>]*class="status"[^>]*>([^<]+)</span>'
# Status words of the site that answers in JSON, and the shape of its answers.
PAYLOAD_STATUS = {"ONGOING": "active", "COMPLETED": "completed", "HIATUS": "dropped", "ABANDONED": "dropped", "UNKNOWN": "active"}
PAYLOAD = "struct<data:array<struct<title:string,author:struct<name:string>,coverUrl:string,description:string,genres:array<struct<name:string>>,status:string>>>"


def series_page(html: Column) -> Column:
    """(title, author, cover_url, synopsis, tags, status) of a series page; null without a
    title. Missing fields are null, ten tags at most are kept, an unknown status is active."""
    one = {k: F.nullif(F.regexp_replace(F.regexp_extract(html, p, 1), r"(?U)^\s+|\s+$", ""), F.lit("")) for k, p in SERIES_FIELDS.items()}
    tags = F.slice(F.filter(F.transform(F.regexp_extract_all(html, F.lit(SERIES_TAG)), lambda t: F.trim(t)), lambda t: t != ""), 1, 10)
    fields = [v.alias(k) for k, v in one.items()]
    return F.when(one["title"].isNotNull(), F.struct(*fields, tags.alias("tags"), series_status(F.regexp_extract(html, SERIES_STATE, 1)).alias("status")))


def series_record(payload: Column, base: str) -> Column:
    """The first record of a search answer in JSON, with the fields of ``series_page``; null if
    there is none or the answer is not readable."""
    first = F.get(F.from_json(payload, PAYLOAD)["data"], 0)
    status = F.element_at(F.create_map(*[F.lit(x) for kv in PAYLOAD_STATUS.items() for x in kv]), first["status"])
    tags = F.slice(F.filter(F.transform(first["genres"], lambda g: F.trim(g["name"])), lambda t: t != ""), 1, 10)
    return F.when(
        first.isNotNull(),
        F.struct(
            F.coalesce(first["title"], F.lit("")).alias("title"), first["author"]["name"].alias("author"), absolute_url(first["coverUrl"], base).alias("cover_url"),
            first["description"].alias("synopsis"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"), F.coalesce(status, F.lit("active")).alias("status"),
        ),
    )


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def backoff_seconds(attempt: Column, cap: int) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(float(cap)))


# What a provider's error message holds, by kind; the first kind that fits counts.
ERROR_WORDS = {
    "json_mode": ["response_format"],
    "auth": ["401", "invalid_api_key", "unauthorized"],
    "rate_limit": ["429", "rate limit", "rate_limit", "quota"],
}


def error_kind(message: Column) -> Column:
    """``json_mode``, ``auth``, ``rate_limit`` or ``other``; a null message is ``other``."""
    low = F.lower(message)
    kinds = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), kind) for kind, words in ERROR_WORDS.items()]
    return F.coalesce(*kinds, F.lit("other"))


def lock_fields(content: Column) -> Column:
    """(pid, since) of a lock's ``pid|timestamp``; nulls where it is broken."""
    parts = F.split(F.trim(content), r"\|")
    ok = F.size(parts) == 2
    return F.struct(F.when(ok, F.get(parts, F.lit(0)).try_cast("long")).alias("pid"), F.when(ok, F.try_to_timestamp(F.get(parts, F.lit(1)))).alias("since"))


def broken_rules(**rules: Column) -> Column:
    """Names of the rules that do not hold (null counts as not)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))


def reading_percent(read: Column, total: Column) -> Column:
    """Share in per cent, halves rounded up; 0 without a total."""
    share = F.floor(100 * read / F.nullif(total, F.lit(0)) + 0.5)
    return F.coalesce(share, F.lit(0)).cast("long")
