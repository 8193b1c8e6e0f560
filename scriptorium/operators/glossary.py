"""Glossary entries ``(category, ord, name, raw, aliases, ...)``: lookup, merge, budgeted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories in order of priority with their headings, and the frame of a section.
PRIORITY = {"characters": "Characters", "factions": "Factions", "locations": "Locations", "terms": "Terms"}
HEADER = "## NARRATIVE CONTEXT & GLOSSARY\n\n**CRITICAL**: You MUST adhere to the following naming conventions and details for consistency across the adaptation.\n"
FOOTER = "**REMINDER**: Use these exact names and terms consistently with the glossary above.\n"


def lookup_keys(entries: DataFrame) -> DataFrame:
    """(key, name) for each name and alias in small letters; the last entry of a key wins."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = entries.select("ord", "name", F.explode(names).alias("key")).select(F.lower("key").alias("key"), "ord", "name")
    return keys.groupBy("key").agg(F.max_by("name", F.struct("ord", "name")).alias("name"))


def resolve(mentions: DataFrame, entries: DataFrame, column: str = "speaker") -> DataFrame:
    """Adds ``entry``: the glossary name that a mention's name or alias, in any case, stands for.
    Spark broadcasts the glossary if its size allows."""
    keys = lookup_keys(entries).select("key", F.col("name").alias("entry"))
    return mentions.join(keys, F.lower(column) == F.col("key"), "left").drop("key")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the entries of ``new``: of an entry that both have only ``raw`` is renewed;
    others are added. Of repeated new entries the first is added with the last ``raw``."""
    keys = ["category", "name"]
    last = Window.partitionBy(*keys)
    nth = F.row_number().over(last.orderBy("ord"))
    latest = F.max_by("raw", "ord").over(last)
    fresh = new.withColumns({"__n": nth, "__raw": latest}).where("__n = 1").select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("__new"), "__raw", F.lit(True).alias("__in"))
    both = old.withColumn("__old", F.lit(True)).join(fresh, keys, "full")

    def pick(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c == "raw":
            return F.coalesce("__raw", "raw").alias(c)
        return F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__new.{c}")).alias(c)

    return both.select(*[pick(c) for c in old.columns])


def totals(entries: DataFrame) -> DataFrame:
    """(category, entries, is_total): a row for each category, null among them, and one for all."""
    return entries.rollup("category").agg(F.count("*").alias("entries"), (F.grouping_id() == 1).alias("is_total"))


def of_category(entries: DataFrame, category: str | None = None) -> DataFrame:
    """Entries of one category, or all, in the glossary's order."""
    found = entries if category is None else entries.where(F.col("category") == category)
    return found.orderBy("category", "ord", "name")


def without_names(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """Entries but for all that have a name of ``gone(category, name)``."""
    return entries.join(gone.select("category", "name").distinct(), ["category", "name"], "left_anti").select(*entries.columns)


def with_first_changed(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries after ``changes(category, name, raw)``: of the entries that have the name, the
    first by ``ord`` takes the new ``raw``. Of repeated changes the greatest ``raw`` holds."""
    new = changes.groupBy("category", "name").agg(F.max("raw").alias("__raw"))
    first = entries.groupBy("category", "name").agg(F.min("ord").alias("__first"))
    joined = entries.join(new.join(first, ["category", "name"]), ["category", "name"], "left")
    raw = F.when(F.col("ord") == F.col("__first"), F.coalesce("__raw", "raw")).otherwise(F.col("raw"))
    return joined.withColumn("raw", raw).select(*entries.columns)


def as_json(entries: DataFrame) -> DataFrame:
    """(category, entries): each category's entries in order, as one JSON text."""
    fields = [c for c in entries.columns if c not in ("category", "ord")]
    rows = entries.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("rows"))
    return rows.select("category", F.to_json(F.transform("rows", lambda r: F.struct(*[r[f].alias(f) for f in fields]))).alias("entries"))


def format_entry(name: Column, raw: Column, aliases: Column, desc: Column) -> Column:
    """The lines of one entry, each with a newline."""
    head = F.concat(F.lit("- **"), name, F.lit("** ("), raw, F.lit(")\n"))
    also = F.when(F.size(F.coalesce(aliases, F.array().cast("array<string>"))) > 0, F.concat(F.lit("  Aliases: "), F.array_join(aliases, ", "), F.lit("\n")))
    about = F.when(F.coalesce(desc, F.lit("")) != "", F.concat(F.lit("  Context: "), desc, F.lit("\n")))
    return F.concat(head, F.coalesce(also, F.lit("")), F.coalesce(about, F.lit("")))


def notice(shown: Column, total: Column) -> Column:
    return F.concat(F.lit("\n_Truncated: "), shown.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" entries shown._\n"))


def within_budget(entries: DataFrame, max_tokens: Column | int, group: list[str]) -> DataFrame:
    """Entries ``(group..., rank, ord, heading, block)`` in order of (rank, ord) for as long as
    the section with its notice stays within the budget of a quarter token a character; the
    first that does not fit ends it. A heading is counted with the first entry of its rank."""
    order = Window.partitionBy(*group).orderBy("rank", "ord")
    first = F.row_number().over(Window.partitionBy(*group, "rank").orderBy("ord")) == 1
    own = F.when(first, F.concat(F.lit("\n### "), F.col("heading"), F.lit("\n"), F.col("block"))).otherwise(F.col("block"))
    sized = entries.withColumn("piece", own).withColumns(
        {"upto": F.sum(F.length("piece")).over(order), "nth": F.row_number().over(order), "total": F.count("*").over(Window.partitionBy(*group))}
    )
    size = len(HEADER) + F.col("upto") + F.length(notice(F.col("nth") - 1, F.col("total"))) + 1 + len(FOOTER)
    fits = F.floor(size / 4) <= max_tokens
    return sized.withColumn("fits", F.min(fits).over(order)).where("fits").drop("fits")


def section(fitting: DataFrame, group: list[str]) -> DataFrame:
    """(group..., section): the text of entries that ``within_budget`` let pass."""
    rows = fitting.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("nth", "piece"))).alias("rows"), F.max("total").alias("total"))
    body = F.array_join(F.transform("rows", lambda r: r["piece"]), "")
    shown = F.size("rows")
    tail = F.when(shown < F.col("total"), notice(shown, F.col("total"))).otherwise("")
    return rows.select(*group, F.concat(F.lit(HEADER), body, tail, F.lit("\n" + FOOTER)).alias("section"))


def differences(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., issues, blocks, score) of two transforms: positions that both have differ in
    speaker (an empty one is none), in content, or in both; the score divides by the blocks
    of ``second``, the transform that is judged, also where ``first`` is shorter."""
    side = lambda df, n: df.select(*keys, "block_index", F.nullif("speaker", F.lit("")).alias(f"speaker_{n}"), F.col("content").alias(f"content_{n}"), F.lit(1).alias(f"has_{n}"))
    off = lambda c: (~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))).cast("long")
    paired = F.col("has_a").isNotNull() & F.col("has_b").isNotNull()
    both = side(first, "a").join(side(second, "b"), [*keys, "block_index"], "full").groupBy(*keys).agg(
        F.sum(F.when(paired, off("speaker") + off("content")).otherwise(0)).alias("issues"), F.count("has_b").alias("blocks")
    )
    return both.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("issues") / F.greatest("blocks", F.lit(1))))


def mean_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"), F.count_if(F.col("score") < 0.7).alias("low_scores"))


def effectiveness(plain: DataFrame, helped: DataFrame, again: DataFrame, keys: list[str], least: float = 0.7) -> DataFrame:
    """(keys..., score_plain, score_helped, gain, low): how alike two transforms of a chapter
    are without (``plain`` against ``again``) and with a glossary (``helped`` against
    ``again``), by ``differences``; ``low`` where the helped score is below ``least``."""
    one = lambda a, name: differences(a, again, keys).select(*keys, F.col("score").alias(name))
    both = one(plain, "score_plain").join(one(helped, "score_helped"), keys, "full")
    return both.withColumns({"gain": F.col("score_helped") - F.col("score_plain"), "low": F.coalesce(F.col("score_helped") < least, F.lit(False))})


def seeded_sample(rows: DataFrame, name: str, k: int, seed: int) -> DataFrame:
    """``k`` rows that seed and name decide, or all."""
    return rows.orderBy(F.xxhash64(F.lit(seed), name), name).limit(k)
