"""Corrections of blocks: context, application, statistics, renaming, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.scan import placed


def with_context(blocks: DataFrame, key: str = "chapter", order: str = "block_index") -> DataFrame:
    """Adds ``context_json``: the blocks before and after as JSON; blocks of equal ``order`` come
    by their other columns."""
    own = [c for c in blocks.columns if c != key]
    ordered = placed(blocks, [key], [F.col(order), *[F.col(c) for c in own if c != order]])
    near = ordered.with_neighbours(F.struct(*own), "__preceding", "__following")
    context = F.to_json(F.struct(F.col("__preceding").alias("preceding"), F.col("__following").alias("following")))
    return near.with_columns({"context_json": context}).result().drop("__preceding", "__following")


def apply_corrections(blocks: DataFrame, corrections: DataFrame) -> DataFrame:
    """``blocks(chapter, block_index, type, speaker, content, tone)`` after ``corrections(id,
    chapter, block_index, type, speaker, content)``: the last correction of a block holds,
    types become small letters, an empty speaker none; adds ``corrected`` and ``correction_id``."""
    last = corrections.groupBy("chapter", "block_index").agg(F.max_by(F.struct("id", "type", "speaker", "content"), "id").alias("c"))
    both = blocks.join(last, ["chapter", "block_index"], "left")
    hit = F.col("c").isNotNull()
    return both.withColumns(
        {
            "type": F.when(hit, F.lower("c.type")).otherwise(F.col("type")),
            "speaker": F.when(hit, F.nullif(F.col("c.speaker"), F.lit(""))).otherwise(F.col("speaker")),
            "content": F.when(hit, F.col("c.content")).otherwise(F.col("content")),
            "corrected": hit,
            "correction_id": F.col("c.id"),
        }
    ).drop("c")


def transitions(corrections: DataFrame, chapter: str | None = None) -> DataFrame:
    """(transition, count, share): what types were corrected to what, in per cent of all."""
    if chapter is not None:
        corrections = corrections.where(F.col("chapter") == chapter)
    key = F.concat_ws("->", F.upper("original_type"), F.upper("corrected_type"))
    counted = corrections.groupBy(key.alias("transition")).agg(F.count("*").alias("count"))
    return counted.withColumn("share", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()))


def most_common(counts: DataFrame) -> DataFrame:
    """The transition with the highest count, the first by name of equal ones."""
    return counts.orderBy(F.col("count").desc(), "transition").limit(1)


def rename_speaker(blocks: DataFrame, old: str, new: str, any_case: bool = False) -> DataFrame:
    """Blocks with the speaker renamed; adds ``renamed``."""
    hit = F.lower("speaker") == old.lower() if any_case else F.col("speaker") == old
    hit = F.coalesce(hit, F.lit(False))
    return blocks.withColumns({"renamed": hit, "speaker": F.when(hit, F.lit(new)).otherwise(F.col("speaker"))})


def export_lines(corrections: DataFrame) -> DataFrame:
    """(line): each correction as a JSON text."""
    return corrections.select(F.to_json(F.struct("*")).alias("line"))


def text_mentions(content: Column, name: str) -> Column:
    """How often the name stands in a text."""
    quoted = "".join(f"\\{c}" if not c.isalnum() and ord(c) < 128 else c for c in name)
    return F.regexp_count(content, F.lit(quoted))
