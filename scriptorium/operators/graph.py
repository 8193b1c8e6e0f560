"""Who speaks how much, and who appears with whom.

Input blocks: ``(chapter, block_index, speaker, type)``, chapters in reading order.
Speakers and pairs are made distinct within a chapter before they meet, and counted with
map-side partial sums; what is kept of the speakers (``max_nodes`` at most) is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.misc import SPEAKING
from scriptorium.session import cut


def first_chapters(blocks: DataFrame, most: int) -> DataFrame:
    """Blocks of the first ``most`` chapters (for readers who have come so far)."""
    known = blocks.select("chapter").distinct().orderBy("chapter").limit(most)
    return blocks.join(known, "chapter", "left_semi")


def named(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("speaker").isNotNull() & (F.col("speaker") != ""))


def speakers(blocks: DataFrame) -> DataFrame:
    """(speaker, lines, first_chapter, first_said): lines and first place of speaking blocks,
    first chapter of any block."""
    speaks = F.col("type").isin(SPEAKING)
    place = F.struct("chapter", "block_index")
    return named(blocks).groupBy("speaker").agg(
        F.count_if(speaks).alias("lines"), F.min("chapter").alias("first_chapter"), F.min(F.when(speaks, place)).alias("first_said")
    )


def speaker_counts(blocks: DataFrame) -> DataFrame:
    """(speaker, blocks) over all kinds of blocks."""
    return named(blocks).groupBy("speaker").agg(F.count("*").alias("blocks"))


def nodes(blocks: DataFrame, min_lines: int = 2, max_nodes: int = 80) -> DataFrame:
    """The ``max_nodes`` speakers with most lines; equal ones in order of their first line."""
    order = (F.col("lines").desc(), F.col("first_said"), F.col("speaker"))
    top = speakers(blocks).where(F.col("lines") >= min_lines).orderBy(*order).limit(max_nodes)
    return top.select("speaker", "lines", "first_chapter", "first_said")


def edges(blocks: DataFrame, kept: DataFrame | None = None, min_weight: int = 1) -> DataFrame:
    """(source, target, weight): in how many chapters two speakers appear; source < target.

    ``kept(speaker)`` limits both ends; it is applied before speakers meet, which gives
    the same edges as after.
    """
    present = named(blocks).select("chapter", "speaker")
    if kept is not None:
        present = present.join(kept.select("speaker"), "speaker", "left_semi")
    present = cut(present.distinct())  # both sides read it; it is not made twice
    a = present.select("chapter", F.col("speaker").alias("source"))
    b = present.select("chapter", F.col("speaker").alias("target"))
    met = a.join(b, "chapter").where("source < target")
    return met.groupBy("source", "target").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_weight)


def by_weight(graph: DataFrame) -> DataFrame:
    """Edges with the heaviest first."""
    return graph.orderBy(F.col("weight").desc(), "source", "target")


def scales(kept: DataFrame, graph: DataFrame) -> DataFrame:
    """One row (max_lines, max_weight) that sizes of nodes and edges are measured by; 1 at least."""
    most = lambda rows, c: rows.agg(F.greatest(F.lit(1), F.coalesce(F.max(c), F.lit(1))).alias(f"max_{c}"))
    return most(kept, "lines").crossJoin(most(graph, "weight"))  # one row each


def unique_speakers(blocks: DataFrame, kinds: tuple[str, ...] = ("dialogue", "thought")) -> DataFrame:
    """(chapter, speakers): who speaks or thinks in each chapter, sorted."""
    return named(blocks).where(F.col("type").isin(*kinds)).groupBy("chapter").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))


def met_with(blocks: DataFrame, name: str) -> DataFrame:
    """(neighbour, weight): in how many chapters others appear with one speaker. Only the
    chapters that have the speaker are looked at, and no pairs are made."""
    present = named(blocks).select("chapter", "speaker").distinct()
    known = present.where(F.col("speaker") == name).select("chapter")
    others = present.where(F.col("speaker") != name).join(known, "chapter", "left_semi")
    return others.groupBy(F.col("speaker").alias("neighbour")).agg(F.count("*").alias("weight"))


def neighbours(graph: DataFrame, name: str) -> DataFrame:
    """(neighbour, weight) at the other ends of a speaker's edges in a finished graph."""
    at = graph.where((F.col("source") == name) | (F.col("target") == name))
    return at.select(F.when(F.col("source") == name, F.col("target")).otherwise(F.col("source")).alias("neighbour"), "weight")
