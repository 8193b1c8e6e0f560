"""Streams over landed files and reading events.

Each job runs over what has arrived and then ends (``availableNow``), keeps its place in
its checkpoint folder, and may be started again at any time. Results are written to shared
folders and read back as tables.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import source_hash
from scriptorium.streaming import latest

READS = "novel_id bigint, chapter_id bigint, ts timestamp"
_KEYS, _ORDER = ["novel_id", "chapter_id"], ["ts"]


def reading_progress(events: DataFrame, target: str, checkpoint: str, ttl: timedelta | None = None) -> DataFrame:
    """(novel_id, chapters_read, current_chapter) of a stream ``events(novel_id, chapter_id, ts)``.

    State: the last reading of each pair of novel and chapter; a batch writes the pairs that it
    changes and no others. Without any events so far the result is empty.
    """
    spark, reads = events.sparkSession, events.select("novel_id", "chapter_id", "ts")
    latest.run_latest(reads, _KEYS, _ORDER, target, checkpoint, ttl)
    seen = latest.read_latest(spark, target, reads.schema, _KEYS, _ORDER)
    return seen.groupBy("novel_id").agg(
        F.count("chapter_id").alias("chapters_read"), F.max_by("chapter_id", F.struct("ts", "chapter_id")).alias("current_chapter")
    )


def ingest_new(spark: SparkSession, landing: str, target: str, checkpoint: str, pattern: str = "*.txt", files_at_once: int = 1000) -> DataFrame:
    """Texts landed under ``landing`` that ``target`` does not hold yet, by name and hash of
    the content; appends (filename, source_hash, text, part) and returns the table.

    A batch takes ``files_at_once`` files at most. ``target`` is laid out by the first two
    digits of the hash, so a batch is compared with the parts that it falls into alone.
    """
    raw = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_at_once)
        .load(landing)
    )
    text = F.col("content").cast("string")
    rows = raw.select(F.substring_index("path", "/", -1).alias("filename"), source_hash(text).alias("source_hash"), text.alias("text"))

    def append(batch: DataFrame, epoch: int) -> None:
        new = batch.dropDuplicates(["filename", "source_hash"]).withColumn("part", F.substring("source_hash", 1, 2))
        known = latest.maybe_read(spark, target, "filename string, source_hash string, part string")
        if known is not None:
            parts = [r["part"] for r in new.select("part").distinct().collect()]  # 256 at most
            new = new.join(known.where(F.col("part").isin(parts)).select("filename", "source_hash"), ["filename", "source_hash"], "left_anti")
        new.write.mode("append").partitionBy("part").parquet(target)

    rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("filename string, source_hash string, text string, part string").parquet(target)
