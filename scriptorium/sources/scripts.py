"""Script files, manifests, glossaries and correction exports."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.names import basename, natural_key
from scriptorium.sources import glossary_files

BLOCK = "struct<type:string,content:string,text:string,speaker:string,tone:string>"
SCRIPT = f"chapter_title string, source_hash string, blocks array<{BLOCK}>, _corrupt_record string"
MANIFEST = "source_filename string, chapters array<struct<index:int,title:string,filename:string,token_estimate:int,metadata:map<string,array<string>>>>"


def scripts(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, chapter_title, source_hash, blocks, readable) of the JSON files under ``path``.

    A file that cannot be read has ``readable`` false and no blocks, so it still counts as
    scanned; with ``strict`` it ends the job.
    """
    options = {"multiLine": "true", "mode": "FAILFAST" if strict else "PERMISSIVE", "pathGlobFilter": "*.json"}
    found = spark.read.schema(SCRIPT.rsplit(", ", 1)[0] if strict else SCRIPT).options(**options).json(path)
    readable = F.lit(True) if strict else F.col("_corrupt_record").isNull()
    return found.select(F.col("_metadata.file_path").alias("path"), "chapter_title", "source_hash", "blocks", readable.alias("readable"))


def blocks_of(found: DataFrame) -> DataFrame:
    """(chapter, order_key, block_index, type, speaker, content, tone): one row for each block;
    ``order_key`` sorts files by the numbers in their names; ``text`` stands in for ``content``."""
    name = basename(F.col("path"))
    one = found.where("readable").select(name.alias("chapter"), natural_key(name).alias("order_key"), F.posexplode("blocks").alias("block_index", "b"))
    return one.select("chapter", "order_key", "block_index", "b.type", "b.speaker", F.coalesce("b.content", "b.text").alias("content"), "b.tone")


def manifest_entries(spark: SparkSession, path: str) -> DataFrame:
    """(source_filename, index, title, filename, token_estimate, metadata) of a manifest file, which must be there."""
    found = spark.read.schema(MANIFEST).options(multiLine="true", mode="FAILFAST").json(path)
    return found.select("source_filename", F.explode("chapters").alias("c")).select("source_filename", "c.*")


def glossary_entries(spark: SparkSession, path: str) -> DataFrame:
    """(category, ord, name, raw, aliases, desc) of a glossary in YAML or JSON (see ``glossary_files``)."""
    return glossary_files.read(spark, path).drop("path")


def preferred_glossary(spark: SparkSession, own: str, shared: str) -> DataFrame:
    """The entries of the first of a novel's own glossary file and the shared one that is there
    and can be read; none if there is no such file."""
    for path in (own, shared):
        try:
            found = glossary_entries(spark, path)
            found.limit(1).collect()
        except (PySparkException, Py4JJavaError):  # missing or not readable: the next one
            continue
        return found
    return spark.createDataFrame([], glossary_files.ENTRIES)


def write_chapters(chapters: DataFrame, path: str) -> None:
    """Clean chapters as Parquet, in a folder for each novel."""
    chapters.write.mode("overwrite").partitionBy("novel_id").parquet(path)


def write_documents(pages: DataFrame, path: str) -> DataFrame:
    """Finished pages ``(name, document)`` as a table of files in a folder, for a static store to
    serve from; returns what was written. Written as a whole by Spark's commit, so readers see
    the old pages or the new ones."""
    pages.select("name", "document").write.mode("overwrite").parquet(path)
    return pages.sparkSession.read.parquet(path)


def write_glossary(by_category: DataFrame, path: str) -> None:
    """A glossary ``(category, entries as JSON)`` as one JSON line for each category; files that
    read back as glossaries are written by ``glossary_files.write``."""
    rows = by_category.select(F.concat(F.lit('{"category": '), F.to_json(F.array("category")).substr(F.lit(2), F.length(F.to_json(F.array("category"))) - 2), F.lit(', "entries": '), "entries", F.lit("}")).alias("value"))
    rows.write.mode("overwrite").text(path)


def write_report(scores: DataFrame, path: str) -> None:
    """Scores of a glossary test as lines of JSON."""
    scores.write.mode("overwrite").json(path)


def export_corrections(corrections: DataFrame, path: str, kind: str = "jsonl") -> None:
    """Corrections as lines of JSON or as CSV with a header."""
    if kind == "csv":
        corrections.write.mode("overwrite").option("header", "true").csv(path)
    elif kind in ("json", "jsonl"):
        corrections.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown kind of export: {kind}")
