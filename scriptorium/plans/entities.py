"""The library's entities as views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.session import table


def novels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("updated_at")
    )


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("novel_id"),
        F.row_number().over(order).alias("chapter_index"),
        F.concat(F.lit("ch_"), F.col("o_orderkey").cast("string"), F.lit(".xhtml")).alias("filename"),
        F.when(F.col("o_orderstatus") == "F", None).otherwise(F.concat(F.lit("Part "), F.col("o_orderkey").cast("string"))).alias("title"),
    )


#: Block type by return flag.
FLAG_TYPES = {"A": "dialogue", "N": "thought", "R": "narrator"}


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in FLAG_TYPES.items() for x in kv])
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return lines.select(
        F.col("l_orderkey").alias("chapter"),
        F.col("l_linenumber").alias("block_index"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("speaker"),
        F.element_at(kinds, F.col("l_returnflag")).alias("type"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("chapter"), F.col("turn").alias("block_index"), F.col("role").alias("speaker"), F.col("text").alias("content")
    )


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, ord, name, raw, aliases, faction) from suppliers, by nation and region."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("category"),
            F.col("s_suppkey").cast("int").alias("ord"),
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"),
            F.col("s_name").alias("raw"),
            F.array(F.concat(F.lit("Alias "), F.col("s_suppkey").cast("string"))).alias("aliases"),
            F.col("n_name").alias("faction"),
        )
    )


NOVELS = "SELECT c_custkey AS id, c_name AS title, c_mktsegment AS status, c_acctbal AS updated_at FROM customer"
CHAPTERS = """SELECT o_orderkey AS id, o_custkey AS novel_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS chapter_index,
 'ch_' || o_orderkey || '.xhtml' AS filename, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'Part ' || o_orderkey END AS title FROM orders"""
BLOCKS = """SELECT l_orderkey AS chapter, l_linenumber AS block_index, 'S' || l_suppkey AS speaker,
 CASE l_returnflag WHEN 'A' THEN 'dialogue' WHEN 'N' THEN 'thought' WHEN 'R' THEN 'narrator' END AS type FROM lineitem"""
TURNS = "SELECT conv_id AS chapter, turn AS block_index, role AS speaker, text AS content FROM conversations"
GLOSSARY = """SELECT r_name AS category, CAST(s_suppkey AS INT) AS ord, 'S' || s_suppkey AS name, s_name AS raw, ['Alias ' || s_suppkey] AS aliases, n_name AS faction
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
