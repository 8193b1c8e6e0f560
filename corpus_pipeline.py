"""A training corpus from ``documents``: five filtering and encoding stages.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what the stage before it kept,
written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontamination, near_dup, piece_dropout, quality, toxicity
from scriptorium.llm.arrow import fresh_name
from scriptorium.session import ensure_checkpoint_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the operator's threshold.

    Null and empty texts are scored like others; repeated rows stay together; an empty table
    stays empty, and without labels nothing is toxic; other columns of any name are kept.
    """
    labels, score = table(spark, sf_dir, "labels").select("doc_id", "toxic"), fresh_name(docs, "score")
    scored = toxicity.with_score(docs, toxicity.train(docs, labels), score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches the operator's threshold.

    Null and empty texts are scored like others; repeated rows stay together; an empty table
    stays empty; without trusted rows nothing is known to be good and nothing stays; other
    columns of any name are kept.
    """
    labels, score = table(spark, sf_dir, "labels").select("doc_id", "quality"), fresh_name(docs, "score")
    scored = quality.with_score(docs, quality.train(docs, labels, docs), score)
    return scored.where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (five-word shingles, similarity 0.8): the one with the smallest id.

    Null, empty and blank texts are in no group and all stay; of repeated rows one stays; a
    row without id stays only where nothing else is in its group; other columns are kept.
    """
    return near_dup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; repeated rows are judged alike; without items everything
    stays; other columns of any name are kept.
    """
    held = fresh_name(docs, "held")
    return decontamination.with_flag(docs, table(spark, sf_dir, "benchmark"), held).where(~F.col(held)).drop(held)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, tokens, text_bytes, text_crc32, decoded_bytes, decoded_crc32) of each
    document under merge-dropout; text and decoded agree as the pieces lose nothing.

    Null and empty texts have no pieces; repeated rows are encoded alike.
    """
    return piece_dropout.encode_and_check(docs.select(F.col("doc_id").cast("long"), "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written in a new folder of the
    shared checkpoint folder and read again, so runs do not meet."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpus-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{base}/stage-{n}")
            docs = spark.read.parquet(f"{base}/stage-{n}")
    return docs
