"""The trigram index against ``contains``, and what a query reads of it."""

import random

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from scriptorium.operators import search


def test_search_equals_contains(spark, tmp_path):
    rng = random.Random(8)
    rows = [(n, "".join(rng.choices("aAbB éÉ漢😀.", k=rng.randrange(12)))) for n in range(400)] + [(500, None), (501, ""), (502, "ab"), (3, "same key")]
    df = spark.createDataFrame(rows, "id long, title string")
    search.write_index(df, "id", "title", f"{tmp_path}/index")
    queries = ["a", "É", "ab", " .", "aab", "b é", "漢", "zzz", "abab", "aaa", ""] + [t[i : i + rng.randrange(1, 6)] for _, t in rng.sample(rows[:400], 12) for i in (0, 3)]
    for q in queries:
        want = sorted(r["id"] for r in df.where(F.contains(F.lower("title"), F.lit(q.lower()))).collect())
        assert sorted(r["id"] for r in search.search(df, "id", "title", f"{tmp_path}/index", q).collect()) == want, q


def test_a_query_reads_its_own_postings(spark, tmp_path):
    df = spark.createDataFrame([(n, f"{chr(97 + n % 26)}{n} title") for n in range(200)], "id long, title string")
    search.write_index(df, "id", "title", f"{tmp_path}/index")
    found = search.postings_of(spark, f"{tmp_path}/index", "q16")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "gram" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert {r["gram"] for r in found.collect()} == {"q16"}


def test_texts_are_dealt_before_they_become_postings(spark, tmp_path, monkeypatch):
    """One file with all texts is one task: it must not hold all their postings."""
    written = []
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, **_: written.append(self._df))
    rows = spark.range(3000).select("id", F.concat(F.lit("Title #0000"), "id").alias("title")).coalesce(1)
    search.write_index(rows, "id", "title", f"{tmp_path}/index")
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan.split("Generate", 1)[1] and "Aggregate" not in plan
