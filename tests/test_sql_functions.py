"""SQL names of the library's functions give what their Python forms give, without Python workers."""

from pyspark.sql import functions as F

from scriptorium.functions import sql, style, text


def test_sql_functions_equal_their_python_forms(spark):
    sql.register(spark)
    rows = ["“Hi”  https://a.b/c x\r\nTN: gone\n\n\n\n  read more at z.y \n end ", "", None, "été 漢字 ‘q’", "a\n\n b \n"]
    spark.createDataFrame([(n, t) for n, t in enumerate(rows)], "id int, t string").createOrReplaceTempView("texts_of_test")
    got = spark.sql("SELECT id, clean_text(t) a, token_estimate(t) b, word_count(t) c, paragraph_count(t) d, source_hash(t) e, stable_hash_mod(t, 360) f FROM texts_of_test")
    t = F.col("t")
    want = spark.table("texts_of_test").select("id", text.clean_text(t), text.token_estimate(t).cast("long"), text.word_count(t).cast("long"), text.paragraph_count(t).cast("long"), text.source_hash(t), style.hash_modulo(t, 360).cast("long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    lines = spark.sql("SELECT id, line_no, line FROM texts_of_test, LATERAL text_lines(t) WHERE id = 4")
    assert [tuple(r)[1:] for r in lines.orderBy("line_no").collect()] == [(0, "a"), (1, ""), (2, " b "), (3, "")]
    parts = spark.sql("SELECT paragraph FROM texts_of_test, LATERAL text_paragraphs(t) WHERE id = 4")
    assert [r[0] for r in parts.collect()] == ["a", " b "]
