"""The stand-in for a model digests a text once."""

from pyspark.sql import functions as F

from trovesift.operators import embedding as E


def test_a_text_is_digested_once(spark):
    rows = spark.createDataFrame([("a text",), ("",), ("another",)], "text string").select(E.deterministic(F.col("text"), 16, 7).alias("e"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert all(abs(sum(x * x for x in r.e) - 1) < 1e-9 for r in rows.collect())
