"""Texts are worked out once: summaries cut them once."""

from pyspark.sql import functions as F

from turnmill.operators import summaries


def plan(rows):
    return rows._jdf.queryExecution().analyzed().toString()


def test_a_summary_cuts_its_text_once(spark):
    rows = spark.createDataFrame([(1, "One. Two! Three. " * 300), (2, "short"), (3, None), (4, "")], "id int, x string")
    found = rows.select("id", summaries.extractive(F.col("x"), least_tokens=300).alias("s"))
    assert plan(found).count("split(x") == 1
    got = {r["id"]: r["s"] for r in found.collect()}
    assert got[2] == "short" and got[3] is None and got[4] == ""
    assert got[1].startswith("One. ") and got[1].endswith(".") and len(got[1]) < 300 * 6
