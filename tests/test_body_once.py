"""The lines of a body are worked out once."""

from pyspark.sql import functions as F

from quire.functions import text as tx


def test_normalised_lines_are_named_once(spark):
    texts = [" a bc \r\n\nd\nhttp://x yy  ", "z", None, "", "one line", "x yy\u0085zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = df.select("i", tx.normalize_body(F.col("x")).alias("y"))
    assert [r["y"] for r in got.orderBy("i").collect()] == ["a bc\n yy\n", "", "", "", "one line\n", "yy\nzz\n"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
