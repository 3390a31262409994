"""The code paths that only run at scale, forced on small inputs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from babelgrid.operators.ranking import block_running_max, bucketed_row_number


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_bucketed_row_number_equals_window(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1000).alias("x"), "id")
    got = bucketed_row_number(df, ["g"], [F.floor(F.col("x") / 37).alias("_b")], [F.col("_b")], [F.col("x"), F.col("id")], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("x", "id")))
    assert _rows(got, ["g", "id", "rn"]) == _rows(want, ["g", "id", "rn"])


def test_block_running_max_equals_window(spark):
    df = spark.range(1, 500).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), ((F.col("id") * 37) % 101).cast("double").alias("m"))
    got = block_running_max(df, ["g"], "k", "m", 16, "best")
    want = df.withColumn("best", F.max("m").over(Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)))
    assert _rows(got, ["g", "k", "best"]) == _rows(want, ["g", "k", "best"])
    got2 = block_running_max(df, ["g"], "k", "m", 16, "best", include_current=True)
    want2 = df.withColumn("best", F.max("m").over(Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    assert _rows(got2, ["g", "k", "best"]) == _rows(want2, ["g", "k", "best"])
