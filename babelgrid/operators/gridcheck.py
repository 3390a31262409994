"""Consistency checks on result grids.

* Q1: within one (task, model) grid, a transfer language whose metrics are
  all on the 0-1 scale while the grid holds percent values elsewhere.
* Q2: a transfer language that is not one of the task languages of its grid
  (for example ``en`` next to ``english``).

Both are small aggregates and one anti join over the grid rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ISSUE_NOT_A_TASK_LANG = "transfer_lang_not_a_task_lang"
ISSUE_FRACTION_SCALE = "fraction_scale_in_percent_grid"


def grid_issues(grid: DataFrame, metrics: list[str], keys: list[str] = ("task", "model")) -> DataFrame:
    keys = list(keys)
    task_langs = grid.select(*keys, F.col("task_lang").alias("transfer_lang")).distinct()
    unknown = grid.select(*keys, "transfer_lang").distinct() \
        .join(task_langs, keys + ["transfer_lang"], "left_anti") \
        .withColumn("issue", F.lit(ISSUE_NOT_A_TASK_LANG))
    per = grid.groupBy(*keys, "transfer_lang").agg(F.greatest(*[F.max(m) for m in metrics]).alias("mx"))
    overall = per.groupBy(*keys).agg(F.max("mx").alias("omx"))
    wrong = per.join(overall, keys).filter((F.col("mx") <= 1.0) & (F.col("omx") > 1.0)) \
        .select(*keys, "transfer_lang", F.lit(ISSUE_FRACTION_SCALE).alias("issue"))
    return unknown.unionByName(wrong)
