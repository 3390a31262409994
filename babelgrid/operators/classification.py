"""Classification metrics over a grid of cells (inventory G2, H1-H5, H15, I1).

Every metric is derived from one confusion-count aggregate per cell
``(cell..., truth, pred) -> n``.  That aggregate is combined map-side, so the
shuffle carries at most (#cells x #classes^2) rows no matter how many
predictions there are or how skewed the cells are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import masked_pairs
from ..functions.text import strip


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def argmax(c) -> Column:
    """Index of the largest value, first one on ties (numpy ``argmax``)."""
    return (F.array_position(_c(c), F.array_max(_c(c))) - 1).cast("int")


def confusion(preds: DataFrame, cell: list[str], truth: str = "label", pred: str = "pred") -> DataFrame:
    return preds.groupBy(*cell, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(cm: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, cls) -> tp, support (true count), predicted count.

    The class set of a cell is the union of true and predicted values seen in
    that cell, as in the usual F1 definitions.
    """
    as_true = F.struct(F.col("truth").alias("cls"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).alias("tp"),
                       F.col("n").alias("t"), F.lit(0).cast("long").alias("p"))
    as_pred = F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"))
    x = cm.select(*cell, F.inline(F.array(as_true, as_pred)))
    return x.groupBy(*cell, "cls").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))


def f1_of(tp: Column, t: Column, p: Column) -> Column:
    """F1 = 2tp / (true + predicted); 0 when the class never occurs."""
    return F.when(t + p > 0, 2.0 * tp / (t + p)).otherwise(F.lit(0.0))


def classification_grid(preds: DataFrame, cell: list[str], truth: str = "label", pred: str = "pred",
                        digits: int = 6) -> DataFrame:
    """H1 accuracy, H2 macro F1, H3 support-weighted F1 and the row count per cell."""
    pc = per_class(confusion(preds, cell, truth, pred), cell)
    f1 = f1_of(F.col("tp"), F.col("t"), F.col("p"))
    g = pc.groupBy(*cell).agg(
        (F.sum("tp") / F.sum("t")).alias("accuracy"),
        F.avg(f1).alias("f1_score"),
        (F.sum(f1 * F.col("t")) / F.sum("t")).alias("weighted_f1"),
        F.sum("t").cast("long").alias("n"))
    return g.select(*cell, *[F.round(c, digits).alias(c) for c in ("accuracy", "f1_score", "weighted_f1")], "n")


def string_classification_grid(preds: DataFrame, cell: list[str], truth: str, pred: str, digits: int = 6) -> DataFrame:
    """H4: metrics over generated strings, both sides stripped first; every
    distinct generated string is a class of its own."""
    s = preds.select(*cell, strip(truth).alias("_t"), strip(pred).alias("_p"))
    return classification_grid(s, cell, "_t", "_p", digits)


def token_classification_grid(preds: DataFrame, cell: list[str], pred_arr: str, label_arr: str, digits: int = 6) -> DataFrame:
    """H5: masked token accuracy and macro F1, flattened over all rows of a cell."""
    pairs = preds.select(*cell, F.inline_outer(masked_pairs(pred_arr, label_arr))).filter(F.col("l").isNotNull())
    return classification_grid(pairs, cell, "l", "p", digits)


def row_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key, computed by the executors (never a driver ``len``)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
