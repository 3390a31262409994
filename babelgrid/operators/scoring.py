"""Model scoring and pluggable metrics (inventory J5, J6).

``score`` runs a batch predictor over a column with ``predict_batch_udf``:
Arrow batches, the model built once per Python worker, rows never pass
through the driver.  ``METRICS`` maps metric names to the statistics they are
made from, so that any number of them is one pass over the predictions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .classification import f1_of


def linear_model(weights: np.ndarray) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A ``make_predict_fn`` for a linear scorer ``x @ W`` (float64)."""
    w = np.asarray(weights, dtype=np.float64)

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            return x.astype(np.float64) @ w
        return predict
    return make


def score(df: DataFrame, input_col: str, make_predict_fn, input_dim: int, output: str = "logits",
          batch_size: int = 1024) -> DataFrame:
    """Batch scoring of a fixed-length float array column."""
    from pyspark.ml.functions import predict_batch_udf
    udf = predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size,
                            input_tensor_shapes=[[input_dim]])
    return df.withColumn(output, udf(F.col(input_col)))


@dataclass(frozen=True)
class Metric:
    """A metric by its sufficient statistics, which add up over rows.

    ``rows``: sums over prediction rows, by name.  ``finish`` makes the value
    of a cell, an aggregate over its classes, from the columns ``tp`` (rows of
    the class predicted right), ``t`` (rows of the class), ``p`` (rows
    predicted as it) and the sums of ``rows``, each counted with the true class.
    """

    finish: Callable[[], Column]
    rows: dict[str, Column] = field(default_factory=dict)


def _f1() -> Column:
    return f1_of(F.col("tp"), F.col("t"), F.col("p"))


# Name -> metric
METRICS: dict[str, Metric] = {
    "accuracy": Metric(lambda: F.sum("tp") / F.sum("t")),
    "f1_macro": Metric(lambda: F.avg(_f1())),
    "f1_weighted": Metric(lambda: F.sum(_f1() * F.col("t")) / F.sum("t")),
}


def register_metric(name: str, metric: Metric) -> None:
    METRICS[name] = metric


def compute_metrics(preds: DataFrame, cell: list[str], names: list[str], truth: str = "label", pred: str = "pred",
                    digits: int = 6) -> DataFrame:
    """All requested metrics in long form: metric, cell..., value.

    The statistics of all metrics are gathered in one aggregate over one scan,
    whatever their number; the finishers read its result.
    """
    wanted = {n: METRICS[n] for n in dict.fromkeys(names)}
    sums: dict[str, Column] = {}
    for n, m in wanted.items():
        for s, c in m.rows.items():
            if str(sums.setdefault(s, c)) != str(c):
                raise ValueError(f"metric {n!r} gives the statistic {s!r} another meaning")
    cm = preds.groupBy(*cell, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("double").alias(s) for s, c in sums.items()])
    zero = F.lit(0).cast("long")
    as_true = F.struct(F.col("truth").alias("cls"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(zero).alias("tp"),
                       F.col("n").alias("t"), zero.alias("p"), *[F.col(s) for s in sums])
    as_pred = F.struct(F.col("pred").alias("cls"), zero.alias("tp"), zero.alias("t"), F.col("n").alias("p"),
                       *[F.lit(0.0).alias(s) for s in sums])
    classes = cm.select(*cell, F.inline(F.array(as_true, as_pred))).groupBy(*cell, "cls").agg(
        *[F.sum(c).alias(c) for c in ("tp", "t", "p", *sums)])
    done = classes.groupBy(*cell).agg(*[F.round(m.finish(), digits).alias(f"m{k}") for k, m in enumerate(wanted.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{k}").alias("value")) for k, n in enumerate(wanted)])
    return done.select(F.inline(pairs), *cell).select("metric", *cell, "value")
