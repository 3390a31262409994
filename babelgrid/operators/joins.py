"""Joins with dimensions (label sets, language sets, per-language models).

``join_dim`` writes the dimension to the shared folder first, so the
optimizer knows its size in bytes: below ``spark.sql.autoBroadcastJoinThreshold``
it is broadcast, above it the join is a shuffle join whose hot keys are split
by adaptive skew handling.  No row count decides, and nothing stays cached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import materialize


def join_dim(fact: DataFrame, dim: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of a fact table with a dimension of measured size."""
    return fact.join(materialize(dim, "dim"), on, how)


def fits_broadcast(table: DataFrame) -> bool:
    """Whether the optimizer's size of a (written) table is within the session's broadcast threshold."""
    spark = table.sparkSession
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most
