"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_PREFIX = "_bg_"


def tmp(name: str) -> str:
    """Name of a helper column that no input column is expected to have."""
    return _PREFIX + name


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return df["`" + name.replace("`", "``") + "`"]


def n_words(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def same(a: Column, b: Column) -> Column:
    """Equality in which null equals null."""
    return a.eqNullSafe(b)


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str, table: str) -> DataFrame:
    """``df`` written as a table in the order of (group, order), with ``name`` =
    0, 1, ... counting the rows of each group.

    A range partition puts neighbours together and splits a hot group; a row's
    number is its place in its partition plus the group's rows in earlier
    ones, a table of one row per group and partition.  Rows equal in all of
    ``order`` get any order among themselves, but share one partition.
    """
    mid, part = tmp("mid"), tmp("part")
    keys = [F.col(g).asc_nulls_first() for g in group]
    d = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    d = materialize(d.withColumn(mid, F.monotonically_increasing_id()), table)
    d = d.withColumn(part, F.shiftright(mid, 33))
    sizes = d.groupBy(*group, part).agg(F.min(mid).alias(tmp("first")), F.count(F.lit(1)).alias(tmp("n")))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*group, part, (F.coalesce(F.sum(tmp("n")).over(before), F.lit(0)) - F.col(tmp("first"))).alias(tmp("shift")))
    out = d.join(sizes, [*group, part])
    return out.select(*df.columns, (F.col(mid) + F.col(tmp("shift"))).alias(name))
