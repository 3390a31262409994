"""Exact-n sampling and seeded shuffles (inventory E1-E4).

Rows are ranked per group by ``md5(seed ':' key)`` (a hash both Spark and
SQL engines compute identically), never by ``sample()``, which is inexact.
The per-group rank only has to be exact among the first n rows: a histogram of
the hash gives each group a threshold just above n, and only rows below it are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_dim
from .ranking import bucketed_row_number, first_rows

SEED = "42"   # fixed value: the seed of the reference sampler


def hash_key(key: Column, seed: str = SEED, copy: Column | None = None) -> Column:
    parts = [F.lit(seed), F.lit(":"), key.cast("string")]
    if copy is not None:
        parts += [F.lit(":"), copy.cast("string")]
    return F.md5(F.concat(*parts))


def _bin(h: Column) -> Column:
    """The first 16 bits of a hash, which sort as it does."""
    return F.conv(F.substring(h, 1, 4), 16, 10).cast("int")


def thresholds(df: DataFrame, group: list[str], h: Column, n: int) -> DataFrame:
    """(group..., _size, _upto): a group's rows, and the last bin of the hash that
    its ``n`` smallest rows reach into.  At most 65,536 counts per group are shuffled."""
    bins = df.select(*group, _bin(h).alias("_bin")).groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return bins.groupBy(*group).agg(F.sum("_n").alias("_size"), F.max(F.when(F.col("_before") < n, F.col("_bin"))).alias("_upto"))


def sample_exact_n(df: DataFrame, group: list[str], key: str, n: int, seed: str = SEED) -> DataFrame:
    """E1 + E2 (+E3): exactly ``n`` rows per group.

    size >= n: the n rows with the smallest hash rank.  size < n: every row
    ``n div size`` times plus one more copy for the ``n mod size`` best ranked
    rows.  Adds ``copy`` (1-based) and ``rank``.  No more than n rows and those of
    one bin are ranked per group, repeated keys in two limited steps.
    """
    h = hash_key(F.col(key), seed)
    near = join_dim(df, thresholds(df, group, h, n), group).filter(_bin(h) <= F.col("_upto"))
    top = first_rows(near, group, [h, F.col(key)], n)
    copies = F.when(F.col("_size") >= n, F.lit(1)).otherwise(
        F.floor(F.lit(n) / F.col("_size")).cast("int") + F.when(F.col("rank") <= F.lit(n) % F.col("_size"), 1).otherwise(0))
    out = top.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    return out.drop("_size", "_upto")


#: Rows that one task numbers in a seeded shuffle, on average.
ROWS_PER_BUCKET = 1 << 18


def seeded_shuffle(df: DataFrame, group: list[str], key: str, copy: str = "copy", seed: str = SEED,
                   rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """A seeded permutation within each group, as ``shuffle_key`` (hash)
    and ``shuffle_rank`` (1-based position).

    The rank is computed in ranges of the hash, as many as the group's size
    asks for, so a huge group is spread over many tasks.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    d = join_dim(df.withColumn("shuffle_key", hash_key(F.col(key), seed, F.col(copy))), sizes, group)
    head = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long")
    b = F.shiftright(head * F.ceil(F.col("_size") / F.lit(rows_per_bucket)), 32).alias("_hb")
    return bucketed_row_number(d, group, [b], [F.col("_hb")], [F.col("shuffle_key"), F.col(key), F.col(copy)],
                               "shuffle_rank").drop("_size")


def cap_per_group(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group by ``order``."""
    return first_rows(df, group, [F.col(c) for c in order], n, "_rn").drop("_rn")
