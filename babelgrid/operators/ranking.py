"""Row numbers and running aggregates that do not put a whole group in one task.

``row_number() over (partition by g order by o)`` sends every row of a group
to one task.  When one group may hold a large share of all rows (one
language, one run, one frequent count), ``bucketed_row_number`` splits the
group into ordered buckets: a small table of bucket sizes gives each bucket
its offset, and the final numbering is a window over (group, bucket).  The
bucket expression must be monotone in the order (for example a prefix of the
sort key, or a time bucket of a timestamp).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def bucketed_row_number(df: DataFrame, part: list[str], buckets: list[Column], bucket_order: list[Column],
                        order: list[Column], name: str = "rn") -> DataFrame:
    """Append ``name`` = 1-based row number within ``part`` by ``order``.

    ``buckets``: aliased expressions defining the bucket (monotone in
    ``order``); ``bucket_order``: how buckets sort, in the same direction as
    ``order``.
    """
    d = df.select("*", *buckets)
    bnames = d.columns[len(df.columns):]
    sizes = d.groupBy(*part, *bnames).agg(F.count(F.lit(1)).alias("_bn"))
    before = Window.partitionBy(*part).orderBy(*bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*part, *bnames, F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"))
    # the offset table is an aggregate: AQE sees its real size and broadcasts
    # it when small; a hot (group, bucket) on the fact side is split by the
    # skew-join handling otherwise
    j = d.join(offsets, part + bnames)
    inner = Window.partitionBy(*part, *bnames).orderBy(*order)
    return j.withColumn(name, (F.col("_off") + F.row_number().over(inner)).cast("long")).drop("_off", *bnames)


def first_rows(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank",
               salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, numbered from 1 as ``name``.

    Two limits: within (group, a salt of the input partition) and then within
    the group.  The literal bound is applied before each shuffle, so the last
    task of a group sorts at most ``salts * n`` rows however many tasks read
    the group, repeated keys included.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    near = Window.partitionBy(*group, "_salt").orderBy(*order)
    few = salted.withColumn("_near", F.row_number().over(near)).filter(F.col("_near") <= n).drop("_near", "_salt")
    w = Window.partitionBy(*group).orderBy(*order)
    return few.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def block_running_max(df: DataFrame, part: list[str], idx: str, value: str, block: int, name: str,
                      include_current: bool = False) -> DataFrame:
    """Running ``max(value)`` over earlier rows (by integer ``idx``) of each group.

    Rows are cut into blocks of ``block`` consecutive indices; the max of all
    earlier blocks comes from a small per-block table, the rest from a window
    over (group, block).  No task ever holds more than one block.
    """
    d = df.withColumn("_blk", F.floor(F.col(idx) / F.lit(block)).cast("long"))
    bmax = d.groupBy(*part, "_blk").agg(F.max(value).alias("_bmax"))
    prev_blocks = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = bmax.select(*part, "_blk", F.max("_bmax").over(prev_blocks).alias("_carry"))
    j = d.join(carry, part + ["_blk"])
    end = 0 if include_current else -1
    within = Window.partitionBy(*part, "_blk").orderBy(idx).rowsBetween(Window.unboundedPreceding, end)
    local = F.max(value).over(within)
    return j.withColumn(name, F.greatest(local, F.col("_carry"))).drop("_blk", "_carry")
