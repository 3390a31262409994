"""CSV with quoted line breaks, read in parallel by quote parity (A1, A3).

``multiLine`` makes a file one task.  Here files are read as lines, in ranges
as Spark cuts them: a first pass counts the quotes of each range (one row per
range), a running sum over a file's ranges says whether a range begins inside
a quoted field, and a line begins a record where the quotes before it are
even.  Most lines are whole records; only those of records over several lines
are shuffled, to be joined, and a record may begin in one range and end in
another.  Quotes are doubled inside fields (RFC 4180), and a quoted empty
field is an empty text where an unquoted one is null.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import materialize

#: More distinct headers than this in one folder are taken for a mistake.
MAX_HEADERS = 100
#: What Spark's parser gives an unquoted empty field, so that a quoted one stays an empty text.
NULL_MARK = "\x01null"
_LINE = "file string, block long, nth long, odd_before boolean, odd boolean, value string"


def _quotes(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))


def _tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in scan order to lines with their number in the range and the parity of the quotes before them."""
    last, nth, odd = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        file, block, at, value = b.columns
        at = at.to_numpy()
        own = pc.count_substring(value, '"').to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(np.append(at[0] != last, at[1:] != at[:-1]))
        upto = np.cumsum(own)
        number, before = np.arange(len(at)) + nth, upto - own + odd
        for k, lo in enumerate(new):
            hi = new[k + 1] if k + 1 < len(new) else len(at)
            number[lo:hi] = np.arange(hi - lo)
            before[lo:hi] = upto[lo:hi] - own[lo:hi] - (upto[lo - 1] if lo else 0)
        last, nth, odd = at[-1], int(number[-1]) + 1, int(before[-1] + own[-1]) & 1
        yield pa.RecordBatch.from_arrays(
            [file, block, pa.array(number), pa.array(before % 2 == 1), pa.array(own % 2 == 1), value],
            names=["file", "block", "nth", "odd_before", "odd", "value"])


def csv_records(spark: SparkSession, folder: str, glob: str = "*.csv", recursive: bool = True) -> DataFrame:
    """(file, block, nth, value): the records of all files below ``folder`` as text,
    where they begin (byte of the range, line in it), the header as (0, 0).  Blank
    lines between records are left out.  A quote that is never closed makes the
    rest of its file one record, as in any CSV reader."""
    lines = (spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
             .text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"))
    odd = lines.groupBy("file", "block").agg((F.sum(_quotes(F.col("value"))) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = materialize(odd.select("file", "block", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1).alias("inside")), "csv-ranges")

    tagged = lines.select("file", "block", F.xxhash64("file", "block").alias("at"), "value").mapInArrow(_tag, _LINE)
    tagged = tagged.join(inside, ["file", "block"])
    tagged = tagged.select("file", "block", "nth", "odd", "value", (F.col("inside") == F.col("odd_before")).alias("begins"))
    whole = tagged.where(F.col("begins") & ~F.col("odd")).select("file", "block", "nth", "value")

    # the rest: a beginning with a quote left open, lines within the field, the line that closes it
    part = materialize(tagged.where(~F.col("begins") | F.col("odd")).drop("odd"), "csv-parts")
    begin = F.when(F.col("begins"), F.struct("block", "nth"))
    open_at = part.groupBy("file", "block").agg(F.max(begin).alias("latest"))
    open_at = materialize(open_at.select("file", "block", F.last("latest", ignorenulls=True).over(earlier).alias("carried")), "csv-open")
    so_far = Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("own", F.last(begin, ignorenulls=True).over(so_far)).join(open_at, ["file", "block"])
    part = part.select("file", F.coalesce("own", "carried").alias("begin"), F.struct("block", "nth", "value").alias("line"))
    joined = part.groupBy("file", "begin").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    joined = joined.select("file", "begin.block", "begin.nth", F.array_join("lines.value", "\n").alias("value"))
    out = whole.unionByName(joined).withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    return out.where((F.col("value") != "") | ((F.col("block") == 0) & (F.col("nth") == 0)))


def read_quoted_csv(spark: SparkSession, folder: str, schema: StructType | None = None, glob: str = "*.csv",
                    recursive: bool = True) -> DataFrame:
    """CSV files with a header, quoted breaks and doubled quotes, plus ``source_file``.

    Columns are matched by the names in each file's own header, so an unnamed
    leading index column is left out, and a column that a file lacks is null.
    Without a schema all named columns are text.  Values that don't fit their type are null.
    """
    records = csv_records(spark, folder, glob, recursive)
    first = (F.col("block") == 0) & (F.col("nth") == 0)
    headers = materialize(records.where(first).select("file", F.ltrim(F.col("value"), F.lit("﻿")).alias("header")), "csv-headers")
    distinct = [r.header for r in headers.select("header").distinct().limit(MAX_HEADERS + 1).collect()]
    if len(distinct) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers below {folder}")
    names = {h: next(csv.reader([h], strict=True), []) if "\n" not in h else next(csv.reader(h.splitlines(True))) for h in distinct}
    if schema is None:
        found = list(dict.fromkeys(n for ns in names.values() for n in ns if n))
        schema = StructType([StructField(n, StringType()) for n in found])
    body = records.where(~first).select("file", "value")
    if len(distinct) > 1:
        body = body.join(headers, "file")
    else:
        body = body.withColumn("header", F.lit(distinct[0] if distinct else ""))
    out = F.lit(None).cast(schema)
    for h, ns in names.items():
        fields = F.from_csv("value", ", ".join(f"c{k} string" for k in range(len(ns))) or "c0 string",
                            {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1", "nullValue": NULL_MARK})
        cols = [fields[f"c{ns.index(f.name)}"].try_cast(f.dataType).alias(f.name) if f.name in ns
                else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        out = F.when(F.col("header") == h, F.struct(*cols)).otherwise(out)
    return body.select(out.alias("row"), F.col("file").alias("source_file")).select("row.*", "source_file")
