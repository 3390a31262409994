"""Sources and sinks (inventory A1-A11, I2).

Per-language corpora land as one partitioned table (``task/lang/split``);
language folders and ``<lang>_<split>.csv`` file names become columns.
Result grids are written per transfer language with dynamic partition
overwrite (a rerun of one language replaces only its partition) and unioned
by column name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path  # noqa: F401 - the sinks' default target
from .quoted_csv import NULL_MARK, read_quoted_csv

# Pattern of the reference's per-file convention ``<lang>_<split>.csv``.
LANG_SPLIT_FILE = r"([^/]+)_([A-Za-z0-9]+)\.csv$"
# The same information in Hive-style folders written by Spark.
LANG_SPLIT_DIRS = r"lang=([^/]+)/split=([^/]+)/"
ROWS_PER_FILE = 5_000_000
# Line breaks inside one-line CSV fields: the escape comes first when writing, last when reading.
BREAKS = (("\\", "\\b"), ("\n", "\\n"), ("\r", "\\r"))


def read_csv_folder(spark: SparkSession, folder: str, schema: StructType | None = None,
                    glob: str = "*.csv", recursive: bool = True, multiline: bool = False,
                    infer: bool = True) -> DataFrame:
    """A1 + A2: CSV files with a header under ``folder`` (glob on the file
    name), with the file path kept as ``source_file`` for provenance.  Pass a
    schema on large inputs: inference reads the data twice.  Quotes are
    doubled inside fields.  ``multiline`` for quoted fields holding line breaks
    (free text): columns are then matched by the header's names, texts without a schema."""
    if multiline:
        return read_quoted_csv(spark, folder, schema, glob, recursive)
    r = spark.read.option("header", True).option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    r = r.option("escape", '"').option("nullValue", NULL_MARK)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", infer)
    df = r.csv(folder)
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def read_lang_split_csv(spark: SparkSession, folder: str, schema: StructType | None = None,
                        pattern: str = LANG_SPLIT_FILE, multiline: bool = True) -> DataFrame:
    """A3: language and split taken from the file path.  Columns are matched
    by the header's names, so an unnamed leading index column is dropped also
    where ``schema`` (types of the named columns) leaves it out."""
    df = read_csv_folder(spark, folder, schema if multiline else None, multiline=multiline, infer=schema is None)
    if schema is not None and not multiline:
        have = set(df.columns)
        df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in have
                         else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], "source_file")
    if "_c0" in df.columns:
        df = df.drop("_c0")
    return (df.withColumn("lang", F.regexp_extract("source_file", pattern, 1))
              .withColumn("split", F.regexp_extract("source_file", pattern, 2)))


def land_partitioned(df: DataFrame, path: str, cols: tuple[str, ...] = ("task", "lang", "split"),
                     rows_per_file: int = ROWS_PER_FILE) -> str:
    """A7 (+A11): write examples as one table partitioned by task/lang/split.

    The rebalance hint lets Spark split a large language over as many writers
    as its bytes need and join the pieces of small ones.
    """
    (df.hint("rebalance", *cols).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
       .partitionBy(*cols).parquet(path))
    return path


def write_quoted_csv(df: DataFrame, path: str, cols: tuple[str, ...]) -> str:
    """A3's sink as other tools write it: quoted fields with doubled quotes and
    line breaks as they are, empty texts quoted and nulls not."""
    (df.hint("rebalance", *cols).write.mode("overwrite").option("header", True).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).partitionBy(*cols).csv(path))
    return path


def write_lang_split_csv(df: DataFrame, path: str, text_cols: tuple[str, ...] = ("text",)) -> str:
    """A3's sink in a form that large files can be split in: one line per row,
    with back-slashes and line breaks in ``text_cols`` escaped."""
    for c in text_cols:
        x = F.col(c)
        for raw, code in BREAKS:
            x = F.replace(x, F.lit(raw), F.lit(code))
        df = df.withColumn(c, x)
    (df.hint("rebalance", "lang", "split").write.mode("overwrite").option("header", True).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .partitionBy("lang", "split").csv(path))
    return path


def read_one_line_csv(spark: SparkSession, folder: str, schema: StructType,
                      text_cols: tuple[str, ...] = ("text",)) -> DataFrame:
    """What ``write_lang_split_csv`` wrote, texts restored."""
    r = spark.read.option("header", True).option("escape", '"').option("nullValue", NULL_MARK)
    r = r.option("recursiveFileLookup", True)
    df = r.schema(schema).csv(folder)
    for c in text_cols:
        x = F.col(c)
        for raw, code in reversed(BREAKS):
            x = F.replace(x, F.lit(code), F.lit(raw))
        df = df.withColumn(c, x)
    df = df.withColumn("source_file", F.col("_metadata.file_path"))
    return (df.withColumn("lang", F.regexp_extract("source_file", LANG_SPLIT_DIRS, 1))
              .withColumn("split", F.regexp_extract("source_file", LANG_SPLIT_DIRS, 2)))


def read_language(spark: SparkSession, path: str, lang: str | None = None, split: str | None = None,
                  task: str | None = None) -> DataFrame:
    """A5 + A6: partition-pruned read of one language / split."""
    df = spark.read.parquet(path)
    for c, v in (("task", task), ("lang", lang), ("split", split)):
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df


def discover_languages(spark: SparkSession, path: str) -> DataFrame:
    """The languages present in a landed table, from a listing of its
    files; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    lang = F.regexp_extract(F.col("path"), "/lang=([^/]+)/", 1)
    return files.load(path).select(F.url_decode(F.replace(lang, F.lit("+"), F.lit("%2B"))).alias("lang")).distinct()


def write_grid(grid: DataFrame, path: str, partition: str = "transfer_lang") -> str:
    """One CSV folder per transfer language; with dynamic partition
    overwrite a rerun replaces only the languages it produced."""
    (grid.repartition(partition).write.mode("overwrite").option("header", True).option("escape", '"')
         .option("partitionOverwriteMode", "dynamic").partitionBy(partition).csv(path))
    return path


def write_single_csv(df: DataFrame, path: str) -> str:
    """A10: one CSV file with a header (grids are small: one writer)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def union_grids(grids: list[DataFrame]) -> DataFrame:
    """Union by column name; a metric column missing in one grid is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), grids)
