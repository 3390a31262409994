"""Incremental result grid (optional inventory item L1).

Result files (one CSV per transfer language, rewritten as evaluation goes
on) arrive in a folder.  A Structured Streaming query keeps, as keyed state,
the last row per (task, model, task_lang, transfer_lang): the one of the
latest file by modification time, whatever the order in which files are seen, so a late older
file changes nothing.  A micro-batch passes on the rows that changed the state;
they replace their keys in a landed table (``sources/landing.py``), of which
only the buckets they fall into are written anew.  A batch run twice lands the
same content, which is no new version.  Readers see one committed version and
read its files only, never the history.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import materialize
from ..sources import landing

GRID_KEYS = ["task", "model", "task_lang", "transfer_lang"]
#: Parts of the grid table; a micro-batch rewrites those it has rows for.
BUCKETS = 16
#: Versions whose files stay, for readers that began before a commit.
KEEP_VERSIONS = 3
_TIME, _FILE, _BUCKET = "file_time", "source_file", "bucket"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastRow(StatefulProcessor):
    """Keeps the row of the latest file per key; rows of one file and key are ordered by their values."""

    def __init__(self, keys: list[str], fields: list[str], schema: StructType) -> None:
        self.keys, self.fields, self.schema = keys, fields, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema)

    @staticmethod
    def _order(row: tuple) -> tuple:
        return (row[0], row[1], *[(v is not None, str(v)) for v in row[2:]])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - Spark's name
        best = tuple(self.last.get()) if self.last.exists() else None
        changed = False
        for pdf in rows:
            for row in pdf[self.fields].astype(object).where(pdf[self.fields].notna(), None).itertuples(index=False, name=None):
                row = (int(row[0]), *row[1:])
                if best is None or self._order(row) > self._order(best):
                    best, changed = row, True
        if changed:
            self.last.update(best)
            yield pd.DataFrame([(*key, *best)], columns=[*self.keys, *self.fields])

    def close(self) -> None:
        pass


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("string")


def _has_version(spark: SparkSession, table_dir: str) -> bool:
    return bool(landing.versions(spark, table_dir))


def replace_keys(changed: DataFrame, table_dir: str, keys: list[str]) -> int:
    """Land ``changed`` (one row per key) over the table's rows of the same keys; the version."""
    spark = changed.sparkSession
    new = materialize(changed.withColumn(_BUCKET, _bucket(keys)), "grid-changes")
    rows = new
    if _has_version(spark, table_dir):
        old = landing.read_landed(spark, table_dir).drop("version").join(new.select(_BUCKET).distinct(), _BUCKET, "left_semi")
        mine = new.select(*[F.col(k).alias(f"n_{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & old[k].eqNullSafe(mine[f"n_{k}"])
        # written first: the landing reads it twice, and it comes from the table that is replaced
        rows = materialize(old.join(mine, same, "left_anti").unionByName(new), "grid-buckets")
    version = landing.land(rows, table_dir, (_BUCKET,))
    landing.vacuum(spark, table_dir, KEEP_VERSIONS)
    return version


def start_grid_stream(spark: SparkSession, source_dir: str, table_dir: str, schema: StructType,
                      checkpoint: str, available_now: bool = True, path_columns: tuple[str, ...] = ("transfer_lang",),
                      keys: list[str] = GRID_KEYS):
    """Start the file-to-table stream; returns the ``StreamingQuery``.

    ``path_columns`` are read from Hive-style ``name=value`` folders of each
    file (one folder per transfer language).  A restart from the checkpoint
    goes on with the state it has."""
    src = (spark.readStream.schema(schema).option("header", True).option("escape", '"').option("recursiveFileLookup", True)
           .csv(source_dir).withColumn(_FILE, F.col("_metadata.file_path"))
           .withColumn(_TIME, F.unix_micros("_metadata.file_modification_time")))
    for c in path_columns:
        src = src.withColumn(c, F.regexp_extract(_FILE, c + "=([^/]+)/", 1))
    metrics = [f for f in src.schema.fields if f.name not in (*keys, _TIME, _FILE)]
    state = StructType([StructField(_TIME, LongType()), StructField(_FILE, StringType()), *metrics])
    out = StructType([*[src.schema[k] for k in keys], *state.fields])
    rows = src.select(*keys, *state.names).groupBy(*keys).transformWithStateInPandas(
        LastRow(keys, state.names, state), outputStructType=out, outputMode="Update", timeMode="None")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        replace_keys(batch, table_dir, keys)

    w = rows.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # keyed state of this kind needs it; the query takes a copy of the settings
    try:
        return w.start()
    finally:
        spark.conf.set(_PROVIDER, before)


def current_grid(spark: SparkSession, table_dir: str, version: int | None = None) -> DataFrame:
    """The grid as of the last committed version (or an earlier one that is kept): keys and metrics."""
    return landing.read_landed(spark, table_dir, version).drop(_BUCKET, _TIME, _FILE, "version")


def run_once(spark: SparkSession, source_dir: str, work_dir: str, schema: StructType) -> DataFrame:
    """Process everything available now and return the current grid."""
    table = os.path.join(work_dir, "table")
    q = start_grid_stream(spark, source_dir, table, schema, os.path.join(work_dir, "checkpoint"))
    q.awaitTermination()
    return current_grid(spark, table)
