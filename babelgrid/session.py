"""Session construction and lineage cutting.

Everything in the library takes a ``SparkSession`` from the caller; this module
only offers a default builder (used by tests, ``bench.py`` and the examples) and
the helpers that write intermediate tables into the cluster's shared
checkpoint folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that every plan in the library relies on.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "babelgrid", extra: dict | None = None) -> SparkSession:
    """Default session for local runs; on a cluster pass your own session."""
    master = master or os.environ.get("BABELGRID_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app_name)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.driver.memory", os.environ.get("BABELGRID_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Unset is an error on a cluster: a folder of the driver's machine would not
    be seen by the executors.  Only a ``local`` master, where driver and
    executors are one process, gets a private folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: only the session conf is visible
        sc = None
    if sc is not None:
        d = d or sc.getCheckpointDir()
    if not d:
        if sc is None or not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="babelgrid-ckpt-")
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; all of an application's scratch
    paths lie in one folder, which ``drop_scratch`` deletes."""
    return "/".join([_scratch_root(spark), f"{name}-{uuid.uuid4().hex}"])


def _scratch_root(spark: SparkSession) -> str:
    app = spark.conf.get("spark.app.id", None) or "app"
    return "/".join([checkpoint_dir(spark).rstrip("/"), "babelgrid", app])


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application (call when its results are consumed)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    Cuts lineage with one computation (``checkpoint()`` recomputes unless the
    data is cached), survives executor loss, and gives the optimizer exact
    size statistics for the next join.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
