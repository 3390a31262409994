"""Incremental landing with a manifest.

A table is a folder of data and a row of manifests.  A landing digests every
partition of its input, writes only those whose digest isn't in the current
manifest, each landing into a folder of its own, and commits by writing the
next manifest: which landing holds each partition.  Until that is complete,
readers go by the one before, so a killed run changes nothing, and its
leftovers are never read.  Two landings at once can't both commit: the second
finds its manifest's place taken.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize

_DATA, _MANIFESTS = "data", "manifests"
LANDING = "landing"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete manifests of a table, oldest first."""
    fs, p = _fs(spark, f"{path}/{_MANIFESTS}")
    if not fs.exists(p):
        return []
    found = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found.append(int(name[1:]))
    return sorted(found)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(partition columns..., digest, n, landing, version, schema) of a version, the latest by default."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no complete landing at {path}")
    return spark.read.parquet(f"{path}/{_MANIFESTS}/v{known[-1] if version is None else version:08d}")


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def digests(df: DataFrame, cols: list[str]) -> DataFrame:
    """(cols..., digest, n): the content of each partition, whatever the order of its rows."""
    rest = [c for c in df.columns if c not in cols]
    # nulls are hashed as such: xxhash64 alone skips them
    row = [x for c in rest for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    g = df.groupBy(*cols).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(F.lit(1), *row).cast("decimal(38,0)")).alias("a"),
        F.sum(F.xxhash64(F.lit(2), *row).cast("decimal(38,0)")).alias("b"))
    return g.select(*cols, F.sha2(F.concat_ws(":", F.lit(",".join(rest)), "n", "a", "b"), 256).alias("digest"), "n")


def land(df: DataFrame, path: str, cols: tuple[str, ...] = ("task", "lang", "split"), drop_missing: bool = False) -> int:
    """Bring the table at ``path`` to the content of ``df``; the version committed (the
    one that was there, if nothing changed).

    Partitions that ``df`` doesn't have stay (a rerun of one language), or go
    with ``drop_missing``.  The digests cost one pass over ``df``, read once
    more for the changed partitions only.
    """
    spark, keys = df.sparkSession, list(cols)
    schema = json.dumps(df.select(*[c for c in df.columns if c not in keys], *keys).schema.jsonValue())
    mine = materialize(digests(df, keys), "landing-digests")
    known = versions(spark, path)
    name, version = uuid.uuid4().hex, (known[-1] if known else 0) + 1
    fresh = mine.select("*", F.lit(name).alias(LANDING), F.lit(version).alias("version"), F.lit(schema).alias("schema"))
    if known:
        old = materialize(manifest(spark, path), "landing-old")
        changed = mine.join(old, _same(mine, old, [*keys, "digest"]), "left_anti")
        stay = old.join(mine, _same(old, mine, keys if not drop_missing else [*keys, "digest"]),
                        "left_anti" if not drop_missing else "left_semi")
        if not drop_missing:
            stay = stay.unionByName(old.join(mine, _same(old, mine, [*keys, "digest"]), "left_semi"))
        fresh = fresh.join(old, _same(fresh, old, [*keys, "digest"]), "left_anti").unionByName(stay.drop("schema").withColumn("schema", F.lit(schema)))
    else:
        changed = mine
    changed = materialize(changed.select(*keys), "landing-changed")
    some = bool(changed.take(1))
    if known and not some and (not drop_missing or fresh.count() == manifest(spark, path).count()):
        return known[-1]
    if some:
        rows = df.join(changed, _same(df, changed, keys), "left_semi")
        rows.hint("rebalance", *keys).write.partitionBy(*keys).parquet(f"{path}/{_DATA}/{LANDING}={name}")
    # the commit: one small folder, whose _SUCCESS is written last; an existing one is an error
    fresh.coalesce(1).write.mode("error").parquet(f"{path}/{_MANIFESTS}/v{version:08d}")
    return version


def read_landed(spark: SparkSession, path: str, version: int | None = None, **equal: str) -> DataFrame:
    """The table as of a version, plus ``version``, the landing that wrote each row.
    ``equal`` picks partitions (``lang="de"``); only files of those are read."""
    m = manifest(spark, path, version)
    keys = [c for c in m.columns if c not in ("digest", "n", LANDING, "version", "schema")]
    for c, v in equal.items():
        m = m.filter(F.col(c) == v)
    first = m.select("schema").first()
    if first is None:
        first = manifest(spark, path, version).select("schema").first()
    if first is None:
        raise FileNotFoundError(f"the table at {path} has no partition")
    schema = StructType.fromJson(json.loads(first[0])).add(LANDING, "string")
    data = spark.read.schema(schema).parquet(f"{path}/{_DATA}")
    for c, v in equal.items():
        data = data.filter(F.col(c) == v)
    m = m.select(*[F.col(c).alias(f"m_{c}") for c in keys], F.col(LANDING).alias("m_landing"), "version")
    on = data[LANDING] == m["m_landing"]
    for c in keys:
        on = on & data[c].eqNullSafe(m[f"m_{c}"])
    return data.join(m, on).drop(LANDING, "m_landing", *[f"m_{c}" for c in keys])


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete the landings that none of the last ``keep`` manifests uses (old versions, killed runs); their names."""
    used = {r[0] for v in versions(spark, path)[-keep:] for r in manifest(spark, path, v).select(LANDING).distinct().collect()}
    fs, p = _fs(spark, f"{path}/{_DATA}")
    gone = []
    for s in fs.listStatus(p) if fs.exists(p) else ():
        name = s.getPath().getName().removeprefix(f"{LANDING}=")
        if name not in used:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return gone
