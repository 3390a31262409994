"""Incremental landing: only changed partitions are written, a killed run changes nothing."""

import os
import tempfile

import pytest

from babelgrid.sources import landing
from babelgrid.session import scratch_path

COLS = ("lang", "split")


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, lang string, split string")


def content(spark, path, **k):
    return sorted((tuple(r) for r in landing.read_landed(spark, path, **k).select("id", "text", "lang", "split", "version").collect()), key=str)


BASE = [(1, "a", "de", "train"), (2, None, "de", "train"), (2, None, "de", "train"), (3, "", "de", "test"), (4, "c", "en", "train"), (5, "d", None, "test"), (6, "e", "01", "test")]


def files(spark, path):
    fs, p = landing._fs(spark, f"{path}/data")
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def test_rerun_writes_changed_partitions_only(spark):
    path = scratch_path(spark, "land")
    assert landing.land(table(spark, BASE), path, COLS) == 1
    assert content(spark, path) == sorted(((*r, 1) for r in BASE), key=str)
    # the same rows in another order and cut: nothing is written
    assert landing.land(table(spark, BASE[::-1]).repartition(3), path, COLS) == 1 and len(files(spark, path)) == 1
    # one partition changes (a null text becomes empty), one is new, the rest of the input is left out
    new = [(1, "a", "de", "train"), (2, "", "de", "train"), (2, None, "de", "train"), (9, "z", "fr", "train")]
    assert landing.land(table(spark, new), path, COLS) == 2
    keep = [(*r, 1) for r in BASE if r[2:] != ("de", "train")]
    assert content(spark, path) == sorted(keep + [(*r, 2) for r in new], key=str)
    written = files(spark, path)
    assert len(written) == 2
    # earlier versions stay readable until they are vacuumed
    assert content(spark, path, version=1) == sorted(((*r, 1) for r in BASE), key=str)
    assert content(spark, path, lang="de") == sorted([(*r, 2) for r in new if r[2] == "de"] + [(3, "", "de", "test", 1)], key=str)
    assert landing.land(table(spark, new), path, COLS, drop_missing=True) == 3
    assert content(spark, path) == sorted(((*r, 2) for r in new), key=str)
    assert len(landing.vacuum(spark, path)) == 1 and content(spark, path) == sorted(((*r, 2) for r in new), key=str)


def test_killed_run_leaves_the_old_table(spark):
    path = scratch_path(spark, "land")
    landing.land(table(spark, BASE), path, COLS)
    bad = table(spark, [(1, "changed", "de", "train"), (7, "boom", "en", "train")])
    flag = tempfile.mktemp()

    def fail(batches):
        for b in batches:
            if b["text"].eq("boom").any() and os.path.exists(flag):
                raise RuntimeError("killed")
            yield b

    broken = bad.mapInPandas(fail, bad.schema)
    write = landing.materialize

    def armed(df, name):  # the digests succeed, the write of the data dies
        out = write(df, name)
        if name == "landing-changed":
            open(flag, "w").close()
        return out

    landing.materialize = armed
    try:
        with pytest.raises(Exception, match="killed"):
            landing.land(broken, path, COLS)
    finally:
        landing.materialize = write
    assert content(spark, path) == sorted(((*r, 1) for r in BASE), key=str)
    # a data folder without a manifest, and a manifest without _SUCCESS, are not seen
    table(spark, [(99, "x", "de", "train")]).write.partitionBy(*COLS).parquet(f"{path}/data/landing=dead")
    landing.manifest(spark, path).write.parquet(f"{path}/manifests/v00000002")
    fs, p = landing._fs(spark, f"{path}/manifests/v00000002/_SUCCESS")
    fs.delete(p, False)
    assert landing.versions(spark, path) == [1] and content(spark, path) == sorted(((*r, 1) for r in BASE), key=str)


def test_commits_collide(spark):
    path = scratch_path(spark, "land")
    landing.land(table(spark, BASE), path, COLS)
    spark.range(1).write.parquet(f"{path}/manifests/v00000002")
    fs, p = landing._fs(spark, f"{path}/manifests/v00000002/_SUCCESS")
    fs.delete(p, False)  # another landing is about to commit
    with pytest.raises(Exception, match="(?i)already exists"):
        landing.land(table(spark, [(1, "n", "de", "train")]), path, COLS)
    assert content(spark, path) == sorted(((*r, 1) for r in BASE), key=str)
    with pytest.raises(FileNotFoundError):
        landing.manifest(spark, path + "-none")


def test_only_the_picked_files_are_read(spark):
    path = scratch_path(spark, "land")
    landing.land(table(spark, BASE), path, COLS)
    p = landing.read_landed(spark, path, lang="de")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in p and "dynamicpruning" in p.lower()
    assert landing.read_landed(spark, path, lang="xx").count() == 0
