"""Incremental grid: the latest file wins, whatever the order of arrival; restarts, replays, no history read."""

import os
import tempfile
import time

from babelgrid.plans.q_io import _STREAM_SCHEMA
from babelgrid.sources import landing
from babelgrid.streaming import grid_stream as gs
from babelgrid.streaming.grid_stream import run_once


def _write(spark, rows, path, age=0):
    """One CSV per transfer language; ``age`` seconds old."""
    seen = set(_files(path))
    df = spark.createDataFrame(rows, "task string, model string, task_lang string, transfer_lang string, accuracy double, f1_score double")
    df.coalesce(1).write.mode("append").option("header", True).partitionBy("transfer_lang").csv(path)
    at = time.time() - age
    for f in set(_files(path)) - seen:
        os.utime(f, (at, at))


def _files(path):
    return [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".csv")]


def _grid(df):
    return {(r["task_lang"], r["transfer_lang"]): (r["accuracy"], r["f1_score"]) for r in df.collect()}


def test_latest_file_wins(spark):
    base = tempfile.mkdtemp(prefix="bg-stream-")
    src = os.path.join(base, "incoming")
    _write(spark, [("cls", "m", "de", "en", 0.5, 0.4), ("cls", "m", "fr", "en", 0.6, None), ("cls", "m", "fr", "de", 0.1, 0.1)], src, age=100)
    want = {("de", "en"): (0.5, 0.4), ("fr", "en"): (0.6, None), ("fr", "de"): (0.1, 0.1)}
    assert _grid(run_once(spark, src, base, _STREAM_SCHEMA)) == want
    # a restart from the checkpoint, with a newer file: its keys change, others stay
    _write(spark, [("cls", "m", "de", "en", 0.9, 0.8)], src, age=50)
    want["de", "en"] = (0.9, 0.8)
    grid = run_once(spark, src, base, _STREAM_SCHEMA)
    assert _grid(grid) == want
    # a late older file changes nothing, except a key not seen before
    table = os.path.join(base, "table")
    before = landing.versions(spark, table)[-1]
    _write(spark, [("cls", "m", "de", "en", 0.2, 0.2), ("cls", "m", "fr", "en", 0.2, 0.2)], src, age=500)
    assert _grid(run_once(spark, src, base, _STREAM_SCHEMA)) == want
    assert landing.versions(spark, table)[-1] == before
    _write(spark, [("cls", "m", "de", "en", 0.3, 0.2), ("cls", "m", "es", "en", 0.3, 0.3)], src, age=400)
    want["es", "en"] = (0.3, 0.3)
    assert _grid(run_once(spark, src, base, _STREAM_SCHEMA)) == want
    # nothing new: no batch, same grid
    assert _grid(run_once(spark, src, base, _STREAM_SCHEMA)) == want


def test_replayed_batch_and_kept_versions(spark):
    """A batch that is run again after its landing is no new version; a version reads its own files only."""
    table = os.path.join(tempfile.mkdtemp(prefix="bg-stream-"), "table")
    keys, cols = ["k", "l"], "k string, l string, v double"

    def rows(*r):
        return spark.createDataFrame(r, cols)

    assert gs.replace_keys(rows(("a", None, 1.0), ("b", "x", 2.0)), table, keys) == 1
    assert gs.replace_keys(rows(("a", None, 1.5)), table, keys) == 2
    assert gs.replace_keys(rows(("a", None, 1.5)), table, keys) == 2
    for n in range(5):
        gs.replace_keys(rows(("a", None, 10.0 + n)), table, keys)
    got = landing.read_landed(spark, table)
    assert sorted((r.k, r.l, r.v) for r in got.collect()) == [("a", None, 14.0), ("b", "x", 2.0)]
    folders = {p.name for p in os.scandir(os.path.join(table, "data"))}
    assert len(folders) <= gs.KEEP_VERSIONS + 1
