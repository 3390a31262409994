"""Quoted CSV against pandas, in files cut into many ranges."""

import os
import random
import tempfile

import pandas as pd
import pytest

from babelgrid.sources import io
from babelgrid.sources.quoted_csv import read_quoted_csv
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("text", StringType()), StructField("classification", StringType()), StructField("n", LongType())])


def frame(rng, n):
    pieces = ['said "hi, you"', "a,b", "line one\nline two", "tab\t", '"', '""', "é\r\nwindows", "  spaces  ", "\n\n", "plain", "back\\slash", "'"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) or "x" for _ in range(n)]
    return pd.DataFrame({"text": texts, "classification": [rng.choice(["Faith", 'Gra"ce', "Sin\nful"]) for _ in range(n)],
                         "n": [k if k % 7 else None for k in range(n)]}).astype({"n": "Int64"})


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_files_of_pandas(spark, ends):
    """As the original corpora are written: index column, header, minimal quoting."""
    rng = random.Random(3)
    base = tempfile.mkdtemp(prefix="bg-csv-")
    want = []
    for k, lang in enumerate(("de", "en", "fr")):
        df = frame(rng, 400)
        if k == 2:
            df = df[["n", "classification", "text"]]
        df.to_csv(os.path.join(base, f"{lang}_train.csv"), lineterminator=ends)
        want += [(lang, "train", r.text, r.classification, None if pd.isna(r.n) else int(r.n)) for r in df.itertuples()]
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "700b")
    try:
        back = io.read_lang_split_csv(spark, base, SCHEMA)
        assert back.rdd.getNumPartitions() >= 8
        got = [(r.lang, r.split, r.text, r.classification, r.n) for r in back.collect()]
    finally:
        spark.conf.set(size, before)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_null_and_short_records(spark):
    base = tempfile.mkdtemp(prefix="bg-csv-")
    with open(os.path.join(base, "x.csv"), "w", newline="") as f:
        f.write('﻿,"te""xt",n\n0,"",1\n\n1,,x\n2,"a\n\nb",3\n3\n4,"He said ""hi, you"", ok",5')
    got = read_quoted_csv(spark, base, StructType([StructField('te"xt', StringType()), StructField("n", LongType()), StructField("none", LongType())]))
    assert sorted(((r[0], r[1], r[2]) for r in got.collect()), key=str) == sorted(
        [("", 1, None), (None, None, None), ("a\n\nb", 3, None), (None, None, None), ('He said "hi, you", ok', 5, None)], key=str)


def test_no_rows(spark):
    base = tempfile.mkdtemp(prefix="bg-csv-")
    open(os.path.join(base, "a.csv"), "w").close()
    open(os.path.join(base, "b.csv"), "w").write("text,n\n")
    assert read_quoted_csv(spark, base, SCHEMA).collect() == []
    assert read_quoted_csv(spark, base).columns == ["text", "n", "source_file"]


def test_sinks_keep_quotes_empty_and_null(spark):
    rows = [("de", "train", 'say "hi, you"', 1), ("de", "train", "", 2), ("de", "test", None, 3), ("en", "test", "a\\b\nc,\r\n", 4), ("en", "test", " x ", 5)]
    d = spark.createDataFrame(rows, "lang string, split string, text string, n long")
    schema = StructType([StructField("text", StringType()), StructField("n", LongType())])
    back = io.read_one_line_csv(spark, io.write_lang_split_csv(d, io.scratch_path(spark, "t")), schema)
    assert sorted(tuple(r) for r in back.select("n", "lang", "split", "text").collect()) == sorted((r[3], r[0], r[1], r[2]) for r in rows)
    path = io.write_quoted_csv(d, io.scratch_path(spark, "t"), ("lang", "split"))
    back = io.read_lang_split_csv(spark, path, schema, io.LANG_SPLIT_DIRS)
    assert sorted(tuple(r) for r in back.select("n", "lang", "split", "text").collect()) == sorted((r[3], r[0], r[1], r[2]) for r in rows)
    grid = spark.createDataFrame([("m", 'task "x", y', 0.5), ("m", "", 1.0), ("m", None, None)], "transfer_lang string, task string, f double")
    got = io.read_csv_folder(spark, io.write_grid(grid, io.scratch_path(spark, "t")),
                             StructType([StructField("task", StringType()), *d.sparkSession.createDataFrame([], "f double").schema.fields]))
    assert sorted((tuple(r)[:2] for r in got.collect()), key=str) == sorted([('task "x", y', 0.5), ("", 1.0), (None, None)], key=str)


def test_rerun_of_one_language(spark):
    """A rerun replaces its own language in an existing grid, no other."""
    path = io.scratch_path(spark, "grid")
    cols = "transfer_lang string, task_lang string, f double"
    io.write_grid(spark.createDataFrame([("de", "de", 0.1), ("de", "en", 0.2), ("en", "en", 0.3)], cols), path)
    io.write_grid(spark.createDataFrame([("de", "fr", 0.9)], cols), path)
    got = spark.read.option("header", True).schema("task_lang string, f double, transfer_lang string").csv(path)
    assert sorted(tuple(r) for r in got.select("transfer_lang", "task_lang", "f").collect()) == [("de", "fr", 0.9), ("en", "en", 0.3)]
