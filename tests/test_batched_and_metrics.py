"""J1 batched functions, J6 mergeable metrics, H10 overlap, windows of null questions."""

import random
import time
from collections import Counter

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from babelgrid.operators import scoring
from babelgrid.operators.batched import map_batched
from babelgrid.operators.features import qa_windows
from babelgrid.operators.qa import multiset_overlap

OUT = StructType([StructField("piece", StringType()), StructField("size", IntegerType())])


def pieces(batch):
    out = {"origin": [], "piece": [], "size": []}
    for k, t in enumerate(batch["text"]):
        for p in (t or "").split("|"):
            if p:
                out["origin"].append(k)
                out["piece"].append(p[:5])
                out["size"].append(len(p))
    return out


def test_rows_become_several_or_none(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([None, "", "x", "ab|c||d", "|".join("q" * n for n in range(9))])) for k in range(3000)]
    rows.append((-1, "big", "y" * 20_000_000 + "|z"))
    d = spark.createDataFrame(rows, "id long, lang string, text string")
    want = Counter((i, g, p[:5], len(p)) for i, g, t in rows for p in (t or "").split("|") if p)
    for limits in ({}, {"batch_rows": 7}, {"batch_bytes": 50}):
        got = map_batched(d, pieces, OUT, ["id", "lang"], **limits)
        assert got.columns == ["id", "lang", "piece", "size"]
        assert Counter(tuple(r) for r in got.collect()) == want
    assert map_batched(d.where("false"), pieces, OUT, ["id"]).collect() == []


def test_batches_are_bounded(spark):
    d = spark.range(1000).select("id", F.repeat(F.lit("x"), 1000).alias("text")).coalesce(1)
    sizes = StructType([StructField("n", IntegerType())])
    got = map_batched(d, lambda b: {"n": [len(b["id"])] * len(b["id"])}, sizes, ["id"], batch_rows=300, batch_bytes=40_000)
    assert 1 < got.agg(F.max("n")).first()[0] <= 40


@pytest.mark.parametrize("fn, said", [
    (lambda b: {"piece": ["x"], "size": [1]}, "must return 'origin'"),
    (lambda b: {"piece": ["x"], "size": [1], "origin": [99]}, "must name a row"),
    (lambda b: {"piece": ["x"], "size": [], "origin": [0]}, "different lengths"),
    (lambda b: {"piece": b["text"]}, "returned the columns")])
def test_lost_keys_are_refused(spark, fn, said):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string").coalesce(1)
    with pytest.raises(PythonException, match=said):
        map_batched(d, fn, OUT, ["id"]).collect()
    with pytest.raises(ValueError, match="named like keys"):
        map_batched(d, fn, OUT, ["id", "piece"])


def test_any_number_of_metrics_is_one_pass(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(4), rng.randrange(4)) for _ in range(500)]
    path = spark.createDataFrame(rows, "c string, label int, pred int")
    off = F.abs(F.col("label") - F.col("pred"))
    scoring.register_metric("t_near", scoring.Metric(lambda: F.sum("t_near") / F.sum("t"), {"t_near": (off <= 1).cast("int")}))
    got = scoring.compute_metrics(path, ["c"], ["accuracy", "f1_macro", "f1_weighted", "t_near"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Union" not in plan and "Join" not in plan
    assert plan.count("Aggregate [") == 3  # rows to confusion counts, to classes, to cells
    values = {(r.metric, r.c): r.value for r in got.collect()}
    for c in "ab":
        mine = [(t, p) for x, t, p in rows if x == c]
        f1 = {}
        for k in range(4):
            tp, t, p = sum(a == b == k for a, b in mine), sum(a == k for a, _ in mine), sum(b == k for _, b in mine)
            f1[k] = (2 * tp / (t + p), t)
        n = len(mine)
        assert values["accuracy", c] == pytest.approx(sum(a == b for a, b in mine) / n, abs=1e-6)
        assert values["f1_macro", c] == pytest.approx(sum(x for x, _ in f1.values()) / 4, abs=1e-6)
        assert values["f1_weighted", c] == pytest.approx(sum(x * t for x, t in f1.values()) / n, abs=1e-6)
        assert values["t_near", c] == pytest.approx(sum(abs(a - b) <= 1 for a, b in mine) / n, abs=1e-6)
    scoring.register_metric("t_clash", scoring.Metric(lambda: F.sum("t_near"), {"t_near": F.lit(1)}))
    with pytest.raises(ValueError, match="another meaning"):
        scoring.compute_metrics(path, ["c"], ["t_near", "t_clash"])


def test_overlap_is_a_multiset_intersection(spark):
    rng = random.Random(3)
    rows = [([rng.choice("abcde") for _ in range(rng.randrange(12))], [rng.choice("abcdf") for _ in range(rng.randrange(12))]) for _ in range(300)]
    d = spark.createDataFrame(rows, "p array<string>, g array<string>")
    got = d.select("p", "g", multiset_overlap(F.col("p"), F.col("g")).alias("n")).collect()
    assert all(r.n == sum((Counter(r.p) & Counter(r.g)).values()) for r in got)


def test_overlap_is_linear(spark):
    """Ten times the distinct tokens take at most some ten times as long, not a hundred."""
    def seconds(n):
        a = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.concat(F.lit("t"), x.cast("string")))
        b = F.transform(F.sequence(F.lit(n // 2), F.lit(n + n // 2 - 1)), lambda x: F.concat(F.lit("t"), x.cast("string")))
        d = spark.range(1).select(a.alias("p"), b.alias("g"))
        t0 = time.time()
        assert d.select(multiset_overlap(F.col("p"), F.col("g"))).first()[0] == n - n // 2
        return time.time() - t0
    seconds(100)
    small = seconds(10_000)
    assert seconds(100_000) < 30 * small + 5


def test_windows_of_null_texts(spark):
    schema = "id string, question string, context string, answers struct<answer_start:array<int>,text:array<string>>"
    d = spark.createDataFrame([("a", None, "one two", ([0], ["one"])), ("b", "q", None, ([0], ["x"])), ("c", "q", "", None)], schema)
    got = {r.id: (r.feature_idx, r.tok_start, r.tok_end) for r in qa_windows(d, 64, 16).collect()}
    assert got == {"a": (0, 0, 2), "b": (0, 0, 0), "c": (0, 0, 0)}
