"""Naive Bayes with a token in a third of all places, against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from babelgrid.operators import transfer as T

K = 3


def _examples(seed, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["the" if rng.random() < 0.34 else f"W{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randint(0, 40))]
        text = None if i % 37 == 5 else "  ".join(words)
        rows.append(("t", ["aa", "bb", "cc"][rng.randrange(3)], "train" if i % 3 else "test", i, rng.randrange(K), text))
    return rows


def _plain(rows):
    """(id, transfer language) -> scores of the classes."""
    langs = sorted({r[1] for r in rows if r[2] == "train"})
    out = {}
    for lang in langs:
        train = [r for r in rows if r[2] == "train" and r[1] == lang]
        n = [Counter() for _ in range(K)]
        for r in train:
            n[r[4]].update((r[5] or "").lower().split())
        vocab = set().union(*n)
        docs = Counter(r[4] for r in train)
        for r in rows:
            if r[2] == "test":
                seen = [w for w in (r[5] or "").lower().split() if w in vocab]
                out[r[3], lang] = [
                    math.log(docs[c] / len(train)) + sum(math.log1p(n[c][w]) for w in seen)
                    - len(seen) * math.log(sum(n[c].values()) + len(vocab)) for c in range(K)]
    return out


def _frames(spark, rows):
    ex = spark.createDataFrame(rows, "task string, lang string, split string, id long, label int, text string")
    return ex.where("split = 'train'"), ex.where("split = 'test'"), T.transfer_languages(ex)


def _check(spark, rows):
    train, test, langs = _frames(spark, rows)
    got = T.predict_naive_bayes(T.train_naive_bayes(train, K), test, langs).collect()
    want = _plain(rows)
    assert {(r.id, r.transfer_lang) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        scores = want[r.id, r.transfer_lang]
        assert scores[r.pred] >= max(scores) - 1e-9


def test_scores_equal_plain_loops(spark):
    _check(spark, _examples(1))


@pytest.mark.parametrize("hot", [T.HOT_TOKENS, 2])
def test_scores_when_the_weights_exceed_a_broadcast(spark, monkeypatch, hot):
    monkeypatch.setattr(T.frequent_tokens, "__defaults__", (hot, 4096))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = _examples(2)
        _check(spark, rows)
        train, test, langs = _frames(spark, rows)
        df = T.predict_naive_bayes(T.train_naive_bayes(train, K), test, langs)
        plan = df._jdf.queryExecution().executedPlan().toString()
        # the hot tokens and nothing else: once for their weights, once to leave them out
        assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_sketch_finds_frequent_tokens_in_any_order(spark):
    # each of 8 tasks has its own rare tokens, "the" is in every third document
    docs = spark.range(0, 6000, 1, 8).selectExpr(
        "'t' as task", "case when id % 3 = 0 then array('the', concat('r', id)) else array(concat('r', id)) end as toks")
    bags = docs.select("task", T.token_bag(docs["toks"]).alias("bag"))
    top = [r.token for r in T.frequent_tokens(bags, 4, 64).collect()]
    assert "the" in top and len(top) <= 4


def test_token_bag(spark):
    rows = [(["b", "a", "b", "b"],), ([],), (None,), (["x"],)]
    got = spark.createDataFrame(rows, "t array<string>").select(T.token_bag(F.col("t")).alias("bag")).collect()
    assert [r.bag and [tuple(x) for x in r.bag] for r in got] == [[("a", 1), ("b", 3)], None, None, [("x", 1)]]
