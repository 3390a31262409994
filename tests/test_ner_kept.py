"""Words hashed, positions masked and tags kept by the batch, against plain loops."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from babelgrid import fixtures as fx
from babelgrid.functions import labels as L
from babelgrid.operators.ner import tag_string_grid
from babelgrid.plans import QUERIES

from .test_plans import plan_of


def test_a_word_of_a_batch_is_hashed_once(monkeypatch):
    hashed = []

    def md5(word, **kw):
        hashed.append(word)
        return hashlib.md5(word, **kw)
    monkeypatch.setattr(fx, "md5", md5)
    words = ["a", "b", "", "a", "\u00e9", "b", "a"] * 50
    assert fx._first_digits(pa.array(words)).tolist() == [int(hashlib.md5(w.encode()).hexdigest()[0], 16) for w in words]
    assert sorted(hashed) == [b"", b"a", b"b", "\u00e9".encode()]
    assert fx._first_digits(pa.array([], pa.string())).tolist() == []


def test_words_are_tagged_once_for_tags_and_labels(spark, small_dir):
    p = plan_of(QUERIES["ner_token_accuracy"](spark, small_dir))
    assert "_some_masked(pythonUDF" in p and "lambdafunction" not in p


def test_every_seventh_label_is_masked(spark):
    rows = [(0, []), (1, None), (2, [3]), (3, list(range(20))), (4, [1, 2, None, 4, 5, 6, None, 0])]
    df = spark.createDataFrame(rows, "i int, a array<int>").repartition(2)
    got = dict(df.select("i", fx._some_masked("a")).collect())
    assert got == {i: a if a is None else [-100 if k % 7 == 6 else x for k, x in enumerate(a)] for i, a in rows}


def pairs(preds, labels):
    if preds is None or labels is None:
        return None
    preds = preds + [None] * (len(labels) - len(preds))
    return [(p, x) for p, x in zip(preds, labels) if x is not None and x != -100]


@pytest.mark.parametrize("element", ["int", "bigint"])
def test_masked_pairs_of_a_batch(spark, element):
    rng = random.Random(7)
    rows = [(0, [], []), (1, None, [1, 2]), (2, [1, 2], None), (3, None, None), (4, [1], [1, 2, -100, 3]),
            (5, [1, 2, 3], [-100]), (6, [None, 2, 3], [1, None, -100]), (7, [-100, 5], [0, 5])]
    for i in range(8, 150):
        n = rng.randrange(30)
        rows.append((i, [rng.randrange(7) for _ in range(n)], [rng.choice([-100, None, *range(7)]) for _ in range(n)]))
    df = spark.createDataFrame(rows, f"i int, p array<{element}>, l array<{element}>").repartition(3)
    # whole rows, then those of equal lengths only: a batch of them takes the short way
    for some in (df, df.where("i >= 8")):
        z = some.select("i", L.masked_pairs("p", "l", element=element).alias("z"))
        assert z.schema["z"].dataType.simpleString() == f"array<struct<p:{element},l:{element}>>"
        got = {r["i"]: r["z"] and [tuple(x) for x in r["z"]] for r in z.collect()}
        assert got == {i: pairs(p, x) for i, p, x in rows if i in got} and len(got) in (150, 142)


def test_masked_pairs_query_has_no_interpreted_lambda(spark, small_dir):
    assert "lambdafunction" not in plan_of(QUERIES["masked_pairs"](spark, small_dir))


def test_tag_strings_without_o_and_null(spark, small_dir):
    rows = [("a", [0, 1, 0, 2], [1, 2]), ("a", [0, 0], []), ("a", [1, None, 0], [None, 1]), ("a", [1], [2]),
            ("b", None, [1]), ("b", [None], [0]), ("c", [None, 1], [1, 1])]
    df = spark.createDataFrame(rows, "c string, tags array<int>, pred_tags array<int>")
    got = {r["c"]: r["exact_match"] for r in tag_string_grid(df, ["c"], L.WIKIANN_LABELS).collect()}
    assert got == {"a": 0.75, "b": 1.0, "c": 0.0}
    assert "array_remove(" in plan_of(QUERIES["tag_exact_match"](spark, small_dir).select(F.col("*")))
