"""Token offsets of windows (D6) against plain loops on awkward texts."""

import random
import re
import time

from pyspark.sql import functions as F

from babelgrid.operators import features as D

SPACES = [" ", "  ", "\n", "\t ", " ", "  "]
WORDS = ["a", "word", "été", "\U0001f600x", "end.", "हि"]


def _text(rng, n):
    lead = rng.choice(["", " ", "\n\n"])
    return lead + "".join(rng.choice(WORDS) + rng.choice(SPACES) for _ in range(n))


def _plain(question, context, max_len, stride):
    spans = [m.span() for m in re.finditer(r"\S+", context or "")]
    q = len((question or "").split())
    cap = max_len - q - D.PAIR_SPECIALS
    out, at = [], 0
    while True:
        out.append([None] * (q + 3) + spans[at:at + cap] + [None])
        if at + cap >= len(spans):
            return out
        at += cap - stride


def _frame(spark, rows):
    return spark.createDataFrame(
        [(i, q, c, ([], [])) for i, (q, c) in enumerate(rows)],
        "id long, question string, context string, answers struct<text:array<string>,answer_start:array<int>>")


def _windows(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.id, {})[r.feature_idx] = [o and tuple(o) for o in r.offsets]
    return {i: [w[k] for k in sorted(w)] for i, w in got.items()}


def test_offsets_equal_plain_loops(spark):
    rng = random.Random(5)
    rows = [("why " * rng.randint(0, 5), _text(rng, rng.choice([0, 1, 7, 30, 31, 32, 200, 700]))) for _ in range(60)]
    rows += [("q", ""), ("q", " \n "), ("q", None), (None, "one two"), (None, None)]
    for max_len, stride in ((40, 12), (24, 13), (384, 128)):
        got = _windows(D.qa_offsets(_frame(spark, rows), max_len, stride))
        assert got == {i: _plain(q, c, max_len, stride) for i, (q, c) in enumerate(rows)}


def test_running_sums(spark):
    rng = random.Random(6)
    rows = [([rng.randint(0, 9) for _ in range(n)],) for n in (0, 1, 3, 4, 5, 16, 17, 1000)]
    got = spark.createDataFrame(rows, "v array<int>").select("v", D.running_sums(F.col("v"), 4).alias("s")).collect()
    for r in got:
        assert r.s == [sum(r.v[:i + 1]) for i in range(len(r.v))]


def test_one_very_long_context(spark):
    n = 400_000
    text = "".join(f"w{i % 97} " + ("\n" if i % 13 == 0 else "") for i in range(n))
    t0 = time.time()
    df = D.qa_offsets(_frame(spark, [("what is it", text)]))
    got = df.select(F.count(F.lit(1)).alias("n"), F.max(F.get("offsets", F.size("offsets") - 2)["e"]).alias("last"),
                    F.sum(F.size("offsets")).alias("size")).first()
    want = _plain("what is it", text, D.QA_MAX_LEN, D.QA_STRIDE)
    assert (got.n, got.last, got.size) == (len(want), len(text.rstrip()), sum(map(len, want)))
    assert time.time() - t0 < 60
