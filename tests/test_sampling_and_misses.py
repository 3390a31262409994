"""Exact samples by a threshold of the hash; unknown labels reported from the same pass."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from babelgrid.functions import labels as L
from babelgrid.operators import sampling as sp


def test_threshold_sample_is_the_ranked_one(spark):
    rng = random.Random(1)
    rows = [("big", k) for k in range(5000)] + [("small", k) for k in range(7)] + [("same", 1)] * 300 + [("one", 5)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "g string, id long").repartition(5)
    for n in (1, 10, 100, 5000):
        want = Counter()
        for g in {g for g, _ in rows}:
            ids = sorted((k for x, k in rows if x == g), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
            for r, k in enumerate(ids[:n]):
                want[g, k] += 1 if len(ids) >= n else n // len(ids) + (r < n % len(ids))
        got = Counter((r.g, r.id) for r in sp.sample_exact_n(d, ["g"], "id", n).collect())
        assert got == +want, n


def test_few_rows_pass_the_threshold(spark):
    """What is ranked is n rows and those of one bin, not the group."""
    d = spark.range(200_000).select(F.lit("hot").alias("g"), "id")
    h = sp.hash_key(F.col("id"))
    t = sp.thresholds(d, ["g"], h, 500)
    r = t.first()
    assert r["_size"] == 200_000
    near = d.filter(sp._bin(h) <= r["_upto"]).count()
    assert 500 <= near <= 500 + 40


def test_misses_come_with_the_same_pass(spark):
    texts = ["Faith"] * 50 + ["faith"] * 7 + ["Unknown"] * 20 + [None] * 3 + [""] * 2 + [f"x{k}" for k in range(30)]
    random.Random(2).shuffle(texts)
    d = spark.createDataFrame([(t,) for t in texts], "c string").repartition(4)
    seen, observed = L.observe_misses(d, "c", L.TAXI_LABELS)
    encoded = seen.withColumn("label", L.encode_or_null("c", L.TAXI_LABELS)).collect()
    assert len(encoded) == len(texts) and sum(r.label is None for r in encoded) == 62
    got = observed.get
    assert got["rows"] == len(texts) and got["unknown"] == 62 and got["null"] == 3
    assert L.misses(observed) == Counter(t for t in texts if t not in L.TAXI_LABELS)


def test_many_unknown_labels_stay_bounded(spark):
    d = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "often").otherwise(F.concat(F.lit("u"), F.col("id"))).alias("c"))
    seen, observed = L.observe_misses(d, "c", L.TAXI_LABELS, "many", 256)
    seen.write.format("noop").mode("overwrite").save()
    found = L.misses(observed)
    assert len(found) <= 256 and abs(found["often"] - 20_000) <= 60_000 / 64 and observed.get["unknown"] == 60_000
