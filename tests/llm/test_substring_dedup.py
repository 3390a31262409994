"""Substring dedup against plain windows in Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from babelgrid.llm import recompression as rc
from babelgrid.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, id long, tag string, starts int, keys string"


def plain(rows, window):
    out = []
    first = {}
    texts = [re.findall("[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (i, _), w in zip(rows, texts):
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    for (i, _), w in zip(rows, texts):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, window):
    rng = random.Random(seed)
    few, many = ["a", "b", "c"], [f"w{k}" for k in range(400)] + ["é", " ", " x"]
    passages = [[rng.choice(many) for _ in range(rng.randint(window, 3 * window))] for _ in range(6)]
    rows = []
    for k in range(150):
        words = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.3:
                p = rng.choice(passages)
                cut = rng.randint(0, window)
                words += p[cut:cut + rng.randint(1, len(p))]
            elif kind < 0.5:
                words += [rng.choice(few) for _ in range(rng.randint(1, 3 * window))]
            elif kind < 0.6:
                words += ["a"] * rng.randint(1, 3 * window)
            elif kind < 0.7:
                words += ["a", "b"] * rng.randint(1, 2 * window)
            else:
                words += [rng.choice(many) for _ in range(rng.randint(1, 40))]
        rows.append((rng.randint(0, 120), rng.choice([" ", "  ", "\n", "\t"]).join(words)))
    rows += [(None, rows[0][1]), (None, None), (3, ""), (4, " \n "), rows[1], rows[1], rows[2]]
    rows += [(200 + k, rows[5][1]) for k in range(8)] + [(300, " ".join(rng.choice(many) for _ in range(20000)) + " " + " ".join(passages[0]))]
    return rows


@pytest.mark.parametrize("seed, window, batch", [(1, 13, 200_000), (2, 13, 300), (3, 5, 300)])
def test_dedup(spark, monkeypatch, seed, window, batch):
    monkeypatch.setattr(sd, "BATCH", batch)
    rows = rows_of(seed, window)
    docs = spark.createDataFrame([(*r, 1, "t", 2, "k") for r in rows], SCHEMA).repartition(3)
    got = sd.dedup(docs, window=window)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, window)


def test_empty(spark):
    assert sd.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("rounds, alphabet, group", [(1, 3, 4), (1, 1000, 4), (2, 2, 2), (3, 50, 1)])
def test_equal_windows_have_equal_anchors(rounds, alphabet, group):
    """Whatever surrounds it, a window's key depends on its tokens alone."""
    rng = np.random.default_rng(rounds)
    tokens = [str(x).encode() for x in rng.integers(0, alphabet, 3000)]
    tokens += tokens[500:900] + tokens[100:113] + [b"x"] * 40 + tokens[700:720]
    names = rc.token_names(tokens)
    wall = np.zeros(len(names), bool)
    wall[[1000, 2000]] = True
    keys = rc.anchors(names, wall, 13, rounds, (group,) * rounds)
    seen = {}
    for k in range(len(keys)):
        if not wall[k:k + 13].any():
            assert seen.setdefault(tuple(tokens[k:k + 13]), keys[k]) == keys[k]
    assert len(set(seen.values())) < len(seen) or alphabet <= 3


def test_levels_shrink_and_cover():
    rng = np.random.default_rng(4)
    v = rc.base(rc.token_names([str(x).encode() for x in rng.integers(0, 500, 5000)]), np.zeros(5000, bool))
    for salt in range(1, 6):
        after = rc.next_level(v, salt)
        assert len(after.names) < 0.85 * len(v.names)
        assert after.start[0] == 0 and set(after.start) <= set(v.start)
        v = after
    assert sd.rounds_for(13) == 1 and sd.rounds_for(50) > 3


def test_hot_strings_are_salted():
    """A passage of all documents of a batch leaves it under its own key once."""
    import pyarrow as pa
    passage = " ".join(f"w{k}" for k in range(40))
    texts = [f"own{k} {passage} end{k}" for k in range(50)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(texts)], names=["id", "text"])
    got = pa.Table.from_batches(sd._key_rows(13, 1, 4)(iter([rows]))).to_pandas()
    unsalted = got[got.salt == 0].groupby("key").size()
    assert unsalted.max() == 1 and got.known.sum() > 50
