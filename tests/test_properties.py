"""Random inputs against short Python loops written from the spec."""

import random
import re

from pyspark.sql import functions as F

from babelgrid.functions import labels as L
from babelgrid.operators.features import align_labels, pair_lengths, qa_windows
from babelgrid.operators.ner import with_entities
from babelgrid.operators.spans import best_spans


def py_chunks(tags):
    """Lenient IOB2 entities (type, start, end) by a plain loop."""
    out, cur = [], None
    for i, t in enumerate(tags + ["O"]):
        typ = t[2:] if t != "O" else None
        prev = tags[i - 1] if i > 0 else "O"
        start = t != "O" and (t.startswith("B") or prev == "O" or prev[2:] != typ)
        if cur and (t == "O" or start):
            out.append((cur[0], cur[1], i - 1))
            cur = None
        if start:
            cur = (typ, i)
    return out


def test_chunks_match_loop(spark):
    rnd = random.Random(7)
    rows = [[rnd.randrange(len(L.WIKIANN_LABELS)) for _ in range(rnd.randrange(0, 25))] for _ in range(300)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<int>")
    types = ["PER", "ORG", "LOC"]
    got = {r["i"]: [(types[e["type"] - 1], e["start"], e["end"]) for e in r["e"]]
           for r in with_entities(df, "a", "e", L.WIKIANN_LABELS).select("i", "e").collect()}
    for i, r in enumerate(rows):
        assert got[i] == py_chunks([L.WIKIANN_LABELS[x] for x in r]), (i, r)


def py_longest_first(la, lb, budget):
    while la + lb > budget:
        if la > lb:
            la -= 1
        else:
            lb -= 1
    return la, lb


def test_pair_truncation_matches_loop(spark):
    rnd = random.Random(3)
    cases = [(rnd.randrange(0, 300), rnd.randrange(0, 300), rnd.randrange(1, 260)) for _ in range(300)]
    df = spark.createDataFrame(cases, "la int, lb int, b int")
    rows = []
    for b in sorted({c[2] for c in cases})[:20]:
        sub = df.filter(F.col("b") == b)
        ka, kb = pair_lengths(F.col("la"), F.col("lb"), b)
        rows += [(r["la"], r["lb"], b, r["ka"], r["kb"]) for r in sub.select("la", "lb", ka.alias("ka"), kb.alias("kb")).collect()]
    for la, lb, b, ka, kb in rows:
        assert (ka, kb) == py_longest_first(la, lb, b)


def py_windows(n, cap, overlap):
    out, k = [], 0
    while True:
        s = k * (cap - overlap)
        out.append((s, min(s + cap, n)))
        if s + cap >= n:
            return out
        k += 1


def _qa_rows(rnd, n):
    """Contexts of random words and gaps, answers at random offsets, some without any."""
    rows = []
    for i in range(n):
        ws = [rnd.choice(["a", "bb", "cccc", "é", "dd-d"]) for _ in range(rnd.choice([0, 1, 3, 20, 90, 200]))]
        context = "".join(rnd.choice([" ", "  ", "\n"]) + w for w in ws) + rnd.choice(["", " "])
        q = " ".join(["q"] * rnd.randrange(0, 9))
        spans = [m.span() for m in re.finditer(r"\S+", context)]
        if spans and rnd.random() < 0.85:
            j = rnd.randrange(len(spans))
            k = min(len(spans) - 1, j + rnd.randrange(0, 6))
            lo, hi = spans[j][0], spans[k][1]
            if rnd.random() < 0.3:  # an answer that cuts into its words
                lo, hi = min(lo + 1, hi - 1), max(lo + 1, hi - 1)
            answers = ([lo], [context[lo:hi]]) if hi > lo else ([], [])
        else:
            answers = ([], [])
        rows.append((str(i), q, context, answers))
    return rows


def py_windows_of(q, context, answers, max_len, stride):
    """Windows with answer positions by a loop over tokens."""
    spans = [m.span() for m in re.finditer(r"\S+", context)]
    nq = len(q.split())
    cap = max_len - nq - 4
    cs = nq + 3
    out = []
    for k, (t0, t1) in enumerate(py_windows(len(spans), cap, stride)):
        start = end = 0
        if answers[0] and t1 > t0:
            lo, hi = answers[0][0], answers[0][0] + len(answers[1][0])
            if spans[t0][0] <= lo and spans[t1 - 1][1] >= hi:
                i = t0
                while i < t1 and spans[i][0] <= lo:
                    i += 1
                j = t1 - 1
                while j >= t0 and spans[j][1] >= hi:
                    j -= 1
                start, end = cs + i - 1 - t0, cs + j + 1 - t0
        out.append((k, t0, t1, start, end))
    return out


def test_answer_spans_match_loop(spark):
    rnd = random.Random(11)
    rows = _qa_rows(rnd, 250)
    schema = "id string, question string, context string, answers struct<answer_start:array<int>,text:array<string>>"
    d = spark.createDataFrame(rows, schema)
    got = {}
    for r in qa_windows(d, 40, 8).collect():
        got.setdefault(r.id, []).append((r.feature_idx, r.tok_start, r.tok_end, r.start_position, r.end_position))
    for i, q, context, answers in rows:
        assert sorted(got[i]) == py_windows_of(q, context, answers, 40, 8), (q, context, answers)


def test_aligned_labels_match_loop(spark):
    """D8 and D9, label arrays shorter than the words included: the guard ignores those words, without it they are null."""
    rnd = random.Random(12)
    rows = []
    for i in range(300):
        n = rnd.randrange(0, 12)
        wid = [None] + [w for w in range(n) for _ in range(rnd.randrange(0, 4))] + [None] * rnd.randrange(1, 3)
        rows.append((i, wid, [rnd.randrange(7) for _ in range(rnd.randrange(0, n + 2))]))
    d = spark.createDataFrame(rows, "i int, w array<int>, l array<int>")
    got = {r.i: r for r in d.select("i", align_labels(F.col("w"), F.col("l")).alias("plain"),
                                    align_labels(F.col("w"), F.col("l"), guarded=True).alias("guarded")).collect()}
    reached = 0
    for i, wid, labels in rows:
        for name in ("plain", "guarded"):
            want, prev = [], None
            for w in wid:
                if w is None or w == prev:
                    want.append(-100)
                elif w >= len(labels):
                    want.append(-100 if name == "guarded" else None)
                    reached += 1
                else:
                    want.append(labels[w])
                prev = w
            assert got[i][name] == want, (name, wid, labels)
    assert reached > 100


def test_best_spans_match_loop(spark):
    """G3 on any number of examples and windows, ties included."""
    rnd = random.Random(13)
    rows = []
    for i in range(60):
        for f in range(rnd.randrange(1, 5)):
            n = rnd.randrange(1, 30)
            offs = [None if rnd.random() < 0.2 else (p * 3, p * 3 + 2) for p in range(n)]
            logit = [[float(rnd.randrange(-3, 4)) for _ in range(n)] for _ in range(2)]
            rows.append(("x", str(i), f, *logit, offs, "".join(f"{p % 10}b " for p in range(n))))
    rows.append(("x", "none", 0, [1.0], [1.0], [None], "0b "))
    schema = "k string, id string, feature_idx int, start_logit array<float>, end_logit array<float>, offsets array<struct<s:int,e:int>>, context string"
    got = {r.id: (r.pred_text, r.score) for r in best_spans(spark.createDataFrame(rows, schema), ["k"], 5, 4).collect()}
    for i in {r[1] for r in rows}:
        best = None
        for _, _, f, sl, el, offs, context in sorted((r for r in rows if r[1] == i), key=lambda r: r[2]):
            def top(v):
                return [p for _, p in sorted(((x, p) for p, x in enumerate(v)), reverse=True)[:5]]
            for s in top(sl):
                for e in top(el):
                    if offs[s] and offs[e] and s <= e <= s + 4:
                        key = (-(sl[s] + el[e]), f, sl[s], el[e], s, e)
                        if best is None or key < best[0]:
                            best = (key, context[offs[s][0]:offs[e][1]])
        assert got[i] == ((best[1], -best[0][0]) if best else ("", None)), i


def test_window_counts_match_loop(spark):
    d = spark.range(0, 400).select(F.col("id").cast("string").alias("id"), F.lit("q").alias("question"),
                                   F.repeat(F.lit("w "), F.col("id").cast("int")).alias("context"),
                                   F.lit(None).cast("struct<answer_start:array<int>,text:array<string>>").alias("answers"))
    got = {int(r.id): r.n for r in qa_windows(d, 35, 12).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert all(got[n] == len(py_windows(n, 30, 12)) for n in range(400))
