"""SimHash near-dedup against a brute-force version."""

import random
import re

import pytest
import xxhash

from babelgrid.llm import simhash


def plain(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    if not shingles:
        return 0
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, bits=3):
    fps = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return [(k, f"{f:016x}", least.get(find(i))) for i, ((k, _), f) in enumerate(zip(rows, fps))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "two WORDS", "a b c", "a  b\tc d\n", "É é x y z",
                                  "the cat sat on the mat " * 500, " lead and trail "])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    text = " ".join(str(i * i) for i in range(200))
    assert simhash.fingerprint(text) == plain(text)


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    rows = []
    for base in range(25):
        words = [rng.choice(vocab) for _ in range(rng.choice([5, 60, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(words)
            for _ in range(rng.choice([0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows) * 7 % 101, " ".join(w)))
    rows += [(None, "solo row without a key"), (500, None), (501, ""), (502, rows[3][1]), rows[0], rows[0]]
    rng.shuffle(rows)
    return rows


def test_components(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(brute(rows), key=str)


def test_links_are_exact(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps):
        for n in (1, 2, 3, 4):
            x = f
            for b in rng.sample(range(64), n):
                x ^= 1 << b
            fps.add(x)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 3}
    assert got == want


def test_long_chain(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1001)]
    got = dict(simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 201)}, 1001: 1000}


def test_dedup_keeps_one_of_each(spark):
    rows = corpus(8)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows],
                               "doc_id long, text string, fingerprint string, component_id int")
    out = simhash.dedup(df)
    assert out.columns == df.columns
    got = [r.doc_id for r in out.collect()]
    want = {c for _, _, c in brute(rows)}
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.dedup(df).collect() == []


def test_repeated_rows_leave_the_first_as_json(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "b"), (1, text, "a"), (1, text, None), (1, text, "a"), (2, text, "0"), (None, None, "z"), (None, None, "y"),
            (7, "nine ten eleven twelve thirteen", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(4)
    got = sorted((r.doc_id or 0, r.text, r.note) for r in simhash.dedup(df).collect())
    assert got == [(0, None, "y"), (1, text, "a"), (7, rows[-1][1], "q")]


def test_rows_meet_the_verdicts_once(spark):
    df = spark.range(40).selectExpr("id as doc_id", "concat_ws(' ', 'alpha beta gamma', cast(id % 30 as string), 'delta') as text")
    out = simhash.dedup(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert {r.doc_id for r in out.collect()} == {c for _, _, c in brute([(r.doc_id, r.text) for r in df.collect()])}
