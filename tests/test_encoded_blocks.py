"""Token ids looked up by blocks of rows, against a dict, with repeated and null keys."""

import random

from babelgrid.operators import features as D

from .test_plans import plan_of


def rows_and_vocab(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30))), " ".join(rng.choice(words) for _ in range(rng.randrange(6))))
            for i in range(150)] + [(500, None, None), (501, "", " "), (None, "w1 w2", "w3"), (None, "w0", "w59 w4 w5"), (7, "w8", "w9")]
    df = spark.createDataFrame(rows, "id int, s string, t string").repartition(3)
    vocab = spark.createDataFrame([(w, 10 + i) for i, w in enumerate(words[:50])], "token string, token_id int")
    return rows, df, vocab, {w: 10 + i for i, w in enumerate(words[:50])}


def test_ids_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_TOKENS", 64)
    rows, df, vocab, ids = rows_and_vocab(spark)
    got = {r["id"]: (r["input_ids"], r["labels"]) for r in D.encode_text2text(df, vocab, "s", "t", 12, 4).collect()}
    want = {}
    for i, s, t in rows:
        sides = [[(p, ids.get(w, D.UNK_ID)) for p, w in enumerate((x or "").split()[:n])] for x, n in ((s, 11), (t, 3))]
        want[i] = [a + b for a, b in zip(want[i], sides)] if i in want else sides
    assert got == {i: tuple([v for _, v in sorted(x)] + [D.EOS_ID] for x in sides) for i, sides in want.items()}


def test_tokens_are_not_shuffled_one_by_one(spark):
    _, df, vocab, _ = rows_and_vocab(spark)
    p = plan_of(D.encode_text2text(df, vocab, "s", "t"))
    assert "posexplode(words" in p and "explode(toks" not in p and "explode_outer(toks" not in p
