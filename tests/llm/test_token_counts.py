"""Edit-aware counts against encoding the edited text anew."""

import random

import pytest

from babelgrid.llm import token_counts as tc
from babelgrid.llm.queries import QUERIES


@pytest.fixture(scope="module")
def of():
    return tc.counter()


def whole(text, of):
    return len(of.encoding.encode_ordinary(text))


ALPHABET = ["a", "the", "Word", " ", "  ", "\n", "\n\n ", "'s", "'", "1", "234", "é", "漢字", "!!", "𝄞", "\t", "<", "don't"]


def test_random_edits(of):
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 5, 80, 700])))
        tree = tc.Tree.of_text(text, of)
        assert tree.tokens[1] == whole(text, of)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 3, 40, 300]))
            new = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 3, 30, 900])))
            want = text[:a] + new + text[b:]
            text, tree, _ = tc.edit(text, tree, a, b, new, of)
            assert text == want and tree.tokens[1] == whole(want, of) and tree.chars[1] == len(want)
            at = 0
            for n, k in tree.leaves():  # leaves end where pre-tokens end
                assert k == whole(want[at:at + n], of) or at + n < len(want)
                at += n


def test_only_the_region_is_encoded(of):
    text = "some plain words here " * 20_000
    tree = tc.Tree.of_text(text, of)
    _, tree, n = tc.edit(text, tree, 200_001, 200_004, "X", of)
    assert n <= 4 * tc.LEAF


def test_very_long_text_in_pieces(of, monkeypatch):
    text = "a b  c\n" * 3000
    want = tc.Tree.of_text(text, of)
    monkeypatch.setattr(tc, "_LONG", 100)
    got = tc.Tree.of_text(text, of)
    assert (got.chars, got.tokens) == (want.chars, want.tokens)


def test_columns(spark, of):
    rows = [(1, "hello world, again and again", [(0, 5, "HELLO"), (28, 99, "!")], 7), (2, None, [(0, 0, "new")], 7),
            (3, "", None, 7), (None, "keep", [], 7), (1, "hello world, again and again", [(3, 9, None)], 7)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {tc.EDITS}, n_tokens int")
    got = sorted(((r.doc_id, r.text, r.n_tokens) for r in tc.apply_edits(tc.build(df)).collect()), key=str)
    want = [(1, "HELLO world, again and again!"), (2, "new"), (3, ""), (None, "keep"), (1, "helld, again and again")]
    assert got == sorted(((k, t, whole(t, of)) for k, t in want), key=str)
    assert tc.apply_edits(tc.build(df.where("false"))).collect() == []


def test_query(spark, small_dir, of):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    for r in QUERIES["op8_token_counts"](spark, small_dir).collect():
        t = texts[r.doc_id]
        n, q, h = len(t), len(t) // 4, len(t) // 2
        end = max(h, n - 5)
        new = t[:q] + "edited " + t[min(q + 3, h):h] + " with a new clause," + t[h:end]
        assert (r.n_tokens, r.n_tokens_edited) == (whole(t, of), whole(new, of))
