"""Tags and entities of whole Arrow batches against plain loops over the rows."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from babelgrid import fixtures as fx
from babelgrid.functions import labels as L
from babelgrid.functions.text import ws_tokens
from babelgrid.operators import ner
from babelgrid.plans import QUERIES

from .test_plans import plan_of

IDS = "i int, labels array<int>, pred_tags array<int>"


def chunks(ids):
    """(type, start, end) by the lenient rule."""
    out, names = [], [None if x == "O" else x for x in (L.WIKIANN_LABELS[i] for i in ids)]
    for i, x in enumerate(names):
        if x is None:
            continue
        before = names[i - 1] if i else None
        if x[0] == "B" or before is None or before[2:] != x[2:]:
            out.append([x[2:], i, i])
        else:
            out[-1][2] = i
    return {tuple(e) for e in out}


def test_row_counts_of_a_batch(spark):
    rng = random.Random(5)
    rows = [(0, [], []), (1, [-100, -100], [1, 2]), (2, [1, 2, 2], [1]), (3, [3], [3, 4, 4]), (4, None, None)]
    for i in range(5, 200):
        n = rng.randrange(40)
        gold = [rng.choice([-100, *range(7)]) for _ in range(n)]
        rows.append((i, gold, [g if g >= 0 and rng.random() < .7 else rng.randrange(7) for g in gold]))
    df = spark.createDataFrame(rows, IDS).repartition(3)
    got = {r["i"]: r for r in ner.ner_rows(df, ["i"], L.WIKIANN_LABELS).collect()}
    types = ner.type_names(L.WIKIANN_LABELS)
    for i, gold, pred in rows[:4] + rows[5:]:
        pairs = [(g, p) for g, p in zip(gold, pred) if g != -100]
        t, p = chunks([g for g in gold if g != -100]), chunks([p for _, p in pairs])
        assert (got[i]["correct"], got[i]["tokens"]) == (sum(g == p for g, p in pairs), sum(g != -100 for g in gold)), i
        for name, found in (("nt", t), ("np", p), ("nm", t & p)):
            n = Counter(k for k, *_ in found)
            assert got[i][name] == [n[k] for k in types], (i, name)
    assert set(got[4]["nt"]) == {None} and not got[4]["tokens"]


def test_unknown_label_ids_open_and_close_nothing(spark):
    df = spark.createDataFrame([(1, [1, None, 2, 2]), (2, [99, 2]), (3, None), (4, [5, 6, None]), (5, [])], "i int, a array<int>")
    got = {r["i"]: r["e"] and [tuple(e) for e in r["e"]] for r in ner.with_entities(df, "a", "e", L.WIKIANN_LABELS).collect()}
    half = [(None, None, None)]  # a start or an end is missing
    assert got == {1: [(1, 0, 3)], 2: half, 3: None, 4: half, 5: []}


def test_multiset_overlap_of_a_batch(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randrange(9))], [rng.choice("abcd") for _ in range(rng.randrange(9))])
            for i in range(100)] + [(100, None, ["a"]), (101, [None, "a"], [None, "a"])]
    df = spark.createDataFrame(rows, "i int, p array<string>, g array<string>")
    got = dict(df.select("i", ner.multiset_overlap("p", "g")).collect())
    assert all(got[i] == sum((Counter(p) & Counter(g)).values()) for i, p, g in rows[:100])
    assert got[100] is None and got[101] == 1


def test_tags_follow_the_words_md5(spark, small_dir):
    for r in fx.fx_ner(spark, small_dir).where("doc_id < 20").collect():
        kinds = [fx.NER_TYPE_BY_DIGIT.get(hashlib.md5(w.encode()).hexdigest()[0], "O") for w in r["tokens"]]
        names = ["O" if k == "O" else ("I-" if i and kinds[i - 1] == k else "B-") + k for i, k in enumerate(kinds)]
        assert [L.WIKIANN_LABELS[t] for t in r["tags"]] == names


def test_a_tag_for_every_word_whatever_the_white_space(spark):
    spaces = [chr(i) for i in range(0x10000) if chr(i).isspace()]
    texts = [f"{x}a{x}b{x}{x}c" for x in [*spaces, "\u180e", "\u200b", "\ufeff", "\x00", "\u3001", "\U0001f600"]] + [None, "", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        ws_tokens("t").alias("w"), fx._word_tags(F.col("t"), L.WIKIANN_LABELS, fx.NER_TYPE_BY_DIGIT).alias("tags"), "t")
    rows = df.collect()
    assert all(r["w"] == (r["t"] and r["t"].split()) or not r["t"] for r in rows)
    assert all(len(r["w"]) == len(r["tags"]) if r["t"] is not None else r["w"] is r["tags"] is None for r in rows)


def test_tags_and_entities_are_made_by_the_batch(spark, small_dir):
    for name in ("label_dim", "ner_macro_grid", "ner_macro_grid_9", "ner_type_prf", "tag_multiset_f1", "generated_tags_grid"):
        p = plan_of(QUERIES[name](spark, small_dir))
        assert "ArrowEvalPython" in p and "md5(" not in p and "zip_with(" not in p, name
    assert "zip_with(" not in plan_of(ner.token_accuracy_grid(
        spark.createDataFrame([(1, [1], [1])], IDS).withColumn("c", F.lit(1)), ["c"]))
