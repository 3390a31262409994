"""Hand-computed goldens (FIXTURES.md section 4)."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from babelgrid.functions import labels as L
from babelgrid.functions import text as TX
from babelgrid.operators import features as D
from babelgrid.operators.classification import argmax, classification_grid
from babelgrid.operators.ner import ner_grid, tag_string_scores, with_entities
from babelgrid.operators.qa import squad_grid, token_f1
from babelgrid.operators.runs import best_checkpoint, early_stop, retain_checkpoints
from babelgrid.operators.sampling import sample_exact_n


def one(spark, col, schema="s string", value=None):
    return spark.createDataFrame([(value,)], schema).select(col.alias("out")).first()["out"]


def test_normalize_answer(spark):
    assert one(spark, TX.normalize_answer("s"), value="The  Cat, an' a DOG!") == "cat dog"
    assert one(spark, TX.normalize_answer("s"), value="ça the día") == "ça día"


def test_parse_numpy_list(spark):
    assert one(spark, TX.parse_numpy_list("s"), value="""['I' "don't" 'go' '' "a"]""") == ["I", "don't", "go", "", "a"]


def test_strip_and_tokens(spark):
    assert one(spark, TX.strip("s"), value="  x y\t\n") == "x y"
    assert one(spark, TX.ws_tokens("s"), value="") == []
    assert one(spark, TX.ws_tokens("s"), value="  a 　b ") == ["a", "b"]


def test_token_f1(spark):
    df = spark.createDataFrame([(["a", "b", "b", "c"], ["b", "b", "d"]), ([], [])], "p array<string>, g array<string>")
    got = [r[0] for r in df.select(token_f1(F.col("p"), F.col("g"))).collect()]
    assert got[0] == pytest.approx(4 / 7)
    assert got[1] == 0.0


def test_squad_best_of_golds(spark):
    refs = spark.createDataFrame([("qa", "en", "q1", (["dog", "the cat"], [0, 4]))],
                                 "task string, task_lang string, id string, answers struct<text:array<string>,answer_start:array<int>>")
    preds = spark.createDataFrame([("qa", "en", "en", "q1", "cat")], "task string, transfer_lang string, task_lang string, id string, pred_text string")
    r = squad_grid(refs, preds, ["task_lang", "transfer_lang"]).first()
    assert (r["exact_match"], r["f1_score"]) == (100.0, 100.0)


def test_macro_and_weighted_f1(spark):
    df = spark.createDataFrame([("x", 0, 0), ("x", 0, 1), ("x", 1, 2)], "c string, label int, pred int")
    r = classification_grid(df, ["c"]).first()
    assert r["f1_score"] == pytest.approx(2 / 9, abs=1e-6)
    assert r["weighted_f1"] == pytest.approx(4 / 9, abs=1e-6)
    assert r["accuracy"] == pytest.approx(1 / 3, abs=1e-6)


def _ner(spark, true_tags, pred_tags):
    ids = {t: i for i, t in enumerate(L.WIKIANN_LABELS)}
    df = spark.createDataFrame([("c", "t", "s1", [ids[t] for t in true_tags], [ids[t] for t in pred_tags])],
                               "task_lang string, transfer_lang string, id string, labels array<int>, pred_tags array<int>")
    return ner_grid(df, ["task_lang", "transfer_lang"], L.WIKIANN_LABELS).first()


def test_ner_lenient_chunks(spark):
    assert _ner(spark, ["B-PER", "I-PER", "O", "B-LOC"], ["B-PER", "I-PER", "O", "I-LOC"])["f1_score"] == 1.0
    assert _ner(spark, ["B-PER", "I-PER"], ["B-PER", "I-LOC"])["f1_score"] == 0.0
    assert _ner(spark, ["O", "O"], ["O", "O"])["f1_score"] == 0.0


def test_entity_ids(spark):
    df = spark.createDataFrame([([1, 2, 0, 6, 6, 3, 2],)], "a array<int>")
    got = with_entities(df, "a", "e", L.WIKIANN_LABELS).first()["e"]
    assert [(e["type"], e["start"], e["end"]) for e in got] == [(1, 0, 1), (3, 3, 4), (2, 5, 5), (1, 6, 6)]


def test_tag_multiset_f1(spark):
    df = spark.createDataFrame([("B-PER I-PER", "B-PER B-PER")], "g string, p string")
    df = df.select("g", "p", TX.ws_tokens("g").alias("gt"), TX.ws_tokens("p").alias("pt"))
    em, f1 = tag_string_scores(F.col("g"), F.col("p"), F.col("gt"), F.col("pt"))
    r = df.select(em.alias("em"), f1.alias("f1")).first()
    assert (r["em"], r["f1"]) == (0, 0.5)


def test_windows_and_span(spark):
    # n=400 context tokens, capacity 350, overlap 128 -> [0,350), [222,400)
    question = " ".join(["q"] * (384 - 4 - 350))
    context = " ".join(["w"] * 400)
    ex = spark.createDataFrame([("e1", question, context, ([], []))],
                               "id string, question string, context string, answers struct<text:array<string>,answer_start:array<int>>")
    w = D.qa_windows(ex).orderBy("feature_idx").collect()
    assert [(r["tok_start"], r["tok_end"]) for r in w] == [(0, 350), (222, 400)]
    # offsets (0,3)(4,7)(8,11), context start 5: answer [4,11) -> (6, 7); [4,14) -> (0, 0)
    q = " ".join(["q"] * 2)
    for text, start, expect in (("abcd", 4, (6, 7)), ("abcdefghij", 4, (0, 0))):
        ex = spark.createDataFrame([("e", q, "abc def ghi", ([text[:7]] if expect != (0, 0) else [text], [start]))],
                                   "id string, question string, context string, answers struct<text:array<string>,answer_start:array<int>>")
        r = D.qa_windows(ex).first()
        assert (r["start_position"], r["end_position"]) == expect


def test_align_labels(spark):
    df = spark.createDataFrame([([None, 0, 0, 1, None], [3, 4])], "w array<int>, l array<int>")
    assert df.select(D.align_labels(F.col("w"), F.col("l")).alias("a")).first()["a"] == [-100, 3, -100, 4, -100]


@pytest.mark.parametrize("size,max_copy", [(5, 2), (12, 1), (3, 4)])
def test_exact_n(spark, size, max_copy):
    df = spark.createDataFrame([("g", str(i)) for i in range(size)], "lang string, id string")
    s = sample_exact_n(df, ["lang"], "id", 10)
    assert s.count() == 10
    assert s.agg(F.max("copy")).first()[0] == max_copy


def test_early_stop_and_best(spark):
    runs = spark.createDataFrame([("r", i + 1, m) for i, m in enumerate([.5, .6, .6, .5, .4])], "run string, step int, metric double")
    stops = early_stop(runs, patience=3)
    assert stops.first()["stop_step"] == 5
    best = best_checkpoint(runs, stops)
    assert best.first()["best_step"] == 2
    kept = sorted(r["step"] for r in retain_checkpoints(runs, stops, best).collect())
    assert kept == [2, 5]


def test_label_encoders(spark):
    df = spark.createDataFrame([("nope",)], "c string")
    assert df.select(L.encode_or_null("c", L.TAXI_LABELS)).first()[0] is None
    assert df.select(L.encode_or_default("c", L.UPOS_LABELS, "X")).first()[0] == 16
    with pytest.raises(Exception):
        df.select(L.encode_strict("c", L.SIB_LABELS)).collect()


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "x array<double>")
    assert df.select(argmax("x")).first()[0] == 1


def test_cap_per_group(spark):
    from babelgrid.operators.sampling import cap_per_group
    df = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(40)], "lang string, k int")
    got = sorted((r["lang"], r["k"]) for r in cap_per_group(df, ["lang"], ["k"], 5).collect())
    want = sorted([("a", k) for k in range(40) if k % 3][:5] + [("b", k) for k in range(40) if k % 3 == 0][:5])
    assert got == want
