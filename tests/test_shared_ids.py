"""Ids shared by the languages of a parallel corpus, and logs with gaps."""

import random

import pytest

from babelgrid.operators import features as D
from babelgrid.operators.qa import last_prediction, squad_grid
from babelgrid.operators.runs import best_checkpoint, early_stop, retain_checkpoints
from babelgrid.sources import io

ANSWERS = "struct<text:array<string>,answer_start:array<int>>"


def test_squad_scores_each_language_by_its_own_prediction(spark):
    refs = spark.createDataFrame([("qa", "en", "q1", (["cat"], [0])), ("qa", "de", "q1", (["Hund"], [0]))],
                                 f"task string, task_lang string, id string, answers {ANSWERS}")
    preds = spark.createDataFrame([("qa", "en", "en", "q1", 0, "cat"), ("qa", "en", "de", "q1", 0, "Maus")],
                                  "task string, transfer_lang string, task_lang string, id string, seq int, pred_text string")
    last = last_prediction(preds, ["task", "transfer_lang", "task_lang", "id"])
    got = {r.task_lang: (r.exact_match, r.f1_score) for r in squad_grid(refs, last, ["task_lang", "transfer_lang"]).collect()}
    assert got == {"en": (100.0, 100.0), "de": (0.0, 0.0)}


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([("ab", 9, 4), ("cd", 5, 5), ("ef", 3, 6)], "token string, cnt long, token_id int")


def test_encoders_keep_languages_and_empty_texts_apart(spark, vocab):
    docs = spark.createDataFrame([("t", "en", "1", "ab cd"), ("t", "de", "1", "EF zz"), ("t", "de", "2", ""), ("t", "de", "3", None)],
                                 "task string, lang string, id string, text string")
    e = D.encode_single(docs, vocab, max_len=6)
    got = {(r.lang, r.id): (r.n_tokens, list(r.input_ids)) for r in e.collect()}
    assert got == {("en", "1"): (2, [1, 4, 5, 2, 0, 0]), ("de", "1"): (2, [1, 6, 3, 2, 0, 0]),
                   ("de", "2"): (0, [1, 2, 0, 0, 0, 0]), ("de", "3"): (0, [1, 2, 0, 0, 0, 0])}
    assert {(r.lang, r.id): r.text for r in D.decode_ids(e, vocab).collect()} == {
        ("en", "1"): "ab cd", ("de", "1"): "ef", ("de", "2"): "", ("de", "3"): ""}


def test_offsets_of_shared_ids_and_empty_contexts(spark):
    ex = spark.createDataFrame([("qa", "en", "q1", "who", "ab  cd", (["ab"], [0])), ("qa", "de", "q1", "wer", "xyz", ([], [])),
                                ("qa", "de", "q2", "was", "", ([], []))],
                               f"task string, lang string, id string, question string, context string, answers {ANSWERS}")
    got = {(r.lang, r.id): [tuple(o) for o in r.offsets if o] for r in D.qa_offsets(ex).collect()}
    assert got == {("en", "q1"): [(0, 2), (4, 6)], ("de", "q1"): [(0, 3)], ("de", "q2"): []}
    assert D.qa_windows(ex).count() == 3


def test_encoders_explode_tokens_once(spark, vocab):
    docs = spark.createDataFrame([("t", "en", "1", "ab")], "task string, lang string, id string, text string")
    plan = D.encode_single(docs, vocab)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") == 1 and plan.count("Exchange hashpartitioning(task") == 1


def stop_loop(log, patience, every):
    best, bad, last, best_step = None, 0, None, None
    for step, metric in sorted(log):
        if step % every:
            continue
        last = step
        if best is None or metric > best:
            best, bad, best_step = metric, 0, step
        else:
            bad += 1
            if bad >= patience:
                return step, 1, best_step
    return last, 0, best_step


def test_runs_with_gaps_against_a_loop(spark):
    rng = random.Random(4)
    logs = {f"r{n}": [(s, float(rng.randint(0, 9))) for s in sorted(rng.sample(range(1, 60), rng.randint(6, 40)))]
            for n in range(30)}
    logs["gap"] = [(1, 5.0), (10, 4.0), (11, 3.0)]
    df = spark.createDataFrame([(r, s, m) for r, log in logs.items() for s, m in log], "run string, step int, metric double")
    for every, patience in ((1, 3), (2, 2), (1, 5)):
        stops = early_stop(df, patience, every, block=4)
        best = {r.run: r.best_step for r in best_checkpoint(df, stops, every).collect()}
        got = {r.run: (r.stop_step, r.stopped, best[r.run]) for r in stops.collect()}
        want = {r: stop_loop(log, patience, every) for r, log in logs.items()}
        assert got == {r: w for r, w in want.items() if w[0] is not None}
    kept = retain_checkpoints(df, early_stop(df), keep=2).where("run = 'gap'").collect()
    assert sorted(r.step for r in kept) == [10, 11]


def test_csv_with_an_index_column_under_a_schema(spark, tmp_path):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType
    (tmp_path / "deu_test.csv").write_text(',text,classification\n0,"hello, you",2\n1,bye,\n')
    schema = StructType([StructField("text", StringType()), StructField("classification", IntegerType())])
    got = sorted((r.text, r.classification, r.lang, r.split) for r in io.read_lang_split_csv(spark, str(tmp_path), schema).collect())
    assert got == [("bye", None, "deu", "test"), ("hello, you", 2, "deu", "test")]


def test_runs_with_undefined_metrics(spark):
    """NaN and null improve nothing, over any cut into blocks."""
    nan = float("nan")
    logs = {"a": [0.1, nan, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95], "b": [nan, nan, nan, 0.2], "c": [None, None, None, None, None, 0.9],
            "d": [0.5, nan, None, 0.4, 0.6, 0.6, nan, 0.1, 0.2], "e": [nan], "f": [0.3, 0.2, 0.1]}
    rows = [(r, k + 1, m) for r, ms in logs.items() for k, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "run string, step int, metric double")
    for block in (2, 3, 4096):
        stops = early_stop(df, 3, block=block)
        got = {r.run: (r.stop_step, r.stopped) for r in stops.collect()}
        best = {r.run: (r.best_step, r.best_metric) for r in best_checkpoint(df, stops).collect()}
        want, tops = {}, {}
        for run, ms in logs.items():
            top, at, stop = None, 0, None
            for k, m in enumerate(ms, 1):
                if m is not None and m == m and (top is None or m > top):
                    top, at = m, k
                if k - at >= 3:
                    stop = k
                    break
            want[run] = (stop or len(ms), int(stop is not None))
            seen = [(m, -k) for k, m in enumerate(ms[:want[run][0]], 1) if m is not None and m == m]
            tops[run] = (-max(seen)[1], max(seen)[0]) if seen else (None, None)
        assert got == want and best == tops, block
    kept = retain_checkpoints(df, early_stop(df, 3), best_checkpoint(df), keep=2)
    assert {r.step for r in kept.where("run = 'e'").collect()} == {1}
