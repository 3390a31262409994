"""Operators against plain Python on inputs spread over partitions: ties,
repeated rows, hot groups, odd texts."""

import random

from pyspark.sql import functions as F

from babelgrid.functions.labels import MASAKHANER_LABELS
from babelgrid.operators.features import FIRST_WORD_ID, build_vocab
from babelgrid.operators.ner import generated_tags_grid, ner_grid, token_accuracy_grid
from babelgrid.operators.ranking import first_rows
from babelgrid.operators.sampling import sample_exact_n, seeded_shuffle
from babelgrid.session import scratch_path
from babelgrid.sources import io

NER = "task_lang string, transfer_lang string, id string, labels array<int>, pred_tags array<int>"
CELL = ["task_lang", "transfer_lang"]


def test_first_rows_over_partitions_and_ties(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 10 else "rare", rnd.randrange(30)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(16)
    got = first_rows(df, ["g"], [F.col("k")], 25, salts=4).collect()
    for g in ("hot", "rare"):
        mine = sorted((r["rank"], r["k"]) for r in got if r["g"] == g)
        assert [k for _, k in mine] == sorted(k for h, k in rows if h == g)[:25]
        assert [n for n, _ in mine] == list(range(1, 26))


def test_sample_is_exact_for_any_size(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 3), ("b", 10), ("c", 57)) for i in range(n)],
                               "g string, k int").repartition(7)
    got = sample_exact_n(df, ["g"], "k", 10).groupBy("g").agg(F.count("*").alias("n"), F.max("copy").alias("c"))
    assert {r["g"]: (r["n"], r["c"]) for r in got.collect()} == {"a": (10, 4), "b": (10, 1), "c": (10, 1)}


def test_seeded_shuffle_does_not_depend_on_its_buckets(spark):
    df = spark.createDataFrame([("g", i, 1) for i in range(500)], "g string, k int, copy int").repartition(5)
    few = {(r["k"], r["shuffle_rank"]) for r in seeded_shuffle(df, ["g"], "k").collect()}
    many = {(r["k"], r["shuffle_rank"]) for r in seeded_shuffle(df, ["g"], "k", rows_per_bucket=7).collect()}
    assert few == many and {n for _, n in few} == set(range(1, 501))


def test_vocabulary_ids_over_partitions(spark):
    rnd = random.Random(5)
    toks = [f"w{int(rnd.paretovariate(0.7)) % 3000}" for _ in range(6000)]
    df = spark.createDataFrame([(t,) for t in toks], "token string").repartition(9)
    got = {r["token"]: r["token_id"] for r in build_vocab(df).collect()}
    count = {t: toks.count(t) for t in set(toks)}
    order = sorted(count, key=lambda t: (-count[t], t))
    assert got == {t: FIRST_WORD_ID + i for i, t in enumerate(order)}
    assert build_vocab(df.limit(0)).count() == 0


def test_one_line_csv_keeps_every_text(spark):
    texts = ["plain", "a,b", 'say "hi"', "two\nlines\r\nmore", "back\\slash \\n \\b end\\", "\n", "  spaces ",
             "tab\there", '"', "it\\\n"]
    rows = [("de" if i % 2 else "en", "test", str(i), t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "lang string, split string, id string, text string, label long")
    path = io.write_lang_split_csv(df, scratch_path(spark, "csv-lines"))
    schema = df.select("id", "text", "label").schema
    back = io.read_one_line_csv(spark, path, schema).collect()
    assert {(r["lang"], r["id"], r["text"], r["label"]) for r in back} == {(a, c, d, e) for a, _, c, d, e in rows}


def test_discover_languages_lists_folders(spark):
    df = spark.createDataFrame([("t", lang, "test", "x") for lang in ("de", "zh hans", "a=b")],
                               "task string, lang string, split string, id string")
    path = io.land_partitioned(df, scratch_path(spark, "landed"))
    assert {r["lang"] for r in io.discover_languages(spark, path).collect()} == {"de", "zh hans", "a=b"}


def test_perfect_predictions_score_one_and_languages_permute(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(40):
        tags = [rnd.randrange(9) for _ in range(rnd.randrange(1, 30))]
        rows.append(("x" if i % 2 else "y", "z", str(i), tags, tags if i % 2 else [rnd.randrange(9) for _ in tags]))
    grid = {r["task_lang"]: r for r in ner_grid(spark.createDataFrame(rows, NER), CELL, MASAKHANER_LABELS).collect()}
    assert (grid["x"]["accuracy"], grid["x"]["f1_score"]) == (1.0, 1.0)
    swapped = [({"x": "y", "y": "x"}[a], *rest) for a, *rest in rows]
    other = {r["task_lang"]: r for r in ner_grid(spark.createDataFrame(swapped, NER), CELL, MASAKHANER_LABELS).collect()}
    assert (other["x"]["accuracy"], other["x"]["f1_score"]) == (grid["y"]["accuracy"], grid["y"]["f1_score"])


def test_token_accuracy_without_a_kept_token_is_null(spark):
    df = spark.createDataFrame([("x", "z", "1", [-100, -100], [1, 2]), ("y", "z", "2", [0, -100, 3], [0, 1, 4])], NER)
    got = {r["task_lang"]: r["accuracy"] for r in token_accuracy_grid(df, CELL).collect()}
    assert got == {"x": None, "y": 0.5}
    assert {r["task_lang"]: r["accuracy"] for r in ner_grid(df, CELL, MASAKHANER_LABELS).collect()} == got


def test_generated_tags_with_blanks_and_nulls(spark):
    df = spark.createDataFrame([("a", "B-PER I-PER", " B-PER I-PER\n"), ("b", "B-PER I-PER", "I-PER   B-PER"),
                                ("c", "None", ""), ("d", "B-LOC", None)], "c string, g string, p string")
    got = {r["c"]: (r["exact_match"], r["f1_score"]) for r in generated_tags_grid(df, ["c"], "g", "p").collect()}
    assert got == {"a": (1.0, 1.0), "b": (0.0, 1.0), "c": (0.0, 0.0), "d": (0.0, 0.0)}
