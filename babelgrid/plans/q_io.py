"""Source / sink, scoring, metric-registry and streaming queries
(A1-A11, I2, J5, J6, L1).  Each one writes into a fresh folder under the
session's checkpoint folder and reads the result back."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .. import fixtures as fx
from ..operators.classification import argmax, classification_grid
from ..operators import scoring
from ..operators.batched import map_batched
from ..operators.scoring import compute_metrics, linear_model, score
from ..session import materialize
from ..sources import io, landing
from ..streaming.grid_stream import run_once
from .q_qa import SQUAD_SQL, qa_squad_grid
from .registry import register
from .sqlfx import cls_metrics_sql, with_fx

CELL = ["task_lang", "transfer_lang"]
_PRED_SRC = "(SELECT task_lang, transfer_lang, label, pred FROM fx_pred)"
_GRID_SQL = f"SELECT task_lang, transfer_lang, accuracy, f1_score FROM {cls_metrics_sql(_PRED_SRC, CELL)}"


@register("land_partitioned", with_fx("SELECT id, label FROM fx_cls WHERE lang = 'de' AND split = 'test'", "fx_cls"))
def land_partitioned(spark, sf_dir):
    """A7 + A5 + A6: land examples partitioned by task/lang/split, read one
    language's test split back (partition pruning)."""
    path = io.land_partitioned(fx.fx_cls(spark, sf_dir), io.scratch_path(spark, "cls_examples"))
    return io.read_language(spark, path, lang="de", split="test").select("id", "label")


@register("discover_languages", with_fx("SELECT DISTINCT lang FROM fx_cls", "fx_cls"))
def discover_languages(spark, sf_dir):
    """Languages of a landed table, from its partition values."""
    rows = fx.fx_cls(spark, sf_dir).select("task", "lang", "split", "id")
    return io.discover_languages(spark, io.land_partitioned(rows, io.scratch_path(spark, "cls_examples")))


@register("land_partitioned_texts", with_fx("SELECT id, lang, split, label, md5(text) AS text_md5 FROM fx_cls", "fx_cls"))
def land_partitioned_texts(spark, sf_dir):
    """Every partition read back, texts by their hash."""
    path = io.land_partitioned(fx.fx_cls(spark, sf_dir), io.scratch_path(spark, "cls_examples"))
    return io.read_language(spark, path).select("id", "lang", "split", "label", F.md5("text").alias("text_md5"))


@register("lang_split_csv_texts", with_fx("SELECT id, lang, split, label, md5(text) AS text_md5 FROM fx_cls", "fx_cls"))
def lang_split_csv_texts(spark, sf_dir):
    """A3: one-line CSV written per language and split and read back whole,
    texts by their hash."""
    c = fx.fx_cls(spark, sf_dir).select("lang", "split", "id", "text", "label")
    path = io.write_lang_split_csv(c, io.scratch_path(spark, "cls_lines"))
    schema = StructType([StructField("id", StringType()), StructField("text", StringType()), StructField("label", LongType())])
    back = io.read_one_line_csv(spark, path, schema)
    return back.select("id", "lang", "split", F.col("label").cast("int").alias("label"), F.md5("text").alias("text_md5"))


_GRID_SCHEMA = StructType([StructField("task_lang", StringType()), StructField("accuracy", DoubleType()),
                           StructField("f1_score", DoubleType())])


@register("grid_roundtrip_csv", with_fx(_GRID_SQL, "fx_pred"))
def grid_roundtrip_csv(spark, sf_dir):
    """A9 + A1 + A2 + A3: one CSV per transfer language, read back by glob
    with the language taken from the folder name."""
    grid = classification_grid(fx.fx_pred(spark, sf_dir), CELL).select(*CELL, "accuracy", "f1_score")
    path = io.write_grid(grid, io.scratch_path(spark, "grid"))
    back = io.read_csv_folder(spark, path, _GRID_SCHEMA)
    back = back.withColumn("transfer_lang", F.regexp_extract("source_file", r"transfer_lang=([^/]+)/", 1))
    return back.select(*CELL, "accuracy", "f1_score")


@register("grid_union", f"""
SELECT 'cls' AS task, 'fixture' AS model, task_lang, transfer_lang, accuracy, CAST(NULL AS DOUBLE) AS exact_match, f1_score,
       'cls/transfer_lang=' || transfer_lang AS source_file
FROM ({with_fx(_GRID_SQL, 'fx_pred')})
UNION ALL
SELECT 'qa', 'fixture', task_lang, transfer_lang, CAST(NULL AS DOUBLE), exact_match, f1_score,
       'qa/transfer_lang=' || transfer_lang
FROM ({SQUAD_SQL})""")
def grid_union(spark, sf_dir):
    """I2 + A10: grids with different metric columns written as files, read
    back and unioned by name (missing metrics NULL) with the model and the file
    each row came from, one aggregated CSV."""
    model = F.lit(fx.MODEL).alias("model")
    cls = classification_grid(fx.fx_pred(spark, sf_dir), CELL).select(model, *CELL, "accuracy", "f1_score")
    base = io.scratch_path(spark, "grids")
    io.write_grid(cls, os.path.join(base, "cls"))
    io.write_grid(qa_squad_grid(spark, sf_dir).select(model, *CELL, "exact_match", "f1_score"), os.path.join(base, "qa"))
    parts = []
    for task, first in (("cls", "accuracy"), ("qa", "exact_match")):
        schema = StructType([StructField("model", StringType()), StructField("task_lang", StringType()),
                             StructField(first, DoubleType()), StructField("f1_score", DoubleType())])
        g = io.read_csv_folder(spark, os.path.join(base, task), schema)
        g = g.withColumn("transfer_lang", F.regexp_extract("source_file", r"transfer_lang=([^/]+)/", 1))
        g = g.withColumn("source_file", F.regexp_extract("source_file", r"([^/]+/transfer_lang=[^/]+)/", 1))
        parts.append(g.select(F.lit(task).alias("task"), "model", *CELL, first, "f1_score", "source_file"))
    u = io.union_grids(parts)
    agg_path = io.write_single_csv(u, os.path.join(base, "aggregated"))
    back = spark.read.option("header", True).schema(u.schema).csv(agg_path)
    return back.select("task", "model", *CELL, "accuracy", "exact_match", "f1_score", "source_file")


@register("lang_split_csv", with_fx("SELECT id, lang, split, label, md5(text) AS text_md5 FROM fx_cls", "fx_cls"))
def lang_split_csv(spark, sf_dir):
    """A3: free texts with quotes and line breaks in CSV files whose language
    and split come from the path, read back in ranges; every text by its hash."""
    c = fx.fx_cls(spark, sf_dir).select("lang", "split", "id", "text", "label")
    path = io.write_quoted_csv(c, io.scratch_path(spark, "cls_csv"), ("lang", "split"))
    schema = StructType([StructField("id", StringType()), StructField("text", StringType()), StructField("label", LongType())])
    back = io.read_lang_split_csv(spark, path, schema, io.LANG_SPLIT_DIRS)
    return back.select("id", "lang", "split", F.col("label").cast("int").alias("label"), F.md5("text").alias("text_md5"))


@register("land_incremental", with_fx("""
SELECT id, lang, split, md5(CASE WHEN lang = 'de' AND split = 'train' THEN text || '!' ELSE text END) AS text_md5,
       CAST(CASE WHEN lang = 'de' AND split = 'train' THEN 2 ELSE 1 END AS INTEGER) AS version
FROM fx_cls""", "fx_cls"))
def land_incremental(spark, sf_dir):
    """A7 + A9: a landing, then a rerun of one language of which one split has
    changed: that split alone is written anew, the version tells."""
    c = fx.fx_cls(spark, sf_dir)
    path = io.scratch_path(spark, "landed")
    landing.land(c, path)
    edited = F.when(F.col("split") == "train", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    landing.land(c.filter(F.col("lang") == "de").withColumn("text", edited), path)
    return landing.read_landed(spark, path).select("id", "lang", "split", F.md5("text").alias("text_md5"), "version")


@register("split_leakage", with_fx("""
SELECT lang, split, CAST(count(*) AS BIGINT) AS n_leaked
FROM fx_cls e WHERE split <> 'train' AND md5(text) IN (SELECT md5(text) FROM fx_cls WHERE split = 'train')
GROUP BY ALL""", "fx_cls"))
def split_leakage(spark, sf_dir):
    """Q7 check: evaluation rows whose exact text also occurs in training.
    The training side is reduced to distinct hashes before a semi join, so
    many copies of one text cannot blow the join up."""
    c = fx.fx_cls(spark, sf_dir).withColumn("h", F.md5("text"))
    train = c.filter(F.col("split") == "train").select("h").distinct()
    ev = c.filter(F.col("split") != "train")
    return ev.join(train, "h", "left_semi").groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n_leaked"))


# --- J5 / J6 ---------------------------------------------------------------------------

EMB_DIM, N_CLASSES = 64, 10


def _weights() -> np.ndarray:
    """Fixed scorer weights W[i, j] = ((7i + 13j) mod 17 - 8) / 8."""
    i = np.arange(EMB_DIM)[:, None]
    j = np.arange(N_CLASSES)[None, :]
    return ((7 * i + 13 * j) % 17 - 8) / 8.0


@register("score_batch", f"""
WITH e AS (SELECT vec_id, unnest(range({EMB_DIM})) AS i, unnest(embedding) AS x FROM embeddings),
w AS (SELECT i, j, ((7 * i + 13 * j) % 17 - 8) / 8.0 AS w FROM range({EMB_DIM}) a(i), range({N_CLASSES}) b(j)),
lg AS (SELECT e.vec_id, w.j, sum(CAST(e.x AS DOUBLE) * w.w) AS v FROM e JOIN w USING (i) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, j) AS rn FROM lg)
SELECT vec_id AS id, CAST(j AS INTEGER) AS pred, round(v, 4) AS top_logit FROM r WHERE rn = 1""")
def score_batch(spark, sf_dir):
    """Batch scoring with a linear model, Arrow batches, model built once
    per worker; argmax over the scores."""
    e = fx.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    s = score(e, "embedding", linear_model(_weights()), EMB_DIM)
    return s.select("id", argmax("logits").alias("pred"), F.round(F.array_max("logits"), 4).alias("top_logit"))


@register("metric_registry", with_fx(f"""
SELECT metric, task_lang, transfer_lang, value FROM (
  SELECT task_lang, transfer_lang, accuracy, f1_score, weighted_f1 FROM {cls_metrics_sql(_PRED_SRC, CELL)})
UNPIVOT (value FOR metric IN (accuracy AS 'accuracy', f1_score AS 'f1_macro', weighted_f1 AS 'f1_weighted'))""", "fx_pred"))
def metric_registry(spark, sf_dir):
    """Metrics looked up by name in the registry, long form."""
    return compute_metrics(fx.fx_pred(spark, sf_dir), CELL, ["accuracy", "f1_macro", "f1_weighted"]) \
        .select("metric", *CELL, "value")


@register("metric_sums", with_fx(f"""
SELECT metric, task_lang, transfer_lang, value FROM (
  SELECT task_lang, transfer_lang, f1_score,
         round(avg(CASE WHEN abs(label - pred) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS near, round(avg(abs(label - pred)::DOUBLE), 6) AS off
  FROM fx_pred JOIN (SELECT task_lang, transfer_lang, f1_score FROM {cls_metrics_sql(_PRED_SRC, CELL)}) USING (task_lang, transfer_lang)
  GROUP BY ALL)
UNPIVOT (value FOR metric IN (f1_score AS 'f1_macro', near AS 'near', off AS 'mean_distance'))""", "fx_pred"))
def metric_sums(spark, sf_dir):
    """Metrics of one's own, from sums over rows, beside one from counts per class, in one pass."""
    off = F.abs(F.col("label") - F.col("pred"))
    scoring.register_metric("near", scoring.Metric(lambda: F.sum("n_near") / F.sum("t"), {"n_near": (off <= 1).cast("int")}))
    scoring.register_metric("mean_distance", scoring.Metric(lambda: F.sum("distance") / F.sum("t"), {"distance": off}))
    return compute_metrics(fx.fx_pred(spark, sf_dir), CELL, ["near", "f1_macro", "mean_distance"])


# --- J1 ------------------------------------------------------------------------------


def _sentences(batch: dict[str, list]) -> dict[str, list]:
    """Texts to their lines that have a word, numbered: a row becomes several or none."""
    out: dict[str, list] = {"origin": [], "line": [], "n_words": [], "head": []}
    for k, text in enumerate(batch["text"]):
        for n, line in enumerate((text or "").split("\n")):
            words = [w for w in line.split(" ") if w]
            if words:
                out["origin"].append(k)
                out["line"].append(n)
                out["n_words"].append(len(words))
                out["head"].append(words[0])
    return out


@register("map_batched", """
SELECT doc_id, lang, CAST(i - 1 AS INTEGER) AS line, CAST(len(w) AS INTEGER) AS n_words, w[1] AS head
FROM (SELECT doc_id, lang, i, list_filter(string_split(t[i], ' '), lambda x: x <> '') AS w
      FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS t FROM documents)))
WHERE len(w) > 0""")
def map_batched_q(spark, sf_dir):
    """A batched Python function that changes the number of rows, keys carried along."""
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    returns = StructType([StructField("line", IntegerType()), StructField("n_words", IntegerType()), StructField("head", StringType())])
    return map_batched(docs, _sentences, returns, ["doc_id", "lang"])


# --- L1 ------------------------------------------------------------------------------------

_STREAM_SCHEMA = StructType([StructField("task", StringType()), StructField("model", StringType()),
                             StructField("task_lang", StringType()), StructField("accuracy", DoubleType()),
                             StructField("f1_score", DoubleType())])


@register("stream_grid", with_fx(_GRID_SQL, "fx_pred"))
def stream_grid(spark, sf_dir):
    """L1: result files streamed into a grid table in two rounds, the second
    rewriting every cell; last row per key wins."""
    cols = ["task", "model", "task_lang", "transfer_lang", "accuracy", "f1_score"]
    g = materialize(classification_grid(fx.fx_pred(spark, sf_dir), ["task", "model"] + CELL).select(*cols), "stream-grid")
    base = io.scratch_path(spark, "stream")
    src = os.path.join(base, "incoming")
    early = g.withColumn("accuracy", F.col("accuracy") / 2).withColumn("f1_score", F.lit(0.0))
    io.write_grid(early, os.path.join(src, "early"))
    run_once(spark, src, base, _STREAM_SCHEMA)
    io.write_grid(g, os.path.join(src, "late"))
    grid = run_once(spark, src, base, _STREAM_SCHEMA)
    return grid.select(*CELL, "accuracy", "f1_score")
