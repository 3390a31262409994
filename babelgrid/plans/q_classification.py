"""Classification queries: flagship transfer grid, metric grids, argmax."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators.classification import argmax, classification_grid, row_counts, string_classification_grid
from ..operators.transfer import transfer_grid
from .registry import register
from .sqlfx import cls_metrics_sql, strip, with_fx, words

CELL = ["task_lang", "transfer_lang"]

# --- K1 flagship ---------------------------------------------------------------

_NB_SQL = with_fx(f"""
, train_tok AS (SELECT lang AS transfer_lang, label, unnest({words('lower(text)')}) AS token FROM fx_cls WHERE split = 'train'),
vc AS (SELECT transfer_lang, token, label, count(*) AS n FROM train_tok GROUP BY ALL),
vsize AS (SELECT transfer_lang, count(DISTINCT token) AS v FROM train_tok GROUP BY ALL),
tot AS (SELECT transfer_lang, label, count(*) AS tot FROM train_tok GROUP BY ALL),
docs AS (SELECT lang AS transfer_lang, label, count(*) AS nd FROM fx_cls WHERE split = 'train' GROUP BY ALL),
ndocs AS (SELECT transfer_lang, sum(nd) AS s FROM docs GROUP BY ALL),
model AS (SELECT d.transfer_lang, d.label, ln(d.nd / n.s) AS lp, ln(coalesce(t.tot, 0) + z.v) AS lden
          FROM docs d JOIN ndocs n USING (transfer_lang) JOIN vsize z USING (transfer_lang)
          LEFT JOIN tot t USING (transfer_lang, label)),
test_docs AS (SELECT id, lang, label AS truth, text FROM fx_cls WHERE split = 'test'),
test_tok AS (SELECT id, token, count(*) AS tf
             FROM (SELECT id, unnest({words('lower(text)')}) AS token FROM test_docs) GROUP BY ALL),
vocab AS (SELECT DISTINCT transfer_lang, token FROM vc),
nv AS (SELECT t.id, v.transfer_lang, sum(t.tf) AS nv FROM test_tok t JOIN vocab v USING (token) GROUP BY ALL),
av AS (SELECT t.id, c.transfer_lang, c.label, sum(t.tf * ln(c.n + 1)) AS a FROM test_tok t JOIN vc c USING (token) GROUP BY ALL),
scores AS (SELECT d.id, d.lang AS task_lang, d.truth, m.transfer_lang, m.label AS cls,
                  m.lp + coalesce(a.a, 0) - coalesce(n.nv, 0) * m.lden AS score
           FROM test_docs d CROSS JOIN model m
           LEFT JOIN av a ON a.id = d.id AND a.transfer_lang = m.transfer_lang AND a.label = m.label
           LEFT JOIN nv n ON n.id = d.id AND n.transfer_lang = m.transfer_lang),
pred AS (SELECT task_lang, transfer_lang, truth AS label, cls AS pred
         FROM (SELECT *, row_number() OVER (PARTITION BY id, transfer_lang ORDER BY score DESC, cls) AS rn FROM scores)
         WHERE rn = 1)
SELECT task_lang, transfer_lang, accuracy, f1_score FROM {cls_metrics_sql('pred', CELL)}
""", "fx_cls")


@register("transfer_grid_nb", _NB_SQL)
def transfer_grid_nb(spark, sf_dir):
    return transfer_grid(fx.fx_cls(spark, sf_dir), num_classes=4)


# --- H1-H3 metric grids over synthetic predictions ----------------------------

def _pred_grid(spark, sf_dir):
    return classification_grid(fx.fx_pred(spark, sf_dir), CELL)


_PRED_SRC = "(SELECT task_lang, transfer_lang, label, pred FROM fx_pred)"


@register("cls_accuracy_grid", with_fx(f"SELECT task_lang, transfer_lang, accuracy, n FROM {cls_metrics_sql(_PRED_SRC, CELL)}", "fx_pred"))
def cls_accuracy_grid(spark, sf_dir):
    return _pred_grid(spark, sf_dir).select(*CELL, "accuracy", "n")


@register("cls_macro_f1_grid", with_fx(f"SELECT task_lang, transfer_lang, f1_score FROM {cls_metrics_sql(_PRED_SRC, CELL)}", "fx_pred"))
def cls_macro_f1_grid(spark, sf_dir):
    return _pred_grid(spark, sf_dir).select(*CELL, "f1_score")


@register("cls_weighted_f1_grid", with_fx(f"SELECT task_lang, transfer_lang, accuracy, weighted_f1 FROM {cls_metrics_sql(_PRED_SRC, CELL)}", "fx_pred"))
def cls_weighted_f1_grid(spark, sf_dir):
    return _pred_grid(spark, sf_dir).select(*CELL, "accuracy", "weighted_f1")


# --- H4: generated strings ------------------------------------------------------

# fixed values of the string-prediction fixture
_NAMES = ["low", "mid", "high", "top"]
_GARBAGE = "garbage "

_STR_SRC = f"""(SELECT task_lang, transfer_lang,
        {strip("' ' || " + str(_NAMES) + "[label + 1] || chr(10)")} AS t,
        {strip("CASE WHEN substr(md5(transfer_lang || '#' || id), 1, 1) = 'f' THEN '" + _GARBAGE + "' ELSE '  ' || " + str(_NAMES) + "[pred + 1] END")} AS p
    FROM fx_pred)"""


@register("cls_string_f1_grid", with_fx(f"SELECT task_lang, transfer_lang, accuracy, f1_score FROM {cls_metrics_sql(_STR_SRC, CELL, 't', 'p')}", "fx_pred"))
def cls_string_f1_grid(spark, sf_dir):
    p = fx.fx_pred(spark, sf_dir)
    names = F.array(*[F.lit(x) for x in _NAMES])
    p = p.select(*CELL,
                 F.concat(F.lit(" "), F.element_at(names, F.col("label") + 1), F.lit("\n")).alias("truth_text"),
                 F.when(F.substring(F.md5(F.concat("transfer_lang", F.lit("#"), "id")), 1, 1) == "f", F.lit(_GARBAGE))
                 .otherwise(F.concat(F.lit("  "), F.element_at(names, F.col("pred") + 1))).alias("pred_text"))
    return string_classification_grid(p, CELL, "truth_text", "pred_text").select(*CELL, "accuracy", "f1_score")


# --- G2 argmax ----------------------------------------------------------------

@register("logit_argmax", with_fx("""
SELECT id, label, pred, CAST(label = pred AS INTEGER) AS correct
FROM (SELECT id, label, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM fx_logits)""", "fx_logits"))
def logit_argmax(spark, sf_dir):
    lg = fx.fx_logits(spark, sf_dir)
    return lg.select("id", "label", argmax("logits").alias("pred")) \
        .withColumn("correct", (F.col("label") == F.col("pred")).cast("int"))


# --- H15 row counts -------------------------------------------------------------

@register("row_counts", with_fx("SELECT lang, split, CAST(count(*) AS BIGINT) AS n FROM fx_cls GROUP BY ALL", "fx_cls"))
def row_counts_q(spark, sf_dir):
    return row_counts(fx.fx_cls(spark, sf_dir), ["lang", "split"])
