"""QA metric queries (F1 join, G4, H9-H12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.text import first_answer
from ..session import materialize
from ..operators.gridcheck import grid_issues
from ..operators.qa import em_f1_fraction_grid, last_prediction, squad_grid
from .q_text import _normalize_sql
from .registry import register
from .sqlfx import with_fx

CELL = ["task_lang", "transfer_lang"]
KEY = ["task", "transfer_lang", "task_lang", "id"]

_FINAL = """
, fin AS (SELECT task, transfer_lang, task_lang, id, arg_max(pred_text, seq) AS pred_text FROM fx_qapred GROUP BY ALL)"""


def _score_sql(pairs: str) -> str:
    """EM / token F1 for rows ``k, task_lang, transfer_lang, id, pred_text, gold`` (CTE ``{pairs}``)."""
    return f"""
, np AS (SELECT k, task_lang, transfer_lang, id, {_normalize_sql('pred_text')} AS pn, {_normalize_sql('gold')} AS gn FROM {pairs}),
ptok AS (SELECT k, tok, count(*) AS c FROM (SELECT k, unnest(string_split(pn, ' ')) AS tok FROM np WHERE pn <> '') GROUP BY ALL),
gtok AS (SELECT k, tok, count(*) AS c FROM (SELECT k, unnest(string_split(gn, ' ')) AS tok FROM np WHERE gn <> '') GROUP BY ALL),
common AS (SELECT k, sum(least(p.c, g.c)) AS common FROM ptok p JOIN gtok g USING (k, tok) GROUP BY k),
sc AS (SELECT np.task_lang, np.transfer_lang, np.id, CASE WHEN pn = gn THEN 1 ELSE 0 END AS em,
              CASE WHEN coalesce(c.common, 0) = 0 THEN 0.0
                   ELSE 2 * (c.common / len(string_split(pn, ' '))) * (c.common / len(string_split(gn, ' ')))
                        / ((c.common / len(string_split(pn, ' '))) + (c.common / len(string_split(gn, ' ')))) END AS f1
       FROM np LEFT JOIN common c USING (k))"""


@register("last_prediction", with_fx(_FINAL + "\nSELECT transfer_lang, id, pred_text FROM fin", "fx_qapred"))
def last_prediction_q(spark, sf_dir):
    p = fx.fx_qapred(spark, sf_dir)
    return last_prediction(p, KEY).select("transfer_lang", "id", "pred_text")


SQUAD_SQL = with_fx(_FINAL + """,
refs AS (SELECT q.task, q.lang AS task_lang, q.id, t.transfer_lang,
                CASE WHEN len(q.answers.text) > 0 THEN q.answers.text ELSE [''] END AS golds
         FROM fx_qa q JOIN fx_qa_langs t ON q.task = t.task),
pairs AS (SELECT row_number() OVER () AS k, * FROM (
            SELECT r.task_lang, r.transfer_lang, r.id, coalesce(f.pred_text, '') AS pred_text, unnest(r.golds) AS gold
            FROM refs r LEFT JOIN fin f ON f.task = r.task AND f.transfer_lang = r.transfer_lang AND f.task_lang = r.task_lang AND f.id = r.id))"""
                 + _score_sql("pairs") + """,
best AS (SELECT task_lang, transfer_lang, id, max(em) AS em, max(f1) AS f1 FROM sc GROUP BY ALL)
SELECT task_lang, transfer_lang, round(100.0 * avg(em), 6) AS exact_match, round(100.0 * avg(f1), 6) AS f1_score
FROM best GROUP BY ALL""", "fx_qapred", "fx_qa_langs")


def _qa(spark, sf_dir):
    """QA examples, materialised once: the plan reads them for references,
    predictions and the language dimension; none of them needs the context."""
    return materialize(fx.fx_qa(spark, sf_dir).drop("context"), "fx_qa")


@register("qa_squad_grid", SQUAD_SQL)
def qa_squad_grid(spark, sf_dir):
    qa = _qa(spark, sf_dir)
    fin = last_prediction(fx.fx_qapred(spark, sf_dir, qa), KEY)
    return squad_grid(qa.withColumnRenamed("lang", "task_lang"), fin, CELL)


_FRAC = with_fx(_FINAL + """,
pairs AS (SELECT row_number() OVER () AS k, q.lang AS task_lang, t.transfer_lang, q.id,
                 coalesce(f.pred_text, '') AS pred_text, coalesce(q.answers.text[1], '') AS gold
          FROM fx_qa q JOIN fx_qa_langs t ON q.task = t.task
          LEFT JOIN fin f ON f.task = q.task AND f.transfer_lang = t.transfer_lang AND f.task_lang = q.lang AND f.id = q.id)"""
                + _score_sql("pairs") + """
SELECT task_lang, transfer_lang, round(avg(em), 6) AS em_frac, round(avg(f1), 6) AS f1_frac FROM sc GROUP BY ALL""",
                "fx_qapred", "fx_qa_langs")


@register("qa_em_f1_frac", _FRAC)
def qa_em_f1_frac(spark, sf_dir):
    """Generative QA during training: one target (first answer or empty) per
    example, mean EM / F1 as fractions."""
    qa = _qa(spark, sf_dir)
    fin = last_prediction(fx.fx_qapred(spark, sf_dir, qa), KEY)
    langs = qa.select("task", F.col("lang").alias("transfer_lang")).distinct()
    rows = fx.with_transfer_languages(qa.select("task", F.col("lang").alias("task_lang"), "id", first_answer("answers").alias("gold")), langs)
    rows = rows.join(fin, KEY, "left").withColumn("pred_text", F.coalesce("pred_text", F.lit("")))
    return em_f1_fraction_grid(rows, CELL, "pred_text", "gold")


# --- Q1 / Q2 grid checks ----------------------------------------------------------------

@register("grid_check", with_fx(_FINAL + """,
refs AS (SELECT q.task, q.lang AS task_lang, q.id, t.transfer_lang,
                CASE WHEN len(q.answers.text) > 0 THEN q.answers.text ELSE [''] END AS golds
         FROM fx_qa q JOIN fx_qa_langs t ON q.task = t.task),
pairs AS (SELECT row_number() OVER () AS k, * FROM (
            SELECT r.task_lang, r.transfer_lang, r.id, coalesce(f.pred_text, '') AS pred_text, unnest(r.golds) AS gold
            FROM refs r LEFT JOIN fin f ON f.task = r.task AND f.transfer_lang = r.transfer_lang AND f.task_lang = r.task_lang AND f.id = r.id))"""
                 + _score_sql("pairs") + """,
best AS (SELECT task_lang, transfer_lang, id, max(em) AS em, max(f1) AS f1 FROM sc GROUP BY ALL),
pct AS (SELECT task_lang, transfer_lang, 100.0 * avg(em) AS em, 100.0 * avg(f1) AS f1 FROM best GROUP BY ALL),
frac AS (SELECT task_lang, transfer_lang || '_frac' AS transfer_lang, avg(em) AS em, avg(f1) AS f1
         FROM sc WHERE transfer_lang = 'en' GROUP BY ALL),
grid AS (SELECT * FROM pct UNION ALL SELECT * FROM frac),
per AS (SELECT transfer_lang, greatest(max(em), max(f1)) AS mx FROM grid GROUP BY ALL)
SELECT 'qa' AS task, transfer_lang, 'transfer_lang_not_a_task_lang' AS issue
FROM (SELECT DISTINCT transfer_lang FROM grid) WHERE transfer_lang NOT IN (SELECT task_lang FROM grid)
UNION ALL
SELECT 'qa', transfer_lang, 'fraction_scale_in_percent_grid' FROM per
WHERE mx <= 1.0 AND (SELECT max(mx) FROM per) > 1.0""", "fx_qapred", "fx_qa_langs"))
def grid_check(spark, sf_dir):
    """Q1 + Q2: the percent QA grid united with the fraction-scale grid of one
    transfer language under its own name, as in a published grid where one
    transfer language was stored as fractions; both issues are flagged."""
    qa = _qa(spark, sf_dir)
    fin = last_prediction(fx.fx_qapred(spark, sf_dir, qa), KEY)
    pct = squad_grid(qa.withColumnRenamed("lang", "task_lang"), fin, CELL)
    langs = qa.select("task", F.col("lang").alias("transfer_lang")).distinct()
    rows = fx.with_transfer_languages(qa.select("task", F.col("lang").alias("task_lang"), "id", first_answer("answers").alias("gold")), langs)
    rows = rows.join(fin, KEY, "left").withColumn("pred_text", F.coalesce("pred_text", F.lit("")))
    frac = em_f1_fraction_grid(rows.filter(F.col("transfer_lang") == "en"), CELL, "pred_text", "gold") \
        .select("task_lang", F.concat(F.col("transfer_lang"), F.lit("_frac")).alias("transfer_lang"),
                F.col("em_frac").alias("exact_match"), F.col("f1_frac").alias("f1_score"))
    grid = pct.unionByName(frac).select(F.lit("qa").alias("task"), F.lit("fixture").alias("model"), "*")
    return grid_issues(grid, ["exact_match", "f1_score"]).select("task", "transfer_lang", "issue")
