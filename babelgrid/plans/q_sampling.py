"""Sampling (E1-E4) and training-control (K2-K4) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators.runs import KEEP_CHECKPOINTS, PATIENCE, best_checkpoint, early_stop, retain_checkpoints
from ..operators.sampling import SEED, sample_exact_n, seeded_shuffle
from ..session import materialize
from .registry import register
from .sqlfx import with_fx

NUM_SAMPLES = 10000   # fixed value: exact training-set size of the POS script


def _sample_sql(n: int) -> str:
    return f"""
, r AS (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY md5('{SEED}:' || id), id) AS rk,
               count(*) OVER (PARTITION BY lang) AS sz FROM fx_cls WHERE split = 'train'),
c AS (SELECT lang, id, rk, CASE WHEN sz >= {n} THEN CASE WHEN rk <= {n} THEN 1 ELSE 0 END
                               ELSE {n} // sz + CASE WHEN rk <= {n} % sz THEN 1 ELSE 0 END END AS copies FROM r),
s AS (SELECT lang, id, rk, unnest(range(1, copies + 1)) AS copy FROM c WHERE copies > 0)"""


def _sampled(spark, sf_dir, n):
    t = fx.fx_cls(spark, sf_dir).filter(F.col("split") == "train").select("lang", "id")
    return sample_exact_n(t, ["lang"], "id", n)


@register("sample_exact_n", with_fx(_sample_sql(NUM_SAMPLES) + """
SELECT lang, id, CAST(copy AS INTEGER) AS copy FROM s""", "fx_cls"))
def sample_exact_n_q(spark, sf_dir):
    """Exactly 10,000 training rows per language (up- or down-sampled)."""
    return _sampled(spark, sf_dir, NUM_SAMPLES).select("lang", "id", F.col("copy").cast("int"))


@register("sample_counts", with_fx(_sample_sql(100) + """
SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT id) AS BIGINT) AS n_ids, CAST(max(copy) AS INTEGER) AS max_copy
FROM s GROUP BY lang""", "fx_cls"))
def sample_counts(spark, sf_dir):
    """E1/E2 with n = 100: the large language is down-sampled, the small ones
    up-sampled; per language rows, distinct ids and largest copy number."""
    s = _sampled(spark, sf_dir, 100)
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"),
                                 F.max("copy").cast("int").alias("max_copy"))


@register("union_repeats", with_fx("""
SELECT task, lang, split, id, label, CAST(text IS NOT NULL AS INTEGER) AS has_text, CAST(premise IS NOT NULL AS INTEGER) AS has_premise
FROM (SELECT task, lang, split, id, label, text, NULL AS premise FROM fx_cls
      UNION ALL SELECT task, lang, split, id, label, NULL AS text, premise FROM fx_pair)""", "fx_cls", "fx_pair"))
def union_repeats(spark, sf_dir):
    """Union-all of example tables by column name; a column missing
    on one side is NULL there."""
    c = fx.fx_cls(spark, sf_dir).drop("doc_id")
    p = fx.fx_pair(spark, sf_dir).drop("hypothesis")
    u = c.unionByName(p, allowMissingColumns=True)
    return u.select("task", "lang", "split", "id", "label", F.col("text").isNotNull().cast("int").alias("has_text"),
                    F.col("premise").isNotNull().cast("int").alias("has_premise"))


@register("seeded_shuffle", with_fx(_sample_sql(NUM_SAMPLES) + f"""
, k AS (SELECT lang, id, copy, md5('{SEED}:' || id || ':' || CAST(copy AS VARCHAR)) AS shuffle_key FROM s)
SELECT lang, id, CAST(copy AS INTEGER) AS copy, shuffle_key,
       row_number() OVER (PARTITION BY lang ORDER BY shuffle_key, id, copy) AS shuffle_rank FROM k""", "fx_cls"))
def seeded_shuffle_q(spark, sf_dir):
    """Seeded order of the sampled rows within each language."""
    s = _sampled(spark, sf_dir, NUM_SAMPLES).select("lang", "id", F.col("copy").cast("int"))
    return seeded_shuffle(s, ["lang"], "id").select("lang", "id", "copy", "shuffle_key", "shuffle_rank")


# --- K2-K4 ---------------------------------------------------------------------------

def _runs_sql(source: str = "fx_runs") -> str:
    return f"""
, nums AS (SELECT run, step, CASE WHEN NOT isnan(metric) THEN metric END AS metric FROM {source}),
ev AS (SELECT run, step, metric, row_number() OVER (PARTITION BY run ORDER BY step) AS k,
                max(metric) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
         FROM nums),
ev2 AS (SELECT *, coalesce(max(CASE WHEN metric IS NOT NULL AND (best_before IS NULL OR metric > best_before) THEN k END)
                  OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING), 0) AS last_improved FROM ev),
stops AS (SELECT run, coalesce(min(step) FILTER (WHERE k - last_improved >= {PATIENCE}), max(step)) AS stop_step,
                 CAST(min(step) FILTER (WHERE k - last_improved >= {PATIENCE}) IS NOT NULL AS INTEGER) AS stopped
          FROM ev2 GROUP BY run),
best AS (SELECT run, CASE WHEN metric IS NOT NULL THEN step END AS best_step, metric AS best_metric FROM (
           SELECT r.*, row_number() OVER (PARTITION BY r.run ORDER BY r.metric DESC NULLS LAST, r.step) AS rn
           FROM nums r JOIN stops s USING (run) WHERE r.step <= s.stop_step) WHERE rn = 1)"""


_RUNS_SQL = _runs_sql()


def _runs(spark, sf_dir):
    # the step-numbered evaluation log is read by several branches of each
    # plan (stop step, best step, retention): written once, read back
    r = materialize(fx.fx_runs(spark, sf_dir), "fx_runs")
    stops = early_stop(r)
    return r, stops, best_checkpoint(r, stops)


@register("early_stop", with_fx(_RUNS_SQL + """
SELECT run, CAST(stop_step AS INTEGER) AS stop_step, stopped FROM stops""", "fx_runs"))
def early_stop_q(spark, sf_dir):
    """K3: stop step per run (patience 5, every step evaluated)."""
    _, stops, _ = _runs(spark, sf_dir)
    return stops.select("run", F.col("stop_step").cast("int"), "stopped")


@register("best_checkpoint", with_fx(_RUNS_SQL + """
SELECT run, CAST(best_step AS INTEGER) AS best_step, best_metric FROM best""", "fx_runs"))
def best_checkpoint_q(spark, sf_dir):
    """K2: best step (highest metric, earliest on ties) up to the stop step."""
    _, _, best = _runs(spark, sf_dir)
    return best


@register("retain_checkpoints", with_fx(_RUNS_SQL + f"""
, r AS (SELECT f.run, f.step, b.best_step FROM fx_runs f JOIN stops s USING (run) LEFT JOIN best b USING (run) WHERE f.step <= s.stop_step),
o AS (SELECT run, step, best_step, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rk FROM r WHERE best_step IS NULL OR step <> best_step)
SELECT run, CAST(step AS INTEGER) AS step FROM o WHERE rk <= CASE WHEN best_step IS NULL THEN {KEEP_CHECKPOINTS} ELSE {KEEP_CHECKPOINTS - 1} END
UNION ALL SELECT run, CAST(step AS INTEGER) AS step FROM r WHERE step = best_step""", "fx_runs"))
def retain_checkpoints_q(spark, sf_dir):
    """K4: checkpoints kept with save_total_limit = 2 (best always kept)."""
    r, stops, best = _runs(spark, sf_dir)
    return retain_checkpoints(r, stops, best).select("run", F.col("step").cast("int"))


_UNDEFINED = """, undef AS (
SELECT run, step, CASE WHEN step % 11 = 3 OR step <= CAST(run AS BIGINT) % 4 THEN CAST('nan' AS DOUBLE)
                       WHEN step % 13 = 5 OR CAST(run AS BIGINT) % 10 = 7 THEN NULL ELSE metric END AS metric FROM fx_runs)"""


@register("early_stop_undefined", with_fx(_UNDEFINED + _runs_sql("undef") + """
SELECT run, CAST(stop_step AS INTEGER) AS stop_step, stopped, CAST(coalesce(best_step, 0) AS INTEGER) AS best_step, best_metric
FROM stops JOIN best USING (run)""", "fx_runs"))
def early_stop_undefined_q(spark, sf_dir):
    """K2 + K3: logs whose metrics are partly NaN or missing, some runs' all (best step 0)."""
    run, step = F.col("run").cast("long"), F.col("step")
    metric = (F.when((step % 11 == 3) | (step <= run % 4), F.lit(float("nan")))
              .when((step % 13 == 5) | (run % 10 == 7), F.lit(None)).otherwise(F.col("metric")))
    r = materialize(fx.fx_runs(spark, sf_dir).withColumn("metric", metric), "fx_runs")
    stops = early_stop(r)
    d = stops.join(best_checkpoint(r, stops), "run")
    return d.select("run", F.col("stop_step").cast("int").alias("stop_step"), "stopped", F.coalesce("best_step", F.lit(0)).alias("best_step"), "best_metric")


# a cadence, over logs with gaps: of every run the steps that 7 divides are missing
EVAL_EVERY, KEEP_RECENT = 3, 5
_GAPS = f", gaps AS (SELECT * FROM fx_runs WHERE step % 7 <> 0 AND step % {EVAL_EVERY} = 0)" + _runs_sql("gaps")


def _gap_runs(spark, sf_dir):
    r = materialize(fx.fx_runs(spark, sf_dir).filter(F.col("step") % 7 != 0), "fx_runs")
    return r, early_stop(r, eval_every=EVAL_EVERY)


@register("early_stop_cadence", with_fx(_GAPS + """
SELECT s.run, CAST(stop_step AS INTEGER) AS stop_step, stopped, CAST(best_step AS INTEGER) AS best_step
FROM stops s JOIN best b USING (run)""", "fx_runs"))
def early_stop_cadence_q(spark, sf_dir):
    """K2 + K3: every third step evaluated, patience counted in evaluations."""
    r, stops = _gap_runs(spark, sf_dir)
    best = best_checkpoint(r, stops, EVAL_EVERY)
    return stops.join(best, "run").select("run", F.col("stop_step").cast("int"), "stopped", "best_step")


@register("retain_recent", with_fx(_GAPS + f"""
, o AS (SELECT g.run, g.step, row_number() OVER (PARTITION BY g.run ORDER BY g.step DESC) AS rk
        FROM gaps g JOIN stops s USING (run) WHERE g.step <= s.stop_step)
SELECT run, CAST(step AS INTEGER) AS step FROM o WHERE rk <= {KEEP_RECENT}""", "fx_runs"))
def retain_recent_q(spark, sf_dir):
    """K4: the five most recent checkpoints, no best one."""
    r, stops = _gap_runs(spark, sf_dir)
    return retain_checkpoints(r, stops, keep=KEEP_RECENT, eval_every=EVAL_EVERY).select("run", F.col("step").cast("int"))
