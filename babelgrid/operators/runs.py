"""Training control as table operators (inventory K2-K4).

``runs(run, step, metric)`` is an evaluation log.  A run's evaluations are
folded in blocks of steps, so that one long run is not one task: what a block
needs of the earlier ones (the best metric, when it was reached, how many
evaluations there were) is a running aggregate over one row per block.

A metric that is NaN or null is an evaluation that improves nothing: it counts
towards the patience and is never the best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# --- fixed values: defaults of the fine-tuning scripts ---------------------------
PATIENCE = 5
KEEP_CHECKPOINTS = 2
# -----------------------------------------------------------------------------------
BLOCK = 4096


def _number(metric: Column) -> Column:
    return F.when(~F.isnan(metric), metric.cast("double"))


def early_stop(runs: DataFrame, patience: int = PATIENCE, eval_every: int = 1, block: int = BLOCK) -> DataFrame:
    """K3: per run, the step at which training stops (or the last step).

    Steps at the cadence are evaluations, whatever gaps the log has.  An
    evaluation improves iff its metric is a number strictly greater than every
    earlier one; training stops at the first evaluation that is ``patience``
    evaluations after the last improvement (the start of the log, before any).
    """
    ev = runs.filter(F.pmod(F.col("step"), F.lit(eval_every)) == 0)
    ev = ev.withColumn("blk", F.floor(F.col("step") / F.lit(block * eval_every)))
    ev = ev.groupBy("run", "blk").agg(F.sort_array(F.collect_list(F.struct("step", _number(F.col("metric")).alias("m")))).alias("e"))
    ev = ev.select("run", "blk", "e", F.array_max("e.m").alias("top"))
    blocks = materialize(ev.select("*", F.size("e").alias("n"), F.array_position("e.m", F.col("top")).alias("at")), "run-blocks")

    earlier = Window.partitionBy("run").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    narrow = blocks.select("run", "blk", "top", "at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    reached = F.when(F.col("top").isNotNull(), F.struct("top", (-F.col("before") - F.col("at")).alias("neg_k")))
    carry = narrow.select("run", "blk", "before", F.max(reached).over(earlier).alias("best")).filter(F.col("before") > 0)

    d = blocks.join(carry, ["run", "blk"], "left").select(
        "run", "e", F.struct(F.col("best.top").alias("top"), F.coalesce(-F.col("best.neg_k"), F.lit(0)).cast("long").alias("at"),
                             F.coalesce("before", F.lit(0)).cast("long").alias("k"), F.lit(None).cast("long").alias("stop")).alias("start"))

    def fold(s: Column, x: Column) -> Column:
        better = x["m"].isNotNull() & (s["top"].isNull() | (x["m"] > s["top"]))
        k = s["k"] + 1
        at = F.when(better, k).otherwise(s["at"])
        return F.struct(F.when(better, x["m"]).otherwise(s["top"]).alias("top"), at.alias("at"), k.alias("k"),
                        F.coalesce(s["stop"], F.when(k - at >= patience, x["step"].cast("long"))).alias("stop"))

    d = d.select("run", F.aggregate("e", F.col("start"), fold)["stop"].alias("stop"), F.element_at("e", -1)["step"].alias("last"))
    g = d.groupBy("run").agg(F.min("stop").alias("stop"), F.max("last").alias("last"))
    return g.select("run", F.coalesce("stop", "last").alias("stop_step"), F.col("stop").isNotNull().cast("int").alias("stopped"))


def best_checkpoint(runs: DataFrame, stops: DataFrame | None = None, eval_every: int = 1) -> DataFrame:
    """K2: per run, the evaluated step with the highest metric (earliest on
    ties), among the steps up to the stop step when ``stops`` is given; null where
    a run has no number.

    A ``max`` over (metric, -step) structs: partial aggregation, no window.
    """
    r = runs.filter(F.pmod(F.col("step"), F.lit(eval_every)) == 0)
    if stops is not None:
        r = r.join(stops.select("run", "stop_step"), "run").filter(F.col("step") <= F.col("stop_step"))
    m = _number(F.col("metric"))
    g = r.groupBy("run").agg(F.max(F.when(m.isNotNull(), F.struct(m.alias("metric"), (-F.col("step")).alias("neg_step")))).alias("b"))
    return g.select("run", (-F.col("b.neg_step")).cast("int").alias("best_step"), F.col("b.metric").alias("best_metric"))


def retain_checkpoints(runs: DataFrame, stops: DataFrame, best: DataFrame | None = None, keep: int = KEEP_CHECKPOINTS,
                       eval_every: int = 1) -> DataFrame:
    """K4: checkpoints left on disk, one per evaluation: the best one plus the
    most recent others, ``keep`` in total (the best is never rotated out);
    without ``best`` the ``keep`` most recent ones."""
    r = runs.filter(F.pmod(F.col("step"), F.lit(eval_every)) == 0)
    r = r.join(stops.select("run", "stop_step"), "run").filter(F.col("step") <= F.col("stop_step"))
    r = r.withColumn("best_step", F.lit(None).cast("int")) if best is None else \
        r.join(best.select("run", "best_step"), "run", "left")
    others = r.filter(F.col("best_step").isNull() | (F.col("step") != F.col("best_step")))
    w = Window.partitionBy("run").orderBy(F.col("step").desc())
    n_others = F.when(F.col("best_step").isNull(), F.lit(keep)).otherwise(F.lit(keep - 1))
    kept = others.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= keep).filter(F.col("rk") <= n_others)
    bests = r.filter(F.col("step") == F.col("best_step"))
    return kept.select("run", "step").unionByName(bests.select("run", "step"))
