"""Question-answering metrics (inventory C8, F1, G4, H9-H12).

Per-row scores are array expressions on the row itself (no shuffle); the
corpus metrics are one grouped average per grid cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixtures import with_transfer_languages
from ..functions.text import normalize_answer, ws_tokens


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def multiset_overlap(p: Column, g: Column) -> Column:
    """Size of the multiset intersection of two token arrays (``Counter & Counter``).

    Both are sorted together and folded once, counting each side of a run of
    equal tokens: linear after the sort, whatever the number of distinct tokens."""
    sides = F.array_sort(F.concat(F.transform(p, lambda x: F.struct(x.alias("t"), F.lit(0).alias("side"))),
                                  F.transform(g, lambda x: F.struct(x.alias("t"), F.lit(1).alias("side")))))
    # a null of the tokens' type, whatever it is
    start = F.struct(F.when(F.lit(False), F.get(sides, 0)["t"]).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("common"))

    def step(s: Column, x: Column) -> Column:
        same = s["t"] == x["t"]
        left = F.when(same, s["p"]).otherwise(0)
        # a token of ``g`` uses up one of ``p``, which stand before it
        met = same & (x["side"] == 1) & (s["p"] > 0)
        return F.struct(x["t"].alias("t"), F.when(x["side"] == 0, left + 1).when(met, left - 1).otherwise(left).alias("p"),
                        (s["common"] + F.when(met, 1).otherwise(0)).alias("common"))

    return F.aggregate(sides, start, step)["common"]


def token_f1(p: Column, g: Column) -> Column:
    """Bag-of-token F1 of two token arrays; 0 when nothing overlaps."""
    # one-element array: the overlap is computed once, not in every branch
    return F.transform(F.array(multiset_overlap(p, g)), lambda common: _f1(common, p, g))[0]


def _f1(common: Column, p: Column, g: Column) -> Column:
    prec = common / F.size(p)
    rec = common / F.size(g)
    return F.when(common == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))


def exact_match(pred, gold) -> Column:
    """H9: normalised strings are equal (1 / 0)."""
    return (normalize_answer(_c(pred)) == normalize_answer(_c(gold))).cast("int")


def answer_f1(pred, gold) -> Column:
    return token_f1(ws_tokens(normalize_answer(_c(pred))), ws_tokens(normalize_answer(_c(gold))))


def last_prediction(preds: DataFrame, keys: list[str], seq: str = "seq", value: str = "pred_text") -> DataFrame:
    """The prediction with the highest ``seq`` per key (last one wins).

    ``max_by`` is a plain aggregate, so partial aggregation runs before the
    shuffle even when one key has many rows.
    """
    return preds.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def squad_grid(refs: DataFrame, preds: DataFrame, cell_keys: list[str], digits: int = 6) -> DataFrame:
    """H12 (+F1 join): corpus EM / F1 in percent, best over the gold answers.

    ``refs``: task, task_lang, id, answers (text array).  ``preds``: task,
    transfer_lang, task_lang, id, pred_text (one row per id; see
    ``last_prediction``).  Every reference is scored once per transfer language
    of its task; a missing prediction counts as the empty string.  An example
    without any gold answer is scored against the empty answer.
    """
    langs = preds.select("task", "transfer_lang").distinct()
    r = with_transfer_languages(refs.select("task", "task_lang", "id", F.col("answers.text").alias("golds")), langs)
    # ids may be shared by the languages of a parallel corpus: the task language is part of the key
    keys = ["task", "transfer_lang", "task_lang", "id"]
    j = r.join(preds.select(*keys, "pred_text"), keys, "left")
    j = j.select(*cell_keys, "id", F.coalesce("pred_text", F.lit("")).alias("pred_text"),
                 F.when(F.size("golds") > 0, F.col("golds")).otherwise(F.array(F.lit(""))).alias("golds"))
    # one row per (cell, id, gold answer); normalised token arrays are columns
    # before the overlap lambdas read them
    j = j.select(*cell_keys, "id", normalize_answer(F.col("pred_text")).alias("pn"), F.explode("golds").alias("gold"))
    j = j.select(*cell_keys, "id", "pn", normalize_answer(F.col("gold")).alias("gn"))
    j = j.select(*cell_keys, "id", (F.col("pn") == F.col("gn")).cast("int").alias("em"),
                 ws_tokens("pn").alias("pt"), ws_tokens("gn").alias("gt"))
    j = j.select(*cell_keys, "id", "em", token_f1(F.col("pt"), F.col("gt")).alias("f1"))
    scored = j.groupBy(*cell_keys, "id").agg(F.max("em").alias("em"), F.max("f1").alias("f1"))
    g = scored.groupBy(*cell_keys).agg((100.0 * F.avg("em")).alias("exact_match"), (100.0 * F.avg("f1")).alias("f1_score"))
    return g.select(*cell_keys, F.round("exact_match", digits).alias("exact_match"), F.round("f1_score", digits).alias("f1_score"))


def em_f1_fraction_grid(rows: DataFrame, cell_keys: list[str], pred: str, gold: str, digits: int = 6) -> DataFrame:
    """Mean per-row EM and F1 as fractions (one gold string per row)."""
    s = rows.select(*cell_keys, normalize_answer(_c(pred)).alias("pn"), normalize_answer(_c(gold)).alias("gn"))
    s = s.select(*cell_keys, (F.col("pn") == F.col("gn")).cast("int").alias("em"), ws_tokens("pn").alias("pt"), ws_tokens("gn").alias("gt"))
    s = s.select(*cell_keys, "em", token_f1(F.col("pt"), F.col("gt")).alias("f1"))
    g = s.groupBy(*cell_keys).agg(F.avg("em").alias("em_frac"), F.avg("f1").alias("f1_frac"))
    return g.select(*cell_keys, F.round("em_frac", digits).alias("em_frac"), F.round("f1_frac", digits).alias("f1_frac"))
