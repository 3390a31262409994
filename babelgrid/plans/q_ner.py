"""Token-classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.labels import MASAKHANER_LABELS, WIKIANN_LABELS
from ..operators.classification import token_classification_grid
from ..operators.ner import (generated_tags_grid, gold_entities, ner_grid, ner_rows, tag_string_grid,
                             token_accuracy_grid, type_names, type_prf, with_entities)
from .registry import register
from .sqlfx import NER9_LABELS_SQL, NER_LABELS_SQL, cls_metrics_sql, with_fx

CELL = ["task_lang", "transfer_lang"]


def _ner_pred(spark, sf_dir):
    """Per-language predictions over the tagged sentences."""
    return fx.fx_ner_pred(spark, sf_dir)


def _ner_chunked(spark, sf_dir, labels=WIKIANN_LABELS):
    """The same with gold entities found once, before rows meet the transfer languages."""
    gold = gold_entities(fx.fx_ner_gold(spark, sf_dir, labels), labels)
    return fx.fx_ner_pred(spark, sf_dir, gold)


def _chunks_sql(src: str, part: str, order: str, name: str) -> str:
    """Entities of tag-name column ``name`` in ``src``, rows grouped by ``part``
    and ordered by ``order`` -> (part..., type, s, e)."""
    return f"""(
    SELECT {part}, any_value(substr({name}, 3)) AS type, min({order}) AS s, max({order}) AS e
    FROM (SELECT *, sum(st) OVER (PARTITION BY {part} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS chunk
          FROM (SELECT *, CASE WHEN {name} <> 'O' AND (left({name}, 1) = 'B' OR prv IS NULL OR prv = 'O'
                                                      OR substr(prv, 3) <> substr({name}, 3)) THEN 1 ELSE 0 END AS st
                FROM (SELECT *, lag({name}) OVER (PARTITION BY {part} ORDER BY {order}) AS prv FROM {src})))
    WHERE {name} <> 'O'
    GROUP BY {part}, chunk)"""


@register("ner_entities", with_fx(f"""
, named AS (SELECT id, pos, {NER_LABELS_SQL}[tag + 1] AS nm FROM fx_ner_tok)
SELECT id, type, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM {_chunks_sql('named', 'id', 'pos', 'nm')}""",
                                  "fx_ner_tok"))
def ner_entities(spark, sf_dir):
    """F4 input: gold entities (type, first token, last token) per sentence."""
    types = F.array(*[F.lit(t) for t in type_names(WIKIANN_LABELS)])
    n = with_entities(fx.fx_ner(spark, sf_dir).select("id", "tags"), "tags", "ents", WIKIANN_LABELS)
    n = n.select("id", F.inline_outer("ents")).filter(F.col("start").isNotNull())
    return n.select("id", F.element_at(types, F.col("type")).alias("type"), F.col("start").cast("int"), F.col("end").cast("int"))


_NER_BASE = f"""
, kept AS (SELECT transfer_lang, task_lang, id, label, pred,
                  row_number() OVER (PARTITION BY transfer_lang, id ORDER BY pos) - 1 AS kpos,
                  {NER_LABELS_SQL}[label + 1] AS tn, {NER_LABELS_SQL}[pred + 1] AS pn
           FROM fx_ner_pred_tok WHERE label <> -100),
te AS {_chunks_sql('kept', 'transfer_lang, task_lang, id', 'kpos', 'tn')},
pe AS {_chunks_sql('kept', 'transfer_lang, task_lang, id', 'kpos', 'pn')},
nt AS (SELECT task_lang, transfer_lang, type, count(*) AS n_true FROM te GROUP BY ALL),
npd AS (SELECT task_lang, transfer_lang, type, count(*) AS n_pred FROM pe GROUP BY ALL),
tp AS (SELECT te.task_lang, te.transfer_lang, te.type, count(*) AS tp FROM te JOIN pe
       ON te.transfer_lang = pe.transfer_lang AND te.id = pe.id AND te.type = pe.type AND te.s = pe.s AND te.e = pe.e GROUP BY ALL),
ty AS (SELECT task_lang, transfer_lang, type, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp
       FROM nt FULL JOIN npd USING (task_lang, transfer_lang, type) LEFT JOIN tp USING (task_lang, transfer_lang, type)),
prf AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
               CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END AS recall FROM ty),
prf1 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM prf),
acc AS (SELECT task_lang, transfer_lang, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM kept GROUP BY ALL)"""


@register("ner_type_prf", with_fx(_NER_BASE + """
SELECT task_lang, transfer_lang, type, CAST(n_true AS BIGINT) AS n_true, CAST(n_pred AS BIGINT) AS n_pred, CAST(tp AS BIGINT) AS tp,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf1""", "fx_ner_pred_tok"))
def ner_type_prf(spark, sf_dir):
    """H6: per entity type precision / recall / F1 (lenient IOB2 chunks, after
    dropping ignored positions)."""
    rows = ner_rows(_ner_chunked(spark, sf_dir), CELL, WIKIANN_LABELS)
    return type_prf(rows, CELL, WIKIANN_LABELS).withColumn("f1", F.round("f1", 6))


_MACRO = """
SELECT a.task_lang, a.transfer_lang, round(a.accuracy, 6) AS accuracy, round(coalesce(m.f1, 0.0), 6) AS f1_score
FROM acc a LEFT JOIN (SELECT task_lang, transfer_lang, avg(f1) AS f1 FROM prf1 GROUP BY ALL) m USING (task_lang, transfer_lang)"""


@register("ner_macro_grid", with_fx(_NER_BASE + _MACRO, "fx_ner_pred_tok"))
def ner_macro_grid(spark, sf_dir):
    """H7 + H8: the (task_lang, transfer_lang, accuracy, f1_score) NER grid."""
    return ner_grid(_ner_chunked(spark, sf_dir), CELL, WIKIANN_LABELS)


@register("ner_macro_grid_9", with_fx(_NER_BASE.replace(NER_LABELS_SQL, NER9_LABELS_SQL) + _MACRO, "fx_ner9_pred_tok")
          .replace("FROM fx_ner_pred_tok", "FROM fx_ner9_pred_tok"))
def ner_macro_grid_9(spark, sf_dir):
    """H7 + H8 with the nine-tag label set."""
    return ner_grid(_ner_chunked(spark, sf_dir, MASAKHANER_LABELS), CELL, MASAKHANER_LABELS)


@register("ner_token_accuracy", with_fx(_NER_BASE + """
SELECT task_lang, transfer_lang, round(accuracy, 6) AS accuracy FROM acc""", "fx_ner_pred_tok"))
def ner_token_accuracy(spark, sf_dir):
    return token_accuracy_grid(_ner_pred(spark, sf_dir), CELL)


_TAGSTR = with_fx(f"""
, strs AS (SELECT transfer_lang, task_lang, id,
                  coalesce(nullif(string_agg({NER_LABELS_SQL}[tag + 1], ' ' ORDER BY pos) FILTER (WHERE tag <> 0), ''), 'None') AS gold,
                  coalesce(nullif(string_agg({NER_LABELS_SQL}[pred + 1], ' ' ORDER BY pos) FILTER (WHERE pred <> 0), ''), 'None') AS pred
           FROM fx_ner_pred_tok GROUP BY ALL),
gt AS (SELECT transfer_lang, id, tok, count(*) AS c FROM (SELECT transfer_lang, id, unnest(string_split(gold, ' ')) AS tok FROM strs) GROUP BY ALL),
pt AS (SELECT transfer_lang, id, tok, count(*) AS c FROM (SELECT transfer_lang, id, unnest(string_split(pred, ' ')) AS tok FROM strs) GROUP BY ALL),
cm AS (SELECT transfer_lang, id, sum(least(g.c, p.c)) AS tp FROM gt g JOIN pt p USING (transfer_lang, id, tok) GROUP BY ALL),
sc AS (SELECT s.task_lang, s.transfer_lang, CASE WHEN s.gold = s.pred THEN 1 ELSE 0 END AS em,
              coalesce(c.tp, 0) / len(string_split(s.pred, ' ')) AS p, coalesce(c.tp, 0) / len(string_split(s.gold, ' ')) AS r
       FROM strs s LEFT JOIN cm c USING (transfer_lang, id))
SELECT task_lang, transfer_lang, round(avg(em), 6) AS exact_match,
       round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 6) AS f1_score
FROM sc GROUP BY ALL""", "fx_ner_pred_tok")


@register("tag_multiset_f1", _TAGSTR)
def tag_multiset_f1(spark, sf_dir):
    """H13 (+H14): generated tag strings scored by multiset F1 per row."""
    return tag_string_grid(_ner_pred(spark, sf_dir), CELL, WIKIANN_LABELS)


@register("tag_exact_match", _TAGSTR.replace("SELECT task_lang, transfer_lang, round(avg(em), 6) AS exact_match,\n       round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 6) AS f1_score",
                                              "SELECT task_lang, transfer_lang, round(avg(em), 6) AS exact_match"))
def tag_exact_match(spark, sf_dir):
    """Mean exact match of stripped generated strings."""
    return tag_string_grid(_ner_pred(spark, sf_dir), CELL, WIKIANN_LABELS).select(*CELL, "exact_match")


_GENERATED = with_fx(f"""
, strs AS (SELECT transfer_lang, task_lang, id, any_value(line) AS line,
                  coalesce(string_agg({NER_LABELS_SQL}[tag + 1], ' ' ORDER BY pos) FILTER (WHERE tag <> 0), 'None') AS gold,
                  string_agg({NER_LABELS_SQL}[pred + 1], '  ' ORDER BY pos) FILTER (WHERE pred <> 0) AS wide,
                  string_agg({NER_LABELS_SQL}[pred + 1], ' ' ORDER BY pos) FILTER (WHERE pred <> 0) AS narrow
           FROM fx_ner_pred_tok GROUP BY ALL),
gen AS (SELECT transfer_lang, task_lang, id, gold,
               CASE line % 4 WHEN 0 THEN narrow WHEN 1 THEN ' ' || coalesce(narrow, 'None') || chr(10)
                             WHEN 2 THEN chr(9) || wide ELSE '' END AS pred FROM strs),
s2 AS (SELECT *, list_filter(regexp_split_to_array(coalesce(pred, ''), '\\s+'), lambda x: x <> '') AS pt,
              string_split(gold, ' ') AS gt FROM gen),
gt AS (SELECT transfer_lang, id, tok, count(*) AS c FROM (SELECT transfer_lang, id, unnest(gt) AS tok FROM s2) GROUP BY ALL),
pt AS (SELECT transfer_lang, id, tok, count(*) AS c FROM (SELECT transfer_lang, id, unnest(pt) AS tok FROM s2) GROUP BY ALL),
cm AS (SELECT transfer_lang, id, sum(least(g.c, p.c)) AS tp FROM gt g JOIN pt p USING (transfer_lang, id, tok) GROUP BY ALL),
sc AS (SELECT s.task_lang, s.transfer_lang,
              CASE WHEN gold = regexp_replace(coalesce(pred, ''), '^\\s+|\\s+$', '', 'g') THEN 1 ELSE 0 END AS em,
              CASE WHEN len(pt) > 0 THEN coalesce(c.tp, 0) / len(pt) ELSE 0 END AS p, coalesce(c.tp, 0) / len(gt) AS r
       FROM s2 s LEFT JOIN cm c USING (transfer_lang, id))
SELECT task_lang, transfer_lang, round(avg(em), 6) AS exact_match,
       round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 6) AS f1_score
FROM sc GROUP BY ALL""", "fx_ner_pred_tok")


@register("generated_tags_grid", _GENERATED)
def generated_tags_query(spark, sf_dir):
    """H13 + H14 over decoded strings with blanks around and between the tags,
    empty and missing ones."""
    p = _ner_pred(spark, sf_dir).select(*CELL, "id", "tags", "pred_tags")
    names = F.array(*[F.lit(x) for x in WIKIANN_LABELS])
    none = F.lit(None).cast("string")

    def tags(arr):
        return F.transform(F.filter(arr, lambda x: x != 0), lambda x: F.get(names, x))

    p = p.select(*CELL, "id", tags("tags").alias("g"), tags("pred_tags").alias("p"))
    some = F.size("p") > 0
    narrow, wide = F.when(some, F.array_join("p", " ")), F.when(some, F.array_join("p", "  "))
    form = F.pmod(F.split_part("id", F.lit(":"), F.lit(2)).cast("int"), F.lit(4))
    pred = (F.when(form == 0, narrow)
            .when(form == 1, F.concat(F.lit(" "), F.coalesce(narrow, F.lit("None")), F.lit("\n")))
            .when(form == 2, F.coalesce(F.concat(F.lit("\t"), wide), none)).otherwise(F.lit("")))
    gold = F.when(F.size("g") > 0, F.array_join("g", " ")).otherwise(F.lit("None"))
    return generated_tags_grid(p.select(*CELL, gold.alias("gold"), pred.alias("pred")), CELL, "gold", "pred")


@register("pos_metrics_grid", with_fx(f"""
SELECT task_lang, transfer_lang, accuracy, f1_score
FROM {cls_metrics_sql('(SELECT task_lang, transfer_lang, label, pred FROM fx_pos_pred_tok WHERE label <> -100)', CELL)}""",
                                      "fx_pos_pred_tok"))
def pos_metrics_grid(spark, sf_dir):
    """H5: masked token accuracy and macro F1 over all kept tokens of a cell."""
    p = fx.fx_pos_pred(spark, sf_dir)
    return token_classification_grid(p, CELL, "preds", "labels").select(*CELL, "accuracy", "f1_score")
