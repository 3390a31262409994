"""Token-classification metrics (inventory B10, F4, H6-H8, H13, H14).

Entities are found per sentence (lenient IOB2 chunk rule), all sentences of an
Arrow batch at once, so no token-level shuffle is needed; predicted and true
entities are matched inside the row and only per-(cell, type) counts are
aggregated, with map-side partial aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..functions.arrays import count_true, firsts, ints, place_of, ragged, row_of, to_lists
from ..functions.labels import IGNORE_INDEX
from ..functions.text import strip, ws_tokens


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def type_names(labels: list[str]) -> list[str]:
    """Entity type names in label order; type index k is the k-th of them, 0 is ``O``."""
    types: list[str] = []
    for lab in labels:
        if lab != "O" and lab[2:] not in types:
            types.append(lab[2:])
    return types


def _codes(labels: list[str]) -> np.ndarray:
    """Per label id one integer: 2 * type index + (1 if ``B-``); ``O`` is 0.  The last stands for unknown ids."""
    types = type_names(labels)
    return np.array([0 if lab == "O" else 2 * (types.index(lab[2:]) + 1) + int(lab.startswith("B-")) for lab in labels]
                    + [-1], np.int16)


#: Digits of an entity's long: type below 2**8, end below 2**28, then the start.
_TYPE_SPAN, _END_SPAN = 1 << 8, 1 << 28


def entity(kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """An entity as one long that is equal for equal (type, start, end)."""
    return (start * _END_SPAN + end) * _TYPE_SPAN + kind


def entity_type(e: Column) -> Column:
    return e.bitwiseAND(F.lit(_TYPE_SPAN - 1))


def entity_start(e: Column) -> Column:
    return F.shiftright(e, 36)


def entity_end(e: Column) -> Column:
    return F.shiftright(e, 8).bitwiseAND(F.lit(_END_SPAN - 1))


def with_entities(df: DataFrame, ids: str, out: str, labels: list[str]) -> DataFrame:
    """H6 chunking of a label-id array column into ``out``:
    array<struct<type (index), start, end>>."""
    df = with_entity_codes(df, ids, out, labels)
    return df.withColumn(out, F.transform(out, lambda e: F.struct(
        entity_type(e).cast("int").alias("type"), entity_start(e).cast("int").alias("start"),
        entity_end(e).cast("int").alias("end"))))


def with_entity_codes(df: DataFrame, ids: str, out: str, labels: list[str]) -> DataFrame:
    """H6 chunking of a label-id array column into ``out``: one long per
    entity (see ``entity``), in order; the rule is that of ``_chunks``."""
    codes = _codes(labels)

    @F.arrow_udf("array<long>")
    def of(a: pa.Array) -> pa.Array:
        flat, offsets = ragged(a)
        kind, start, end, begins = _chunks(_code_of(ints(flat, -1), codes), offsets)
        found = pa.array(entity(kind, start, end), mask=(start < 0) | (end < 0))
        return to_lists(found, begins, a.is_null())
    return df.withColumn(out, of(ids))


def _code_of(ids: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return codes[np.where((ids >= 0) & (ids < len(codes) - 1), ids, -1)]


def _chunks(c: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entities of the sentences whose codes lie one after the other in ``c``:
    their types, first and last places, and where each sentence's begin.

    A token opens a chunk iff it is not ``O`` and (its prefix is ``B``, or it
    is the first token, or the previous token is ``O`` or of another type).
    A chunk ends at a non-``O`` token whose successor does not continue it;
    the k-th start pairs with the k-th end.  Whether a token opens a chunk is
    unknown beside an unknown label (-1), so a place may be missing (-1).
    """
    first = firsts(offsets)
    last, after, n = np.roll(first, -1), np.roll(c, -1), len(offsets) - 1
    prev = np.where(first, -2, np.roll(c, 1))
    word, known = c > 1, prev != -1
    opens = word & ((c & 1 == 1) | (known & (prev >> 1 != c >> 1)))
    # the next token doesn't continue the chunk: it opens one, or is known to be ``O``
    ends = word & (last | ((after != -1) & (np.roll(opens, -1) | (after <= 1))))
    s, e = np.flatnonzero(opens), np.flatnonzero(ends)
    of_s, of_e = row_of(offsets, s), row_of(offsets, e)
    ns, ne = np.bincount(of_s, minlength=n), np.bincount(of_e, minlength=n)
    begins = np.concatenate(([0], np.cumsum(np.maximum(ns, ne))))

    def placed(x: np.ndarray, row: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = np.full(begins[-1], -1)
        out[begins[row] + np.arange(len(x)) - (np.cumsum(count) - count)[row]] = x
        return out

    start, end = placed(s - offsets[of_s], of_s, ns), placed(e - offsets[of_e], of_e, ne)
    return placed(c[s] >> 1, of_s, ns), start, end, begins


def _kept(labels: Column) -> Column:
    return F.filter(labels, lambda x: x != F.lit(IGNORE_INDEX))


def _of_type(arr: str, k: int) -> Column:
    return F.size(F.filter(arr, lambda e: entity_type(e) == k))


def _counts_of(arr: str, n_types: int) -> Column:
    return F.array(*[_of_type(arr, k) for k in range(1, n_types + 1)])


def gold_entities(gold: DataFrame, labels: list[str], label_arr: str = "labels") -> DataFrame:
    """``gold`` with ``te``, its entities after dropping the ignore index, and
    ``nt``, their number per type.  Run it before rows meet the predictions of
    several models or transfer languages: it is the same for all of them."""
    z = with_entity_codes(gold.withColumn("_tl", _kept(F.col(label_arr))), "_tl", "te", labels).drop("_tl")
    return z.withColumn("nt", _counts_of("te", len(type_names(labels))))


def _kept_pairs(labels: pa.Array, preds: pa.Array) -> tuple[np.ndarray, ...]:
    """Per sentence the positions outside the ignore index (``tokens``) and
    those predicted right (``correct``), and the predictions that stay, with
    where each sentence's begin.  A prediction without a label goes."""
    lab, at = ragged(labels)
    lab = ints(lab, IGNORE_INDEX)
    tokens = count_true(lab != IGNORE_INDEX, at)
    pred, offsets = ragged(preds)
    known, pred = pred.is_valid().to_numpy(zero_copy_only=False), ints(pred, -1)
    if not np.array_equal(at, offsets):
        row, place = row_of(offsets), place_of(offsets)
        there = place < np.diff(at)[row]
        truth = np.full(len(pred), IGNORE_INDEX)
        truth[there] = lab[(at[row] + place)[there]]
        lab = truth
    kept = lab != IGNORE_INDEX
    correct = count_true(kept & known & (lab == pred), offsets)
    return correct, tokens, pred[kept], np.concatenate(([0], np.cumsum(count_true(kept, offsets))))


_TOKEN_COUNTS = StructType().add("correct", LongType()).add("tokens", LongType())


@F.arrow_udf(_TOKEN_COUNTS)
def token_counts(labels: pa.Array, preds: pa.Array) -> pa.Array:
    """Per row: positions outside the ignore index with an equal prediction, and all of them."""
    correct, tokens, _, _ = _kept_pairs(labels, preds)
    return pa.StructArray.from_arrays([pa.array(correct), pa.array(tokens)], ["correct", "tokens"])


def _row_counts(labels: list[str]):
    """``correct``, ``tokens`` and per type the predicted and matched entities
    (``np``, ``nm``) of a row's labels, predictions and true entities."""
    codes, n_types = _codes(labels), len(type_names(labels))

    @F.arrow_udf("correct long, tokens long, np array<long>, nm array<long>")
    def of(labs: pa.Array, preds: pa.Array, true: pa.Array) -> pa.Array:
        correct, tokens, pred, offsets = _kept_pairs(labs, preds)
        n = len(correct)
        kind, start, end, begins = _chunks(_code_of(pred, codes), offsets)
        row, whole = row_of(begins), (start >= 0) & (end >= 0)
        row, kind, found = row[whole], kind[whole], entity(kind, start, end)[whole]
        te, at = ragged(true)
        te, of_te = ints(te, -1), row_of(at)
        te, of_te = te[te >= 0], of_te[te >= 0]
        # an entity's first place is its own in its row: the true one that begins there, if any
        room = np.zeros(n, np.int64)
        for r, e in ((row, found), (of_te, te)):
            np.maximum.at(room, r, (e >> 36) + 1)
        base = np.cumsum(room) - room
        begun = np.full(room.sum(), -1)
        begun[base[of_te] + (te >> 36)] = te
        met = begun[base[row] + (found >> 36)] == found
        cell = row * n_types + kind - 1
        counts = [np.bincount(x, minlength=n * n_types) for x in (cell, cell[met])]
        per_type = np.arange(n + 1) * n_types
        return pa.StructArray.from_arrays([pa.array(correct), pa.array(tokens), *[to_lists(pa.array(x), per_type) for x in counts]],
                                          ["correct", "tokens", "np", "nm"])
    return of


def ner_rows(preds: DataFrame, cell: list[str], labels: list[str], pred_arr: str = "pred_tags",
             label_arr: str = "labels") -> DataFrame:
    """Per sentence: token counts and, per type, the numbers of true,
    predicted and matched entities (``nt``, ``np``, ``nm``) after dropping the
    ignore index.  Rows from ``gold_entities`` keep its columns; others get them here."""
    if "te" not in preds.columns:
        preds = gold_entities(preds, labels, label_arr)
    z = preds.select(*cell, "nt", _row_counts(labels)(label_arr, pred_arr, "te").alias("c"))
    return z.select(*cell, "c.correct", "c.tokens", "nt", "c.np", "c.nm")


def _type_counts(rows: DataFrame, cell: list[str], labels: list[str]) -> DataFrame:
    """One aggregate over the sentences, without exploding entities: per (cell,
    type index) true / predicted / matched entity counts, plus type 0 carrying
    the token counts.  Types without an entity on either side have no row."""
    n = len(type_names(labels))
    sums = [F.sum(F.get(arr, k)).alias(f"{arr}{k}") for arr in ("nt", "np", "nm") for k in range(n)]
    g = rows.groupBy(*cell).agg(F.sum("correct").alias("correct"), F.sum("tokens").alias("tokens"), *sums)

    def row(k, t, p, tp, c, m):
        return F.struct(F.lit(k).alias("type"), *[F.coalesce(x, F.lit(0)).cast("long").alias(a) for a, x in
                                                  (("t", t), ("p", p), ("tp", tp), ("c", c), ("n", m))])
    zero = F.lit(0)
    out = [row(0, zero, zero, zero, F.col("correct"), F.col("tokens"))]
    out += [row(k + 1, F.col(f"nt{k}"), F.col(f"np{k}"), F.col(f"nm{k}"), zero, zero) for k in range(n)]
    g = g.select(*cell, F.inline(F.array(*out)))
    return g.where((F.col("type") == 0) | (F.col("t") + F.col("p") > 0))


def _prf(g: DataFrame, labels: list[str]) -> DataFrame:
    g = _prf_cols(g.filter(F.col("type") > 0))
    return g.withColumn("type", F.element_at(F.array(*[F.lit(x) for x in type_names(labels)]), F.col("type")))


def _prf_cols(g: DataFrame) -> DataFrame:
    prec = F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(F.lit(0.0))
    rec = F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(F.lit(0.0))
    g = g.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return g.withColumn("f1", f1)


def type_prf(rows: DataFrame, cell: list[str], labels: list[str], digits: int = 6) -> DataFrame:
    """Per (cell, entity type): true / predicted / matched counts, P, R, F1."""
    g = _prf(_type_counts(rows, cell, labels), labels)
    return g.select(*cell, "type", F.col("t").alias("n_true"), F.col("p").alias("n_pred"), "tp",
                    F.round("precision", digits).alias("precision"), F.round("recall", digits).alias("recall"), "f1")


def ner_grid(preds: DataFrame, cell: list[str], labels: list[str], digits: int = 6) -> DataFrame:
    """H7 + H8: macro-over-types F1 (0 when no entity on either side) and
    token accuracy per cell, from a single aggregate over the sentences."""
    g = _type_counts(ner_rows(preds, cell, labels), cell, labels)
    # one more (tiny) aggregate: token accuracy from type 0, macro F1 over the
    # entity types; both from the same per-type counts
    prf = _prf_cols(g)
    out = prf.groupBy(*cell).agg(
        F.try_divide(F.sum("c"), F.sum("n")).alias("accuracy"),
        F.avg(F.when(F.col("type") > 0, F.col("f1"))).alias("f1_score"))
    return out.select(*cell, F.round("accuracy", digits).alias("accuracy"),
                      F.round(F.coalesce("f1_score", F.lit(0.0)), digits).alias("f1_score"))


def token_accuracy_grid(preds: DataFrame, cell: list[str], digits: int = 6) -> DataFrame:
    """H8 alone: share of right tokens outside the ignore index per cell."""
    g = preds.select(*cell, token_counts("labels", "pred_tags").alias("t")).groupBy(*cell).agg(
        F.try_divide(F.sum("t.correct"), F.sum("t.tokens")).alias("accuracy"))
    return g.select(*cell, F.round("accuracy", digits).alias("accuracy"))


@F.arrow_udf(LongType())
def multiset_overlap(p: pa.Array, g: pa.Array) -> pa.Array:
    """Size of the multiset intersection of two token arrays (``Counter & Counter``); null tokens meet none."""
    (ps, at), (gs, begins) = ragged(p), ragged(g)
    both = pa.concat_arrays([ps, gs]).dictionary_encode()
    code, row, k = ints(both.indices, -1), np.concatenate([row_of(at), row_of(begins)]), max(len(both.dictionary), 1)
    side, key = np.arange(len(code)) >= len(ps), row * k + code
    (a, n), (b, m) = [np.unique(key[x & (code >= 0)], return_counts=True) for x in (~side, side)]
    met, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = np.bincount(met // k, np.minimum(n[i], m[j]), len(p)).astype(np.int64)
    return pa.array(common, mask=(p.is_null().to_numpy(zero_copy_only=False) | g.is_null().to_numpy(zero_copy_only=False)))


def tag_string_scores(gold: Column, pred: Column, g: Column, p: Column) -> tuple[Column, Column]:
    """H13 / H14 for generated tag strings: exact stripped match and the
    tag-multiset F1 (0 on zero division).  ``g`` / ``p`` are the whitespace
    token arrays of gold / pred, given as columns."""
    em = (strip(pred) == strip(gold)).cast("int")
    tp = multiset_overlap(p, g)
    prec = F.when(F.size(p) > 0, tp / F.size(p)).otherwise(F.lit(0.0))
    rec = F.when(F.size(g) > 0, tp / F.size(g)).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return em, f1


def generated_tags_grid(rows: DataFrame, cell: list[str], gold: str, pred: str, digits: int = 6) -> DataFrame:
    """H13 + H14 over decoded strings: mean exact match of the stripped strings
    and mean tag-multiset F1 of their white-space tokens per cell.  A null
    string counts as empty."""
    g, p = F.coalesce(gold, F.lit("")), F.coalesce(pred, F.lit(""))
    z = rows.select(*cell, g.alias("_g"), p.alias("_p"), ws_tokens(g).alias("_gt"), ws_tokens(p).alias("_pt"))
    z = z.withColumn("_tp", multiset_overlap(F.col("_pt"), F.col("_gt")))
    em = (strip(F.col("_p")) == strip(F.col("_g"))).cast("int")
    # 2PR / (P + R) with P = tp / |p| and R = tp / |g|
    f1 = F.coalesce(F.try_divide(2.0 * F.col("_tp"), F.size("_pt") + F.size("_gt")), F.lit(0.0))
    out = z.select(*cell, em.alias("em"), f1.alias("f1")).groupBy(*cell).agg(
        F.avg("em").alias("exact_match"), F.avg("f1").alias("f1_score"))
    return out.select(*cell, F.round("exact_match", digits).alias("exact_match"),
                      F.round("f1_score", digits).alias("f1_score"))


def _without(arr: str, x: int) -> Column:
    """The elements of an array other than ``x`` and null."""
    rest = F.array_remove(arr, x)
    # null instead of false: an element is null (rare, and lambdas are interpreted)
    return F.when(F.array_contains(rest, F.lit(x)).isNull(), F.filter(rest, lambda e: e.isNotNull())).otherwise(rest)


def tag_string_grid(preds: DataFrame, cell: list[str], labels: list[str], digits: int = 6) -> DataFrame:
    """Generative NER: per row the target strings of gold and predicted tag ids
    (C6: non-``O`` tag names joined by a space, ``None`` when there are none),
    then mean exact match (H14) and mean tag-multiset F1 (H13) per cell.

    Tag names hold no white space, so the white-space tokens of such a string
    are exactly its non-``O`` tags (or ``None``): the scores are computed on
    those id arrays directly, without building and re-splitting strings
    (``tag_string_scores`` is the string form for decoded generations).
    """
    o = labels.index("O")
    none = F.array(F.lit(-1))
    s = preds.select(*cell, _without("tags", o).alias("g0"), _without("pred_tags", o).alias("p0"))
    s = s.select(*cell, F.when(F.size("g0") == 0, none).otherwise(F.col("g0")).alias("gt"),
                 F.when(F.size("p0") == 0, none).otherwise(F.col("p0")).alias("pt"))
    p, g = F.col("pt"), F.col("gt")
    tp = multiset_overlap(p, g)
    prec = tp / F.size(p)
    rec = tp / F.size(g)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    em = (p == g).cast("int")
    g2 = s.select(*cell, em.alias("em"), f1.alias("f1")).groupBy(*cell).agg(
        F.avg("em").alias("exact_match"), F.avg("f1").alias("f1_score"))
    return g2.select(*cell, F.round("exact_match", digits).alias("exact_match"), F.round("f1_score", digits).alias("f1_score"))
