"""Label vocabularies and label encode / decode (inventory B4-B7, B9, B11, F5).

Label sets are tiny and fixed, so lookups are literal ``map`` expressions that
stay inside whole-stage codegen: no join, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .arrays import count_true, place_of, ragged, row_of, to_lists

# --- fixed values: label vocabularies of the benchmark tasks, in id order ----
SIB_LABELS = ["science/technology", "travel", "politics", "sports", "health",
              "entertainment", "geography"]
TAXI_LABELS = ["Recommendation", "Faith", "Description", "Sin", "Grace", "Violence"]
XNLI_LABELS = ["entailment", "neutral", "contradiction"]
WIKIANN_LABELS = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC"]
MASAKHANER_LABELS = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC",
                     "B-DATE", "I-DATE"]
UPOS_LABELS = ["ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM",
               "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X", "_"]
UPOS_DEFAULT = "X"
# Label that marks a position to ignore in token-level label arrays.
IGNORE_INDEX = -100
# ---------------------------------------------------------------------------
#: Entries of the sketch of unknown labels, and characters of a label it keeps.
MISSES_TRACKED = 4096
MISS_CHARS = 200


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def encode_map(labels: list[str]) -> Column:
    """label -> id as a literal map (B11, one direction)."""
    return F.create_map(*[x for i, l in enumerate(labels) for x in (F.lit(l), F.lit(i))])


def encode_strict(c, labels: list[str]) -> Column:
    """Unknown label is an error (raised on the executor)."""
    looked = encode_map(labels)[_c(c)]
    return F.coalesce(looked, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(_c(c).cast("string"), F.lit("NULL"))))).cast("int")


def encode_or_null(c, labels: list[str]) -> Column:
    """Unknown label becomes NULL."""
    return encode_map(labels)[_c(c)]


def observe_misses(df: DataFrame, c: str, labels: list[str], name: str = "misses", tracked: int = MISSES_TRACKED) -> tuple[DataFrame, Observation]:
    """B5 with a report: ``df`` as it is, and an observation filled by the first
    action on it, without a pass of its own: ``rows``, ``unknown`` (labels outside
    the vocabulary, null included) and ``by_label``, the unknown texts with their counts.

    The texts are kept in a frequent-items sketch of ``tracked`` entries: exact
    up to three quarters of that many different texts, and the commonest beyond."""
    unknown = ~F.coalesce(F.col(c).isin(labels), F.lit(False))
    o = Observation(name)
    # what the sketch can't hold, nulls, is counted apart
    texts = F.when(unknown, F.substring(F.col(c), 1, MISS_CHARS))
    return df.observe(o, F.count(F.lit(1)).alias("rows"), F.count_if(unknown).alias("unknown"), F.count_if(F.col(c).isNull()).alias("null"),
                      F.call_function("approx_top_k", texts, F.lit(tracked * 3 // 4), F.lit(tracked)).alias("by_label")), o


def misses(o: Observation) -> dict[str | None, int]:
    """Unknown label text -> number of rows, from a filled observation."""
    got = o.get
    out = {r["item"]: r["count"] for r in got["by_label"] if r["item"] is not None}
    return out | ({None: got["null"]} if got["null"] else {})


def encode_or_default(c, labels: list[str], default: str) -> Column:
    """Unknown label becomes the id of ``default``."""
    return F.coalesce(encode_map(labels)[_c(c)], F.lit(labels.index(default)))


def decode(c, labels: list[str]) -> Column:
    """Id -> label; ids outside the vocabulary give NULL."""
    return F.try_element_at(F.array(*[F.lit(l) for l in labels]), _c(c) + 1)


def decode_array(c, labels: list[str]) -> Column:
    """B7 on an id array."""
    arr = F.array(*[F.lit(l) for l in labels])
    return F.transform(_c(c), lambda x: F.try_element_at(arr, x + 1))


def label_dim(spark: SparkSession, labels: list[str], name: str = "label") -> DataFrame:
    """The label list as a (label, id) dimension table."""
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(l) for l in labels])).alias(f"{name}_id", name))


def replace_sentinels(c, vocab_size, pad_id: int) -> Column:
    """Ids outside ``[0, vocab_size)`` (e.g. -100) become ``pad_id``."""
    return F.transform(_c(c), lambda x: F.when((x >= 0) & (x < vocab_size), x).otherwise(F.lit(pad_id)))


def _kept_of(ignore: int, element: str):
    """Predictions and labels of the positions whose label is neither ``ignore``
    nor null, as two arrays; a prediction that is missing is null."""
    @F.arrow_udf(f"p array<{element}>, l array<{element}>")
    def of(preds: pa.Array, labels: pa.Array) -> pa.Array:
        (pred, begins), (lab, at) = ragged(preds), ragged(labels)
        null = pc.or_(preds.is_null(), labels.is_null())
        kept = pc.fill_null(pc.not_equal(lab, pa.scalar(ignore, lab.type)), False)
        if np.array_equal(begins, at):
            pred = pred.filter(kept)
        else:
            row, place = row_of(at), place_of(at)
            there = place < np.diff(begins)[row]
            pred = pred.take(pa.array(begins[row] + place, mask=~there).filter(kept))
        offsets = np.concatenate(([0], np.cumsum(count_true(kept.to_numpy(zero_copy_only=False), at))))
        return pa.StructArray.from_arrays([to_lists(x, offsets, null) for x in (pred, lab.filter(kept))], ["p", "l"])
    return of


def masked_pairs(pred, label, ignore: int = IGNORE_INDEX, element: str = "int") -> Column:
    """Zip predictions with labels and drop positions whose label is ``ignore``.

    Returns ``array<struct<p, l>>`` re-indexed from 0; ``element`` is the type of both.
    """
    kept = _kept_of(ignore, element)(_c(pred), _c(label))
    return F.arrays_zip(kept["p"].alias("p"), kept["l"].alias("l"))
