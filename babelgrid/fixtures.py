"""Canonical benchmark-shaped tables derived from the driver tables.

The original multilingual corpora are not available offline, so every
canonical table (classification examples, QA examples, tagged sentences,
model predictions, span logits, training-run logs) is derived from the given
parquet tables by a fixed rule.  Every rule reads whole tables and whole
texts, so the work grows with the data; each rule has a SQL twin in
``babelgrid.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .functions.arrays import count_true, firsts, ints, place_of, ragged, to_lists
from .functions.labels import IGNORE_INDEX, UPOS_DEFAULT, UPOS_LABELS, WIKIANN_LABELS, encode_or_default
from .functions.text import WS_CLASS, ws_tokens
from .operators.joins import join_dim
from .operators.ranking import bucketed_row_number

_NOT_WS = "[^" + WS_CLASS[1:-1] + "]"

# --- fixed values of the fixture rules --------------------------------------
SEED = "42"
MODEL = "fixture"
# Hex digit thresholds that decide whether a synthetic prediction is right.
CLS_RIGHT_BELOW = "b"          # cross-language
CLS_RIGHT_BELOW_IN_LANG = "e"  # same language
NER_DROP_BELOW = 3             # of 16 hash values
NER_DROP_BELOW_IN_LANG = 1
# Entity type of a word by the first hex digit of md5(word).
NER_TYPE_BY_DIGIT = {"0": "PER", "1": "PER", "2": "ORG", "3": "LOC"}
NER_DATE_DIGIT = "4"           # only in label sets with dates
MASK_EVERY = 7                 # label masked where pos % 7 == 6
QA_UNANSWERABLE_MOD = 9        # doc_id % 10 == 9 -> no gold answer
QA_MISSING_PRED_MOD = 17       # doc_id % 17 == 0 -> no prediction
SPAN_NULL_BELOW = 8            # positions < 8 are outside the context
SPAN_WORD_WIDTH = 5            # 'w008 ' -> 5 characters per word
# ---------------------------------------------------------------------------
_HEX = "0123456789abcdef"
_INTS = ArrayType(IntegerType())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table; its splits follow from the files and
    ``spark.sql.files.maxPartitionBytes``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(doc_id: Column) -> Column:
    m = F.pmod(doc_id, F.lit(10))
    return F.when(m < 7, "train").when(m == 7, "validation").otherwise("test")


def _md5_digit(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat(*parts)), 1, 1)


def transfer_languages(examples: DataFrame, split: str | None = "train") -> DataFrame:
    """(task, transfer_lang): the languages a model was trained on."""
    src = examples.filter(F.col("split") == split) if split else examples
    return src.select("task", F.col("lang").alias("transfer_lang")).distinct()


def with_transfer_languages(rows: DataFrame, langs: DataFrame) -> DataFrame:
    """every example row once per transfer language of its task."""
    return join_dim(rows, langs, ["task"])


# --- classification ----------------------------------------------------------

def fx_cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents join labels: label = quality*2 + toxic, split by doc_id % 10."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    lab = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id")
    return j.select(
        F.lit("cls").alias("task"), "lang", split_of(F.col("doc_id")).alias("split"),
        F.col("doc_id").cast("string").alias("id"), "doc_id", "text",
        (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("label"))


def fx_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic classifier output for every (transfer language, test row)."""
    cls = fx_cls(spark, sf_dir)
    test = cls.filter(F.col("split") == "test").select("task", "lang", "id", "doc_id", "label")
    rows = with_transfer_languages(test, transfer_languages(cls))
    thr = F.when(F.col("transfer_lang") == F.col("lang"), F.lit(CLS_RIGHT_BELOW_IN_LANG)).otherwise(F.lit(CLS_RIGHT_BELOW))
    right = _md5_digit(F.col("transfer_lang"), F.lit(":"), F.col("id")) < thr
    return rows.select(
        "task", F.lit(MODEL).alias("model"), "transfer_lang", F.col("lang").alias("task_lang"),
        "id", "doc_id", "label",
        F.when(right, F.col("label")).otherwise(F.pmod(F.col("label") + 1, F.lit(4))).cast("int").alias("pred"))


def fx_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding as class logits, ``label`` as truth."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("logits"),
                    F.col("label").cast("int").alias("label"))


# --- question answering ------------------------------------------------------

def fx_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractive QA examples over whole documents; a text of fewer than four
    words is its own answer, one without words is unanswerable."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    w = d.select("doc_id", "lang", F.coalesce(ws_tokens("text"), F.array().cast("array<string>")).alias("words"))
    n = F.size("words")
    a = F.pmod(F.col("doc_id"), F.greatest(n - 3, F.lit(1))).cast("int")
    ans = F.array_join(F.slice("words", a + 1, 3), " ")
    start = F.when(a == 0, F.lit(0)).otherwise(F.length(F.array_join(F.slice("words", 1, a), " ")) + 1)
    answerable = (F.pmod(F.col("doc_id"), F.lit(10)) != QA_UNANSWERABLE_MOD) & (n > 0)
    answers = F.when(answerable, F.struct(F.array(ans).alias("text"), F.array(start.cast("int")).alias("answer_start"))) \
        .otherwise(F.struct(F.array().cast("array<string>").alias("text"), F.array().cast("array<int>").alias("answer_start")))
    return w.select(
        F.lit("qa").alias("task"), "lang", F.lit("validation").alias("split"),
        F.concat(F.col("lang"), F.lit("-"), F.col("doc_id").cast("string")).alias("id"), "doc_id",
        F.concat(F.array_join(F.slice("words", 1, 5), " "), F.lit("?")).alias("question"),
        F.array_join("words", " ").alias("context"),
        answers.alias("answers"))


def fx_qapred(spark: SparkSession, sf_dir: str, qa: DataFrame | None = None) -> DataFrame:
    """Two predictions per (transfer language, answerable example): seq 0 is a
    stale one, seq 1 the final one; some ids get none."""
    qa = qa if qa is not None else fx_qa(spark, sf_dir)
    rows = qa.filter((F.pmod("doc_id", F.lit(10)) != QA_UNANSWERABLE_MOD) & (F.pmod("doc_id", F.lit(QA_MISSING_PRED_MOD)) != 0))
    rows = rows.select("task", "lang", "id", "doc_id", "question",
                       F.coalesce(F.get(F.col("answers.text"), 0), F.lit("")).alias("ans"))
    langs = qa.select("task", F.col("lang").alias("transfer_lang")).distinct()
    rows = with_transfer_languages(rows, langs)
    v = F.pmod(F.col("doc_id") + F.ascii("transfer_lang"), F.lit(4))
    final = (F.when(v == 0, F.col("ans"))
             .when(v == 1, F.array_join(F.slice(F.split("ans", " "), 1, 2), " "))
             .when(v == 2, F.concat(F.lit("the "), F.col("ans"), F.lit(".")))
             .otherwise(F.col("question")))
    out = rows.select("task", F.lit(MODEL).alias("model"), "transfer_lang", F.col("lang").alias("task_lang"), "id",
                      F.array(F.struct(F.lit(0).alias("seq"), F.lit("none").alias("pred_text")),
                              F.struct(F.lit(1).alias("seq"), final.alias("pred_text"))).alias("p"))
    return out.select("task", "model", "transfer_lang", "task_lang", "id", F.inline("p"))


def fx_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-window start / end logits with offsets (null outside the context)."""
    e = read(spark, sf_dir, "embeddings")
    pos = F.sequence(F.lit(0), F.size("embedding") - 1)
    offsets = F.transform(pos, lambda p: F.when(p >= SPAN_NULL_BELOW, F.struct(
        ((p - SPAN_NULL_BELOW) * SPAN_WORD_WIDTH).alias("s"), ((p - SPAN_NULL_BELOW) * SPAN_WORD_WIDTH + 4).alias("e"))))
    words = F.transform(F.sequence(F.lit(SPAN_NULL_BELOW), F.size("embedding") - 1),
                        lambda p: F.concat(F.lit("w"), F.lpad(p.cast("string"), 3, "0")))
    return e.select(
        F.lit("und").alias("transfer_lang"),
        F.concat(F.lit("ex"), F.pmod("vec_id", F.lit(100)).cast("string")).alias("id"),
        (F.col("vec_id") / 100).cast("int").alias("feature_idx"),
        F.col("embedding").alias("start_logit"), F.reverse("embedding").alias("end_logit"),
        offsets.alias("offsets"), F.array_join(words, " ").alias("context"))


# --- token classification ---------------------------------------------------

def _sentence_langs(spark: SparkSession, sf_dir: str, task: str) -> DataFrame:
    """(task, transfer_lang) of the tagged-sentence tables, straight from the
    documents: a document yields a sentence iff it has a non-space character.
    A cheap column scan, so the size check does not recompute the sentences."""
    d = read(spark, sf_dir, "documents").select("lang", "text")
    d = d.filter(F.col("text").rlike(_NOT_WS))
    return d.select(F.lit(task).alias("task"), F.col("lang").alias("transfer_lang")).distinct()


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a whitespace-tokenised sentence."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    lines = d.select("doc_id", "lang", F.posexplode_outer(F.split("text", "\n")).alias("line", "line_text"))
    # "has a token" as a regex test on the line, filtered before tokenizing
    # (a size filter on the tokens would be pushed below and tokenize twice)
    lines = lines.filter(F.col("line_text").rlike(_NOT_WS))
    return lines.select("doc_id", "lang", "line", ws_tokens("line_text").alias("tokens"), "line_text")


def _first_digits(words: pa.Array) -> np.ndarray:
    """The first hex digit of each word's md5; each different word is hashed once."""
    coded = words.dictionary_encode()
    different = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    digit = np.fromiter((md5(w, usedforsecurity=False).digest()[0] >> 4 for w in different), np.int8, len(different))
    return digit[coded.indices.to_numpy()]


def _word_tags(text: Column, labels: list[str], by_digit: dict[str, str]) -> Column:
    """Tag ids of the words of each sentence: a word's type by md5, B- where
    the type changes.  Arrow splits at Python's white space, so these are the
    words of ``ws_tokens``."""
    types = ["O", *sorted(set(by_digit.values()))]
    place = {x: i for i, x in enumerate(labels)}
    kind = np.array([types.index(by_digit.get(d, "O")) for d in _HEX], np.int8)
    begin = np.array([place.get(t if t == "O" else f"B-{t}", -1) for t in types], np.int32)
    inside = np.array([place.get(t if t == "O" else f"I-{t}", -1) for t in types], np.int32)

    def tags(a: pa.Array) -> pa.Array:
        parts, ends = ragged(pc.utf8_split_whitespace(a))
        # beside white space at an edge there is an empty part, which is no word
        words = pc.binary_length(parts).to_numpy(zero_copy_only=False) > 0
        offsets, t = np.concatenate(([0], np.cumsum(count_true(words, ends)))), kind[_first_digits(parts)[words]]
        return to_lists(pa.array(np.where(firsts(offsets) | (t != np.roll(t, 1)), begin[t], inside[t])), offsets, a.is_null())

    # over an iterator: Spark would chain a plain function with those of the tags, once for each
    @F.arrow_udf(_INTS)
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return map(tags, texts)
    return of(text)


def fx_ner(spark: SparkSession, sf_dir: str, labels: list[str] = WIKIANN_LABELS) -> DataFrame:
    """Tagged sentences: tags by md5 of the word, B- where the type changes;
    label sets with dates tag a further share of the words."""
    s = _sentences(spark, sf_dir)
    by_digit = {**NER_TYPE_BY_DIGIT, **({NER_DATE_DIGIT: "DATE"} if "B-DATE" in labels else {})}
    return s.select(
        F.lit("ner").alias("task"), "lang", F.lit("test").alias("split"),
        F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("line").cast("string")).alias("id"),
        "doc_id", "line", "tokens", _word_tags(F.col("line_text"), labels, by_digit).alias("tags"))


def _pos_hash(i: Column) -> Column:
    """Cheap deterministic hash of (row hash ``_h``, position) into 0..15."""
    return F.pmod(F.col("_h") + i * 7, F.lit(16))


@F.arrow_udf(_INTS)
def _some_dropped(a: pa.Array, h: pa.Array, below: pa.Array) -> pa.Array:
    """Tag ids, ``O`` where ``_pos_hash`` of the row's hash (0 to 15) is under ``below``; no hash, none."""
    ids, offsets = ragged(a)
    sizes = np.diff(offsets)
    low = np.where(h.is_null().to_numpy(zero_copy_only=False), 0, ints(below, 0))
    # only modulo 16, so one byte may wrap
    hashed = np.repeat((ints(h, 0) - 7 * offsets[:-1]).astype(np.int8), sizes) + np.arange(offsets[-1]).astype(np.int8) * np.int8(7)
    at = (hashed & 15) < np.repeat(low.astype(np.int8), sizes)
    return to_lists(pa.array(np.where(at, 0, ids.to_numpy()).astype(np.int32)), offsets, a.is_null())


@F.arrow_udf(_INTS)
def _some_masked(a: pa.Array) -> pa.Array:
    """Tag ids with every 7th position masked."""
    ids, offsets = ragged(a)
    at = place_of(offsets) % MASK_EVERY == MASK_EVERY - 1
    return to_lists(pc.if_else(pa.array(at), pa.scalar(IGNORE_INDEX, ids.type), ids), offsets, a.is_null())


def fx_ner_gold(spark: SparkSession, sf_dir: str, labels: list[str] = WIKIANN_LABELS) -> DataFrame:
    """Gold ids with every 7th position masked."""
    return fx_ner(spark, sf_dir, labels).withColumn("labels", _some_masked("tags"))


def fx_ner_pred(spark: SparkSession, sf_dir: str, gold: DataFrame | None = None) -> DataFrame:
    """Per transfer language: the gold rows (with whatever was derived from
    them) and predictions that turn some tokens into ``O``."""
    gold = gold if gold is not None else fx_ner_gold(spark, sf_dir)
    langs = _sentence_langs(spark, sf_dir, "ner")
    rows = with_transfer_languages(gold, langs)
    rows = rows.withColumn("_h", F.col("doc_id") * 31 + F.col("line") * 17 + F.ascii("transfer_lang") * 13)
    thr = F.when(F.col("transfer_lang") == F.col("lang"), F.lit(NER_DROP_BELOW_IN_LANG)).otherwise(F.lit(NER_DROP_BELOW))
    pred = _some_dropped("tags", F.pmod("_h", F.lit(16)).cast("int"), thr)
    return rows.select("task", F.lit(MODEL).alias("model"), "transfer_lang", F.col("lang").alias("task_lang"), "id",
                       "tokens", "tags", "labels", pred.alias("pred_tags"), *[c for c in ("te", "nt") if c in gold.columns])


def _hex_val(ch: Column) -> Column:
    return F.instr(F.lit(_HEX), ch) - 1


def fx_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POS-tagged sentences: 18 tags plus one unknown tag, chosen by md5(word);
    also the stringified numpy form of tokens and tags."""
    s = _sentences(spark, sf_dir)

    def tag(w):
        h = F.md5(w)
        idx = F.pmod(_hex_val(F.substring(h, 1, 1)) * 16 + _hex_val(F.substring(h, 2, 1)), F.lit(len(UPOS_LABELS) + 1))
        return F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in UPOS_LABELS]), idx + 1), F.lit("UNK"))

    def np_str(arr):
        q = F.transform(arr, lambda t: F.when(F.instr(t, "'") > 0, F.concat(F.lit('"'), t, F.lit('"')))
                        .otherwise(F.concat(F.lit("'"), t, F.lit("'"))))
        return F.concat(F.lit("["), F.array_join(q, " "), F.lit("]"))

    s = s.select("doc_id", "lang", "line", "tokens", F.transform("tokens", tag).alias("upos"))
    return s.select(
        F.lit("pos").alias("task"), "lang", F.lit("test").alias("split"),
        F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("line").cast("string")).alias("id"),
        "doc_id", "line", "tokens", "upos", np_str(F.col("tokens")).alias("tokens_str"), np_str(F.col("upos")).alias("upos_str"))


def fx_pos_pred(spark: SparkSession, sf_dir: str, pos: DataFrame | None = None) -> DataFrame:
    """Per transfer language: gold UPOS ids (unknown tag -> ``X``, every 7th
    position masked) and predictions that shift some ids by one."""
    pos = pos if pos is not None else fx_pos(spark, sf_dir)
    langs = _sentence_langs(spark, sf_dir, "pos")
    rows = with_transfer_languages(pos.select("task", "lang", "id", "doc_id", "line", "upos"), langs)
    ids = F.transform("upos", lambda t: encode_or_default(t, UPOS_LABELS, UPOS_DEFAULT))
    rows = rows.select("task", "transfer_lang", "lang", "id", ids.alias("ids"),
                       (F.col("doc_id") * 31 + F.col("line") * 17 + F.ascii("transfer_lang") * 13).alias("_h"))
    thr = F.when(F.col("transfer_lang") == F.col("lang"), F.lit(NER_DROP_BELOW_IN_LANG)).otherwise(F.lit(NER_DROP_BELOW))
    pred = F.transform("ids", lambda t, i: F.when(_pos_hash(i) < thr, F.pmod(t + 1, F.lit(len(UPOS_LABELS)))).otherwise(t))
    labels = F.transform("ids", lambda t, i: F.when(F.pmod(i, F.lit(MASK_EVERY)) == MASK_EVERY - 1, F.lit(IGNORE_INDEX)).otherwise(t))
    return rows.select("task", F.lit(MODEL).alias("model"), "transfer_lang", F.col("lang").alias("task_lang"), "id",
                       labels.alias("labels"), pred.alias("preds"))


# --- sentence pairs and training runs ---------------------------------------

def fx_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive conversation turns as premise / hypothesis pairs."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    # equi-join on the unique (conv_id, turn) key: a very long conversation is
    # spread over tasks like any other rows (a window per conversation is not)
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    c = c.join(nxt, ["conv_id", "turn"])
    return c.select(
        F.lit("pair").alias("task"), F.lit("und").alias("lang"), F.lit("test").alias("split"),
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("premise"), F.col("next_text").alias("hypothesis"),
        F.pmod(F.col("turn"), F.lit(3)).cast("int").alias("label"))


def fx_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation logs: one run per user, steps numbered by (ts, event_id)."""
    ev = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    # step = row number per user by (ts, event_id), computed in hour buckets so
    # one very active user is not one task
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).alias("_hour")
    ev = bucketed_row_number(ev, ["user_id"], [hour], [F.col("_hour")], [F.col("ts"), F.col("event_id")], "step")
    return ev.select(F.col("user_id").cast("string").alias("run"), F.col("step").cast("int"),
                     F.col("value").cast("double").alias("metric"))
