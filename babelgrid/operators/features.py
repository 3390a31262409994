"""Feature preparation (inventory D1-D10, J1) on the engine's own tokenizer.

The reference calls pretrained subword tokenizers; here a token is a
white-space-separated word of the text, ids come from a vocabulary built with
``groupBy(token).count()``, and long contexts are cut into overlapping
windows by relational operators:

* windows and answer spans follow from token counts alone,
* character offsets come from prefix sums in two levels: the lengths of blocks
  of tokens first, then the tokens of a window, all in the row of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.arrays import ragged, to_lists
from ..functions.text import LETTERS, WS_CLASS, strip, ws_tokens
from ..session import materialize
from .joins import join_dim

# --- fixed values: special tokens and sequence limits ---------------------------
PAD_ID, BOS_ID, EOS_ID, UNK_ID = 0, 1, 2, 3
SPECIAL_TOKENS = ["<pad>", "<s>", "</s>", "<unk>"]
FIRST_WORD_ID = len(SPECIAL_TOKENS)
QA_MAX_LEN = 384
QA_STRIDE = 128
PAIR_SPECIALS = 4          # <s> A </s></s> B </s>
SINGLE_MAX_LEN = 128
PAIR_MAX_LEN = 256
T2T_INPUT_MAX = 1024
T2T_TARGET_MAX = 128
TAG_TARGET_MAX = 32
CLASS_TARGET_MAX = 8
BLOCK_TOKENS = 1 << 19     # tokens whose words are looked up together
# ---------------------------------------------------------------------------------

def _not_ws() -> str:
    return "[^" + WS_CLASS[1:-1] + "]"




# --- vocabulary ---------------------------------------------------------------------

def build_vocab(tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """(token, cnt, token_id): ids by (count desc, token asc) after the specials.

    Distinct tokens are range-partitioned and sorted by that order and written
    once with their place in their partition; the sizes of the partitions (one
    row each, whatever the vocabulary) give every partition its offset.
    """
    counts = tokens.groupBy(F.col(token_col).alias("token")).agg(F.count(F.lit(1)).alias("cnt"))
    order = [F.col("cnt").desc(), F.col("token")]
    ranked = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    # the partition number is in the upper bits of the id, the place in the lower 33
    ranked = materialize(ranked.withColumn("at", F.monotonically_increasing_id()), "vocabulary")
    ranked = ranked.withColumn("part", F.shiftright("at", 33))
    sizes = sorted(ranked.groupBy("part").count().collect())
    before = accumulate((n for _, n in sizes), initial=0)
    offsets = tokens.sparkSession.createDataFrame([(k, off) for (k, _), off in zip(sizes, before)],
                                                  "part long, off long")
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.join(F.broadcast(offsets), "part").select(
        "token", "cnt", (F.lit(FIRST_WORD_ID) + F.col("off") + place).cast("int").alias("token_id"))


EXAMPLE_KEYS = ("task", "lang", "id")


def example_keys(df: DataFrame, keys: list[str] | None = None) -> list[str]:
    """What identifies an example: ids may be shared by the languages of a
    parallel corpus, so task and language belong to the key where present."""
    return list(keys) if keys else [c for c in EXAMPLE_KEYS if c in df.columns]


def lookup_ids(rows: DataFrame, vocab: DataFrame, token_col: str = "token") -> DataFrame:
    """Token rows -> token ids (unknown -> <unk>)."""
    v = vocab.select(F.col("token").alias(token_col), "token_id")
    j = join_dim(rows, v, [token_col], how="left")
    return j.withColumn("token_id", F.coalesce("token_id", F.lit(UNK_ID)))


def lower_tokens(text: str) -> Column:
    return F.coalesce(ws_tokens(F.lower(F.col(text))), F.array().cast("array<string>"))


def _coded(rows: DataFrame, keys: list[str], sides: list[str]) -> DataFrame:
    """Rows in blocks of at most ``BLOCK_TOKENS`` tokens (or one row): block,
    ``rows`` (key and per side where its tokens begin and how many they are),
    ``codes`` (a number per token, side by side) and ``words`` (each of the
    block's words once, by code)."""
    d = rows.select(F.struct(*keys).alias("key"), *sides)
    row = StructType([d.schema["key"], *[StructField(f"{x}{n}", IntegerType()) for n in range(len(sides)) for x in "sn"]])
    out = StructType([StructField("block", LongType()), StructField("rows", ArrayType(row)),
                      StructField("codes", ArrayType(IntegerType())), StructField("words", ArrayType(StringType()))])

    def one(x) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for b in batches:
            ends = np.cumsum(sum(np.diff(ragged(b[x])[1]) for x in sides))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_TOKENS, "right")))
                part = b.slice(i, j - i)
                tokens, offsets = zip(*[ragged(part[x]) for x in sides], strict=True)
                words = pa.concat_arrays(tokens).dictionary_encode()
                before = accumulate((len(t) for t in tokens), initial=1)
                places = [pa.array(x, pa.int32()) for first, o in zip(before, offsets) for x in (first + o[:-1], np.diff(o))]
                at = pa.StructArray.from_arrays([part["key"], *places], row.names)
                yield pa.RecordBatch.from_arrays([pa.array([block]), one(at), one(words.indices), one(words.dictionary)], out.names)
                block, i = block + 1, j

    return materialize(d.mapInArrow(coded, out), "coded")


def _side_ids(rows: DataFrame, vocab: DataFrame, keys: list[str], sides: list[str], extra: list[str]) -> DataFrame:
    """Ids of token-array columns.  Returns keys, ``extra`` and one id array per
    side; empty sides keep their row, rows of equal keys are one, by place.

    Only the words that differ within a block of rows meet the vocabulary, and
    their ids come back as one array per block."""
    names = [*keys, *extra]
    blocks = _coded(rows, names, sides)
    d = lookup_ids(blocks.select("block", F.posexplode("words").alias("code", "token")), vocab)
    ids = d.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("code", "token_id")))["token_id"].alias("ids"))

    out = StructType([*rows.select(*names).schema, *[StructField(x, ArrayType(IntegerType())) for x in sides]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, codes, found in zip(b["rows"], b["codes"], b["ids"]):
                at, codes = at.values, codes.values.to_numpy()
                values = pa.array(found.values.to_numpy()[codes]) if len(codes) else pa.array([], pa.int32())
                lists = []
                for n in range(len(sides)):
                    first, size = (at.field(f"{x}{n}").to_numpy() for x in "sn")
                    lists.append(pa.ListArray.from_arrays(pa.array(np.append(first, first[-1] + size[-1]) - 1, pa.int32()), values))
                yield pa.RecordBatch.from_arrays([*[at.field("key").field(k) for k in names], *lists], out.names)

    z = blocks.join(ids, "block", "left").select("rows", "codes", "ids").mapInArrow(cut, out)
    g = z.groupBy(*names).agg(F.collect_list(F.struct(*sides)).alias("same"))

    def merged(x: str) -> Column:
        placed = F.flatten(F.transform("same", lambda r: F.transform(r[x], lambda t, p: F.struct(p.alias("p"), t.alias("t")))))
        return F.when(F.size("same") == 1, F.col("same")[0][x]).otherwise(F.array_sort(placed)["t"]).alias(x)

    return g.select(*names, *[merged(x) for x in sides])


def encode_single(docs: DataFrame, vocab: DataFrame, text: str = "text", max_len: int = SINGLE_MAX_LEN,
                  keys: list[str] | None = None) -> DataFrame:
    """<s> ids </s> truncated to ``max_len`` and padded, with attention
    mask size and the token count of the whole text.  The text is cut in its
    row, so only the tokens that stay are exploded."""
    keys = example_keys(docs, keys)
    w = docs.select(*keys, lower_tokens(text).alias("w"))
    w = w.select(*keys, F.size("w").alias("n_tokens"), F.slice("w", 1, max_len - 2).alias("w"))
    e = _side_ids(w, vocab, keys, ["w"], ["n_tokens"])
    body = F.concat(F.array(F.lit(BOS_ID)), F.col("w"), F.array(F.lit(EOS_ID)))
    e = e.select(*keys, "n_tokens", body.alias("body"))
    padded = F.concat("body", F.array_repeat(F.lit(PAD_ID), F.lit(max_len) - F.size("body")))
    return e.select(*keys, "n_tokens", F.size("body").alias("attention"), padded.alias("input_ids"))


def pair_lengths(la: Column, lb: Column, budget: int) -> tuple[Column, Column]:
    """Longest-first truncation of two lengths to ``budget`` tokens: the longer
    side loses a token each step, the second side on ties."""
    half_up = (budget + 1) // 2
    over = la + lb > budget
    ka = F.when(~over, la).otherwise(F.least(la, F.greatest(F.lit(budget) - lb, F.lit(half_up))))
    kb = F.when(~over, lb).otherwise(F.lit(budget) - ka)
    return ka, kb


def encode_pair(pairs: DataFrame, vocab: DataFrame, a: str = "premise", b: str = "hypothesis",
                max_len: int = PAIR_MAX_LEN, keys: list[str] | None = None) -> DataFrame:
    """<s> A </s></s> B </s>, longest-first truncated, unpadded."""
    keys = example_keys(pairs, keys)
    w = pairs.select(*keys, lower_tokens(a).alias("wa"), lower_tokens(b).alias("wb"))
    ka, kb = pair_lengths(F.size("wa"), F.size("wb"), max_len - PAIR_SPECIALS)
    w = w.select(*keys, ka.alias("ka"), kb.alias("kb"), "wa", "wb")
    w = w.select(*keys, "ka", "kb", F.slice(F.col("wa"), F.lit(1), F.col("ka")).alias("wa"),
                 F.slice(F.col("wb"), F.lit(1), F.col("kb")).alias("wb"))
    e = _side_ids(w, vocab, keys, ["wa", "wb"], ["ka", "kb"])
    seq = F.concat(F.array(F.lit(BOS_ID)), F.col("wa"), F.array(F.lit(EOS_ID), F.lit(EOS_ID)), F.col("wb"),
                   F.array(F.lit(EOS_ID)))
    return e.select(*keys, F.col("ka").alias("len_a"), F.col("kb").alias("len_b"), seq.alias("input_ids"))


def encode_text2text(rows: DataFrame, vocab: DataFrame, source: str, target: str,
                     source_max: int = T2T_INPUT_MAX, target_max: int = T2T_TARGET_MAX,
                     keys: list[str] | None = None) -> DataFrame:
    """D3: input ids and label ids, each truncated to its cap with </s> last."""
    keys = example_keys(rows, keys)
    w = rows.select(*keys, lower_tokens(source).alias("ws"), lower_tokens(target).alias("wt"))
    w = w.select(*keys, F.slice("ws", 1, source_max - 1).alias("ws"), F.slice("wt", 1, target_max - 1).alias("wt"))
    e = _side_ids(w, vocab, keys, ["ws", "wt"], [])
    return e.select(*keys, F.concat("ws", F.array(F.lit(EOS_ID))).alias("input_ids"),
                    F.concat("wt", F.array(F.lit(EOS_ID))).alias("labels"))


def decode_ids(encoded: DataFrame, vocab: DataFrame, ids: str = "input_ids", keys: list[str] | None = None) -> DataFrame:
    """Ids -> text, specials (pad, bos, eos, unk) skipped, in order."""
    keys = example_keys(encoded, keys)
    e = encoded.select(*keys, F.posexplode_outer(F.filter(ids, lambda t: t >= FIRST_WORD_ID)).alias("pos", "token_id"))
    j = join_dim(e, vocab.select("token_id", "token"), ["token_id"], "left")
    g = j.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(
        F.col("token").isNotNull(), F.struct("pos", "token")))).alias("pt"))
    return g.select(*keys, F.array_join(F.transform("pt", lambda s: s["token"]), " ").alias("text"))


# --- long-context windows ----------------------------------------------------------------

def _token_pattern() -> str:
    """A token after its white space, as two groups.

    Ranges without white space are tried first, since the class of all white space costs some
    ten comparisons a character; possessive, so the matcher loops and never
    recurses or tries again."""
    return f"((?: |(?!{LETTERS}){WS_CLASS})*+)((?:{LETTERS}++|{_not_ws()})++)"


def running_sums(values: Column, block: int = 16) -> Column:
    """Array of numbers to the sums of the elements up to and with each.

    Two levels: sums within blocks, then each block's offset.  Appending copies
    an array, so a block is short and there is one append per block above it."""
    def fold(xs: Column) -> Column:
        return F.aggregate(xs, F.array().cast("array<bigint>"), lambda acc, x: F.concat(
            acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("bigint")) + x)))

    def join(within: Column) -> Column:
        offsets = F.concat(F.array(F.lit(0).cast("bigint")), fold(F.transform(within, lambda w: F.get(w, F.size(w) - 1))))
        return F.flatten(F.zip_with(within, F.slice(offsets, 1, F.size(within)),
                                    lambda w, o: F.transform(w, lambda v: v + o)))

    def blocks(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(block)))
        return F.coalesce(F.transform(starts, lambda i: fold(F.slice(v, i, block))), F.array().cast("array<array<bigint>>"))

    # one-element arrays: each level is computed once, not at every use
    return F.transform(F.array(F.transform(F.array(values), blocks)[0]), join)[0]


def token_blocks(text: Column, size: Column) -> Column:
    """A text cut into pieces of ``size`` tokens, each with the white space before it."""
    one = F.concat(F.lit(f"(?:{_token_pattern()}){{1,"), size.cast("string"), F.lit("}+"))
    return F.regexp_extract_all(text, one, F.lit(0))


def token_offsets(text: Column, base: Column) -> Column:
    """(s, e) of every token of ``text``, in code points from ``base``; as long as it has tokens."""
    space = np.array([chr(i).isspace() for i in range(0x3002)])

    @F.arrow_udf("array<struct<s:int,e:int>>")
    def of(texts: pa.Array, bases: pa.Array) -> pa.Array:
        edges = [np.zeros(0, np.int64)]
        for t, b in zip(texts, bases):
            points = np.frombuffer((t.as_py() or "").encode("utf-32-le", "surrogatepass"), np.uint32)
            word = ~space[np.minimum(points, len(space) - 1)]
            edges.append(np.flatnonzero(np.diff(word, prepend=False, append=False)) + (b.as_py() or 0))
        both = np.concatenate(edges).astype(np.int32)
        at = pa.StructArray.from_arrays([pa.array(both[::2]), pa.array(both[1::2])], ["s", "e"])
        return to_lists(at, np.cumsum([len(x) // 2 for x in edges]), texts.is_null())
    return of(text, base)


def _window_frame(examples: DataFrame, max_len: int, stride: int) -> DataFrame:
    """Window sizes per example; a null question or context has no tokens."""
    ex = examples.select(
        *example_keys(examples), F.coalesce(F.size(ws_tokens(strip("question"))), F.lit(0)).alias("qlen"),
        F.coalesce(F.size(ws_tokens("context")), F.lit(0)).alias("n"), "context",
        F.get(F.col("answers.answer_start"), 0).alias("sc"),
        (F.get(F.col("answers.answer_start"), 0) + F.length(F.get(F.col("answers.text"), 0))).alias("ec"))
    cap = F.lit(max_len) - F.col("qlen") - PAIR_SPECIALS
    ex = ex.withColumn("cap", cap).withColumn("step", F.col("cap") - stride)
    ex = ex.withColumn("cap", F.when(F.col("step") > 0, F.col("cap")).otherwise(
        F.raise_error(F.lit("question too long for max_len and stride")).cast("int")))
    return ex.withColumn("nwin", F.greatest(F.lit(0), F.ceil((F.col("n") - F.col("cap")) / F.col("step"))).cast("int") + 1)


def qa_windows(examples: DataFrame, max_len: int = QA_MAX_LEN, stride: int = QA_STRIDE) -> DataFrame:
    """D4 + D5 + D7 without exploding tokens.

    Windows follow from the token count alone.  Because token offsets grow
    with the token index, the answer's token span needs two numbers per
    example: ``a`` = tokens starting at or before the answer's first
    character (the tokens of the text up to it), ``b`` = tokens ending before
    the answer's end (the tokens of the text before it, minus a token cut by
    that boundary).  A window [t0, t1) holds the answer iff t0 < a and
    t1 - 1 >= b; then start = cs + min(a, t1) - t0 - 1, end = cs + min(b, t1) - t0.

    ``examples``: id, question, context, answers.  Returns id, feature_idx,
    tok_start, tok_end, seq_len, start_position, end_position.
    """
    ex = _window_frame(examples, max_len, stride)
    nws = _not_ws()
    cut_len = F.col("ec") - 1
    cut = ((cut_len > 0) & (F.length("context") > cut_len)
           & F.substring("context", cut_len + 1, 1).rlike(nws) & F.substring("context", cut_len, 1).rlike(nws))
    names = example_keys(ex)
    ex = ex.select(*names, "qlen", "n", "cap", "step", "nwin", "sc",
                   F.size(ws_tokens(F.substring("context", 1, F.col("sc") + 1))).alias("a"),
                   (F.size(ws_tokens(F.substring("context", 1, cut_len))) - F.when(cut, 1).otherwise(0)).alias("b"))
    w = ex.select("*", F.explode(F.sequence(F.lit(0), F.col("nwin") - 1)).alias("feature_idx"))
    t0 = F.col("feature_idx") * F.col("step")
    t1 = F.least(t0 + F.col("cap"), F.col("n"))
    w = w.withColumn("tok_start", t0).withColumn("tok_end", t1)
    cs = F.col("qlen") + 3                       # <s> question </s></s>
    inside = F.col("sc").isNotNull() & (F.col("tok_start") < F.col("a")) & (F.col("tok_end") - 1 >= F.col("b"))
    return w.select(
        *names, F.col("feature_idx").cast("int"), F.col("tok_start").cast("int"), F.col("tok_end").cast("int"),
        (cs + F.col("tok_end") - F.col("tok_start") + 1).cast("int").alias("seq_len"),
        F.when(inside, cs + F.least("a", "tok_end") - F.col("tok_start") - 1).otherwise(F.lit(0)).cast("int").alias("start_position"),
        F.when(inside, cs + F.least("b", "tok_end") - F.col("tok_start")).otherwise(F.lit(0)).cast("int").alias("end_position"))


def qa_offsets(examples: DataFrame, max_len: int = QA_MAX_LEN, stride: int = QA_STRIDE) -> DataFrame:
    """Per window the offsets of every sequence position, null outside
    the context.  No shuffle: a context is cut into blocks of ``step`` tokens, a
    window is the text of a few consecutive blocks, and where it begins is the
    sum of the lengths of the blocks before it.  The tokens of one window are
    the most that is ever held as an array.  A null or empty context has its
    one window, without offsets.
    """
    ex = _window_frame(examples, max_len, stride)
    names = example_keys(ex)
    span = F.ceil(F.col("cap") / F.col("step")).cast("int")

    def windows(b: Column) -> Column:
        before = running_sums(F.transform(b, lambda t: F.length(t)), 512)
        return F.transform(F.array(before), lambda ends: F.transform(
            F.sequence(F.lit(0), F.col("nwin") - 1), lambda k: F.struct(
                k.alias("feature_idx"), F.coalesce(F.get(ends, k - 1), F.lit(0)).alias("base"),
                F.array_join(F.slice(b, k + 1, span), "").alias("part"))))[0]

    blocks = F.coalesce(token_blocks(F.col("context"), F.col("step")), F.array().cast("array<string>"))
    w = ex.select(*names, "qlen", "cap", F.explode_outer(F.transform(F.array(blocks), windows)[0]).alias("w"))
    w = w.select(*names, "qlen", F.col("w.feature_idx").alias("feature_idx"),
                 F.slice(token_offsets(F.col("w.part"), F.col("w.base")), F.lit(1), F.col("cap")).alias("toks"))
    cs = F.col("qlen") + 3
    none = F.lit(None).cast("struct<s:int,e:int>")
    offsets = F.concat(F.array_repeat(none, cs), F.col("toks"), F.array(none))
    return w.select(*names, F.col("feature_idx").cast("int"), offsets.alias("offsets"))


def align_labels(word_ids: Column, labels: Column, ignore: int = -100, guarded: bool = False,
                 default: Column | None = None) -> Column:
    """A label for the first piece of each word, ``ignore`` for other
    pieces and specials (null word id).  ``guarded`` also ignores word ids past
    the label array; ``default`` replaces a null label."""
    def one(w, i):
        prev = F.get(word_ids, i - 1)
        lab = F.get(labels, w)
        if default is not None:
            lab = F.coalesce(lab, default)
        cond = w.isNull() | ((i > 0) & prev.isNotNull() & (prev == w))
        if guarded:
            cond = cond | (w >= F.size(labels))
        return F.when(cond, F.lit(ignore)).otherwise(lab)
    return F.transform(word_ids, one)
