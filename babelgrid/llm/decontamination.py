"""Benchmark decontamination by spaced-seed hashing (native).

Texts and benchmark items become arrays of word hashes.  A mask such as
``1110111`` hashes the words under its ones and ignores the others, so two
passages that differ by a substitution under a zero still meet.  Every
position of every item is hashed under every mask; every position of every
text probes that table, and a hit is verified where it occurs: along the hit's
alignment, some window of the item must agree with the text in enough words.

Only the seeds of the benchmark are broadcast, in blocks of at most
``MAX_SEEDS`` (a larger benchmark takes more passes over the texts, one after
the other, each with a bounded table).  Texts are never shuffled: positions,
probes and the verification are one stage, and only verified overlaps leave it.

Spark holds all rows that one row of a stage makes until the next operator
takes them, so a hit must not carry its whole text or item: both are cut into
blocks of ``BLOCK`` positions that overlap as far as a window reaches.  What a
task holds at a time is then the hits of one block, whatever the text's length.

The masks find what a window of 13 words may differ in.  Items shorter than
the window are found by runs of up to three words, of which one is whole
wherever the allowed substitutions are.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import column, same, tmp

MASKS = ("1110111", "11011011", "110101101", "1100110011")
WINDOW = 13
SIMILARITY = 0.8
MAX_SEEDS = 500_000
#: Positions of a text or item that are looked up together.
BLOCK = 64
#: What separates words, which are compared in lower case.
GAP = r"[^\p{L}\p{N}]+"


#: Items of fewer words match as an exact sequence of words.
MIN_INEXACT = 7
#: Words of a seed of a short item, as far as its runs have so many.
SHORT_SEED = 3


def short_seeds(n: int, similarity: float = SIMILARITY) -> list[tuple[str, int]]:
    """Masks for an item of ``n`` words, of which ``similarity`` must agree, and where in the item each begins.

    With s words that may differ the item is cut into s + 1 runs, of which one
    stays whole wherever the s words are; its first words are the seed.  All
    short lengths so share the masks ``1``, ``11`` and ``111``, and a position of a
    text is probed under three more masks at most, whatever the benchmark.
    """
    s = 0 if n < MIN_INEXACT else sum(n - k >= n * similarity for k in range(1, n))
    starts = [k * n // (s + 1) for k in range(s + 2)]
    size = min(SHORT_SEED, *(b - a for a, b in zip(starts, starts[1:])))
    return [("1" * size, at) for at in starts[:-1]]


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), GAP), lambda w: F.length(w) > 0)
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def _seeds(h: Column, i: Column, masks: tuple[str, ...]) -> Column:
    """The seed hashes that start at position ``i``, null where a mask doesn't fit."""
    keys = []
    for mask in masks:
        picked = [F.get(h, i + k) for k, on in enumerate(mask) if on == "1"]
        keys.append(F.when(i + len(mask) <= F.size(h), F.xxhash64(F.lit(mask), *picked)))
    return F.array(*keys)


def _blocks(h: Column, step: int, reach: int) -> Column:
    """``h`` as blocks of ``step`` positions, with up to ``reach`` words before and after them: ``h``, the block's words,
    of which the positions begin at ``i0``, and ``at``, the place of its first word.  None of an empty ``h``."""
    def block(b: Column) -> Column:
        at = F.greatest(b - reach, F.lit(0))
        words = F.sequence(at, F.least(b + step + reach, F.size(h)) - 1)
        return F.struct(at.alias("at"), (b - at).alias("i0"), F.transform(words, lambda k: F.get(h, k)).alias("h"))
    return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), F.size(h) - 1, F.lit(step)), block))


def _positions(d: DataFrame, keep: list[str], step: int) -> DataFrame:
    """A row for each position ``i`` of each block."""
    at = F.sequence("i0", F.least(F.col("i0") + step, F.size("h")) - 1)
    return d.select(*keep, "h", F.explode(at).alias("i"))


def overlaps(docs: DataFrame, benchmark: DataFrame, keys: list[str], text: str = "text", item: str = "item_id",
             item_text: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW,
             similarity: float = SIMILARITY, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """One row (keys, item, matched, window) for each text and benchmark item
    that share a passage: ``matched`` of ``window`` aligned words agree at the
    best place, at least ``similarity`` of them.

    The window is ``window`` words, or the whole item where that is shorter;
    items of fewer than ``MIN_INEXACT`` words match as an exact sequence of
    words.  Null and empty items and texts match nothing.  Items with equal
    words are looked up once and all reported; repeated rows and rows with
    equal ``keys`` report once.
    """
    items = benchmark.select(column(benchmark, item).alias("item"),
                             word_hashes(column(benchmark, item_text)).alias("h"))
    items = items.where(F.size("h") > 0).groupBy("h").agg(
        F.collect_list(F.struct("item")).alias("items"))
    items = items.select(F.md5(F.array_join(F.col("h").cast("array<string>"), ",")).alias("id"), "h", "items",
                         F.size("h").alias("n"))
    step, reach = max(BLOCK, window), max(window, *map(len, masks))
    items = materialize(items, "benchmark-items")
    pieces = items.select("id", "n", F.explode(_blocks(F.col("h"), step, reach)).alias("b")).select("id", "n", "b.*")
    pieces = materialize(pieces.withColumn("piece", F.monotonically_increasing_id()), "benchmark-pieces")
    long = _positions(pieces.where(F.col("n") >= window), ["piece", "n", "at"], step).withColumnRenamed("i", "j")
    seeds = [long.select("piece", "n", "at", "j", F.posexplode(_seeds(F.col("h"), F.col("j"), masks)).alias("mask", "seed")).select(
        "piece", "n", "at", "j", F.array(*[F.lit(len(m)) for m in masks])[F.col("mask")].alias("span"), "seed")]
    sizes = items.where(F.col("n") < window).select("n").distinct()
    for n in sorted(r.n for r in sizes.collect()):  # fewer than ``window``: one block
        short = pieces.where(F.col("n") == n)
        for mask, at in short_seeds(n, similarity):
            seeds.append(short.select("piece", "n", "at", F.lit(at).alias("j"), F.lit(len(mask)).alias("span"),
                                      _seeds(F.col("h"), F.lit(at), (mask,))[0].alias("seed")))
            masks = masks if mask in masks else (*masks, mask)
    # the windows of the item that hold the seed begin between ``lo`` and ``hi``, places of the block as ``j``
    size = F.least(F.lit(window), F.col("n"))
    seeds = reduce(DataFrame.unionAll, seeds).where(F.col("seed").isNotNull()).select(
        "seed", "piece", "j", size.alias("window"),
        F.greatest(-F.col("at"), F.col("j") + F.col("span") - size).alias("lo"),
        F.least(F.col("j"), F.col("n") - size - F.col("at")).alias("hi"))
    seeds = materialize(seeds, "benchmark-seeds")
    parts = max(1, -(-seeds.count() // max_seeds))

    names = [tmp(f"k{n}") for n in range(len(keys))]
    d = docs.select(*[column(docs, k).alias(n) for k, n in zip(keys, names, strict=True)],
                    word_hashes(column(docs, text)).alias("h"))
    d = d.select(*names, F.explode(_blocks(F.col("h"), step, reach)).alias("b")).select(*names, "b.*")
    probes = _positions(d, names, step).select(*names, "h", "i", F.explode(_seeds(F.col("h"), F.col("i"), masks)).alias("seed"))
    found = []
    for part in range(parts):
        mine = F.pmod(F.xxhash64("piece"), F.lit(parts)) == part
        hits = probes.join(F.broadcast(seeds.where(mine)), "seed")
        hits = hits.select(*names, "piece", "h", (F.col("i") - F.col("j")).alias("shift"), "window", "lo", "hi")
        it = pieces.where(mine).select("piece", "id", F.col("h").alias("ih"))
        hits = hits.join(F.broadcast(it), "piece").select(
            *names, "id", "window", (F.col("hi") - F.col("lo")).alias("more"),
            F.transform(F.sequence("lo", F.col("hi") + F.col("window") - 1), lambda t: F.coalesce(
                F.get(F.col("h"), F.col("shift") + t) == F.get(F.col("ih"), t), F.lit(False)).cast("int")).alias("equal"))
        best = F.array_max(F.transform(F.sequence(F.lit(0), F.col("more")), lambda s: F.aggregate(
            F.slice("equal", s + 1, F.col("window")), F.lit(0), lambda a, x: a + x)))
        exact = F.col("window") < min(MIN_INEXACT, window)
        least = F.col("window") * F.when(exact, 1.0).otherwise(similarity)
        # no window has more equal words than all of them together; most hits end here
        hits = hits.where(F.size(F.filter("equal", lambda x: x == 1)) >= least)
        hits = hits.select(*names, "id", "window", least.alias("least"), best.alias("matched")).where(F.col("matched") >= F.col("least"))
        # one pass's tables at a time: those of a union would all be held together
        best = hits.groupBy(*names, "id").agg(F.max("matched").alias("matched"), F.max("window").alias("window"))
        found.append(best if parts == 1 else materialize(best, "overlaps"))
    found = reduce(DataFrame.unionAll, found)
    if parts > 1:
        found = found.groupBy(*names, "id").agg(F.max("matched").alias("matched"), F.max("window").alias("window"))
    ids = items.select("id", F.explode("items.item").alias("item")).distinct()
    return found.join(ids, "id").select(
        *[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("item").alias(item),
        F.col("matched").cast("long").alias("matched"), F.col("window").cast("long").alias("window"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  **how) -> DataFrame:
    """The rows of ``docs`` that share no passage with the benchmark, as ``overlaps`` finds them.

    A row is known by its key and text: repeated rows stay or go together,
    rows of one key with different texts are judged apart, null keys too.
    """
    k, t = tmp("key"), tmp("text")
    d = docs.select("*", column(docs, key).alias(k), F.xxhash64(column(docs, text)).alias(t))
    bad = materialize(overlaps(d, benchmark, [k, t], text, **how).select(k, t).distinct(), "contaminated").alias("b")
    d = d.alias("d").join(bad, same(F.col("d." + k), F.col("b." + k)) & (F.col("d." + t) == F.col("b." + t)),
                          "left_anti")
    return d.drop(k, t)


_WORDS = rf"list_filter(regexp_split_to_array(lower(text), '{GAP}'), lambda x: x <> '')"
_OFFSETS = ", ".join("(" + str([k for k, on in enumerate(m) if on == "1"]) + f", {len(m)})" for m in MASKS)
SQL = f"""
WITH m(o, span) AS (VALUES {_OFFSETS}),
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
dp AS (SELECT doc_id, r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
bp AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM b),
ds AS (SELECT r, i, o, list_transform(o, lambda k: w[i + k]) AS s FROM dp, m WHERE i + span - 1 <= len(w)),
bs AS (SELECT item_id, i, o, list_transform(o, lambda k: w[i + k]) AS s FROM bp, m WHERE i + span - 1 <= len(w)),
hit AS (SELECT DISTINCT ds.r, bs.item_id, ds.i - bs.i AS d FROM ds JOIN bs ON ds.s = bs.s AND ds.o = bs.o),
eq AS (
  SELECT d.doc_id, b.item_id, least({WINDOW}, len(b.w)) AS win, len(b.w) AS n,
         list_transform(range(1, len(b.w) + 1), lambda t: CASE
           WHEN t + hit.d >= 1 AND t + hit.d <= len(d.w) AND d.w[t + hit.d] = b.w[t] THEN 1 ELSE 0 END) AS e
  FROM hit JOIN d USING (r) JOIN b USING (item_id)),
best AS (SELECT doc_id, item_id, win,
         list_max(list_transform(range(1, n - win + 2), lambda s: list_sum(e[s:s + win - 1]))) AS k FROM eq)

SELECT doc_id, item_id, max(k)::BIGINT AS matched, max(win)::BIGINT AS "window" FROM (
  SELECT doc_id, item_id, win, k FROM best WHERE win = {WINDOW}
  -- items shorter than the window: every alignment that lets all but a fifth of the words agree
  UNION ALL
  SELECT doc_id, item_id, len(v) AS win, list_sum(list_transform(range(1, len(v) + 1), lambda t: CASE
         WHEN t + d >= 1 AND t + d <= len(w) AND w[t + d] = v[t] THEN 1 ELSE 0 END)) AS k
  FROM (SELECT d.doc_id, d.w, s.item_id, s.v, unnest(range(-len(s.v), len(d.w))) AS d
        FROM d, (SELECT item_id, w AS v FROM b WHERE len(w) BETWEEN 1 AND {WINDOW} - 1) s) x) y
WHERE k >= win * CASE WHEN win < {MIN_INEXACT} THEN 1 ELSE {SIMILARITY} END GROUP BY doc_id, item_id
"""
