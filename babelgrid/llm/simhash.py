"""SimHash near-dedup with pivot distance tables.

Fingerprints are linked when they differ in at most ``max_bits`` bits.  The
candidates come from tables of Hamming distances to reference fingerprints
(pivots):

* The 64 bits are cut into ``max_bits + 3`` bands, each with its own random
  pivots.  Differing bits touch at most ``max_bits`` bands, so three bands at
  least are untouched, and a pivot's distance relative to the zero pivot's,
  d(x, p) - d(x, 0), depends on the pivot's band alone: two linked
  fingerprints have the same distances to all pivots of some three bands.  The
  hash of these distances is a join key; one row per choice of three bands.
* Pairs that meet are discarded by the largest difference between their
  distances to pivots over the whole width (it never exceeds the distance
  between the two), and survivors are verified bit by bit.

Equal fingerprints are one row throughout, so a group of copies costs one
fingerprint, whatever its size, and pairs are of distinct fingerprints only.
Components come from alternating large-star and small-star rounds over the
links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import column, same, tmp

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Pivots of a band, and pivots over the whole width (8 bits each in a long).
BAND_PIVOTS = 14
WIDE_PIVOTS = 8
_CHUNK = 1 << 15
_SPACE = bytes([32, *range(9, 14)])
_TO_SPACE = bytes.maketrans(_SPACE, b" " * 6)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, unsigned.

    A-Z in lower case; words are runs without ASCII white space; shingles
    joined by one space, repeats included, hashed by XXH64 (UTF-8, seed 42); a
    bit is set when it is set in over half the hashes.  Fewer words than a
    shingle: the whole sequence is one.  No word (or null): 0.  The text is
    read in pieces of shingles, so a very long one needs a few times its size.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).translate(_TO_SPACE)
    b = np.frombuffer(raw, np.uint8) != 32
    edge = np.flatnonzero(np.diff(b, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return 0
    if (starts[1:] - ends[:-1] > 1).any():  # longer gaps: join the words anew
        raw = b" ".join(raw.split())
        gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
    last = min(shingle, len(starts)) - 1
    starts, ends = starts[:len(starts) - last], ends[last:]
    counts = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for k in range(0, len(starts), _CHUNK):
        pairs = zip(starts[k:k + _CHUNK].tolist(), ends[k:k + _CHUNK].tolist(), strict=True)
        h = np.fromiter((hashed(raw[i:j], SEED) for i, j in pairs), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """``fingerprint`` as a long column (two's complement); one text at a time
    leaves the Arrow batch."""
    @F.arrow_udf("long")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in texts:
            yield pa.array(np.fromiter((fingerprint(t.as_py(), shingle) for t in a), np.uint64, len(a)).view(np.int64))
    return of(text)


def _pivots(max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Band pivots [bands, BAND_PIVOTS] and wide pivots, unsigned."""
    rng = np.random.default_rng(SEED)
    cuts = np.linspace(0, 64, max_bits + 4).round().astype(int)
    bands = []
    for lo, hi in itertools.pairwise(cuts):
        mask = np.uint64(((1 << int(hi)) - 1) ^ ((1 << int(lo)) - 1))
        bands.append(rng.integers(0, 1 << 64, BAND_PIVOTS, dtype=np.uint64) & mask)
    return np.array(bands), rng.integers(0, 1 << 64, WIDE_PIVOTS, dtype=np.uint64)


def pivot_table(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp) to (fp, wide, keys): distances to the wide pivots, a byte each, and
    the key of every choice of three bands."""
    band, wide = _pivots(max_bits)
    choices = list(itertools.combinations(range(len(band)), 3))
    rng = np.random.default_rng(SEED + 1)
    mixer = rng.integers(0, 1 << 64, (len(choices), 3 * BAND_PIVOTS), dtype=np.uint64) | np.uint64(1)
    salt = rng.integers(0, 1 << 64, len(choices), dtype=np.uint64)

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            zero = np.bitwise_count(x).astype(np.int64)
            dist = np.bitwise_count(x[:, None, None] ^ band[None]).astype(np.int64) - zero[:, None, None]
            keys = np.empty((len(x), len(choices)), np.uint64)
            for n, c in enumerate(choices):
                coords = dist[:, c, :].reshape(len(x), -1).view(np.uint64)
                k = (coords * mixer[n]).sum(axis=1, dtype=np.uint64) + salt[n]
                k ^= k >> np.uint64(32)
                keys[:, n] = k * np.uint64(0x9E3779B97F4A7C15)
            far = np.bitwise_count(x[:, None] ^ wide[None]).astype(np.uint8)
            yield pd.DataFrame({"fp": pdf["fp"], "wide": far.view(np.int64)[:, 0],
                                "keys": list(keys.view(np.int64))})

    return fps.select("fp").mapInPandas(table, "fp long, wide long, keys array<long>")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at most ``max_bits`` apart, once each."""
    table = pivot_table(fps, max_bits).select("fp", "wide", F.posexplode("keys").alias("n", "key"))
    a, b = table.alias("a"), table.alias("b")

    def byte(side: str, k: int) -> Column:
        return F.shiftrightunsigned(F.col(side + ".wide"), 8 * k).bitwiseAND(F.lit(255))

    apart = F.greatest(*[F.abs(byte("a", k) - byte("b", k)) for k in range(WIDE_PIVOTS)])
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    meet = ((F.col("a.key") == F.col("b.key")) & (F.col("a.n") == F.col("b.n")) & (F.col("a.fp") < F.col("b.fp"))
            & (apart <= max_bits) & (close <= max_bits))
    pairs = a.join(b, meet).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    return pairs.distinct()


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links to (node, root), for nodes with a link; root is the smallest node reachable.

    Large star: every larger neighbour of a node is linked to the smallest
    node of its neighbourhood.  Small star: the smaller neighbours and the
    node itself are.  Until nothing changes; each round's links are a table in
    the shared folder.
    """
    edges = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "star")
    seen = None
    for _ in range(max_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: key, ``text_hash`` (which tells rows of one
    key apart), ``fingerprint`` (16 hex digits), ``component_id`` (the smallest
    key reachable over links, its own included), ``component_size`` (rows) and
    ``first_hash`` (the text of the component's first row).

    Null and empty texts have fingerprint zero, linked like any other; null
    keys come last in the minimum, so only a component of null keys has a null
    id; repeated rows are linked, as their fingerprints are equal; an empty
    table has no components.
    """
    t = column(docs, text)
    d = docs.select(column(docs, key).alias("key"), F.xxhash64(t).alias("text_hash"),
                    fingerprints(t, shingle).alias("fp"))
    d = materialize(d, "simhash")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_hash"))
    one = materialize(d.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "simhash-fps")
    root = components(links(one, max_bits))
    one = one.join(root, one["fp"] == root["node"], "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    groups = one.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("component_size"))
    of = one.select("fp", "root").join(groups, "root").select("fp", "first", "component_size")
    of = materialize(of, "simhash-components")
    return d.join(of, "fp").select(
        F.col("key").alias(key), "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.key").alias("component_id"), "component_size", F.col("first.text_hash").alias("first_hash"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the row with
    the smallest key stays (null keys last; of equal keys the one with the
    smaller text hash; of rows equal in both the one whose columns come first
    as JSON).

    Rows meet a narrow table once: that of the (key, text hash) which goes or
    is repeated.  Only repeated rows are read a second time, where there are any.
    """
    k, t = tmp("key"), tmp("text")
    near = materialize(near_duplicates(docs.select(column(docs, key).alias(k), column(docs, text).alias(t)), k, t,
                                       **how), "simhash-near")
    stays = same(F.col(k), F.col("component_id")) & same(F.col("text_hash"), F.col("first_hash"))
    verdict = near.groupBy(k, "text_hash").agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    verdict = materialize(verdict.where("not stays or n > 1"), "simhash-verdicts")
    d = docs.select("*", column(docs, key).alias(k), F.xxhash64(column(docs, text)).alias(t))

    def at(o: DataFrame) -> Column:
        return same(d[k], o[k]) & (d[t] == o["text_hash"])

    once = d.join(verdict, at(verdict), "left_anti").drop(k, t)
    again = verdict.where("stays")
    if again.isEmpty():
        return once
    row = F.struct(*[column(d, c) for c in docs.columns])
    one = d.join(again, at(again), "left_semi").groupBy(k, t).agg(
        F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias("row"))
    return once.unionAll(one.select("row.*"))
