"""Removal of word sequences that an earlier document has, by recompression.

1. ``facts``: words and the name of the topmost symbol, the whole document
   (its SHA-256).  Whole copies are settled by that name alone.
2. Rounds of recompression (``recompression.py``) name runs and pairs of
   words; a window is known by one group of symbols that are sure wherever it
   occurs, and only those groups are exchanged, about a quarter of the words.
3. Groups found in two documents send the window names of the places they
   stand for; of equal windows the smallest document is first.
4. Words covered by a window that isn't its first document's go.

Names are 64-bit hashes, so a group may be shared by accident, which only adds
candidates; windows are compared by 128 bits.

Hot strings: a task sends a group or window once however many of its documents
have it.  The others are settled there and then (their task holds a smaller
document), and pass the exchange under a salted key.  A string in a third of
all documents so costs its group one row per batch of ``BATCH`` words.
Texts are shuffled once, to meet their candidates, and those with candidates
once more, to meet their removals.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import column, same
from .recompression import anchors, token_names, window_names

WINDOW = 13
#: Symbols in a group; 4 of the first round span 4 to 8 words and more where words repeat.
GROUP = 4
#: Words parsed together in a task; documents are never cut.
BATCH = 200_000


def rounds_for(window: int) -> int:
    """Rounds after which a window still has sure symbols: a round leaves about three of four."""
    return max(1, 1 + int(math.log(max(window, 1) / WINDOW, 4 / 3)))


def split(text: str | None) -> list[bytes]:
    """Words: what the six ASCII white-space characters separate."""
    return (text or "").encode().split()


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_FACTS = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("whole", pa.string())])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, tags, texts = b.columns
        n, whole = [], []
        for t in texts:
            words = split(t.as_py())
            n.append(len(words))
            whole.append(_sha(words))
        yield pa.RecordBatch.from_arrays([ids, tags, pa.array(n, pa.int64()), pa.array(whole)], schema=_FACTS)


def _together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Rows with their words in place of the text (last column), about ``size`` words at a time."""
    rows, n = [], 0
    for b in batches:
        for k in range(b.num_rows):
            *head, text = (c[k] for c in b.columns)
            words = split(text.as_py())
            rows.append((*head, words))
            n += len(words)
            if n >= size:
                yield rows
                rows, n = [], 0
    if rows:
        yield rows


def _joined(rows: list[tuple], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of all words with a wall after each document; (names, wall, row, start) of
    these and of the windows within documents."""
    sizes = np.array([len(r[-1]) + 1 for r in rows])
    ends = np.cumsum(sizes)
    names, wall = np.empty(ends[-1], np.uint64), np.zeros(ends[-1], bool)
    wall[ends - 1] = True
    names[ends - 1] = 0
    for r, end, size in zip(rows, ends, sizes, strict=True):
        names[end - size:end - 1] = token_names(r[-1])
    start = np.concatenate([np.arange(e - s, e - window) for e, s in zip(ends, sizes, strict=True) if s > window] or [np.empty(0, int)])
    return names, wall, np.searchsorted(ends, start, side="right"), start


def _first_of(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of its group, group has several ids) for rows sorted by keys, then id."""
    order = np.lexsort((ids, *reversed(keys)))
    new = np.ones(len(order), bool)
    changed = np.zeros(max(len(order) - 1, 0), bool)
    for k in keys:
        k = k[order]
        changed |= k[1:] != k[:-1]
    new[1:] = changed
    group = np.cumsum(new) - 1
    lowest = ids[order][new][group]
    highest = np.maximum.reduceat(ids[order], np.flatnonzero(new))[group] if len(order) else lowest
    return order, ids[order] == lowest, highest > lowest


_KEYS = pa.schema([("key", pa.int64()), ("salt", pa.int64()), ("id", pa.int64()), ("known", pa.bool_())])


def _key_rows(window: int, rounds: int, group: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(batches, BATCH):
            least: dict[bytes, tuple] = {}  # of whole copies the smallest speaks for all
            for i, words in ((r[0].as_py(), r[1]) for r in rows):
                whole = hashlib.sha256(b" ".join(words)).digest()
                if whole not in least or i < least[whole][0]:
                    least[whole] = (i, words)
            rows = [r for r in least.values() if len(r[1]) >= window]
            if not rows:
                continue
            names, wall, row, start = _joined(rows, window)
            keys = anchors(names, wall, window, rounds, (group,) * rounds)[start]
            both = np.unique(np.rec.fromarrays([keys.view(np.int64), np.array([r[0] for r in rows])[row]]))
            keys, ids = both.f0, both.f1
            order, first, several = _first_of([keys], ids)
            keys, ids = keys[order], ids[order]
            salt = np.where(first, 0, 1 + (ids & 0xFFFFF))
            for k in range(0, len(keys), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[part]), pa.array(salt[part]), pa.array(ids[part]), pa.array(several[part])], schema=_KEYS)
    return emit


_WINDOWS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("salt", pa.int64()), ("id", pa.int64()), ("tag", pa.int64()),
                      ("starts", pa.list_(pa.int32()))])


def _window_rows(window: int, rounds: int, group: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(batches, BATCH):
            rows = [r for r in rows if len(r[-1]) >= window]
            if not rows:
                continue
            names, wall, row, start = _joined(rows, window)
            keys = anchors(names, wall, window, rounds, (group,) * rounds)[start].view(np.int64)
            wanted = np.zeros(len(start), bool)
            edge = np.searchsorted(row, np.arange(len(rows) + 1))
            for k, r in enumerate(rows):
                mine = slice(edge[k], edge[k + 1])
                wanted[mine] = np.isin(keys[mine], r[2].values.to_numpy())
            offset = start[edge[:-1]]
            row, start = row[wanted], start[wanted]
            a, b = (window_names(names, window, seed)[start].view(np.int64) for seed in (3, 4))
            ids = np.array([r[0].as_py() for r in rows])[row]
            tags = np.array([r[1].as_py() for r in rows])[row]
            at = (start - offset[row]).astype(np.int32)
            # one row per window and document, with all its places
            order = np.lexsort((at, tags, ids, b, a))
            a, b, ids, tags, at = (x[order] for x in (a, b, ids, tags, at))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
            cut = np.append(np.flatnonzero(new), len(a)).astype(np.int32)
            a, b, ids, tags = (x[new] for x in (a, b, ids, tags))
            order, first, _ = _first_of([a, b], ids)
            salt = np.empty(len(a), np.int64)
            salt[order] = np.where(first, 0, 1 + (ids[order] & 0xFFFFF))
            for k in range(0, len(a), 50_000):
                part, cuts = slice(k, k + 50_000), cut[k:k + 50_001]
                starts = pa.ListArray.from_arrays(pa.array(cuts - cuts[0]), pa.array(at[cuts[0]:cuts[-1]]))
                yield pa.RecordBatch.from_arrays([*[pa.array(x[part]) for x in (a, b, salt, ids, tags)], starts], schema=_WINDOWS)
    return emit


def uncovered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words no window from ``starts`` covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change)[:n] == 0


_KEPT = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _kept_rows(window: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                i, tag, starts, text = (c[k] for c in b.columns)
                words = split(text.as_py())
                good = uncovered(len(words), starts.values.to_numpy().astype(np.int64), window)
                out.append((i.as_py(), tag.as_py(), int((~good).sum()),
                            b" ".join([words[n] for n in np.flatnonzero(good)]).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _KEPT)], schema=_KEPT)
    return emit


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(facts, kept): (id, tag, n_words, whole, copy) of every row, and (id, tag,
    n_removed, kept) of those that lose words without being whole copies; ``tag`` is the
    text's hash, ``kept`` the words that stay joined by one space."""
    rounds = rounds_for(window)
    d = docs.select(column(docs, key).cast("long").alias("id"), F.xxhash64(column(docs, text)).alias("tag"), column(docs, text).alias("text"))
    facts = materialize(d.mapInArrow(_facts, "id long, tag long, n_words long, whole string"), "substring-facts")
    # a table of its own, of copied texts only: a text with very many copies is a skewed join, which Spark splits
    first = facts.where("id IS NOT NULL").groupBy("whole").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    first = materialize(first.where("first < last").select("whole", "first"), "substring-firsts")
    facts = materialize(facts.join(first, "whole", "left").select(
        "id", "tag", "n_words", "whole", F.coalesce(F.col("first") < F.col("id"), F.lit(False)).alias("copy")), "substring-copies")

    known = d.where("id IS NOT NULL")
    keys = known.select("id", "text").mapInArrow(_key_rows(window, rounds, group), "key long, salt long, id long, known boolean")
    w = Window.partitionBy("key", "salt")
    keys = keys.select("key", "id", (F.col("known") | (F.min("id").over(w) < F.max("id").over(w))).alias("shared")).where("shared")
    open_ = facts.where(~F.col("copy") & (F.col("n_words") >= window)).select("id").distinct()
    keys = materialize(keys.groupBy("id").agg(F.collect_set("key").alias("keys")).join(open_, "id", "left_semi"), "substring-keys")

    found = materialize(known.join(keys, "id").select("id", "tag", "keys", "text"), "substring-candidates")
    rows = found.mapInArrow(_window_rows(window, rounds, group), "a long, b long, salt long, id long, tag long, starts array<int>")
    w = Window.partitionBy("a", "b", "salt")
    later = rows.select("id", "tag", "starts", "salt", F.min("id").over(w).alias("first")).where("salt <> 0 OR first < id")
    later = later.groupBy("id", "tag").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    later = materialize(later, "substring-places")
    kept = found.select("id", "tag", "text").join(later, ["id", "tag"]).select("id", "tag", "starts", "text")
    return facts, kept.mapInArrow(_kept_rows(window), "id long, tag long, n_removed long, kept string")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """One row (key, n_words, n_removed, kept_sha256) per row of ``docs``.

    A word goes if a window of ``window`` words that covers it starts in a row
    with a smaller key, judged on the input.  Rows of one key don't outrank
    each other; rows without a key neither lose words nor make others lose
    any.  Null and empty texts have no words; repeated rows give equal rows.
    """
    facts, kept = repeats(docs, key, text, window, group)
    kept = kept.select("id", "tag", "n_removed", F.sha2("kept", 256).alias("sha")).distinct()
    kept = materialize(kept, "substring-kept").select(*[F.col(c).alias(f"k_{c}") for c in ("id", "tag", "n_removed", "sha")])
    d = facts.join(kept, same(F.col("id"), F.col("k_id")) & (F.col("tag") == F.col("k_tag")), "left")
    gone = F.col("copy") & (F.col("n_words") >= window)
    return d.select(F.col("id").alias(key), "n_words",
                    F.when(gone, F.col("n_words")).otherwise(F.coalesce("k_n_removed", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(gone, F.lit(_sha([]))).otherwise(F.coalesce("k_sha", "whole")).alias("kept_sha256"))


SQL = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS MATERIALIZED (
  SELECT r, doc_id, i, sha256(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS k
  FROM (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}) x),
f AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS j FROM win JOIN f USING (k) WHERE m < doc_id),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY j) FILTER (g IS NULL) AS t, count(g) AS n
  FROM (SELECT word.r, x, word.j, gone.j AS g FROM word LEFT JOIN gone ON gone.r = word.r AND gone.j = word.j) y GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
