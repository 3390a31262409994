"""Toxicity: a character n-gram classifier with naive Bayes features.

A text's features are the hashed character n-grams that occur in it.  Each is
scaled by its log-count ratio, the logarithm of how much more often toxic
texts have it than others, and a logistic regression weighs the scaled
features.  Counting is a Spark job over the training rows; the features whose
counts differ most between the classes are kept, so that a text's training
row is short; the regression is fitted on the driver from at most about
``MAX_TRAIN`` such rows, drawn by hash from all labelled ones.  Scoring reads
every whole text once, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import column, tmp
from .linear import fit_sparse, sigmoid

ORDERS = (3, 4, 5)
BITS = 18
#: Labelled rows that the classifier is fitted on, at most (by expectation).
MAX_TRAIN = 12_000
#: Features kept, and the least number of training texts that have one.
FEATURES = 4096
MIN_TEXTS = 4
#: Least chi-squared statistic of a feature against the class.
MIN_CHI = 10.0
THRESHOLD = 0.7
#: Penalty of a weight, as rows.
L2_ROWS = 0.3
_PIECE = 1 << 16
_ODD = (np.random.default_rng(3).integers(0, 1 << 32, max(ORDERS), dtype=np.uint32) | np.uint32(1))


def _hashes(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of a text's n-grams, with repeats, piece by piece."""
    over = max(ORDERS) - 1
    for k in range(0, len(text), _PIECE):
        piece = " " + text[max(0, k - over):k + _PIECE].lower() + " "
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in range(max(ORDERS)):
            if len(c) <= n:
                break
            h = h[:len(c) - n] + (c[n:] + np.uint32(n)) * _ODD[n]
            if n + 1 in ORDERS:
                x = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
                yield (x ^ np.uint32((n + 1) * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)


def features(text: str | None, keep: np.ndarray | None = None) -> np.ndarray:
    """The distinct features of a whole text, ascending; with ``keep`` (a mask) those of it only."""
    found = []
    for h in _hashes(text or ""):
        h = h if keep is None else h[keep[h]]
        found.append(np.unique(h))
        if len(found) > 64:
            found = [np.unique(np.concatenate(found))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


@dataclass
class Model:
    keep: np.ndarray        #: which of the 2 ** BITS features the model knows
    weight: np.ndarray      #: weight times log-count ratio of each feature
    bias: float

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.weight[features(text, self.keep)].sum() + self.bias))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    seen = np.zeros(2, np.int64)
    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["y"], strict=True):
            counts[y, features(text)] += 1
            seen[y] += 1
    hit = np.flatnonzero(counts.any(axis=0))
    yield pd.DataFrame({"f": np.r_[hit, -1], "no": np.r_[counts[0, hit], seen[0]], "yes": np.r_[counts[1, hit], seen[1]]})


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          max_train: int = MAX_TRAIN, n_features: int = FEATURES) -> Model:
    """Fit on the rows of ``docs`` that have a label.

    Labels other than 0 and 1 and null keys are ignored; of several labels of
    one key the largest counts.  Without rows of both classes the score is the
    share of toxic rows for every text (one half without any row).
    """
    lab = labels.select(column(labels, key).alias("k"), column(labels, label).cast("int").alias("y"))
    lab = lab.where("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    total = lab.count()
    share = min(1.0, max_train / max(1, total))

    def drawn(k: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(11), k), F.lit(1 << 30)) < int(share * (1 << 30))

    lab = materialize(lab.where(drawn(F.col("k"))), "toxic-labels")
    d = docs.select(column(docs, key).alias("k"), column(docs, text).alias("text")).where(drawn(F.col("k")))
    d = materialize(d.join(lab, "k").select("k", "text", "y"), "toxic-training")

    counts = d.select("text", "y").mapInPandas(_counted, "f long, no long, yes long").groupBy("f").agg(
        F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    counts = materialize(counts, "toxic-counts")
    rows = counts.where(F.col("f") < 0).first()
    no, yes = (rows.no, rows.yes) if rows else (0, 0)
    empty = np.zeros(1 << BITS)
    if not no or not yes:
        return Model(empty > 0, empty, float(np.log((yes + 0.5) / (no + 0.5))))
    # chi-squared of presence against the class, as an expression; the strongest features
    a, b = F.col("yes") / yes, F.col("no") / no
    p = (F.col("yes") + F.col("no")) / (yes + no)
    chi = F.pow(a - b, 2) / (p * (1 - p) + 1e-9) * (yes * no / (yes + no))
    top = counts.where((F.col("f") >= 0) & (F.col("yes") + F.col("no") >= MIN_TEXTS)).select(
        "f", F.log(((F.col("yes") + 1) / (yes + 2)) / ((F.col("no") + 1) / (no + 2))).alias("r"), chi.alias("chi"))
    top = top.where(F.col("chi") >= MIN_CHI).orderBy(F.col("chi").desc(), "f").limit(n_features).toPandas()
    keep = empty > 0
    keep[top["f"]] = True
    number = np.zeros(1 << BITS, np.int32)
    number[top["f"]] = np.arange(len(top))

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["f"] = [number[features(t, keep)].tobytes() for t in pdf["text"]]
            yield pdf[["k", "y", "f"]]

    of_key = dict(d.dtypes)["k"]
    x = d.mapInPandas(short, f"k {of_key}, y int, f binary").toPandas().sort_values("k", kind="stable")
    ratio = top["r"].to_numpy()
    w, bias = fit_sparse([np.frombuffer(r, np.int32) for r in x["f"]], ratio, x["y"].to_numpy(float),
                         L2_ROWS / max(1, len(x)))
    weight = empty.copy()
    weight[top["f"]] = w * ratio
    return Model(keep, weight, bias)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` plus ``score`` (0 to 1, higher: toxic likelier) and ``predicted``.

    Null and empty texts score as a text without any known feature.  Input
    columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights, whatever the data

    @F.arrow_udf("double")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in texts:  # one text at a time leaves the Arrow batch
            yield pa.array([float(shared.value.score(t.as_py())) for t in a], pa.float64())

    s = tmp("score")
    d = docs.select(*[column(docs, c) for c in docs.columns if c not in ("score", "predicted")],
                    of(column(docs, text)).alias(s))
    return d.select(*[column(d, c) for c in d.columns if c != s], F.col(s).alias("score"),
                    (F.col(s) >= threshold).cast("int").alias("predicted"))


def held_out(key: Column) -> Column:
    """Rows that the registered query never learns from (a null key counts as an empty text)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
