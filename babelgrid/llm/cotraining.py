"""Quality classifier by co-training of two views.

One classifier sees what a text says (content statistics), the other what is
recorded about it (language, source, recorded length).  They start from the
labelled rows; in each round either labels the unlabelled rows that it is most
confident about, by the rank of its calibrated probability among all rows, for
the other one's training set.  A view has its own bound: a row must be likelier
in the class than a labelled row taken blindly.  What is passed on is the
calibrated probability as a soft label, so that a weak view teaches as much as
it knows and no more.
At the end both are calibrated on labelled rows held out of their training,
combined by a logistic regression on their log odds, and score every row.

Fitting takes at most about ``MAX_LABELLED`` labelled rows, by hash, as small
vectors on the driver.  Each round is a pass over all unlabelled rows, of which
the most confident per view and class reach the driver; scoring is one pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import column, tmp
from .linear import fit_dense, logit, sigmoid

MAX_LABELLED = 8_000
ROUNDS = 4
#: Pseudo-labels a round and class, as a share of the labelled rows.
GROWTH = 0.1
THRESHOLD = 0.5
META_BUCKETS = 64
_SPACES = " \t\n\x0b\x0c\r"
_MARKS = "#*$%&|<>!?.,;:-_=+/\\'\"()[]{}@~^"
_STATS = 11


def content(text: str | None) -> np.ndarray:
    """The text view: statistics of the whole text, each about zero for none."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = max(1, len(words))
    chars = max(1, len(text) - sum(map(text.count, _SPACES)))
    low, up = text.lower(), text.upper()
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    marks = sum(map(text.count, _MARKS))
    capital = 0
    if text and text != low:
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        b = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        capital = int((a != b).sum()) if len(a) == len(b) else sum(map(str.isupper, text))
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return np.array([
        np.log1p(len(words)), np.log(chars / n), np.sqrt(symbols / n), np.sqrt(text.count("!") / n),
        np.sqrt(marks / chars), np.sqrt(capital / chars), np.sqrt(twice / n), len(set(words)) / n ** 0.9,
        np.sqrt((len(lines) - len(set(lines))) / max(1, len(lines))), np.log1p(n / max(1, len(lines))),
        np.sqrt(sum(map(text.count, "0123456789")) / chars) + (low == up)])


def metadata(lang, source, n_chars) -> np.ndarray:
    """The metadata view: hashed language and source, and the recorded length."""
    x = np.zeros(META_BUCKETS + 2)
    for name, v in (("lang", lang), ("source", source)):
        x[zlib.crc32(f"{name}={v}".encode("utf-8", "surrogatepass")) % META_BUCKETS] += 1
    if n_chars is not None and n_chars == n_chars:
        x[-2] = np.log1p(max(0.0, float(n_chars)))
    else:
        x[-1] = 1
    return x


@dataclass
class View:
    """Logistic regression on scaled features, their sizes and squares, with a calibration."""
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0
    share: float = 0.5  #: of class 1 among labelled rows: what the view must exceed to speak for a class

    @staticmethod
    def wide(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        z = np.clip((x - mean) / scale, -6, 6)
        return np.hstack([z, np.abs(z), z * z / 6])

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> View:
        mid, spread = np.median(x, axis=0), x.std(axis=0)
        iqr = (np.percentile(x, 75, axis=0) - np.percentile(x, 25, axis=0)) / 1.349
        scale = np.where(iqr > 0.05 * spread, iqr, spread) + 1e-3
        w, bias = fit_dense(cls.wide(x, mid, scale), y, l2=1e-3)
        return cls(mid, scale, w, bias, share=float(y.mean()))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> View:
        """Scale and shift of the log odds on rows not trained on; the scale is never negative."""
        if 0 < y.sum() < len(y):
            w, b = fit_dense(self.odds(x)[:, None], y, l2=1e-2)
            self.a, self.b = self.a * max(0.0, w[0]), b + max(0.0, w[0]) * self.b
            self.share = float(y.mean())
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.a * (self.wide(x, self.mean, self.scale) @ self.w + self.bias) + self.b


@dataclass
class Model:
    text: View | None
    meta: View | None
    mix: np.ndarray
    bias: float
    pseudo: tuple = ()  #: per round: rows the text view labelled, rows the metadata view labelled

    def score(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            p = np.full(len(t), sigmoid(np.array(self.bias)))
            return p, p, p
        a, b = self.text.odds(t), self.meta.odds(m)
        return sigmoid(a), sigmoid(b), sigmoid(np.c_[a, b] @ self.mix + self.bias)


def _pick(p: np.ndarray, free: np.ndarray, most: int, share: float, tie: np.ndarray | None = None
          ) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` free rows likeliest in either class, of those likelier in it than its share,
    and the class; equal ones in the order of ``tie``."""
    tie = np.arange(len(p)) if tie is None else tie
    rows, labels = [], []
    for y, q, least in ((1, p, share), (0, 1 - p, 1 - share)):
        sure = np.flatnonzero(free & (q > least))
        sure = sure[np.lexsort((tie[sure], -q[sure]))][:most]
        rows.append(sure)
        labels.append(np.full(len(sure), y))
    return np.concatenate(rows), np.concatenate(labels)


#: Views and a number of rows to, for each view, the features and soft labels of the rows that the other one passes on.
Best = Callable[[dict[str, View], int], dict[str, tuple[np.ndarray, np.ndarray]]]


def cotrain(lt: np.ndarray, lm: np.ndarray, y: np.ndarray, ut: np.ndarray, um: np.ndarray,
            rounds: int = ROUNDS) -> Model:
    """Co-train on labelled rows (both views, labels) and unlabelled rows (both views)."""
    free = {"t": np.ones(len(ut), bool), "m": np.ones(len(ut), bool)}

    def best(views: dict[str, View], most: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for teacher, pupil, ux, px in (("t", "m", ut, um), ("m", "t", um, ut)):
            p = sigmoid(views[teacher].odds(ux))
            rows, _ = _pick(p, free[pupil], most, views[teacher].share)
            free[pupil][rows] = False
            out[pupil] = px[rows], p[rows]
        return out

    return exchange(lt, lm, y, best, rounds)


def exchange(lt: np.ndarray, lm: np.ndarray, y: np.ndarray, best: Best, rounds: int = ROUNDS) -> Model:
    """Co-train on labelled rows; ``best`` gives each round's rows from the unlabelled ones, each to a view once."""
    hold = np.arange(len(y)) % 4 == 0  # calibrates and combines; rows come in the order of a hash
    tr = ~hold
    if min(y[tr].sum(), (1 - y[tr]).sum(), y[hold].sum(), (1 - y[hold]).sum()) < 1:
        return Model(None, None, np.zeros(2), float(np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5))))
    given = {"t": [(lt[tr], y[tr])], "m": [(lm[tr], y[tr])]}  # training rows of each view
    counts = []
    for k in range(rounds + 1):
        views = {}
        for v, lx in (("t", lt), ("m", lm)):
            views[v] = View.fit(np.vstack([x for x, _ in given[v]]),
                                np.concatenate([labels for _, labels in given[v]]).astype(float))
            views[v].calibrate(lx[hold], y[hold].astype(float))
        if k == rounds:
            break
        got = best(views, max(1, int(GROWTH * tr.sum())))
        for v, rows in got.items():
            given[v].append(rows)
        counts.append((len(got["m"][1]), len(got["t"][1])))
        if not any(counts[-1]):
            break
    mix, bias = fit_dense(np.c_[views["t"].odds(lt[hold]), views["m"].odds(lm[hold])], y[hold].astype(float), l2=1e-2)
    return Model(views["t"], views["m"], mix, bias, tuple(counts))


def best_of(pool: DataFrame) -> Best:
    """``exchange``'s rows from all rows of ``pool`` (h, t, lang, source, n_chars).

    A round is one pass: each task keeps its most confident rows per view and
    class, and the best of those over all tasks reach the driver.  ``h`` breaks
    ties; rows of one ``h`` are repeated rows, passed on in one round only.
    """
    used = {"t": np.zeros(0, np.int64), "m": np.zeros(0, np.int64)}
    dims = {"t": _STATS, "m": META_BUCKETS + 2}

    def best(views: dict[str, View], most: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = []
            for pdf in batches:
                h = pdf["h"].to_numpy(np.int64)
                x = {"t": np.frombuffer(b"".join(pdf["t"]), np.float64).reshape(-1, _STATS),
                     "m": np.array([metadata(*r) for r in zip(pdf["lang"], pdf["source"], pdf["n_chars"], strict=True)]
                                   ).reshape(-1, META_BUCKETS + 2)}
                for teacher, pupil in (("t", "m"), ("m", "t")):
                    p = sigmoid(views[teacher].odds(x[teacher]))
                    rows, labels = _pick(p, ~np.isin(h, used[pupil]), most, views[teacher].share, h)
                    kept.append(pd.DataFrame({
                        "pupil": pupil, "y": labels, "q": np.where(labels == 1, p[rows], 1 - p[rows]), "h": h[rows],
                        "x": [r.tobytes() for r in x[pupil][rows]]}))
                kept = [pd.concat(kept).sort_values(["q", "h"], ascending=[False, True], kind="stable")
                        .groupby(["pupil", "y"]).head(most)]
            yield from kept

        found = materialize(pool.mapInPandas(top, "pupil string, y int, q double, h long, x binary"), "cotrain-best")
        out = {}
        for v in ("t", "m"):
            rows = [r for y in (1, 0) for r in found.where((F.col("pupil") == v) & (F.col("y") == y)).orderBy(
                F.col("q").desc(), "h").limit(most).collect()]
            used[v] = np.unique(np.r_[used[v], np.array([r.h for r in rows], np.int64)])
            out[v] = (np.frombuffer(b"".join(r.x for r in rows), np.float64).reshape(-1, dims[v]),
                      np.array([r.q if r.y else 1 - r.q for r in rows], float))
        return out

    return best


def _views(docs: DataFrame, text: str, meta: tuple[str, str, str], extra: list[Column]) -> DataFrame:
    """``extra`` columns, the text view and what the metadata view is made of, for every row."""
    names = [f"c{i}" for i in range(len(extra))]
    d = docs.select(*[c.alias(n) for c, n in zip(extra, names, strict=True)], column(docs, text).alias("text"),
                    column(docs, meta[0]).alias("lang"), column(docs, meta[1]).alias("source"),
                    column(docs, meta[2]).cast("double").alias("n_chars"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # one text at a time leaves the Arrow batch
            seen = pa.array([content(t.as_py()).tobytes() for t in b.column("text")], pa.binary())
            rest = ["lang", "source", "n_chars"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], seen, *[b.column(n) for n in rest]],
                                             names=[*names, "t", *rest])

    kinds = dict(d.dtypes)
    return d.mapInArrow(of, ", ".join([f"{n} {kinds[n]}" for n in names] + ["t binary"] + [
        f"{n} {kinds[n]}" for n in ("lang", "source", "n_chars")]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          meta: tuple[str, str, str] = ("lang", "source", "n_chars"), max_labelled: int = MAX_LABELLED,
          rounds: int = ROUNDS) -> Model:
    """Fit from labelled rows of ``docs``, at most about ``max_labelled``, and all rows without a label.

    Labels other than 0 and 1 and null keys are ignored; of several labels of
    a key the largest counts.  With too few rows of a class to train and
    calibrate, every text scores the labelled share of good rows.
    """
    # keys as text: pandas would turn longs with nulls into floats
    lab = labels.select(column(labels, key).cast("string").alias("k"), column(labels, label).cast("int").alias("y"))
    lab = lab.where("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    lab = materialize(lab, "cotrain-labels")
    n_lab = lab.count()
    k = column(docs, key).cast("string")
    order = F.pmod(F.xxhash64(F.lit(4), k), F.lit(1 << 30))
    row = F.xxhash64(F.lit(4), k, *[column(docs, c) for c in (text, *meta)])
    x = materialize(_views(docs, text, meta, [k, order, row]), "cotrain-views")
    known = x.where(F.col("c1") < int(min(1.0, max_labelled / max(1, n_lab)) * (1 << 30)))
    a = known.join(lab, known["c0"] == lab["k"]).select("c1", "c0", "y", "t", "lang", "source", "n_chars").toPandas()
    a = a.sort_values(["c1", "c0", "t"], kind="stable")
    # rows without a key need no join, which would bring them together
    free = x.where("c0 is not null").join(lab, x["c0"] == lab["k"], "left_anti").unionAll(x.where("c0 is null"))
    pool = materialize(free.select(F.col("c2").alias("h"), "t", "lang", "source", "n_chars"), "cotrain-pool")
    lt = np.frombuffer(b"".join(a["t"]), np.float64).reshape(-1, _STATS)
    lm = np.array([metadata(*r) for r in zip(a["lang"], a["source"], a["n_chars"], strict=True)])
    return exchange(lt, lm.reshape(-1, META_BUCKETS + 2), a["y"].to_numpy(int), best_of(pool), rounds)


def score(docs: DataFrame, model: Model, text: str = "text",
          meta: tuple[str, str, str] = ("lang", "source", "n_chars"), threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` plus ``text_score``, ``meta_score``,
    ``score`` (the calibrated combination) and ``kept``.

    Null and empty texts have the statistics of a text without words; null
    metadata is a value of its own.  Input columns of these names are replaced.
    """
    s = tmp("score")

    @F.arrow_udf("struct<text_score: double, meta_score: double, score: double>")
    def of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, *meta_of in batches:
            t = np.array([content(x.as_py()) for x in texts]).reshape(-1, _STATS)
            m = np.array([metadata(*r) for r in zip(*[c.to_pylist() for c in meta_of], strict=True)]
                         ).reshape(-1, META_BUCKETS + 2)
            yield pa.StructArray.from_arrays([pa.array(p, pa.float64()) for p in model.score(t, m)],
                                             names=["text_score", "meta_score", "score"])

    new = ("text_score", "meta_score", "score", "kept")
    d = docs.select(*[column(docs, c) for c in docs.columns if c not in new],
                    of(column(docs, text), column(docs, meta[0]), column(docs, meta[1]),
                       column(docs, meta[2]).cast("double")).alias(s))
    return d.select(*[column(d, c) for c in d.columns if c != s], f"{s}.*", (F.col(f"{s}.score") >= threshold)
                    .alias("kept"))
