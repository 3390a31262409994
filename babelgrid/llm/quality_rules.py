"""Quality rules with robust multivariate outliers.

Counts of every whole text (words, symbols, repeated lines, words in repeated
8-word windows) give base rules, and a vector of transformed statistics that
is judged against its language and source: the minimum covariance determinant
(MCD) estimate of the group's location and scatter, by concentration steps
over all of its rows, and the vector's Mahalanobis distance from it.

The counts are one Arrow pass per text.  The estimates never gather a group:
a concentration step is two aggregates over a narrow table, a histogram of
distances (which gives the cut that holds the closest ``SUBSET`` of the rows)
and the sums of the rows below the cut, so that a group with a third of all
rows costs what others cost.  Each row counts for three groups: its language
and source, its language, and all rows; a group too small for an estimate is
judged by the next larger one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import column, same, tmp

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"

STATS = ("mean_word", "symbols", "dup_lines", "repeats")
#: Words of the group's average that every text is mixed with: short texts
#: have statistics that vary by chance alone.
PRIOR_WORDS = 50.0
#: The least standard deviation of each statistic: most texts have no symbol
#: and no repeat at all, and an estimate without scatter would reject any.
FLOOR = (0.035, 0.05, 0.1, 0.1)
#: Share of a group's rows that the estimate is to hold, and its least size.
SUBSET = 0.75
MIN_GROUP = 100
#: Concentration steps at most; the cut is a bin of a histogram, so that some groups go on changing a little.
STEPS = 12
#: Parts of a group's vectors in a join with its estimate.
SALTS = 16
#: Squared distance beyond which a vector is an outlier: about the 1 - 1e-6 quantile of chi-squared with 4 degrees.
CUT = 33.4
#: Median of chi-squared with 4 degrees, for the scale of the estimate.
MEDIAN = 3.357
#: Bins of a histogram for each doubling of the squared distance.
_BINS = 32


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # at ASCII white space only
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(words, REPEAT_WINDOW)


_MIX = np.random.default_rng(8).integers(0, 1 << 64, REPEAT_WINDOW, dtype=np.uint64) | np.uint64(1)


def _repeated(words: list[bytes], n: int) -> int:
    """Words inside windows of ``n`` words that occur at least twice."""
    if len(words) <= n:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known) + 1) for w in words], np.uint64)
    m = len(words) - n + 1
    key = np.zeros(m, np.uint64)
    for k in range(n):
        key += ids[k:k + m] * _MIX[k]
    order = np.argsort(key, kind="stable")
    again = key[order][1:] == key[order][:-1]
    if not again.any():
        return 0
    at = np.zeros(len(words) + 1, np.int64)
    hit = np.zeros(m, bool)
    hit[order[1:][again]] = True
    hit[order[:-1][again]] = True
    where = np.flatnonzero(hit)
    at[where] += 1
    at[where + n] -= 1
    return int((np.cumsum(at)[:-1] > 0).sum())


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_counts(text: Column) -> Column:
    """``counts`` as a struct column; one text at a time leaves the Arrow batch."""
    @F.arrow_udf("struct<" + ", ".join(c + ": long" for c in _COUNTS) + ">")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in texts:
            found = np.array([counts(t.as_py()) for t in a], np.int64).reshape(-1, len(_COUNTS))
            yield pa.StructArray.from_arrays([pa.array(c) for c in found.T], names=_COUNTS)
    return of(text)


_P = len(STATS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_EST = "g string, start int, n long, " + ", ".join([f"m{i} double" for i in range(_P)] + [f"w{i}{j} double" for i, j in _PAIRS]
                                        + ["scale double", "logdet double"])


def _groups(lang: Column, source: Column) -> list[Column]:
    """Keys of the groups of a row, the finest first; null is a value of its own."""
    def part(c: Column) -> Column:
        return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))

    size = F.length(part(lang)).cast("string")  # tells where the language ends
    return [F.concat(F.lit("0"), size, part(lang), part(source)), F.concat(F.lit("1"), part(lang)), F.lit("2")]


def _base_failed(d: DataFrame) -> Column:
    n = column(d, "n_words")
    return (n < MIN_WORDS) | (column(d, "n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)


def _vector(prior: Column) -> list[Column]:
    """The transformed statistics; ``prior`` is the language's mean characters a word."""
    n = F.col("n_words") + F.lit(PRIOR_WORDS)
    return [F.log((F.col("word_chars") + prior * PRIOR_WORDS) / n), F.sqrt(F.col("n_symbols") / n),
            F.sqrt(F.col("n_dup_lines") * 10 / n), F.sqrt(F.col("n_repeat_words") / n)]


def _distance(x: str, m: str) -> Column:
    """Squared Mahalanobis distance of the columns x.x* from the estimate m."""
    u = [F.col(f"{x}.x{i}") - F.col(f"{m}.m{i}") for i in range(_P)]
    terms = [F.col(f"{m}.w{i}{j}") * u[i] * u[j] * (1.0 if i == j else 2.0) for i, j in _PAIRS]
    return sum(terms[1:], terms[0]) / F.col(f"{m}.scale")


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-9))) * _BINS).cast("int")


def _at_share(counted: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """From (keys, bin, n) the first bin at which a share of the group's rows is reached."""
    w = Window.partitionBy(*keys)
    c = counted.select(*keys, "bin", F.sum("n").over(w.orderBy("bin")).alias("cum"), F.sum("n").over(w).alias("all"))
    return c.where(F.col("cum") >= F.col("all") * share).groupBy(*keys).agg(F.min("bin").alias(name))


def _invert(cov: np.ndarray) -> tuple[np.ndarray, float]:
    cov = cov + np.diag(np.square(FLOOR))
    return np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def _row(g: str, start: int, n: int, mean: np.ndarray, cov: np.ndarray) -> list:
    w, logdet = _invert(cov)
    return [g, start, n, *mean, *[w[i, j] for i, j in _PAIRS], 1.0, logdet]


def _start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Median and interquartile range of each statistic, no correlation."""
    for pdf in batches:
        rows = [_row(r.g, 0, r.n, np.array(r.mid) / 512.0, np.diag(np.square((np.array(r.hi) - np.array(r.lo))
                                                                          / 512.0 / 1.349)))
                for r in pdf.itertuples()]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _EST.split(", ")])


def _refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean and scatter of the rows of the subset, from sums about the old mean."""
    for pdf in batches:
        rows = []
        for r in pdf.to_dict("records"):
            s = np.array([r[f"s{i}"] for i in range(_P)]) / r["k"]
            cov = np.zeros((_P, _P))
            for i, j in _PAIRS:
                cov[i, j] = cov[j, i] = r[f"q{i}{j}"] / r["k"] - s[i] * s[j]
            rows.append(_row(r["g"], r["start"], r["n"], np.array([r[f"m{i}"] for i in range(_P)]) + s, cov))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _EST.split(", ")])


def estimates(stats: DataFrame, lang: str = "lang", source: str = "source", steps: int = STEPS) -> DataFrame:
    """MCD estimates from rows with ``counts`` columns: one row per group of at
    least ``MIN_GROUP`` rows that pass the base rules (g, n, location m*,
    inverse scatter w**, scale, logdet), and the languages' mean characters a
    word, as (estimates, priors)."""
    d = stats.where(~_base_failed(stats)).select(
        column(stats, lang).alias("lang"), column(stats, source).alias("source"), *_COUNTS)
    priors = materialize(d.groupBy("lang").agg((F.sum("word_chars") / F.sum("n_words")).alias("prior")), "mcd-priors")
    p = d.join(priors.withColumnRenamed("lang", "l"), same(d["lang"], F.col("l")))
    p = p.select(F.explode(F.array(*_groups(F.col("lang"), F.col("source")))).alias("g"),
                 *[x.alias(f"x{i}") for i, x in enumerate(_vector(F.col("prior")))])
    # equal vectors of a group (most short statistics are zero) are one row with a weight
    xs = [f"x{i}" for i in range(_P)]
    p = p.groupBy("g", *xs).agg(F.count(F.lit(1)).alias("n"))
    p = materialize(p.withColumn("salt", F.pmod(F.xxhash64(*xs), F.lit(SALTS)).cast("int")), "mcd-vectors")
    sizes = p.groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_GROUP)

    flat = p.select("g", "n", F.posexplode(F.array(*[F.floor(F.col(f"x{i}") * 512).cast("int") for i in range(_P)]))
                    .alias("i", "bin"))
    flat = flat.groupBy("g", "i", "bin").agg(F.sum("n").alias("n"))
    qs = _at_share(flat, ["g", "i"], 0.5, "mid").join(_at_share(flat, ["g", "i"], 0.25, "lo"), ["g", "i"]).join(
        _at_share(flat, ["g", "i"], 0.75, "hi"), ["g", "i"])
    qs = qs.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "mid", "lo", "hi"))).alias("q"))
    start = qs.join(sizes, "g").select("g", "n", "q.mid", "q.lo", "q.hi")
    robust = materialize(start.mapInPandas(_start, _EST), "mcd-start")
    est = _settle(p, robust, steps)

    mid = _at_share(_at(p, est).groupBy(*_RUN, "bin").agg(F.sum("n").alias("n")), _RUN, 0.5, "mid").drop("start")
    # scaled up only: where the floors are the scatter, the median distance is small by design
    scale = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("mid") + 1) / float(_BINS)) / MEDIAN)
    est = est.join(mid, "g").withColumn("scale", scale).drop("mid")
    return materialize(est, "mcd"), priors


#: A group's estimate from one start (there is one, 0).
_RUN = ["g", "start"]


def _at(p: DataFrame, est: DataFrame, *more: str) -> DataFrame:
    """(g, start, n, u*, bin): the vectors about their group's estimate, binned by distance.

    Joined by group and salt, the few estimates once per salt: where they are
    too many to be broadcast, a group's vectors are still spread, and what
    is summed by group next is summed in their own task first."""
    e = est.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return p.alias("x").join(e.alias("e"), ["g", "salt"]).select(
        *_RUN, F.col("x.n").alias("n"), *[(F.col(f"x.x{i}") - F.col(f"e.m{i}")).alias(f"u{i}") for i in range(_P)],
        _bin(_distance("x", "e")).alias("bin"), *[F.col(f"e.{c}").alias(c) for c in more])


def _sums(at: DataFrame) -> DataFrame:
    return at.groupBy(*_RUN).agg(
        F.sum("n").alias("k"), *[F.sum(F.col("n") * F.col(f"u{i}")).alias(f"s{i}") for i in range(_P)],
        *[F.sum(F.col("n") * F.col(f"u{i}") * F.col(f"u{j}")).alias(f"q{i}{j}") for i, j in _PAIRS])


def _narrow(est: DataFrame) -> DataFrame:
    return est.select(*_RUN, "n", *[f"m{i}" for i in range(_P)])


def _settle(p: DataFrame, est: DataFrame, steps: int) -> DataFrame:
    """Concentration steps until no determinant changes, ``steps`` at most."""
    before = None
    for _ in range(steps):
        # tables of their own, so that their size is known
        cut = materialize(_at_share(_at(p, est).groupBy(*_RUN, "bin").agg(F.sum("n").alias("n")), _RUN, SUBSET, "cut"), "mcd-cut")
        inside = _at(p, est.join(cut, _RUN), "cut").where(F.col("bin") <= F.col("cut"))
        est = materialize(_sums(inside).join(_narrow(est), _RUN).mapInPandas(_refit, _EST), "mcd-step")
        now = est.agg(F.sum(F.round("logdet", 6))).first()[0]
        if now == before:
            break
        before = now
    return est


def judge(stats: DataFrame, est: DataFrame, priors: DataFrame, lang: str = "lang", source: str = "source",
          cut: float = CUT) -> DataFrame:
    """Adds ``base_failed``, ``distance2`` and ``kept`` to rows with ``counts`` columns.

    ``kept`` is false where a base rule fails, or the squared distance from
    the finest group that has an estimate exceeds ``cut``; where no group has
    one (a tiny table) the distance is null and the base rules decide.
    """
    l, s = column(stats, lang), column(stats, source)
    gs = [tmp(f"g{k}") for k in range(3)]
    pr = priors.select(F.col("lang").alias(tmp("lang")), F.col("prior").alias(tmp("prior")))
    d = stats.select("*", *[g.alias(n) for g, n in zip(_groups(l, s), gs, strict=True)])
    d = d.join(pr, same(column(d, lang), pr[tmp("lang")]), "left")
    cols = d.columns
    for k, g in enumerate(gs):
        e = est.where(F.left("g", F.lit(1)) == str(k)).select(*[F.col(c).alias(tmp(f"{c}_{k}")) for c in est.columns])
        d = d.join(e, d[g] == e[tmp(f"g_{k}")], "left")
    x = _vector(F.col(tmp("prior")))
    found = []
    for k in range(3):
        u = [x[i] - F.col(tmp(f"m{i}_{k}")) for i in range(_P)]
        t = [F.col(tmp(f"w{i}{j}_{k}")) * u[i] * u[j] * (1.0 if i == j else 2.0) for i, j in _PAIRS]
        found.append(sum(t[1:], t[0]) / F.col(tmp(f"scale_{k}")))
    failed = _base_failed(d)
    new = {"base_failed": failed, "distance2": F.when(~failed, F.coalesce(*found))}
    new["kept"] = ~failed & (F.coalesce(new["distance2"], F.lit(0.0)) <= cut)
    keep = [column(d, c) for c in cols if not c.startswith(tmp("")) and c not in new]
    return d.select(*keep, *[v.alias(c) for c, v in new.items()])


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of every whole text (null and empty: zeros) as
    long columns, which replace input columns of the same names."""
    c = tmp("counts")
    d = docs.select("*", text_counts(column(docs, text)).alias(c))
    keep = [column(d, k) for k in docs.columns if k not in _COUNTS]
    return d.select(*keep, *[F.col(f"{c}.{k}").alias(k) for k in _COUNTS])


def quality(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", lang: str = "lang",
            source: str = "source") -> DataFrame:
    """Keys, counts, ``base_failed``, ``distance2`` and ``kept`` for every row of ``docs``.

    Null and empty texts have no words and fail; null languages and sources
    are groups of their own; equal rows get equal verdicts.
    """
    narrow = {k: k for k in (*keys, lang, source, text)}
    d = materialize(with_counts(docs.select(*[column(docs, c) for c in narrow]), text).drop(text), "quality-counts")
    return judge(d, *estimates(d, lang, source), lang, source)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with their own columns.

    The texts are counted a second time rather than joined to their verdicts:
    no text is shuffled.
    """
    l, s, t = "l", "s", "t"
    narrow = docs.select(column(docs, lang).alias(l), column(docs, source).alias(s), column(docs, text).alias(t))
    fitted = estimates(materialize(with_counts(narrow, t).drop(t), "quality-counts"), l, s)
    d = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("row"),
                    column(docs, lang).alias(l), column(docs, source).alias(s), column(docs, text).alias(t))
    return judge(with_counts(d, t).drop(t), *fitted, l, s).where("kept").select("row.*")
