"""Site-relative line frequency (native).

Lines are grouped by host.  A line is boilerplate on a host when the share of
the host's pages that contain it exceeds ``max_ratio`` and at least
``min_pages`` pages contain it (on a host of two pages every line has a ratio
of one half or more, which says nothing).

Plan: one narrow aggregate over (host, line hash), whose map-side part
collapses a line that half of all pages share; the host totals; and the
boilerplate lines of each host as one array.  A host has at most (lines per
page / max_ratio) boilerplate lines, so that array is bounded whatever the
host's size, and texts are cleaned in place: no text is ever shuffled back
together from its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import column, same, tmp

MAX_RATIO = 0.08
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a trimmed line."""
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text",
                      max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row (host, n_pages, lines) per host with boilerplate; ``lines`` holds line hashes."""
    h, t = tmp("host"), tmp("line")
    d = docs.select(column(docs, host).alias(h), column(docs, text).alias("text"))
    totals = d.groupBy(h).agg(F.count(F.lit(1)).alias("n_pages"))
    lines = d.select(h, F.explode_outer(F.array_distinct(F.transform(_lines(F.col("text")), F.trim))).alias(t))
    lines = lines.where(F.length(t) > 0).select(h, _key(F.col(t)).alias("key"))
    often = lines.groupBy(h, "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    often, totals = often.alias("o"), totals.alias("t")
    return (often.join(totals, same(F.col(f"o.{h}"), F.col(f"t.{h}")))
            .where(F.col("o.n") > F.col("t.n_pages") * F.lit(max_ratio))
            .groupBy(F.col(f"t.{h}").alias(h), F.col("t.n_pages").alias("n_pages"))
            .agg(F.collect_list("o.key").alias("lines")))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text",
                     max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
                     n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """All rows and columns of ``docs`` with the boilerplate lines removed from
    ``text``, plus the number of lines before and of lines dropped.

    Lines are compared without leading and trailing spaces; blank lines are
    never dropped; every copy of a boilerplate line goes, also within one page.
    A page whose lines all go keeps its row with an empty text.  Null texts
    stay null (0 lines); an empty text has one blank line; rows without a host
    form a host of their own; repeated rows are pages of their own.  Input
    columns named like ``n_lines`` or ``n_dropped`` are replaced.
    """
    h, ls = tmp("host"), tmp("lines")
    sites = materialize(boilerplate_lines(docs, host, text, max_ratio, min_pages), "line-dedup")
    sites = sites.select(F.col(h), F.col("lines").alias(ls))
    old, bad = _lines(column(docs, text)), F.col(ls)
    d = docs.join(sites, same(column(docs, host), sites[h]), "left")
    good = F.when(bad.isNull(), old).otherwise(
        F.filter(old, lambda x: (F.length(F.trim(x)) == 0) | ~F.array_contains(bad, _key(x))))
    n_old = F.when(old.isNull(), 0).otherwise(F.size(old)).cast("long")
    d = d.select("*", good.alias(tmp("good")), n_old.alias(tmp("n")))
    n_good = F.when(F.col(tmp("good")).isNull(), 0).otherwise(F.size(tmp("good"))).cast("long")
    new = {text: F.array_join(tmp("good"), "\n"), n_lines: F.col(tmp("n")), n_dropped: F.col(tmp("n")) - n_good}
    kept = [new.pop(c).alias(c) if c in new else column(docs, c) for c in docs.columns]
    return d.select(*kept, *[v.alias(c) for c, v in new.items()])


SQL = f"""
WITH l AS (
  SELECT doc_id, source, r, i, t, trim(t) AS k FROM (
    SELECT doc_id, source, r, unnest(string_split(text, chr(10))) AS t,
           unnest(generate_series(1, len(string_split(text, chr(10))))) AS i
    FROM (SELECT *, row_number() OVER () AS r FROM documents) d0) d1),
bad AS (
  SELECT c.source, c.k FROM
    (SELECT source, k, count(DISTINCT r) AS n FROM l WHERE k <> '' GROUP BY source, k) c
    JOIN (SELECT source, count(*) AS n_pages FROM documents GROUP BY source) h
      ON c.source IS NOT DISTINCT FROM h.source
  WHERE c.n >= {MIN_PAGES} AND c.n > h.n_pages * {MAX_RATIO}::DOUBLE)
SELECT l.doc_id, coalesce(string_agg(CASE WHEN b.k IS NULL THEN t END, chr(10) ORDER BY i), '') AS text,
       count(*)::BIGINT AS n_lines, count(b.k)::BIGINT AS n_dropped
FROM l LEFT JOIN bad b ON b.k = l.k AND b.source IS NOT DISTINCT FROM l.source
GROUP BY l.doc_id, l.r
"""
