"""Merkle manifest of a dataset: a tree per group over its ordered leaves, a
tree over the groups' subroots, an inclusion proof for every leaf.

Leaves are numbered within their group by a range partition and per-partition
offsets, so no group is one task.  Levels are built with lag and lead columns:
a node's digest stands in the row of its first leaf, so at level ``l`` its
siblings stand exactly ``k * arity ** l`` rows away; columns are masked by the
node's slot in its run, and the row of a run's first child hashes the parent.
Windows are partitioned by (group, block of ``BLOCK`` leaves): runs never cross
a block, all levels of a block share one exchange and one sort, and the
blocks' roots are the leaves of the next round (two rounds reach 16 million
leaves, three 68 billion).  Texts are hashed where they are read and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import column, numbered, same, tmp

ARITY = 2
#: Leaves in a window partition; a power of the arity at most this large is used.
BLOCK = 4096
_SIBLINGS = "struct<l:string,r:string>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value as UTF-8 byte count, ``:``, value, or ``-`` where it is null."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _depth(n: Column, arity: int) -> Column:
    """Levels above ``n`` nodes until one is left."""
    powers = [arity ** k for k in range(64) if arity ** k < 2 ** 63]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < n))


def _levels(arity: int) -> int:
    if not 2 <= arity <= BLOCK:
        raise ValueError(f"arity must be 2 to {BLOCK}")
    k = 1
    while arity ** (k + 1) <= BLOCK:
        k += 1
    return k


def _blocks(nodes: DataFrame, arity: int) -> DataFrame:
    """(g, pos, block, i, node, left) to (g, pos, block, i, path, top, left): ``path`` holds the
    siblings on the way up the block, ``top`` the block's root in the block's first row."""
    k = _levels(arity)
    d = nodes
    w = Window.partitionBy("g", "block").orderBy("i")
    for level in range(k):
        step = arity ** level
        near = range(1, arity)
        d = d.select("*", *[F.lag("node", n * step).over(w).alias(f"lag{n}") for n in near],
                     *[F.lead("node", n * step).over(w).alias(f"lead{n}") for n in near])
        slot = F.expr(f"(i div {step}) % {arity}")
        no = F.lit("")
        left = F.concat(*[F.when(slot >= n, F.coalesce(f"lag{n}", no)).otherwise(no) for n in reversed(near)])
        right = F.concat(*[F.when(slot + n < arity, F.coalesce(f"lead{n}", no)).otherwise(no) for n in near])
        inner = (F.pmod("i", F.lit(step)) == 0) & (F.col("left") > level)
        up = F.when(inner & (slot == 0), digest(F.col("node"), right))
        d = d.select(*[c for c in d.columns if not c.startswith(("lag", "lead")) and c != "node"],
                     F.when(inner, F.struct(left.alias("l"), right.alias("r"))).alias(f"siblings{level}"),
                     F.when(F.col("left") > level, up).otherwise(F.col("node")).alias("node"))
    below = w.rowsBetween(Window.unboundedPreceding, 0)
    path = [F.last(f"siblings{level}", ignorenulls=True).over(below).alias(f"siblings{level}") for level in range(k)]
    d = d.select("g", "pos", "block", "i", "left", F.col("node").alias("top"), *path)
    path = F.array_compact(F.array(*[f"siblings{level}" for level in range(k)]))
    return d.select("g", "pos", "block", "i", path.cast(f"array<{_SIBLINGS}>").alias("path"), "top",
                    F.greatest(F.col("left") - k, F.lit(0)).alias("left"))


def trees(nodes: DataFrame, arity: int = ARITY) -> tuple[DataFrame, DataFrame]:
    """One tree per group ``g`` over (g, pos, node), ``pos`` = 0, 1, ... without gaps.

    Returns (g, pos, path) and (g, root).  While a group has several nodes,
    every ``arity`` consecutive ones (the last run: fewer, even one) become
    the digest of their concatenated digests; a single node is its own root.
    """
    nodes = _cut(nodes, arity)
    # the depth is joined by group and block: by group alone, the windows would inherit that partitioning
    sizes = nodes.groupBy("g", "block").agg(F.count(F.lit(1)).alias("n"))
    depth = sizes.select("g", "block", _depth(F.sum("n").over(Window.partitionBy("g")), arity).alias("left"))
    return _grow(nodes.join(materialize(depth, "merkle-depths"), ["g", "block"]), arity)


def _cut(nodes: DataFrame, arity: int) -> DataFrame:
    width = arity ** _levels(arity)
    return nodes.select("*", F.expr(f"pos div {width}").alias("block"), F.pmod("pos", F.lit(width)).alias("i"))


def _grow(nodes: DataFrame, arity: int) -> tuple[DataFrame, DataFrame]:
    done = materialize(_blocks(nodes, arity), "merkle-blocks")
    tops = done.where(F.col("i") == 0).select("g", F.col("block").alias("pos"), F.col("top").alias("node"), "left")
    more = tops.agg(F.max("left")).first()[0]  # one number
    paths = done.select("g", "pos", "block", "path")
    if not more:
        return paths.drop("block"), tops.select("g", F.col("node").alias("root"))
    upper, roots = _grow(_cut(tops, arity), arity)
    upper = upper.select("g", F.col("pos").alias("block"), F.col("path").alias("more"))
    return paths.join(upper, ["g", "block"]).select("g", "pos", F.concat("path", "more").alias("path")), roots


def fold(start: Column, path: Column) -> Column:
    """The root that a digest and the siblings on its way up give."""
    return F.aggregate(path, start, lambda acc, s: digest(s["l"], acc, s["r"]))


def proof_text(path: Column) -> Column:
    """The siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             tampered: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """One row (key, leaf, tampered_leaf, subroot, root, path) per row of ``docs``.

    Leaves ascend by ``key`` within their group (null keys first, then by
    digest, so repeated rows sit side by side, each with a place of its own);
    groups by their UTF-8 bytes, null first.  Nulls have their own mark in a
    leaf, so a null text differs from an empty one.  ``tampered`` replaces
    some of the fields' values: ``tampered_leaf`` is the digest of those.
    Columns that aren't named stay out.  An empty table gives no rows.
    """
    now = [column(docs, f) for f in fields]
    then = [(tampered or {}).get(f, column(docs, f)) for f in fields]
    g = column(docs, group).cast("string")
    # the mark before a group keeps null apart from empty, and first
    d = docs.select(column(docs, key).alias(tmp("key")),
                    F.when(g.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), g)).alias("g"),
                    leaf_digest(*now).alias("leaf"), leaf_digest(*then).alias("tampered_leaf"))
    d = numbered(d, ["g"], [F.col(tmp("key")).asc_nulls_first(), F.col("leaf").asc()], "pos", "merkle-leaves")
    paths, subroots = trees(d.select("g", "pos", F.col("leaf").alias("node")), arity)
    subroots = materialize(subroots, "merkle-subroots")
    order = numbered(subroots.select(F.lit("").alias("all"), "g", "root"), ["all"], [F.col("g").asc()], "pos", "merkle-groups")
    group_paths, root = trees(order.select(F.col("all").alias("g"), "pos", F.col("root").alias("node")), arity)
    tops = (order.join(group_paths.select("pos", F.col("path").alias("upper")), "pos")
            .crossJoin(root.select(F.col("root").alias("all_root")))  # one row
            .select("g", F.col("root").alias("subroot"), "upper", F.col("all_root").alias("root")))
    d = d.join(paths, ["g", "pos"]).join(materialize(tops, "merkle-tops"), "g")
    return d.select(F.col(tmp("key")).alias(key), "leaf", "tampered_leaf", "subroot", "root",
                    F.concat("path", "upper").alias("path"))


def verify(leaves: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``manifest`` with the proof's digest, the root recomputed from
    the tampered leaf and the original siblings, and whether it is the root."""
    d = leaves.withColumn("folded_root", fold(F.col("tampered_leaf"), F.col("path")))
    return d.select(column(leaves, key).alias(key), "leaf", "subroot", "root",
                    digest(proof_text(F.col("path"))).alias("proof_sha256"), "folded_root",
                    same(F.col("folded_root"), F.col("root")).alias("verified"))


# the twin: a tree is a list that a recursive query shortens level by level
_H = "sha256({})"
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda ch: "
        "[ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: xor(xor(c, x) >> 1, "
        "CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT)")


def _leaf_sql(n_chars: str) -> str:
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(
        f"coalesce(strlen(({f})::VARCHAR)::VARCHAR || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


_UP = """list_transform(range(0, (len(nodes) + 1) // 2),
                 lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], '')))"""
_SIBLING = "coalesce(nodes[(pos >> level)::BIGINT + 1 + CASE WHEN (pos >> level) % 2 = 0 THEN 1 ELSE -1 END], '')"
SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
         CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("n_chars + 1")}
              ELSE {_leaf_sql("n_chars")} END AS bad
  FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t(lang, level, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM p GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, {_UP} FROM t WHERE len(nodes) > 1),
tops AS MATERIALIZED (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM t WHERE len(nodes) = 1),
u(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM tops
  UNION ALL
  SELECT level + 1, {_UP} FROM u WHERE len(nodes) > 1),
s AS (
  SELECT p.doc_id, p.leaf, p.bad, p.lang, p.pos, t.level, 0 AS upper, (p.pos >> t.level) % 2 AS slot, {_SIBLING} AS sibling
  FROM p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT p.doc_id, p.leaf, p.bad, p.lang, p.pos, q.level, 1, q.slot, q.sibling
  FROM p JOIN (SELECT lang, level, (pos >> level) % 2 AS slot, {_SIBLING} AS sibling FROM tops, u WHERE len(nodes) > 1) q
    ON p.lang IS NOT DISTINCT FROM q.lang),
path AS (
  SELECT p.doc_id, p.leaf, p.bad, p.lang, p.pos,
         coalesce(list({{'slot': slot, 'sibling': sibling}} ORDER BY upper, s.level) FILTER (sibling IS NOT NULL), []) AS path
  FROM p LEFT JOIN s ON s.lang IS NOT DISTINCT FROM p.lang AND s.pos = p.pos GROUP BY ALL),
f AS (
  SELECT *, list_reduce(list_prepend(bad, list_transform(path, lambda x: x.slot || x.sibling)),
           lambda a, x: CASE WHEN x[1] = '0' THEN sha256(a || x[2:]) ELSE sha256(x[2:] || a) END) AS folded_root FROM path)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(path, lambda x: x.sibling)), 'string_agg', '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM f JOIN tops ON f.lang IS NOT DISTINCT FROM tops.lang, (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1)
"""
