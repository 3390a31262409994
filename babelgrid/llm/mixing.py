"""Mixing sources to target weights (native).

Every source has a target number of words; the mix takes whole epochs of a
source plus part of one more.  The rows of a source are permuted into blocks,
so a target becomes an exact quota of block draws, and a splitting tree deals
the quotas out: the root holds all output shards, each node sends half of its
draws to either child, and how many of them each source contributes follows
the multivariate hypergeometric law (one hypergeometric draw per source, by
inversion).  A leaf is a shard with its quota of every source.  A source's
shards then own disjoint ranges of its permuted draws, and the rows of a shard
are ordered by a hash: the only shuffle that a shard needs is its own.

Blocks and shards keep their size in words, so their number follows the total.
Everything per source, block or shard is a table: sources are numbered by a
range partition, running sums over a source's blocks or shards go through
ordered buckets, and a node of the tree is one row per ``CHUNK`` of its
sources.  A node with more sources deals its draws to chunks of sources first
and then, within each chunk, to the sources, which is the same law.  Only what
a single block of a source holds is ever an array of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import column, n_words, numbered, same, tmp

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BLOCK_WORDS = 1 << 18
SHARD_WORDS = 1 << 22
#: Sources in one row of the tree.
CHUNK = 256
#: Levels of the tree in one plan; the nodes are then spread over tasks anew.
STEP_LEVELS = 6
#: Shards in a bucket of running sums, and bits of a hash that make one.
SHARD_BUCKET = 1 << 12
HASH_BUCKET_BITS = 12
#: Share of a boundary block's rest that may be missed before its largest rows are tried first.
NEAR = 0.01
SEED = 20


def _sized(docs: DataFrame, source: str, text: str, key: str, seed: int) -> DataFrame:
    """Row identity ``h``: equal for repeated rows only, which are drawn together."""
    t = column(docs, text)
    return docs.select(
        "*", column(docs, source).alias(tmp("source")), n_words(t).alias(tmp("size")),
        F.xxhash64(F.lit(seed), column(docs, key), t).alias(tmp("h")))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, take the weights in turn.  All sizes are
    shared by weight; targets stop at ``max_epochs`` times their source, and
    the excess is reshared by weight until no further source is stopped.  Each
    round is one aggregate over the table of sources, in whole numbers per
    weight, so that reruns agree to the last digit.
    """
    d = numbered(sizes, [], [F.col("source").asc_nulls_last()], "n", "mix-ranked")
    turn = (F.col("n") % len(weights)).cast("int")
    d = materialize(d.select("source", "source_size", turn.alias("turn"),
                             F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1).alias("weight"),
                             (F.col("source_size") * float(max_epochs)).alias("cap")), "mix-caps")
    level, stopped = 0.0, None
    while True:
        full = F.col("weight") * F.lit(level) > F.col("cap")
        rows = d.groupBy("turn").agg(
            F.sum("source_size").alias("words"), F.sum(F.when(full, F.col("source_size"))).alias("full"),
            F.count(F.when(full, 1)).alias("stopped"), F.count(F.when(~full, 1)).alias("free")).collect()
        now = sum(r.stopped for r in rows)
        if now == stopped:
            break
        stopped = now
        free = sum(r.free * float(weights[r.turn]) for r in sorted(rows, key=lambda r: r.turn))
        if free <= 0:
            level = float("inf")  # every source with a weight is used up
            break
        level = (sum(r.words for r in rows) - float(max_epochs) * sum(r.full or 0 for r in rows)) / free
    share = F.when(F.col("weight") > 0, F.lit(level) * F.col("weight")).otherwise(0.0)
    return d.select("source", "source_size", F.least("cap", share).alias("target"))


def _uniform(*cols: Column) -> Column:
    """Of (0, 1), the same on every run."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def hypergeometric(total: Column, good: Column, n: Column, u: Column) -> Column:
    """How many of ``good`` marked items are among ``n`` drawn out of ``total``,
    by inversion at the uniform ``u``.

    Two passes over the support keep a running log weight: the first sums the
    weights relative to the largest, the second counts the steps below u.  The
    support stops at five roots of the smallest margin from the mean: what lies
    beyond has a probability under 2 exp(-50) (Hoeffding's bound), less than
    the distance of two neighbouring u.
    """
    lo, hi = F.greatest(F.lit(0), n - (total - good)).cast("long"), F.least(good, n).cast("long")
    mean = F.try_divide(n.cast("double") * good.cast("double"), total.cast("double"))
    far = 5 * F.sqrt(F.greatest(F.lit(0), F.least(good, n, total - good, total - n)).cast("double")) + 1
    lo, hi = F.greatest(lo, F.floor(mean - far)), F.least(hi, F.ceil(mean + far))
    support = F.sequence(lo, hi)

    def up(w: Column, x: Column) -> Column:  # log weight of x + 1 from that of x
        return w + F.coalesce(F.log((good - x) * (n - x) / ((x + 1) * (total - good - n + x + 1))), F.lit(-1e9))

    def add(s: Column, x: Column) -> Column:
        top = F.greatest(s["top"], s["w"])
        return F.struct(up(s["w"], x).alias("w"), top.alias("top"),
                        (s["sum"] * F.exp(s["top"] - top) + F.exp(s["w"] - top)).alias("sum"))

    zero = F.lit(0.0)
    whole = F.aggregate(support, F.struct(zero.alias("w"), zero.alias("top"), zero.alias("sum")), add,
                        lambda s: F.struct(s["top"].alias("top"), (s["sum"] * u).alias("goal")))

    def count(s: Column, x: Column) -> Column:
        acc = s["sum"] + F.exp(s["w"] - s["top"])
        return F.struct(up(s["w"], x).alias("w"), s["top"].alias("top"), s["goal"].alias("goal"), acc.alias("sum"),
                        (s["x"] + F.when(acc < s["goal"], 1).otherwise(0).cast("long")).alias("x"))

    # the first pass's result enters the second as a one-element array, so that it is computed once
    picked = F.transform(F.array(whole), lambda g: F.aggregate(
        support, F.struct(zero.alias("w"), g["top"].alias("top"), g["goal"].alias("goal"), zero.alias("sum"),
                          F.lit(0).cast("long").alias("x")), count, lambda s: s["x"]))
    return F.when(hi <= lo, hi).otherwise(F.least(hi, lo + picked[0]))


def _dealt(rows: DataFrame, height: int, depth: int, seed: int) -> DataFrame:
    """(node, c, q) plus ``left``: how many of each entry's draws go left.

    ``q`` holds (name, k) in a fixed order, a chunk of the node's entries; ``c``
    numbers the chunks, of which a node has up to ``CHUNK ** height``.  With
    one chunk the node's half is dealt to its entries; with more it is first
    dealt to the chunks, as entries of their own.
    """
    d = rows.select("node", "c", "q", F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x["k"]).alias("n"))
    if height == 0:
        # an odd draw goes left or right at random
        odd = F.pmod(F.xxhash64(F.lit(seed), F.lit(depth), "node"), F.lit(2))
        d = d.select("*", F.floor((F.col("n") + odd) / 2).cast("long").alias("half"))
    else:
        d = materialize(d, "mix-chunks")
        up = d.groupBy("node", F.floor(F.col("c") / CHUNK).cast("long").alias("up")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("c").alias("name"), F.col("n").alias("k")))).alias("q"))
        up = _dealt(up.select("node", F.col("up").alias("c"), "q"), height - 1, depth, seed)
        half = up.select("node", F.explode(F.arrays_zip(F.col("q.name").alias("c"), F.col("left").alias("half"))).alias("x"))
        d = d.join(half.select("node", "x.c", "x.half"), ["node", "c"])
    salt = [F.lit(seed + 1), F.lit(depth), F.col("node")] + ([F.lit(height)] if height else [])

    def take(s: Column, x: Column) -> Column:
        got = F.transform(F.array(hypergeometric(s["total"], x["k"], s["n"], _uniform(*salt, x["name"]))), lambda v: v)
        return F.transform(got, lambda g: F.struct(
            (s["total"] - x["k"]).alias("total"), (s["n"] - g).alias("n"),
            F.concat(s["out"], F.array(g)).alias("out")))[0]

    start = F.struct(F.col("n").alias("total"), F.col("half").alias("n"), F.array().cast("array<bigint>").alias("out"))
    return d.select("node", "c", "q", F.aggregate("q", start, take, lambda s: s["out"]).alias("left"))


def split_quotas(quotas: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """(source, quota) to (shard, source, quota) over ``2 ** levels`` shards.

    A node is a row for each ``CHUNK`` of its sources, those with draws left; a
    level of the tree turns each row into one of either child.
    """
    many, height, chunks = quotas.count(), 0, 1
    while chunks * CHUNK < many:
        height, chunks = height + 1, chunks * CHUNK
    if height:  # chunks of neighbours by name
        q = numbered(quotas, [], [F.col("source").asc_nulls_last()], "n", "mix-numbered")
    else:
        q = quotas.select("*", F.lit(0).cast("long").alias("n"))
    nodes = q.groupBy(F.floor(F.col("n") / CHUNK).cast("long").alias("c")).agg(F.sort_array(F.collect_list(F.struct(
        F.col("source").isNull().alias("none"), F.col("source").alias("name"), F.col("quota").cast("long").alias("k"))))
        .alias("q"))
    nodes = nodes.select(F.lit(0).cast("long").alias("node"), "c", "q")
    for level in range(levels):
        left = _dealt(nodes, height, level, seed)
        child = left.select("node", "c", F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.zip_with("q", "left", lambda x, g: x.withField("k", g)).alias("q")),
            F.struct(F.lit(1).alias("side"),
                     F.zip_with("q", "left", lambda x, g: x.withField("k", x["k"] - g)).alias("q")))).alias("x"))
        nodes = child.select((F.col("node") * 2 + F.col("x.side")).alias("node"), "c",
                             F.filter("x.q", lambda x: x["k"] > 0).alias("q"))
        if (level + 1) % STEP_LEVELS == 0:
            nodes = materialize(nodes.where(F.size("q") > 0).repartition("node", "c"), "mix-tree")
    leaf = nodes.select(F.col("node").alias("shard"), F.explode("q").alias("x"))
    return leaf.select("shard", F.col("x.name").alias("source"), F.col("x.k").alias("quota")).where("quota > 0")


def _running(d: DataFrame, bucket: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``d`` plus, per source, the sums over the rows before each in ``order``.

    ``bucket`` rises with the order: a table of one row per source and bucket
    gives each bucket its start, a window over (source, bucket) the rest.
    """
    at = tmp("bucket")
    d = d.select("*", bucket.alias(at))
    each = d.groupBy("source", at).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    before = Window.partitionBy("source").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    each = each.select(F.col("source").alias(tmp("source")), F.col(at).alias(tmp("at")), *[
        F.coalesce(F.sum(n).over(before), zero).alias(tmp(n)) for n in sums])
    within = Window.partitionBy("source", at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(each, same(d["source"], each[tmp("source")]) & (d[at] == each[tmp("at")]))
    new = [(F.col(tmp(n)) + F.coalesce(F.sum(v).over(within), zero)).alias(n) for n, v in sums.items()]
    return d.select("*", *new).drop(at, tmp("source"), tmp("at"), *[tmp(n) for n in sums])


def _boundary(units: DataFrame, edge: DataFrame) -> DataFrame:
    """Which rows of each source's boundary block fill the rest of its quota.

    In the order of their hash, every row that fits what is left is taken, a
    longer one is passed over; at last the smallest row passed over goes in if
    it overshoots by less than it fills.  What is left is then less than any
    row not taken.  Where that misses the rest by more than ``NEAR`` of it (the
    short rows are used up and a long one didn't fit any more), the same is
    done with the largest rows first, and the better of the two stays.

    Returns (source, cut, order, steps, but, extra), as ``_fills`` reads it:
    ``steps`` holds a (limit, bound) for each time that a row which fitted when
    the step began no longer does, about the logarithm of the block.  ``but``
    are repeated rows that fit alone and not together.
    """
    e = edge.alias("e")
    u = units.alias("u").join(e, same(F.col("u.source"), F.col("e.source")) & (F.col("u.block") == F.col("e.block")))
    u = u.where("u.size > 0").groupBy("u.source", "u.h").agg(
        F.sum("u.size").alias("size"), F.max("u.size").alias("one"), F.first("e.rest").alias("rest"))
    g = u.groupBy("source").agg(F.first("rest").alias("rest"),
                                F.collect_list(F.struct("h", "size", "one")).alias("rows"))
    g = g.select("source", "rest", F.explode(F.array(F.lit(0), F.lit(1))).alias("order"), "rows")
    g = g.select("source", "rest", "order", F.sort_array(F.transform("rows", lambda x: F.struct(
        _at(F.col("order"), x["one"], x["h"]).alias("at"), x["size"].alias("size"), x["one"].alias("one")))).alias("rows"))

    def fill(s: Column, x: Column) -> Column:
        ok, late = x["size"] <= s["gap"], x["size"] <= s["limit"]
        step = F.array(F.struct(s["limit"].alias("limit"), x["at"].alias("bound")))
        left_out = F.struct(x["size"].alias("size"), x["at"]["h"].alias("h"))
        return F.struct(
            F.when(ok, s["gap"] - x["size"]).otherwise(s["gap"]).alias("gap"),
            F.when(late & ~ok, s["gap"]).otherwise(s["limit"]).alias("limit"),
            F.when(late & ~ok, F.concat(s["steps"], step)).otherwise(s["steps"]).alias("steps"),
            F.when(ok, s["cut"]).otherwise(F.coalesce(s["cut"], x["at"]["h"])).alias("cut"),
            F.when(ok, s["over"]).otherwise(F.least(s["over"], left_out)).alias("over"))

    place = "struct<place:bigint,h:bigint>"
    start = F.struct(F.col("rest").alias("gap"), F.col("rest").alias("limit"),
                     F.array().cast(f"array<struct<limit:double,bound:{place}>>").alias("steps"),
                     F.lit(None).cast("bigint").alias("cut"),
                     F.lit(None).cast("struct<size:bigint,h:bigint>").alias("over"))
    g = g.select("source", "rest", "order", "rows", F.aggregate("rows", start, fill).alias("s"))
    last = F.struct(F.col("s.limit").alias("limit"), F.lit(None).cast(place).alias("bound"))
    g = g.select("source", "rest", "order", "rows", "s", F.concat("s.steps", F.array(last)).alias("steps"),
                 F.least(F.col("s.gap"), F.col("s.over.size") - F.col("s.gap")).alias("miss"))
    but = F.filter("rows", lambda x: (x["one"] < x["size"]) & (x["one"] <= _limit(F.col("steps"), x["at"]))
                   & (x["size"] > _limit(F.col("steps"), x["at"])))
    g = g.select("source", "order", "steps", F.transform(but, lambda x: x["at"]["h"]).alias("but"),
                 F.col("s.cut").alias("cut"),
                 F.when(F.col("s.over.size") < 2 * F.col("s.gap"), F.col("s.over.h")).alias("extra"),
                 F.when((F.col("order") == 0) & (F.col("miss") <= NEAR * F.col("rest")), -1.0)
                 .otherwise(F.col("miss")).alias("miss"))
    best = g.groupBy("source").agg(
        F.min_by(F.struct("order", "steps", "but", "extra"), F.struct("miss", "order")).alias("best"),
        F.max(F.when(F.col("order") == 0, F.col("cut"))).alias("cut"))
    return best.select("source", "cut", "best.*")


def _at(order: Column, size: Column, h: Column) -> Column:
    """Where a row comes: by hash in order 0, by size from the largest in order 1."""
    return F.struct((-size * order).cast("long").alias("place"), h.alias("h"))


def _limit(steps: Column, at: Column) -> Column:
    """The largest size that is taken at a place of the order."""
    return F.filter(steps, lambda s: s["bound"].isNull() | (at < s["bound"]))[0]["limit"]


def _fills(h: Column, size: Column, g: str) -> Column:
    """Whether a row of a boundary block is taken; those without words are up to the first hash passed over."""
    fits = size <= _limit(F.col(g + ".steps"), _at(F.col(g + ".order"), size, h))
    fits = (fits & ~F.array_contains(F.col(g + ".but"), h)) | h.eqNullSafe(F.col(g + ".extra"))
    return F.when(size == 0, F.coalesce(h < F.col(g + ".cut"), F.lit(True))).otherwise(fits)


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id",
        weights: tuple = WEIGHTS, max_epochs: float = MAX_EPOCHS, block_words: int = BLOCK_WORDS,
        shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``docs`` plus ``size``, ``source_size``,
    ``target`` and ``draws``: one (epoch, shard, place) for each time that the
    mix takes the row.  ``place`` orders the rows of a shard.

    The same rows and seed give the same mix, in whatever order or files they
    come.  Null and empty texts have size 0; null sources are one source, the
    last; repeated rows (equal key and text) are drawn together, as one row of
    their summed size; an empty table gives an empty mix.  Input columns with
    the names of new ones are replaced.
    """
    d = _sized(docs, source, text, key, seed)
    narrow = d.select(F.col(tmp("source")).alias("source"), F.col(tmp("size")).alias("size"),
                      F.col(tmp("h")).alias("h"))
    narrow = materialize(narrow, "mix-sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = materialize(targets.select(
        "*", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long").alias("blocks"),
        F.floor(share).cast("long").alias("epochs")), "mix-sources")
    s = sources.alias("s")

    # blocks: a permutation of a source's rows cut by hash, then permuted again
    block = F.pmod(F.col("h"), F.col("s.blocks"))
    units = (narrow.alias("n").join(s, same(F.col("n.source"), F.col("s.source")))
             .select("n.source", block.alias("block"), "h", "size"))
    blocks = units.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.select("*", F.xxhash64(F.lit(seed + 2), "source", "block").alias("mixed"))
    blocks = _running(blocks, F.shiftright("mixed", 64 - HASH_BUCKET_BITS), [F.col("mixed"), F.col("block")],
                      {"p": F.lit(1), "cum": F.col("words")})
    blocks = blocks.select("source", "block", "words", "p", (F.col("cum") + F.col("words")).alias("cum"))
    rest = F.col("s.target") - F.col("s.epochs") * F.col("s.source_size")
    b = blocks.alias("b").join(s, same(F.col("b.source"), F.col("s.source")))
    blocks = materialize(b.select(
        "b.*", (F.col("b.cum") <= rest).alias("whole"),
        ((F.col("b.cum") > rest) & (F.col("b.cum") - F.col("b.words") < rest)).alias("edge"),
        (rest - (F.col("b.cum") - F.col("b.words"))).alias("rest")), "mix-blocks")

    # quotas, one draw for each block of an epoch; the tree; the draws of each shard
    n_draws = blocks.groupBy("source").agg(
        F.count(F.lit(1)).alias("filled"),
        F.sum(F.when(F.col("whole") | F.col("edge"), 1).otherwise(0)).alias("part"))
    quotas = n_draws.alias("q").join(s, same(F.col("q.source"), F.col("s.source"))).select(
        "q.source", (F.col("epochs") * F.col("filled") + F.col("part")).alias("quota"), "filled")
    quotas = materialize(quotas, "mix-quotas")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    leaf = materialize(split_quotas(quotas.select("source", "quota"), (shards - 1).bit_length(), seed), "mix-leaves")
    leaf = _running(leaf, F.floor(F.col("shard") / SHARD_BUCKET), [F.col("shard")], {"first": F.col("quota")})
    draw = leaf.select("source", "shard", F.explode(F.sequence(
        F.col("first"), F.col("first") + F.col("quota") - 1)).alias("j")).alias("d")
    draw = draw.join(quotas.alias("q"), same(F.col("d.source"), F.col("q.source"))).select(
        "d.source", "shard", F.floor(F.col("j") / F.col("filled")).alias("epoch"),
        (F.col("j") % F.col("filled")).alias("p")).alias("d")
    b = blocks.alias("b")
    given = draw.join(b, same(F.col("d.source"), F.col("b.source")) & (F.col("d.p") == F.col("b.p")))
    given = given.join(s, same(F.col("d.source"), F.col("s.source")))
    part = F.col("edge") & (F.col("d.epoch") == F.col("s.epochs"))
    given = given.select("b.source", "b.block", F.struct("d.epoch", "d.shard", part.alias("part")).alias("draw"))
    given = given.groupBy("source", "block").agg(F.sort_array(F.collect_list("draw")).alias("given"))

    edge = _boundary(units, blocks.where("edge").select("source", "block", "rest")).alias("e")
    given = given.alias("g").join(edge, same(F.col("g.source"), F.col("e.source")), "left")
    given = materialize(given.select("g.source", "g.block", "given", "cut", "order", "steps", "but", "extra"),
                        "mix-given").alias("g")

    d = d.alias("d").join(s, same(F.col("d." + tmp("source")), F.col("s.source")))
    h = F.col("d." + tmp("h"))
    at_block = same(F.col("d." + tmp("source")), F.col("g.source")) & (F.pmod(h, F.col("s.blocks")) == F.col("g.block"))
    d = d.join(given, at_block, "left")
    fills = _fills(h, F.col("d." + tmp("size")), "g")
    draws = F.filter(F.coalesce(F.col("g.given"), F.array().cast(given.schema["given"].dataType)),
                     lambda x: ~x["part"] | F.coalesce(fills, F.lit(False)))
    draws = F.transform(draws, lambda x: F.struct(
        x["epoch"].alias("epoch"), x["shard"].alias("shard"),
        F.xxhash64(F.lit(seed + 3), x["shard"], x["epoch"], h).alias("place")))
    new = {"size": F.col("d." + tmp("size")), "source_size": F.col("s.source_size"),
           "target": F.col("s.target"), "draws": draws}
    kept = [F.col("d.`" + c.replace("`", "``") + "`") for c in docs.columns if c not in new]
    return d.select(*kept, *[v.alias(c) for c, v in new.items()])


def shards(mixed: DataFrame) -> DataFrame:
    """One row for each time that the mix takes a row, with ``epoch``,
    ``shard`` and ``place``; each shard in the order of its places."""
    d = mixed.select(*[column(mixed, c) for c in mixed.columns if c not in ("draws", "epoch", "shard", "place")],
                     F.inline("draws"))
    return d.repartition("shard").sortWithinPartitions("shard", "place")
