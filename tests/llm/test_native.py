"""Line dedup, decontamination and mixing on small fixtures with every awkward case."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from babelgrid.llm import decontamination as dc
from babelgrid.llm import line_dedup as ld
from babelgrid.llm import mixing as mx
from babelgrid.session import materialize

DOCS = "doc_id long, text string, source string, n_lines int, size string, item_id int"


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, s, 1, "x", 2) for k, t, s in rows], DOCS)


# --- line dedup ---------------------------------------------------------------

def plain_lines(rows, ratio, least):
    pages, having = Counter(), defaultdict(Counter)
    for _, t, s in rows:
        pages[s] += 1
        having[s].update({x.strip(" ") for x in (t or "").split("\n")} - {""} if t is not None else set())
    out = []
    for k, t, s in rows:
        if t is None:
            out.append((k, None, 0, 0))
            continue
        old = t.split("\n")
        new = [x for x in old if not (x.strip(" ") and having[s][x.strip(" ")] >= least
                                      and having[s][x.strip(" ")] > ratio * pages[s])]
        out.append((k, "\n".join(new), len(old), len(old) - len(new)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(2)
    rows = []
    for n in range(120):
        lines = [f"own line {n} {k}" for k in range(rng.randint(0, 4))]
        if rng.random() < 0.6:
            lines.insert(0, rng.choice(["  menu home", "menu home ", "menu home"]))
        if rng.random() < 0.2:
            lines += ["rare", "", "rare"]
        rows.append((n % 100, "\n".join(lines), rng.choice(["a", "a", "b", None])))
    rows += [(None, None, "a"), (7, "", "a"), (8, "menu home", "tiny"), (9, "menu home\n" * 400, "a"), rows[0], rows[0]]
    got = ld.drop_boilerplate(docs_of(spark, rows), max_ratio=0.3, min_pages=5)
    assert got.columns == [*DOCS.replace(",", "").split()[::2], "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == plain_lines(rows, 0.3, 5)
    assert ld.drop_boilerplate(docs_of(spark, [])).collect() == []


# --- decontamination ----------------------------------------------------------

def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def plain_overlaps(rows, items, window=13, share=0.8):
    out = {}
    for i, it in items:
        b = words(it)
        if len(b) < 7:
            continue
        w = min(window, len(b))
        for k, t, _ in rows:
            d = words(t)
            for shift in range(-len(b), len(d)):
                eq = [0 <= shift + j < len(d) and d[shift + j] == b[j] for j in range(len(b))]
                best = max(sum(eq[s:s + w]) for s in range(len(b) - w + 1))
                if best >= share * w:
                    out[k, i] = max(best, out.get((k, i), (0,))[0]), w
    return out


@pytest.fixture(scope="module")
def contaminated():
    rng = random.Random(6)
    vocab = [f"w{n}" for n in range(400)]

    def text(n):
        return [rng.choice(vocab) for _ in range(n)]

    items = [(n, " ".join(text(rng.choice([7, 9, 20, 40])))) for n in range(12)]
    items += [(50, None), (51, ""), (52, "too short"), (53, items[3][1].upper() + "!"), (None, items[4][1])]
    rows = []
    for n in range(60):
        body = text(rng.choice([0, 5, 60, 200]))
        if n % 3 == 0:
            _, it = items[n % 12]
            passage = it.split()
            if n % 2 and len(passage) > 12:
                passage[5] = "changed"  # one substitution
            at = rng.randint(0, len(body))
            body[at:at] = passage
        rows.append((n, ", ".join(body).replace(",", ",", 1), "s"))
    rows += [(None, items[0][1], "s"), (90, None, "s"), (91, "", "s"), rows[3], (3, "clean text", "s")]
    return rows, items


def test_overlaps(spark, contaminated):
    rows, items = contaminated
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (dc.MAX_SEEDS, 40):  # one pass, and the benchmark in blocks
        got = dc.overlaps(docs_of(spark, rows), bench, ["doc_id"], max_seeds=limit).collect()
        assert len(got) == len({(r.doc_id, r.item_id) for r in got})
        assert {(r.doc_id, r.item_id): (r.matched, r.window) for r in got} == plain_overlaps(rows, items)


def test_hits_carry_a_block_not_the_text(spark):
    """160,000 hits in one text: with its 40,000 words in each of them they would take 51 GB."""
    item = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(item * 1000), "s"), (2, " ".join(item[:9] + ["x"] + item[10:13]), "s"), (3, " ".join(item[:9]), "s")]
    got = dc.overlaps(docs_of(spark, rows), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"), ["doc_id"])
    assert {(r.doc_id, r.item_id, r.matched) for r in got.collect()} == {(1, 7, 13), (2, 7, 12)}


def test_passages_across_blocks(spark):
    """A window anywhere in a text and anywhere in an item, each of several blocks."""
    item = [f"i{k}" for k in range(3 * dc.BLOCK + 5)]
    other = [f"o{k}" for k in range(dc.BLOCK + 1)]
    rows = []
    for at in range(len(item) - dc.WINDOW + 1):
        passage = item[at:at + dc.WINDOW]
        passage[at % dc.WINDOW] = "changed"
        before = at * 7 % (2 * dc.BLOCK + 9)
        rows.append((at, " ".join([f"b{k}" for k in range(before)] + passage + ["after"] * (at % 3 * dc.BLOCK)), "s"))
    rows += [(1000 + n, " ".join(["x"] * n + other), "s") for n in (0, 1, dc.BLOCK - 1, dc.BLOCK)]
    bench = [(1, " ".join(item)), (2, " ".join(other)), (3, " ".join(item[5:12]))]
    got = dc.overlaps(docs_of(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), ["doc_id"]).collect()
    assert {(r.doc_id, r.item_id): (r.matched, r.window) for r in got} == plain_overlaps(rows, bench)
    assert {r.doc_id for r in got} == {k for k, _, _ in rows}


def test_one_pass_at_a_time(spark, contaminated):
    """A benchmark in blocks: no plan holds the tables of more than one."""
    rows, items = contaminated
    out = dc.overlaps(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], max_seeds=600)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= 2


def test_short_seeds_hit_every_substitution():
    for n in range(1, 13):
        subs = 0 if n < 7 else max(s for s in range(n) if n - s >= 0.8 * n)
        for changed in combinations(range(n), subs):
            assert any(all(mask[p - at] == "0" for p in changed if at <= p < at + len(mask))
                       for mask, at in dc.short_seeds(n)), (n, changed)
    assert {mask for n in range(1, 13) for mask, _ in dc.short_seeds(n)} == {"1", "11", "111"}
    assert {mask for n in range(1, 13) for mask, _ in dc.short_seeds(n, 0.6)} <= {"1", "11", "111"}


def test_sql_twin_with_short_items(spark, tmp_path):
    """The twin agrees for items of every length, with substitutions inside and at the edges of texts."""
    import duckdb
    rng = random.Random(9)
    items = [(n, " ".join(f"i{n}w{k % 5}" for k in range(n))) for n in range(1, 31)] + [(40, ""), (41, None), (42, "i3w0 i3w1 i3w2")]
    rows = []
    for k in range(300):
        w = words(rng.choice(items[:30])[1])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "x"
        body = [rng.choice("abc") for _ in range(rng.randint(0, 6))]
        at = rng.randint(0, len(body))
        rows.append((k, " ".join(body[:at] + w[rng.choice([0, 0, 1, 2]):] + body[at:])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", bench.toPandas())
    want = con.sql(dc.SQL).fetchall()
    got = [(r.doc_id, r.item_id, r.matched, r.window) for r in dc.overlaps(docs, bench, ["doc_id"]).collect()]
    assert sorted(got) == sorted(want) and len(want) > 200


def test_short_items_are_found(spark):
    items, rows = [], []
    for n in range(1, 13):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        subs = 0 if n < 7 else max(s for s in range(n) if n - s >= 0.8 * n)
        for changed in combinations(range(n), subs):
            copy = ["changed" if k in changed else w for k, w in enumerate(item)]
            edge = len(rows) % 3  # at the start, inside, at the end
            rows.append((len(rows), " ".join(["before"] * (edge > 0) + copy + ["after"] * (edge < 2)), str(n)))
        rows.append((len(rows), " ".join(["other"] * (subs + 1) + item[subs + 1:]), "none"))
    got = dc.overlaps(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"])
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k, int(s)) for k, _, s in rows if s != "none"}


def test_decontaminate(spark, contaminated):
    rows, items = contaminated
    df = docs_of(spark, rows)
    out = dc.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == df.columns
    bad = {(k, t) for k, t, s in rows if plain_overlaps([(k, t, s)], items)}
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((k, t) for k, t, _ in rows if (k, t) not in bad)
    assert dc.decontaminate(df, spark.createDataFrame([], "item_id long, text string")).count() == len(rows)
    assert dc.decontaminate(df.where("false"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# --- mixing -------------------------------------------------------------------

def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: float(1 + n % 3) for n, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), list(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.fixture(scope="module")
def mixture(spark):
    rng = random.Random(9)
    rows = [(n, "word x " * rng.choice([0, 1, 3, 8, 40]), rng.choice(["b", "b", "b", "a", "é", "Z", None])) for n in range(900)]
    rows += [(5000, None, "a"), (5001, "", "empty"), (None, "a b c", "b"), rows[3], rows[3], (5002, "x " * 700, "Z")]
    return rows, docs_of(spark, rows).repartition(5)


def test_mix(spark, mixture):
    rows, df = mixture
    got = mx.mix(df, block_words=60, shard_words=500)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "item_id", "size", "source_size", "target", "draws"]
    out = got.collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").replace(" ", "_").split())
    want, taken = plain_targets(sizes), defaultdict(int)
    shards = defaultdict(set)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert len(r.draws) <= 3 and len({d.epoch for d in r.draws}) == len(r.draws)
        taken[r.source] += r["size"] * len(r.draws)
        for d in r.draws:
            shards[d.shard].add(r.source)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(4, 0.01 * t), (s, taken[s], t)
    assert len(shards) > 4

    def key(rs):
        return sorted((str(r.doc_id), r.text, sorted(map(tuple, r.draws))) for r in rs if r.text)
    again = mx.mix(df.repartition(3), block_words=60, shard_words=500).collect()
    assert key(again) == key(out)


def test_the_boundary_block_is_filled(spark):
    rng = random.Random(4)
    units, edge = [], []
    for n in range(60):  # sources: each one long document among short ones, in another order of hashes
        size, many = rng.choice([(400, 340), (100, 1300)])
        rows = [(rng.getrandbits(60), size + rng.randint(-9, 9)) for _ in range(many)] + [(rng.getrandbits(60), 120_000)]
        rows += [r for r in rows if rng.random() < 0.05 * (n % 2)]  # repeated rows are taken together
        units += [(str(n), 0, h, k) for h, k in rows] + [(str(n), 0, -5, 0), (str(n), 1, 7, 10)]
        edge.append((str(n), 0, rng.choice([0.4, 0.3, 0.7]) * sum(k for _, k in rows)))
    df = spark.createDataFrame(units, "source string, block long, h long, size long")
    got = mx._boundary(df, spark.createDataFrame(edge, "source string, block long, rest double")).alias("g")
    d = df.where("block = 0").alias("d").join(got, "source").where(mx._fills(F.col("d.h"), F.col("d.size"), "g"))
    taken = {r.source: r for r in d.groupBy("source").agg(F.sum("size").alias("words"), F.min("size").alias("least")).collect()}
    for s, _, rest in edge:
        assert abs(taken[s].words - rest) < 900 and taken[s].least == 0, (s, taken[s], rest)


def test_a_long_document_does_not_end_the_mix(spark):
    rows = [(n, "w " * (120 if n % 340 else 36_000), "ab"[n // 340]) for n in range(680)]
    out = mx.mix(docs_of(spark, rows), seed=2).collect()
    for s in "ab":
        miss = sum(r["size"] * len(r.draws) for r in out if r.source == s) - next(r.target for r in out if r.source == s)
        assert abs(miss) <= 60


def test_shards_hold_the_draws(spark, mixture):
    _, df = mixture
    mixed = mx.mix(df, block_words=60, shard_words=500)
    got = mx.shards(mixed).select("shard", "place", F.spark_partition_id().alias("part")).collect()
    assert len(got) == mixed.agg(F.sum(F.size("draws"))).first()[0]
    seen = {}
    for r in got:  # a shard is whole in its task, and in the order of places there
        assert r.part == seen.get(r.shard, (r.part,))[0] and r.place >= seen.get(r.shard, (0, r.place))[1]
        seen[r.shard] = (r.part, r.place)
    assert mx.mix(df.where("false")).collect() == []


def test_hypergeometric_law(spark):
    d = spark.range(20000).select(mx.hypergeometric(F.lit(30), F.lit(12), F.lit(10), (F.col("id") + 0.5) / 20000).alias("x"))
    from math import comb
    got = {r.x: r["count"] / 20000 for r in d.groupBy("x").count().collect()}
    for x in range(11):
        assert abs(got.get(x, 0) - comb(12, x) * comb(18, 10 - x) / comb(30, 10)) < 2e-4
    edge = spark.range(1).select(mx.hypergeometric(F.lit(9), F.lit(9), F.lit(4), F.lit(0.3)).alias("a"),
                                 mx.hypergeometric(F.lit(9), F.lit(0), F.lit(4), F.lit(0.3)).alias("b"))
    assert tuple(edge.first()) == (4, 0)


def test_quotas_are_split_exactly(spark):
    q = [("a", 37), ("b", 5), (None, 1), ("c", 80)]
    leaf = mx.split_quotas(spark.createDataFrame(q, "source string, quota long"), 3).collect()
    total = defaultdict(int)
    for r in leaf:
        total[r.source] += r.quota
    assert dict(total) == dict(q)
    per = defaultdict(int)
    for r in leaf:
        per[r.shard] += r.quota
    assert max(per.values()) - min(per.values()) <= 3 and len(per) == 8


def test_quotas_of_very_many_sources(spark):
    """100,000 sources, one with a third of all draws: no row holds more than a chunk of them."""
    q = spark.range(100_000).select(F.concat(F.lit("host"), "id").alias("source"), F.lit(2).cast("long").alias("quota"))
    q = q.unionAll(spark.sql("select cast(null as string) as source, 100000L as quota"))
    leaf = materialize(mx.split_quotas(q, 3), "leaf")
    total = leaf.groupBy("source").agg(F.sum("quota").alias("got")).alias("t")
    wrong = q.alias("q").join(total, F.col("q.source").eqNullSafe(F.col("t.source")), "full").where("not (quota <=> got)")
    assert wrong.count() == 0
    per = {r.shard: (r.n, r.hot) for r in leaf.groupBy("shard").agg(
        F.sum("quota").alias("n"), F.sum(F.when(F.col("source").isNull(), F.col("quota"))).alias("hot")).collect()}
    assert len(per) == 8 and max(n for n, _ in per.values()) - min(n for n, _ in per.values()) <= 3
    assert all(abs(hot - 12_500) < 5 * (100_000 / 8) ** 0.5 for _, hot in per.values())
    both = leaf.where("quota = 2").count() / 100_000  # two draws of a source share a shard by chance 1/8
    assert abs(both - 1 / 8) < 0.01


def test_targets_of_many_sources(spark):
    rng = random.Random(3)
    sizes = {f"s{n}": int(10 ** rng.uniform(0, 6)) for n in range(2000)} | {None: 7, "": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mx.source_targets(df).collect()}
    want = plain_targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - t) <= 1e-9 * max(1, t) for s, t in want.items())
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-3
    again = mx.source_targets(df.repartition(7)).collect()
    assert {r.source: r.target for r in again} == got
    low = {r.source: r.target for r in mx.source_targets(df, (1, 0), 0.5).collect()}
    assert all(t in (0, 0.5 * sizes[s]) for s, t in low.items()) and low[None] in (0, 3.5)


def test_hypergeometric_of_millions(spark):
    total, good, n = 40_000_000, 9_000_000, 20_000_000
    d = spark.range(400).select(mx.hypergeometric(
        F.lit(total).cast("long"), F.lit(good).cast("long"), F.lit(n).cast("long"), (F.col("id") + 0.5) / 400).alias("x"))
    x = [r.x for r in d.collect()]
    sd = (n * good / total * (1 - good / total) * (total - n) / (total - 1)) ** 0.5
    assert x == sorted(x) and abs(sum(x) / 400 - n * good / total) < 0.05 * sd
    assert abs((sum((v - n * good / total) ** 2 for v in x) / 400) ** 0.5 - sd) < 0.05 * sd


def test_running_sums_by_bucket(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", None]), n, rng.randint(0, 9)) for n in range(500)]
    d = spark.createDataFrame(rows, "source string, at long, v long")
    got = mx._running(d, F.floor(F.col("at") / 16), [F.col("at")], {"before": F.col("v"), "n": F.lit(1)}).collect()
    for r in got:
        mine = [v for s, n, v in rows if s == r.source and n < r["at"]]
        assert (r.before, r.n) == (sum(mine), len(mine))
    assert len(got) == 500


def test_the_mix_has_no_window_over_everything(spark, mixture, monkeypatch):
    plans = []

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return materialize(df, name)

    monkeypatch.setattr(mx, "materialize", seen)
    mx.mix(mixture[1], block_words=60, shard_words=500).collect()
    for name, plan in plans:
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
        # the numbering's offsets are a row for each task that wrote its table
        assert "Exchange SinglePartition" not in plan or name == "mix-caps", name
