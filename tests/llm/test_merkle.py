"""The manifest against a plain tree in Python, with awkward rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from babelgrid.llm import merkle
from babelgrid.llm.common import numbered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos long, leaf string, node int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes, arity):
    """(root, path of every leaf); a path is a list of (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(paths):
            i = at[k]
            first = i - i % arity
            p.append(("".join(nodes[first:i]), "".join(nodes[i + 1:first + arity])))
            at[k] = i // arity
        nodes = [H(*nodes[k:k + arity]) for k in range(0, len(nodes), arity)]
    return nodes[0], paths


def plain(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    out, subroots = [], []
    for g in order:
        ls = sorted(((r[0], leaf_of(r[0], r[3], r[2], r[4], r[1]), r) for r in groups[g]),
                    key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subroot, paths = tree([x[1] for x in ls], arity)
        subroots.append(subroot)
        out.append([(x, subroot, p) for x, p in zip(ls, paths)])
    root, upper = tree(subroots, arity) if subroots else (None, [])
    rows = []
    for part, up in zip(out, upper):
        for (doc_id, leaf, r), subroot, path in part:
            path = path + up
            n = r[4]
            if n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
                n += 1
            acc = leaf_of(r[0], r[3], r[2], n, r[1])
            for left, right in path:
                acc = H(left, acc, right)
            rows.append((doc_id, leaf, subroot, root, H(*[a + b for a, b in path]), acc, acc == root))
    return sorted(rows, key=str)


def rows_of(n):
    rows = [(k, f"text {k}" if k % 5 else ["", None][k % 2], [None, "", "a", "é", "b"][k % 5 if k % 3 else 2],
             None if k % 11 == 0 else "s", None if k % 7 == 0 else k) for k in range(n)]
    return [*rows, rows[3], rows[3], (None, None, None, None, None), (None, "x", None, None, 1), (1, "x" * 100000, "a", "s", 1)]


@pytest.mark.parametrize("arity, block, n", [(2, 4096, 40), (2, 4, 60), (3, 9, 100)])
def test_manifest(spark, monkeypatch, arity, block, n):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = rows_of(n)
    docs = spark.createDataFrame([(*r, "g", 5, "leaf", 1) for r in rows], SCHEMA)
    bad = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.verify(merkle.manifest(docs, tampered={"n_chars": bad}, arity=arity))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, arity)


def test_single_and_empty(spark):
    one = spark.createDataFrame([(7, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = merkle.verify(merkle.manifest(one)).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == H("") and r.verified
    assert merkle.verify(merkle.manifest(one.where("false"))).collect() == []


def test_numbered_splits_a_hot_group(spark):
    d = spark.range(20000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 20000).alias("k"))
    joined = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(joined, "false")
    try:
        got = numbered(d, ["g"], [F.col("k").asc()], "n", "test-numbered")
        assert got.where("k <> n").count() == 0
        assert len(set(got.inputFiles())) > 1
    finally:
        spark.conf.unset(joined)
