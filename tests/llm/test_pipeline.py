"""The pipeline's stages over the smallest tables, each against a plain version of its decision."""

from collections import defaultdict

import corpus_pipeline as cp
from __spark_entry__ import oracle_sql, queries
from babelgrid.session import materialize

from .test_models import plain_counts
from .test_native import plain_lines, plain_overlaps
from .test_simhash import brute


def test_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, steps = docs.columns, {}
    before = docs.collect()
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, small_dir), name)
        steps[name] = (before, docs.collect())
        before = steps[name][1]
        if name != "mix":
            assert docs.columns == columns
    old, new = steps["quality"]
    kept = {r.doc_id for r in new}
    for r in old:
        n, _, _, _, rep = plain_counts(r.text)
        assert not (r.doc_id in kept and (n < 20 or 100 * rep > 30 * n))
    assert len(new) > 0.7 * len(old)
    old, new = steps["lines"]
    want = plain_lines([(r.doc_id, r.text, r.source) for r in old], 0.08, 5)
    assert sorted(((r.doc_id, r.text) for r in new), key=str) == [(k, t) for k, t, *_ in want]
    assert all(r.n_chars == len(r.text) for r in new)
    old, new = steps["near_duplicates"]
    assert {r.doc_id for r in new} == {c for _, _, c in brute([(r.doc_id, r.text) for r in old])}
    old, new = steps["decontaminate"]
    items = [tuple(r) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").select("item_id", "text").collect()]
    gone = {r.doc_id for r in old} - {r.doc_id for r in new}
    near = [(r.doc_id, r.text, None) for r in old if r.doc_id in gone]
    assert {k for k, _ in plain_overlaps(near, items)} == gone
    whole = {r.doc_id for r in old if any(t in r.text for _, t in items)}
    assert whole <= gone
    old, new = steps["mix"]
    taken = defaultdict(int)
    for r in new:
        taken[r.doc_id] += 1
    assert set(taken) <= {r.doc_id for r in old} and max(taken.values()) <= 3


def test_registered():
    names = queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2:3].isdigit() for n in names) == 13
    assert {"op1_decontaminate", "op9_line_dedup", "op11_conversation_repair", "op12_substring_dedup", "op13_merkle"} <= set(oracle_sql())
