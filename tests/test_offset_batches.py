"""Offsets of a window's tokens from whole Arrow batches, against ``re``."""

import re

from pyspark.sql import functions as F

from babelgrid.operators import features as D
from babelgrid.plans import QUERIES

from .test_plans import plan_of


def test_offsets_by_the_batch(spark, small_dir):
    texts = ["", " ", "ab  cd", "　é \U0001f600x ", "\x1c\x1fa​b ᠎", "w " * 300, None]
    df = spark.createDataFrame([(i, t, 10 * i) for i, t in enumerate(texts)], "i int, t string, b long")
    got = {r["i"]: r["o"] and [tuple(o) for o in r["o"]] for r in
           df.select("i", D.token_offsets(F.col("t"), F.col("b")).alias("o")).collect()}
    assert got == {i: None if t is None else [(10 * i + m.start(), 10 * i + m.end()) for m in re.finditer(r"\S+", t)]
                   for i, t in enumerate(texts)}
    p = plan_of(QUERIES["qa_offset_mask"](spark, small_dir))
    assert "ArrowEvalPython" in p and "Exchange hashpartitioning" not in p
