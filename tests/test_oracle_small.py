"""Every registered query against its SQL twin on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

from .test_plans import assert_spreads

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _rows(pdf):
    cols = sorted(pdf.columns)

    def norm(v):
        if v is None:
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        return v
    return cols, Counter(tuple(str(norm(x)) for x in r) for r in pdf[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, small_dir, name):
    df = queries()[name](spark, small_dir)
    assert_spreads(df, name)
    sp = df.toPandas()
    dk = con.execute(oracle_sql()[name]).df()
    c1, r1 = _rows(sp)
    c2, r2 = _rows(dk)
    assert c1 == c2
    assert r1 == r2


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["task_lang", "transfer_lang", "accuracy", "f1_score"]
    assert df.count() > 0
