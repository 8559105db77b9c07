import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from carrierlens.plans.oracle import SQL
from carrierlens.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 9) if hasattr(v, "__float__") and not isinstance(v, str) else v
    return sorted(str([plain(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    if name in SQL:
        assert rows(got) == rows(duck.execute(SQL[name]).df())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_is_listed():
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"html_page", "output_size_limit"}
