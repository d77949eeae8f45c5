"""Queries against their SQL twins on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from marlstone.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def views():
    for t in TABLES:
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in ("confidence_upgrade", "near_duplicate_pairs")])
def test_query_equals_its_twin(spark, views, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    names = [r[0] for r in duckdb.sql("DESCRIBE " + catalog.ORACLES[name]).fetchall()]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in duckdb.sql(catalog.ORACLES[name]).fetchall())
    assert Counter(tuple(map(plain, r)) for r in df.select(columns).collect()) == want


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
