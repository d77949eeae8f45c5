"""Ledgers on small files."""

import pytest
from pyspark.sql import functions as F

from marlstone.plans import ledger

SCHEMA = '{"record_type":"schema","schema_version":1,"description":"d"}'


def found(spark, text):
    df = ledger.findings(spark.createDataFrame([("l", text)], "path string, text string"))
    return sorted((r["line_no"] or 0, r["detail"]) for r in df.collect())


@pytest.mark.parametrize(("depth", "says"), [(129, "record must be a JSON object"), (130, "invalid JSON: maximum nesting depth exceeded"), (200_000, "invalid JSON: ")])
def test_depth(spark, depth, says):
    got = found(spark, SCHEMA + "\n" + "[" * depth + "]" * depth)
    assert len(got) == 1 and got[0][0] == 2 and got[0][1].startswith(says)


def test_edges(spark):
    assert found(spark, None) == found(spark, "") == [(0, "expected exactly one schema record, found 0")]
    assert found(spark, SCHEMA + "\n\n") == [(2, "blank lines are not allowed")]
    assert found(spark, SCHEMA) == found(spark, SCHEMA + "\n") == []
    rows = spark.createDataFrame([], "path string, text string")
    assert ledger.findings(rows).count() == 0


def test_record_repeated_often(spark):
    record = '{"record_type":"capture_approval","run_id":"%d","pages_touched":["wiki/a.md"]}'
    got = found(spark, "\n".join([SCHEMA, *(record % k for k in range(500))]))
    assert got == [(k, "duplicate approval record") for k in range(3, 502)]


def test_odd_record_type(spark):
    assert found(spark, SCHEMA + '\n{"record_type":["a"]}') == [(2, "unsupported record_type ['a']")]


def test_scope(spark):
    df = spark.createDataFrame([(" a, b,,a ,\t",), (None,)], "s string").select(ledger.scope(F.col("s")).alias("s"))
    assert [r["s"] for r in df.collect()] == [["a", "b"], None]
    assert not any(map(ledger.in_scope, ("raw/a.md", "/wiki/a.md", "wiki//a.md", "wiki/./a.md", "wiki/", "OTHER.md"))) and ledger.in_scope("wiki/a.md")
