"""Declared counts and approvals on odd rows."""

import json

import pytest

from marlstone.plans import approvals, markers


def test_counts_of_any_length(spark):
    queue = spark.createDataFrame([("q", f"<!-- lint:entity-count folder=goals count={'9' * 40} --> <!-- lint:entity-count folder=people count=+1 -->")], "path string, text string")
    pages = spark.createDataFrame([("people/a.md",)], "path string")
    assert [tuple(r) for r in markers.drift(queue, pages).collect()] == [("q", "goals", "9" * 40, 0)]


@pytest.mark.parametrize(("text", "says"), [("", []), (None, []), ("<!-- lint:entity-count folder=goals count=1", []), ("<!-- lint:entity-count folder=goals count=1.5 -->", ["line 1: count '1.5' is not an integer"]), ("\n\n<!-- lint:entity-count count=1 -->", ["line 3: missing folder"])])
def test_marker_faults(spark, text, says):
    assert [r["detail"] for r in markers.findings(spark.createDataFrame([("q", text)], "path string, text string")).collect()] == says


def test_a_faulty_marker_takes_no_folder():
    found = markers.read_markers("<!-- lint:entity-count folder=goals -->\n<!-- lint:entity-count folder=goals count=1 -->")
    assert [(n, f, c) for n, f, c, _ in found] == [(1, None, None), (2, "goals", "1")]


def test_empty(spark):
    rows = spark.createDataFrame([], "path string, text string")
    assert markers.findings(rows).count() == markers.drift(rows, rows.select("path")).count() == approvals.findings(rows).count() == 0


@pytest.mark.parametrize("value", [None, [], {}, "\n", 10**30, -1.5, "9999-12-31T23:59:59-23:59", "0001-01-01T00:00:00+23:59"])
def test_any_value_in_any_field(value):
    fields = ("schema_version", "approval_status", "artifact", "primary_home", "route", "phase", "pages_touched", "approved_at", "synthesized_pages", "word_count", "domain_context", "triggers", "backfilled", *approvals.MEASUREMENT)
    for record_faults in (approvals.capture_faults, approvals.synthesis_faults):
        assert all(isinstance(record_faults(json.loads(json.dumps({"approved_at": "2026-08-01"} | {k: value}))), list) for k in fields)
        assert record_faults(dict.fromkeys(fields, value))
