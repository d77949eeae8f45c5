"""Logs and evidence on small files."""

import hashlib
import random

import pytest

from marlstone.plans import evidence, logs


def lines(spark, files):
    rows = [(p, k, x) for p, text in files.items() for k, x in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "path string, line_no long, line string")


def test_headers(spark):
    text = "# Log\n## [2026-01-02] ingest | A\n## 2026-01-03 | Synthesis-pass | B\n## 2026-01-04\n## 2026-01-05 | 12 things\n## no date\n```\n## [2026-01-06] x\n```\n## [2026-01-07] lint"
    df = lines(spark, {"log.md": text, "other.md": "```\n## [2026-01-01] x"})
    got = {(r["path"], r["line_no"]): (r["date"], r["type"]) for r in logs.with_headers(df).filter("date IS NOT NULL").collect()}
    assert got[("log.md", 2)] == ("2026-01-02", "ingest") and got[("log.md", 3)] == ("2026-01-03", "synthesis-pass")
    assert got[("log.md", 4)] == ("2026-01-04", None) and got[("log.md", 5)] == ("2026-01-05", None) and ("log.md", 6) not in got
    bad = {(r["path"], r["detail"].split(":")[0]) for r in logs.header_findings(df).collect()}
    assert bad == {("log.md", "line 6"), ("log.md", "line 8"), ("other.md", "line 2")}


GOOD = 'Stale-text sweep: status=completed; commands=["rg -n -i -- \'a; b\' wiki"]; hit_count=2; pages_fixed=[]; historical_no_change_hits=["x"]'


@pytest.mark.parametrize(
    ("line", "error"),
    [
        (GOOD, None),
        ('Stale-text sweep: status=not_applicable; reason="no; change"', None),
        ("Stale-text sweep:", "missing status field"),
        ("Sweep", "line must start with 'Stale-text sweep:'"),
        ("Stale-text sweep: status=done", "status must be completed or not_applicable"),
        (GOOD.replace("hit_count=2", "hit_count=-2"), "hit_count must be a non-negative integer"),
        (GOOD.replace("; hit_count=2", ""), "completed proof missing field(s): hit_count"),
        (GOOD + "; more=1", "completed proof has unexpected field(s): more"),
        (GOOD + "; status=completed", "duplicate field 'status'"),
        (GOOD.replace("-n -i", "-i -n"), "commands entries must use exactly -n -i before --"),
        (GOOD.replace(" wiki", " raw"), "commands entries must search the wiki root (wiki or wiki/)"),
        ('Stale-text sweep: status=not_applicable; reason=" "', "reason must be a non-empty JSON string"),
        ('Stale-text sweep: status="x', "unterminated quoted string"),
        ("Stale-text sweep: status=]", "unbalanced JSON brackets"),
        ("Stale-text sweep: status", "field segment missing '=': 'status'"),
    ],
)
def test_proofs(line, error):
    assert logs.proof_error(line) == error


def test_proof_findings(spark):
    text = f"## [2026-07-01] ingest | old\n## [2026-07-06] ingest | none\nwords\n## [2026-07-07] ingest | good\n{GOOD}\n## [2026-07-08] lint | x\n## [2026-07-09] ingest | bad\nStale-text sweep:\nStale-text sweep:\n## [2026-13-01] ingest | when"
    got = {r["detail"] for r in logs.proof_findings(lines(spark, {"log.md": text})).collect()}
    assert got == {
        "line 2: ingest entry dated 2026-07-06 is missing structured Stale-text sweep proof", "line 7: ingest entry has multiple Stale-text sweep proof lines", "line 8: missing status field", "line 9: missing status field",
        "line 10: ingest entry date 2026-13-01 is not a real calendar date",
    }


def test_rotation(spark):
    entries = [f"## [2026-01-{d:02d}] ingest | {d}\nbody\n" for d in range(1, 21)]  # three lines each
    text = "# Log\n\nHead.\n" + "\n".join(entries)
    df = lines(spark, {"log.md": text, "short.md": "# Log\n## [2026-01-01] x", "stuck.md": "## [2026-01-01] a\n## [2026-01-02] b" + "\nx" * 60})
    n = len(text.split("\n"))
    assert n == 63  # three of the head, and sixty
    (plan,) = logs.rotation_plan(df, 40).collect()
    # the head gets a blank line, a pointer takes two, the new entry eight: 63 + 11 - 3 * 12 <= 40
    assert (plan["path"], plan["moved"], plan["kept"], plan["before"], plan["after"]) == ("log.md", 12, 8, 63, 38)
    assert plan["archive"] == "archive/wiki-log/2026-01-01-to-2026-01-12.md"
    moved = logs.archived_lines(df, logs.rotation_plan(df, 40)).orderBy("line_no").collect()
    assert [r["line_no"] for r in moved] == list(range(4, 40))
    with pytest.raises(ValueError):
        logs.rotation_plan(df, logs.WARN_LINES)


PAGES = [("wiki/a.md", "# A\nOne (source: [[x]]).\nTwo (source: [[y]] and [[x]], [[y]]).\r\nnone [[x]]\n## Referenced by\nsource: [[z]]\n"), ("wiki/b.md", "# A\nOne (source: [[x]]).\nsource: [[Not-a-slug]]\nlast source: [[q]]"), ("wiki/c.md", None)]


def test_claims(spark):
    got = evidence.claims(spark.createDataFrame(PAGES, "path string, text string")).orderBy("path", "line_number").collect()
    assert [(r["path"], r["line_number"], r["cited_slugs"]) for r in got] == [("wiki/a.md", 2, ["x"]), ("wiki/a.md", 3, ["y", "x"]), ("wiki/b.md", 2, ["x"]), ("wiki/b.md", 4, ["q"])]
    for r in got:
        assert r["claim_id"] == hashlib.sha256(f"{r['path']}\0{r['line_number']}\0{r['line_text']}".encode()).hexdigest()
    assert got[1]["line_text"].endswith("\r\n") and got[0]["line_text"] == got[2]["line_text"] and got[0]["claim_id"] != got[2]["claim_id"]


def test_run(spark):
    pages = [(f"wiki/p{k:02d}.md", "".join(f"line {j} (source: [[s{j}]]).\n" for j in range(k % 4))) for k in range(20)]
    found = evidence.claims(spark.createDataFrame(pages, "path string, text string")).cache()
    every = [r["claim_id"] for r in found.orderBy("path", "line_number", "claim_id").collect()]
    drawn = evidence.sample(found, 42, 7).cache()
    assert [r["claim_id"] for r in drawn.orderBy("place").collect()] == random.Random(42).sample(every, 7)
    assert evidence.sample(found.limit(0), 42, 7).count() == 0
    first = drawn.filter("place = 1").first()["claim_id"]
    items = evidence.batches(drawn, "something else", first, 3).cache()
    rows = items.orderBy("item_id").collect()
    assert [(r["item_id"], r["batch_id"]) for r in rows] == [(f"item-{k:03d}", f"batch-{(k - 1) % 3 + 1:02d}") for k in range(1, 9)] and rows[-1]["kind"] == "plant"
    told = lambda bad: spark.createDataFrame([(r["item_id"], bad.get(r["item_id"], "VERIFIED")) for r in rows if bad.get(r["item_id"]) != "-"], "item_id string, verdict string")
    assert evidence.run_errors(drawn, items, told({"item-008": "MISMATCH"})).count() == 0
    assert tuple(evidence.metrics(items, told({"item-008": "MISMATCH", "item-002": "CONFLATED"})).first()) == (7, 3, 1, "MISMATCH")
    bad = {r["error"] for r in evidence.run_errors(drawn, items.filter("item_id <> 'item-003'"), told({"item-002": "MAYBE"})).collect()}
    assert any(e.startswith("sample-to-batch claims: missing") for e in bad) and "plant: returned VERIFIED instead of being caught" in bad and "verdict item-002: invalid verdict" in bad and "batch-to-verdict item IDs: duplicated or excess item-003" in bad
    changed = spark.createDataFrame([(p, t + "x" if p == "wiki/p03.md" else t) for p, t in pages if p != "wiki/p07.md"], "path string, text string")
    errors = {(r["path"], r["error"]) for r in evidence.stale(found, changed).collect()}
    assert errors == {("wiki/p03.md", "file hash changed"), ("wiki/p07.md", "file is gone")}
