"""File-tree rules and the gate on odd rows."""

import datetime

import pytest

from marlstone.plans import gate, tree

NOW = datetime.datetime(2026, 3, 11, tzinfo=datetime.timezone.utc)


def col(df):
    return sorted(r[0] for r in df.collect())


def test_empty(spark):
    docs, files = spark.createDataFrame([], "path string, text string"), spark.createDataFrame([], "path string, kind string")
    assert tree.export_files(files).count() == 0
    errors = col(tree.export_errors(files, files.select("path"), "x.zip"))
    assert errors == sorted(f"archive does not contain {p}" for p in tree.REQUIRED_FILES + tree.REQUIRED_FOLDERS)
    assert tree.wrapper_problems(docs, docs).count() == tree.backup_states(docs, NOW).count() == tree.document_links(docs).count() == 0
    assert col(tree.document_problems(docs, files, tree.Manifest(("a.md",), ("d",)))) == ["declared document is missing: a.md", "operational directory is missing: d"]


def test_long_chain_of_documents(spark, tmp_path):
    n = 12
    docs = spark.createDataFrame([(f"d/{k}.md", f"[next]({k + 1}.md) [next](./{k + 1}.md)") for k in range(n)] + [(f"d/{n}.md", ""), ("d/.md", "")], "path string, text string")
    assert col(tree.document_problems(docs, docs.select("path"), tree.Manifest(("d/0.md",), ("d",)))) == ["unreachable operational document: d/.md"]


@pytest.mark.parametrize(
    ("src", "target", "dst"),
    [("a/b.md", "c.md", "a/c.md"), ("a/b.md", "../../c.md", None), ("a/b.md", "../..", None), ("b.md", "x//./y.md", "x/y.md"), ("a/b.md", "..", ""), ("a/b.md", "< c.md >", ""), ("b.md", "\n c.md\t'title'", "c.md"), ("b.md", "/c.md", None)],
)
def test_link_targets(spark, src, target, dst):
    found = tree.document_links(spark.createDataFrame([(src, f"[x]({target})")], "path string, text string")).collect()
    assert [r["dst"] for r in found] == ([dst] if target != "< c.md >" else [])


@pytest.mark.parametrize("text", ["", "nul", "[" * 100_000, '{"schema_version": 1}', "null"])
def test_bad_receipts(spark, text):
    row = tree.backup_states(spark.createDataFrame([("r", text)], "path string, text string"), NOW).first()
    assert row["state"] == "invalid" and row["message"].startswith("backup receipt is invalid: ")


def test_receipts_need_a_time_zone(spark):
    with pytest.raises(ValueError):
        tree.backup_states(spark.createDataFrame([], "path string, text string"), datetime.datetime(2026, 3, 11))


def test_gate_on_nulls(spark):
    fields = "phase string, artifact string, primary_home string, pages_touched string, path string, draft string, synthesized_pages int, domain_context boolean, triggers array<string>"
    df = spark.createDataFrame([(None,) * 9, ("accepted", *(None,) * 8), ("accepted", "a", " wiki/a.md ", None, None, None, None, None, ["odd", "odd"])], fields)
    got = [(r["exit_code"], r["route"], r["home"], r["words"]) for r in gate.judged(df).collect()]
    assert got == [(3, None, "", 0), (0, "chat-only", "none", 0), (2, "promotion-audit", "wiki/a.md", 0)]


@pytest.mark.parametrize(
    ("path", "fault"),
    [("", "path must be a nonempty string"), ("a\0b", "path must not contain NUL"), ("wiki\\a", "path must use POSIX separators"), ("c:/a", "URI-like values are not repository paths"), ("/wiki/a", "path must be repository-relative"),
     ("wiki//a", "path must not contain empty components"), ("wiki/./a", "path must not contain '.' or '..' components"), ("wiki", "path is outside allowed repository roots: wiki"), ("wiki/a.md", None), ("README.md", None)],
)
def test_path_faults(spark, path, fault):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(path,)], "p string").select(gate.path_fault(F.col("p"))).first()[0] == fault
