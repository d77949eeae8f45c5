"""Rules beyond the corpora of ``plans.corpus``, whose queries are tested with the catalog."""

from marlstone.functions.markdown import parse_pages, with_place
from marlstone.plans import rules
from marlstone.plans.corpus import page


def findings(spark, pages, files=()):
    parsed = parse_pages(with_place(spark.createDataFrame(list(pages.items()), "path string, text string"))).cache()
    return rules.findings(parsed, spark.createDataFrame([(f,) for f in files], "path string"))


def test_blank_values_belong_to_the_frontmatter_rule(spark):
    got = findings(spark, {"sources/s.md": page("S", "x", "source", confidence='""', source_type="''", created=" ")})
    assert {(r["check"], r["detail"]) for r in got.collect()} >= {("frontmatter", "confidence must be a nonempty scalar"), ("frontmatter", "source_type must be a nonempty scalar"), ("frontmatter", "created must be a nonempty scalar")}
    assert not got.filter("check = 'date'").count()


def test_references(spark):
    pages = {
        "concepts/a.md": page("A", "x", authority_kind="local-resource", authority_ref="raw/deep"),
        "concepts/b.md": page("B", "x", authority_kind="mixed", authority_ref="raw/../secret"),
        "concepts/c.md": page("C", "x", authority_kind="owner-page", authority_ref="wiki/sources/s.md"),
        "concepts/d.md": page("D", "x", authority_kind="mixed", authority_ref="notes by hand"),
        "concepts/e.md": page("E", "x", authority_kind="none", authority_ref="x"),
        "sources/s.md": page("S", "x", "source"),
    }
    got = findings(spark, pages, ["raw/deep/f.md", "wiki/sources/s.md"]).filter("check = 'authority-ref-shape'")
    assert sorted((r["path"], r["detail"].split(" ")[0]) for r in got.collect()) == [("concepts/b.md", "mixed"), ("concepts/c.md", "owner-page"), ("concepts/e.md", "authority_kind")]


def test_order_and_empty(spark):
    got = findings(spark, {"concepts/X.md": "no frontmatter [[gone]]"}).orderBy("ord").collect()
    assert [r["check"] for r in got] == ["filename", "frontmatter"]
    assert findings(spark, {"a.md": "x"}).filter("check = 'entity-folder'").count() == 0


def test_meta_pages(spark):
    parsed = lambda d: parse_pages(with_place(spark.createDataFrame(list(d.items()), "path string, text string")))
    got = rules.meta_findings(parsed({"index.md": "[[a]] [[gone]] [[glossary]]", "log.md": "[[old]]"}), parsed({"concepts/a.md": "x"}))
    assert [r["path"] for r in got.collect()] == ["index.md: [[gone]]"]
