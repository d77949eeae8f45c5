"""Parsing and links on small pages."""

from marlstone.functions import markdown as md
from marlstone.functions.markdown import mask_code, parse, parse_pages, split_frontmatter, with_place
from marlstone.operators import backlinks, links


def test_frontmatter():
    assert split_frontmatter("---\r\ntitle: A\r\ntags:\r\n  - x\r\n---\r\nbody") == ({"title": "A", "tags": ""}, "title: A\r\ntags:\r\n  - x", "body", None)
    assert split_frontmatter("no")[0] is None and split_frontmatter("---\na: 1")[3].endswith("closing '---' line")
    assert split_frontmatter("--- \na: 1\n---")[3].startswith("leading frontmatter opener") and split_frontmatter("---\n---\nx")[0] == {}
    assert parse("---\na: 1\n[[x]]")["links"] == [] and parse(None)["fm"] is None


def test_masks():
    text = "a `[[x]]` ``b ` c`` [[y]]\n````\n```\n[[z]]\n````\n~~~\n[[q]]\n~~~\n<!-- [[c]] --> [[dir/w|alias]]"
    assert len(mask_code(text)) == len(text) and parse(text)["links"] == ["y", "c", "w"]
    assert parse("## One\n```\n## Two\n```\n### Deep\n## Three ##")["sections"] == ["One", "Three"]
    assert parse("[[a#part]] [[dir/sub/b]] [[c|d]]")["links"] == ["a#part", "sub/b", "c"]
    assert parse("<!--\n```\n-->\n[[a]]")["links"] == ["a"]  # a fence in a comment is none
    assert parse("```\n<!--\n```\n[[a]]")["links"] == ["a"]  # nor is a comment in a fence
    assert parse("one ` two\n[[a]] ``` [[b]]")["links"] == ["a", "b"]  # runs that nothing closes
    assert mask_code("```\nnever closed") == "   \n            "


def test_views():
    text = "---\na: 1\n---\n# T\nprose [[x]]\n## Referenced by\n[[gen]]\n### deeper\n[[gen2]]\n## Notes\nmore\n## related PAGES ##\n- Supports: [[y]]\n- Odd: [[z]]\n- Odd: plain\n"
    got = parse(text)
    assert got["links"] == ["x", "y", "z"] and got["labels"] == ["Supports", "Odd"] and got["words"] == len("T prose x Notes more".split())
    assert got["canonical"] == text.replace("## Referenced by\n[[gen]]\n### deeper\n[[gen2]]\n", "\n")
    assert md.section_spans("## `Related pages`\n## Related pages", "Related pages") == [(19, 35)]
    assert parse("**Status (2026-01-02)** **Status note (2026-02-30)** `**Status (2027-01-01)**`")["status_date"] == "2026-01-02"


def test_lists():
    assert md.list_items('["a, b", c, \'d,e\', ""]') == ["a, b", "c", "d,e"] and md.list_items("") == md.list_items("[]") == []
    assert md.source_items("sources:\n  - one\n  - 'two'\ntags: x\n  - no") == ["one", "two"] and md.source_items("title: raw/x.md") == []
    assert md.has_items("k:\n  - a", "k") and not md.has_items("k:\nother:\n  - a", "k") and not md.has_items("k: []", "k")
    refs = md.provenance(["web: any", "https://e.org/a", "see raw/a.md.", "../x", "raw/../b", "a-slug", "Two words", "wiki/concepts/a.md"])
    assert [r["kind"] for r in refs] == ["raw", "bad", "bad", "slug", "bad", "wiki"] and refs[0]["ref"] == "raw/a.md"
    assert md.fragments("the first part has six words here ... too short [cut] and this one has six words") == ["the first part has six words here", "and this one has six words"]


def test_graph(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    pages = [("c/a.md", "[[b]] [[b]] [[a]] [[gone]] [[folder/]]"), ("c/b.md", "[[d]]"), ("c/d.md", "`[[a]]` [[b]]"), ("s/g.md", "[[a]] [[b]]\n## Referenced by\n[[d]]"), ("s/n.md", None), ("z/b.md", "[[b]]")]
    df = parse_pages(with_place(spark.createDataFrame(pages, "path string, text string"))).cache()
    assert ("c/a.md", "a") in {tuple(r) for r in links.edges(df).collect()}
    # the last page of a stem is what links to it count for; its own link doesn't count
    assert {r["path"]: r["inbound"] for r in links.in_degree(df).collect()} == {"c/a.md": 1, "c/b.md": 0, "c/d.md": 1, "s/g.md": 0, "s/n.md": 0, "z/b.md": 3}
    assert {r["path"] for r in links.orphans(df).collect()} == {"c/b.md", "s/g.md", "s/n.md"}
    assert [tuple(r) for r in links.dangling(df).collect()] == [("c/a.md", "gone")]
    refs = {(r["path"], r["folder"]): r["refs"] for r in links.backlinks(df).collect()}
    assert refs[("c/b.md", "c")] == ["a", "d"] and refs[("c/b.md", "z")] == ["b"] and refs[("z/b.md", "s")] == ["g"]
    root = spark.createDataFrame([("c/a.md",)], "path string")
    assert {r["path"] for r in links.reachable(df, root).collect()} == {"c/a.md", "c/b.md", "c/d.md", "z/b.md"}


def test_reach_of_a_long_chain(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    pages = [(f"c/p{k}.md", f"[[p{k + 1}]]") for k in range(102)] + [("c/x.md", "[[p0]]")]
    df = parse_pages(with_place(spark.createDataFrame(pages, "path string, text string"))).drop("text").checkpoint()
    root = spark.createDataFrame([("c/p0.md",)], "path string")
    assert {r["path"] for r in links.reachable(df, root).collect()} == {f"c/p{k}.md" for k in range(102)}


def test_a_second_rendering_changes_nothing(spark):
    from marlstone.plans.corpus import BACKLINKS, frame

    once = {r["path"]: r["text"] for r in backlinks.rendered(frame(spark, BACKLINKS)).collect()}
    assert not backlinks.rendered(frame(spark, once)).filter("changed").count()
    for path, text in BACKLINKS.items():
        assert md.canonical_text(once[path]).split() == md.canonical_text(text).split()
