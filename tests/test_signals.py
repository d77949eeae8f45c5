"""Signals beyond the corpora of ``plans.corpus``, whose queries are tested with the catalog."""

from marlstone.functions.markdown import parse_pages, with_place
from marlstone.operators import similarity
from marlstone.plans import signals
from marlstone.plans.corpus import page


def test_synthesis(spark):
    log = [(k, "ingest") for k in range(5)] + [(5, "synthesis-pass")] + [(k, "ingest") for k in range(6, 14)]
    df = spark.createDataFrame(log, "line int, type string")
    assert tuple(signals.ingests_since_synthesis(df).first()) == (8, True)
    assert tuple(signals.ingests_since_synthesis(df.filter("line < 8")).first()) == (2, False)
    assert tuple(signals.ingests_since_synthesis(df.limit(0)).first()) == (0, False)


def test_glossary(spark):
    df = spark.createDataFrame([("Tide", "It is still pending, and Not yet known."), ("Tide", "not yet"), ("Silt", "settles")], "term string, line string")
    assert {(r["a"], r["b"]) for r in signals.glossary_volatile(df).collect()} == {("Tide", "still pending"), ("Tide", "not yet")}


def test_a_status_note_is_as_fresh_as_an_update(spark):
    pages = {"concepts/a.md": page("A", "[[s]] **Status (2026-05-01)** fine", updated="2026-01-01"), "concepts/b.md": page("B", "[[s]] [[twin]]", updated="2026-01-01"), "sources/s.md": page("S", "x", "source", updated="2026-04-01")}
    pages |= {f"{d}/twin.md": page("T", "x", "source", updated="2026-04-01") for d in ("sources", "people")}
    df = parse_pages(with_place(spark.createDataFrame(list(pages.items()), "path string, text string"))).cache()
    assert [(r["a"], r["b"]) for r in signals.recompile_candidates(df).collect()] == [("concepts/b.md", "sources/s.md")]  # a shared stem is no link


def test_quotes_in_raw_files(spark):
    body = '"one two three four five six seven" (source: [[s]]) "own words that nobody ever said before" (own framing, source: [[s]])'
    pages = {"concepts/a.md": page("A", body), "sources/s.md": page("S", "x", "source", sources="[raw/s.md]")}
    df = parse_pages(with_place(spark.createDataFrame(list(pages.items()), "path string, text string"))).cache()
    raw = lambda t: spark.createDataFrame([("raw/s.md", t)], "path string, text string")
    assert signals.quote_mismatches(df, raw("One two, three four five SIX seven!")).count() == 0
    assert signals.quote_mismatches(df, raw("one two three four")).count() == 1


def test_copies_are_classes(spark):
    rows = [(k, ["a", "b", "c", "d"]) for k in range(40)] + [(100, ["a", "b", "c", "e"]), (101, []), (102, None), (103, ["z"])]
    df = spark.createDataFrame(rows, "id long, s array<string>")
    members, pairs = similarity.similar_classes(df, "id", "s", 0.5)
    assert members.count() == 42 and [tuple(r) for r in pairs.collect()] == [(0, 100, 3, 0.6)]
    every = similarity.similar_pairs(df, "id", "s", 0.5)
    assert every.count() == 40 * 39 // 2 + 40
    top = [tuple(r)[:2] for r in similarity.closest_pairs(df, "id", "s", 0.5, 5).collect()]
    assert top == [(38, 39), (37, 39), (37, 38), (36, 39), (36, 38)]
