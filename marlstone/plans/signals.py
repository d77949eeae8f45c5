"""Signals over parsed pages: what deserves a look, though no rule is broken.

Pages are those of ``plans.rules``. A signal is ``(check, a, b, detail, score)``: the page it is about, a
second one where it is about two, and how strong it is. Settled ones are data as well,
``(category, a, b)``, and leave the list by anti join; those that settle nothing any more are found likewise.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.markdown import plain_quote
from marlstone.operators import links, similarity
from marlstone.plans.rules import META_PAGES, real_date

#: Policy.
THIN_WORDS = 80
UPGRADE_INBOUND = 2
SYNTHESIS_INGESTS = 8
SIMILAR, SIMILAR_LISTED = 0.35, 15
RELATED, RELATED_SHARED = 0.5, 3
LOG_LINES = 2500
# Folders whose pages should have a date of review, and the name that settled signals go by.
REVIEWED_FOLDERS = ("decisions", "goals")
SETTLED_AS = {
    "orphans": "accepted_orphans", "missing_related": "skipped_crossref_pairs", "confidence_upgrade": "reviewed_confidence_low", "near_duplicate": "reviewed_near_duplicates", "quote_mismatch": "reviewed_quotes",
    "recompile_candidates": "reviewed_recompile_candidates", "authority_missing": "reviewed_authority_missing", "glossary_volatile_status": "reviewed_glossary_volatile", "unconsumed_sources": "reviewed_unconsumed_sources", "status_drift": "reviewed_status_drift",
}
# Fixed value: words of a state that will pass.
VOLATILE = r"(?i)\b(still (?:missing|open|pending|owed|outstanding)|remains? open|not yet|tentative(?:ly)?|awaiting|in progress|up in the air|yet to be|to be determined|unresolved|pending)\b"


def _fm(key: str) -> Column:
    return F.col("page.fm")[key]


def _date(value: Column) -> Column:
    return F.when(real_date(value), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("date"))


def _row(df: DataFrame, check: str, a: Column | str, detail: Column, b: Column | str | None = None, score: Column | None = None) -> DataFrame:
    col = lambda x: F.col(x) if isinstance(x, str) else x
    empty = F.lit(None).cast("string")
    return df.select(F.lit(check).alias("check"), col(a).alias("a"), (empty if b is None else col(b)).alias("b"), detail.cast("string").alias("detail"), (F.lit(None) if score is None else score).cast("double").alias("score"))


def with_dates(pages: DataFrame) -> DataFrame:
    """``updated``, ``status`` and ``fresh``, the later of the two, beside each page."""
    status = F.col("page.status_date").cast("date")
    return pages.withColumns({"updated": _date(_fm("updated")), "status": status}).withColumn("fresh", F.greatest("updated", "status"))


def derived(pages: DataFrame) -> DataFrame:
    return pages.filter("folder IS NULL OR folder <> 'sources'")


def thin(pages: DataFrame) -> DataFrame:
    """Pages whose evidence has fewer than ``THIN_WORDS`` words."""
    few = pages.filter(F.col("page.words") < THIN_WORDS)
    return _row(few, "thin", "path", F.format_string("%s (%dw)", "path", "page.words"))


def uncited(pages: DataFrame) -> DataFrame:
    return _row(derived(pages).filter((F.size("page.sources") == 0) & ~F.col("page.body_links")), "uncited", "path", F.col("path"))


def orphans(pages: DataFrame) -> DataFrame:
    return _row(links.orphans(pages), "orphans", "path", F.col("path"))


def confidence_upgrade(pages: DataFrame) -> DataFrame:
    """Pages of low confidence, sources apart, that several pages link to."""
    low = derived(pages).filter(_fm("confidence") == "low").select("path")
    met = links.in_degree(pages).filter(F.col("inbound") >= UPGRADE_INBOUND).join(low, "path", "left_semi")
    return _row(met, "confidence_upgrade", "path", F.format_string("%s (%d inbound)", "path", "inbound"), score=F.col("inbound"))


def near_duplicates(pages: DataFrame) -> DataFrame:
    """Pairs of derived pages with much the same words."""
    pairs = similarity.similar_pairs(derived(pages).select("path", "page.tokens"), "path", "tokens", SIMILAR)
    return _row(pairs, "near_duplicate", "a", F.concat_ws(" ~ ", "a", "b"), "b", F.col("score"))


def missing_related(pages: DataFrame) -> DataFrame:
    """Pairs of pages that link to the same pages but not to each other, two sources apart."""
    out = links.edges(pages)
    sets = out.groupBy("src").agg(F.collect_set("slug").alias("s"))
    # a link to either page of a pair counts for neither; a pair that has one is no candidate, so
    # of the sets nothing but a page's links to itself has to go, and each side's to the other can't be
    sets = sets.join(pages.select(F.col("path").alias("src"), "stem"), "src").select("src", F.array_remove("s", F.col("stem")).alias("s"))
    # the partner's own link to itself is gone already; this page can't link to the partner
    pairs = similarity.similar_pairs(sets, "src", "s", RELATED).filter(F.col("shared") >= RELATED_SHARED)
    of = lambda x: pages.select(F.col("path").alias(x), F.col("stem").alias(f"stem_{x}"), F.col("folder").alias(f"folder_{x}"), F.col("page.links").alias(f"links_{x}"))
    pairs = pairs.join(of("a"), "a").join(of("b"), "b")
    both = (F.coalesce("folder_a", F.lit("")) == "sources") & (F.coalesce("folder_b", F.lit("")) == "sources")
    linked = F.expr("array_contains(links_a, stem_b) OR array_contains(links_b, stem_a)")
    pairs = pairs.filter(~both & ~linked)
    return _row(pairs, "missing_related", "a", F.concat(F.concat_ws(" ~ ", "a", "b"), F.format_string(" (%d shared)", "shared")), "b", F.col("score"))


def recompile_candidates(pages: DataFrame) -> DataFrame:
    """Pages and the sources they link to that were updated after them; a stem of several pages is no link."""
    dated = with_dates(pages)
    own = derived(dated).select(F.col("path").alias("src"), "fresh").filter("fresh IS NOT NULL")
    alone = dated.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.first("path").alias("source"), F.first("folder").alias("folder"), F.first("updated").alias("theirs"))
    alone = alone.filter("n = 1 AND folder = 'sources'").select(F.col("stem").alias("slug"), "source", "theirs")
    newer = links.edges(pages).join(own, "src").join(alone, "slug").filter("theirs > fresh")
    return _row(newer, "recompile_candidates", "src", F.format_string("page %s, source %s", F.col("fresh").cast("string"), F.col("theirs").cast("string")), "source")


def authority_missing(pages: DataFrame) -> DataFrame:
    rows = derived(with_dates(pages)).filter(~F.array_contains(F.map_keys("page.fm"), "authority_kind") | F.col("page.fm").isNull())
    why = F.when(F.col("status").isNotNull(), F.lit("has dated Status note")).when(_fm("review_by") != "", F.lit("has review_by"))
    return _row(rows.withColumn("why", why).filter("why IS NOT NULL"), "authority_missing", "path", F.col("why"), score=F.when(F.col("status").isNotNull(), 0).otherwise(1))


def unconsumed_sources(pages: DataFrame) -> DataFrame:
    """Sources that no page outside the sources links to."""
    used = links.edges(derived(pages)).select(F.col("slug").alias("stem"))
    return _row(pages.filter("folder = 'sources'").join(used, "stem", "left_anti"), "unconsumed_sources", "path", F.lit("no authored link from any non-source entity page"))


def review_by_missing(pages: DataFrame) -> DataFrame:
    return _row(pages.filter(F.col("folder").isin(*REVIEWED_FOLDERS) & (F.coalesce(_fm("review_by"), F.lit("")) == "")), "review_by_missing", "path", F.col("path"))


def review_due(pages: DataFrame, as_of: datetime.date) -> DataFrame:
    """Pages whose day of review has come; the score is the days since."""
    due = pages.withColumn("due", _date(_fm("review_by"))).filter(F.col("due") <= F.lit(as_of))
    overdue = F.datediff(F.lit(as_of), "due")
    return _row(due, "review_due", "path", F.format_string("%s (review_by %s, %d day(s) overdue)", "path", _fm("review_by"), overdue), score=overdue)


def owner_signals(pages: DataFrame, owners: DataFrame) -> DataFrame:
    """Signals of registered owners of a current state; ``owners`` is ``(path)``."""
    dated = with_dates(pages)
    own = dated.join(owners, "path", "left_semi")
    missing = _row(own.filter("status IS NULL"), "owner_status_missing", "path", F.lit("no parseable dated Status note"))
    ahead = _row(own.filter("status > updated"), "owner_self_drift", "path", F.format_string("updated %s, status %s", F.col("updated").cast("string"), F.col("status").cast("string")))
    ref = F.regexp_replace(F.coalesce(_fm("authority_ref"), F.lit("")), "^wiki/", "")
    named = dated.filter(_fm("authority_kind") == "owner-page").withColumn("ref", ref).filter("ref <> '' AND ref <> path")
    stranger = _row(named.join(owners.select(F.col("path").alias("ref")), "ref", "left_anti"), "authority_owner_mismatch", "path", F.format_string("authority_ref '%s' is not a registered owner", _fm("authority_ref")))
    alone = dated.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.first("path").alias("owner")).filter("n = 1").select(F.col("stem").alias("slug"), "owner")
    by_link = links.edges(pages).join(alone, "slug").select("src", "owner")
    at = F.regexp_replace("path", "[^/]*$", "")
    by_file = dated.select(F.col("path").alias("src"), at.alias("at"), F.explode("page.file_links").alias("t")).select("src", F.when(F.col("t").startswith("wiki/"), F.regexp_replace("t", "^wiki/", "")).otherwise(F.regexp_replace(F.concat("at", "t"), r"[^/]+/\.\./", "")).alias("owner"))
    by_ref = dated.filter(_fm("authority_ref").startswith("wiki/")).select(F.col("path").alias("src"), ref.alias("owner"))
    refs = by_link.unionByName(by_file).unionByName(by_ref).distinct().filter("src <> owner")
    old = derived(dated).select(F.col("path").alias("src"), "fresh")
    drift = refs.join(own.select(F.col("path").alias("owner"), "status"), "owner").join(old, "src").filter("status > fresh")
    drift = _row(drift, "status_drift", "src", F.format_string("page %s, status %s", F.col("fresh").cast("string"), F.col("status").cast("string")), "owner")
    return missing.unionByName(ahead).unionByName(stranger).unionByName(drift)


def quote_mismatches(pages: DataFrame, raw: DataFrame) -> DataFrame:
    """Quotations that stand neither in a page they cite nor in its raw files ``(path, text)``. Only
    texts that a quotation cites are compared with it."""
    plain = F.udf(plain_quote)  # the same text form for quotations and texts
    quotes = pages.select("path", F.explode("page.quotes").alias("q")).select("path", "q.*").withColumn("qid", F.xxhash64("path", "quote"))
    cited = quotes.select("qid", "fragments", F.explode("cites").alias("slug")).join(links.targets(pages), "slug").select("qid", "fragments", "dst").distinct()
    texts = pages.select(F.col("path").alias("dst"), plain("text").alias("hay"))
    refs = pages.select(F.col("path").alias("dst"), F.explode("page.provenance").alias("p")).filter("p.kind = 'raw'").select("dst", F.col("p.ref").alias("path"))
    texts = texts.unionByName(refs.join(raw, "path").select("dst", plain("text").alias("hay")))
    judged = cited.join(texts, "dst").groupBy("qid").agg(F.max(F.forall("fragments", lambda f: F.contains(F.col("hay"), f))).alias("found"))
    bad = quotes.join(judged.filter("NOT found"), "qid")
    preview = F.when(F.length("quote") > 70, F.concat(F.substring("quote", 1, 70), F.lit("..."))).otherwise(F.col("quote"))
    return _row(bad, "quote_mismatch", "path", F.format_string('%s: "%s" not found in cited source(s)', "path", preview), plain("quote"))


def glossary_volatile(entries: DataFrame) -> DataFrame:
    """Entries ``(term, line)`` that tell of a state that will pass, once for each phrase."""
    hits = entries.select("term", F.explode(F.regexp_extract_all("line", F.lit(VOLATILE), F.lit(1))).alias("phrase")).select("term", F.lower("phrase").alias("phrase")).distinct()
    return _row(hits, "glossary_volatile_status", "term", F.col("phrase"), "phrase")


def ingests_since_synthesis(entries: DataFrame) -> DataFrame:
    """One row ``(ingests, due)`` for a log's entries ``(line, type)``; aggregates only, no window over the log."""
    last = entries.agg(F.coalesce(F.max(F.when(F.col("type").startswith("synthesis"), F.col("line"))), F.lit(-1)).alias("last"))
    late = entries.filter("type = 'ingest'").join(F.broadcast(last), F.col("line") > F.col("last"))
    return late.agg(F.count(F.lit(1)).alias("ingests")).withColumn("due", F.col("ingests") >= SYNTHESIS_INGESTS)


def page_signals(pages: DataFrame, as_of: datetime.date, owners: DataFrame) -> DataFrame:
    out = owner_signals(pages, owners)
    for signal in (thin, uncited, orphans, confidence_upgrade, near_duplicates, missing_related, recompile_candidates, authority_missing, unconsumed_sources, review_by_missing):
        out = out.unionByName(signal(pages))
    return out.unionByName(review_due(pages, as_of))


def _settling(found: DataFrame, settled: DataFrame) -> DataFrame:
    """Signals with the entry ``(category, x, y)`` that settles them; pairs are found in either order."""
    names = F.create_map(*[F.lit(x) for kv in SETTLED_AS.items() for x in kv])
    one = found.withColumn("category", names[F.col("check")])
    also = found.filter("check = 'unconsumed_sources'").withColumn("category", F.lit("accepted_orphans"))
    hubs = found.filter("check = 'missing_related'").select("*", F.explode(F.array("a", "b")).alias("x")).withColumns({"y": F.lit(None).cast("string"), "category": F.lit("hub_pages")})
    loose = F.col("check").isin("near_duplicate", "missing_related")
    keyed = one.unionByName(also).withColumns({"x": F.when(loose, F.least("a", "b")).otherwise(F.col("a")), "y": F.when(loose, F.greatest("a", "b")).otherwise(F.col("b"))})
    keyed = keyed.unionByName(hubs)
    rows = settled.select(F.col("category").alias("c"), F.col("a").alias("sx"), F.col("b").alias("sy"))
    paired = F.col("c").isin("reviewed_near_duplicates", "skipped_crossref_pairs")
    rows = rows.select("c", F.when(paired, F.least("sx", "sy")).otherwise(F.col("sx")).alias("sx"), F.when(paired, F.greatest("sx", "sy")).otherwise(F.col("sy")).alias("sy"))
    return keyed.join(rows.distinct(), (F.col("category") == F.col("c")) & (F.col("x") == F.col("sx")) & F.col("y").eqNullSafe(F.col("sy"))).select("check", "a", "b", "category", "x", "y")


def unsettled(found: DataFrame, settled: DataFrame) -> DataFrame:
    """Signals that no entry settles."""
    gone = _settling(found, settled).select(F.col("check").alias("c"), F.col("a").alias("ga"), F.col("b").alias("gb")).distinct()
    return found.join(gone, (F.col("check") == F.col("c")) & (F.col("a") == F.col("ga")) & F.col("b").eqNullSafe(F.col("gb")), "left_anti")


def dead(found: DataFrame, settled: DataFrame) -> DataFrame:
    """Entries that settle nothing; hubs may lie quiet. An unconsumed source uses its own entry before an orphan's."""
    used = _settling(found, settled)
    own = used.filter("check = 'unconsumed_sources' AND category = 'reviewed_unconsumed_sources'").select("a")
    used = used.filter("NOT (check = 'unconsumed_sources' AND category = 'accepted_orphans')").unionByName(used.filter("check = 'unconsumed_sources' AND category = 'accepted_orphans'").join(own, "a", "left_anti"))
    used = used.select(F.col("category").alias("c"), F.col("x").alias("ux"), F.col("y").alias("uy")).distinct()
    paired = F.col("category").isin("reviewed_near_duplicates", "skipped_crossref_pairs")
    rows = settled.filter("category <> 'hub_pages'").withColumns({"x": F.when(paired, F.least("a", "b")).otherwise(F.col("a")), "y": F.when(paired, F.greatest("a", "b")).otherwise(F.col("b"))})
    return rows.join(used, (F.col("category") == F.col("c")) & (F.col("x") == F.col("ux")) & F.col("y").eqNullSafe(F.col("uy")), "left_anti").select("category", "a", "b")
