"""The gate before pages are written: requests are routed, and blocked or passed, in one projection.

``requests`` has ``(phase, artifact, primary_home, pages_touched, path, draft, synthesized_pages,
domain_context, triggers)``: ``pages_touched`` is a comma-separated list, ``draft`` the text at ``path``,
null where that can't be read. Null strings count as empty. Paths are judged as written; whether they
are links or folders is for the tree's rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans.ledger import ALLOWED_ROOT_FILES, ALLOWED_ROOTS, scope

# Fixed values.
ANALYSES = "wiki/analyses/"
LEAST_PAGES, MOST_WORDS_IN_CHAT = 3, 300
TRIGGERS = {
    "reusable_distinction": "reusable distinction", "ranking_or_framework": "ranking or framework", "open_question_resolution": "open-question resolution",
    "future_agent_behavior": "future-agent behavior", "existing_page_update": "existing page update",
}
WORD = r"[\p{L}\p{N}_]+"
FREE, APPROVAL, BLOCKED = 0, 2, 3


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def vague(path: Column) -> Column:
    """Whether a path still has a template's brackets."""
    return path.contains("<") | path.contains(">")


def of_analyses(path: Column) -> Column:
    low = F.lower(path)
    return low.startswith(ANALYSES) | (low == ANALYSES.rstrip("/"))


def path_fault(path: Column) -> Column:
    """What keeps a path from being one that may be written, or null."""
    parts = F.split(path, "/")
    inside = path.isin(*ALLOWED_ROOT_FILES)
    for root in ALLOWED_ROOTS:
        inside = inside | path.startswith(root)
    return (
        F.when(path == "", "path must be a nonempty string")
        .when(path.contains("\0"), "path must not contain NUL")
        .when(path.contains("\\"), "path must use POSIX separators")
        .when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "URI-like values are not repository paths")
        .when(path.startswith("/"), "path must be repository-relative")
        .when(F.array_contains(parts, ""), "path must not contain empty components")
        .when(F.arrays_overlap(parts, F.array(F.lit("."), F.lit(".."))), "path must not contain '.' or '..' components")
        .when(~inside, F.concat(F.lit("path is outside allowed repository roots: "), path))
    )


def _first_fault(paths: Column) -> Column:
    return F.get(F.filter(F.transform(paths, path_fault), lambda x: x.isNotNull()), F.lit(0))


def _quoted(paths: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(paths, "', '"), F.lit("']"))


def _named(home: Column) -> Column:
    return (home != "") & (home != "none") & ~vague(home)


def _destinations(home: Column, pages: Column) -> Column:
    return F.filter(F.concat(F.array(home), pages), _named)


def judged(requests: DataFrame) -> DataFrame:
    """The requests with ``words`` of the draft, ``route`` (null but in the accepted phase), ``home``, ``why`` of the
    route, ``exit_code`` (0 free, 2 needs approval, 3 blocked) and ``reason`` where blocked."""
    phase, path, artifact, declared = _text("phase"), _text("path"), _text("artifact"), _strip(_text("primary_home"))
    pages = F.coalesce(scope(_text("pages_touched")), F.array().cast("array<string>"))
    words = F.coalesce(F.regexp_count("draft", F.lit(WORD)), F.lit(0)).cast("long")
    count = F.coalesce("synthesized_pages", F.lit(0))
    triggers = F.array_sort(F.array_distinct(F.coalesce("triggers", F.array().cast("array<string>"))))
    labels = F.create_map(*[F.lit(x) for pair in TRIGGERS.items() for x in pair])

    analysis = (count >= LEAST_PAGES) & (words > MOST_WORDS_IN_CHAT) & F.coalesce("domain_context", F.lit(False))
    route = F.when(analysis, "analysis-capture").when(F.size(triggers) > 0, "promotion-audit").otherwise("chat-only")
    stated = F.when(_text("primary_home") != "", declared)
    df = requests.select("*", words.alias("words"), F.when(phase == "accepted", route).alias("route"))
    route = F.col("route")
    home = F.when(route == "analysis-capture", F.coalesce(stated, F.lit(f"{ANALYSES}<slug>.md"))).when(route == "promotion-audit", F.coalesce(stated, F.lit("wiki/<page>.md"))).when(route == "chat-only", "none").otherwise(declared)
    why = (
        F.when(route == "analysis-capture", "Matches the research analysis criteria: 3+ pages, >300 words, domain-context question.")
        .when(route == "promotion-audit", F.concat(F.lit("Promotion trigger present: "), F.array_join(F.transform(triggers, lambda t: F.coalesce(labels[t], t)), ", "), F.lit(".")))
        .when(route == "chat-only", "Does not meet analysis-capture criteria and has no promotion trigger.")
    )
    df = df.withColumn("home", home).withColumn("why", why)
    home, approval = F.col("home"), route.isin("analysis-capture", "promotion-audit")

    declared_all, target_all = _destinations(declared, pages), _destinations(home, pages)
    target = F.get(F.filter(target_all, of_analyses), F.lit(0))
    into_analyses = F.exists(declared_all, of_analyses)
    hint = F.when(path == "", " If this is a drafted analysis, re-run with --path to the draft so its word count is measured, not declared.").otherwise("")
    open_pages = F.filter(pages, vague)
    measured = f" requires --path to the drafted artifact so its word count is measured, not declared; any {ANALYSES} destination in the scope triggers this."
    free, accepted, chat = (phase != "") & (phase != "accepted"), phase == "accepted", route == "chat-only"
    reason = F.coalesce(
        F.when(phase == "", "--phase is required when --kind=capture."),
        F.when(free, _first_fault(declared_all)),
        F.when(free & into_analyses, F.concat(F.lit("phase '"), phase, F.lit(f"' may not write to {ANALYSES}; an analysis must go through analysis-capture or promotion-audit."))),
        F.when(accepted & (path != "") & F.col("draft").isNull(), F.concat(F.lit("--path '"), path, F.lit("' is not a readable file."))),
        F.when(accepted & (count < 0), "--synthesized-pages must be a non-negative count of distinct wiki pages synthesized."),
        F.when(accepted & (home != "none") & ~vague(home) & ((home != "") | (_text("primary_home") != "")), path_fault(home)),
        F.when(chat, _first_fault(declared_all)),
        F.when(chat & into_analyses, F.concat(F.lit(f"route 'chat-only' may not write to {ANALYSES}; an analysis must go through analysis-capture or promotion-audit."), hint)),
        F.when(approval & (_strip(artifact) == ""), "--artifact must be a non-empty description; the gate will not write an approval record its own validator would reject."),
        F.when(approval & ~_named(home), F.concat(route, F.lit(" requires a concrete --primary-home path (no placeholder); name the real durable destination."))),
        F.when(approval & (F.size(open_pages) > 0), F.concat(F.lit("approval scope must name concrete paths, not placeholders: "), _quoted(open_pages))),
        F.when(approval & F.array_contains(pages, "none"), "approval scope must name real files; drop the 'none' entries from --pages-touched."),
        F.when(approval, _first_fault(target_all)),
        F.when(approval & (path == "") & ((route == "analysis-capture") | target.isNotNull()), F.concat(route, F.lit(" targeting "), F.coalesce(target, home), F.lit(measured))),
        F.when(accepted, _first_fault(pages)),
    )
    code = F.when(F.col("reason").isNotNull(), BLOCKED).when(approval, APPROVAL).otherwise(FREE)
    return df.withColumn("reason", reason).withColumn("exit_code", code)


def synthesis_reasons(requests: DataFrame, files: DataFrame) -> DataFrame:
    """``(request_id, reason)``, null where nothing blocks it, of requests ``(request_id, artifact, drafts,
    primary_home, pages_touched)`` for a synthesis, which changes no page of analyses that isn't there yet;
    ``files`` is ``(path)``. An empty home is the page of the synthesis."""
    pages, home = scope(_text("pages_touched")), _strip(_text("primary_home"))
    home = F.when(home == "", "wiki/synthesis.md").otherwise(home)
    df = requests.select("request_id", _text("artifact").alias("artifact"), _text("drafts").alias("drafts"), pages.alias("pages"), home.alias("home"))
    df = df.withColumn("checked", F.concat("pages", F.array("home")))
    asked = df.select("request_id", F.posexplode("checked").alias("at", "path")).filter(of_analyses(F.col("path")))
    gone = asked.join(files.select("path").distinct(), "path", "left_anti").groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("m"))
    gone = gone.select("request_id", F.col("m.path").alias("missing"))
    df, home = df.join(gone, "request_id", "left"), F.col("home")
    open_paths = F.filter("checked", vague)
    reason = F.coalesce(
        F.when(~vague(home), path_fault(home)),
        _first_fault(F.col("pages")),
        F.when(_strip(F.col("artifact")) == "", "--artifact must be a non-empty description; the gate will not write an approval record its own validator would reject."),
        F.when(_strip(F.col("drafts")) == "", "Synthesis approval requires --drafts so the user can review what changed."),
        F.when(F.size("pages") == 0, "Synthesis approval requires --pages-touched so the editable scope is explicit."),
        F.when(F.size(open_paths) > 0, F.concat(F.lit("approval scope must name concrete paths, not placeholders: "), _quoted(open_paths))),
        F.when(~F.array_contains(F.col("pages"), home), F.concat(F.lit("primary home "), home, F.lit(" must be included in --pages-touched."))),
        F.when(F.col("missing").isNotNull(), F.concat(F.lit(f"synthesis may only touch existing {ANALYSES} pages; file a new analysis through analysis-capture with a measured draft: missing "), _quoted(F.col("missing")))),
    )
    return df.select("request_id", reason.alias("reason"))
