"""Rules over parsed pages; each yields findings ``(check, path, detail)``.

Pages have ``path``, ``folder``, ``stem``, ``text`` and ``page`` (see ``functions.markdown``). All rules
that read one page are columns of one scan; those that need other pages or files are joins. A page
whose frontmatter fails has that finding and those on its path, and no others of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import links

# Fixed values.
FOLDERS = {
    "analyses": "analysis", "competitors": "competitor", "concepts": "concept", "customers": "customer", "decisions": "decision", "features": "feature", "goals": "goal", "health": "health", "initiatives": "initiative",
    "investments": "investment", "learnings": "learning", "metrics": "metric", "partners": "partner", "people": "person", "personas": "persona", "policies": "policy", "processes": "process", "products": "product",
    "projects": "project", "properties": "property", "skills": "skill", "sources": "source", "systems": "system", "teams": "team",
}
META_PAGES = ("index", "log", "overview", "glossary", "primer", "sourcing-queue", "contradictions", "design-notes", "SCHEMA", "synthesis", "domain")
CONFIDENCE = ("high", "medium", "low", "contested")
SOURCE_TYPE = ("help-doc", "slack-thread", "call-transcript", "exec-memo", "deck", "crm-export", "strategy-doc", "release-note", "press", "analyst-report", "competitor-collateral", "sales-battlecard", "product-spec", "board-doc", "synthesis", "other")
AUTHORITY_KIND = ("raw-source", "source-page", "owner-page", "external-url", "local-resource", "mixed", "none")
AUTHORITY_FRESHNESS = ("immutable-source", "stable-meaning", "current-state", "event-log", "predictive", "deprecated")
AUTHORITY_FIELDS = ("authority_ref", "authority_freshness", "verify_before_action", "last_verified")
BASE_KEYS = ("title", "type", "created", "updated", "sources", "tags", "confidence")
SCALARS = ("confidence", "created", "title", "type", "updated")
DATE_KEYS = ("created", "updated", "review_by")
LABELS = ("Supports", "Contradicts", "Depends on", "Derived from", "Part of", "Related")
KEBAB = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
DATED = r"^\d{4}-\d{2}-\d{2}-"
DATE = r"^\d{4}-\d{2}-\d{2}$"
WEB_ADDRESS = r"""(?i)^https?://[^\s\])}>"']+$"""
ROOT_FOLDERS = (".agents", ".claude", ".codex", ".github", ".wiki-transactions", "archive", "deliverables", "raw", "scripts", "tmp", "wiki", "workflows")
ROOT_FILES = (".gitignore", "AGENTS.md", "CLAUDE.md", "CONTEXT.md", "LICENSE", "README.md", "REFERENCES.md", "SETUP.md")
#: Findings of one check that a report lists.
REPORT_ROWS = 25

_FINDING = "struct<ord:int,check:string,detail:string>"


def _fm(key: str) -> Column:
    return F.col("page.fm")[key]


def _has(key: str) -> Column:
    return F.array_contains(F.map_keys("page.fm"), key)


def scalar(key: str) -> Column:
    """A field without the quotation marks around it; an absent one is empty."""
    return F.btrim(F.regexp_replace(F.btrim(F.coalesce(_fm(key), F.lit(""))), "^([\"'])(.*)\\1$", "$2"))


def real_date(v: Column) -> Column:
    return F.coalesce(v.rlike(DATE) & ~v.startswith("0000") & F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def _text(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def _if(order: int, check: str, bad: Column, detail: Column | str) -> Column:
    """An array of one finding, or of none."""
    detail = F.lit(detail) if isinstance(detail, str) else detail
    found = F.struct(F.lit(order).alias("ord"), F.lit(check).alias("check"), detail.alias("detail"))
    return F.when(F.coalesce(bad, F.lit(False)), F.array(found)).otherwise(F.array().cast(f"array<{_FINDING}>"))


def _date_errors(order: int, check: str, key: str, v: Column) -> list[Column]:
    there = v != ""
    return [
        _if(order, check, there & ~v.rlike(DATE), _text(f"{key} '%s' is not YYYY-MM-DD", v)),
        _if(order, check, there & v.rlike(DATE) & ~real_date(v), _text(f"{key} '%s' is not a real calendar date", v)),
    ]


def path_columns() -> list[Column]:
    return [
        _if(1, "filename", ~F.col("stem").rlike(KEBAB), "not kebab-case"),
        _if(2, "filename", F.col("stem").rlike(DATED), "has date prefix"),
        _if(3, "entity-folder", ~F.col("folder").isin(*FOLDERS), _text("unknown folder '%s'", F.col("folder"))),
    ]


def page_columns() -> list[Column]:
    """The rules that read the page alone, in their order."""
    source = F.coalesce(F.col("folder") == "sources", F.lit(False))
    required = F.array_sort(F.concat(F.array(*map(F.lit, BASE_KEYS)), F.when(source, F.array(F.lit("source_type"))).otherwise(F.array(F.lit("agent_use_cases")))))
    missing = F.array_except(required, F.map_keys("page.fm"))
    types = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])
    expected = F.when(F.col("folder").isNotNull(), F.element_at(types, F.col("folder")))
    kind, fresh, ref, verified = scalar("authority_kind"), scalar("authority_freshness"), scalar("authority_ref"), scalar("last_verified")
    known_kind = kind.isin(*AUTHORITY_KIND)
    anchors = F.filter(F.array(*map(F.lit, AUTHORITY_FIELDS)), lambda k: F.array_contains(F.map_keys("page.fm"), k))
    shape = "authority-ref-shape"
    lower = F.lower(ref)
    confidence = F.coalesce(_fm("confidence"), F.lit(""))
    out = [
        _if(10, "frontmatter", F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing, ", "))),
        *[_if(11, "frontmatter", _has(k) & (scalar(k) == "") & (source if k == "source_type" else F.lit(True)), f"{k} must be a nonempty scalar") for k in sorted((*SCALARS, "source_type"))],
        _if(12, "frontmatter", ~source & _has("agent_use_cases") & ~F.col("page.use_cases"), "agent_use_cases has no list items"),
        _if(20, "type", _has("type") & (_fm("type") != expected), _text("type '%s' != folder type '%s'", _fm("type"), expected)),
        _if(30, "confidence", (confidence != "") & ~confidence.isin(*CONFIDENCE), _text("invalid value '%s'", confidence)),
        _if(40, "source-type", source & (_fm("source_type") != "") & ~_fm("source_type").isin(*SOURCE_TYPE), _text("invalid value '%s'", _fm("source_type"))),
        _if(40, "source-type", ~source & _has("source_type"), "source_type set on non-source page"),
        *[e for k in DATE_KEYS for e in _date_errors(50, "date", k, F.coalesce(_fm(k), F.lit("")))],
        _if(60, "authority-field-values", _has("authority_kind") & ~known_kind, _text("authority_kind '%s' is not an accepted value", kind)),
        _if(60, "authority-field-values", _has("authority_freshness") & ~fresh.isin(*AUTHORITY_FRESHNESS), _text("authority_freshness '%s' is not an accepted value", fresh)),
        _if(60, "authority-field-values", _has("verify_before_action") & ~scalar("verify_before_action").isin("true", "false"), "verify_before_action must be true or false"),
        _if(60, "authority-field-values", _has("last_verified") & (verified == ""), "last_verified '' is not YYYY-MM-DD"),
        *_date_errors(60, "authority-field-values", "last_verified", verified),
        _if(70, "authority-kind-anchor", (F.size(anchors) > 0) & ~_has("authority_kind"), F.concat(F.lit("authority metadata present without authority_kind: "), F.array_join(anchors, ", "))),
        _if(80, "authority-ref-required", known_kind & (kind != "none") & (ref == ""), _text("authority_ref required when authority_kind is '%s'", kind)),
        _if(90, shape, (kind == "none") & (ref != ""), "authority_kind 'none' requires authority_ref to be absent or empty"),
        _if(90, shape, (kind == "external-url") & (ref != "") & ~ref.rlike(WEB_ADDRESS), _text("external-url authority_ref '%s' must be exactly one http:// or https:// URL", ref)),
        _if(90, shape, (kind == "owner-page") & ref.startswith("wiki/sources/") & ref.endswith(".md") & F.col("ref_exists"), _text("owner-page authority_ref '%s' must not be under wiki/sources/", ref)),
        _if(90, shape, (kind == "raw-source") & (ref != "") & ~(ref.startswith("raw/") & F.col("ref_exists")), _text("raw-source authority_ref '%s' must be a contained existing raw/ path", ref)),
        _if(90, shape, (kind == "source-page") & (ref != "") & ~(ref.startswith("wiki/sources/") & ref.endswith(".md") & F.col("ref_exists")), _text("source-page authority_ref '%s' must be a contained existing wiki/sources/*.md file", ref)),
        _if(90, shape, (kind == "owner-page") & (ref != "") & ~(ref.startswith("wiki/") & ref.endswith(".md") & F.col("ref_exists")), _text("owner-page authority_ref '%s' must be a contained existing wiki/*.md file", ref)),
        _if(90, shape, (kind == "local-resource") & (ref != "") & ~lower.startswith("source:") & ~(_below_root(ref) & F.col("ref_exists")), _text("local-resource authority_ref '%s' must exist under the repo root or start with source:", ref)),
        _if(90, shape, (kind == "mixed") & ~lower.startswith("source:") & ~ref.rlike(WEB_ADDRESS) & _path_shaped(ref) & ~(_below_root(ref) & F.col("ref_exists")), _text("mixed authority_ref '%s' is an unsafe repository path", ref)),
        _if(100, "source-page-authority", source & known_kind & ~kind.isin("raw-source", "external-url", "mixed"), "source pages with authority metadata must use raw-source, external-url, or mixed"),
        _if(100, "source-page-authority", source & fresh.isin(*AUTHORITY_FRESHNESS) & (fresh != "immutable-source"), "source pages may only set authority_freshness to immutable-source"),
        _if(110, "predictive-review-enrollment", (fresh == "predictive") & (F.coalesce(_fm("review_by"), F.lit("")) == ""), "authority_freshness 'predictive' requires review_by"),
        F.transform(F.filter("page.provenance", lambda p: p["kind"] == "bad"), lambda p: F.struct(F.lit(120).alias("ord"), F.lit("source-ref").alias("check"), p["ref"].alias("detail"))),
        _if(140, "synthesis-as-source", F.exists("page.sources", lambda s: (s == "synthesis") | F.contains(s, F.lit("[[synthesis]]"))), "sources: cites the synthesis ledger; cite the original pages"),
        _if(141, "synthesis-as-source", F.col("page.cites_synthesis") > 0, "body cites [[synthesis]] as a source; cite the original pages"),
        F.transform(F.filter("page.labels", lambda x: ~x.isin(*LABELS)), lambda x: F.struct(F.lit(150).alias("ord"), F.lit("related-label").alias("check"), F.format_string("'%s:' is not an allowed relationship label", x).alias("detail"))),
        _if(160, "open-questions", ~source & ~F.col("text").rlike("(?m)^##+ Open [Qq]uestions"), "missing Open questions / gaps section"),
        _if(170, "confidence-restate", confidence.isin("low", "contested") & ~F.col("page.says_confidence"), _text("confidence '%s' not restated in body", confidence)),
        _if(171, "confidence-restate", (confidence == "contested") & ~F.col("page.has_disagreement"), "contested page lacks a Disagreement section"),
    ]
    return out


def _below_root(ref: Column) -> Column:
    return ref.isin(*ROOT_FILES) | F.substring_index(ref, "/", 1).isin(*ROOT_FOLDERS) & F.contains(ref, F.lit("/"))


def _path_shaped(ref: Column) -> Column:
    return F.contains(ref, F.lit("/")) | F.contains(ref, F.lit("\\")) | ref.startswith(".") | ref.startswith("~") | ref.isin(*ROOT_FILES) | ref.rlike(r"^[^\s.]\S*\.[^\s./]+$")


def with_folders(files: DataFrame) -> DataFrame:
    """``(path)`` of files and of every folder above them."""
    parts = F.split("path", "/")
    return files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("path")).distinct()


def local_findings(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Findings that need no other page; ``files`` are the paths that references may name."""
    there = with_folders(files).select(F.col("path").alias("ref"), F.lit(True).alias("ref_exists"))
    # a safe reference alone is looked up, so no unsafe one exists
    looked = pages.withColumn("ref", F.when(F.col("page.authority_ref_safe"), scalar("authority_ref"))).join(there, "ref", "left").withColumn("ref_exists", F.coalesce("ref_exists", F.lit(False)))
    failed = _if(4, "frontmatter", F.col("page.fm").isNull(), F.concat_ws(": ", F.lit("missing or malformed frontmatter"), "page.fm_error"))
    own = F.when(F.col("page.fm").isNotNull(), F.concat(*page_columns())).otherwise(F.array().cast(f"array<{_FINDING}>"))
    return looked.select("path", F.explode(F.concat(*path_columns(), failed, own)).alias("f")).select("path", "f.ord", "f.check", "f.detail")


def reference_findings(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Findings that need other pages or files: provenance and links that lead nowhere."""
    good = pages.filter(F.col("page.fm").isNotNull())
    refs = good.select("path", F.explode("page.provenance").alias("p")).select("path", "p.kind", "p.ref")
    there = with_folders(files).select(F.col("path").alias("bare"))
    gone = refs.filter(F.col("kind").isin("raw", "wiki")).withColumn("bare", F.regexp_replace("ref", "/$", "")).join(there, "bare", "left_anti")
    slugs = refs.filter("kind = 'slug'").join(pages.filter("folder = 'sources'").select(F.col("stem").alias("ref")), "ref", "left_anti")
    dangling = links.dangling(pages, F.col("slug").isin(*META_PAGES)).join(good.select(F.col("path").alias("src")), "src", "left_semi")
    row = lambda df, order, check, path, detail: df.select(F.col(path).alias("path"), F.lit(order).alias("ord"), F.lit(check).alias("check"), detail.alias("detail"))
    return (
        row(gone, 120, "source-ref", "path", F.format_string("'%s' does not exist or is unsafe", "ref"))
        .unionByName(row(slugs, 120, "source-ref", "path", F.format_string("source '%s' matches no wiki/sources/ page", "ref")))
        .unionByName(row(dangling, 130, "dangling-link", "src", F.format_string("[[%s]] resolves to nothing", "slug")))
    )


def set_findings(pages: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Stems of several pages, and where an index ``(target)``, a row for each of its links, differs from the pages."""
    shared = pages.groupBy("stem").agg(F.array_sort(F.collect_list("path")).alias("all")).filter(F.size("all") > 1)
    detail = F.format_string("stem '%s' is shared by: %s", "stem", F.array_join("all", ", "))
    out = shared.select(F.explode("all").alias("path"), F.lit(0).alias("ord"), F.lit("duplicate-stem").alias("check"), detail.alias("detail"))
    if index is not None:
        rows = index.groupBy(F.col("target").alias("path")).agg(F.count(F.lit(1)).alias("n"))
        both = pages.select("path", F.lit(1).alias("here")).join(rows, "path", "full")
        ours = F.contains("path", F.lit("/")) & F.substring_index("path", "/", 1).isin(*FOLDERS)
        found = F.concat(
            _if(200, "index-missing", F.col("n").isNull(), "no row in index.md"),
            _if(201, "index-stale", F.col("here").isNull() & ours, "index.md row points to missing page"),
            _if(202, "index-duplicate", (F.col("n") > 1) & ours, "multiple index.md rows point to this page"),
        )
        out = out.unionByName(both.select("path", F.explode(found).alias("f")).select("path", "f.ord", "f.check", "f.detail"))
    return out


def meta_findings(meta: DataFrame, pages: DataFrame) -> DataFrame:
    """Links of the root's own pages that lead nowhere; the log keeps such ones on purpose."""
    gone = links.edges(meta.filter("stem <> 'log'")).filter(~F.col("slug").endswith("/") & ~F.col("slug").isin(*META_PAGES))
    gone = gone.join(pages.select(F.col("stem").alias("slug")), "slug", "left_anti")
    return gone.select(F.format_string("%s: [[%s]]", "src", "slug").alias("path"), F.lit(0).alias("ord"), F.lit("meta-dangling-link").alias("check"), F.lit("resolves to nothing").alias("detail"))


def stray_tags(pages: DataFrame) -> DataFrame:
    """Lines that are nothing but a tag that a tool left behind."""
    lines = pages.select("path", F.posexplode(F.split("text", "\r\n|\n|\r", -1)).alias("k", "line")).withColumn("line", F.trim("line"))
    bad = lines.filter(F.col("line").isin("</content>", "</invoke>") | F.col("line").startswith("<parameter"))
    return bad.select("path", F.lit(0).alias("ord"), F.lit("stray-tag").alias("check"), F.format_string("line %d: stray tool-call artifact '%s'", F.col("k") + 1, "line").alias("detail"))


def findings(pages: DataFrame, files: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """All findings, each once, with ``ord``: the rule's place in the order of rules."""
    found = local_findings(pages, files).unionByName(reference_findings(pages, files)).unionByName(set_findings(pages, index)).unionByName(stray_tags(pages))
    return found.groupBy("check", "path", "detail").agg(F.min("ord").alias("ord"))


def summary(found: DataFrame) -> DataFrame:
    """``(check, n_findings, listed)``: how many, and the first ``REPORT_ROWS`` by path and detail."""
    order = Window.partitionBy("check").orderBy("path", "detail")
    first = found.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= REPORT_ROWS)
    listed = first.groupBy("check").agg(F.array_sort(F.collect_list(F.struct("path", "detail"))).alias("listed"))
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n_findings")).join(listed, "check")
