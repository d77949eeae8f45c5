"""The page operators as named queries over small corpora that are written here.

The driver has no table of pages, so the pages are rows of this module, and what each query must
return was worked out by hand from the rules and stands beside it as SQL ``VALUES``.
"""

from __future__ import annotations

import datetime
import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.markdown import parse_pages, with_place
from marlstone.operators import backlinks, links
from marlstone.plans import approvals, evidence, gate, ledger, logs, markers, rules, signals, tree
from marlstone.sources.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

GAPS = "\n## Open questions / gaps\n\nNone.\n"
AS_OF = datetime.date(2026, 3, 11)


def page(title: str, body: str, kind: str = "concept", related: str = "", gaps: str = GAPS, **fields: str) -> str:
    """A page; a field given as an empty string is left out."""
    own = {"title": f'"{title}"', "type": kind, "created": "2026-01-01", "updated": "2026-01-02", "sources": '["experience: field notes"]', "tags": "[fixture]", "confidence": "medium"}
    own |= {"source_type": "other"} if kind == "source" else {"agent_use_cases": "\n  - to try things out"}
    lines = [f"{k}: {v}".replace(": \n", ":\n") for k, v in (own | fields).items() if v]
    return "\n".join(["---", *lines, "---", f"# {title}", "", body, ""]) + ("" if kind == "source" else gaps) + (f"\n## Related pages\n\n{related}\n" if related else "")


_DELTAS = "- [[delta-one]]\n- [[delta-two]]\n- [[delta-three]]"
CLEAN = {
    "concepts/alpha.md": page("Alpha", "Rivers carry silt toward coastal plains every spring season.", related=_DELTAS),
    "concepts/beta.md": page("Beta", "Rivers carry silt toward coastal plains every winter season.", related=_DELTAS.replace("[[delta-one]]", "Supports: [[concepts/delta-one|the first]]")),
    "concepts/delta-one.md": page("Delta", "Silt settles.", related="- [[alpha]]"),
    "concepts/delta-two.md": page("Delta", "Silt settles.", related="- [[beta]]"),
    "concepts/delta-three.md": page("Delta", "Silt settles slowly.", related="- [[delta-one]]") + "\n## Referenced by\n\n**concepts/**  [[alpha]], [[beta]]\n",
    "sources/gamma.md": page("Gamma", "A survey of estuary sediments. See [[alpha]].", "source"),
}

BROKEN = {
    "concepts/Bad_Name.md": page("Name", "Words."),
    "concepts/2026-01-02-note.md": page("Note", "Words."),
    "odd/stray.md": page("Stray", "Words."),
    "concepts/open.md": "---\ntitle: A",
    "concepts/plain.md": "no frontmatter at all",
    "concepts/gaps.md": "---\ntitle:\ntype: idea\ncreated: 2026-02-30\nupdated: 2026-6-1\nsources: [missing-slug, raw/none.md, notes/a.txt, \"synthesis\", raw/notes.md, https://example.org/a, report]\ntags: t\nconfidence: sure\nsource_type: deck\nagent_use_cases: []\n---\n" + GAPS,
    "concepts/authority.md": page("Authority", "Words.", authority_kind="odd", authority_freshness="never", verify_before_action="maybe", last_verified="soon"),
    "concepts/anchor.md": page("Anchor", "Words.", authority_ref="x", last_verified="2026-01-01"),
    "concepts/needs-ref.md": page("Needs", "Words.", authority_kind="mixed", authority_freshness="predictive"),
    "concepts/url.md": page("Url", "Words.", authority_kind="external-url", authority_ref="ftp://x"),
    "concepts/owner.md": page("Owner", "Words.", authority_kind="owner-page", authority_ref="wiki/concepts/gone.md"),
    "concepts/raw.md": page("Raw", "Words.", authority_kind="raw-source", authority_ref="'raw/notes.md'"),
    "sources/report.md": page("Report", "Words.", "source", source_type="rumor", tags="", authority_kind="none", authority_freshness="event-log"),
    "concepts/twin.md": page("Twin", "Words."),
    "people/twin.md": page("Twin", "Words.", "person"),
    "concepts/links.md": page("Links", "[[gone]] `[[code]]` <!-- ``` --> [[lost]] [[folder/]]\n\n~~~\n[[fenced]]\n~~~", related="- Supports: [[twin]]\n- Because: [[twin]]\n- Note: plain prose"),
    "concepts/doubt.md": page("Doubt", "It is so (source: [[synthesis]]).", gaps="", confidence="contested"),
    "concepts/tag.md": "---\ntitle: T\ntype: concept\ncreated: 2026-01-01\nupdated: 2026-01-01\nsources: x-y\ntags: t\nconfidence: low\nagent_use_cases: some\n---\n</invoke>\n## Open Questions\nLow confidence.\n",
}
#: Rows of the index: one page has none, one row leads nowhere, one page has two.
BROKEN_INDEX = [p for p in BROKEN if p != "concepts/url.md"] + ["concepts/ghost.md", "concepts/owner.md"]
BROKEN_FILES = ["raw/notes.md", *(f"wiki/{p}" for p in BROKEN)]
_DANGLING_NOTE = "cite the original pages"
BROKEN_FINDINGS = [
    ("filename", "concepts/Bad_Name.md", "not kebab-case"),
    ("filename", "concepts/2026-01-02-note.md", "has date prefix"),
    ("entity-folder", "odd/stray.md", "unknown folder 'odd'"),
    ("frontmatter", "concepts/open.md", "missing or malformed frontmatter: leading frontmatter is missing an exact closing '---' line"),
    ("frontmatter", "concepts/plain.md", "missing or malformed frontmatter"),
    ("frontmatter", "concepts/gaps.md", "title must be a nonempty scalar"),
    ("frontmatter", "concepts/gaps.md", "agent_use_cases has no list items"),
    ("type", "concepts/gaps.md", "type 'idea' != folder type 'concept'"),
    ("confidence", "concepts/gaps.md", "invalid value 'sure'"),
    ("source-type", "concepts/gaps.md", "source_type set on non-source page"),
    ("date", "concepts/gaps.md", "created '2026-02-30' is not a real calendar date"),
    ("date", "concepts/gaps.md", "updated '2026-6-1' is not YYYY-MM-DD"),
    ("source-ref", "concepts/gaps.md", "source 'missing-slug' matches no wiki/sources/ page"),
    ("source-ref", "concepts/gaps.md", "source 'synthesis' matches no wiki/sources/ page"),
    ("source-ref", "concepts/gaps.md", "'raw/none.md' does not exist or is unsafe"),
    ("source-ref", "concepts/gaps.md", "unsafe provenance path expression: 'notes/a.txt'"),
    ("synthesis-as-source", "concepts/gaps.md", f"sources: cites the synthesis ledger; {_DANGLING_NOTE}"),
    ("authority-field-values", "concepts/authority.md", "authority_kind 'odd' is not an accepted value"),
    ("authority-field-values", "concepts/authority.md", "authority_freshness 'never' is not an accepted value"),
    ("authority-field-values", "concepts/authority.md", "verify_before_action must be true or false"),
    ("authority-field-values", "concepts/authority.md", "last_verified 'soon' is not YYYY-MM-DD"),
    ("authority-kind-anchor", "concepts/anchor.md", "authority metadata present without authority_kind: authority_ref, last_verified"),
    ("authority-ref-required", "concepts/needs-ref.md", "authority_ref required when authority_kind is 'mixed'"),
    ("predictive-review-enrollment", "concepts/needs-ref.md", "authority_freshness 'predictive' requires review_by"),
    ("authority-ref-shape", "concepts/url.md", "external-url authority_ref 'ftp://x' must be exactly one http:// or https:// URL"),
    ("authority-ref-shape", "concepts/owner.md", "owner-page authority_ref 'wiki/concepts/gone.md' must be a contained existing wiki/*.md file"),
    ("source-type", "sources/report.md", "invalid value 'rumor'"),
    ("frontmatter", "sources/report.md", "missing keys: tags"),
    ("source-page-authority", "sources/report.md", "source pages with authority metadata must use raw-source, external-url, or mixed"),
    ("source-page-authority", "sources/report.md", "source pages may only set authority_freshness to immutable-source"),
    ("duplicate-stem", "concepts/twin.md", "stem 'twin' is shared by: concepts/twin.md, people/twin.md"),
    ("duplicate-stem", "people/twin.md", "stem 'twin' is shared by: concepts/twin.md, people/twin.md"),
    ("dangling-link", "concepts/links.md", "[[gone]] resolves to nothing"),
    ("dangling-link", "concepts/links.md", "[[lost]] resolves to nothing"),
    ("related-label", "concepts/links.md", "'Because:' is not an allowed relationship label"),
    ("open-questions", "concepts/doubt.md", "missing Open questions / gaps section"),
    ("confidence-restate", "concepts/doubt.md", "confidence 'contested' not restated in body"),
    ("confidence-restate", "concepts/doubt.md", "contested page lacks a Disagreement section"),
    ("synthesis-as-source", "concepts/doubt.md", f"body cites [[synthesis]] as a source; {_DANGLING_NOTE}"),
    ("stray-tag", "concepts/tag.md", "line 11: stray tool-call artifact '</invoke>'"),
    ("source-ref", "concepts/tag.md", "source 'x-y' matches no wiki/sources/ page"),
    ("index-missing", "concepts/url.md", "no row in index.md"),
    ("index-stale", "concepts/ghost.md", "index.md row points to missing page"),
    ("index-duplicate", "concepts/owner.md", "multiple index.md rows point to this page"),
]

STATE = {
    "goals/plan.md": page("Plan", "**Status (2026-02-01)** moving ahead", "goal", updated="2026-01-05", authority_kind="none", review_by="2026-03-01"),
    "goals/quiet.md": page("Quiet", "Nothing said.", "goal", authority_kind="none"),
    "concepts/old.md": page("Old", "Built on [[plan]] and [[late]].", updated="2026-01-10", confidence="low"),
    "concepts/fan.md": page("Fan", "**Status note (2026-02-15)** admires [[old]].", updated="2026-03-01"),
    "concepts/echo.md": page("Echo", "No word of it.", updated="2026-03-01", sources="[]", review_by="2026-12-01", related="- [[old]]"),
    "concepts/claim.md": page(
        "Claim", 'It says "the tide always returns before the moon has fully risen" (source: [[late]]) and "the harbour was closed for repairs during the whole long winter" (source: [[late]]).\n`**Status (2026-03-09)**`',
        updated="2026-03-01", authority_kind="owner-page", authority_ref="wiki/concepts/fan.md",
    ),
    "sources/late.md": page("Late", "The tide always returns -- before the moon has fully risen.", "source", updated="2026-02-20"),
}
OWNERS = ["goals/plan.md", "goals/quiet.md"]
_LOST = '"the harbour was closed for repairs during the whole long winter"'
STATE_SIGNALS = [
    ("owner_self_drift", "goals/plan.md", None, "updated 2026-01-05, status 2026-02-01", None),
    ("owner_status_missing", "goals/quiet.md", None, "no parseable dated Status note", None),
    ("authority_owner_mismatch", "concepts/claim.md", None, "authority_ref 'wiki/concepts/fan.md' is not a registered owner", None),
    ("status_drift", "concepts/old.md", "goals/plan.md", "page 2026-01-10, status 2026-02-01", None),
    ("recompile_candidates", "concepts/old.md", "sources/late.md", "page 2026-01-10, source 2026-02-20", None),
    ("confidence_upgrade", "concepts/old.md", None, "concepts/old.md (2 inbound)", 2.0),
    ("authority_missing", "concepts/fan.md", None, "has dated Status note", 0.0),
    ("authority_missing", "concepts/echo.md", None, "has review_by", 1.0),
    ("uncited", "concepts/echo.md", None, "concepts/echo.md", None),
    ("orphans", "concepts/claim.md", None, "concepts/claim.md", None),
    ("orphans", "concepts/echo.md", None, "concepts/echo.md", None),
    ("orphans", "concepts/fan.md", None, "concepts/fan.md", None),
    ("orphans", "goals/quiet.md", None, "goals/quiet.md", None),
    ("review_by_missing", "goals/quiet.md", None, "goals/quiet.md", None),
    ("review_due", "goals/plan.md", None, "goals/plan.md (review_by 2026-03-01, 10 day(s) overdue)", 10.0),
    ("quote_mismatch", "concepts/claim.md", _LOST.strip('"'), f"concepts/claim.md: {_LOST} not found in cited source(s)", None),
]
SETTLED = [("accepted_orphans", "concepts/fan.md", None), ("reviewed_status_drift", "concepts/old.md", "goals/plan.md"), ("reviewed_confidence_low", "concepts/ghost.md", None), ("hub_pages", "concepts/ghost.md", None)]

BACKLINKS = {
    "concepts/alpha.md": page("Alpha", "To [[beta]].") + "\n## Referenced by\n\n**concepts/**  [[beta]]\n",
    "concepts/beta.md": page("Beta", "Of nothing.") + "\n## Referenced by\n",
    "concepts/delta.md": "## Related pages\n\n- [[alpha]]\n",
    "concepts/omega.md": "# Omega\n\nAlone.\n\n\n",
    "sources/gamma.md": page("Gamma", "Words.", "source", related="- [[alpha]]"),
}
_NONE = "## Referenced by\n\n_No inbound links yet._\n"
RENDERED = {
    "concepts/alpha.md": page("Alpha", "To [[beta]].") + "\n## Referenced by\n\n\n**concepts/**  [[delta]]\n\n\n**sources/**  [[gamma]]\n",
    "concepts/beta.md": page("Beta", "Of nothing.") + "\n## Referenced by\n\n\n**concepts/**  [[alpha]]\n",
    "concepts/delta.md": _NONE + "## Related pages\n\n- [[alpha]]\n",
    "concepts/omega.md": "# Omega\n\nAlone.\n\n" + _NONE,
    "sources/gamma.md": page("Gamma", "Words.", "source").rstrip("\n") + "\n\n" + _NONE + "## Related pages\n\n- [[alpha]]\n",
}


def frame(spark: SparkSession, pages: dict[str, str]) -> DataFrame:
    """Parsed pages, kept because every rule and signal reads them."""
    ship_package(spark)
    return parse_pages(with_place(spark.createDataFrame(list(pages.items()), "path string, text string"))).persist()


def _one(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def _values(columns: str, rows: list[tuple]) -> str:
    """The rows as a DuckDB query."""

    def text(v: object) -> str:
        return "NULL" if v is None else repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    names = [f'"{c.split()[0]}"' for c in columns.split(", ")]
    casts = ", ".join(f"CAST({n} AS {c.split()[1]}) AS {n}" for n, c in zip(names, columns.split(", "), strict=True))
    if not rows:
        return f"SELECT {casts} FROM (SELECT {', '.join(f'NULL AS {n}' for n in names)}) AS t WHERE false"
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def _query(name: str, run: Callable[[SparkSession], DataFrame], columns: str, rows: list[tuple]) -> None:
    QUERIES[name] = lambda spark, _: run(spark).select(*[c.split()[0] for c in columns.split(", ")])
    ORACLES[name] = _values(columns, rows)


def _broken(spark: SparkSession) -> DataFrame:
    return rules.findings(frame(spark, BROKEN), _one(spark, BROKEN_FILES, "path string"), _one(spark, BROKEN_INDEX, "target string"))


def _state(spark: SparkSession) -> DataFrame:
    pages = frame(spark, STATE)
    found = signals.page_signals(pages, AS_OF, _one(spark, OWNERS, "path string")).filter("check NOT IN ('thin', 'near_duplicate', 'missing_related')")
    return found.unionByName(signals.quote_mismatches(pages, _one(spark, [("raw/none.md", "")], "path string, text string")))


_FINDING, _SIGNAL = "check VARCHAR, path VARCHAR, detail VARCHAR", "check VARCHAR, a VARCHAR, b VARCHAR, detail VARCHAR, score DOUBLE"
_DUPLICATES = [("concepts/delta-one.md", "concepts/delta-two.md", 1.0), ("concepts/delta-one.md", "concepts/delta-three.md", 0.875), ("concepts/delta-three.md", "concepts/delta-two.md", 0.875), ("concepts/alpha.md", "concepts/beta.md", 0.75)]
_SETTLING = {("orphans", "concepts/fan.md"), ("status_drift", "concepts/old.md")}

_query("lint_clean", lambda s: rules.findings(frame(s, CLEAN), _one(s, ["raw/notes.md"], "path string"), _one(s, list(CLEAN), "target string")), _FINDING, [])
_query("lint_findings", _broken, _FINDING, BROKEN_FINDINGS)
_query("lint_report", lambda s: rules.summary(_broken(s)), "check VARCHAR, n_findings BIGINT", sorted({(c, sum(x[0] == c for x in BROKEN_FINDINGS)) for c, *_ in BROKEN_FINDINGS}))
_query("inbound_counts", lambda s: links.in_degree(frame(s, CLEAN)), "path VARCHAR, inbound BIGINT", [("concepts/alpha.md", 2), ("concepts/beta.md", 1), ("concepts/delta-one.md", 3), ("concepts/delta-two.md", 2), ("concepts/delta-three.md", 2), ("sources/gamma.md", 0)])
_query("page_orphans", lambda s: signals.orphans(frame(s, CLEAN)), _SIGNAL, [("orphans", "sources/gamma.md", None, "sources/gamma.md", None)])
_query("unconsumed_sources", lambda s: signals.unconsumed_sources(frame(s, CLEAN)), _SIGNAL, [("unconsumed_sources", "sources/gamma.md", None, "no authored link from any non-source entity page", None)])
_query("missing_related", lambda s: signals.missing_related(frame(s, CLEAN)), _SIGNAL, [("missing_related", "concepts/alpha.md", "concepts/beta.md", "concepts/alpha.md ~ concepts/beta.md (3 shared)", 1.0)])
_query("near_duplicate", lambda s: signals.near_duplicates(frame(s, CLEAN)), _SIGNAL, [("near_duplicate", a, b, f"{a} ~ {b}", v) for a, b, v in _DUPLICATES])
_query("thin_pages", lambda s: signals.thin(frame(s, CLEAN)), _SIGNAL, [("thin", p, None, f"{p} ({n}w)", None) for p, n in (("concepts/alpha.md", 14), ("concepts/beta.md", 14), ("concepts/delta-one.md", 7), ("concepts/delta-two.md", 7), ("concepts/delta-three.md", 8), ("sources/gamma.md", 8))])
_query("state_signals", _state, _SIGNAL, STATE_SIGNALS)
_query("unsettled_signals", lambda s: signals.unsettled(_state(s), _one(s, SETTLED, "category string, a string, b string")), _SIGNAL, [x for x in STATE_SIGNALS if x[:2] not in _SETTLING])
_query("dead_settlements", lambda s: signals.dead(_state(s), _one(s, SETTLED, "category string, a string, b string")), "category VARCHAR, a VARCHAR, b VARCHAR", [("reviewed_confidence_low", "concepts/ghost.md", None)])
_query("rendered_backlinks", lambda s: backlinks.rendered(frame(s, BACKLINKS)), "path VARCHAR, text VARCHAR", list(RENDERED.items()))

# --- logs and evidence -----------------------------------------------------------------------------------

_PROOF = 'Stale-text sweep: status=not_applicable; reason="nothing was replaced"'
LOG = "# Log\n## [2026-07-01] ingest | early\n## 2026-07-06 | ingest | without proof\n## [2026-07-07] ingest | proven\n" + _PROOF + "\n## no date\n```\n## [2026-07-08] fenced\n```\n## [2026-07-09] Synthesis-pass | all\n## [2026-07-10] ingest | bad\nStale-text sweep: status=done"
LONG_LOG = "# Log\n\nHead.\n" + "\n".join(f"## [2026-01-{d:02d}] ingest | {d}\nbody\n" for d in range(1, 21))
CLAIMS = {"wiki/a.md": "# A\nOne (source: [[x]]).\nno claim [[x]]\n## Referenced by\nsource: [[z]]\n", "wiki/b.md": "# A\nOne (source: [[x]]).\nTwo (source: [[y-2]] and [[x]], [[y-2]])."}


def _lines(spark: SparkSession, text: str) -> DataFrame:
    ship_package(spark)
    return spark.createDataFrame([("log.md", k, x) for k, x in enumerate(text.split("\n"), 1)], "path string, line_no long, line string")


_query("log_entries", lambda s: logs.with_headers(_lines(s, LOG)).filter("date IS NOT NULL"), "line_no BIGINT, date VARCHAR, type VARCHAR", [(2, "2026-07-01", "ingest"), (3, "2026-07-06", "ingest"), (4, "2026-07-07", "ingest"), (8, "2026-07-08", "fenced"), (10, "2026-07-09", "synthesis-pass"), (11, "2026-07-10", "ingest")])
_query(
    "log_findings", lambda s: logs.header_findings(_lines(s, LOG)).unionByName(logs.proof_findings(_lines(s, LOG))), _FINDING,
    [
        ("log-entry-header", "log.md", "line 6: '## ' line is not a recognized log entry header"), ("log-entry-header", "log.md", "line 8: fenced '## ' line"),
        ("stale-sweep-proof", "log.md", "line 3: ingest entry dated 2026-07-06 is missing structured Stale-text sweep proof"), ("stale-sweep-proof", "log.md", "line 12: status must be completed or not_applicable"),
    ],
)
# three lines of head and twenty entries of three; a rotation adds eleven lines, so twelve entries go
_query("log_rotation_plan", lambda s: logs.rotation_plan(_lines(s, LONG_LOG), 40), "path VARCHAR, archive VARCHAR, moved BIGINT, kept BIGINT, before BIGINT, after BIGINT", [("log.md", "archive/wiki-log/2026-01-01-to-2026-01-12.md", 12, 8, 63, 38)])
QUERIES["evidence_claims"] = lambda s, _: evidence.claims(s.createDataFrame(list(CLAIMS.items()), "path string, text string")).select("claim_id", "path", "line_number", F.array_join("cited_slugs", ",").alias("slugs"))
ORACLES["evidence_claims"] = "SELECT sha256(path || chr(0) || CAST(n AS VARCHAR) || chr(0) || line) AS claim_id, path, CAST(n AS BIGINT) AS line_number, slugs FROM (VALUES ('wiki/a.md', 2, 'One (source: [[x]]).' || chr(10), 'x'), ('wiki/b.md', 2, 'One (source: [[x]]).' || chr(10), 'x'), ('wiki/b.md', 3, 'Two (source: [[y-2]] and [[x]], [[y-2]]).', 'y-2,x')) AS t(path, n, line, slugs)"

# --- ledgers ---------------------------------------------------------------------------------------------

_SCHEMA = '{"record_type":"schema","schema_version":1,"description":"approvals"}'
_GOOD = '{"record_type":"capture_approval","artifact":"a","primary_home":"wiki/a.md","pages_touched":["wiki/a.md","README.md"]}'
LEDGERS = {
    "clean.jsonl": f"{_SCHEMA}\n{_GOOD}\n",
    "empty.jsonl": "",
    "blank.jsonl": " \n",
    "bad.jsonl": "\n".join(
        [
            _GOOD, '{"record_type":"schema","schema_version":true}', "", "[1]", '{"a":1,"a":2}', "{", '{"record_type":"other"}',
            _GOOD.replace('"artifact"', '"approved_at":"2026-01-01","artifact"'), '{"record_type":"synthesis_approval","pages_touched":[]}',
            '{"record_type":"synthesis_approval","primary_home":"wiki/<x>.md","pages_touched":["wiki/<y>.md","raw/z.md","wiki/../a.md"]}',
            '{"record_type":"synthesis_approval","backfilled":true,"pages_touched":["old/z.md"]}', _SCHEMA,
        ]
    ),
}


def _ledgers(spark: SparkSession) -> DataFrame:
    ship_package(spark)
    return spark.createDataFrame(list(LEDGERS.items()), "path string, text string")


_query(
    "ledger_findings", lambda s: ledger.findings(_ledgers(s)), "path VARCHAR, line_no BIGINT, detail VARCHAR",
    [
        ("empty.jsonl", None, "expected exactly one schema record, found 0"), ("blank.jsonl", None, "ledger is nonempty but contains only whitespace"),
        ("bad.jsonl", None, "expected exactly one schema record, found 2"), ("bad.jsonl", 2, "schema record must be the first line"),
        ("bad.jsonl", 2, "schema record must have schema_version 1"), ("bad.jsonl", 2, "schema record must have a description"),
        ("bad.jsonl", 3, "blank lines are not allowed"), ("bad.jsonl", 4, "record must be a JSON object"), ("bad.jsonl", 5, "invalid JSON: duplicate JSON key: a"),
        ("bad.jsonl", 6, "invalid JSON: Expecting property name enclosed in double quotes"), ("bad.jsonl", 7, "unsupported record_type 'other'"),
        ("bad.jsonl", 8, "duplicate approval record"), ("bad.jsonl", 9, "pages_touched must be a non-empty list"),
        ("bad.jsonl", 10, "pages_touched must not contain placeholder paths: ['wiki/<y>.md']"), ("bad.jsonl", 10, "primary_home must not be a placeholder path"),
        ("bad.jsonl", 10, "primary_home must be included in pages_touched"), ("bad.jsonl", 10, "pages_touched paths must be under an allowed root: ['raw/z.md', 'wiki/../a.md']"),
        ("bad.jsonl", 12, "schema record must be the first line"),
    ],
)
QUERIES["ledger_lookup"] = lambda s, _: ledger.approval(_ledgers(s), hashlib.sha256(_GOOD.encode()).hexdigest())
ORACLES["ledger_lookup"] = _values("path VARCHAR, line_no BIGINT, record VARCHAR", [("clean.jsonl", 2, _GOOD)])

# --- the tree of files -------------------------------------------------------------------------------------

_REQUIRED = [*tree.REQUIRED_FILES, *(f"{p}x.md" for p in tree.REQUIRED_FOLDERS)]
TREE = [*((p, "file") for p in _REQUIRED), (".env", "file"), ("tmp/a.zip", "file"), ("wiki/.DS_Store", "file"), (".agents/b.md", "file"), ("notes/l.md", "symlink"), ("notes/n.md", "file")]
ARCHIVE = [*(p for p in _REQUIRED if p not in ("LICENSE", "raw/x.md")), "tmp/a.zip", ".env"]
_WRAPPED = {".claude/commands/wiki-a.md": "a", ".claude/commands/wiki-b.md": "b", ".agents/skills/wiki-a/SKILL.md": "a", ".agents/skills/wiki-c/SKILL.md": "c"}
_WRAPPERS = {".claude/commands/wiki-a.md": "a", ".claude/commands/wiki-b.md": "old", ".agents/skills/wiki-c/SKILL.md": None, ".agents/skills/wiki-d/SKILL.md": "d", ".claude/commands/other.md": "o", ".claude/commands/wiki-x/y.md": "y"}


def _receipt(**other: object) -> str:
    return json.dumps({"schema_version": 1, "verified_at": "2026-03-01T12:00:00Z", "content_sha256": "0" * 64, "byte_count": 5, "destination_id": "sha256:" + "a" * 64} | other)


RECEIPTS = {
    "none": None, "fresh": _receipt(), "edge": _receipt(verified_at="2026-02-09T00:00:00Z"), "stale": _receipt(verified_at="2026-02-08T23:59:59Z"), "future": _receipt(verified_at="2026-03-11T00:00:01Z"),
    "list": "[]", "fields": _receipt(more=1), "version": _receipt(schema_version=True), "shape": _receipt(verified_at="2026-03-01"), "day": _receipt(verified_at="2026-02-30T00:00:00Z"),
    "hash": _receipt(content_sha256="A" * 64), "size": _receipt(byte_count=-1), "place": _receipt(destination_id="drive:backup"), "twice": '{"a":1,"a":2}',
}
DOCS = {
    "README.md": "[a](docs/a.md) [b](docs/b.md#part 'title') [web](https://example.org/x.md) [here](#top) [gone](docs/gone.md) [up](../x.md) [pic](pic.png) [folder](docs/) []( <docs/d.md> )",
    "docs/a.md": "[c](./sub/../c.md) [root](/etc/x.md)", "docs/b.md": "[closed](closed/k.md) [self](b.md)", "docs/c.md": "[readme](../README.md)", "docs/d.md": None,
    "docs/e.md": "[gone](nowhere.md) [f](f.md)", "docs/f.md": "", "docs/closed/k.md": "[e](../e.md)", "docs/alone.md": "", "other/o.md": "",
}
_MANIFEST = tree.Manifest(("README.md",), ("docs",), ("docs/closed",), ("docs/alone.md",))


def _documents(spark: SparkSession, manifest: tree.Manifest) -> DataFrame:
    return tree.document_problems(spark.createDataFrame(list(DOCS.items()), "path string, text string"), _one(spark, list(DOCS), "path string"), manifest)


def _layout(spark: SparkSession) -> DataFrame:
    folders = _one(spark, ["concepts", "people", "odd", "more"], "folder string")
    return tree.layout_errors(folders, "unconfigured", ()).withColumn("status", F.lit("unconfigured")).unionByName(tree.layout_errors(folders, "configured", ("person", "goal", "idea", "goal")).withColumn("status", F.lit("configured"))).unionByName(
        tree.layout_errors(_one(spark, [], "folder string"), "configured", ()).withColumn("status", F.lit("empty"))
    )


def _shipped(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    return spark


_query("export_files", lambda s: tree.export_files(_one(s, TREE, "path string, kind string"), "notes/n.md"), "path VARCHAR", [(p,) for p in _REQUIRED])
_query(
    "export_errors", lambda s: tree.export_errors(_one(s, TREE, "path string, kind string"), _one(s, ARCHIVE, "path string"), "tmp/a.zip"), "error VARCHAR",
    [(e,) for e in (
        "symlink in the export root: notes/l.md", "archive does not contain LICENSE", "archive does not contain raw/", "archive contains excluded path tmp/a.zip",
        "archive contains excluded path .env", "archive unexpectedly contains itself (tmp/a.zip)", "archive file count 14 did not match expected 15",
    )],
)
_query(
    "wrapper_parity", lambda s: tree.wrapper_problems(_one(s, list(_WRAPPED.items()), "path string, text string"), _one(s, list(_WRAPPERS.items()), "path string, text string")), "problem VARCHAR",
    [(e,) for e in (
        "stale generated wrapper: .claude/commands/wiki-b.md", "missing generated wrapper: .agents/skills/wiki-a/SKILL.md", "cannot read wrapper .agents/skills/wiki-c/SKILL.md", "unexpected wiki-* wrapper: .agents/skills/wiki-d/SKILL.md",
    )],
)
_query(
    "entity_layout", _layout, "status VARCHAR, error VARCHAR",
    [
        ("unconfigured", "unsupported entity folders: more, odd"), ("configured", "unsupported entity folders: more, odd"), ("configured", "configured wiki active entity types must not contain duplicates"),
        ("configured", "unsupported active types: idea"), ("configured", "active entity folders missing: goals"), ("configured", "inactive entity folders present: concepts"),
        ("empty", "configured wiki requires at least one active entity type"),
    ],
)
_query(
    "backup_states", lambda s: tree.backup_states(_one(_shipped(s), list(RECEIPTS.items()), "path string, text string"), datetime.datetime(2026, 3, 11, tzinfo=datetime.timezone.utc)), "path VARCHAR, state VARCHAR, message VARCHAR",
    [
        ("none", "not-configured", "no verified remote-backup receipt is configured"), ("fresh", "fresh", "last verified remote backup: 2026-03-01T12:00:00Z"), ("edge", "fresh", "last verified remote backup: 2026-02-09T00:00:00Z"),
        ("stale", "stale", "last verified remote backup is 30 day(s) old (threshold 30)"), ("future", "future", "backup receipt is future-dated (2026-03-11T00:00:01Z)"),
        *((p, "invalid", f"backup receipt is invalid: {m}") for p, m in (
            ("list", "top level must be a JSON object"), ("fields", "receipt fields do not match schema version 1"), ("version", "schema_version must equal 1"), ("shape", "verified_at must be UTC YYYY-MM-DDTHH:MM:SSZ"),
            ("day", "verified_at is not a real UTC timestamp"), ("hash", "content_sha256 must be 64 lowercase hex characters"), ("size", "byte_count must be a nonnegative integer"),
            ("place", "destination_id must be a redacted sha256 identifier"), ("twice", "duplicate JSON key 'a'"),
        )),
    ],
)
_query(
    "document_reachability", lambda s: _documents(s, _MANIFEST), "problem VARCHAR",
    [(e,) for e in (
        "missing local Markdown target: README.md -> docs/gone.md", "local Markdown target escapes repository: README.md -> ../x.md", "local Markdown target escapes repository: docs/a.md -> /etc/x.md",
        "cannot read routed document docs/d.md", "unreachable operational document: docs/e.md", "unreachable operational document: docs/f.md",
    )],
)
_query("document_manifest", lambda s: _documents(s, tree.Manifest(("README.md", "START.md"), ("docs", "guides"))), "problem VARCHAR", [("declared document is missing: START.md",), ("operational directory is missing: guides",)])

# --- the gate -----------------------------------------------------------------------------------------------

_ASK = {"phase": "accepted", "artifact": "an answer", "primary_home": "wiki/concepts/a.md", "pages_touched": "", "path": "", "draft": None, "synthesized_pages": 0, "domain_context": True, "triggers": []}
_DRAFT = {"path": "tmp/d.md", "draft": "word " * 301, "synthesized_pages": 3}
_TWO = ["reusable_distinction", "existing_page_update"]
REQUESTS: dict[str, tuple[dict, tuple[int, str | None, str | None]]] = {
    "no phase": ({"phase": None}, (3, None, "--phase is required when --kind=capture.")),
    "draft phase": ({"phase": "draft"}, (0, None, None)),
    "draft into analyses": ({"phase": "draft", "pages_touched": "Wiki/Analyses/x.md"}, (3, None, "path is outside allowed repository roots: Wiki/Analyses/x.md")),
    "draft into the folder": ({"phase": "draft", "pages_touched": "wiki/Analyses/x.md"}, (3, None, "phase 'draft' may not write to wiki/analyses/; an analysis must go through analysis-capture or promotion-audit.")),
    "chat": ({}, (0, "chat-only", None)),
    "chat with none": ({"pages_touched": "none"}, (3, "chat-only", "path is outside allowed repository roots: none")),
    "chat into analyses": ({"primary_home": "wiki/analyses/a.md", **_DRAFT, "domain_context": False}, (3, "chat-only", "route 'chat-only' may not write to wiki/analyses/; an analysis must go through analysis-capture or promotion-audit.")),
    "short draft": ({**_DRAFT, "draft": "word " * 300}, (0, "chat-only", None)),
    "unread draft": ({"path": "tmp/d.md"}, (3, "chat-only", "--path 'tmp/d.md' is not a readable file.")),
    "negative": ({"synthesized_pages": -1}, (3, "chat-only", "--synthesized-pages must be a non-negative count of distinct wiki pages synthesized.")),
    "analysis": (_DRAFT, (2, "analysis-capture", None)),
    "analysis without home": ({**_DRAFT, "primary_home": ""}, (3, "analysis-capture", "analysis-capture requires a concrete --primary-home path (no placeholder); name the real durable destination.")),
    "promotion": ({"triggers": _TWO, "pages_touched": "README.md, wiki/b.md,,README.md"}, (2, "promotion-audit", None)),
    "promotion unsaid": ({"triggers": _TWO, "artifact": " "}, (3, "promotion-audit", "--artifact must be a non-empty description; the gate will not write an approval record its own validator would reject.")),
    "promotion open": ({"triggers": _TWO, "pages_touched": "wiki/<a>.md,wiki/<b>.md"}, (3, "promotion-audit", "approval scope must name concrete paths, not placeholders: ['wiki/<a>.md', 'wiki/<b>.md']")),
    "promotion none": ({"triggers": _TWO, "pages_touched": "none"}, (3, "promotion-audit", "approval scope must name real files; drop the 'none' entries from --pages-touched.")),
    "promotion up": ({"triggers": _TWO, "primary_home": "wiki/../a.md"}, (3, "promotion-audit", "path must not contain '.' or '..' components")),
    "promotion unmeasured": ({"triggers": _TWO, "pages_touched": "wiki/analyses/x.md"}, (3, "promotion-audit", "promotion-audit targeting wiki/analyses/x.md requires --path to the drafted artifact so its word count is measured, not declared; any wiki/analyses/ destination in the scope triggers this.")),
}
SYNTHESES: list[tuple] = [
    ("good", "a", "d", "", "wiki/synthesis.md,wiki/analyses/old.md", None), ("no drafts", "a", " ", "", "wiki/synthesis.md", "Synthesis approval requires --drafts so the user can review what changed."),
    ("no pages", "a", "d", "", " , ", "Synthesis approval requires --pages-touched so the editable scope is explicit."), ("not in scope", "a", "d", "wiki/b.md", "wiki/a.md", "primary home wiki/b.md must be included in --pages-touched."),
    ("new analysis", "a", "d", "wiki/analyses/new.md", "wiki/analyses/new.md", "synthesis may only touch existing wiki/analyses/ pages; file a new analysis through analysis-capture with a measured draft: missing ['wiki/analyses/new.md', 'wiki/analyses/new.md']"),
    ("outside", "a", "d", "", "raw/x.md", "path is outside allowed repository roots: raw/x.md"),
]


def _requests(spark: SparkSession) -> DataFrame:
    fields = "request_id string, phase string, artifact string, primary_home string, pages_touched string, path string, draft string, synthesized_pages int, domain_context boolean, triggers array<string>"
    return spark.createDataFrame([(k, *(_ASK | own).values()) for k, (own, _) in REQUESTS.items()], fields)


_query("gate_requests", lambda s: gate.judged(_requests(s)), "request_id VARCHAR, exit_code INTEGER, route VARCHAR, reason VARCHAR", [(k, *told) for k, (_, told) in REQUESTS.items()])
_query("gate_syntheses", lambda s: gate.synthesis_reasons(s.createDataFrame([r[:5] for r in SYNTHESES], "request_id string, artifact string, drafts string, primary_home string, pages_touched string"), _one(s, ["wiki/analyses/old.md"], "path string")), "request_id VARCHAR, reason VARCHAR", [(r[0], r[-1]) for r in SYNTHESES])

# --- approvals and declared counts -----------------------------------------------------------------------------

_HEX = "0" * 64
_CAPTURE = {
    "record_type": "capture_approval", "schema_version": 1, "approval_status": "approved", "artifact": "a", "primary_home": "wiki/a.md", "route": "promotion-audit", "phase": "accepted", "pages_touched": ["wiki/a.md"],
    "approved_at": "2026-07-01T00:00:00Z", "synthesized_pages": 3, "word_count": 301, "domain_context": True, "triggers": ["reusable_distinction"],
}
_SYNTHESIS = {"record_type": "synthesis_approval", "schema_version": 1, "approval_status": "approved", "artifact": "a", "drafts": "d", "primary_home": "wiki/synthesis.md", "pages_touched": ["wiki/synthesis.md"], "approved_at": "2026-07-01", "ledger_update_required": True}
_NEW = {"approved_at": "2026-07-08T19:11:14+02:00", "word_count_source": "unmeasured", "word_count_path": ""}
_MEASURED = {"approved_at": "2026-07-10T03:23:58Z", "word_count_source": "measured", "word_count_path": "tmp/d.md", "draft_sha256": _HEX, "route": "analysis-capture"}
_HASHED = {"authored_sha256": _HEX, "authored_hash_policy": "strip_referenced_by_v1"}
APPROVALS: list[tuple[dict, list[str]]] = [
    (_CAPTURE, []), (_SYNTHESIS, []), (_CAPTURE | _NEW, []), (_CAPTURE | _MEASURED | _HASHED, []), (_CAPTURE | {"approved_at": "2026-07-08T17:11:13"}, []),
    (_CAPTURE | {"schema_version": True, "approval_status": "no", "artifact": " ", "route": "chat-only", "phase": "draft"}, [
        "approval record must have schema_version 1", "approval_status must be approved", "artifact must be a non-empty string", "route must be one of ['analysis-capture', 'promotion-audit']", "phase must be accepted for capture approvals",
    ]),
    (_CAPTURE | {"approved_at": "", "synthesized_pages": -1, "word_count": True, "domain_context": 1, "triggers": ["odd"], "backfilled": True}, [
        "approved_at must be a non-empty string", "synthesized_pages must be a non-negative integer", "word_count must be a non-negative integer", "domain_context must be a boolean", "triggers must be a list of valid promotion triggers", "backfilled records must include backfill_source",
    ]),
    (_CAPTURE | {"approved_at": "2026-02-30", "triggers": [], "backfilled": 0, "word_count_path": None, "draft_sha256": "A", "authored_sha256": "b"}, [
        "approved_at must be ISO-8601 parseable", "promotion-audit records must include at least one trigger", "backfilled must be a boolean when present", "word_count_path must be a string when present",
        "draft_sha256 must be 64 lowercase hex characters when present", "authored_sha256 must be 64 lowercase hex characters when present", "authored_sha256 and authored_hash_policy must be present together",
    ]),
    (_CAPTURE | {"route": "analysis-capture", "word_count": 300, "authored_hash_policy": "v0", "authored_sha256": _HEX}, ["analysis-capture records must meet the 3+ pages, >300 words, domain-context criteria", "authored_hash_policy must be strip_referenced_by_v1"]),
    (_CAPTURE | {"approved_at": "2026-07-08T17:11:14Z"}, ["word_count_source must be measured or unmeasured"]),
    (_CAPTURE | _NEW | {"word_count_path": "x", "draft_sha256": _HEX, "triggers": ["reusable_distinction", "existing_page_update"], "pages_touched": ["wiki/a.md", "Wiki/Analyses/b.md"]}, [
        "unmeasured capture approvals require empty word_count_path", "unmeasured capture approvals must not carry draft_sha256", "analyses-targeting capture approvals must use measured provenance", "triggers must be sorted and unique for new approvals",
    ]),
    (_CAPTURE | _MEASURED | {"word_count_path": " ", "draft_sha256": None}, [
        "measured capture approvals require nonempty word_count_path", "measured capture approvals require a valid draft_sha256", "draft_sha256 must be 64 lowercase hex characters when present",
        "authored_sha256 is required for commissioned analyses-targeting approvals", "commissioned analyses-targeting approvals require authored_hash_policy strip_referenced_by_v1",
    ]),
    (_SYNTHESIS | {"drafts": None, "ledger_update_required": "yes", "draft_sha256": _HEX}, [
        "drafts must be a non-empty string", "wiki/synthesis.md primary_home requires ledger_update_required true", "ledger_update_required must be a boolean", "synthesis approvals must not carry capture measurement fields: ['draft_sha256']",
    ]),
    (_SYNTHESIS | {"primary_home": "wiki/a.md"}, ["ledger_update_required must be false unless primary_home is wiki/synthesis.md"]),
]
_query(
    "approval_findings", lambda s: approvals.findings(_one(_shipped(s), [("l.jsonl", "\n".join([_SCHEMA, *(json.dumps(r) for r, _ in APPROVALS), "{"]))], "path string, text string")), "path VARCHAR, line_no BIGINT, detail VARCHAR",
    [("l.jsonl", k, e) for k, (_, errors) in enumerate(APPROVALS, 2) for e in errors],
)
QUEUES = {
    "good.md": "# Queue\n<!-- lint:entity-count folder=concepts count=2 -->\n<!--lint:entity-count count=0 folder=people-->\n<!-- lint:entity-count folder=goals count=0 -->", "none.md": None,
    "bad.md": "<!-- lint:entity-count folder=concepts count=9 -->\n<!-- lint: entity-count folder=goals count=1 -->\n<!-- lint:entity-count folder=concepts count=1 -->\n<!-- lint:entity-count folder=odd count=x extra -->\n"
    "<!-- lint:entity-count -->\n<!-- lint:entity-count folder=teams folder=goals size=3 count=-1 -->\n<!-- lint:entity-counts folder=goals count=1 -->\n<!-- lint:entity-count folder=goals\ncount=1 -->",
}
_query(
    "count_marker_findings", lambda s: markers.findings(_one(_shipped(s), list(QUEUES.items()), "path string, text string")), _FINDING,
    [("sourcing-queue-count-marker", "bad.md", f"line {n}: {e}") for n, e in (
        (2, "malformed entity-count marker"), (3, "duplicate folder 'concepts'"), (4, "malformed attribute text"), (4, "unknown folder 'odd'"), (4, "count 'x' is not an integer"), (5, "missing folder"), (5, "missing count"),
        (6, "duplicate attribute 'folder'"), (6, "unknown attribute 'size'"), (6, "count must be non-negative"), (7, "malformed entity-count marker"), (8, "malformed entity-count marker"),
    )],
)
_query("count_marker_drift", lambda s: markers.drift(_one(_shipped(s), list(QUEUES.items()), "path string, text string"), _one(s, [*CLEAN, "people/p.md", "log.md"], "path string")), "path VARCHAR, folder VARCHAR, declared VARCHAR, actual BIGINT", [("good.md", "concepts", "2", 5), ("good.md", "people", "0", 1)])
