"""What an approval in a ledger must say, beyond the rules of ``ledger``: each record is judged alone, in
Arrow batches, as its JSON distinguishes kinds of values that columns don't."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans import ledger
from marlstone.plans.gate import ANALYSES, LEAST_PAGES, MOST_WORDS_IN_CHAT, TRIGGERS

# Fixed values.
ROUTES = ("analysis-capture", "promotion-audit")
DRAFT_HASH_FROM = datetime.datetime(2026, 7, 8, 17, 11, 14, tzinfo=datetime.timezone.utc)
AUTHORED_HASH_FROM = datetime.datetime(2026, 7, 10, 3, 23, 58, tzinfo=datetime.timezone.utc)
AUTHORED_POLICY = "strip_referenced_by_v1"
MEASUREMENT = ("word_count_source", "word_count_path", "draft_sha256", "authored_sha256", "authored_hash_policy")
SYNTHESIS = "wiki/synthesis.md"


def _said(value: object) -> bool:
    return isinstance(value, str) and value.strip() != ""


def _whole(value: object) -> bool:
    return type(value) is int


def _hash(value: object) -> bool:
    return isinstance(value, str) and re.fullmatch("[0-9a-f]{64}", value) is not None


def _moment(value: object) -> datetime.datetime | None:
    """The instant of an ISO date, in UTC where it names no zone."""
    try:
        found = datetime.datetime.fromisoformat(re.sub(r"Z\Z", "+00:00", value)) if _said(value) else None
    except ValueError:
        return None
    return found if found is None or found.tzinfo else found.replace(tzinfo=datetime.timezone.utc)


def _broken(rules: Iterable[tuple[object, str]]) -> list[str]:
    return [text for wrong, text in rules if wrong]


def _common(r: dict, told: tuple[str, ...]) -> list[str]:
    at = r.get("approved_at")
    return _broken(
        [
            (not _whole(r.get("schema_version")) or r["schema_version"] != ledger.SCHEMA_VERSION, f"approval record must have schema_version {ledger.SCHEMA_VERSION}"),
            (r.get("approval_status") != "approved", "approval_status must be approved"),
            *((not _said(r.get(k)), f"{k} must be a non-empty string") for k in told),
            (not _said(at), "approved_at must be a non-empty string"),
            (_said(at) and _moment(at) is None, "approved_at must be ISO-8601 parseable"),
            (r.get("backfilled") is True and not _said(r.get("backfill_source")), "backfilled records must include backfill_source"),
            (not isinstance(r.get("backfilled", False), bool), "backfilled must be a boolean when present"),
        ]
    )


def _to_analyses(r: dict) -> bool:
    pages = r.get("pages_touched")
    named = [r.get("primary_home"), *(pages if isinstance(pages, list) else ())]
    return r.get("route") == "analysis-capture" or any(isinstance(p, str) and p.casefold().startswith(ANALYSES) for p in named)


def _measured(r: dict) -> list[str]:
    """Faults in how the draft was measured, of records from the day on that they must tell it."""
    source, path = r.get("word_count_source"), r.get("word_count_path")
    yes, no = source == "measured", source == "unmeasured"
    triggers = r.get("triggers")
    return _broken(
        (
            (not (yes or no), "word_count_source must be measured or unmeasured"),
            (yes and not _said(path), "measured capture approvals require nonempty word_count_path"),
            (yes and not _hash(r.get("draft_sha256")), "measured capture approvals require a valid draft_sha256"),
            (no and path != "", "unmeasured capture approvals require empty word_count_path"),
            (no and "draft_sha256" in r, "unmeasured capture approvals must not carry draft_sha256"),
            (_to_analyses(r) and not yes, "analyses-targeting capture approvals must use measured provenance"),
            (_known_triggers(triggers) and triggers != sorted(set(triggers)), "triggers must be sorted and unique for new approvals"),
        )
    )


def _known_triggers(triggers: object) -> bool:
    return isinstance(triggers, list) and all(isinstance(t, str) and t in TRIGGERS for t in triggers)


def capture_faults(r: dict) -> list[str]:
    route, pages, words, at = r.get("route"), r.get("synthesized_pages"), r.get("word_count"), _moment(r.get("approved_at"))
    authored, policy = r.get("authored_sha256"), r.get("authored_hash_policy")
    must_hash = at is not None and at >= AUTHORED_HASH_FROM and _to_analyses(r)
    enough = _whole(pages) and pages >= LEAST_PAGES and _whole(words) and words > MOST_WORDS_IN_CHAT and r.get("domain_context") is True
    return (
        _common(r, ("artifact", "primary_home"))
        + (_measured(r) if at is not None and at >= DRAFT_HASH_FROM else [])
        + _broken(
            (
                (not isinstance(route, str) or route not in ROUTES, f"route must be one of {sorted(ROUTES)}"),
                (r.get("phase") != "accepted", "phase must be accepted for capture approvals"),
                (not _whole(pages) or pages < 0, "synthesized_pages must be a non-negative integer"),
                (not _whole(words) or words < 0, "word_count must be a non-negative integer"),
                (not isinstance(r.get("word_count_path", ""), str), "word_count_path must be a string when present"),
                ("draft_sha256" in r and not _hash(r["draft_sha256"]), "draft_sha256 must be 64 lowercase hex characters when present"),
                ("authored_sha256" in r and not _hash(authored), "authored_sha256 must be 64 lowercase hex characters when present"),
                ("authored_hash_policy" in r and policy != AUTHORED_POLICY, f"authored_hash_policy must be {AUTHORED_POLICY}"),
                (("authored_sha256" in r) != ("authored_hash_policy" in r), "authored_sha256 and authored_hash_policy must be present together"),
                (must_hash and not _hash(authored), "authored_sha256 is required for commissioned analyses-targeting approvals"),
                (must_hash and policy != AUTHORED_POLICY, f"commissioned analyses-targeting approvals require authored_hash_policy {AUTHORED_POLICY}"),
                (not isinstance(r.get("domain_context"), bool), "domain_context must be a boolean"),
                (not _known_triggers(r.get("triggers")), "triggers must be a list of valid promotion triggers"),
                (route == "analysis-capture" and not enough, "analysis-capture records must meet the 3+ pages, >300 words, domain-context criteria"),
                (route == "promotion-audit" and r.get("triggers") == [], "promotion-audit records must include at least one trigger"),
            )
        )
    )


def synthesis_faults(r: dict) -> list[str]:
    carried, update, at_home = [k for k in MEASUREMENT if k in r], r.get("ledger_update_required"), r.get("primary_home") == SYNTHESIS
    return _common(r, ("artifact", "drafts", "primary_home")) + _broken(
        (
            (carried, f"synthesis approvals must not carry capture measurement fields: {carried}"),
            (at_home and isinstance(r.get("pages_touched"), list) and update is not True, f"{SYNTHESIS} primary_home requires ledger_update_required true"),
            (not at_home and update is True, f"ledger_update_required must be false unless primary_home is {SYNTHESIS}"),
            (not isinstance(update, bool), "ledger_update_required must be a boolean"),
        )
    )


def _faults(record: pd.Series) -> pd.Series:
    told = map(json.loads, record)
    return pd.Series([capture_faults(r) if r["record_type"] == "capture_approval" else synthesis_faults(r) for r in told], dtype=object)


def findings(files: DataFrame) -> DataFrame:
    """``(path, line_no, detail)`` for what approvals of ledgers ``(path, text)`` lack; lines that are no
    approval have none."""
    records = ledger.judged(files).filter("record IS NOT NULL")
    return records.select("path", "line_no", F.explode(F.pandas_udf(_faults, "array<string>")("record")).alias("detail"))
