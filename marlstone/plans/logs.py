"""Logs as rows ``(path, line_no, line)``, numbered from 1: entries, rules, and the plan of a rotation.

Order matters within one file only, so every window is partitioned by path; a corpus of many logs
is worked on file by file, in parallel.
"""

from __future__ import annotations

import json
import re
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# An entry's header with its date and type, policy numbers, and the day from which proofs are due.
HEADER = r"^## (?:(?:\[(\d{4}-\d{2}-\d{2})\])|(\d{4}-\d{2}-\d{2}))(?:$| \| (?:([A-Za-z][\w-]*).*|.+)| ([A-Za-z][\w-]*).*)$"
TARGET_LINES, WARN_LINES, HEADROOM = 1500, 2500, 25
PROOF_FROM = "2026-07-05"
PROOF = "Stale-text sweep:"
PROOF_FIELDS = {"completed": {"status", "commands", "hit_count", "pages_fixed", "historical_no_change_hits"}, "not_applicable": {"status", "reason"}}
#: Lines that a rotation itself adds: a pointer in the header, and an entry at the end.
POINTER_LINES, ENTRY_LINES = 2, 8


def _group(k: int) -> Column:
    return F.regexp_extract("line", HEADER, k)


def with_headers(lines: DataFrame) -> DataFrame:
    """``date`` and ``type`` beside each line, null where it is no entry's header."""
    there = F.col("line").rlike(HEADER)
    kind = F.lower(F.when(_group(3) != "", _group(3)).when(_group(4) != "", _group(4)))
    return lines.withColumns({"date": F.when(there, F.when(_group(1) != "", _group(1)).otherwise(_group(2))), "type": F.when(there, kind)})


def with_entries(lines: DataFrame) -> DataFrame:
    """``entry``: the number of the entry that a line belongs to, 0 before the first."""
    so_far = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return with_headers(lines).withColumn("entry", F.count("date").over(so_far))


def header_findings(lines: DataFrame) -> DataFrame:
    """``(check, path, detail)`` of headings that are no entry's header, or stand in a fence."""
    fence = F.ltrim("line").startswith("```")
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = with_headers(lines).withColumn("inside", F.sum(fence.cast("int")).over(before) % 2 == 1)
    bad = rows.filter(F.col("line").startswith("## ") & (F.col("inside") | F.col("date").isNull()))
    why = F.when(F.col("inside"), F.lit("fenced '## ' line")).otherwise(F.lit("'## ' line is not a recognized log entry header"))
    return bad.select(F.lit("log-entry-header").alias("check"), "path", F.format_string("line %d: %s", "line_no", why).alias("detail"))


def proof_fields(payload: str) -> tuple[dict[str, str], str | None]:
    """Fields between semicolons that stand outside strings and brackets, or what is wrong."""
    tokens = re.findall(r'"(?:[^"\\]|\\.)*"|"|[\[{]|[\]}]|;|[^"\[\]{};]+', payload, re.S)
    parts, depth = [""], 0
    for t in tokens:
        if t == '"':
            return {}, "unterminated quoted string"
        depth += (t in "[{") - (t in "]}")
        if depth < 0:
            return {}, "unbalanced JSON brackets"
        if t == ";" and not depth:
            parts.append("")
        else:
            parts[-1] += t
    if depth:
        return {}, "unbalanced JSON brackets"
    fields: dict[str, str] = {}
    for part in filter(None, map(str.strip, parts)):
        key, equals, value = (x.strip() for x in part.partition("="))
        if not equals or not key or key in fields:
            return {}, f"field segment missing '=': {part!r}" if not equals else f"field segment has empty key: {part!r}" if not key else f"duplicate field '{key}'"
        fields[key] = value
    return fields, None


def _strings(value: str, field: str) -> tuple[list[str], str | None]:
    try:
        got = json.loads(value)
    except json.JSONDecodeError as error:
        return [], f"{field} must be a JSON array of strings: {error.msg}"
    good = isinstance(got, list) and all(isinstance(x, str) for x in got)
    return (got, None) if good else ([], f"{field} must be a JSON array of strings")


def command_error(command: str) -> str | None:
    """What keeps a command from being a search of the whole wiki for one phrase."""
    try:
        parts = shlex.split(command)
    except ValueError as error:
        return f"commands entries must be shell-parseable: {error}"
    if parts[:1] != ["rg"]:
        return "commands entries must be rg evidence shaped like: rg -n -i -- '<phrase>' wiki"
    if "--" not in parts:
        return "commands entries must include -- before the phrase"
    at = parts.index("--")
    if parts[1:at] != ["-n", "-i"]:
        return "commands entries must use exactly -n -i before --"
    if len(parts) != at + 3:
        return "commands entries must name exactly one phrase and the wiki root after --"
    if not parts[-2].strip():
        return "commands entries must include a non-empty phrase"
    return None if parts[-1].rstrip("/") == "wiki" else "commands entries must search the wiki root (wiki or wiki/)"


def proof_error(line: str) -> str | None:
    """What is wrong with a proof line, if anything."""
    if not line.startswith(PROOF):
        return f"line must start with '{PROOF}'"
    payload = line[len(PROOF) :].strip()
    if not payload:
        return "missing status field"
    fields, error = proof_fields(payload)
    if error:
        return error
    status = fields.get("status")
    if status not in PROOF_FIELDS:
        return "status must be completed or not_applicable"
    for what, names in (("missing", PROOF_FIELDS[status] - fields.keys()), ("unexpected", fields.keys() - PROOF_FIELDS[status])):
        if names:
            return f"{status} proof {'missing' if what == 'missing' else 'has unexpected'} field(s): " + ", ".join(sorted(names))
    if status == "not_applicable":
        try:
            reason = json.loads(fields["reason"])
        except json.JSONDecodeError as bad:
            return f"reason must be a JSON string: {bad.msg}"
        return None if isinstance(reason, str) and reason.strip() else "reason must be a non-empty JSON string"
    commands, error = _strings(fields["commands"], "commands")
    if error or not commands:
        return error or "commands must include at least one command string"
    errors = [*map(command_error, commands), *(_strings(fields[f], f)[1] for f in ("pages_fixed", "historical_no_change_hits"))]
    errors.append(None if re.fullmatch(r"\d+", fields["hit_count"]) else "hit_count must be a non-negative integer")
    return next(filter(None, errors), None)


@F.pandas_udf(StringType())
def _proof_error(line: pd.Series) -> pd.Series:
    return line.map(proof_error)


def proof_findings(lines: DataFrame) -> DataFrame:
    """``(check, path, detail)`` of ingests without a good proof that stale text was looked for."""
    rows = with_entries(lines).filter("entry > 0")
    proof = F.col("date").isNull() & F.col("line").startswith(PROOF)
    own = rows.groupBy("path", "entry").agg(F.min("line_no").alias("at"), F.max("date").alias("date"), F.max("type").alias("type"), F.count_if(proof).alias("n"))
    own = own.filter("type = 'ingest'").withColumn("real", F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).isNotNull())
    due = own.filter(F.col("real") & (F.col("date") >= PROOF_FROM))
    row = lambda df, detail: df.select(F.lit("stale-sweep-proof").alias("check"), "path", detail.alias("detail"))
    bad = rows.filter(proof).select("path", "entry", "line_no", "line").join(due.select("path", "entry"), ["path", "entry"], "left_semi").withColumn("error", _proof_error("line"))
    return (
        row(own.filter("NOT real"), F.format_string("line %d: ingest entry date %s is not a real calendar date", "at", "date"))
        .unionByName(row(due.filter("n = 0"), F.format_string("line %d: ingest entry dated %s is missing structured Stale-text sweep proof", "at", "date")))
        .unionByName(row(due.filter("n > 1"), F.format_string("line %d: ingest entry has multiple Stale-text sweep proof lines", "at")))
        .unionByName(row(bad.filter("error IS NOT NULL"), F.format_string("line %d: %s", "line_no", "error")))
    )


def rotation_plan(lines: DataFrame, target: int = TARGET_LINES) -> DataFrame:
    """``(path, oldest, newest, archive, moved, kept, before, after)`` for each log beyond its target:
    as few of the oldest entries go as bring it there, and the newest stays. A log that can't get there has no row."""
    if not 0 < target < WARN_LINES - HEADROOM:
        raise ValueError(f"the target must be positive and below {WARN_LINES - HEADROOM}")
    rows = with_entries(lines)
    whole = rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("before"), F.max("entry").alias("entries"), F.count_if(F.col("entry") == 0).alias("head"),
        F.max_by(F.trim("line"), F.when(F.col("entry") == 0, F.col("line_no"))).alias("last"),
    )
    whole = whole.filter((F.col("before") > target) & (F.col("entries") > 1))
    added = F.when((F.col("head") > 0) & (F.col("last") != ""), 1).otherwise(0) + POINTER_LINES + ENTRY_LINES
    sizes = rows.filter("entry > 0").groupBy("path", "entry").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("date"))
    so_far = Window.partitionBy("path").orderBy("entry").rowsBetween(Window.unboundedPreceding, 0)
    cuts = sizes.select("path", "entry", "date", F.sum("n").over(so_far).alias("gone")).join(whole, "path").withColumn("after", F.col("before") - F.col("gone") + added)
    cuts = cuts.filter((F.col("entry") < F.col("entries")) & (F.col("after") <= target))
    best = cuts.groupBy("path", "before", "entries").agg(F.min(F.struct("entry", "date", "after")).alias("c"))
    first = sizes.filter("entry = 1").select("path", F.col("date").alias("oldest"))
    out = best.join(first, "path").select("path", "oldest", F.col("c.date").alias("newest"), F.col("c.entry").alias("moved"), (F.col("entries") - F.col("c.entry")).alias("kept"), "before", F.col("c.after").alias("after"))
    return out.withColumn("archive", F.format_string("archive/wiki-log/%s-to-%s.md", "oldest", "newest"))


def archived_lines(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """``(path, archive, line_no, line)`` of the entries that a plan moves; all other lines stay, so
    none is lost or doubled."""
    return with_entries(lines).join(plan.select("path", "archive", "moved"), "path").filter("entry BETWEEN 1 AND moved").select("path", "archive", "line_no", "line")
