"""Ledgers: one JSON object a line, judged line by line in Arrow batches; what spans lines (repeated
records, the one schema record) is grouped in the table, so a record repeated often is no hot task.

``files`` is ``(path, text)``. JSON is read by Python, as Spark's reader keeps quiet about repeated
keys. A null text counts as empty.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
RECORD_TYPES = ("capture_approval", "synthesis_approval")
ALLOWED_ROOTS = ("wiki/", "scripts/", "workflows/", ".agents/", ".claude/", ".codex/")
ALLOWED_ROOT_FILES = ("AGENTS.md", "CLAUDE.md", "CONTEXT.md", "README.md", "REFERENCES.md")
IDENTITY_EXCLUDE_FIELDS = ("approved_at", "run_id", "word_count_source", "word_count_path")
SCHEMA_VERSION = 1
DEEPEST = 128

_JUDGED = "path string, line_no long, kind string, faults array<string>, identity string, sha256 string, record string"


def _said(value: object) -> bool:
    return isinstance(value, str) and value.strip() != ""


def _once(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if len(out) < len(pairs):
        names = [k for k, _ in pairs]
        raise ValueError(f"duplicate JSON key: {next(k for i, k in enumerate(names) if k in names[:i])}")
    return out


def _depth(value: object) -> int:
    """Levels below a value, counted level by level."""
    level, depth = [value], -1
    while level:
        level = [c for v in level for c in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
        depth += 1
    return depth


def in_scope(path: str) -> bool:
    """Whether a path is written plainly and lies under a folder or is a file that may be changed."""
    parts = path.split("/")
    if "\\" in path or "\0" in path or any(p in ("", ".", "..") for p in parts):
        return False
    return path in ALLOWED_ROOT_FILES or any(path.startswith(r) for r in ALLOWED_ROOTS)


def page_faults(record: dict) -> list[str]:
    """What is wrong with the pages that a record names."""
    pages, home = record.get("pages_touched"), record.get("primary_home")
    if not isinstance(pages, list) or not pages:
        return ["pages_touched must be a non-empty list"]
    if not all(map(_said, pages)):
        return ["pages_touched entries must be non-empty strings"]
    vague = [p for p in pages if set(p) & set("<>")]
    outside = [] if record.get("backfilled") is True else [p for p in pages if not in_scope(p)]
    rules = (
        (vague, f"pages_touched must not contain placeholder paths: {vague}"),
        (_said(home) and set(home) & set("<>"), "primary_home must not be a placeholder path"),
        (_said(home) and home not in pages, "primary_home must be included in pages_touched"),
        (outside, f"pages_touched paths must be under an allowed root: {outside}"),
    )
    return [text for wrong, text in rules if wrong]


def _schema_faults(record: dict, line_no: int) -> list[str]:
    version = record.get("schema_version")
    rules = (
        (line_no != 1, "schema record must be the first line"),
        (type(version) is not int or version != SCHEMA_VERSION, f"schema record must have schema_version {SCHEMA_VERSION}"),
        (not _said(record.get("description")), "schema record must have a description"),
    )
    return [text for wrong, text in rules if wrong]


def _judge(line: str, line_no: int) -> tuple[str, list[str], str | None, str | None]:
    """Kind, faults, and for an approval its identity and itself."""
    if not line.strip():
        return "none", ["blank lines are not allowed"], None, None
    try:
        record = json.loads(line, object_pairs_hook=_once)
    except (ValueError, RecursionError) as e:
        return "none", [f"invalid JSON: {getattr(e, 'msg', e)}"], None, None
    if _depth(record) > DEEPEST:
        return "none", ["invalid JSON: maximum nesting depth exceeded"], None, None
    if not isinstance(record, dict):
        return "none", ["record must be a JSON object"], None, None
    kind = record.get("record_type")
    if kind == "schema":
        return "schema", _schema_faults(record, line_no), None, None
    if kind not in RECORD_TYPES:
        return "none", [f"unsupported record_type {kind!r}"], None, None
    identity = json.dumps({k: v for k, v in record.items() if k not in IDENTITY_EXCLUDE_FIELDS}, sort_keys=True, separators=(",", ":"))
    return kind, page_faults(record), hashlib.sha256(identity.encode()).hexdigest(), line


def _judge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers, lines = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        kind, faults, identity, record = zip(*map(_judge, lines, numbers), strict=True) if lines else ((),) * 4
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(kind, pa.string()), pa.array(faults, pa.list_(pa.string())), pa.array(identity, pa.string()), pa.array(sha, pa.string()), pa.array(record, pa.string())],
            ["path", "line_no", "kind", "faults", "identity", "sha256", "record"],
        )


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def judged(files: DataFrame) -> DataFrame:
    """``(path, line_no, kind, faults, identity, sha256, record)`` for each line of a ledger that has
    any; the last line's end begins no line. ``sha256`` is that of the exact line without its end."""
    rows = files.filter(~_blank(_text())).select("path", F.posexplode(F.split(F.regexp_replace(_text(), r"\n\z", ""), "\n", -1)).alias("k", "line"))
    return rows.select("path", (F.col("k") + 1).cast("long").alias("line_no"), "line").mapInArrow(_judge_all, _JUDGED)


def findings(files: DataFrame) -> DataFrame:
    """``(path, line_no, detail)`` for each fault; a fault of the file as a whole has no line."""
    rows = judged(files)
    single = rows.select("path", "line_no", F.explode("faults").alias("detail"))
    known = rows.filter("identity IS NOT NULL").select("path", "line_no", "identity")
    first = known.groupBy("path", "identity").agg(F.min("line_no").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = known.join(first, ["path", "identity"]).filter("line_no > first").select("path", "line_no", F.lit("duplicate approval record").alias("detail"))
    schemas = rows.filter("kind = 'schema'").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    blank = F.when((_text() != "") & _blank(_text()), "ledger is nonempty but contains only whitespace")
    count = F.when(n != 1, F.concat(F.lit("expected exactly one schema record, found "), n.cast("string")))
    whole = files.join(schemas, "path", "left").select("path", F.lit(None).cast("long").alias("line_no"), F.coalesce(blank, count).alias("detail")).filter("detail IS NOT NULL")
    return single.unionByName(again).unionByName(whole)


def approval(files: DataFrame, sha256: str) -> DataFrame:
    """``(path, line_no, record)`` of the first approval whose exact line has this hash, in each ledger
    without a fault."""
    found = judged(files).filter(F.col("record").isNotNull() & (F.col("sha256") == sha256))
    found = found.groupBy("path").agg(F.min_by(F.struct("line_no", "record"), "line_no").alias("r")).select("path", "r.line_no", "r.record")
    return found.join(findings(files).select("path").distinct(), "path", "left_anti")


def scope(listed: Column) -> Column:
    """The paths of a comma-separated list, without blanks and repeats, in order."""
    parts = F.transform(F.split(listed, ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))
