"""Rules over the files of a repository: what an export holds, generated files, configured folders,
receipts of backups, and documents that can be reached from declared entry points.

Files are rows; a folder is there if a file lies below it. Null texts are unreadable files. Lists that
a configuration file declares (required files, folders, roots) are parameters.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.links import walk
from marlstone.plans.rules import FOLDERS

# Fixed values.
EXCLUDED_FOLDERS = (".git/", ".agents/", "tmp/", "deliverables/", ".claude/worktrees/")
EXCLUDED_FILES = (".claude/settings.local.json", ".env", "scripts/backup-receipt.json")
EXCLUDED_ENDING = ".DS_Store"
KEPT_FOLDER = ".agents/skills/"
REQUIRED_FILES = (".gitignore", "AGENTS.md", "CLAUDE.md", "CONTEXT.md", "LICENSE", "README.md", "REFERENCES.md")
REQUIRED_FOLDERS = (".claude/commands/", ".agents/skills/", ".github/workflows/", "raw/", "scripts/", "wiki/", "workflows/")
RECEIPT_FIELDS = ("schema_version", "verified_at", "content_sha256", "byte_count", "destination_id")
WRAPPERS = r"^(\.claude/commands/wiki-[^/]*\.md|\.agents/skills/wiki-[^/]*/SKILL\.md)$"
LINK = r"\[[^\]]*\]\(([^)]+)\)"
ELSEWHERE = ("#", "http://", "https://", "mailto:")


def _any(conditions: Sequence[Column]) -> Column:
    return F.exists(F.array(*conditions), lambda x: x) if conditions else F.lit(False)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _rows(df: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")


# --- exports ---------------------------------------------------------------------------------------------


def excluded(path: Column) -> Column:
    """Whether an export leaves a path out."""
    below = _any([path.startswith(p) for p in EXCLUDED_FOLDERS]) & ~path.startswith(KEPT_FOLDER)
    return path.isin(*EXCLUDED_FILES) | path.endswith(EXCLUDED_ENDING) | below


def export_files(files: DataFrame, *own: str) -> DataFrame:
    """``(path)`` of the files ``(path, kind)`` to export; ``own`` are the archive and its receipt."""
    return files.filter((F.col("kind") == "file") & ~excluded(F.col("path")) & ~F.col("path").isin(*own)).select("path")


def export_errors(files: DataFrame, names: DataFrame, own: str) -> DataFrame:
    """``(error)`` of an archive's ``names`` ``(path)`` against the tree's files; links are refused."""
    links = files.filter("kind = 'symlink'").select(F.format_string("symlink in the export root: %s", "path").alias("error"))
    required = _rows(files, "path", REQUIRED_FILES).join(names, "path", "left_anti").select(F.format_string("archive does not contain %s", "path").alias("error"))
    met = names.agg(*[F.coalesce(F.max(F.col("path").startswith(p)), F.lit(False)).alias(f"_{k}") for k, p in enumerate(REQUIRED_FOLDERS)])
    folders = met.select(F.explode(F.array(*[F.when(~F.col(f"_{k}"), F.lit(f"archive does not contain {p}")) for k, p in enumerate(REQUIRED_FOLDERS)])).alias("error"))
    odd = names.filter(excluded(F.col("path"))).select(F.format_string("archive contains excluded path %s", "path").alias("error"))
    itself = names.filter(F.col("path") == own).limit(1).select(F.format_string("archive unexpectedly contains itself (%s)", "path").alias("error"))
    counted = names.select(F.lit(1).alias("n"), F.lit(0).alias("m")).unionAll(export_files(files, own).select(F.lit(0), F.lit(1)))
    counts = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"))
    differ = counts.filter("n <> m").select(F.format_string("archive file count %d did not match expected %d", "n", "m").alias("error"))
    return links.unionByName(required).unionByName(folders.filter("error IS NOT NULL")).unionByName(odd).unionByName(itself).unionByName(differ)


# --- generated files and configured folders -----------------------------------------------------------------


def wrapper_problems(expected: DataFrame, files: DataFrame) -> DataFrame:
    """``(problem)`` where generated files ``(path, text)`` differ from the tree's; other files don't count."""
    there = files.filter(F.col("path").rlike(WRAPPERS)).select("path", F.col("text").alias("now"), F.lit(True).alias("found"))
    both = expected.select("path", "text", F.lit(True).alias("wanted")).join(there, "path", "full")
    problem = (
        F.when(F.col("found").isNull(), F.format_string("missing generated wrapper: %s", "path"))
        .when(F.col("wanted").isNull(), F.format_string("unexpected wiki-* wrapper: %s", "path"))
        .when(F.col("now").isNull(), F.format_string("cannot read wrapper %s", "path"))
        .when(F.col("now") != F.col("text"), F.format_string("stale generated wrapper: %s", "path"))
    )
    return both.select(problem.alias("problem")).filter("problem IS NOT NULL")


def layout_errors(folders: DataFrame, status: str, active: Sequence[str]) -> DataFrame:
    """``(error)`` where the entity ``folders`` ``(folder)`` aren't those of the active types."""
    kinds = {kind: folder for folder, kind in FOLDERS.items()}
    wanted = _strings(sorted({kinds[a] for a in active if a in kinds}))
    there, known = F.array_sort(F.collect_set("folder")), _strings(list(FOLDERS))
    unknown = sorted(set(active) - set(kinds))

    def listed(text: str, names: Column) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit(text), F.array_join(F.array_sort(names), ", ")))

    errors = [listed("unsupported entity folders: ", F.array_except(there, known))]
    if status != "unconfigured":
        errors += [F.lit(text) for text, wrong in (
            ("configured wiki requires at least one active entity type", not active),
            ("configured wiki active entity types must not contain duplicates", len(set(active)) < len(active)),
            ("unsupported active types: " + ", ".join(unknown), unknown),
        ) if wrong]
        errors += [listed("active entity folders missing: ", F.array_except(wanted, there)), listed("inactive entity folders present: ", F.array_except(F.array_intersect(there, known), wanted))]
    return folders.agg(F.array(*errors).alias("errors")).select(F.explode("errors").alias("error")).filter("error IS NOT NULL")


# --- receipts ------------------------------------------------------------------------------------------------


def _once(pairs: list[tuple[str, object]]) -> dict[str, object]:
    names = [k for k, _ in pairs]
    if twice := [k for i, k in enumerate(names) if k in names[:i]]:
        raise ValueError(f"duplicate JSON key {twice[0]!r}")
    return dict(pairs)


def _hex(value: object, prefix: str = "") -> bool:
    return isinstance(value, str) and re.fullmatch(prefix + "[0-9a-f]{64}", value) is not None


def read_receipt(text: str) -> tuple[str | None, int | None]:
    """What is wrong with a receipt, else the second since 1970 in which it was made."""
    try:
        told = json.loads(text, object_pairs_hook=_once)
    except (json.JSONDecodeError, RecursionError) as error:
        return f"unreadable JSON: {error}", None
    except ValueError as error:
        return str(error), None
    if not isinstance(told, dict):
        return "top level must be a JSON object", None
    if set(told) != set(RECEIPT_FIELDS):
        return "receipt fields do not match schema version 1", None
    made, size = told["verified_at"], told["byte_count"]
    if isinstance(told["schema_version"], bool) or told["schema_version"] != 1:
        return "schema_version must equal 1", None
    if not isinstance(made, str) or not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z", made):
        return "verified_at must be UTC YYYY-MM-DDTHH:MM:SSZ", None
    try:
        moment = datetime.datetime.strptime(made, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=datetime.timezone.utc)
    except ValueError:
        return "verified_at is not a real UTC timestamp", None
    rest = (
        (_hex(told["content_sha256"]), "content_sha256 must be 64 lowercase hex characters"),
        (type(size) is int and size >= 0, "byte_count must be a nonnegative integer"),
        (_hex(told["destination_id"], "sha256:"), "destination_id must be a redacted sha256 identifier"),
    )
    fault = next((text for right, text in rest if not right), None)
    return fault, None if fault else int(moment.timestamp())


def _receipts(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if t is None else read_receipt(t) for t in text], columns=["fault", "made"]).astype({"made": "Int64"})


def backup_states(receipts: DataFrame, now: datetime.datetime, max_age_days: int = 30) -> DataFrame:
    """``(path, state, message)`` of receipts ``(path, text)``; a null text is a receipt that isn't there."""
    if now.tzinfo is None or max_age_days < 0:
        raise ValueError("now must have a time zone, max_age_days must not be negative")
    age = F.lit(int(now.timestamp())) - F.col("r.made")
    made = F.get_json_object("text", "$.verified_at")
    cases = (
        (F.col("text").isNull(), "not-configured", F.lit("no verified remote-backup receipt is configured")),
        (F.col("r.fault").isNotNull(), "invalid", F.format_string("backup receipt is invalid: %s", "r.fault")),
        (age < 0, "future", F.format_string("backup receipt is future-dated (%s)", made)),
        (age > max_age_days * 86400, "stale", F.format_string("last verified remote backup is %d day(s) old (threshold %d)", F.floor(age / 86400), F.lit(max_age_days))),
        (F.lit(True), "fresh", F.format_string("last verified remote backup: %s", made)),
    )
    state = F.coalesce(*[F.when(when, F.struct(F.lit(state).alias("state"), message.alias("message"))) for when, state, message in cases])
    return receipts.withColumn("r", F.pandas_udf(_receipts, "fault string, made long")("text")).withColumn("s", state).select("path", "s.state", "s.message")


# --- documents ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """Entry points, folders whose documents must be reached, folders that aren't entered, and
    documents that need no link."""

    roots: tuple[str, ...]
    operational: tuple[str, ...]
    closed: tuple[str, ...] = ()
    standalone: tuple[str, ...] = ()


def _below(path: Column, folders: Sequence[str]) -> Column:
    return _any([(path == f) | path.startswith(f + "/") for f in folders])


def document_links(docs: DataFrame) -> DataFrame:
    """``(src, target, dst)`` for links of ``docs`` ``(path, text)`` to files: ``dst`` is the path that a target
    means, null where it leaves the root."""
    found = docs.select(F.col("path").alias("src"), F.explode(F.expr(f"regexp_extract_all(text, r'{LINK}', 1)")).alias("raw"))
    word = F.element_at(F.split(F.regexp_replace("raw", r"(?U)^\s+", ""), r"(?U)\s+"), 1)
    found = found.select("src", F.regexp_replace(word, "^[<>]+|[<>]+$", "").alias("target"))
    found = found.filter(~_any([F.col("target").startswith(p) for p in ELSEWHERE])).withColumn("link", F.substring_index("target", "#", 1)).filter("link <> ''")
    folder = F.split("src", "/")
    parts = F.concat(F.slice(folder, 1, F.size(folder) - 1), F.split("link", "/"))
    gone = F.lit(None).cast("array<string>")
    end = F.aggregate(
        parts,
        F.when(F.col("link").startswith("/"), gone).otherwise(F.array().cast("array<string>")),
        lambda at, p: F.when(at.isNull() | p.isin("", "."), at).when(p != "..", F.concat(at, F.array(p))).when(F.size(at) > 0, F.slice(at, 1, F.size(at) - 1)).otherwise(gone),
    )
    return found.select("src", "target", F.array_join(end, "/").alias("dst"))


def document_problems(docs: DataFrame, files: DataFrame, manifest: Manifest) -> DataFrame:
    """``(problem)``: declared documents and folders that are missing, else links of reached documents that
    lead nowhere and operational documents that no entry point leads to. ``files`` is ``(path)`` of all
    files, ``docs`` ``(path, text)`` of those in Markdown."""
    seeds = _rows(docs, "path", manifest.roots + manifest.standalone).distinct()
    there = files.select("path").distinct()
    folders = there.agg(*[F.coalesce(F.max(F.col("path").startswith(f + "/")), F.lit(False)).alias(f"_{k}") for k, f in enumerate(manifest.operational)])
    empty = folders.select(F.explode(F.array(*[F.when(~F.col(f"_{k}"), F.lit(f"operational directory is missing: {f}")) for k, f in enumerate(manifest.operational)])).alias("problem"))
    undeclared = seeds.join(there, "path", "left_anti").select(F.format_string("declared document is missing: %s", "path").alias("problem"))
    undeclared = undeclared.unionByName(empty.filter("problem IS NOT NULL"))
    if undeclared.limit(1).count():
        return undeclared
    open_docs = docs.filter(~_below(F.col("path"), manifest.closed))
    links = document_links(open_docs).join(there.select(F.col("path").alias("dst"), F.lit(True).alias("found")), "dst", "left")
    markdown = F.col("dst").rlike(r"(?i)[^/]\.md\z")
    reached = walk(links.filter(markdown & F.col("found")).select("src", "dst").filter(~_below(F.col("dst"), manifest.closed)), seeds.filter(~_below(F.col("path"), manifest.closed)))
    told = links.join(reached.select(F.col("path").alias("src")), "src", "left_semi")
    leads = told.select(
        F.when(F.col("dst").isNull(), F.format_string("local Markdown target escapes repository: %s -> %s", "src", "target"))
        .when(markdown & F.col("found").isNull(), F.format_string("missing local Markdown target: %s -> %s", "src", "target")).alias("problem")
    )
    unread = open_docs.filter("text IS NULL").join(reached, "path", "left_semi").select(F.format_string("cannot read routed document %s", "path").alias("problem"))
    operational = open_docs.filter(F.col("path").endswith(".md") & _below(F.col("path"), manifest.operational)).join(reached, "path", "left_anti")
    lost = operational.select(F.format_string("unreachable operational document: %s", "path").alias("problem"))
    return leads.filter("problem IS NOT NULL").unionByName(unread).unionByName(lost).distinct()
