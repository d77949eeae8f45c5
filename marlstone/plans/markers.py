"""Declared counts: comments that say how many pages a folder has, their faults, and where the pages differ.

``queue`` is ``(path, text)``; a null text has no markers.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.rules import FOLDERS

# Fixed values.
MARKER = re.compile(r"<!--\s*lint:entity-count\b(?P<attrs>.*?)-->")
INTENT = re.compile(r"<!--(?=[^>]*\blint\s*:\s*entity-counts?\b)[\s\S]*?-->")
ATTRIBUTE = re.compile(r"([A-Za-z_][A-Za-z0-9_-]*)=([^\s]+)")
CHECK = "sourcing-queue-count-marker"


def _count_fault(said: str | None) -> str | None:
    if said is None:
        return "missing count"
    try:
        return "count must be non-negative" if int(said) < 0 else None
    except ValueError:
        return f"count '{said}' is not an integer"


def _folder_fault(folder: str | None, taken: set[str]) -> str | None:
    if folder is None:
        return "missing folder"
    if folder not in FOLDERS:
        return f"unknown folder '{folder}'"
    return f"duplicate folder '{folder}'" if folder in taken else None


def read_markers(text: str) -> list[tuple[int, str | None, str | None, list[str]]]:
    """``(line, folder, count, faults)`` of each marker; only one without faults has a folder, and takes
    it, and a count, as text, since it may be of any length."""
    exact = {m.span(): m for m in MARKER.finditer(text)}
    found = [(text.count("\n", 0, m.start()) + 1, None, None, ["malformed entity-count marker"]) for m in INTENT.finditer(text) if m.span() not in exact]
    taken: set[str] = set()
    for (start, _), marker in exact.items():
        attrs, values = marker["attrs"], {}
        faults = ["malformed attribute text"] if ATTRIBUTE.sub("", attrs).strip() else []
        for key, value in ATTRIBUTE.findall(attrs):
            if key not in ("folder", "count"):
                faults.append(f"unknown attribute '{key}'")
            elif key in values:
                faults.append(f"duplicate attribute '{key}'")
            else:
                values[key] = value
        folder, count = values.get("folder"), values.get("count")
        faults += filter(None, (_folder_fault(folder, taken), _count_fault(count)))
        if not faults:
            taken.add(folder)
        found.append((text.count("\n", 0, start) + 1, None if faults else folder, None if faults else str(int(count)), faults))
    return found


def _read(text: pd.Series) -> pd.Series:
    return pd.Series([[{"line": n, "folder": f, "count": c, "faults": bad} for n, f, c, bad in read_markers(t or "")] for t in text], dtype=object)


def markers(queue: DataFrame) -> DataFrame:
    """``(path, line, folder, count, faults)``, a row for each marker."""
    kind = "array<struct<line:long,folder:string,count:string,faults:array<string>>>"
    return queue.select("path", F.explode(F.pandas_udf(_read, kind)("text")).alias("m")).select("path", "m.*")


def findings(queue: DataFrame) -> DataFrame:
    """``(check, path, detail)`` of faulty markers."""
    faults = markers(queue).select("path", "line", F.explode("faults").alias("fault"))
    return faults.select(F.lit(CHECK).alias("check"), "path", F.format_string("line %d: %s", "line", "fault").alias("detail"))


def drift(queue: DataFrame, pages: DataFrame) -> DataFrame:
    """``(path, folder, declared, actual)`` where a folder of ``pages`` ``(path)`` has another number of pages than
    a queue without faults declares."""
    found = markers(queue)
    faulty = found.filter(F.size("faults") > 0).select("path").distinct()
    folder = F.element_at(F.split("path", "/"), -2)
    actual = pages.filter(F.size(F.split("path", "/")) > 1).groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    met = found.join(faulty, "path", "left_anti").join(actual, "folder", "left").withColumn("actual", F.coalesce("n", F.lit(0)))
    return met.filter(F.col("count") != F.col("actual").cast("string")).select("path", "folder", F.col("count").alias("declared"), "actual")
