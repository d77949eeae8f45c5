"""Evidence checks: claims with citations, a seeded sample, batches with a planted control, verdicts.

Claims are found and identified in the table; the draw is the one that Python's generator makes for a
seed, and only places are drawn (as many as are asked for), never rows on the driver.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MARKER = "source: [["
CITED = r"\[\[([a-z0-9]+(?:-[a-z0-9]+)*)\]\]"
VERDICTS = ("VERIFIED", "OVEREXTENDED", "CONFLATED", "MISMATCH", "NOT-FOUND")
PLANT = "plant-01"


def claims(pages: DataFrame) -> DataFrame:
    """``(claim_id, path, line_number, line_text, line_sha256, file_sha256, cited_slugs)`` for each line
    that cites a page, outside the generated section; a line keeps its end, which is part of its identity."""
    # a line is all up to and including its end
    lines = pages.select("path", F.sha2("text", 256).alias("file_sha256"), F.posexplode(F.regexp_extract_all("text", F.lit("([^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+$)"), F.lit(1))).alias("k", "line_text"))
    heading = F.when(F.col("line_text").startswith("## "), F.trim(F.regexp_replace("line_text", "[\r\n]+$", "")))
    last = F.last(heading, ignorenulls=True).over(Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("heading", last).filter(F.contains("line_text", F.lit(MARKER)) & ~F.coalesce(F.col("heading") == "## Referenced by", F.lit(False)))
    rows = rows.withColumn("cited_slugs", F.array_distinct(F.regexp_extract_all("line_text", F.lit(CITED), F.lit(1)))).filter(F.size("cited_slugs") > 0)
    number = (F.col("k") + 1).cast("long")
    identity = F.concat("path", F.lit("\0"), number.cast("string"), F.lit("\0"), "line_text")
    return rows.select(F.sha2(identity, 256).alias("claim_id"), "path", number.alias("line_number"), "line_text", F.sha2("line_text", 256).alias("line_sha256"), "file_sha256", "cited_slugs")


def sample(found: DataFrame, seed: int, count: int = 25) -> DataFrame:
    """The claims of a seeded draw without replacement, with ``place`` in the draw's order. Places are
    in the order of path and line; the claims of each path are numbered apart and shifted by sums over paths."""
    per = found.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n")).first()[0] or 0
    drawn = random.Random(seed).sample(range(total), min(count, total))
    if not drawn:
        return found.withColumn("place", F.lit(0)).limit(0)
    # one row a page, not a claim, passes the window that has no partition
    before = per.select("path", (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("path").orderBy("line_number", "claim_id")) - 1
    placed = found.withColumn("within", within).join(before, "path").withColumn("at", F.col("before") + F.col("within"))
    picks = found.sparkSession.createDataFrame([(a, k) for k, a in enumerate(drawn, 1)], "at long, place int")
    return placed.join(F.broadcast(picks), "at").drop("at", "before", "within")


def batches(drawn: DataFrame, plant_text: str, plant_of: str, count: int) -> DataFrame:
    """``(batch_id, item_id, kind, source_id, path, line_number, text, cited_slugs)``: the drawn claims
    and one planted item dealt in turn to ``count`` batches."""
    if count not in (2, 3):
        raise ValueError("batch count must be 2 or 3")
    item = lambda df, place, kind, source, text: df.select(place.alias("k"), F.lit(kind).alias("kind"), source.alias("source_id"), "path", "line_number", text.alias("text"), "cited_slugs")
    last = drawn.agg(F.coalesce(F.max("place"), F.lit(0)).alias("last"))
    plant = drawn.filter(F.col("claim_id") == plant_of).crossJoin(F.broadcast(last))  # one row each
    rows = item(drawn, F.col("place"), "claim", F.col("claim_id"), F.col("line_text")).unionByName(item(plant, F.col("last") + 1, "plant", F.lit(PLANT), F.lit(plant_text)))
    return rows.select(F.format_string("batch-%02d", ((F.col("k") - 1) % count + 1).cast("int")).alias("batch_id"), F.format_string("item-%03d", F.col("k").cast("int")).alias("item_id"), "kind", "source_id", "path", "line_number", "text", "cited_slugs")


def _bags(expected: DataFrame, actual: DataFrame, label: str) -> DataFrame:
    """Errors where two bags of ``key`` differ."""
    count = lambda df, name: df.groupBy("key").agg(F.count(F.lit(1)).alias(name))
    both = count(expected, "e").join(count(actual, "a"), "key", "full").select("key", F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("a", F.lit(0)).alias("a"))
    what = F.when(F.col("e") > F.col("a"), F.lit("missing")).otherwise(F.lit("duplicated or excess"))
    return both.filter("e <> a").select(F.format_string(f"{label}: %s %s", what, "key").alias("error"))


def run_errors(drawn: DataFrame, items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``(error)`` of a run: every drawn claim is in one batch, every item has one verdict of the known
    ones, ``(item_id, verdict)``, and the planted item wasn't verified."""
    key = lambda df, c: df.select(F.col(c).alias("key"))
    told = items.filter("kind = 'plant'").join(verdicts, "item_id", "left")
    unknown = verdicts.filter(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)))
    out = _bags(key(drawn, "claim_id"), key(items.filter("kind = 'claim'"), "source_id"), "sample-to-batch claims")
    out = out.unionByName(_bags(key(items, "item_id"), key(verdicts, "item_id"), "batch-to-verdict item IDs"))
    out = out.unionByName(unknown.select(F.format_string("verdict %s: invalid verdict", "item_id").alias("error")))
    out = out.unionByName(told.filter("verdict = 'VERIFIED'").select(F.lit("plant: returned VERIFIED instead of being caught").alias("error")))
    return out.unionByName(told.filter("verdict IS NULL").select(F.lit("plant: no unique verdict was returned").alias("error")))


def metrics(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``(sampled, batches, flagged, plant_verdict)`` of a run."""
    real: Column = F.col("kind") == "claim"
    both = items.join(verdicts, "item_id", "left")
    return both.agg(F.count_if(real).alias("sampled"), F.countDistinct("batch_id").alias("batches"), F.count_if(real & (F.col("verdict") != "VERIFIED")).alias("flagged"), F.max(F.when(~real, F.col("verdict"))).alias("plant_verdict"))


def stale(drawn: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, line_number, error)`` of drawn claims whose file or line has changed since; ``now`` are
    the claims and files ``(path, text)`` as they stand."""
    files = now.select("path", F.sha2("text", 256).alias("sha"))
    both = drawn.join(files, "path", "left")
    error = F.when(F.col("sha").isNull(), F.lit("file is gone")).when(F.col("sha") != F.col("file_sha256"), F.lit("file hash changed"))
    return both.select("path", "line_number", error.alias("error")).filter("error IS NOT NULL")
