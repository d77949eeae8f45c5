"""The link graph of parsed pages: edges, degrees, orphans, dangling links, backlinks, reach.

Links are by stem. Where several pages share one, the last by path is the target of counts, and
generated sections never count (see ``functions.markdown``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.sources.session import allow_checkpoints


def edges(pages: DataFrame) -> DataFrame:
    """``(src, slug)`` for each distinct link of a page, to itself included."""
    return pages.select(F.col("path").alias("src"), F.explode(F.array_distinct("page.links")).alias("slug"))


def targets(pages: DataFrame) -> DataFrame:
    """``(slug, dst)``: the page that a stem stands for."""
    return pages.groupBy(F.col("stem").alias("slug")).agg(F.max("path").alias("dst"))


def in_degree(pages: DataFrame) -> DataFrame:
    """``(path, inbound)`` for every page, 0 where no other page links to it."""
    met = edges(pages).join(targets(pages), "slug").filter("src <> dst")
    counts = met.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return pages.select("path").join(counts, "path", "left").select("path", F.coalesce("n", F.lit(0)).cast("long").alias("inbound"))


def orphans(pages: DataFrame) -> DataFrame:
    return in_degree(pages).filter("inbound = 0").select("path")


def dangling(pages: DataFrame, known: Column | None = None) -> DataFrame:
    """``(src, slug)`` of links to no page; ``known`` is a condition on ``slug`` for what else there is.
    A link that ends in a slash points to a folder."""
    gone = edges(pages).filter(~F.col("slug").endswith("/")).join(pages.select(F.col("stem").alias("slug")), "slug", "left_anti")
    return (gone.filter(~known) if known is not None else gone).select("src", "slug")


def backlinks(pages: DataFrame) -> DataFrame:
    """``(path, folder, refs)``: for each page the stems that link to it, by their folder, in order.
    All pages that share a stem get its links."""
    of = pages.select(F.col("path").alias("src"), F.coalesce("folder", F.lit("wiki root")).alias("folder"), F.col("stem").alias("ref"))
    met = edges(pages).join(pages.select(F.col("stem").alias("slug"), "path"), "slug").filter("src <> path").join(of, "src")
    return met.groupBy("path", "folder").agg(F.array_sort(F.collect_list("ref")).alias("refs"))


def walk(steps: DataFrame, roots: DataFrame) -> DataFrame:
    """``(path)`` of all that ``steps`` ``(src, dst)`` lead to from ``roots`` ``(path)``, by frontier; it
    ends, as each round takes unseen paths only."""
    allow_checkpoints(steps.sparkSession)
    steps = steps.distinct().checkpoint()
    seen = frontier = roots.select("path").distinct().checkpoint()
    while True:
        frontier = frontier.join(steps, frontier["path"] == steps["src"]).select(F.col("dst").alias("path")).distinct().join(seen, "path", "left_anti").checkpoint()
        if not frontier.limit(1).count():
            return seen
        seen = seen.unionByName(frontier).checkpoint()


def reachable(pages: DataFrame, roots: DataFrame) -> DataFrame:
    """``(path)`` of every page that can be reached from ``roots``."""
    steps = edges(pages).join(pages.select(F.col("stem").alias("slug"), F.col("path").alias("dst")), "slug").select("src", "dst")
    return walk(steps, roots)
