"""Site-relative line dedup, in DataFrame functions only.

For each host, the pages that hold a line are counted (a page counts once for each line) and
divided by the host's pages; a line above ``ratio``, on ``least_pages`` pages at least, is
boilerplate there and dropped from every page of the host.

Lines travel as two 64-bit hashes with their host's, counted before the shuffle, so a host or
a line that holds a third of all rows costs one row for each task. A host has at most (mean lines of a page) /
``ratio`` boilerplate lines; the lists of all hosts are broadcast when their measured size is
small, and else joined to salted documents.

Defined results: lines are compared without blanks, tabs and carriage returns at their ends, and
blank lines always stay; a null text has no lines and stays null; rows with a null host are one
site; each row is a page, repeated or not; an id may be null or repeated, for nothing is joined by
it; an empty table gives no row; a text of any length is one array of lines in its row; other
columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import materialise, unused

RATIO = 0.05
#: A line on fewer pages is no boilerplate of its host, whatever the ratio: of a handful of pages one line
#: in common says nothing yet.
LEAST_PAGES = 4
#: Boilerplate lines of all hosts (16 bytes each) that may be broadcast.
BROADCAST_LINES = 200_000
SALTS = 32


def _key(line: Column) -> Column:
    line = F.btrim(line, F.lit(" \t\r"))
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) == ""


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``(host, n, bad)``: hash of each host and its boilerplate lines' hashes."""
    rows = pages.select(F.xxhash64(F.col(host_col)).alias("host"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    keys = F.array_distinct(F.transform(F.filter("lines", lambda x: ~_blank(x)), _key))
    counts = rows.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    often = counts.filter(F.col("n") >= least_pages).join(totals, "host").filter(F.col("n") > F.col("pages") * ratio)
    return often.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.collect_list("line").alias("bad"))


def line_dedup(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The pages with boilerplate lines dropped from their text, all columns kept, and last
    ``n_lines`` and ``n_removed`` (of the row before), or ``n_lines_1`` and so on where a column is
    called so."""
    bad = materialise(boilerplate(pages, host_col, text_col, ratio, least_pages), "boilerplate")
    size = bad.agg(F.sum("n")).first()[0] or 0
    rows = pages.select(F.struct("*").alias("row"), F.xxhash64(F.col(host_col)).alias("host"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    if size <= broadcast_lines:
        rows = rows.join(F.broadcast(bad.select("host", "bad")), "host", "left")
    else:
        # a host's rows go to as many tasks as there are, a third of all rows included
        n = max(SALTS, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        salts = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("lines"), F.lit(n)).cast("int"))
        rows = rows.join(bad.select("host", "bad", salts.alias("salt")), ["host", "salt"], "left")
    kept = F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: _blank(x) | ~F.array_contains("bad", _key(x))))
    rows = rows.select("row", "lines", kept.alias("kept"))
    names = pages.columns
    return rows.select(
        *[F.array_join("kept", "\n").alias(n) if n == text_col else F.col("row").getField(n).alias(n) for n in names],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias(unused(names, "n_lines")),
        (F.coalesce(F.size("lines"), F.lit(0)) - F.coalesce(F.size("kept"), F.lit(0))).cast("long").alias(unused(names, "n_removed")),
    )


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT DISTINCT r, source, trim(x, ' ' || chr(9) || chr(13)) AS line FROM (SELECT r, source, unnest(lines) AS x FROM d) AS u),
c AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY source, line),
t AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
bad AS (SELECT c.source, c.line FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= {LEAST_PAGES} AND n > pages * CAST({RATIO} AS DOUBLE)),
x AS (SELECT r, source, generate_subscripts(lines, 1) AS k, unnest(lines) AS line FROM d),
y AS (SELECT x.r, x.k, x.line, bad.line IS NOT NULL AS gone FROM x LEFT JOIN bad ON x.source IS NOT DISTINCT FROM bad.source AND trim(x.line, ' ' || chr(9) || chr(13)) = bad.line),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone) AS kept FROM y GROUP BY r)
SELECT d.doc_id, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed, sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.kept, '') END) AS kept_sha256
FROM d LEFT JOIN g ON d.r = g.r
"""
