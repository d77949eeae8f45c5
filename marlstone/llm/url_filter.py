"""URL filter by a ratio of character language models, in DataFrame functions only.

URLs that a rule accepts or rejects train two interpolated Markov models of up to three characters
of context over all that follows ``://`` (query and fragment included; a URL without it is read whole);
host and path alone are cut out for the rules. Other URLs are judged by the mean over their characters of the difference of the
models' log probabilities, against a threshold between the two classes' mean scores, weighted by
their spread.

One pass counts each distinct four-character run by class; every shorter context is a sum over
that table. Runs are counted before the shuffle and URLs that read alike are scored once, so a
host or a URL that holds a third of all rows costs no more than others. The table of runs is
broadcast when its measured size is small, and else shuffled.

Defined results: a null URL or one without ``://`` has an empty host and path; the null one is judged
by the models on the empty text. An empty table gives no row. A very long URL is read whole. A URL that many rows share is
scored once; joining its verdict to them is left to adaptive execution, which splits such keys. Rows are judged one by one, repeated or not; without accepted or without rejected URLs
to learn from, no rule means allow. Columns other than the id and the URL are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import materialise

# The rules (host, path, verdict) in the order given.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Weight of the shorter context, in characters.
BACK_OFF = 4.0
#: Characters that a model reckons with beyond those it has seen.
ALPHABET = 128
BROADCAST_RUNS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def _rule(rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _log_ratio(runs: DataFrame) -> DataFrame:
    """``(run, llr)`` from ``(run, a, r)``."""
    total = runs.agg(F.sum("a").alias("a"), F.sum("r").alias("r")).first()
    part = lambda *at: Window.partitionBy(F.substring("run", *at))
    for c in "ar":
        over = lambda *at, c=c: F.sum(c).over(part(*at))
        runs = runs.withColumns({f"{c}3": over(1, 3), f"{c}n3": over(2, 3)})
        runs = runs.withColumns({f"{c}2": over(2, 2), f"{c}n2": over(3, 2)})
        runs = runs.withColumns({f"{c}1": over(3, 1), f"{c}n1": over(4, 1)})
        p = (F.col(f"{c}n1") + 0.5) / F.lit(float((total[c] or 0) + 0.5 * ALPHABET))
        for seen, context in ((f"{c}n2", f"{c}1"), (f"{c}n3", f"{c}2"), (c, f"{c}3")):
            p = (F.col(seen) + BACK_OFF * p) / (F.col(context) + BACK_OFF)
        runs = runs.withColumn(f"{c}p", p)
    return runs.select("run", (F.log("ap") - F.log("rp")).alias("llr"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    host, path = url_parts(F.col("url"))
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"\A(?s).*?://", "")
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), rest.alias("rest"))
    name, verdict = _rule(rules)
    rows = rows.withColumns({"rule": name, "by_rule": verdict})
    text = F.translate(F.lower("rest"), "123456789", "000000000")
    rows = rows.withColumn("read", F.concat(F.lit("\x02\x02\x02"), text, F.lit("\x03")))
    # a URL travels as two 64-bit hashes, so a long one costs no more for each of its runs
    rows = rows.withColumn("key", F.struct(F.xxhash64("read").alias("k1"), F.xxhash64(F.lit(1), "read").alias("k2"))).drop("rest")
    alike = materialise(rows.groupBy("key").agg(F.first("read").alias("read"), F.count_if(F.col("by_rule") == "allow").alias("a"), F.count_if(F.col("by_rule") == "block").alias("r")), "urls")
    each = F.explode(F.transform(F.sequence(F.lit(1), F.length("read") - 3), lambda i: F.substr("read", i, F.lit(4)))).alias("run")
    runs = alike.select(each, "a", "r").groupBy("run").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    llr = materialise(_log_ratio(materialise(runs, "url-runs")), "url-model")
    if llr.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS:
        llr = F.broadcast(llr)
    scored = alike.select("key", "a", "r", each).join(llr, "run").groupBy("key").agg(F.first("a").alias("a"), F.first("r").alias("r"), F.avg("llr").alias("score"))
    scored = materialise(scored, "url-scores")
    s, q = F.col("score"), lambda c: (F.sum(F.col(c)), F.sum(F.col(c) * F.col("score")), F.sum(F.col(c) * F.col("score") * F.col("score")))
    n_a, s_a, q_a, n_r, s_r, q_r = scored.agg(*[x.alias(f"x{i}") for i, x in enumerate((*q("a"), *q("r")))]).first()
    if n_a and n_r:
        m_a, m_r = s_a / n_a, s_r / n_r
        d_a, d_r = (max(x / n - m * m, 0.0) ** 0.5 + 1e-9 for x, n, m in ((q_a, n_a, m_a), (q_r, n_r, m_r)))
        judged = F.when(F.round(s, 6) >= F.round(F.lit((m_a * d_r + m_r * d_a) / (d_a + d_r)), 6), "allow").otherwise("block")
    else:
        judged = F.lit("allow")
    out = rows.drop("read").join(scored.select("key", judged.alias("judged")), "key", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "judged").alias("verdict"))


def _oracle() -> str:
    order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in order]
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values, strict=True)) + " END"
    sums = ", ".join(f"sum({c}) OVER (PARTITION BY substr(run, {i}, {n})) AS {c}{x}" for c in "ar" for x, i, n in (("3", 1, 3), ("n3", 2, 3), ("2", 2, 2), ("n2", 3, 2), ("1", 3, 1), ("n1", 4, 1)))

    def p(c: str) -> str:
        out = f"(({c}n1 + CAST(0.5 AS DOUBLE)) / (tot.{c}t + CAST({0.5 * ALPHABET} AS DOUBLE)))"
        for seen, context in ((f"{c}n2", f"{c}1"), (f"{c}n3", f"{c}2"), (c, f"{c}3")):
            out = f"(({seen} + CAST({BACK_OFF} AS DOUBLE) * {out}) / ({context} + CAST({BACK_OFF} AS DOUBLE)))"
        return out

    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE coalesce(url, '') END AS whole FROM pages),
h AS (SELECT page_id, whole, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT page_id, host, path, {case([h + p for h, p, _ in order])} AS rule, {case([v for *_, v in order])} AS by_rule,
  chr(2) || chr(2) || chr(2) || translate(lower(whole), '123456789', '000000000') || chr(3) AS txt FROM h),
k AS (SELECT txt, count(*) FILTER (WHERE by_rule = 'allow') AS a, count(*) FILTER (WHERE by_rule = 'block') AS r FROM d GROUP BY txt),
e AS (SELECT txt, a, r, substr(txt, CAST(i AS BIGINT), 4) AS run FROM (SELECT txt, a, r, unnest(range(1, length(txt) - 2)) AS i FROM k) AS q),
g AS (SELECT run, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(r) AS DOUBLE) AS r FROM e GROUP BY run),
tot AS (SELECT sum(a) AS at, sum(r) AS rt FROM g),
w AS (SELECT run, a, r, {sums} FROM g),
m AS (SELECT run, ln({p("a")}) - ln({p("r")}) AS llr FROM w, tot),
s AS (SELECT e.txt, any_value(e.a) AS a, any_value(e.r) AS r, avg(m.llr) AS score FROM e JOIN m ON e.run = m.run GROUP BY e.txt),
c AS (SELECT sum(a) AS na, sum(r) AS nr, sum(a * score) / sum(a) AS ma, sum(r * score) / sum(r) AS mr, sum(a * score * score) / sum(a) AS qa, sum(r * score * score) / sum(r) AS qr FROM s),
t AS (SELECT na, nr, ma, mr, sqrt(greatest(qa - ma * ma, 0)) + 1e-9 AS da, sqrt(greatest(qr - mr * mr, 0)) + 1e-9 AS dr FROM c)
SELECT d.page_id, d.host, d.path, d.rule, coalesce(d.by_rule, CASE WHEN t.na > 0 AND t.nr > 0 AND round(s.score, 6) < round((t.ma * t.dr + t.mr * t.da) / (t.da + t.dr), 6) THEN 'block' ELSE 'allow' END) AS verdict
FROM d JOIN s ON d.txt = s.txt CROSS JOIN t
"""


ORACLE_SQL = _oracle()
