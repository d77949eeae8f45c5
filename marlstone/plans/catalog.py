"""Named queries over the driver's tables and their SQL twins.

The reference's operators work on pages, links, logs and registries; each is put here on a driver
table of the same shape. A query is Spark SQL over DataFrames (no temporary views), or a function
where the DataFrame API says it better. Where both dialects agree, one text serves both.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.markdown import STOP_WORDS
from marlstone.operators.similarity import closest_pairs, similar_counts, similar_pairs, token_set
from marlstone.plans import corpus
from marlstone.sources.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The date that "due" and "stale" are reckoned from.
AS_OF = "1998-01-01"


#: A table's place in a query; other braces are doubled.
_TABLE = re.compile(r"(?<![{p])\{([a-z]+)\}(?!\})")


def _sql(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """Register a query; tables stand in braces. Without ``oracle`` DuckDB reads the same text."""
    names = sorted(set(_TABLE.findall(spark_sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not names:  # then Spark doesn't format the text, and braces are not doubled
            return spark.sql(spark_sql.replace("{{", "{").replace("}}", "}"))
        return spark.sql(spark_sql, **{n: table(spark, sf_dir, n) for n in names})

    QUERIES[name] = run
    ORACLES[name] = _TABLE.sub(r"\1", oracle or spark_sql)


# --- set-similarity joins -------------------------------------------------------------------

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
_TOKENS = f"""
tok AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9'']+')) AS w FROM documents) AS u
  WHERE length(w) >= 4 AND w NOT IN ({_STOP})),
cnt AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
prs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM tok AS a JOIN tok AS b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
sim AS (SELECT prs.a, prs.b, shared, CAST(shared AS DOUBLE) / (x.n + y.n - shared) AS score FROM prs JOIN cnt AS x ON x.doc_id = prs.a JOIN cnt AS y ON y.doc_id = prs.b)
"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return similar_pairs(docs.select("doc_id", token_set(F.col("text")).alias("s")), "doc_id", "s", 0.35)


QUERIES["near_duplicate_documents"] = lambda spark, d: closest_pairs(table(spark, d, "documents").select("doc_id", token_set(F.col("text")).alias("s")), "doc_id", "s", 0.35, 15)
ORACLES["near_duplicate_documents"] = f"WITH {_TOKENS} SELECT a, b, shared, score FROM sim WHERE score >= CAST(0.35 AS DOUBLE) ORDER BY score DESC, a DESC, b DESC LIMIT 15"
QUERIES["near_duplicate_pairs"] = _near
ORACLES["near_duplicate_pairs"] = f"WITH {_TOKENS} SELECT a, b, shared, score FROM sim WHERE score >= CAST(0.35 AS DOUBLE)"
QUERIES["document_token_sets"] = lambda spark, d: table(spark, d, "documents").select("doc_id", F.explode(token_set(F.col("text"))).alias("w"))
ORACLES["document_token_sets"] = f"WITH {_TOKENS} SELECT doc_id, w FROM tok"


def _confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    inbound = similar_counts(docs.select("doc_id", token_set(F.col("text")).alias("s")), "doc_id", "s", 0.35).select(F.col("id").alias("doc_id"), F.col("pairs").alias("inbound"))
    return table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").join(inbound, "doc_id").filter("inbound >= 2")


QUERIES["confidence_upgrade"] = _confidence
ORACLES["confidence_upgrade"] = f"""WITH {_TOKENS}, e AS (SELECT a, b FROM sim WHERE score >= CAST(0.35 AS DOUBLE)), i AS (SELECT doc_id, count(*) AS inbound FROM (SELECT a AS doc_id FROM e UNION ALL SELECT b FROM e) AS u GROUP BY doc_id)
SELECT i.doc_id, inbound FROM i JOIN labels ON labels.doc_id = i.doc_id WHERE quality = 0 AND inbound >= 2"""

# --- links ----------------------------------------------------------------------------------

_HREF_SPARK = "SELECT DISTINCT page_id, href FROM (SELECT page_id, explode(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM {pages})"
_HREF_DUCK = "SELECT DISTINCT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages) AS u"
_PATH_SPARK = "regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1)"


def _links(name: str, body: str, spark_body: str | None = None) -> None:
    _sql(name, f"WITH l AS ({_HREF_SPARK}) {spark_body or body}", f"WITH l AS ({_HREF_DUCK}) {body}")


_links("page_links", "SELECT page_id, href FROM l")
_links("link_out_degree", "SELECT page_id, count(*) AS out_degree FROM l GROUP BY page_id")
_links("link_in_degree", "SELECT href, count(*) AS in_degree FROM l GROUP BY href")
_links(
    "link_reverse_index",
    "SELECT href, count(*) AS n, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS pages FROM l GROUP BY href",
    "SELECT href, count(*) AS n, array_join(transform(array_sort(collect_list(page_id)), x -> CAST(x AS STRING)), ',') AS pages FROM l GROUP BY href",
)
_links("dangling_page_links", f"SELECT page_id, href FROM l WHERE NOT EXISTS (SELECT 1 FROM pages WHERE {_PATH_SPARK} = l.href)", f"SELECT page_id, href FROM l WHERE NOT EXISTS (SELECT 1 FROM {{pages}} p WHERE {_PATH_SPARK} = l.href)")


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return similar_pairs(pages.select("page_id", hrefs.alias("s")), "page_id", "s", 0.5).filter("shared >= 3")


QUERIES["missing_related_pages"] = _related
ORACLES["missing_related_pages"] = f"""WITH l AS ({_HREF_DUCK}), c AS (SELECT page_id, count(*) AS n FROM l GROUP BY page_id),
p AS (SELECT a.page_id AS a, b.page_id AS b, count(*) AS shared FROM l AS a JOIN l AS b ON a.href = b.href AND a.page_id < b.page_id GROUP BY a.page_id, b.page_id)
SELECT a, b, shared, CAST(shared AS DOUBLE) / (x.n + y.n - shared) AS score FROM p JOIN c AS x ON x.page_id = a JOIN c AS y ON y.page_id = b WHERE shared >= 3 AND CAST(shared AS DOUBLE) / (x.n + y.n - shared) >= CAST(0.5 AS DOUBLE)"""

# --- filters, anti joins and set rules --------------------------------------------------------

_sql("exact_duplicate_groups", "SELECT min(doc_id) AS first_id, count(*) AS n FROM {documents} GROUP BY text HAVING count(*) > 1")
_sql(
    "thin_documents",
    r"SELECT doc_id, CAST(regexp_count(text, '[\\p{{L}}\\p{{N}}_]+') AS BIGINT) AS words FROM {documents} WHERE regexp_count(text, '[\\p{{L}}\\p{{N}}_]+') < 80",
    r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS BIGINT) AS words FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) < 80",
)
_sql("unlabelled_documents", "SELECT doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)")
_sql("orphan_orders", "SELECT o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)")
_sql("uncited_documents", "SELECT doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM {benchmark} b WHERE contains(d.text, b.text))")
_sql(
    "index_coverage",
    """SELECT CASE WHEN l.k IS NULL THEN 'missing' WHEN o.k IS NULL THEN 'stale' ELSE 'duplicate' END AS finding, coalesce(o.k, l.k) AS k
FROM (SELECT o_orderkey AS k, count(*) AS n FROM {orders} GROUP BY o_orderkey) o FULL OUTER JOIN (SELECT l_orderkey AS k FROM {lineitem} GROUP BY l_orderkey) l ON o.k = l.k
WHERE l.k IS NULL OR o.k IS NULL OR o.n > 1""",
)
_sql("enum_violations", "SELECT event_id, event_type FROM {events} WHERE event_type NOT IN ('click', 'purchase', 'view')")
_sql(
    "entity_count_drift",
    """SELECT r_name, declared, coalesce(actual, 0) AS actual FROM (VALUES ('AFRICA', 5), ('AMERICA', 4), ('ASIA', 5), ('NOWHERE', 1)) AS d(r_name, declared)
LEFT JOIN (SELECT r_name AS name, count(*) AS actual FROM {region} JOIN {nation} ON n_regionkey = r_regionkey GROUP BY r_name) c ON name = r_name WHERE coalesce(actual, 0) <> declared""",
)
_sql(
    "catalog_parity",
    """SELECT coalesce(n_nationkey, k) AS k, CASE WHEN k IS NULL THEN 'missing' WHEN n_nationkey IS NULL THEN 'extra' ELSE 'differs' END AS finding
FROM {nation} FULL OUTER JOIN (VALUES (0, 0), (1, 1), (2, 3), (99, 1)) AS d(k, r) ON n_nationkey = k WHERE k IS NULL OR n_nationkey IS NULL OR r <> n_regionkey""",
)
_sql("duplicate_identity", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha2(text, 256) ORDER BY doc_id) AS k FROM {documents}) t WHERE k > 1", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents) t WHERE k > 1")
_sql(
    "verdict_accounting",
    "SELECT coalesce(e.lang, a.lang) AS lang, coalesce(e.n, 0) AS expected, coalesce(a.n, 0) AS actual FROM (SELECT lang, count(*) AS n FROM {documents} GROUP BY lang) e FULL OUTER JOIN (SELECT lang, count(*) AS n FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY lang) a ON e.lang = a.lang WHERE coalesce(e.n, 0) <> coalesce(a.n, 0)",
)

# --- dates, drift and due -----------------------------------------------------------------------

_sql(
    "recompile_candidates",
    "SELECT o_orderkey, count(*) AS newer, max(CAST(l_shipdate AS DATE)) AS latest FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) GROUP BY o_orderkey",
)
_sql("status_drift", "SELECT o_orderkey, n_name FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey JOIN (VALUES (0, DATE '1996-01-01'), (2, DATE '1994-06-01')) AS w(r, status) ON r = n_regionkey WHERE status > CAST(o_orderdate AS DATE)")
_sql("review_due", f"SELECT o_orderkey, CAST(datediff(DATE '{AS_OF}', CAST(o_orderdate AS DATE)) AS BIGINT) AS overdue FROM {{orders}} WHERE CAST(o_orderdate AS DATE) <= DATE '{AS_OF}'", f"SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS BIGINT) AS overdue FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '{AS_OF}'")
_sql("freshness", "SELECT o_orderkey, greatest(CAST(o_orderdate AS DATE), s) AS fresh FROM {orders} LEFT JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS s FROM {lineitem} GROUP BY l_orderkey) l ON l_orderkey = o_orderkey")
_sql(
    "backup_freshness_class",
    f"SELECT age, count(*) AS n FROM (SELECT CASE WHEN o_orderdate IS NULL THEN 'missing' WHEN CAST(o_orderdate AS DATE) > DATE '{AS_OF}' THEN 'future' WHEN CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - INTERVAL 30 DAY THEN 'fresh' ELSE 'stale' END AS age FROM {{orders}}) t GROUP BY age",
)
_sql("date_rule", "SELECT s FROM (VALUES ('2026-01-01'), ('2026-02-30'), ('2026-6-1'), ('0000-01-01'), ('20260101')) AS v(s) WHERE NOT (s RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' AND s NOT LIKE '0000%' AND try_cast(s AS DATE) IS NOT NULL)", "SELECT s FROM (VALUES ('2026-01-01'), ('2026-02-30'), ('2026-6-1'), ('0000-01-01'), ('20260101')) AS v(s) WHERE NOT (regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND s NOT LIKE '0000%' AND try_cast(s AS DATE) IS NOT NULL)")

# --- ordered analytics ----------------------------------------------------------------------------

_sql("event_sessions_by_header", "SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM {events}) t GROUP BY user_id, session")
_sql("fence_parity", "SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) % 2 AS inside FROM {events}")
_sql(
    "synthesis_due_by_user",
    "SELECT e.user_id, count(*) AS n FROM {events} e LEFT JOIN (SELECT user_id, max(ts) AS last FROM {events} WHERE event_type = 'signup' GROUP BY user_id) s ON s.user_id = e.user_id WHERE event_type = 'purchase' AND (last IS NULL OR ts > last) GROUP BY e.user_id HAVING count(*) >= 2",
)
_sql(
    "carry_forward_role",
    "SELECT conv_id, turn, last_value(CASE WHEN role = 'system' THEN text END) IGNORE NULLS OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM {conversations}",
    "SELECT conv_id, turn, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM conversations",
)
_sql("log_rotation_cut", "SELECT conv_id, min(turn) AS cut FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS rest FROM {conversations}) t WHERE rest <= 600 GROUP BY conv_id")
_sql("round_robin_batches", "SELECT item_id, k % 3 AS batch, concat('item-', lpad(CAST(k + 1 AS STRING), 3, '0')) AS name FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k FROM {benchmark}) t")
_sql("evidence_hash_sample", "SELECT doc_id FROM {documents} ORDER BY sha2(concat('42|', CAST(doc_id AS STRING)), 256), doc_id LIMIT 25", "SELECT doc_id FROM documents ORDER BY sha256('42|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 25")

# --- text -----------------------------------------------------------------------------------------

_sql("quote_verification", "SELECT b.item_id, count(d.doc_id) AS found FROM {benchmark} b LEFT JOIN {documents} d ON contains(d.text, b.text) GROUP BY b.item_id")
_sql("volatile_phrase_hits", "SELECT DISTINCT doc_id, lower(phrase) AS phrase FROM (SELECT doc_id, explode(regexp_extract_all(text, '(?i)(licensed under|all rights reserved|released under)', 1)) AS phrase FROM {documents})", "SELECT DISTINCT doc_id, lower(phrase) AS phrase FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(licensed under|all rights reserved|released under)', 1)) AS phrase FROM documents) AS t")
_sql("stale_text_sweep", "SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, explode(split(text, '\n')) AS line FROM {documents}) WHERE line RLIKE '(?i)licen[cs]e' GROUP BY doc_id", "SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) AS t WHERE regexp_matches(line, '(?i)licen[cs]e') GROUP BY doc_id")
_sql("claim_identity", "SELECT doc_id, CAST(pos + 1 AS BIGINT) AS line_no, sha2(concat(CAST(doc_id AS STRING), '|', CAST(pos + 1 AS STRING), '|', line), 256) AS claim_id FROM (SELECT doc_id, posexplode(split(text, '\n')) AS (pos, line) FROM {documents})", "SELECT doc_id, CAST(k AS BIGINT) AS line_no, sha256(CAST(doc_id AS VARCHAR) || '|' || CAST(k AS VARCHAR) || '|' || line) AS claim_id FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM documents) AS t")
_sql("manifest_hashes", "SELECT doc_id, sha2(text, 256) AS sha, md5(text) AS md, CAST(octet_length(text) AS BIGINT) AS size FROM {documents}", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md, CAST(strlen(text) AS BIGINT) AS size FROM documents")

# --- gates, suppression, report -------------------------------------------------------------------

_sql("gate_route", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'chat-only' WHEN n_chars > 3000 AND quality = 1 THEN 'analysis-capture' WHEN toxic = 1 THEN 'blocked' ELSE 'promotion-audit' END AS route FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id")
_RULES = "SELECT 'short' AS rule, doc_id FROM {documents} WHERE n_chars < 400 UNION ALL SELECT 'unlabelled', doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)"
_REGISTRY = "(VALUES ('short', 2), ('short', 8), ('unlabelled', 1), ('unlabelled', 5), ('gone', 3)) AS s(rule, doc_id)"
_sql("suppressed_findings", f"SELECT f.rule, f.doc_id FROM ({_RULES}) f WHERE NOT EXISTS (SELECT 1 FROM {_REGISTRY} WHERE s.rule = f.rule AND s.doc_id = f.doc_id)")
_sql("dead_adjudications", f"SELECT s.rule, s.doc_id FROM {_REGISTRY} WHERE NOT EXISTS (SELECT 1 FROM ({_RULES}) f WHERE s.rule = f.rule AND s.doc_id = f.doc_id)")
_sql("findings_summary", f"SELECT rule, count(*) AS n FROM ({_RULES}) f GROUP BY rule")
_sql("findings_report", f"SELECT rule, doc_id, k FROM (SELECT rule, doc_id, row_number() OVER (PARTITION BY rule ORDER BY doc_id) AS k FROM ({_RULES}) f) t WHERE k <= 25")
_sql("props_contract", "SELECT event_type, count(*) AS n FROM {events} WHERE get_json_object(props, '$.k') RLIKE '^[0-9]+$' GROUP BY event_type", "SELECT event_type, count(*) AS n FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') GROUP BY event_type")

# --- pages -------------------------------------------------------------------------------------------

QUERIES |= corpus.QUERIES
ORACLES |= corpus.ORACLES
