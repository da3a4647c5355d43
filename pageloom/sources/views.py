"""Inputs of the operators, bound to the tables at hand. Each view has a Spark form and DuckDB SQL; both derive features that the tables lack by the same arithmetic on ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.columns import host
from pageloom.sources import html
from pageloom.sources.html import CODE, LANG, TITLE

AS_OF = "2024-01-31 00:00:00"

#: Page features that the HTML at hand lacks, as SQL of page_id (p), the same in both engines.
FEATURES = {
    "ad_count": "CAST(p % 9 AS INT)",
    "ad_url_count": "CAST(p % 12 AS INT)",
    "popup_count": "CAST(p % 3 AS INT)",
    "video_ad_count": "CAST(p % 4 AS INT)",
    "affiliate_link_count": "CAST((p * 3) % 25 AS INT)",
    "ad_above_fold": "p % 2 = 0",
    "has_paywall": "p % 10 = 3",
    "paywall_confidence": "CAST(p % 11 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "eat_score": "CAST((p * 37) % 101 AS INT)",
    "readability_score": "CAST((p * 53) % 101 AS DOUBLE)",
    "domain_trust": "CAST((p * 7) % 100 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "domain_age": "CAST(p % 15 AS DOUBLE)",
    "image_count": "CAST(p % 7 AS INT)",
    "video_count": "CAST(CASE WHEN p % 8 = 0 THEN 1 ELSE 0 END AS INT)",
    "comment_count": "CAST((p * 11) % 70 AS INT)",
    "has_table": "p % 4 = 0",
    "has_steps": "p % 5 = 0",
    "dwell_ms": "CAST((p * 997) % 200000 AS BIGINT)",
    "ctr": "CAST(p % 10 AS DOUBLE)",
    "load_ms": "CAST((p * 131) % 4000 AS DOUBLE)",
    "mobile_friendly": "p % 6 <> 0",
    "outbound_ok": "p % 13 <> 0",
    "author": "CASE WHEN p % 4 = 3 THEN NULL ELSE concat('Author ', CAST(p % 17 AS VARCHAR(20))) END",
    "author_type": "CASE p % 4 WHEN 0 THEN 'agency' WHEN 1 THEN 'journalist' WHEN 2 THEN 'editorial' ELSE 'none' END",
    "schema_type": "CASE WHEN p % 3 = 0 THEN 'Article' END",
    "rating_value": "CAST(p % 6 AS DOUBLE)",
    "rating_count": "CAST(p % 40 AS INT)",
    "category": "CASE p % 5 WHEN 0 THEN 'news' WHEN 1 THEN 'shop' WHEN 2 THEN 'health' WHEN 3 THEN 'technology' ELSE 'sport' END",
    "image": "CASE WHEN p % 7 > 0 THEN concat('https://img.example.com/', CAST(p AS VARCHAR(20)), '.jpg') END",
    "price": "CASE WHEN p % 5 = 1 THEN CAST(p % 300 AS DOUBLE) END",
}

Table = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = html.page_text(read(spark, sf_dir, "pages")).withColumn("internal_links", F.regexp_count("html", F.lit(html.COUNTS["internal_links"])))
    base = html.text_ratios(raw).withColumns({"p": F.col("page_id"), "domain": host(F.col("url")), "secure": F.col("url").startswith("https")}).drop("html", "internal_links")
    timed = base.withColumn("published_at", F.to_timestamp(F.lit(AS_OF)) - F.make_dt_interval(days=(F.col("p") * 3).cast("int")))
    faq = F.when(F.col("p") % 9 == 0, F.array(F.lit("q"))).otherwise(F.array().cast("array<string>"))
    return timed.withColumn("faq", faq).select("*", *(F.expr(e).alias(n) for n, e in FEATURES.items())).drop("p")




V_PAGES = rf"""v_pages AS (
  SELECT * EXCLUDE (html, sentences, internal_links), {', '.join(f'{e} AS {n}' for n, e in html.RATIOS.items())}, CASE WHEN page_id % 9 = 0 THEN ['q'] ELSE [] END AS faq
  FROM (SELECT *, CAST(len(string_split(content, ' ')) AS INTEGER) AS word_count, len(regexp_extract_all(content, '{html.SENTENCE_END}')) AS sentences
        FROM (SELECT page_id, url, html, nullif(regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '^www\.', ''), '') AS domain,
               regexp_extract(html, '{TITLE}', 1) AS title, regexp_extract(html, '{LANG}', 1) AS language,
               trim(regexp_replace(regexp_replace(html, '{CODE}', ' ', 'g'), '\s+', ' ', 'g')) AS content,
               len(regexp_extract_all(html, '{html.COUNTS['internal_links']}')) AS internal_links,
               starts_with(url, 'https') AS secure,
               TIMESTAMP '{AS_OF}' - to_days(CAST(page_id * 3 AS INTEGER)) AS published_at,
               {', '.join(f'{e} AS {n}' for n, e in FEATURES.items())}
        FROM (SELECT *, page_id AS p FROM pages))))"""


def v_domain_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes by domain of the page table: purchases and signups are for, errors against; a user votes on the page of the same number."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("user_id"), host(F.col("url")).alias("domain"))
    joined = read(spark, sf_dir, "events").join(pages, "user_id")
    return joined.groupBy("domain").agg(
        F.count_if(F.col("event_type").isin("signup", "purchase")).alias("positive"), F.count_if(F.col("event_type") == "view").alias("neutral"), F.count_if(F.col("event_type") == "error").alias("negative")
    )


V_DOMAIN_VOTES = r"""v_domain_votes AS (
  SELECT domain, count(*) FILTER (WHERE event_type IN ('signup', 'purchase')) AS positive,
         count(*) FILTER (WHERE event_type = 'view') AS neutral, count(*) FILTER (WHERE event_type = 'error') AS negative
  FROM events JOIN (SELECT page_id AS user_id, nullif(regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '^www\.', ''), '') AS domain
                    FROM pages) USING (user_id) GROUP BY domain)"""

K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"


def v_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.expr(K))


def v_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v_events(spark, sf_dir).where("event_type = 'click'")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("https://u"), (F.col("k") % 10).cast("string"), F.lit(".example.com/")).alias("url"), F.concat(F.lit("u"), (F.col("k") % 10).cast("string"), F.lit(".example.com")).alias("domain"),
        F.col("user_id").cast("string").alias("session_id"), "user_id", (F.col("event_id") % 20 + 1).cast("int").alias("position"), F.concat(F.lit("q"), (F.col("k") % 25).cast("string")).alias("query"),
        F.col("ts").alias("clicked_at"), F.floor(F.col("value") * 250).cast("long").alias("dwell_ms"),
    )


V_CLICKS = f"""v_clicks AS (
  SELECT event_id AS id, 'https://u' || (k % 10) || '.example.com/' AS url, 'u' || (k % 10) || '.example.com' AS domain, CAST(user_id AS VARCHAR) AS session_id, user_id,
         CAST(event_id % 20 + 1 AS INTEGER) AS position, 'q' || (k % 25) AS query, ts AS clicked_at, CAST(floor(value * 250) AS BIGINT) AS dwell_ms
  FROM (SELECT *, {K} AS k FROM events) WHERE event_type = 'click')"""


def v_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v_events(spark, sf_dir).where("event_type <> 'error'")
    return e.select(F.concat(F.lit("https://u"), (F.col("k") % 10).cast("string"), F.lit(".example.com/")).alias("url"), (F.col("event_id") % 20 + 1).cast("int").alias("position"), F.concat(F.lit("q"), (F.col("k") % 25).cast("string")).alias("query"), F.col("ts").alias("shown_at"))


V_IMPRESSIONS = f"""v_impressions AS (
  SELECT 'https://u' || (k % 10) || '.example.com/' AS url, CAST(event_id % 20 + 1 AS INTEGER) AS position, 'q' || (k % 25) AS query, ts AS shown_at
  FROM (SELECT *, {K} AS k FROM events) WHERE event_type <> 'error')"""


def v_vote_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("u"), (F.col("k") % 10).cast("string")).alias("url"), F.when(F.col("event_type") == "error", "down").otherwise("up").alias("vote_type"), F.col("ts").alias("created_at"))


V_VOTE_HISTORY = f"""v_vote_history AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS session_id, 'u' || (k % 10) AS url, CASE WHEN event_type = 'error' THEN 'down' ELSE 'up' END AS vote_type, ts AS created_at
  FROM (SELECT *, {K} AS k FROM events))"""


def v_user_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("event_type").isin("signup", "purchase"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return v_events(spark, sf_dir).where("event_type <> 'click'").select(
        F.col("event_id").alias("id"), "user_id", F.concat(F.lit("d"), (F.col("k") % 20).cast("string")).alias("domain"), sign.alias("value"),
        ((F.col("user_id") % 5) * 0.25).cast("double").alias("weight"), (F.col("user_id") % 7 != 0).alias("visible"), F.col("ts").alias("created_at"),
    )


V_USER_VOTES = f"""v_user_votes AS (
  SELECT event_id AS id, user_id, 'd' || (k % 20) AS domain, CASE WHEN event_type IN ('signup', 'purchase') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS value,
         CAST((user_id % 5) * 0.25 AS DOUBLE) AS weight, user_id % 7 <> 0 AS visible, ts AS created_at
  FROM (SELECT *, {K} AS k FROM events) WHERE event_type <> 'click')"""


def v_query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_events(spark, sf_dir).select(F.concat(F.lit("q"), (F.col("k") % 25).cast("string")).alias("query"), F.col("user_id").cast("string").alias("session_id"), "ts", (F.col("event_id") % 40).cast("int").alias("results"), F.floor("value").cast("int").alias("duration_ms"))


V_QUERY_LOG = f"""v_query_log AS (
  SELECT 'q' || (k % 25) AS query, CAST(user_id AS VARCHAR) AS session_id, ts, CAST(event_id % 40 AS INTEGER) AS results, CAST(floor(value) AS INTEGER) AS duration_ms
  FROM (SELECT *, {K} AS k FROM events))"""


def v_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_events(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").cast("string").alias("ip"), "ts", F.col("event_id").alias("id"))


V_VIOLATIONS = "v_violations AS (SELECT CAST(user_id AS VARCHAR) AS ip, ts, event_id AS id FROM events WHERE event_type = 'error')"


def v_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.concat(F.lit("https://o"), (F.col("l_orderkey") % 997).cast("string"), F.lit(".example.com/"), F.col("l_orderkey").cast("string")).alias("from_url"), F.concat(F.lit("https://p"), (F.col("l_partkey") % 97).cast("string"), F.lit(".example.com/"), F.col("l_partkey").cast("string")).alias("to_url"))


V_EDGES = """v_edges AS (
  SELECT 'https://o' || (l_orderkey % 997) || '.example.com/' || l_orderkey AS from_url, 'https://p' || (l_partkey % 97) || '.example.com/' || l_partkey AS to_url FROM lineitem)"""


def v_page_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = v_edges(spark, sf_dir).distinct()
    n = F.regexp_extract("from_url", r"/(\d+)$", 1).cast("long")
    return edges.groupBy(F.col("from_url").alias("url")).agg(F.count("*").alias("outgoing_links"), F.max(n).alias("n")).select("url", (F.col("n") % 101).cast("double").alias("trust_score"), "outgoing_links")


V_PAGE_TRUST = r"""v_page_trust AS (
  SELECT url, CAST(n % 101 AS DOUBLE) AS trust_score, outgoing_links
  FROM (SELECT from_url AS url, count(*) AS outgoing_links, max(CAST(regexp_extract(from_url, '/(\d+)$', 1) AS BIGINT)) AS n FROM (SELECT DISTINCT from_url, to_url FROM v_edges) GROUP BY 1))"""


def v_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    day = lambda n: F.to_timestamp(F.lit(AS_OF)) - F.make_dt_interval(days=n.cast("int"))
    return read(spark, sf_dir, "customer").select(
        k.alias("id"), (k * 7 % 101).cast("int").alias("trust_score"), (k % 3 != 0).alias("email_verified"), (k % 5 == 0).alias("phone_verified"), day(k % 120).alias("active_since"),
        day(k % 40).alias("last_active"), (k % 9).cast("int").alias("logins_week"), (k * 3 % 30).cast("int").alias("searches_week"), (k % 4 == 0).alias("bonus_30"), (k % 8 == 0).alias("bonus_90"),
        (k % 6 == 0).alias("bonus_email"), (k % 10 == 0).alias("bonus_phone"), day(k % 200).alias("created_at"), (k % 11 == 0).alias("suspicious_ip"),
    )


def _day(sql: str) -> str:
    return f"TIMESTAMP '{AS_OF}' - to_days(CAST({sql} AS INTEGER))"


V_USERS = f"""v_users AS (
  SELECT k AS id, CAST(k * 7 % 101 AS INTEGER) AS trust_score, k % 3 <> 0 AS email_verified, k % 5 = 0 AS phone_verified, {_day('k % 120')} AS active_since, {_day('k % 40')} AS last_active,
         CAST(k % 9 AS INTEGER) AS logins_week, CAST(k * 3 % 30 AS INTEGER) AS searches_week, k % 4 = 0 AS bonus_30, k % 8 = 0 AS bonus_90, k % 6 = 0 AS bonus_email, k % 10 = 0 AS bonus_phone,
         {_day('k % 200')} AS created_at, k % 11 = 0 AS suspicious_ip
  FROM (SELECT c_custkey AS k FROM customer))"""


def v_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("item").alias("kind"), F.col("source").alias("scope"), F.col("text").alias("body"))
    said = read(spark, sf_dir, "conversations").select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("id"), F.lit("comment").alias("kind"), F.col("conv_id").cast("string").alias("scope"), F.col("text").alias("body"))
    return docs.unionByName(said)


V_POSTS = """v_posts AS (
  SELECT doc_id AS id, 'item' AS kind, source AS scope, text AS body FROM documents
  UNION ALL SELECT -1 - conv_id * 1000 - turn, 'comment', CAST(conv_id AS VARCHAR), text FROM conversations)"""


def v_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 50).cast("int").alias("likes"), F.col("o_orderpriority").alias("category"), F.col("o_orderdate").alias("created_at"))


V_COLLECTIONS = "v_collections AS (SELECT o_orderkey AS id, o_custkey AS user_id, CAST(o_orderkey % 50 AS INTEGER) AS likes, o_orderpriority AS category, o_orderdate AS created_at FROM orders)"


def v_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("collection_id"), F.col("l_linenumber").alias("n"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("url"), F.when(F.col("l_linenumber") == 4, F.lit(None)).otherwise(F.col("l_linenumber") % 5 == 0).alias("hidden"))


V_ENTRIES = "v_entries AS (SELECT l_orderkey AS collection_id, l_linenumber AS n, 'p' || l_partkey AS url, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_linenumber % 5 = 0 END AS hidden FROM lineitem)"

#: Queries over the page table: words and pairs of words of its texts, and one without any hit.
QUERIES = [
    (1, "the"), (2, "that with"), (3, "les dans"), (4, "nicht sich"), (5, "para como"), (6, "from this the"), (7, "einen sind"), (8, "pour des"),
    (9, "license version"), (10, "kaufen preis"), (11, "was ist that"), (12, "zzqx nothing"),
]


def v_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id long, query string")


V_QUERIES = "v_queries AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{q}')" for i, q in QUERIES) + ") AS t(query_id, query))"


def v_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users said first in every conversation, as queries in lower case."""
    first = read(spark, sf_dir, "conversations").where("role = 'user' and text is not null").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    return first.select(F.col("conv_id").alias("query_id"), F.trim(F.regexp_replace(F.lower("query"), r"\s+", " ")).alias("query"))


V_ASKED = r"v_asked AS (SELECT conv_id AS query_id, trim(regexp_replace(lower(arg_min(text, turn)), '\s+', ' ', 'g')) AS query FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY 1)"

SQL = {name.lower(): value for name, value in list(globals().items()) if name.startswith("V_") and isinstance(value, str)}
#: Views that a view's SQL reads itself.
NEEDS = {"v_page_trust": ["v_edges"]}


def with_views(sql: str, *names: str) -> str:
    """sql with the views that it reads."""
    wanted = list(dict.fromkeys(x for n in names for x in [*NEEDS.get(n, []), n]))
    return "WITH " + ",\n".join(SQL[n] for n in wanted) + "\n" + sql
