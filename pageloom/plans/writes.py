"""Queries that write tables and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from pageloom.functions.tables import gone_at_exit, shared_dir
from pageloom.operators import behaviour as B
from pageloom.operators import lists as L
from pageloom.operators import page_scores as P
from pageloom.plans import pages as G
from pageloom.sources import sinks
from pageloom.sources import views as v
from pageloom.sources.views import AS_OF, with_views

HALF = "2024-01-15 00:00:00"
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def loud(c: str):
    """A text with its ASCII letters in upper case."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def place(spark, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    gone_at_exit(spark, path)
    return path


def appended_clicks(spark, d):
    """Raw clicks as JSON, read, cleaned and appended in two batches."""
    c = v.v_clicks(spark, d)
    raw = c.select(F.to_json(F.struct(F.when(F.col("id") % 11 > 0, F.col("url")).alias("url"), "session_id", (F.col("position") - 3).alias("position"), "query", F.col("clicked_at").alias("ts")), MICROS).alias("body"), F.col("clicked_at").alias("at"))
    parsed = raw.select(F.from_json("body", "url string, session_id string, position int, query string, ts timestamp", MICROS).alias("b"), "at").select("b.*", "at")
    path = place(spark, "clicks")
    for batch in (parsed.where(F.col("at") < HALF), parsed.where(F.col("at") >= HALF)):
        sinks.append(B.ingest_clicks(batch), path)
    return spark.read.parquet(path).groupBy("domain", "position").agg(F.count("*").alias("n"), F.min("clicked_at").alias("oldest"))


def shown_impressions(spark, d):
    """What each query of the log showed most clicked, appended as impressions of its first ten."""
    clicked = v.v_clicks(spark, d).groupBy("query", "url").agg(F.count("*").alias("n"))
    ranked = clicked.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "url")))
    path = place(spark, "impressions")
    sinks.append(B.impressions_from_ranking(ranked, AS_OF), path)
    return spark.read.parquet(path)


def vote_history(spark, d):
    votes = v.v_vote_history(spark, d)
    raw = votes.select("session_id", F.when(F.col("id") % 13 > 0, F.col("url")).alias("url"), F.when(F.col("id") % 9 == 0, "maybe").otherwise(F.col("vote_type")).alias("vote_type"), F.col("created_at").alias("ts"))
    path = place(spark, "votes")
    sinks.append(sinks.ingest_votes(raw), path)
    return spark.read.parquet(path).groupBy("url", "vote_type").agg(F.count("*").alias("n"), F.max("created_at").alias("newest"))


def published_counts(spark, d):
    """Counts of the month's first half published, then brought up to date by the queries of the second half."""
    log = v.v_query_log(spark, d)
    counts = lambda rows: rows.groupBy("query").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))
    path = place(spark, "counts")
    sinks.publish(counts(log.where((F.col("ts") < HALF) & F.col("query").rlike("[0-6]$"))), path)
    new = counts(log.where((F.col("ts") >= HALF) & F.col("query").rlike("[3-9]$")))
    sinks.publish(sinks.upsert(sinks.newest(spark, path), new, ["query"]), path)
    return sinks.newest(spark, path)


def dated_counts(spark, d):
    """Events of each user and day but for errors; then days with errors are merged anew with all events of the users that have some, and all but the last ten days go."""
    events = v.v_events(spark, d).withColumn("day", F.to_date("ts"))
    counts = lambda rows: rows.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    path = place(spark, "days")
    sinks.write_days(counts(events.where("event_type <> 'error'")), path)
    failed = events.where("event_type = 'error'").select("user_id", "day").distinct()
    sinks.merge_days(counts(events.join(failed, ["user_id", "day"], "left_semi")), path, ["user_id"])
    sinks.expire_days(spark, path, AS_OF, 10)
    return spark.read.parquet(path)


def exported_events(spark, d):
    path = place(spark, "export")
    sinks.export_events(v.read(spark, d, "events").select("event_id", "event_type", "user_id", "value"), path)
    back = spark.read.schema("event_id long, user_id long, value double, event_type string").json(path)
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"), F.countDistinct("user_id").alias("n_users"))


def new_answers(spark, d):
    """What assistants answered, asked again in other letters; questions of every third conversation are known."""
    said = v.read(spark, d, "conversations").where("role = 'assistant' and text is not null").groupBy("conv_id").agg(F.min_by("text", "turn").alias("answer"))
    rows = v.v_asked(spark, d).join(said, F.col("query_id") == F.col("conv_id")).select(F.col("query").alias("question"), "answer", "conv_id")
    raw = rows.select(F.explode(F.array(F.struct("question", F.col("conv_id").alias("id")), F.struct(loud("question").alias("question"), (F.col("conv_id") + 1_000_000_000).alias("id")))).alias("q"), "answer").select("q.*", F.concat("answer", F.repeat("answer", F.lit(20))).alias("answer"), F.lit("assistant").alias("source"), F.to_timestamp(F.lit(AS_OF)).alias("ts"))
    path = place(spark, "answers")
    sinks.append(sinks.ingest_answers(raw, rows.where("conv_id % 3 = 0").select(loud("question").alias("question"))), path)
    return spark.read.parquet(path).select(F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"), F.length("answer").alias("size"))


def enriched_pages(spark, d):
    pages = v.v_pages(spark, d)
    paywalls = L.paywall_domains(pages.where("has_paywall").select("url", "domain", F.col("page_id").alias("reporter_id")))
    trust = P.score_trust(pages.where("secure")).groupBy("domain").agg(F.round(F.avg("trust_score"), 4).alias("trust"))
    return sinks.enrich_domains(pages.select("page_id", "domain"), v.v_domain_votes(spark, d), paywalls, trust)


ANSWERED = """rows AS (SELECT query_id AS conv_id, query AS question, answer FROM v_asked JOIN (SELECT conv_id AS query_id, arg_min(text, turn) AS answer FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY 1) USING (query_id))"""
QUERIES = {
    "appended_clicks": (appended_clicks, with_views("SELECT domain, CAST(greatest(0, position - 3) AS INT) AS position, count(*) AS n, min(clicked_at) AS oldest FROM v_clicks WHERE id % 11 > 0 GROUP BY 1, 2", "v_clicks")),
    "shown_impressions": (shown_impressions, with_views(f"SELECT url, CAST(rank AS INT) AS position, query, TIMESTAMP '{AS_OF}' AS shown_at FROM (SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, url) AS rank FROM v_clicks GROUP BY 1, 2) WHERE rank <= 10", "v_clicks")),
    "vote_history": (vote_history, with_views("SELECT url, vote_type, count(*) AS n, max(created_at) AS newest FROM v_vote_history WHERE id % 13 > 0 AND id % 9 > 0 GROUP BY 1, 2", "v_vote_history")),
    "published_counts": (published_counts, with_views(f"""SELECT query, n, newest FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY new DESC) AS i FROM (SELECT query, ts >= TIMESTAMP '{HALF}' AS new, count(*) AS n, max(ts) AS newest FROM v_query_log
      WHERE CASE WHEN ts >= TIMESTAMP '{HALF}' THEN regexp_matches(query, '[3-9]$') ELSE regexp_matches(query, '[0-6]$') END GROUP BY 1, 2)) WHERE i = 1""", "v_query_log")),
    "dated_counts": (dated_counts, f"SELECT user_id, n, value, day FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2) WHERE day >= DATE '{AS_OF[:10]}' - 10"),
    "exported_events": (exported_events, "SELECT event_type, count(*) AS n, round(sum(value), 2) AS value, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1"),
    "new_answers": (new_answers, with_views("", "v_asked").rstrip() + ",\n" + ANSWERED + """, cut AS (SELECT conv_id, left(trim(question), 500) AS q, left(trim(answer || repeat(answer, 20)), 5000) AS a FROM rows)
      SELECT md5(q) AS question_md5, md5(a) AS answer_md5, CAST(length(a) AS INT) AS size FROM (SELECT *, row_number() OVER (PARTITION BY lower(q) ORDER BY conv_id) AS i FROM cut WHERE lower(q) NOT IN (SELECT question FROM rows WHERE conv_id % 3 = 0)) WHERE i = 1"""),
    "enriched_pages": (enriched_pages, with_views("", "v_pages", "v_domain_votes").rstrip() + ",\n" + G.TRUST + """ SELECT page_id, domain, coalesce(positive, 0) AS positive, coalesce(neutral, 0) AS neutral, coalesce(negative, 0) AS negative, coalesce(n_reports, 0) AS n_reports, known_trust FROM v_pages
      LEFT JOIN v_domain_votes USING (domain) LEFT JOIN (SELECT domain, count(DISTINCT (url, page_id)) AS n_reports FROM v_pages WHERE has_paywall GROUP BY 1) USING (domain) LEFT JOIN (SELECT domain, round(avg(CAST(trust_score AS DOUBLE)), 4) AS known_trust FROM trust WHERE secure GROUP BY 1) USING (domain)"""),
}
