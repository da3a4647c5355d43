"""Queries over clicks, impressions, query logs, votes and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.operators import behaviour as B
from pageloom.operators import links as L
from pageloom.operators import trends as T
from pageloom.operators import votes as V
from pageloom.sources import views as v
from pageloom.sources.views import AS_OF, with_views

NOW = f"TIMESTAMP '{AS_OF}'"
CTR = "CASE WHEN position BETWEEN 1 AND 10 THEN [0.285, 0.157, 0.110, 0.080, 0.063, 0.051, 0.040, 0.032, 0.028, 0.024][position] WHEN position BETWEEN 11 AND 20 THEN CAST(0.020 AS DOUBLE) + CAST(position - 11 AS DOUBLE) / 9 * (CAST(0.008 AS DOUBLE) - CAST(0.020 AS DOUBLE)) ELSE 0.005 END"
RATED = f"rated AS (SELECT *, dwell_ms < 8000 AS is_pogo, dwell_ms >= 45000 AS is_good, round(1 / CAST({CTR} AS DOUBLE), 6) AS w FROM v_clicks)"
QUALITY = f"""quality AS (
  SELECT url, domain, count(*) AS n_clicks, count(dwell_ms) AS n_timed, count(*) FILTER (WHERE is_pogo) AS n_pogo, count(*) FILTER (WHERE is_good) AS n_good,
         round(CAST(count(*) FILTER (WHERE is_pogo) AS DOUBLE) / count(dwell_ms), 4) AS pogo_rate, round(CAST(count(*) FILTER (WHERE is_good) AS DOUBLE) / count(dwell_ms), 4) AS good_rate,
         round(coalesce(sum(w) FILTER (WHERE is_pogo), 0) / sum(w), 4) AS weighted_pogo_rate, round(coalesce(sum(w) FILTER (WHERE is_good), 0) / sum(w), 4) AS weighted_good_rate
  FROM rated WHERE clicked_at >= {NOW} - INTERVAL 30 DAY GROUP BY url, domain)"""
DEVIATION = f"""deviation AS (
  SELECT url, n_impressions, CASE WHEN n_impressions >= 30 THEN round(CAST(coalesce(n, 0) AS DOUBLE) / n_impressions - expected, 4) END AS ctr_deviation
  FROM (SELECT url, count(*) AS n_impressions, avg(CAST({CTR} AS DOUBLE)) AS expected FROM v_impressions WHERE shown_at >= {NOW} - INTERVAL 7 DAY GROUP BY url)
  LEFT JOIN (SELECT url, count(*) AS n FROM v_clicks WHERE clicked_at >= {NOW} - INTERVAL 7 DAY GROUP BY url) USING (url))"""
CLICKS = with_views("", "v_clicks", "v_impressions").rstrip() + ",\n" + RATED + ",\n" + QUALITY + ",\n" + DEVIATION + "\n"


def click_quality(spark, d):
    return B.url_quality(B.rate_clicks(v.v_clicks(spark, d)), AS_OF)


def ctr_deviations(spark, d):
    return B.ctr_deviation(v.v_clicks(spark, d), v.v_impressions(spark, d), AS_OF)


def quality_bonuses(spark, d):
    return B.quality_bonus(click_quality(spark, d), ctr_deviations(spark, d))


def rated_clicks(spark, d):
    return B.rate_clicks(v.v_clicks(spark, d)).select("id", "is_pogo", "is_good", "quality", "position_weight")


def closed_clicks(spark, d):
    returns = v.v_events(spark, d).where("event_type = 'view'").select(F.col("user_id").cast("string").alias("session_id"), "ts", F.when(F.col("event_id") % 2 == 0, F.floor(F.col("value") * 100)).alias("dwell_ms"))
    return B.close_clicks(v.v_clicks(spark, d), returns).select("id", "dwell_ms", "returned_at")


def daily_rollup(spark, d):
    return T.rollup_daily(v.v_query_log(spark, d))


def weekly_rollup(spark, d):
    return T.rollup_weekly(v.v_query_log(spark, d))


def trend_scan(spark, d):
    log = v.v_query_log(spark, d)
    return T.scan_trends(log, T.rollup_daily(log), AS_OF, hours=48, least=5, length=2)


def hot_queries(spark, d):
    return T.hot_queries(v.v_query_log(spark, d), AS_OF, minutes=4320, least=3)


def query_dictionary(spark, d):
    return T.dictionary(v.v_query_log(spark, d), AS_OF)


def prefix_suggestions(spark, d):
    prefixes = v.v_query_log(spark, d).select(F.left("query", F.lit(2)).alias("prefix")).distinct()
    return T.prefix_suggestions(prefixes, query_dictionary(spark, d), AS_OF)


def related_searches(spark, d):
    return T.related_searches(v.v_query_log(spark, d), v.v_query_log(spark, d).select("query").distinct(), AS_OF)


def related_fallback(spark, d):
    return T.related_fallback(v.v_query_log(spark, d).select("query").distinct(), ["guide", "news", "compare", "buy"])


def top_searches(spark, d):
    return T.top_searches(v.v_query_log(spark, d))


def daily_trends(spark, d):
    return T.daily_trends(T.rollup_daily(v.v_query_log(spark, d)))


def top_queries(spark, d):
    return T.top_queries(query_dictionary(spark, d))


def trending_queries(spark, d):
    return T.trending(query_dictionary(spark, d))


def analytics_summary(spark, d):
    return T.analytics_summary(v.v_query_log(spark, d), AS_OF)


def peak_hour(spark, d):
    return T.peak_hour(v.v_query_log(spark, d))


def latency_stats(spark, d):
    return T.latency_stats(v.v_events(spark, d).select(F.col("event_type").alias("endpoint"), F.floor("value").cast("int").alias("duration_ms")))


def recent_searches(spark, d):
    return T.recent_searches(v.v_query_log(spark, d)).select("query", "session_id", "ts")


def weighted_votes(spark, d):
    return V.domain_votes_weighted(v.v_user_votes(spark, d))


def vote_weights(spark, d):
    return V.vote_weight(v.v_users(spark, d), AS_OF).select("id", "reason", "visible", "weight")


def trust_statuses(spark, d):
    return V.trust_status(v.v_users(spark, d), AS_OF)


def contrarian_voters(spark, d):
    votes = v.v_user_votes(spark, d)
    return V.contrarian_voters(votes, V.domain_votes_weighted(votes), AS_OF)


def user_trust(spark, d):
    activity = v.v_events(spark, d).where(F.to_date("ts") == F.lit("2024-01-29").cast("date")).groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "signup").alias("logins"), F.count_if(F.col("event_type") == "view").alias("searches"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "error").alias("reports")
    )
    return V.recompute_user_trust(v.v_users(spark, d), activity, contrarian_voters(spark, d), AS_OF)


def vote_bursts(spark, d):
    return V.vote_bursts(v.v_user_votes(spark, d)).select("id", "earlier", "rejected")


def accepted_votes(spark, d):
    return V.accept_votes(v.v_user_votes(spark, d), least=1, seconds=3600).select("id", "accepted")


def folded_votes(spark, d):
    return V.fold_votes(v.v_user_votes(spark, d))


def vote_consensus(spark, d):
    return V.consensus(v.v_user_votes(spark, d), AS_OF)


def evaluated_votes(spark, d):
    return V.evaluate_votes(v.v_user_votes(spark, d), v.v_users(spark, d), AS_OF)


def approvals(spark, d):
    return V.approval(v.v_domain_votes(spark, d))


def vote_leaderboard(spark, d):
    return V.vote_leaderboard(v.v_domain_votes(spark, d))


def vote_totals(spark, d):
    return V.vote_totals(v.v_domain_votes(spark, d))


def user_interests(spark, d):
    return V.user_interests(v.v_user_votes(spark, d), 20)


def ban_tiers(spark, d):
    return V.ban_tiers(v.v_violations(spark, d), (1, 2, 6)).select("id", "last_hour", "last_day", "so_far", "tier", "until")


def domain_authority(spark, d):
    return L.domain_authority(v.v_edges(spark, d))


def reciprocal_trust(spark, d):
    votes = v.v_page_trust(spark, d).select(L.host(F.col("url")).alias("domain")).distinct().withColumn("n", F.regexp_extract("domain", r"(\d+)", 1).cast("int")).select("domain", (F.col("n") % 30).alias("positive"), (F.col("n") % 17).alias("negative"))
    return L.reciprocal_trust(v.v_edges(spark, d), v.v_page_trust(spark, d), votes)


def journey_pairs(spark, d):
    return L.journey_pairs(v.v_vote_history(spark, d))


def journey_links(spark, d):
    return L.journey_links(v.v_vote_history(spark, d), least=2)


def next_steps(spark, d):
    return L.next_steps(L.journey_links(v.v_vote_history(spark, d), least=1)).select("source_url", "target_url", "strength", "rank")


def _log(sql: str) -> str:
    return with_views(sql, "v_query_log")


DICTIONARY = f"""dictionary AS (
  SELECT query, search_count, CAST(search_count AS DOUBLE) AS frequency, CAST(lately AS DOUBLE) AS trend_score, lately * 8 > search_count AS trending, CAST(CASE WHEN lately * 8 > search_count THEN 1.5 ELSE 1.0 END AS DOUBLE) AS multiplier, last_searched
  FROM (SELECT query, count(*) AS search_count, max(ts) AS last_searched, count(*) FILTER (WHERE ts >= {NOW} - INTERVAL 3 DAY) AS lately FROM v_query_log GROUP BY query))"""
DICT = with_views("", "v_query_log").rstrip() + ",\n" + DICTIONARY + "\n"
DAYS = f"date_diff('day', CAST(last_searched AS DATE), DATE '{AS_OF[:10]}')"

ACTIVE = f"""CASE WHEN NOT email_verified THEN 'email not verified' WHEN active_since IS NULL THEN 'no activity'
  WHEN (epoch({NOW}) - epoch(active_since)) / 86400 < 14 THEN 'too new' WHEN floor((epoch({NOW}) - epoch(last_active)) / 86400) > 14 THEN 'inactive too long'
  WHEN logins_week < 3 AND searches_week < 5 AND trust_score < 30 THEN 'too little this week' ELSE 'active' END"""
TIER = "CASE WHEN trust_score >= 81 THEN 1.0 WHEN trust_score >= 66 THEN 0.75 WHEN trust_score >= 51 THEN 0.5 WHEN trust_score >= 31 THEN 0.25 WHEN trust_score >= 15 THEN 0.1 ELSE 0.0 END"
WEIGHED = f"""weighed AS (
  SELECT *, CAST(CASE WHEN reason <> 'active' THEN 0 WHEN suspicious_ip THEN least(0.25, {TIER}) ELSE {TIER} END AS DOUBLE) AS weight, reason = 'active' AS visible
  FROM (SELECT *, {ACTIVE} AS reason FROM v_users))"""
USERS = with_views("", "v_users", "v_user_votes").rstrip() + ",\n" + WEIGHED
COMMUNITY = "community AS (SELECT domain, round(sum(value * weight) / nullif(sum(weight), 0), 4) AS community_score FROM v_user_votes WHERE visible GROUP BY domain)"
CONTRARIAN = f"""contrarian AS (
  SELECT user_id, count(*) AS n_votes, round(avg(CASE WHEN value <> sign(community_score) THEN 1 ELSE 0 END), 4) AS against
  FROM v_user_votes JOIN community USING (domain) WHERE created_at >= {NOW} - INTERVAL 30 DAY GROUP BY user_id HAVING count(*) >= 10 AND round(avg(CASE WHEN value <> sign(community_score) THEN 1 ELSE 0 END), 4) > 0.8)"""
CONSENSUS = f"""agreed AS (SELECT domain, count(*) AS n_visible, min(created_at) AS oldest, count(*) >= 20 AND min(created_at) <= {NOW} - INTERVAL 48 HOUR AS has_consensus FROM v_user_votes WHERE visible GROUP BY domain)"""
BURSTS = "bursts AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(created_at)) AS BIGINT) RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) - 1 AS earlier FROM v_user_votes)"
ACCEPTED = """numbered AS (SELECT *, CAST(floor(epoch(created_at)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(created_at)) AS BIGINT), id) AS i FROM v_user_votes),
took AS (SELECT id, user_id, domain, value, i, [t] AS kept, true AS accepted FROM numbered WHERE i = 1
  UNION ALL SELECT n.id, n.user_id, n.domain, n.value, n.i,
    CASE WHEN len(list_filter(o.kept, lambda x: x >= n.t - 600)) < 5 THEN list_append(list_filter(o.kept, lambda x: x >= n.t - 600), n.t) ELSE list_filter(o.kept, lambda x: x >= n.t - 600) END,
    len(list_filter(o.kept, lambda x: x >= n.t - 600)) < 5 FROM took o JOIN numbered n ON n.user_id = o.user_id AND n.i = o.i + 1)"""
PAIRS = """pairs AS (SELECT a.session_id, a.url AS source_url, b.url AS target_url, a.created_at AS at, b.created_at AS "then"
  FROM v_vote_history a JOIN v_vote_history b ON a.session_id = b.session_id AND a.vote_type = 'up' AND b.vote_type = 'up' AND a.created_at < b.created_at AND b.created_at - a.created_at < INTERVAL 60 MINUTE AND a.url <> b.url)"""
JOURNEYS = with_views("", "v_vote_history").rstrip() + ",\n" + PAIRS + "\n"
HOST = r"nullif(regexp_replace(lower(regexp_extract({}, '(?i)^https?://([^/?#:]+)', 1)), '^www\.', ''), '')"

QUERIES = {
    "click_quality": (click_quality, CLICKS + "SELECT * FROM quality"),
    "ctr_deviations": (ctr_deviations, CLICKS + "SELECT * FROM deviation"),
    "quality_bonuses": (quality_bonuses, CLICKS + """SELECT url, domain, CASE WHEN n_timed < 10 THEN 0 WHEN weighted_pogo_rate > 0.65 THEN -5 WHEN weighted_pogo_rate > 0.45 THEN -3 WHEN weighted_pogo_rate > 0.30 THEN -1
        WHEN n_clicks >= 15 AND weighted_good_rate > 0.75 THEN 3 WHEN weighted_good_rate > 0.6 THEN 2 WHEN weighted_good_rate > 0.45 THEN 1 ELSE 0 END
        + CASE WHEN ctr_deviation > 0.1 THEN 2 WHEN ctr_deviation > 0.05 THEN 1 WHEN ctr_deviation < -0.1 THEN -2 WHEN ctr_deviation < -0.05 THEN -1 ELSE 0 END AS bonus FROM quality LEFT JOIN deviation USING (url)"""),
    "rated_clicks": (rated_clicks, CLICKS + "SELECT id, is_pogo, is_good, CASE WHEN is_pogo THEN 'pogo' WHEN is_good THEN 'good' ELSE 'neutral' END AS quality, w AS position_weight FROM rated"),
    "closed_clicks": (closed_clicks, with_views("", "v_clicks").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + """,
      happened AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, kind, id NULLS FIRST, own NULLS FIRST) AS i FROM (
        SELECT session_id, clicked_at AS ts, 0 AS kind, id, CAST(NULL AS BIGINT) AS own FROM v_clicks
        UNION ALL SELECT CAST(user_id AS VARCHAR), ts, 1, NULL, CASE WHEN event_id % 2 = 0 THEN CAST(floor(value * 100) AS BIGINT) END FROM events WHERE event_type = 'view')),
      walk AS (SELECT session_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id BIGINT, ts TIMESTAMP)[]) AS open, CAST(NULL AS BIGINT) AS hit, CAST(NULL AS BIGINT) AS dwell_ms, CAST(NULL AS TIMESTAMP) AS returned_at FROM happened WHERE i = 1
        UNION ALL SELECT session_id, i, CASE WHEN kind = 0 THEN list_append(open, {'id': id, 'ts': ts}) WHEN ms <= 1800000 THEN open[1:len(open) - 1] ELSE open END,
          CASE WHEN ms <= 1800000 THEN open[len(open)].id END, CASE WHEN ms <= 1800000 THEN coalesce(own, ms) END, ts
        FROM (SELECT e.*, w.open, CASE WHEN kind = 1 AND len(w.open) > 0 THEN CAST(epoch_us(e.ts) // 1000 - epoch_us(w.open[len(w.open)].ts) // 1000 AS BIGINT) END AS ms FROM walk w JOIN happened e ON e.session_id = w.session_id AND e.i = w.i + 1))
      SELECT c.id, w.dwell_ms, w.returned_at FROM v_clicks c LEFT JOIN walk w ON w.hit = c.id"""),
    "daily_rollup": (daily_rollup, _log("SELECT query, CAST(ts AS DATE) AS search_date, count(*) AS daily_count FROM v_query_log GROUP BY 1, 2")),
    "weekly_rollup": (weekly_rollup, _log("""SELECT query, week_start, weekly_total, round(weekly_total / CAST(7 AS DOUBLE), 4) AS avg_daily_count, CASE WHEN weekly_total > last THEN 'up' WHEN weekly_total < last THEN 'down' ELSE 'stable' END AS trend_direction
        FROM (SELECT *, lag(weekly_total) OVER (PARTITION BY query ORDER BY week_start) AS last FROM (SELECT query, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS weekly_total FROM v_query_log GROUP BY 1, 2))""")),
    "trend_scan": (trend_scan, _log(f"""SELECT query, n_recent, round(expected, 4) AS expected, factor, CAST(CASE WHEN factor >= 20 AND n_recent >= 30 THEN 3.0 WHEN factor >= 8 THEN 2.0 WHEN factor >= 3 THEN 1.5 ELSE 1.0 END AS DOUBLE) AS multiplier, CAST(least(100, floor(factor * 3 + 0.5)) AS BIGINT) AS score
        FROM (SELECT query, n_recent, expected, round(n_recent / expected, 2) AS factor FROM (SELECT query, n_recent, coalesce(mean_day / CAST(24 AS DOUBLE) * 48, CAST(1 AS DOUBLE)) AS expected
          FROM (SELECT query, count(*) AS n_recent FROM v_query_log WHERE ts >= {NOW} - INTERVAL 48 HOUR AND ts <= {NOW} AND length(query) >= 2 GROUP BY query HAVING count(*) >= 5)
          LEFT JOIN (SELECT query, avg(n) AS mean_day FROM (SELECT query, CAST(ts AS DATE) AS day, count(*) AS n FROM v_query_log GROUP BY 1, 2) WHERE day >= DATE '{AS_OF[:10]}' - 14 AND day < DATE '{AS_OF[:10]}' GROUP BY query) USING (query)))""")),
    "hot_queries": (hot_queries, _log(f"SELECT query, count(*) AS n, max(ts) AS last_seen FROM v_query_log WHERE ts >= {NOW} - INTERVAL 4320 MINUTE AND ts <= {NOW} GROUP BY query HAVING count(*) >= 3 ORDER BY n DESC, query LIMIT 100")),
    "query_dictionary": (query_dictionary, DICT + "SELECT * FROM dictionary"),
    "prefix_suggestions": (prefix_suggestions, DICT + f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY prefix ORDER BY score DESC, query) AS INT) AS rank FROM (
        SELECT prefix, query, round(frequency * multiplier + CAST(0.3 AS DOUBLE) * trend_score + CASE WHEN {DAYS} <= 1 THEN 20 WHEN {DAYS} <= 7 THEN 10 WHEN {DAYS} <= 30 THEN 5 ELSE 0 END + CASE WHEN trending THEN 50 ELSE 0 END, 4) AS score
        FROM (SELECT DISTINCT left(query, 2) AS prefix FROM v_query_log) JOIN dictionary ON starts_with(query, prefix))) WHERE rank <= 8"""),
    "related_searches": (related_searches, with_views("", "v_query_log").rstrip() + f""",
      recent AS (SELECT session_id, query FROM v_query_log WHERE ts >= {NOW} - INTERVAL 30 DAY), asked AS (SELECT DISTINCT query FROM v_query_log), held AS (SELECT DISTINCT a.query, session_id FROM asked a JOIN recent r ON contains(r.query, a.query))
      SELECT query, related, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, related) AS rank FROM (
        SELECT a.query, r.query AS related, count(*) AS n FROM asked a JOIN recent r ON a.query <> r.query LEFT JOIN held h ON h.query = a.query AND h.session_id = r.session_id
        WHERE length(r.query) BETWEEN 3 AND 60 AND (h.query IS NOT NULL OR contains(r.query, string_split(a.query, ' ')[1]) OR contains(r.query, string_split(a.query, ' ')[-1])) GROUP BY 1, 2)) WHERE rank <= 6"""),
    "related_fallback": (related_fallback, _log("SELECT query, query || ' ' || m AS related, CAST(row_number() OVER (PARTITION BY query ORDER BY i) AS INT) AS rank FROM (SELECT DISTINCT query FROM v_query_log), (VALUES (0, 'guide'), (1, 'news'), (2, 'compare'), (3, 'buy')) AS t(i, m) WHERE NOT contains(query, m)")),
    "top_searches": (top_searches, _log("SELECT query, count(*) AS n, round(avg(duration_ms), 2) AS mean_ms, round(avg(results), 2) AS mean_results, max(ts) AS last_search FROM v_query_log GROUP BY query ORDER BY n DESC, query LIMIT 20")),
    "daily_trends": (daily_trends, _log("SELECT search_date, CAST(sum(n) AS BIGINT) AS searches, count(DISTINCT query) AS n_queries, round(avg(n), 4) AS mean_count FROM (SELECT query, CAST(ts AS DATE) AS search_date, count(*) AS n FROM v_query_log GROUP BY 1, 2) GROUP BY search_date")),
    "top_queries": (top_queries, DICT + "SELECT query, frequency, CAST(row_number() OVER (ORDER BY frequency DESC, query) AS INT) AS rank, CASE WHEN trending THEN 'trending' WHEN frequency >= 100 THEN 'popular' ELSE 'known' END AS label FROM dictionary ORDER BY frequency DESC, query LIMIT 10"),
    "trending_queries": (trending_queries, DICT + "SELECT query, multiplier, trend_score, frequency FROM dictionary WHERE trending ORDER BY multiplier DESC, trend_score DESC, frequency DESC, query LIMIT 10"),
    "analytics_summary": (analytics_summary, _log(f"SELECT count(*) FILTER (WHERE ts >= {NOW} - INTERVAL 1 DAY) AS n_24h, count(*) FILTER (WHERE ts >= {NOW} - INTERVAL 7 DAY) AS n_7d, count(*) AS n_all, round(avg(duration_ms) FILTER (WHERE ts >= {NOW} - INTERVAL 1 DAY), 2) AS mean_ms_24h, round(avg(duration_ms), 2) AS mean_ms, round(avg(results), 2) AS mean_results FROM v_query_log")),
    "peak_hour": (peak_hour, _log("SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM v_query_log GROUP BY 1 ORDER BY n DESC, hour LIMIT 1")),
    "latency_stats": (latency_stats, "SELECT event_type AS endpoint, count(*) AS n, round(avg(floor(value)), 4) AS mean_ms, CAST(min(floor(value)) AS INT) AS min_ms, CAST(max(floor(value)) AS INT) AS max_ms FROM events GROUP BY 1"),
    "recent_searches": (recent_searches, _log("SELECT query, session_id, ts FROM v_query_log ORDER BY ts DESC, query, session_id LIMIT 20")),
    "weighted_votes": (weighted_votes, with_views("""SELECT domain, coalesce(sum(weight) FILTER (WHERE value = 1), 0) AS positive_weight, coalesce(sum(weight) FILTER (WHERE value = 0), 0) AS neutral_weight, coalesce(sum(weight) FILTER (WHERE value = -1), 0) AS negative_weight,
        count(*) AS visible_votes, round(sum(value * weight) / nullif(sum(weight), 0), 4) AS community_score FROM v_user_votes WHERE visible GROUP BY domain""", "v_user_votes")),
    "vote_weights": (vote_weights, USERS + " SELECT id, reason, visible, weight FROM weighed"),
    "trust_statuses": (trust_statuses, USERS + f""" SELECT id, CASE WHEN NOT email_verified THEN 'verify email' WHEN NOT visible THEN 'stay active' WHEN trust_score >= 81 THEN 'full member' WHEN trust_score >= 66 THEN 'trusted' WHEN trust_score >= 51 THEN 'established' WHEN trust_score >= 31 THEN 'growing' ELSE 'building up' END AS status,
        CAST(CASE WHEN NOT email_verified THEN 5 WHEN NOT visible THEN least(95, floor(floor((epoch({NOW}) - epoch(active_since)) / 86400) / 14 * 100 + 0.5)) WHEN trust_score >= 81 THEN 100 WHEN trust_score >= 66 THEN 80 WHEN trust_score >= 51 THEN 60 WHEN trust_score >= 31 THEN 35 ELSE 15 END AS BIGINT) AS progress FROM weighed"""),
    "contrarian_voters": (contrarian_voters, USERS + ",\n" + COMMUNITY + ",\n" + CONTRARIAN + " SELECT * FROM contrarian"),
    "user_trust": (user_trust, USERS + ",\n" + COMMUNITY + ",\n" + CONTRARIAN + f""", a AS (
        SELECT user_id AS id, count(*) FILTER (WHERE event_type = 'signup') AS logins, count(*) FILTER (WHERE event_type = 'view') AS searches, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error') AS reports
        FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-29' GROUP BY 1),
      n AS (SELECT u.* EXCLUDE (trust_score, bonus_30, bonus_90, bonus_email, bonus_phone), age >= 30 AND NOT bonus_30 AS e30, age >= 90 AND NOT bonus_90 AS e90, email_verified AND NOT bonus_email AS ee, phone_verified AND NOT bonus_phone AS ep, bonus_30, bonus_90, bonus_email, bonus_phone, logins, searches, clicks, reports, c.user_id IS NOT NULL AS contra, trust_score AS old
        FROM (SELECT *, (epoch({NOW}) - epoch(created_at)) / 86400 AS age, (epoch({NOW}) - epoch(last_active)) / 86400 AS idle FROM v_users) u LEFT JOIN a USING (id) LEFT JOIN contrarian c ON c.user_id = u.id),
      s AS (SELECT *, CAST(greatest(0, least(100, old + CASE WHEN logins > 0 THEN 1 ELSE 0 END + CASE WHEN searches > 0 THEN 2 ELSE 0 END + CASE WHEN clicks > 0 THEN 1 ELSE 0 END + CASE WHEN e30 THEN 10 ELSE 0 END + CASE WHEN e90 THEN 20 ELSE 0 END + CASE WHEN ee THEN 10 ELSE 0 END + CASE WHEN ep THEN 5 ELSE 0 END
        - CASE WHEN contra THEN 2 ELSE 0 END - CASE WHEN reports > 3 THEN 3 ELSE 0 END - CASE WHEN idle > 7 THEN floor(idle / 7) * 2 ELSE 0 END)) AS INT) AS trust_score FROM n)
      SELECT id, trust_score, CAST(CASE WHEN reason <> 'active' THEN 0 WHEN suspicious_ip THEN least(0.25, {TIER}) ELSE {TIER} END AS DOUBLE) AS weight, reason = 'active' AS visible, bonus_30 OR e30 AS bonus_30, bonus_90 OR e90 AS bonus_90, bonus_email OR ee AS bonus_email, bonus_phone OR ep AS bonus_phone
      FROM (SELECT *, {ACTIVE} AS reason FROM s)"""),
    "vote_bursts": (vote_bursts, with_views("", "v_user_votes").rstrip() + ",\n" + BURSTS + " SELECT id, earlier, earlier >= 5 AS rejected FROM bursts"),
    "accepted_votes": (accepted_votes, with_views("", "v_user_votes").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + ACCEPTED.replace("600", "3600").replace("< 5", "< 1") + " SELECT id, accepted FROM took"),
    "folded_votes": (folded_votes, with_views("", "v_user_votes").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + """, seq AS (SELECT *, row_number() OVER (PARTITION BY user_id, domain ORDER BY created_at, id) AS i, count(*) OVER (PARTITION BY user_id, domain) AS n FROM v_user_votes),
      state AS (SELECT user_id, domain, i, n, value AS v FROM seq WHERE i = 1 UNION ALL SELECT s.user_id, s.domain, s.i, s.n, CASE WHEN o.v = s.value THEN NULL ELSE s.value END FROM state o JOIN seq s ON s.user_id = o.user_id AND s.domain = o.domain AND s.i = o.i + 1)
      SELECT domain, count(*) FILTER (WHERE v = 1) AS positive, count(*) FILTER (WHERE v = 0) AS neutral, count(*) FILTER (WHERE v = -1) AS negative FROM state WHERE i = n GROUP BY domain"""),
    "vote_consensus": (vote_consensus, with_views("", "v_user_votes").rstrip() + ",\n" + CONSENSUS + " SELECT * FROM agreed"),
    "evaluated_votes": (evaluated_votes, USERS.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + ACCEPTED + ",\n" + CONSENSUS + """ SELECT b.id, b.user_id, b.domain, b.value, CASE WHEN NOT accepted THEN 'rejected' WHEN w.visible THEN 'counted' ELSE 'hidden' END AS verdict,
        CASE WHEN NOT accepted THEN 0 ELSE coalesce(w.weight, 0) END AS vote_weight, coalesce(has_consensus, false) AS has_consensus FROM took b LEFT JOIN weighed w ON w.id = b.user_id LEFT JOIN agreed USING (domain)"""),
    "approvals": (approvals, with_views("SELECT domain, CASE WHEN positive + negative > 0 THEN CAST(floor(CAST(positive AS DOUBLE) / (positive + negative) * 100 + 0.5) AS BIGINT) END AS approval FROM v_domain_votes", "v_domain_votes")),
    "vote_leaderboard": (vote_leaderboard, with_views("SELECT domain, positive, neutral, negative, positive + neutral + negative AS total FROM v_domain_votes ORDER BY total DESC, domain LIMIT 500", "v_domain_votes")),
    "vote_totals": (vote_totals, with_views("SELECT count(*) AS n_domains, CAST(sum(positive) AS BIGINT) AS positive, CAST(sum(neutral) AS BIGINT) AS neutral, CAST(sum(negative) AS BIGINT) AS negative FROM v_domain_votes", "v_domain_votes")),
    "user_interests": (user_interests, with_views("SELECT user_id, domain, count(*) AS times FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS i FROM v_user_votes WHERE value = 1) WHERE i <= 20 GROUP BY 1, 2", "v_user_votes")),
    "ban_tiers": (ban_tiers, with_views("""SELECT id, last_hour, last_day, so_far, tier, CASE tier WHEN 3 THEN ts + INTERVAL 168 HOUR WHEN 2 THEN ts + INTERVAL 24 HOUR WHEN 1 THEN ts + INTERVAL 1 HOUR END AS until FROM (SELECT *, CASE WHEN so_far >= 6 THEN 3 WHEN last_day >= 2 THEN 2 WHEN last_hour >= 1 THEN 1 ELSE 0 END AS tier FROM (
        SELECT *, count(*) OVER (PARTITION BY ip ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_hour, count(*) OVER (PARTITION BY ip ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS last_day, count(*) OVER (PARTITION BY ip ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS so_far FROM v_violations))""", "v_violations")),
    "domain_authority": (domain_authority, with_views(f"SELECT domain, count(*) AS inbound, CAST(least(10, floor(round(log10(count(*) + 1) * CAST(4.3 AS DOUBLE), 6) + 0.5)) AS BIGINT) AS bonus FROM (SELECT DISTINCT from_url, {HOST.format('to_url')} AS domain FROM v_edges WHERE {HOST.format('from_url')} <> {HOST.format('to_url')}) GROUP BY domain", "v_edges")),
    "reciprocal_trust": (reciprocal_trust, with_views("", "v_edges", "v_page_trust").rstrip() + r""", x AS (SELECT from_url, to_url, CAST(regexp_extract(from_url, 'https://o(\d+)', 1) AS INT) AS n FROM (SELECT DISTINCT from_url, to_url FROM v_edges)),
        y AS (SELECT *, n % 30 AS pos, n % 17 AS neg, n % 30 + n % 17 AS total FROM x)
        SELECT to_url AS url, count(*) AS n_backlinks, round(least(CAST(15 AS DOUBLE), ln(1 + sum(trust_score / greatest(1, outgoing_links) * CAST(0.85 AS DOUBLE) * CAST(CASE WHEN total < 5 THEN 1.0 WHEN CAST(pos AS DOUBLE) / total >= 0.8 AND total >= 20 THEN 1.2 WHEN CAST(pos AS DOUBLE) / total >= 0.65 THEN 1.1 WHEN CAST(pos AS DOUBLE) / total < 0.35 AND total >= 10 THEN 0.8 WHEN CAST(pos AS DOUBLE) / total < 0.5 THEN 0.9 ELSE 1.0 END AS DOUBLE))) * 5), 4) AS score
        FROM y JOIN v_page_trust ON url = from_url GROUP BY to_url"""),
    "journey_pairs": (journey_pairs, JOURNEYS + "SELECT * FROM pairs"),
    "journey_links": (journey_links, JOURNEYS + "SELECT source_url, target_url, strength, round(strength * CAST(100 AS DOUBLE) / n, 4) AS confidence FROM (SELECT source_url, target_url, count(*) AS strength FROM pairs GROUP BY 1, 2 HAVING count(*) >= 2) JOIN (SELECT url AS source_url, count(*) AS n FROM v_vote_history WHERE vote_type = 'up' GROUP BY 1) USING (source_url)"),
    "next_steps": (next_steps, JOURNEYS + "SELECT * FROM (SELECT source_url, target_url, strength, CAST(row_number() OVER (PARTITION BY source_url ORDER BY strength DESC, target_url) AS INT) AS rank FROM (SELECT source_url, target_url, count(*) AS strength FROM pairs GROUP BY 1, 2)) WHERE rank <= 3"),
}
