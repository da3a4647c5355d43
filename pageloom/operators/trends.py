"""Query logs: rollups, trends, hot queries, suggestions and related searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.columns import half_up

WINDOW_HOURS, HISTORY_DAYS, MIN_SEARCHES, STRONG_SEARCHES, MIN_LENGTH = 2, 14, 15, 30, 4


def rollup_daily(log: DataFrame) -> DataFrame:
    return log.groupBy("query", F.to_date("ts").alias("search_date")).agg(F.count("*").alias("daily_count"))


def rollup_weekly(log: DataFrame) -> DataFrame:
    """(query, week_start, weekly_total, avg_daily_count, trend_direction): the direction compares a week with the query's week before."""
    weeks = log.groupBy("query", F.to_date(F.date_trunc("week", "ts")).alias("week_start")).agg(F.count("*").alias("weekly_total"))
    last = F.lag("weekly_total").over(Window.partitionBy("query").orderBy("week_start"))
    direction = F.when(F.col("weekly_total") > last, "up").when(F.col("weekly_total") < last, "down").otherwise("stable")
    return weeks.select("query", "week_start", "weekly_total", F.round(F.col("weekly_total") / 7.0, 4).alias("avg_daily_count"), direction.alias("trend_direction"))


def scan_trends(log: DataFrame, daily: DataFrame, as_of: str, hours: int = WINDOW_HOURS, least: int = MIN_SEARCHES, length: int = MIN_LENGTH) -> DataFrame:
    """(query, n_recent, expected, factor, multiplier, score) of queries with enough searches in the last hours. The expected number is the mean day of the last 14 days, brought to the window; 1 without history. Each side is counted before the join, so days don't multiply searches."""
    now = F.to_timestamp(F.lit(as_of))
    recent = log.where((F.col("ts") >= now - F.expr(f"interval {hours} hours")) & (F.col("ts") <= now) & (F.length("query") >= length)).groupBy("query").agg(F.count("*").alias("n_recent")).where(F.col("n_recent") >= least)
    day = F.to_date(now)
    past = daily.where((F.col("search_date") >= F.date_sub(day, HISTORY_DAYS)) & (F.col("search_date") < day)).groupBy("query").agg(F.avg("daily_count").alias("mean_day"))
    expected = F.coalesce(F.col("mean_day") / 24.0 * hours, F.lit(1.0))
    factor = F.round(F.coalesce(F.try_divide(F.col("n_recent"), expected), F.lit(0.0)), 2)
    multiplier = F.when((F.col("factor") >= 20) & (F.col("n_recent") >= STRONG_SEARCHES), 3.0).when(F.col("factor") >= 8, 2.0).when(F.col("factor") >= 3, 1.5).otherwise(1.0)
    joined = recent.join(past, "query", "left").select("query", "n_recent", F.round(expected, 4).alias("expected"), factor.alias("factor"))
    return joined.withColumn("multiplier", multiplier).withColumn("score", F.least(F.lit(100), half_up(F.col("factor") * 3)))


def decay_trends(dictionary: DataFrame, as_of: str, minutes: int = 60) -> DataFrame:
    """The query dictionary with trends that were not refreshed lately switched off."""
    old = F.coalesce(F.col("trending"), F.lit(False)) & (F.col("updated_at") < F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {minutes} minutes"))
    return dictionary.withColumns({"trending": F.when(old, False).otherwise(F.coalesce("trending", F.lit(False))), "multiplier": F.when(old, 1.0).otherwise(F.col("multiplier")), "trend_score": F.when(old, 0.0).otherwise(F.col("trend_score"))})


def hot_queries(log: DataFrame, as_of: str, minutes: int = 10, least: int = 3, n: int = 100) -> DataFrame:
    now = F.to_timestamp(F.lit(as_of))
    recent = log.where((F.col("ts") >= now - F.expr(f"interval {minutes} minutes")) & (F.col("ts") <= now))
    return recent.groupBy("query").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen")).where(F.col("n") >= least).orderBy(F.desc("n"), "query").limit(n)


def dictionary(log: DataFrame, as_of: str) -> DataFrame:
    """The query dictionary of a log: search counts, share of all searches, last search, and the recent day's weight as trend score."""
    now = F.to_timestamp(F.lit(as_of))
    counts = log.groupBy("query").agg(F.count("*").alias("search_count"), F.max("ts").alias("last_searched"), F.count_if(F.col("ts") >= now - F.expr("interval 3 days")).alias("lately"))
    return counts.select("query", "search_count", F.col("search_count").cast("double").alias("frequency"), F.col("lately").cast("double").alias("trend_score"), (F.col("lately") * 8 > F.col("search_count")).alias("trending"), F.when(F.col("lately") * 8 > F.col("search_count"), 1.5).otherwise(1.0).alias("multiplier"), "last_searched")


def prefix_suggestions(prefixes: DataFrame, words: DataFrame, as_of: str, n: int = 8) -> DataFrame:
    """(prefix, query, score, rank): the best n dictionary queries that start with each prefix, by frequency, trend and recency, ranked before they are cut."""
    days = F.datediff(F.to_date(F.lit(as_of)), F.to_date("last_searched"))
    recency = F.when(days <= 1, 20).when(days <= 7, 10).when(days <= 30, 5).otherwise(0)
    score = F.round(F.col("frequency") * F.col("multiplier") + 0.3 * F.col("trend_score") + recency + F.when(F.col("trending"), 50).otherwise(0), 4)
    joined = prefixes.join(words, F.col("query").startswith(F.col("prefix")) & (F.substring("query", 1, 1) == F.substring("prefix", 1, 1)))
    best = joined.select("prefix", "query", score.alias("score")).groupBy("prefix", "query").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("score"), "query"))).where(F.col("rank") <= n)


def related_searches(log: DataFrame, queries: DataFrame, as_of: str, n: int = 6) -> DataFrame:
    """(query, related, n, rank): the commonest other queries of the last 30 days that come from sessions with a search that holds the query, or that hold its first or last word; 3 to 60 characters, none that looks like a password. n counts searches.

    What holds what is found among distinct queries by the first three characters of the sought piece, or all of a shorter one; sessions are joined afterwards.
    """
    recent = log.where(F.col("ts") >= F.to_timestamp(F.lit(as_of)) - F.expr("interval 30 days")).groupBy("session_id", F.lower(F.trim("query")).alias("q")).agg(F.count("*").alias("n"))
    targets = queries.select(F.lower(F.trim("query")).alias("query")).where("query <> ''").distinct()
    words = F.split("query", " ")
    pieces = targets.select("query", F.col("query").alias("piece"), F.lit(True).alias("whole")).unionByName(targets.select("query", F.explode(F.array_distinct(F.array(F.element_at(words, 1), F.element_at(words, -1)))).alias("piece"), F.lit(False).alias("whole")))
    grams = lambda k: F.when(F.length("q") >= k, F.transform(F.sequence(F.lit(1), F.length("q") - (k - 1)), lambda i: F.substr("q", i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    cut = recent.groupBy("q").agg(F.sum("n").alias("n")).select("q", "n", F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("gram"))
    holds = pieces.withColumn("gram", F.left("piece", F.lit(3))).join(cut, "gram").where(F.contains("q", F.col("piece"))).select("query", "whole", "q", "n")
    sessions = holds.where("whole").select("query", "q").join(recent, "q").select("query", "session_id").distinct()
    beside = sessions.join(recent, "session_id").groupBy("query", "q").agg(F.sum("n").alias("n"))
    both = beside.unionByName(holds.where("not whole").select("query", "q", "n")).groupBy("query", F.col("q").alias("related")).agg(F.max("n").alias("n"))
    secret = F.col("related").rlike(r"(?i)passwor[td]|^\S*[0-9]\S*[!@#$%]\S*$")
    other = both.where((F.col("related") != F.col("query")) & F.length("related").between(3, 60) & ~secret)
    return other.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "related"))).where(F.col("rank") <= n)


def related_fallback(queries: DataFrame, modifiers: list[str]) -> DataFrame:
    """(query, related, rank): the query with each modifier that it lacks."""
    pairs = queries.select("query", F.posexplode(F.array(*map(F.lit, modifiers))).alias("i", "m")).where(~F.contains(F.lower("query"), F.col("m")))
    return pairs.select("query", F.concat_ws(" ", "query", "m").alias("related"), F.row_number().over(Window.partitionBy("query").orderBy("i")).alias("rank"))


def top_searches(log: DataFrame, n: int = 20) -> DataFrame:
    """The n commonest queries in lower case with mean duration, mean results and the last search."""
    return log.groupBy(F.lower(F.trim("query")).alias("query")).agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 2).alias("mean_ms"), F.round(F.avg("results"), 2).alias("mean_results"), F.max("ts").alias("last_search")).orderBy(F.desc("n"), "query").limit(n)


def daily_trends(daily: DataFrame) -> DataFrame:
    return daily.groupBy("search_date").agg(F.sum("daily_count").alias("searches"), F.countDistinct("query").alias("n_queries"), F.round(F.avg("daily_count"), 4).alias("mean_count"))


def top_queries(words: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent dictionary queries with rank and label."""
    top = words.orderBy(F.desc("frequency"), "query").limit(n)
    label = F.when(F.col("trending"), "trending").when(F.col("frequency") >= 100, "popular").otherwise("known")
    return top.select("query", "frequency", F.row_number().over(Window.orderBy(F.desc("frequency"), "query")).alias("rank"), label.alias("label"))


def trending(words: DataFrame, n: int = 10) -> DataFrame:
    return words.where("trending").orderBy(F.desc("multiplier"), F.desc("trend_score"), F.desc("frequency"), "query").limit(n).select("query", "multiplier", "trend_score", "frequency")


def analytics_summary(log: DataFrame, as_of: str) -> DataFrame:
    now = F.to_timestamp(F.lit(as_of))
    day, week = (F.col("ts") >= now - F.expr(f"interval {d} days") for d in (1, 7))
    return log.agg(F.count_if(day).alias("n_24h"), F.count_if(week).alias("n_7d"), F.count("*").alias("n_all"), F.round(F.avg(F.when(day, F.col("duration_ms"))), 2).alias("mean_ms_24h"), F.round(F.avg("duration_ms"), 2).alias("mean_ms"), F.round(F.avg("results"), 2).alias("mean_results"))


def peak_hour(log: DataFrame) -> DataFrame:
    return log.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hour").limit(1)


def latency_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("endpoint").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"))


def recent_searches(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.desc("ts"), "query", "session_id").limit(n)
