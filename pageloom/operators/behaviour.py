"""Clicks and impressions: closing of clicks, click quality, click-rate deviation and the bonus they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Expected click rate of result positions 1 to 10, and from 11 to 20.
EXPECTED_CTR = [0.285, 0.157, 0.110, 0.080, 0.063, 0.051, 0.040, 0.032, 0.028, 0.024]
LATE_START, LATE_END, NO_RANK = 0.020, 0.008, 0.005
POGO_MS, GOOD_MS, SESSION_MINUTES = 8_000, 45_000, 30
CLICK_DAYS, IMPRESSION_DAYS = 30, 7
MIN_CLICKS_MALUS, MIN_CLICKS_BONUS, MIN_IMPRESSIONS = 10, 15, 30


def expected_ctr(position: Column) -> Column:
    late = F.lit(LATE_START) + (position - 11) / 9.0 * (LATE_END - LATE_START)
    return F.when(position.between(1, 10), F.element_at(F.array(*map(F.lit, EXPECTED_CTR)), F.greatest(F.lit(1), F.least(F.lit(10), position)).cast("int"))).when(position.between(11, 20), late).otherwise(NO_RANK)


def dwell_label(dwell: Column) -> Column:
    return F.when(dwell.isNull(), "open").when(dwell < POGO_MS, "pogo").when(dwell >= GOOD_MS, "good").otherwise("neutral")


def rate_clicks(clicks: DataFrame) -> DataFrame:
    """clicks with is_pogo, is_good, quality and position_weight."""
    dwell = F.col("dwell_ms")
    return clicks.withColumns({"is_pogo": dwell < POGO_MS, "is_good": dwell >= GOOD_MS, "quality": dwell_label(dwell), "position_weight": F.round(1 / expected_ctr(F.col("position")), 6)})


def ingest_clicks(raw: DataFrame) -> DataFrame:
    """Click rows from raw ones (url, session_id, position, query, ts): fields are cut to their lengths, the domain comes from the url, rows without url or session go."""
    domain = F.regexp_replace(F.lower(F.regexp_extract("url", r"^(?i:https?)://([^/?#:]+)", 1)), r"^www\.", "")
    kept = raw.where((F.coalesce(F.trim("url"), F.lit("")) != "") & (F.coalesce(F.trim("session_id"), F.lit("")) != ""))
    return kept.select(F.substring("url", 1, 2000).alias("url"), domain.alias("domain"), F.substring("session_id", 1, 100).alias("session_id"), F.greatest(F.lit(0), F.coalesce("position", F.lit(0))).alias("position"), F.substring("query", 1, 500).alias("query"), F.col("ts").alias("clicked_at"))


def impressions_from_ranking(ranked: DataFrame, shown_at: str) -> DataFrame:
    """Impressions of the first ten results of each list."""
    return ranked.where("rank <= 10").select("url", F.col("rank").alias("position"), "query", F.to_timestamp(F.lit(shown_at)).alias("shown_at"))


def close_clicks(clicks: DataFrame, returns: DataFrame) -> DataFrame:
    """clicks with dwell_ms and returned_at. A return (session_id, ts, dwell_ms) closes the newest click of its session that is open and not older than half an hour; the dwell time is the return's own, or the time between the two. A click before a return of the same instant comes first.

    Clicks and returns are like opening and closing brackets: a return belongs to the last click that left as many clicks open as the return finds. Returns that find none open count for nothing. Whether a pair is too far apart is asked afterwards: older clicks, which later returns would find, are too old as well.
    """
    c = clicks.select("session_id", F.col("clicked_at").alias("ts"), F.lit(0).alias("kind"), "id", F.lit(None).cast("long").alias("own"))
    r = returns.select("session_id", "ts", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), F.col("dwell_ms").cast("long").alias("own"))
    keys = ("ts", "kind", "id", "own")
    so_far = Window.partitionBy("session_id").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    events = c.unionByName(r).withColumn("sum", F.sum(1 - 2 * F.col("kind")).over(so_far))
    events = events.withColumn("open", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far)))
    level = F.col("open") + F.col("kind")  # a return that closed a click found one more; one that found none open meets no click at level 1, as the click before it there is closed
    order = Window.partitionBy("session_id", "level").orderBy(*keys)
    events = events.withColumn("level", level).withColumns({"next_kind": F.lead("kind").over(order), "next_ts": F.lead("ts").over(order), "next_own": F.lead("own").over(order)})
    ms = (F.unix_millis("next_ts") - F.unix_millis("ts")).cast("long")
    closed = events.where((F.col("kind") == 0) & (F.col("next_kind") == 1) & (ms <= SESSION_MINUTES * 60_000)).select("id", F.coalesce("next_own", ms).alias("dwell_ms"), F.col("next_ts").alias("returned_at"))
    return clicks.drop("dwell_ms", "returned_at").join(closed, "id", "left")


def url_quality(clicks: DataFrame, as_of: str) -> DataFrame:
    """Counts and rates of each url over the last 30 days; the weighted rates give a click the inverse of its position's expected rate as weight (20 if it has none). clicks come from rate_clicks."""
    timed, weight = F.col("dwell_ms").isNotNull(), F.coalesce("position_weight", F.lit(20.0))
    weighted = lambda test: F.sum(F.when(timed & test, weight).otherwise(0.0))
    recent = clicks.where(F.col("clicked_at") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {CLICK_DAYS} days"))
    n, all_ = F.count_if(timed), F.sum(F.when(timed, weight).otherwise(0.0))
    return recent.groupBy("url", "domain").agg(
        F.count("*").alias("n_clicks"),
        n.alias("n_timed"),
        F.count_if("is_pogo").alias("n_pogo"),
        F.count_if("is_good").alias("n_good"),
        F.round(F.try_divide(F.count_if("is_pogo"), n), 4).alias("pogo_rate"),
        F.round(F.try_divide(F.count_if("is_good"), n), 4).alias("good_rate"),
        F.round(F.try_divide(weighted(F.col("is_pogo")), all_), 4).alias("weighted_pogo_rate"),
        F.round(F.try_divide(weighted(F.col("is_good")), all_), 4).alias("weighted_good_rate"),
    )


def ctr_deviation(clicks: DataFrame, impressions: DataFrame, as_of: str) -> DataFrame:
    """(url, n_impressions, ctr_deviation) over the last 7 days: clicks per impression less the mean expected rate of the shown positions; null under 30 impressions."""
    since = F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {IMPRESSION_DAYS} days")
    shown = impressions.where(F.col("shown_at") >= since).groupBy("url").agg(F.count("*").alias("n_impressions"), F.avg(expected_ctr(F.col("position"))).alias("expected"))
    clicked = clicks.where(F.col("clicked_at") >= since).groupBy("url").agg(F.count("*").alias("n"))
    rate = F.coalesce("n", F.lit(0)) / F.col("n_impressions") - F.col("expected")
    return shown.join(clicked, "url", "left").select("url", "n_impressions", F.when(F.col("n_impressions") >= MIN_IMPRESSIONS, F.round(rate, 4)).alias("ctr_deviation"))


def quality_bonus(quality: DataFrame, deviation: DataFrame) -> DataFrame:
    """(url, domain, bonus), -7 to 5: a malus for quick returns, or else a bonus for long visits, plus points for the click rate."""
    pogo, good, ctr = F.col("weighted_pogo_rate"), F.col("weighted_good_rate"), F.col("ctr_deviation")
    visits = (
        F.when(F.col("n_timed") < MIN_CLICKS_MALUS, 0)
        .when(pogo > 0.65, -5).when(pogo > 0.45, -3).when(pogo > 0.30, -1)
        .when((F.col("n_clicks") >= MIN_CLICKS_BONUS) & (good > 0.75), 3).when(good > 0.60, 2).when(good > 0.45, 1)
        .otherwise(0)
    )
    rate = F.when(ctr > 0.10, 2).when(ctr > 0.05, 1).when(ctr < -0.10, -2).when(ctr < -0.05, -1).otherwise(0)
    return quality.join(deviation, "url", "left").select("url", "domain", (visits + rate).alias("bonus"))


def fresh_bonuses(quality: DataFrame, as_of: str, days: int = 2) -> DataFrame:
    """(url, bonus) of urls whose bonus isn't zero and was renewed in the last days; quality has url, bonus and updated_at."""
    return quality.where((F.col("bonus") != 0) & (F.col("updated_at") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {days} days"))).select("url", "bonus")


def visit_rates(quality: DataFrame, as_of: str, least: int = 10, days: int = 7) -> DataFrame:
    """(url, bad_rate, good_rate, n_clicks) of urls with enough clicks that were renewed in the last days."""
    fresh = quality.where((F.col("n_clicks") >= least) & (F.col("updated_at") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {days} days")))
    return fresh.select("url", "bad_rate", "good_rate", "n_clicks")
