"""Scores of single pages: trust, spam, rating and advertising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.columns import given, half_up, tier, under, yes

# Author kinds and their points.
AUTHOR_POINTS = {"agency": 10, "journalist": 8, "editorial": 2, "none": 0}
# Patterns of titles and urls that carry a penalty.
ERROR_TITLE = r"(?i)^(error|404|not found|page not found|fehler|seite nicht gefunden|403|forbidden|500|bad gateway|service unavailable)"
URL_PENALTIES = {
    "sitemap": (r"/sitemap", 100),
    "search": (r"[?&](q|query|search|s|suche)=", 100),
    "legal": (r"/login|/signin|/register|/cookie-policy|/datenschutz|/agb|/impressum|/privacy-policy|/checkout|/warenkorb", 80),
    "tag": (r"/tag/|/tags/|/thema/|/themen/|/kategorie/|/category/|/topics?/|/rubrik/", 80),
    "archive": (r"/archiv/|/archive/|/alle-artikel|/overview", 30),
}


def content_depth() -> Column:
    words = tier(F.col("word_count"), [(1500, 5), (800, 4), (400, 3), (200, 1)])
    images = tier(F.col("image_count"), [(5, 3), (2, 2), (1, 1)])
    extras = F.when(F.coalesce(F.size("faq"), F.lit(0)) > 0, 2).otherwise(0) + yes("has_table").cast("int") + yes("has_steps").cast("int")
    return F.least(F.lit(12), words + images + extras)


def schema_completeness() -> Column:
    parts = [
        F.col("schema_type").isNotNull() & (F.col("schema_type") != "") & (F.col("schema_type") != "null"),
        F.length("author") > 2,
        F.col("published_at").isNotNull(),
        (F.col("rating_value") > 0) & (F.col("rating_count") > 0),
    ]
    return sum((F.when(p, 2).otherwise(0) for p in parts), F.lit(0))


def engagement_points() -> Column:
    return F.least(F.lit(8), tier(F.col("ctr"), [(8, 3), (5, 2), (2, 1)]) + tier(F.col("dwell_ms"), [(180_000, 5), (60_000, 3), (20_000, 1)]))


def trust_malus() -> Column:
    ads = F.coalesce("ad_url_count", F.lit(0))
    links = F.when(ads >= 5, F.least(F.lit(15), ads - 5)).otherwise(0)
    wall = F.when(yes("has_paywall"), half_up(given("paywall_confidence", 0.5) * 10)).otherwise(0)
    thin = F.when((F.coalesce("word_count", F.lit(0)) < 100) & (ads > 3), 5).otherwise(0)
    return -(links + wall + thin)


def score_trust(pages: DataFrame) -> DataFrame:
    """pages with trust_score, 0 to 100, and trust_level."""
    ratio = F.coalesce("text_to_code", F.lit(0.0))
    technical = F.when(yes("secure"), 7).otherwise(0) + F.when(yes("mobile_friendly"), 5).otherwise(0) + F.when(F.col("load_ms") > 0, under(F.col("load_ms"), [(1000, 3), (2500, 1)])).otherwise(0)
    author = F.coalesce(F.create_map(*(F.lit(x) for p in AUTHOR_POINTS.items() for x in p))[F.coalesce("author_type", F.lit("none"))], F.lit(0))
    raw = (
        F.coalesce("eat_score", F.lit(0)) / 100.0 * 25
        + given("readability_score", 50.0) / 100.0 * 6
        + tier(ratio, [(0.40, 4), (0.25, 3), (0.10, 1)], F.when(ratio < 0.05, -2).otherwise(0))
        + content_depth()
        + author
        + schema_completeness()
        + technical
        + engagement_points()
        + F.coalesce("domain_trust", F.lit(0.0)) * 10
        + tier(F.col("domain_age"), [(10, 5), (5, 4), (3, 3), (1, 2), (0.5, 1)], over=True)
        + trust_malus()
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    level = tier(F.col("__trust"), [(80, "VERY_HIGH"), (60, "HIGH"), (40, "MEDIUM"), (20, "LOW")], "VERY_LOW")
    return pages.withColumn("__trust", score).withColumn("trust_score", half_up(F.col("__trust"))).withColumn("trust_level", level).drop("__trust")


def diversity(text: Column) -> tuple[Column, Column]:
    """Distinct words of more than three characters as a share of all words, and the number of all words; words lie between white space."""
    words = F.split(F.lower(text), r"\s+")
    return F.size(F.array_distinct(F.filter(words, lambda w: F.length(w) > 3))) / F.size(words), F.size(words)


def score_spam(pages: DataFrame) -> DataFrame:
    """pages with spam_score, 0 to 100, spam_level, is_spam and spam_reasons. Missing features carry no penalty."""
    url, title = F.lower(F.coalesce("url", F.lit(""))), F.trim(F.coalesce("title", F.lit("")))
    by_url = {n: F.when(url.rlike(p), points).otherwise(0) for n, (p, points) in URL_PENALTIES.items()}
    share, n_words = diversity(F.col("content"))
    ads = F.col("ad_url_count")
    own = {
        "error page": F.when(title.rlike(ERROR_TITLE), 100),
        "ads": tier(F.col("ad_count"), [(20, 40), (10, 15)]),
        "ad urls": F.when(ads >= 5, F.least(F.lit(50), (ads - 5) * 5)),
        "domain trust": under(F.col("domain_trust"), [(0.15, 45), (0.3, 25)]),
        "content length": under(F.coalesce("word_count", F.lit(0)), [(50, 35), (150, 10)]),
        "readability": under(F.col("readability_score"), [(30, 40)]),
        "new domain": under(F.col("domain_age"), [(1, 50)]),
        "eat": under(F.col("eat_score"), [(20, 30)]),
        "outbound links": F.when(~F.col("outbound_ok"), 35),
        "no https": F.when(~F.col("secure"), 25),
        "not mobile": F.when(~F.col("mobile_friendly"), 15),
        "slow": tier(F.col("load_ms"), [(120_000, 20), (60_000, 5)], over=True),
        "word length": F.when((F.col("avg_word_length") < 2.5) | (F.col("avg_word_length") > 18), 20),
        "sentence length": under(F.col("avg_sentence_length"), [(3, 15)]),
        "keyword stuffing": F.when((F.col("content") != "") & (title != "") & (share < 0.4) & (n_words > 100), 25),
        "code": under(F.col("text_to_code"), [(0.1, 20)]),
        "internal links": under(F.col("internal_link_density"), [(0.05, 10)]),
    }
    own = {n: F.coalesce(p, F.lit(0)) for n, p in own.items()}
    bonus = sum(
        (F.when(t, n).otherwise(0) for t, n in ((yes("has_table"), 15), (yes("has_steps"), 20), (F.col("image_count") >= 3, 15), (F.col("video_count") > 0, 15), (F.col("comment_count") > 5, 10), (F.col("text_to_code") > 0.6, 10))),
        F.lit(0),
    )
    fixed = sum(by_url.values(), F.lit(0))
    score = F.greatest(F.lit(0), sum(own.values(), F.lit(0)) - bonus) + fixed
    reasons = F.array_compact(F.array(*(F.when(p > 0, F.lit(n)) for n, p in (own | by_url).items())))
    level = tier(F.col("__spam"), [(80, "CRITICAL"), (50, "HIGH"), (20, "MEDIUM")], "SAFE")
    spam = (F.col("__spam") >= 80) | ((F.col("__spam") >= 50) & F.coalesce((F.col("domain_trust") > 0) & (F.col("domain_trust") < 0.3), F.lit(False)))
    out = pages.withColumn("__spam", score.cast("long")).withColumn("spam_score", F.least(F.lit(100), "__spam").cast("long"))
    return out.withColumn("spam_level", level).withColumn("is_spam", spam).withColumn("spam_reasons", reasons).drop("__spam")


def hard_block(pages: DataFrame) -> DataFrame:
    """Pages that may be ranked: needs spam_level and trust_score."""
    return pages.where(~((F.col("spam_level") == "CRITICAL") | ((F.col("spam_level") == "HIGH") & (F.col("trust_score") < 30)) | (F.col("trust_score") < 20)))


def score_rating(pages: DataFrame, as_of: str) -> DataFrame:
    """pages with rating, 1.0 to 5.0."""
    score = (
        tier(F.col("word_count"), [(2000, 2.0), (1000, 1.5), (500, 1.0), (200, 0.5)], 0.0, over=True)
        + F.coalesce("readability_score", F.lit(0)) / 100.0
        + F.coalesce("eat_score", F.lit(0)) / 100.0
        + F.when(yes("has_table"), 0.2).otherwise(0.0)
        + F.when(yes("has_steps"), 0.3).otherwise(0.0)
        + tier(F.col("image_count"), [(5, 0.3), (2, 0.15)], 0.0, over=True)
        - F.when(F.col("published_at") < F.to_timestamp(F.lit(as_of)) - F.expr("interval 365 days"), 0.5).otherwise(0.0)
        - tier(F.col("ad_url_count"), [(10, 0.5), (5, 0.2)], 0.0, over=True)
    )
    return pages.withColumn("rating", half_up(F.round(F.least(F.lit(5.0), F.greatest(F.lit(1.0), score + 1.0)) * 10, 6)) / 10)


def combined_ads(pages: DataFrame) -> DataFrame:
    """ad_count, or a fifth of the ad urls where no ad was seen."""
    ads, urls = F.coalesce("ad_count", F.lit(0)), F.coalesce("ad_url_count", F.lit(0))
    return pages.withColumn("ad_count", F.when((ads == 0) & (urls > 0), F.floor(urls / 5)).otherwise(ads).cast("int"))


MIN_VOTES, MIN_DISLIKE, MAX_FACTOR, MAX_AD_MALUS = 5, 0.20, 5.0, 30


def score_ad_density(pages: DataFrame, votes: DataFrame) -> DataFrame:
    """pages with ad_factor and ad_malus; votes has domain, positive and negative and is joined by domain."""
    ads, popups, videos = (F.coalesce(c, F.lit(0)) for c in ("ad_count", "popup_count", "video_ad_count"))
    density = ads / F.greatest(F.lit(1), F.coalesce("word_count", F.lit(1))) * 100
    factor = (
        1.0
        + tier(ads, [(8, 2.0), (5, 1.5), (3, 0.8), (1, 0.2)], 0.0)
        + tier(density, [(2.0, 1.2), (1.5, 1.0), (0.8, 0.5)], 0.0, over=True)
        + tier(popups, [(2, 1.5), (1, 0.8)], 0.0)
        + tier(videos, [(2, 1.0), (1, 0.5)], 0.0)
        + F.when(yes("ad_above_fold") & (ads + popups + videos > 0), 0.5).otherwise(0.0)
        + F.when(yes("has_paywall") & (ads + videos > 0), 0.8).otherwise(0.0)
    )
    joined = pages.join(votes.select("domain", F.col("positive").alias("__pos"), F.col("negative").alias("__neg")), "domain", "left")
    total = F.coalesce("__pos", F.lit(0)) + F.coalesce("__neg", F.lit(0))
    ratio = F.coalesce(F.try_divide(F.coalesce("__neg", F.lit(0)), total), F.lit(0.0))
    base = tier(ratio, [(0.8, 15), (0.6, 10), (0.4, 6), (0.2, 3)])
    counts = (ads + popups + videos > 0) & (total >= MIN_VOTES) & (ratio >= MIN_DISLIKE)
    factor = F.when(counts, F.round(F.least(factor, F.lit(MAX_FACTOR)), 4)).otherwise(1.0)
    malus = F.least(F.ceil(F.round(F.greatest(F.lit(0.0), base * F.col("ad_factor") - base), 4)), F.lit(MAX_AD_MALUS))
    return joined.withColumn("ad_factor", factor).withColumn("ad_malus", malus.cast("long")).drop("__pos", "__neg")


def score_affiliate(pages: DataFrame) -> DataFrame:
    """pages with affiliate_malus."""
    n = F.coalesce("affiliate_link_count", F.lit(0))
    density = n / F.greatest(F.lit(1), F.coalesce("word_count", F.lit(1))) * 100
    malus = F.when(n == 0, 0).when((n >= 20) | (density > 2.0), 8).when((n >= 10) | (density > 1.0), 5).when((n >= 5) | (density > 0.5), 2).otherwise(0)
    return pages.withColumn("affiliate_malus", malus)


def score_ad_free(pages: DataFrame) -> DataFrame:
    """pages with ad_free_bonus."""
    ads, popups, videos, links = (F.coalesce(c, F.lit(0)) for c in ("ad_count", "popup_count", "video_ad_count", "affiliate_link_count"))
    none = (ads == 0) & (popups == 0) & (videos == 0) & (links == 0) & ~yes("has_paywall")
    return pages.withColumn("ad_free_bonus", F.when(none, 5).when((ads <= 1) & (popups == 0) & (videos == 0), 2).otherwise(0))


def trust_badge(pages: DataFrame) -> DataFrame:
    """pages with a badge and a one-line breakdown of trust_score."""
    badge = tier(F.col("trust_score"), [(80, "very trustworthy"), (60, "trustworthy"), (40, "check"), (20, "doubtful")], "not trustworthy")
    return pages.withColumn("badge", badge).withColumn("breakdown", F.concat_ws(" | ", F.concat(F.lit("trust "), F.col("trust_score").cast("string")), F.col("trust_level")))


def trust_by_domain(pages: DataFrame) -> DataFrame:
    """One row per domain: pages, means of trust_score and eat_score, share of https, newest date."""
    return pages.groupBy("domain").agg(
        F.count("*").alias("n_pages"),
        F.round(F.avg(F.col("trust_score").cast("double")), 4).alias("mean_trust"),
        F.round(F.avg(F.col("eat_score").cast("double")), 4).alias("mean_eat"),
        F.round(F.avg(F.col("secure").cast("double")), 4).alias("https_share"),
        F.max("published_at").alias("newest"),
    )


def domain_age_risk(domains: DataFrame, as_of: str) -> DataFrame:
    """domains (domain, created) with age_days and risk."""
    days = F.datediff(F.to_date(F.lit(as_of)), F.to_date("created"))
    return domains.withColumn("age_days", days).withColumn("risk", F.when(days.isNull(), "unknown").otherwise(under(days, [(30, "danger"), (180, "warning")], "ok")))
