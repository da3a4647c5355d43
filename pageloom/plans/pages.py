"""Queries over single pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.operators import page_scores as P
from pageloom.operators.lists import reputation
from pageloom.operators import reliability
from pageloom.operators.reliability import score_reliability
from pageloom.sources import views as v
from pageloom.sources.html import COUNTS, FEATURES_SQL, FLAGS, RATIOS, extract_page_features
from pageloom.sources.views import AS_OF, with_views

DEPTH = """least(12, CASE WHEN word_count >= 1500 THEN 5 WHEN word_count >= 800 THEN 4 WHEN word_count >= 400 THEN 3 WHEN word_count >= 200 THEN 1 ELSE 0 END
    + CASE WHEN image_count >= 5 THEN 3 WHEN image_count >= 2 THEN 2 WHEN image_count >= 1 THEN 1 ELSE 0 END
    + CASE WHEN len(faq) > 0 THEN 2 ELSE 0 END + CAST(has_table AS INT) + CAST(has_steps AS INT))"""
TRUST = f"""trust AS (
  SELECT *, CAST(floor(raw + 0.5) AS BIGINT) AS trust_score,
         CASE WHEN raw >= 80 THEN 'VERY_HIGH' WHEN raw >= 60 THEN 'HIGH' WHEN raw >= 40 THEN 'MEDIUM' WHEN raw >= 20 THEN 'LOW' ELSE 'VERY_LOW' END AS trust_level
  FROM (SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE),
      CAST(eat_score AS DOUBLE) / 100 * 25
      + CASE WHEN readability_score = 0 THEN 50 ELSE readability_score END / CAST(100 AS DOUBLE) * 6
      + CASE WHEN text_to_code >= 0.4 THEN 4 WHEN text_to_code >= 0.25 THEN 3 WHEN text_to_code >= 0.1 THEN 1 WHEN text_to_code < 0.05 THEN -2 ELSE 0 END
      + {DEPTH}
      + CASE author_type WHEN 'agency' THEN 10 WHEN 'journalist' THEN 8 WHEN 'editorial' THEN 2 ELSE 0 END
      + (CASE WHEN schema_type IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN length(author) > 2 THEN 2 ELSE 0 END + 2 + CASE WHEN rating_value > 0 AND rating_count > 0 THEN 2 ELSE 0 END)
      + (CASE WHEN secure THEN 7 ELSE 0 END + CASE WHEN mobile_friendly THEN 5 ELSE 0 END + CASE WHEN load_ms > 0 AND load_ms < 1000 THEN 3 WHEN load_ms > 0 AND load_ms < 2500 THEN 1 ELSE 0 END)
      + least(8, CASE WHEN ctr >= 8 THEN 3 WHEN ctr >= 5 THEN 2 WHEN ctr >= 2 THEN 1 ELSE 0 END + CASE WHEN dwell_ms >= 180000 THEN 5 WHEN dwell_ms >= 60000 THEN 3 WHEN dwell_ms >= 20000 THEN 1 ELSE 0 END)
      + domain_trust * 10
      + CASE WHEN domain_age > 10 THEN 5 WHEN domain_age > 5 THEN 4 WHEN domain_age > 3 THEN 3 WHEN domain_age > 1 THEN 2 WHEN domain_age > 0.5 THEN 1 ELSE 0 END
      - (CASE WHEN ad_url_count >= 5 THEN least(15, ad_url_count - 5) ELSE 0 END
         + CASE WHEN has_paywall THEN floor(CASE WHEN paywall_confidence = 0 THEN 0.5 ELSE paywall_confidence END * 10 + 0.5) ELSE 0 END
         + CASE WHEN word_count < 100 AND ad_url_count > 3 THEN 5 ELSE 0 END))) AS raw
    FROM v_pages))"""

URL = {n: f"CASE WHEN regexp_matches(lower(url), '{p}') THEN {points} ELSE 0 END" for n, (p, points) in P.URL_PENALTIES.items()}
OWN = [
    f"CASE WHEN regexp_matches(trim(title), '{P.ERROR_TITLE}') THEN 100 ELSE 0 END",
    "CASE WHEN ad_count >= 20 THEN 40 WHEN ad_count >= 10 THEN 15 ELSE 0 END",
    "CASE WHEN ad_url_count >= 5 THEN least(50, (ad_url_count - 5) * 5) ELSE 0 END",
    "CASE WHEN domain_trust < 0.15 THEN 45 WHEN domain_trust < 0.3 THEN 25 ELSE 0 END",
    "CASE WHEN word_count < 50 THEN 35 WHEN word_count < 150 THEN 10 ELSE 0 END",
    "CASE WHEN readability_score < 30 THEN 40 ELSE 0 END",
    "CASE WHEN domain_age < 1 THEN 50 ELSE 0 END",
    "CASE WHEN eat_score < 20 THEN 30 ELSE 0 END",
    "CASE WHEN NOT outbound_ok THEN 35 ELSE 0 END",
    "CASE WHEN NOT secure THEN 25 ELSE 0 END",
    "CASE WHEN NOT mobile_friendly THEN 15 ELSE 0 END",
    "CASE WHEN load_ms > 120000 THEN 20 WHEN load_ms > 60000 THEN 5 ELSE 0 END",
    "CASE WHEN avg_word_length < 2.5 OR avg_word_length > 18 THEN 20 ELSE 0 END",
    "CASE WHEN avg_sentence_length < 3 THEN 15 ELSE 0 END",
    "CASE WHEN content <> '' AND trim(title) <> '' AND len(ws) > 100 AND CAST(len(list_distinct(list_filter(ws, lambda w: length(w) > 3))) AS DOUBLE) / len(ws) < 0.4 THEN 25 ELSE 0 END",
    "CASE WHEN text_to_code < 0.1 THEN 20 ELSE 0 END",
    "CASE WHEN internal_link_density < 0.05 THEN 10 ELSE 0 END",
]
SPAM = f"""spam AS (
  SELECT *, CAST(least(100, s) AS BIGINT) AS spam_score, CASE WHEN s >= 80 THEN 'CRITICAL' WHEN s >= 50 THEN 'HIGH' WHEN s >= 20 THEN 'MEDIUM' ELSE 'SAFE' END AS spam_level,
         s >= 80 OR (s >= 50 AND domain_trust > 0 AND domain_trust < 0.3) AS is_spam
  FROM (SELECT *, greatest(0, ({' + '.join(OWN)})
          - (CASE WHEN has_table THEN 15 ELSE 0 END + CASE WHEN has_steps THEN 20 ELSE 0 END + CASE WHEN image_count >= 3 THEN 15 ELSE 0 END + CASE WHEN video_count > 0 THEN 15 ELSE 0 END
             + CASE WHEN comment_count > 5 THEN 10 ELSE 0 END + CASE WHEN text_to_code > 0.6 THEN 10 ELSE 0 END)) + ({' + '.join(URL.values())}) AS s
        FROM (SELECT *, string_split_regex(lower(content), '\\s+') AS ws FROM trust)))"""

SCORED = "WITH " + v.SQL["v_pages"] + ",\n" + TRUST + ",\n" + SPAM + "\n"
KEPT = "NOT (spam_level = 'CRITICAL' OR (spam_level = 'HIGH' AND trust_score < 30) OR trust_score < 20)"


def scored(spark, d):
    return P.score_spam(P.score_trust(v.v_pages(spark, d)))


def page_features(spark, d):
    return v.v_pages(spark, d).select("page_id", "url", "domain", "title", "language", "word_count", "secure", "published_at", F.md5("content").alias("content_md5"))


def html_features(spark, d):
    found = extract_page_features(v.read(spark, d, "pages"))
    return found.select("page_id", F.md5("content").alias("content_md5"), "title", "word_count", *COUNTS, "author", "description", "schema_type", *FLAGS, *(F.round(n, 6).alias(n) for n in RATIOS), F.size("outbound_links").alias("n_outbound"))


def trust_scores(spark, d):
    return P.trust_badge(P.score_trust(v.v_pages(spark, d))).select("page_id", "trust_score", "trust_level", "badge")


def spam_scores(spark, d):
    return scored(spark, d).select("page_id", "spam_score", "spam_level", "is_spam")


def hard_blocks(spark, d):
    return P.hard_block(scored(spark, d)).select("page_id", "spam_level", "trust_score")


def trust_by_domain(spark, d):
    return P.trust_by_domain(P.hard_block(scored(spark, d)))


def phase_stats(spark, d):
    df = scored(spark, d)
    reason = F.when(F.col("spam_level") == "CRITICAL", "spam critical").when((F.col("spam_level") == "HIGH") & (F.col("trust_score") < 30), "spam high").when(F.col("trust_score") < 20, "trust low").otherwise("kept")
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def page_ratings(spark, d):
    return P.score_rating(v.v_pages(spark, d), AS_OF).select("page_id", "rating")


def ad_counts(spark, d):
    return P.combined_ads(v.v_pages(spark, d)).select("page_id", "ad_count")


def ad_density(spark, d):
    return P.score_ad_density(v.v_pages(spark, d), v.v_domain_votes(spark, d)).select("page_id", F.round("ad_factor", 4).alias("ad_factor"), "ad_malus")


def affiliate_and_ad_free(spark, d):
    return P.score_ad_free(P.score_affiliate(v.v_pages(spark, d))).select("page_id", "affiliate_malus", "ad_free_bonus")


def domain_ages(spark, d):
    domains = v.v_pages(spark, d).groupBy("domain").agg(F.min("published_at").alias("created"))
    return P.domain_age_risk(domains, AS_OF).select("domain", "age_days", "risk")


def linked_pages(spark, d):
    """Pages with the urls of four others by arithmetic on page_id, every fifth a link to an encyclopedia."""
    pages = v.v_pages(spark, d)
    n = pages.count()
    targets = pages.select(F.col("page_id").alias("t"), F.col("url").alias("link"))
    each = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).withColumn("t", (F.col("page_id") * 7 + F.col("i") * 13 + 1) % n)
    links = each.join(targets, "t").select("page_id", F.struct("i", F.when((F.col("page_id") + F.col("i")) % 5 == 0, "https://en.wikipedia.org/x").otherwise(F.col("link")).alias("u")).alias("l"))
    return pages.join(links.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["u"]).alias("outbound_links")), "page_id", "left")


def source_reliability(spark, d):
    pages = linked_pages(spark, d)
    return score_reliability(pages, reputation(P.score_trust(v.v_pages(spark, d)), v.v_domain_votes(spark, d)))


AD_DENSITY = """SELECT page_id, CASE WHEN counts THEN factor ELSE 1.0 END AS ad_factor,
          CAST(least(CASE WHEN counts THEN ceil(round(greatest(0, base * factor - base), 4)) ELSE 0 END, 30) AS BIGINT) AS ad_malus
        FROM (SELECT *, round(least(5.0, f), 4) AS factor, ads + popup_count + video_ad_count > 0 AND total >= 5 AND ratio >= 0.2 AS counts,
                     CASE WHEN ratio >= 0.8 THEN 15 WHEN ratio >= 0.6 THEN 10 WHEN ratio >= 0.4 THEN 6 WHEN ratio >= 0.2 THEN 3 ELSE 0 END AS base
              FROM (SELECT *, ad_count AS ads, coalesce(positive, 0) + coalesce(negative, 0) AS total, CASE WHEN coalesce(positive, 0) + coalesce(negative, 0) = 0 THEN 0 ELSE CAST(coalesce(negative, 0) AS DOUBLE) / (coalesce(positive, 0) + coalesce(negative, 0)) END AS ratio,
                           CAST(1.0 + CASE WHEN ad_count >= 8 THEN 2.0 WHEN ad_count >= 5 THEN 1.5 WHEN ad_count >= 3 THEN 0.8 WHEN ad_count >= 1 THEN 0.2 ELSE 0 END
                           + CASE WHEN CAST(ad_count AS DOUBLE) / greatest(1, word_count) * 100 > 2.0 THEN 1.2 WHEN CAST(ad_count AS DOUBLE) / greatest(1, word_count) * 100 > 1.5 THEN 1.0 WHEN CAST(ad_count AS DOUBLE) / greatest(1, word_count) * 100 > 0.8 THEN 0.5 ELSE 0 END
                           + CASE WHEN popup_count >= 2 THEN 1.5 WHEN popup_count >= 1 THEN 0.8 ELSE 0 END + CASE WHEN video_ad_count >= 2 THEN 1.0 WHEN video_ad_count >= 1 THEN 0.5 ELSE 0 END
                           + CASE WHEN ad_above_fold AND ad_count + popup_count + video_ad_count > 0 THEN 0.5 ELSE 0 END + CASE WHEN has_paywall AND ad_count + video_ad_count > 0 THEN 0.8 ELSE 0 END AS DOUBLE) AS f
                    FROM v_pages LEFT JOIN v_domain_votes USING (domain)))"""

AFFILIATE = """SELECT page_id, CASE WHEN n = 0 THEN 0 WHEN n >= 20 OR t > 2.0 THEN 8 WHEN n >= 10 OR t > 1.0 THEN 5 WHEN n >= 5 OR t > 0.5 THEN 2 ELSE 0 END AS affiliate_malus,
          CASE WHEN ad_count = 0 AND popup_count = 0 AND video_ad_count = 0 AND n = 0 AND NOT has_paywall THEN 5 WHEN ad_count <= 1 AND popup_count = 0 AND video_ad_count = 0 THEN 2 ELSE 0 END AS ad_free_bonus
        FROM (SELECT *, affiliate_link_count AS n, CAST(affiliate_link_count AS DOUBLE) / greatest(1, word_count) * 100 AS t FROM v_pages)"""

TRUSTED = "(" + ", ".join(f"'{x}'" for x in reliability.TRUSTED) + ")"
RELIABILITY = (with_views("", "v_pages", "v_domain_votes").rstrip() + ",\n" + TRUST + rf""",
rep AS (SELECT coalesce(t.domain, d.domain) AS target, trust, coalesce(positive, 0) AS pos, coalesce(negative, 0) AS neg FROM (SELECT domain, round(avg(CAST(trust_score AS DOUBLE)), 4) AS trust FROM trust GROUP BY 1) t FULL JOIN v_domain_votes d ON t.domain = d.domain),
linked AS (SELECT p.page_id, p.domain, i, CASE WHEN (p.page_id + i) % 5 = 0 THEN 'https://en.wikipedia.org/x' ELSE t.url END AS u FROM v_pages p CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i) JOIN v_pages t ON t.page_id = (p.page_id * 7 + i * 13 + 1) % (SELECT count(*) FROM pages)),
hosts AS (SELECT page_id, domain, nullif(regexp_replace(lower(regexp_extract(u, '(?i)^https?://([^/?#:]+)', 1)), '^www\.', ''), '') AS target, min(i) AS i FROM linked GROUP BY 1, 2, 3),
judged AS (SELECT *, pos + neg AS total, CASE WHEN pos + neg >= 5 THEN CAST(neg AS DOUBLE) / (pos + neg) END AS dislike, CASE WHEN pos + neg > 0 THEN CAST(pos AS DOUBLE) / (pos + neg) END AS liking, target IN {TRUSTED} OR regexp_extract(target, '([^.]+\.[^.]+)$', 1) IN {TRUSTED} AS trusted
  FROM hosts LEFT JOIN rep USING (target) WHERE target IS NOT NULL AND target IS DISTINCT FROM domain),
line AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k, trusted, CASE WHEN regexp_matches(target, '{reliability.FARM}') THEN 5 ELSE 0 END + CASE WHEN dislike >= 0.9 THEN 8 WHEN dislike >= 0.8 THEN 6 WHEN dislike >= 0.6 THEN 3 WHEN dislike >= 0.45 THEN 1 ELSE 0 END
    + CASE WHEN trust < 10 THEN 10 WHEN trust < 20 THEN 8 WHEN trust < 30 THEN 5 WHEN trust < 40 THEN 3 ELSE 0 END AS cost, coalesce(dislike < 0.45 AND liking >= 0.85 AND total >= 20, false) AS liked, coalesce(trust >= 80, false) AS high FROM judged),
walk AS (SELECT page_id, 0 AS k, 0 AS found, 0 AS cost, CAST(0 AS DOUBLE) AS bonus FROM v_pages
  UNION ALL SELECT page_id, k, n + CAST(h AS INT), cost, bonus + CASE WHEN t THEN 1.5 WHEN l THEN 1.0 ELSE 0 END + CASE WHEN h THEN 0.5 ELSE 0 END FROM (SELECT *, NOT t AND high AND n < 4 AS h FROM (SELECT *, found + CAST(t OR l AS INT) AS n FROM (
    SELECT w.page_id, x.k, w.found, w.bonus, x.high, x.trusted AND w.found < 4 AS t, NOT (x.trusted AND w.found < 4) AND x.liked AND w.found < 4 AS l, w.cost + CASE WHEN x.trusted AND w.found < 4 THEN 0 ELSE x.cost END AS cost FROM walk w JOIN line x ON x.page_id = w.page_id AND x.k = w.k + 1)))),
ended AS (SELECT page_id, least(35, arg_max(cost, k)) AS p, least(CAST(8 AS DOUBLE), floor(arg_max(bonus, k) * 10 + 0.5) / 10) AS b FROM walk GROUP BY 1)
SELECT page_id, p AS reliability_penalty, b AS reliability_bonus, b - p AS reliability_net FROM ended""").replace("WITH ", "WITH RECURSIVE ", 1)

QUERIES = {
    "source_reliability": (source_reliability, RELIABILITY),
    "page_features": (page_features, with_views("SELECT page_id, url, domain, title, language, word_count, secure, published_at, md5(content) AS content_md5 FROM v_pages", "v_pages")),
    "html_features": (html_features, FEATURES_SQL),
    "trust_scores": (trust_scores, SCORED + "SELECT page_id, trust_score, trust_level, CASE WHEN trust_score >= 80 THEN 'very trustworthy' WHEN trust_score >= 60 THEN 'trustworthy' WHEN trust_score >= 40 THEN 'check' WHEN trust_score >= 20 THEN 'doubtful' ELSE 'not trustworthy' END AS badge FROM trust"),
    "spam_scores": (spam_scores, SCORED + "SELECT page_id, spam_score, spam_level, is_spam FROM spam"),
    "hard_blocks": (hard_blocks, SCORED + f"SELECT page_id, spam_level, trust_score FROM spam WHERE {KEPT}"),
    "trust_by_domain": (trust_by_domain, SCORED + f"SELECT domain, count(*) AS n_pages, round(avg(trust_score), 4) AS mean_trust, round(avg(eat_score), 4) AS mean_eat, round(avg(CAST(secure AS INT)), 4) AS https_share, max(published_at) AS newest FROM spam WHERE {KEPT} GROUP BY domain"),
    "phase_stats": (phase_stats, SCORED + "SELECT CASE WHEN spam_level = 'CRITICAL' THEN 'spam critical' WHEN spam_level = 'HIGH' AND trust_score < 30 THEN 'spam high' WHEN trust_score < 20 THEN 'trust low' ELSE 'kept' END AS reason, count(*) AS n FROM spam GROUP BY 1"),
    "page_ratings": (page_ratings, with_views(f"""SELECT page_id, floor(round(least(CAST(5 AS DOUBLE), greatest(CAST(1 AS DOUBLE),
        CAST(CASE WHEN word_count > 2000 THEN 2.0 WHEN word_count > 1000 THEN 1.5 WHEN word_count > 500 THEN 1.0 WHEN word_count > 200 THEN 0.5 ELSE 0 END AS DOUBLE)
        + readability_score / 100 + CAST(eat_score AS DOUBLE) / 100 + CAST(CASE WHEN has_table THEN 0.2 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN has_steps THEN 0.3 ELSE 0 END AS DOUBLE)
        + CAST(CASE WHEN image_count > 5 THEN 0.3 WHEN image_count > 2 THEN 0.15 ELSE 0 END AS DOUBLE)
        - CAST(CASE WHEN published_at < TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY THEN 0.5 ELSE 0 END AS DOUBLE) - CAST(CASE WHEN ad_url_count > 10 THEN 0.5 WHEN ad_url_count > 5 THEN 0.2 ELSE 0 END AS DOUBLE) + 1)) * 10, 6) + 0.5) / 10 AS rating FROM v_pages""", "v_pages")),
    "ad_counts": (ad_counts, with_views("SELECT page_id, CAST(CASE WHEN ad_count = 0 AND ad_url_count > 0 THEN ad_url_count // 5 ELSE ad_count END AS INT) AS ad_count FROM v_pages", "v_pages")),
    "ad_density": (ad_density, with_views(AD_DENSITY, "v_pages", "v_domain_votes")),
    "affiliate_and_ad_free": (affiliate_and_ad_free, with_views(AFFILIATE, "v_pages")),
    "domain_ages": (domain_ages, with_views(f"""SELECT domain, age_days, CASE WHEN age_days < 30 THEN 'danger' WHEN age_days < 180 THEN 'warning' ELSE 'ok' END AS risk
        FROM (SELECT domain, CAST(date_diff('day', min(published_at), TIMESTAMP '{AS_OF}') AS INT) AS age_days FROM v_pages GROUP BY domain)""", "v_pages")),
}
