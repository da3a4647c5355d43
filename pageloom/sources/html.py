"""Page features that the HTML itself tells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TITLE = r"(?s)<title>(.*?)</title>"
LANG = r'<html lang="([a-z]+)"'
CODE = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"

#: Patterns that are counted.
COUNTS = {
    "image_count": r"(?i)<img\b",
    "video_count": r"(?i)<video\b|<iframe[^>]*(?:youtube|vimeo)",
    "table_count": r"(?i)<table\b",
    "step_lists": r"(?i)<ol\b",
    "heading_count": r"(?i)<h[1-6]\b",
    "link_count": r"(?i)<a\s[^>]*href=",
    "internal_links": r'(?i)<a\s[^>]*href="[/#?]',
    "affiliate_link_count": r'(?i)href="[^"]*(?:amzn\.to|[?&]tag=|aff_?id=|affiliate)',
    "ad_count": r'(?i)class="(?:[^"]* )?(?:ad|ads|advert|advertisement|sponsored)(?: [^"]*)?"',
    "popup_count": r'(?i)class="[^"]*(?:popup|modal|overlay)',
    "comment_count": r'(?i)class="(?:[^"]* )?comment(?: [^"]*)?"',
}
#: Patterns whose first group is the value; null where the page lacks it.
VALUES = {
    "description": r'(?i)<meta\s+name="description"\s+content="([^"]*)"',
    "author": r'(?i)<meta\s+name="author"\s+content="([^"]*)"',
    "published": r'(?i)(?:article:published_time"\s+content|<time[^>]*datetime|"datePublished"\s*:)\s*=?\s*"([^"]*)"',
    "schema_type": r'"@type"\s*:\s*"(\w+)"',
    "price": r'"price"\s*:\s*"?([0-9]+(?:\.[0-9]+)?)',
    "rating_value": r'"ratingValue"\s*:\s*"?([0-9]+(?:\.[0-9]+)?)',
    "rating_count": r'"(?:ratingCount|reviewCount)"\s*:\s*"?([0-9]+)',
    "image": r'(?i)<meta\s+property="og:image"\s+content="([^"]*)"',
}
#: Patterns that a page has or lacks.
FLAGS = {"mobile_friendly": r'(?i)<meta\s+name="viewport"', "has_paywall": r'(?i)class="[^"]*paywall|isAccessibleForFree"\s*:\s*"?false'}
#: Ratios as SQL of content, html, word_count and counts, the same in both engines.
RATIOS = {
    "text_to_code": "CAST(length(content) AS DOUBLE) / greatest(1, length(html))",
    "avg_word_length": "CAST(length(content) - word_count + 1 AS DOUBLE) / word_count",
    "avg_sentence_length": "CAST(word_count AS DOUBLE) / greatest(1, sentences)",
    "internal_link_density": "CAST(internal_links AS DOUBLE) / word_count",
}
SENTENCE_END = r"[.!?]+(?: |$)"
OUTBOUND = r'(?i)<a\s[^>]*href="(https?://[^"]+)"'


def page_text(raw: DataFrame) -> DataFrame:
    """raw (page_id, url, html) with title, language, content (the text without markup, single spaces) and word_count. Null html counts as empty; a text without words counts one empty word."""
    html = F.coalesce("html", F.lit(""))
    text = F.trim(F.regexp_replace(F.regexp_replace(html, CODE, " "), r"\s+", " "))
    out = raw.withColumns({"html": html, "title": F.regexp_extract(html, TITLE, 1), "language": F.regexp_extract(html, LANG, 1), "content": text})
    return out.withColumn("word_count", F.size(F.split("content", " ")))


def text_ratios(pages: DataFrame) -> DataFrame:
    """page_text's rows with RATIOS; needs internal_links."""
    return pages.withColumn("sentences", F.regexp_count("content", F.lit(SENTENCE_END))).select("*", *(F.expr(e).alias(n) for n, e in RATIOS.items())).drop("sentences")


def extract_page_features(raw: DataFrame) -> DataFrame:
    """raw (page_id, url, html) with the text, counts, values, flags and ratios of its HTML, and outbound_links, the urls of other hosts it links to in order."""
    pages = page_text(raw)
    found = pages.select(
        "*",
        *(F.regexp_count("html", F.lit(p)).alias(n) for n, p in COUNTS.items()),
        *(F.nullif(F.regexp_extract("html", p, 1), F.lit("")).alias(n) for n, p in VALUES.items()),
        *(F.regexp_like("html", F.lit(p)).alias(n) for n, p in FLAGS.items()),
        F.regexp_extract_all("html", F.lit(OUTBOUND), 1).alias("outbound_links"),
    )
    typed = found.withColumns({"price": F.col("price").cast("double"), "rating_value": F.col("rating_value").cast("double"), "rating_count": F.col("rating_count").cast("int"), "has_table": F.col("table_count") > 0, "has_steps": F.col("step_lists") > 0})
    return text_ratios(typed).drop("html")


TEXT_SQL = rf"""SELECT *, CAST(len(string_split(content, ' ')) AS INTEGER) AS word_count, len(regexp_extract_all(content, '{SENTENCE_END}')) AS sentences, {', '.join(f"CAST(len(regexp_extract_all(html, '{p}')) AS INTEGER) AS {n}" for n, p in COUNTS.items())}
  FROM (SELECT page_id, url, html, regexp_extract(html, '{TITLE}', 1) AS title, regexp_extract(html, '{LANG}', 1) AS language, trim(regexp_replace(regexp_replace(html, '{CODE}', ' ', 'g'), '\s+', ' ', 'g')) AS content FROM pages)"""
FEATURES_SQL = f"""SELECT page_id, md5(content) AS content_md5, title, word_count, {', '.join(COUNTS)}, {', '.join(f"nullif(regexp_extract(html, '{VALUES[n]}', 1), '') AS {n}" for n in ('author', 'description', 'schema_type'))},
  {', '.join(f"regexp_matches(html, '{p}') AS {n}" for n, p in FLAGS.items())}, {', '.join(f'round({e}, 6) AS {n}' for n, e in RATIOS.items())}, CAST(len(regexp_extract_all(html, '{OUTBOUND}')) AS INTEGER) AS n_outbound FROM ({TEXT_SQL})"""
