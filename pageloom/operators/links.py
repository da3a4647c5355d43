"""Link trust, navigation journeys and domain families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.columns import half_up, host

DAMPING = 0.85
# Domains of one owner, and second-level labels below which a name is registered.
FAMILIES = {
    "amazon": "amazon.de amazon.com amazon.co.uk amazon.fr amazon.es amazon.it amazon.nl amazon.pl amazon.at",
    "apple": "apple.com icloud.com",
    "ebay": "ebay.de ebay.com ebay.co.uk ebay.at",
    "facebook": "facebook.com fb.com",
    "google": "google.de google.com google.co.uk google.at google.ch",
    "microsoft": "microsoft.com azure.com office.com live.com",
    "pinterest": "pinterest.de pinterest.com",
    "twitter": "twitter.com x.com",
    "wikipedia": "wikipedia.org wikimedia.org wikidata.org",
}
SECOND_LEVEL = "co|com|org|net|gov|ac|edu"


def domain_family(domain: Column) -> Column:
    """The owner of a known domain, else the registrable domain: its last two labels, or three below a second level such as co.uk."""
    registrable = F.regexp_extract(domain, rf"([^.]+\.(?:(?:{SECOND_LEVEL})\.[a-z]{{2}}|[^.]+))$", 1)
    name = F.coalesce(F.nullif(registrable, F.lit("")), domain)
    out = None
    for family, members in FAMILIES.items():
        test = name.isin(members.split())
        out = F.when(test, family) if out is None else out.when(test, family)
    return out.otherwise(name)


def domain_authority(edges: DataFrame) -> DataFrame:
    """(domain, inbound, bonus): linking pages of each domain from other domains, and up to ten points for them."""
    linked = edges.select("from_url", host(F.col("to_url")).alias("domain")).where(host(F.col("from_url")) != F.col("domain")).distinct()
    return linked.groupBy("domain").agg(F.count("*").alias("inbound")).withColumn("bonus", F.least(F.lit(10), half_up(F.round(F.log10(F.col("inbound") + 1) * 4.3, 6))))


def vote_multiplier(positive: Column, negative: Column) -> Column:
    total = F.coalesce(positive, F.lit(0)) + F.coalesce(negative, F.lit(0))
    rate = F.try_divide(F.coalesce(positive, F.lit(0)), total)
    return F.when(total < 5, 1.0).when((rate >= 0.8) & (total >= 20), 1.2).when(rate >= 0.65, 1.1).when((rate < 0.35) & (total >= 10), 0.8).when(rate < 0.5, 0.9).otherwise(1.0)


def reciprocal_trust(edges: DataFrame, page_trust: DataFrame, votes: DataFrame) -> DataFrame:
    """(url, n_backlinks, score) of every linked url: what distinct linking pages pass on, trust over their links times 0.85 times a factor from the votes on their domain; min(15, 5 ln(1 + sum))."""
    links = edges.select("from_url", "to_url").distinct().where("from_url <> to_url")
    source = page_trust.select(F.col("url").alias("from_url"), "trust_score", "outgoing_links")
    joined = links.join(source, "from_url").withColumn("domain", host(F.col("from_url"))).join(votes.select("domain", "positive", "negative"), "domain", "left")
    passed = F.col("trust_score") / F.greatest(F.lit(1), "outgoing_links") * DAMPING * vote_multiplier(F.col("positive"), F.col("negative"))
    return joined.groupBy(F.col("to_url").alias("url")).agg(F.count("*").alias("n_backlinks"), F.sum(passed).alias("s")).select("url", "n_backlinks", F.round(F.least(F.lit(15.0), F.log1p("s") * 5), 4).alias("score"))


def journey_pairs(votes: DataFrame, minutes: int = 60) -> DataFrame:
    """(session_id, source_url, target_url, at, then): each up-vote with every later one of the session on another url within the hour. Sessions join on themselves by a bucket of the hour too, so a long session is not paired with all of itself."""
    ups = votes.where("vote_type = 'up'").select("session_id", "url", "created_at").withColumn("t", F.unix_timestamp("created_at"))
    span = minutes * 60
    a = ups.select("session_id", F.col("url").alias("source_url"), F.col("created_at").alias("at"), F.col("t").alias("ta"), F.floor(F.col("t") / span).alias("b"))
    b = ups.select("session_id", F.col("url").alias("target_url"), F.col("created_at").alias("then"), F.col("t").alias("tb"), F.explode(F.array(F.floor(F.col("t") / span), F.floor(F.col("t") / span) - 1)).alias("b"))
    near = (F.col("at") < F.col("then")) & (F.unix_millis("then") - F.unix_millis("at") < span * 1000) & (F.col("source_url") != F.col("target_url"))
    return a.join(b, ["session_id", "b"]).where(near).select("session_id", "source_url", "target_url", "at", "then")


def journey_links(votes: DataFrame, least: int = 3) -> DataFrame:
    """(source_url, target_url, strength, confidence): pairs seen least times, and their share of the source's up-votes in percent."""
    strength = journey_pairs(votes).groupBy("source_url", "target_url").agg(F.count("*").alias("strength")).where(F.col("strength") >= least)
    ups = votes.where("vote_type = 'up'").groupBy(F.col("url").alias("source_url")).agg(F.count("*").alias("n"))
    return strength.join(ups, "source_url").select("source_url", "target_url", "strength", F.round(F.col("strength") * 100.0 / F.col("n"), 4).alias("confidence"))


def next_steps(links: DataFrame, k: int = 3) -> DataFrame:
    best = Window.partitionBy("source_url").orderBy(F.desc("strength"), F.desc("confidence"), "target_url")
    return links.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
