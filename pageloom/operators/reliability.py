"""What the outbound links of a page say about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.columns import half_up, host, tier, under

MAX_PENALTY, MAX_BONUS, MIN_VOTES, GOOD_LINKS = 35, 8.0, 5, 4
# Domains of public trust.
TRUSTED = """wikipedia.org wikimedia.org wikidata.org bundesregierung.de bundestag.de bundesrat.de bund.de bmj.de bmbf.de bmwk.de rki.de destatis.de bundesbank.de bafin.de dwd.de bpb.de bka.de
verfassungsschutz.de europa.eu who.int un.org oecd.org imf.org worldbank.org nato.int nature.com science.org pubmed.ncbi.nlm.nih.gov ncbi.nlm.nih.gov arxiv.org scholar.google.com doi.org orcid.org springer.com
elsevier.com reuters.com apnews.com afp.com dpa.de bbc.com bbc.co.uk spiegel.de zeit.de faz.net sueddeutsche.de welt.de tagesspiegel.de heise.de tagesschau.de w3.org ietf.org iso.org mozilla.org
stackoverflow.com github.com mdn.io developer.mozilla.org""".split()
# Names that link farms and trackers have.
FARM = r"(?i)^(click|clickbait|ad|ads|promo|affiliate|ref\d*|track|redir|redirect)|linkfarm|\d{4,}links|(free|gratis)-.*spam|(seo|backlink)-.*(farm|network|exchange)"


def outbound_domains(pages: DataFrame, links: str = "outbound_links") -> DataFrame:
    """(page_id, place, target): distinct domains that a page links to, in order, without its own."""
    hosts = F.array_distinct(F.filter(F.transform(F.coalesce(F.col(links), F.array().cast("array<string>")), lambda u: host(u)), lambda h: h.isNotNull()))
    own = pages.select("page_id", "domain", F.posexplode(hosts).alias("place", "target"))
    return own.where(~F.col("target").eqNullSafe(F.col("domain"))).select("page_id", "place", "target")


def score_reliability(pages: DataFrame, reputation: DataFrame, links: str = "outbound_links") -> DataFrame:
    """(page_id, reliability_penalty, reliability_bonus, reliability_net) of all pages. reputation has domain, trust, positive and negative.

    Only the first four good links of a page earn a bonus, so its links are folded in order; an array holds the distinct domains of one page.
    """
    rep = reputation.select(F.col("domain").alias("target"), "trust", F.coalesce("positive", F.lit(0)).alias("pos"), F.coalesce("negative", F.lit(0)).alias("neg"))
    out = outbound_domains(pages, links).join(rep, "target", "left")
    base = F.regexp_extract("target", r"([^.]+\.[^.]+)$", 1)
    total = F.coalesce(F.col("pos") + F.col("neg"), F.lit(0))
    dislike = F.when(total >= MIN_VOTES, F.try_divide("neg", total))
    like = F.try_divide("pos", total)
    link = F.struct(
        F.col("place"),
        (F.col("target").isin(TRUSTED) | base.isin(TRUSTED)).alias("trusted"),
        (
            F.when(F.col("target").rlike(FARM), 5).otherwise(0)
            + tier(dislike, [(0.90, 8), (0.80, 6), (0.60, 3), (0.45, 1)])
            + under(F.col("trust"), [(10, 10), (20, 8), (30, 5), (40, 3)])
        ).alias("penalty"),
        F.coalesce((dislike < 0.45) & (like >= 0.85) & (total >= 20), F.lit(False)).alias("liked"),
        F.coalesce(F.col("trust") >= 80, F.lit(False)).alias("high"),
    )
    start = F.struct(F.lit(0).alias("found"), F.lit(0).alias("penalty"), F.lit(0.0).alias("bonus"))

    def step(acc: Column, x: Column) -> Column:
        free = acc["found"] < GOOD_LINKS
        trusted = x["trusted"] & free
        liked = ~trusted & x["liked"] & free
        n = acc["found"] + F.when(trusted | liked, 1).otherwise(0)
        high = ~trusted & x["high"] & (n < GOOD_LINKS)
        bonus = F.when(trusted, 1.5).otherwise(0.0) + F.when(liked, 1.0).otherwise(0.0) + F.when(high, 0.5).otherwise(0.0)
        return F.struct((n + F.when(high, 1).otherwise(0)).alias("found"), (acc["penalty"] + F.when(trusted, 0).otherwise(x["penalty"])).alias("penalty"), (acc["bonus"] + bonus).alias("bonus"))

    folded = out.groupBy("page_id").agg(F.sort_array(F.collect_list(link)).alias("ls")).withColumn("f", F.aggregate("ls", start, step))
    found = folded.select("page_id", F.least(F.lit(MAX_PENALTY), "f.penalty").alias("p"), F.least(F.lit(MAX_BONUS), half_up(F.col("f.bonus") * 10) / 10).alias("b"))
    scored = pages.select("page_id").join(found, "page_id", "left")
    penalty, bonus = F.coalesce("p", F.lit(0)), F.coalesce("b", F.lit(0.0))
    return scored.select("page_id", penalty.alias("reliability_penalty"), bonus.alias("reliability_bonus"), (bonus - penalty).alias("reliability_net"))
