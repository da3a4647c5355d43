"""Relevance of pages to queries, and rankings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.columns import half_up, host, tier, tokens, under, yes
from pageloom.operators.links import domain_family
from pageloom.operators.vectors import Choice, best, dots

# Words that queries are searched without.
STOP_WORDS = """der die das den dem des ein eine und oder auf aus bei bis für mit nach von vor zum zur ins ans vom hat ist sind war wird ich wir sie ihr man sich
aber auch als wie was wer dass wenn noch nur sehr hier the and for not are this that with from""".split()
# Words and parts of words that tell what a query is after.
INTENTS = [
    ("NEWS", r"nachrichten|news|breaking|aktuell|heute|meldung|bericht|ereignis|incident|fall|schlagzeilen"),
    ("INFORMATIONAL", r"^(was|wie|wer|warum|wo|wann)\s|definition|erklär|anleitung|guide|tutorial|how to|unterschied"),
    ("COMMERCIAL", r"kaufen|buy|preis|price|kosten|bestellen|order|shop|angebot|vergleich|compare|hergestellt|hersteller"),
    ("NAVIGATION", r"^www|\.com|\.de|\.org|site:|login|app"),
]
# Weights of trust and relevance by intent; quality has the rest of 100.
WEIGHTS = {"YMYL": (60, 25), "NEWS": (30, 30), "COMMERCIAL": (30, 40), "ENTERTAINMENT": (20, 40), "INFORMATIONAL": (35, 35)}
DEFAULT_WEIGHTS = (40, 35)
YMYL_WORDS = "arzt doktor krankheit symptom medikament diagnose therapie kredit hypothek steuer rechtsanwalt anwalt klage versicherung impfung".split()
CAR_WORDS = "auto autos pkw fahrzeug gebrauchtwagen neuwagen kfz motorrad elektroauto leasing autohaus autokauf cabrio limousine suv kombi".split()
# Queries about computing, and words that pages about it have; other pages get IT_CAP points at most.
IT_QUERY, IT_CONTENT, IT_CAP = "coding|programm|informatik|scratch", "software|programm|scratch|python|java|algorithmus|computer|digital", 20
# Intents that results don't change, and the intents that categories of results stand for.
PROTECTED_INTENTS = ("NEWS", "YMYL", "NAVIGATION")
INTENT_OF_CATEGORY = {"news": "NEWS", "article-news": "NEWS", "blog": "INFORMATIONAL", "tutorial": "INFORMATIONAL", "guide": "INFORMATIONAL", "product": "COMMERCIAL", "shop": "COMMERCIAL", "ecommerce": "COMMERCIAL", "video": "GENERAL", "forum": "GENERAL"}
# Weights of the eleven quality signals.
SIGNALS = {"freshness": 0.18, "phrase": 0.15, "community": 0.15, "engagement": 0.12, "ad_free": 0.10, "ux": 0.08, "structure": 0.08, "authority": 0.06, "reliability": 0.05, "semantic": 0.01, "originality": 0.02}
# Most results of a domain family among the first ten and in all, by intent.
FAMILY_LIMITS = {"NEWS": (10, 20), "COMMERCIAL": (2, 3), "INFORMATIONAL": (2, 4)}
DEFAULT_LIMITS, TOP_SIZE = (3, 5), 10


def words_between_spaces(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.lower(text)), r"\s+"), lambda w: w != "")


def query_terms(queries: DataFrame) -> DataFrame:
    """queries with terms: words longer than two characters that aren't stop words, in order."""
    kept = F.filter(words_between_spaces(F.col("query")), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    return queries.withColumn("terms", kept)


def classify_intent(queries: DataFrame) -> DataFrame:
    q, out = F.lower("query"), None
    for name, pattern in INTENTS:
        out = F.when(q.rlike(pattern), name) if out is None else out.when(q.rlike(pattern), name)
    return queries.withColumn("intent", out.otherwise("GENERAL"))


def classify_search_type(queries: DataFrame) -> DataFrame:
    q = F.lower("query")
    kind = F.when(q.rlike(r"^(wie|was|wer|wo|wann|warum|how|what|who|where|when|why)\b|\?$"), "question").when(q.rlike(r"kaufen|preis|buy|price|shop"), "shopping").when(q.rlike(r"news|aktuell|heute"), "news").otherwise("general")
    return queries.withColumn("search_type", kind)


def is_question(queries: DataFrame) -> DataFrame:
    start = F.element_at(F.split(F.trim(F.lower("query")), r"\s+"), 1)
    asks = start.isin("wer was wie wo wann warum wieso weshalb woher wohin welche welcher welches who what how where when why which".split())
    return queries.withColumn("is_question", asks | F.endswith(F.trim("query"), F.lit("?")))


def weights(queries: DataFrame) -> DataFrame:
    """queries (with intent) with profile, w_trust, w_relevance and w_quality; health, money and law come first, then cars."""
    own = tokens(F.col("query"))
    has = lambda words: F.arrays_overlap(own, F.array(*map(F.lit, words)))
    profile = F.when(has(YMYL_WORDS), "YMYL").when(has(CAR_WORDS), "COMMERCIAL").when(F.col("intent").isin(list(WEIGHTS)), F.col("intent")).otherwise("DEFAULT")
    pick = lambda i: F.coalesce(*(F.when(F.col("profile") == k, v[i]) for k, v in WEIGHTS.items()), F.lit(DEFAULT_WEIGHTS[i]))
    out = queries.withColumn("profile", profile).withColumn("w_trust", pick(0)).withColumn("w_relevance", pick(1))
    return out.withColumn("w_quality", 100 - F.col("w_trust") - F.col("w_relevance"))


def expand_terms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """queries (with terms) with expanded: the terms and all terms of their synonym groups; synonyms has terms, one array for each group."""
    groups = synonyms.select(F.explode("terms").alias("term"), F.col("terms").alias("__group"))
    more = queries.select("query_id", F.explode("terms").alias("term")).join(groups, "term").groupBy("query_id").agg(F.flatten(F.collect_list("__group")).alias("__more"))
    out = queries.join(more, "query_id", "left")
    return out.withColumn("expanded", F.array_sort(F.array_union("terms", F.coalesce("__more", F.array().cast("array<string>"))))).drop("__more")


def term_index(pages: DataFrame) -> DataFrame:
    """(term, page_id, n_title, n_content): words of three characters and more with their counts in each page. A plan that uses it several times stores it first."""
    said = pages.select("page_id", F.explode(tokens(F.col("content"))).alias("term"), F.lit(0).alias("t")).unionByName(pages.select("page_id", F.explode(tokens(F.col("title"))).alias("term"), F.lit(1).alias("t")))
    return said.where(F.length("term") > 2).groupBy("term", "page_id").agg(F.sum("t").alias("n_title"), F.count_if(F.col("t") == 0).alias("n_content"))


def candidates(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, page_id): pages that have any term of the query (which has terms)."""
    terms = queries.select("query_id", F.explode("terms").alias("term")).distinct()
    return terms.join(index, "term").select("query_id", "page_id").distinct()


def score_relevance(queries: DataFrame, pages: DataFrame, index: DataFrame, as_of: str, only: DataFrame | None = None) -> DataFrame:
    """(query_id, page_id, keyword, phrase, relevance): candidates with their relevance, 0 to 100; of those in only (query_id, page_id), if given.

    queries have terms and intent. Counts of the terms in title and content come from the index, joined by term; only the phrase part reads texts, of pages that are candidates.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    hits = terms.join(index, "term").groupBy("query_id", "page_id").agg(
        F.sum(F.when(F.col("n_title") > 0, 20).otherwise(0) + F.when(F.col("n_content") >= 2, 5).otherwise(0)).alias("points"),
        F.count_if((F.length("term") > 3) & ((F.col("n_title") > 0) | (F.col("n_content") >= 2))).alias("n_core"),
        F.count("*").alias("n_found"),
        F.count_if(F.col("n_title") > 0).alias("n_title"),
    )
    if only is not None:
        hits = hits.join(only, ["query_id", "page_id"], "left_semi")
    q = queries.select("query_id", F.trim(F.lower("query")).alias("q"), "terms", "intent")
    p = pages.select("page_id", F.lower("title").alias("title"), F.lower("content").alias("content"), "word_count", "published_at", "readability_score", "avg_word_length", "avg_sentence_length", "ctr", "dwell_ms", "comment_count", "has_table", "has_steps", "image_count", "video_count", "internal_link_density", "category")
    qp = hits.join(q, "query_id").join(p, "page_id")
    core = F.greatest(F.lit(1), F.size(F.filter("terms", lambda t: F.length(t) > 3)))
    keyword = F.col("points") * F.when(F.col("n_core") / core < 1.0, 0.1).otherwise(1.0)
    astray = F.exists("terms", lambda t: t.rlike(IT_QUERY)) & ~F.col("content").rlike(IT_CONTENT)
    keyword = F.greatest(F.lit(0.0), F.least(F.lit(40.0), keyword - F.when(astray, 30.0).otherwise(0.0)))
    bigram = F.exists(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("terms") - 1)), lambda i: F.concat_ws(" ", F.slice("terms", i, 2))), lambda b: F.contains("title", b))
    n_terms = F.size(F.array_distinct("terms"))
    sentence = F.exists(F.split("content", r"[.!?\n]+"), lambda s: F.size(F.array_intersect(tokens(s), F.col("terms"))) == n_terms)
    size = F.length("content")
    near = F.when(size > 150, F.exists(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), size - 151), F.lit(30)), lambda i: F.substr("content", i + 1, F.lit(150))), lambda w: F.size(F.array_intersect(tokens(w), F.col("terms"))) == n_terms)).otherwise(False)
    phrase = (
        F.when(F.size("terms") < 2, 0)
        .when(F.contains("title", F.col("q")), 15)
        .when((F.size("terms") >= 3) & bigram, 12)
        .when(F.contains("content", F.col("q")), 10)
        .when(F.col("n_found") < n_terms, -3)
        .when(sentence, 8)
        .when(F.col("n_title") == n_terms, 8)
        .when(near, 4)
        .otherwise(0)
    )
    age = (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("published_at")) / 86_400.0
    fresh = F.when(age.isNull(), 7).otherwise(F.when(age <= 1, 15).when(age <= 3, 14).when(age <= 7, 12).when(age <= 30, 9).when(age <= 180, 5).when(age <= 365, 2).otherwise(0))
    fresh = F.when((F.col("intent") == "NEWS") & (age <= 3), F.least(F.lit(15), fresh + 3)).otherwise(fresh)
    flag = lambda test, n: F.when(test, n).otherwise(0)
    read = F.least(F.lit(10), tier(F.col("readability_score"), [(70, 15), (50, 12), (30, 7)]) + flag(F.col("avg_word_length").between(3, 8), 3) + flag(F.col("avg_sentence_length").between(8, 15), 2))
    engaged = F.least(F.lit(10), tier(F.col("ctr"), [(8, 6), (5, 4), (2, 2)]) + tier(F.col("dwell_ms"), [(3000, 5), (1500, 3), (500, 1)]) + tier(F.col("comment_count"), [(50, 4), (10, 2)], over=True))
    built = F.least(F.lit(7), flag(yes("has_table"), 4) + flag(yes("has_steps"), 4) + flag(F.col("image_count") >= 5, 3) + flag(F.col("video_count") > 0, 3) + flag(F.col("internal_link_density") >= 0.1, 2))
    shop = (F.col("category") == "shop") | F.col("content").rlike("preis|kaufen|bestellen|angebot")
    meant = flag(((F.col("intent") == "INFORMATIONAL") & ((F.col("category") == "news") | (F.col("word_count") > 1000))) | ((F.col("intent") == "COMMERCIAL") & shop) | ((F.col("intent") == "NEWS") & (F.col("category") == "news")), 3)
    depth = tier(F.col("word_count"), [(2000, 15), (1000, 12), (500, 8), (200, 4)], over=True)
    out = qp.select("query_id", "page_id", keyword.alias("keyword"), phrase.alias("phrase"), (depth + fresh + read + engaged + built + meant).alias("__rest"), F.when(astray, float(IT_CAP)).otherwise(100.0).alias("__cap"))
    return out.select("query_id", "page_id", F.round("keyword", 4).alias("keyword"), "phrase", half_up(F.round(F.least("__cap", F.col("keyword") + F.col("phrase") + F.col("__rest")), 6)).alias("relevance"))


def keyword_filter(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, page_id) that pass: one term: an expanded term in the title or three times in the content; more terms: all of them somewhere and one in the title or twice in the content. queries have terms and expanded."""
    one = queries.where(F.size("terms") == 1).select("query_id", F.explode("expanded").alias("term")).join(index, "term").where("n_title > 0 or n_content >= 3").select("query_id", "page_id").distinct()
    many = queries.where(F.size("terms") >= 2).select("query_id", F.size(F.array_distinct("terms")).alias("need"), F.explode(F.array_distinct("terms")).alias("term")).join(index, "term")
    all_ = many.groupBy("query_id", "page_id", "need").agg(F.count("*").alias("n"), F.max((F.col("n_title") > 0) | (F.col("n_content") >= 2)).alias("strong")).where("n = need and strong").select("query_id", "page_id")
    return one.unionByName(all_)


def refine_intent(ranked: DataFrame) -> DataFrame:
    """(query_id, refined): the category that three or more of a query's first five rows have; ranked has query_id, rank and category."""
    counts = ranked.where("rank <= 5").groupBy("query_id", "category").agg(F.count("*").alias("n")).where("n >= 3")
    return counts.groupBy("query_id").agg(F.max_by("category", F.struct("n", "category")).alias("refined"))


def correct_intent(queries: DataFrame, results: DataFrame) -> DataFrame:
    """queries with intent replaced by that of the category that three or more of the first five results have; results has query_id, rank and category. Protected intents stay, and so does the intent where the results are fewer than three or their category stands for none."""
    category = F.lower("refined")
    found = refine_intent(results).select("query_id", F.coalesce(*(F.when(category == c, i) for c, i in INTENT_OF_CATEGORY.items())).alias("__found"))
    out = queries.join(found, "query_id", "left")
    return out.withColumn("intent", F.when(F.col("intent").isin(*PROTECTED_INTENTS), F.col("intent")).otherwise(F.coalesce("__found", "intent"))).drop("__found")


def quality_signals(scored: DataFrame, votes: DataFrame, authority: DataFrame, as_of: str) -> DataFrame:
    """scored (pages joined to query_id, intent, relevance and phrase) with the eleven signals, 0 to 1, rounded, and their weighted sum quality. Votes and authority (domain, bonus) are joined by domain; reliability, semantic and originality are read if there, else neutral."""
    df = scored.join(votes.select("domain", F.col("positive").alias("__p"), F.col("neutral").alias("__u"), F.col("negative").alias("__n")), "domain", "left").join(authority.select("domain", F.col("bonus").alias("__a")), "domain", "left")
    age = (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("published_at")) / 86_400.0
    fresh = F.when(age.isNull(), 0.5).when(age <= 1, 1.0).when(age <= 3, 0.9).when(age <= 7, 0.78).when(age <= 30, 0.6).when(age <= 180, 0.38).when(age <= 365, 0.18).otherwise(0.04)
    fresh = F.when((F.col("intent") == "NEWS") & (fresh >= 0.9), F.least(F.lit(1.0), fresh * 1.08)).otherwise(fresh)
    flag = lambda test, n: F.when(test, n).otherwise(0.0)
    pos, neg = F.coalesce("__p", F.lit(0)), F.coalesce("__n", F.lit(0))
    community = F.when((pos + neg + F.coalesce("__u", F.lit(0)) < 5) | (pos + neg == 0), 0.5).otherwise(F.try_divide(pos, pos + neg))
    engaged = tier(F.col("ctr"), [(8, 0.6), (5, 0.4), (2, 0.2)], 0.0) + tier(F.col("dwell_ms"), [(3000, 0.5), (1500, 0.3), (500, 0.1)], 0.0) + tier(F.col("comment_count"), [(50, 0.4), (10, 0.2)], 0.0, over=True)
    ads = F.coalesce("ad_count", F.lit(0))
    free = under(ads, [(1, 1.0), (2, 0.75), (3, 0.5), (4, 0.28), (5, 0.1)], 0.0)
    free = F.greatest(F.lit(0.0), free - F.coalesce("affiliate_malus", F.lit(0)) / 20.0)
    free = F.greatest(F.lit(0.0), free - F.coalesce("ad_malus", F.lit(0)) / 25.0)
    free = F.when(F.col("relevance") < 30, F.least(F.lit(0.15), free)).when(F.col("relevance") < 40, F.least(F.lit(0.35), free)).otherwise(free)
    load = F.coalesce("load_ms", F.lit(0.0))
    ux = flag(yes("mobile_friendly"), 0.35) + flag(yes("secure"), 0.2) + F.when(load <= 0, 0.0).when(load < 800, 0.45).when(load < 2000, 0.25).when(load < 3500, 0.05).when(load > 3500, -0.2).otherwise(0.0)
    built = flag(yes("has_table"), 0.32) + flag(yes("has_steps"), 0.32) + flag(F.col("image_count") >= 5, 0.18) + flag(F.col("video_count") > 0, 0.18) + flag(F.col("internal_link_density") >= 0.1, 0.08)
    spam = flag(F.col("spam_score") >= 50, 0.3) if "spam_score" in scored.columns else F.lit(0.0)
    authority_ = F.coalesce(F.greatest(F.lit(0.0), F.col("domain_trust") - spam), F.least(F.lit(1.0), F.coalesce("__a", F.lit(0)) / 10.0))
    own = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in scored.columns else F.lit(d)
    signals = {
        "freshness": fresh, "phrase": (F.col("phrase") + 3) / 18.0, "community": community, "engagement": engaged / 1.5, "ad_free": free, "ux": ux, "structure": built,
        "authority": authority_, "reliability": (own("reliability_net", 0.0) + 5) / 10.0, "semantic": own("semantic_score", 0.0), "originality": own("originality_score", 0.5),
    }
    df = df.withColumns({f"s_{k}": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double"))), 6) for k, v in signals.items()})
    return df.withColumn("quality", sum((F.col(f"s_{k}") * w for k, w in SIGNALS.items()), F.lit(0.0))).drop("__p", "__u", "__n", "__a")


def final_score(signals: DataFrame) -> DataFrame:
    """signals (with trust_score, relevance, quality and the weights) with final_score, 0 to 100. Product pages count a fifth of their quality unless the query is commercial or names a brand (brand, if there); quality is capped where relevance is low. click_bonus and personal_boost add, mismatch_penalty and paywall_penalty take away, where these columns are there."""
    product = (F.col("category") == "shop") | F.lower("url").rlike(r"/products?/")
    if "brand" in signals.columns:
        product &= F.col("brand").isNull()
    quality = F.col("quality") * F.col("w_quality") * F.when((F.col("intent") != "COMMERCIAL") & product, 0.2).otherwise(1.0)
    quality = F.when(F.col("relevance") < 50, F.least(F.lit(8.0), quality)).when(F.col("relevance") < 65, F.least(F.lit(12.0), quality)).otherwise(quality)
    square = lambda c: F.col(c) / 100.0 * (F.col(c) / 100.0)
    extra = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("click_bonus", "personal_boost") if c in signals.columns), F.lit(0)) - sum((F.coalesce(F.col(c), F.lit(0)) for c in ("mismatch_penalty", "paywall_penalty") if c in signals.columns), F.lit(0))
    raw = square("trust_score") * F.col("w_trust") + square("relevance") * F.col("w_relevance") + quality + extra
    return signals.withColumn("final_score", F.greatest(F.lit(0), F.least(F.lit(100), half_up(F.round(raw, 6)))))


def ranked(scored: DataFrame) -> DataFrame:
    """scored with rank by final_score within each query (ties by url)."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), "url")))


def mark_best(ranking: DataFrame) -> DataFrame:
    return ranking.withColumn("best_match", (F.col("rank") == 1) & (F.col("final_score") > 65) & (F.col("trust_score") > 70))


def min_score_filter(ranking: DataFrame, least: int = 35, survivors: int = 3) -> DataFrame:
    """Rows of least points and more, for queries that have enough of them; else all rows."""
    n = F.sum(F.when(F.col("final_score") >= least, 1).otherwise(0)).over(Window.partitionBy("query_id"))
    return ranking.withColumn("__n", n).where((F.col("__n") < survivors) | (F.col("final_score") >= least)).drop("__n")


def named_brand(queries: DataFrame) -> DataFrame:
    """queries with brand: a domain in the query or after site:, which no ranking is needed for."""
    named, site = _named(F.trim(F.lower("query")))
    return queries.withColumn("brand", F.coalesce(named, site))


def _named(q: Column) -> tuple[Column, Column]:
    named = F.nullif(F.regexp_extract(q, r"([a-z0-9-]+\.(?:de|com|org|net|at|ch|io|eu|gov|edu))(?:[^a-z0-9_]|$)", 1), F.lit(""))
    return named, F.when(q.startswith("site:"), F.regexp_extract(q, r"^site:\s*([^\s/]+)", 1))


def detect_brand(queries: DataFrame, ranking: DataFrame) -> DataFrame:
    """(query_id, brand, reason): a domain in the query, a site: operator, or a family with five of the first twenty results whose first label is a word of the query."""
    top = ranking.where("rank <= 20").withColumn("family", domain_family(host(F.col("url"))))
    counts = top.groupBy("query_id", "family").agg(F.count("*").alias("n"))
    best = counts.groupBy("query_id").agg(F.max_by("family", F.struct("n", "family")).alias("family"), F.max("n").alias("n"), F.sum("n").alias("all"))
    q = F.trim(F.lower("query"))
    named, site = _named(q)
    label = F.substring_index("family", ".", 1)
    word = (F.col("all") >= 5) & (F.length(label) >= 3) & (F.col("n") >= 5) & F.array_contains(F.split(q, r"\s+"), label)
    out = queries.join(best, "query_id", "left")
    return out.select("query_id", F.coalesce(named, site, F.when(word, F.col("family"))).alias("brand"), F.when(named.isNotNull(), "domain in query").when(site.isNotNull(), "site operator").when(word, "domain word in query").alias("reason"))


def homepage_boost(ranking: DataFrame, brands: DataFrame) -> DataFrame:
    """ranking with 20 points more, 100 at most, for home pages of brand queries."""
    home = F.regexp_extract("url", r"^https?://[^/?#]+(/?)(?:[?#].*)?$", 0) != ""
    out = ranking.join(brands.select("query_id", "brand"), "query_id", "left")
    return out.withColumn("final_score", F.when(F.col("brand").isNotNull() & home, F.least(F.lit(100), F.col("final_score") + 20)).otherwise(F.col("final_score"))).drop("brand")


def diversify(ranking: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """ranking (query_id, intent, url, final_score) with the rows that a pass down each query's list keeps, and their new rank. A row is passed over while fewer than ten are kept and its domain family has reached its limit for the top, or once the family has reached its limit in all. Passed rows don't return but later ones may come. Queries that have a brand in brands keep all rows.

    While fewer than ten are kept, a family loses rows by its top limit only, so the first ten of all rows within that limit of their family are kept. After the place of the tenth, a family takes what its whole limit leaves. Both are ranks within families, so that no list is gathered.
    """
    pick = lambda i: F.coalesce(*(F.when(F.col("intent") == k, v[i]) for k, v in FAMILY_LIMITS.items()), F.lit(DEFAULT_LIMITS[i]))
    rows = ranking.drop("rank")
    if brands is not None:
        rows = rows.join(brands.where("brand is not null").select("query_id", F.lit(True).alias("__all")), "query_id", "left")
    free = yes("__all") if brands is not None else F.lit(False)
    rows = rows.withColumns({"__r": F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), "url")), "__family": domain_family(host(F.col("url"))), "__top": pick(0), "__most": pick(1), "__free": free})
    family = Window.partitionBy("query_id", "__family")
    rows = rows.withColumn("__rf", F.row_number().over(family.orderBy("__r")))
    tops = rows.where("__rf <= __top").withColumn("__k", F.row_number().over(Window.partitionBy("query_id").orderBy("__r"))).where(F.col("__k") <= TOP_SIZE)
    ends = tops.groupBy("query_id").agg(F.max(F.when(F.col("__k") == TOP_SIZE, F.col("__r"))).alias("__end"))
    rows = rows.join(ends, "query_id", "left")
    in_top = (F.col("__rf") <= F.col("__top")) & (F.col("__end").isNull() | (F.col("__r") <= F.col("__end")))
    rows = rows.withColumns({"__in": in_top, "__after": F.coalesce(F.col("__r") > F.col("__end"), F.lit(False))})
    rows = rows.withColumn("__had", F.sum(F.col("__in").cast("int")).over(family)).withColumn("__ra", F.row_number().over(Window.partitionBy("query_id", "__family", "__after").orderBy("__r")))
    kept = rows.where(F.col("__free") | F.col("__in") | (F.col("__after") & (F.col("__had") + F.col("__ra") <= F.col("__most"))))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("__r"))).select(*(c for c in ranking.columns if c != "rank"), "rank")


def diversity_index(ranking: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, n_families, score, level): normalised Herfindahl index of the families of the first n rows."""
    top = ranking.where(F.col("rank") <= n).withColumn("family", domain_family(host(F.col("url"))))
    counts = top.groupBy("query_id", "family").agg(F.count("*").alias("c"))
    sums = counts.groupBy("query_id").agg(F.count("*").alias("n_families"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    score = F.least(F.lit(1.0), (F.col("sq") / (F.col("n") * F.col("n")) - 1.0 / F.col("n")) / (1 - 1.0 / F.col("n") + 0.0001))
    return sums.select("query_id", "n_families", score.alias("s")).select("query_id", "n_families", (half_up(F.round(F.col("s") * 100, 6)) / 100).alias("score"), under(F.round("s", 6), [(0.10, "high"), (0.25, "good"), (0.45, "medium"), (0.65, "low")], "very low").alias("level"))


def dominant_domain(ranking: DataFrame, share: float = 0.7) -> DataFrame:
    """(query_id, dominated): one family has 70 percent of the first twenty of five or more rows."""
    counts = ranking.where("rank <= 20").groupBy("query_id", domain_family(host(F.col("url"))).alias("family")).agg(F.count("*").alias("c"))
    return counts.groupBy("query_id").agg((F.sum("c") >= 5) & (F.max("c") >= share * F.sum("c"))).toDF("query_id", "dominated")


def personalise(ranking: DataFrame, interests: DataFrame) -> DataFrame:
    """ranking (with user_id and domain) with personal_boost: 15 for a liked domain, 5 or 3 for a category liked five or two times."""
    liked = interests.select("user_id", "domain").distinct().withColumn("liked", F.lit(True))
    often = interests.groupBy("user_id", "category").agg(F.sum("times").alias("often")) if "category" in interests.columns else None
    out = ranking.join(liked, ["user_id", "domain"], "left")
    boost = F.when(yes("liked"), 15).otherwise(0)
    if often is not None:
        out = out.join(often, ["user_id", "category"], "left")
        boost = boost + tier(F.col("often"), [(5, 5), (2, 3)])
    return out.withColumn("personal_boost", boost).drop("liked", "often")


def apply_paywall(ranking: DataFrame, reported: DataFrame, penalty: int = 12) -> DataFrame:
    """ranking (with domain) with final_score less the penalty where the page or its domain has a paywall."""
    out = ranking.join(reported.select("domain", F.lit(True).alias("__wall")).distinct(), "domain", "left")
    return out.withColumn("final_score", F.when(yes("has_paywall") | yes("__wall"), F.greatest(F.lit(0), F.col("final_score") - penalty)).otherwise(F.col("final_score"))).drop("__wall")


def page_of(ranking: DataFrame, n: int, size: int = 10) -> DataFrame:
    return ranking.where(F.col("rank").between((n - 1) * size + 1, n * size))


def highlight(text: Column, terms: Column) -> Column:
    """text with every occurrence of a term longer than two characters, in any case, put into <mark>."""
    escaped = F.transform(F.filter(terms, lambda t: F.length(t) > 2), lambda t: F.regexp_replace(t, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    pattern = F.concat(F.lit("(?i)("), F.array_join(escaped, "|"), F.lit(")"))
    return F.when(F.size(escaped) > 0, F.regexp_replace(text, pattern, F.lit("<mark>$1</mark>"))).otherwise(text)


def semantic_scores(query_vectors: DataFrame, page_vectors: DataFrame, block: int = 5_000, choose: Choice | None = None) -> DataFrame:
    """(query_id, page_id, score): dot products of unit vectors, stretched to 0 to 1, of the stated queries with all pages, or with those that choose keeps. Tasks hold a block of so many queries at a time; a query is not compared with the page of its own id."""
    s = dots(page_vectors.select(F.col("page_id").alias("id"), F.col("embedding").alias("v")), query_vectors.select(F.col("query_id").alias("other_id"), F.col("embedding").alias("o")), block, choose)
    return s.select(F.col("other_id").alias("query_id"), F.col("id").alias("page_id"), stretched(F.col("dot")).alias("score"))


def stretched_products(s: np.ndarray) -> np.ndarray:
    """stretched before it is rounded."""
    return np.clip(np.where(s >= 0.65, (s - 0.65) / 0.35, np.maximum(0.1, s / 0.65 * 0.5)), 0, 1)


def stretched(s: Column) -> Column:
    """A dot product of unit vectors as a score from 0 to 1, to four places: 0.65 and more fills the whole range."""
    score = F.when(s >= 0.65, (s - 0.65) / 0.35).otherwise(F.greatest(F.lit(0.1), s / 0.65 * 0.5))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def pair_similarity(pairs: DataFrame, query_vectors: DataFrame, page_vectors: DataFrame) -> DataFrame:
    """(query_id, page_id, semantic_score) of given pairs whose vectors have one length; only their own vectors are joined to them."""
    both = pairs.select("query_id", "page_id").join(query_vectors.select("query_id", F.col("embedding").alias("qv")), "query_id").join(page_vectors.select("page_id", F.col("embedding").alias("pv")), "page_id")
    dot = F.aggregate(F.zip_with("qv", "pv", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return both.where(F.size("qv") == F.size("pv")).withColumn("s", dot).select("query_id", "page_id", stretched(F.col("s")).alias("semantic_score"))


def semantic_top(query_vectors: DataFrame, page_vectors: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, page_id, score, rank): the n best pages for each query by semantic_scores, equal ones by page_id. Every task keeps n rows of a query before anything is shuffled."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id")
    return semantic_scores(query_vectors, page_vectors, choose=best(n, stretched_products)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
