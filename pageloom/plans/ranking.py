"""Queries that rank pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pageloom.functions.tables import materialised
from pageloom.operators import links as L
from pageloom.operators import page_scores as P
from pageloom.operators import postings as P2
from pageloom.operators import ranking as R
from pageloom.operators.similarity import originality
from pageloom.operators.topics import PENALTIES, Topic, score_category_mismatch
from pageloom.operators.votes import user_interests
from pageloom.plans import pages as G
from pageloom.sources import views as v
from pageloom.sources.views import AS_OF, with_views

TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"
STOP = "[" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + "]"


def terms(spark, d):
    return R.classify_intent(R.query_terms(v.v_queries(spark, d)))


def synonyms(spark):
    return spark.createDataFrame([(["the", "a", "les"],), (["nicht", "kein"],), (["zzqx", "the"],)], "terms array<string>")


def index(spark, d):
    return R.term_index(v.v_pages(spark, d))


def asked(spark, d):
    return R.classify_intent(R.query_terms(v.v_asked(spark, d)))


def query_profiles(spark, d):
    return R.weights(R.is_question(R.classify_search_type(asked(spark, d)))).select("query_id", F.array_join("terms", " ").alias("terms"), "intent", "search_type", "is_question", "profile", "w_trust", "w_relevance", "w_quality")


def expanded_terms(spark, d):
    return R.expand_terms(asked(spark, d), synonyms(spark)).select("query_id", F.array_join("expanded", " ").alias("expanded"))


def term_counts(spark, d):
    return index(spark, d).groupBy("term").agg(F.count("*").alias("n_pages"), F.sum("n_title").alias("in_titles"), F.sum("n_content").alias("in_contents"))


def candidate_pages(spark, d):
    return R.candidates(terms(spark, d), index(spark, d))


def top_candidates(spark, d):
    """The best forty pages for what users asked first in each conversation, and for the stated queries."""
    both = asked(spark, d).select(F.concat(F.lit("c"), F.col("query_id").cast("string")).alias("query_id"), "terms").unionByName(terms(spark, d).select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("query_id"), "terms"))
    return P2.top_candidates(both, P2.stored_postings(index(spark, d), 512), 40)


def keyword_filtered(spark, d):
    return R.keyword_filter(R.expand_terms(terms(spark, d), synonyms(spark)), index(spark, d))


def relevance_scores(spark, d):
    return R.score_relevance(terms(spark, d), v.v_pages(spark, d), index(spark, d), AS_OF)


def first_results(fit, pages):
    """Pages that pass the keyword filter, in the order of their ids, as results that tell a query's intent."""
    rows = fit.join(pages.select("page_id", "category"), "page_id")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("page_id"))).where("rank <= 5")


def corrected_intents(spark, d):
    """Intents and weights of the stated queries after a look at their results."""
    asked = terms(spark, d)
    meant = R.correct_intent(asked, first_results(keyword_filtered(spark, d), v.v_pages(spark, d)))
    return R.weights(meant).join(asked.select("query_id", F.col("intent").alias("intent_before")), "query_id").select("query_id", "intent_before", "intent", "profile", "w_trust", "w_relevance", "w_quality")


def signals(spark, d):
    pages, votes = v.v_pages(spark, d), v.v_domain_votes(spark, d)
    scored = materialised(P.score_affiliate(P.score_ad_density(materialised(P.hard_block(P.score_spam(P.score_trust(pages))), "page-scores"), votes)), "scored-pages").drop("__pos", "__neg")
    asked, terms_of_pages = materialised(R.expand_terms(terms(spark, d), synonyms(spark)), "asked"), materialised(index(spark, d), "term-index")
    fit = materialised(R.keyword_filter(asked, terms_of_pages), "keyword-filtered")
    meant = materialised(R.correct_intent(asked, first_results(fit, pages)), "meant")
    q = R.named_brand(R.weights(meant)).select("brand", "query_id", "query", "intent", "w_trust", "w_relevance", "w_quality")
    rel = materialised(R.score_relevance(meant.drop("expanded"), pages, terms_of_pages, AS_OF, fit), "relevance")
    authority = L.domain_authority(v.v_edges(spark, d))
    vectors = v.read(spark, d, "embeddings")
    near = R.pair_similarity(rel, vectors.withColumnRenamed("vec_id", "query_id"), vectors.withColumnRenamed("vec_id", "page_id"))
    pairs = rel.join(scored, "page_id").join(q, "query_id").withColumn("tags", F.lit(None).cast("array<string>"))
    pairs = pairs.join(near, ["query_id", "page_id"], "left").join(originality(pages), "page_id", "left").join(G.source_reliability(spark, d).select("page_id", "reliability_net"), "page_id", "left")
    fitting = score_category_mismatch(pairs, TOPICS).drop("tags", "topic", "mismatch_reason")
    return materialised(R.quality_signals(fitting, votes, authority, AS_OF), "signals")


def quality_signals(spark, d):
    return signals(spark, d).select("query_id", "page_id", *(f"s_{k}" for k in R.SIGNALS), F.round("quality", 6).alias("quality"))


def ranking(spark, d):
    return materialised(R.ranked(R.final_score(signals(spark, d))), "ranking")


def final_ranking(spark, d):
    walled = v.v_pages(spark, d).where("page_id % 20 = 7").select("domain").distinct()
    first = ranking(spark, d).drop("brand")
    brands = R.detect_brand(v.v_queries(spark, d), first)
    ranked = R.ranked(R.apply_paywall(R.homepage_boost(first.drop("rank"), brands), walled))
    best = R.mark_best(R.min_score_filter(R.diversify(ranked, brands)))
    return best.select("query_id", "page_id", "url", "final_score", "rank", "best_match")


def diversity(spark, d):
    rows = ranking(spark, d)
    return R.diversity_index(rows).join(R.dominant_domain(rows), "query_id")


def refined_intents(spark, d):
    return R.refine_intent(ranking(spark, d))


def first_page(spark, d):
    q = terms(spark, d).select("query_id", "terms")
    return R.page_of(ranking(spark, d), 1).join(q, "query_id").select("query_id", "rank", "url", R.highlight(F.col("title"), F.col("terms")).alias("marked_title"))


# Three topics; a user gives their own list.
TOPICS = [
    Topic("finance", "finanzen geld bank kredit aktie steuer versicherung rente depot fonds etf zinsen dax preis".split(), ["boerse-finanzen", "wirtschaft-business", "immobilien"], ["sport", "fussball", "automotive", "rezepte-kochen"], ["gesundheit-medizin", "reise-tourismus", "politik-gesellschaft"], ["technik-digitales", "nachrichten", "weitere"]),
    Topic("technology", "smartphone laptop computer software app ki ai internet android windows linux chip".split(), ["technik-digitales", "software-ki", "bildung-wissenschaft"], ["rezepte-kochen", "fussball", "sport"], ["reise-tourismus", "kultur-medien"], ["gesundheit-medizin", "weitere", "nachrichten"]),
    Topic("travel", "reise urlaub hotel flug strand ferien mietwagen".split(), ["reise-tourismus", "verkehr-transport"], ["automotive", "fussball", "sport", "boerse-finanzen"], ["technik-digitales", "gesundheit-medizin"], ["bildung-wissenschaft", "weitere", "nachrichten"]),
]
SLUGS = sorted({x for t in TOPICS for x in (*t.allowed, *t.strong, *t.medium, *t.weak)} | {"haushalt"})


def category_mismatches(spark, d):
    """What users asked first against three pages each, whose categories and tags follow their ids."""
    slugs, at = F.array(*map(F.lit, SLUGS)), lambda e: (F.expr(e) % len(SLUGS) + 1).cast("int")
    pages = v.read(spark, d, "pages").select("page_id", F.element_at(slugs, at("page_id")).alias("category"), F.when(F.col("page_id") % 3 > 0, F.array(F.element_at(slugs, at("page_id * 7 + 1")), F.element_at(slugs, at("page_id * 5 + 2")))).alias("tags"))
    asked = v.v_asked(spark, d).select("query_id", "query", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    pairs = asked.join(pages, F.col("page_id") == F.col("query_id") + F.col("i"))
    return score_category_mismatch(pairs, TOPICS).select("query_id", "page_id", "topic", "mismatch_penalty", "mismatch_reason")


def semantic_scores(spark, d):
    e = v.read(spark, d, "embeddings")
    return R.semantic_scores(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("page_id"), "embedding"))


def personalised(spark, d):
    """Every user that liked pages asks one of the stated queries; likes are sign-ups and purchases on the page of the event's number."""
    pages = v.v_pages(spark, d).select(F.col("page_id").alias("k"), "domain", "category")
    votes = v.v_events(spark, d).where(F.col("event_type").isin("signup", "purchase")).join(pages, "k").select(F.col("event_id").alias("id"), "user_id", "domain", "category", F.lit(1).alias("value"), F.col("ts").alias("created_at"))
    interests = materialised(user_interests(votes), "interests")
    asking = interests.select("user_id", (F.col("user_id") % 12 + 1).alias("query_id")).distinct()
    scored = R.final_score(R.personalise(signals(spark, d).join(asking, "query_id"), interests))
    place = F.row_number().over(Window.partitionBy("user_id", "query_id").orderBy(F.desc("final_score"), "url"))
    return scored.select("user_id", "query_id", "page_id", "personal_boost", "final_score", place.alias("rank"))


def semantic_top(spark, d):
    e = v.read(spark, d, "embeddings")
    return R.semantic_top(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("page_id"), "embedding"))


def brand_queries(spark, d):
    return R.detect_brand(v.v_queries(spark, d), ranking(spark, d))


def _in(values):
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def _mismatch_sql(t):
    tag = lambda names: f"list_has_any(tags, {_in(names)})"
    own = "CASE " + " ".join(f"WHEN list_contains({_in(getattr(t, level))}, category) THEN {points}" for level, points in PENALTIES.items()) + " END"
    eased = "CASE " + " ".join(f"WHEN {tag(getattr(t, level))} THEN {points}" for level, points in reversed(PENALTIES.items())) + " END"
    test = f"len(list_filter({_in(t.terms)}, lambda x: contains(q, x))) > 0"
    return f"SELECT *, '{t.name}' AS topic, CASE WHEN list_contains({_in(t.allowed)}, category) THEN 'category allowed' WHEN {tag(t.allowed)} THEN 'tag allowed' END AS ok, {own} AS own, {eased} AS eased FROM pairs WHERE {test}"


def _mismatch_case(q):
    """The penalty of a category without tags."""
    own = lambda t: "CASE " + " ".join(f"WHEN list_contains({_in(getattr(t, level))}, category) THEN {points}" for level, points in PENALTIES.items()) + " ELSE 0 END"
    return "CASE " + " ".join(f"WHEN len(list_filter({_in(t.terms)}, lambda x: contains({q}, x))) > 0 THEN CASE WHEN list_contains({_in(t.allowed)}, category) THEN 0 ELSE {own(t)} END" for t in TOPICS) + " ELSE 0 END"


MISMATCHES = with_views("", "v_asked").rstrip() + f""",
pairs AS (SELECT query_id, page_id, query AS q, {_in(SLUGS)}[CAST(page_id % {len(SLUGS)} + 1 AS INT)] AS category,
    CASE WHEN page_id % 3 > 0 THEN [{_in(SLUGS)}[CAST((page_id * 7 + 1) % {len(SLUGS)} + 1 AS INT)], {_in(SLUGS)}[CAST((page_id * 5 + 2) % {len(SLUGS)} + 1 AS INT)]] ELSE [] END AS tags
  FROM v_asked JOIN (SELECT unnest([0, 1, 2]) AS i) ON true JOIN pages ON page_id = query_id + i),
hit AS ({' UNION ALL '.join(f'SELECT {k} AS k, * FROM ({_mismatch_sql(t)})' for k, t in enumerate(TOPICS))}),
first AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY k) AS f FROM hit)
SELECT p.query_id, p.page_id, topic, CASE WHEN topic IS NULL OR ok IS NOT NULL OR own IS NULL THEN 0 ELSE least(own, coalesce(eased, own)) END AS mismatch_penalty,
  CASE WHEN topic IS NULL THEN 'no topic' WHEN ok IS NOT NULL THEN ok WHEN own IS NULL THEN 'category in no list' WHEN eased < own THEN 'mismatch eased by tag' ELSE 'mismatch' END AS mismatch_reason
FROM pairs p LEFT JOIN first h ON h.query_id = p.query_id AND h.page_id = p.page_id AND f = 1"""
INTENT = "CASE " + " ".join(f"WHEN regexp_matches(query, '{p}') THEN '{n}'" for n, p in R.INTENTS) + " ELSE 'GENERAL' END"
TERMS = f"terms AS (SELECT query_id, query, list_filter(list_filter(string_split_regex(trim(lower(query)), '\\s+'), lambda w: w <> ''), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w)) AS terms, {INTENT} AS intent FROM v_queries)"
INDEX = f"""said AS (SELECT page_id, unnest({TOKENS.format('content')}) AS term, 0 AS t FROM v_pages UNION ALL SELECT page_id, unnest({TOKENS.format('title')}), 1 FROM v_pages),
idx AS (SELECT term, page_id, sum(t) AS n_title, count(*) FILTER (WHERE t = 0) AS n_content FROM said WHERE length(term) > 2 GROUP BY 1, 2)"""
SEARCH = with_views("", "v_pages", "v_queries").rstrip() + ",\n" + TERMS + ",\n" + INDEX
ASKED = with_views("", "v_asked").rstrip() + ",\n" + TERMS.replace("v_queries", "v_asked")
SYN = "syn AS (SELECT unnest([['the', 'a', 'les'], ['nicht', 'kein'], ['zzqx', 'the']]) AS g)"
EXPANDED = SYN + """, more AS (SELECT query_id, list_distinct(flatten(list(g))) AS m FROM (SELECT query_id, unnest(terms) AS term FROM terms) JOIN syn ON list_contains(g, term) GROUP BY 1),
expanded AS (SELECT query_id, terms, list_sort(list_distinct(list_concat(terms, coalesce(m, [])))) AS expanded FROM terms LEFT JOIN more USING (query_id))"""
FILTERED = """one AS (SELECT DISTINCT query_id, page_id FROM (SELECT query_id, unnest(expanded) AS term FROM expanded WHERE len(terms) = 1) JOIN idx USING (term) WHERE n_title > 0 OR n_content >= 3),
many AS (SELECT query_id, page_id FROM (SELECT query_id, len(list_distinct(terms)) AS need, unnest(list_distinct(terms)) AS term FROM terms WHERE len(terms) >= 2) JOIN idx USING (term) GROUP BY query_id, page_id, need HAVING count(*) = need AND bool_or(n_title > 0 OR n_content >= 2)),
filtered AS (SELECT * FROM one UNION ALL SELECT * FROM many)"""
BY_CATEGORY = "CASE lower(category) " + " ".join(f"WHEN '{c}' THEN '{i}'" for c, i in R.INTENT_OF_CATEGORY.items()) + " END"
#: terms with the intent that a query's results tell.
MEANT = f"""told AS (SELECT query_id, {BY_CATEGORY} AS told FROM (SELECT query_id, category, count(*) AS n FROM (SELECT query_id, category, row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS i FROM filtered JOIN (SELECT page_id, category FROM v_pages) USING (page_id)) WHERE i <= 5 GROUP BY 1, 2) WHERE n >= 3),
meant AS (SELECT terms.* REPLACE (CASE WHEN intent IN ({', '.join(f"'{i}'" for i in R.PROTECTED_INTENTS)}) THEN intent ELSE coalesce(told, intent) END AS intent) FROM terms LEFT JOIN told USING (query_id))"""
HOST = r"nullif(regexp_replace(lower(regexp_extract({}, '(?i)^https?://([^/?#:]+)', 1)), '^www\.', ''), '')"
AGE = f"(epoch(TIMESTAMP '{AS_OF}') - epoch(published_at)) / 86400"
RELEVANCE = f"""hits AS (
  SELECT query_id, page_id, sum(CASE WHEN n_title > 0 THEN 20 ELSE 0 END + CASE WHEN n_content >= 2 THEN 5 ELSE 0 END) AS points, count(*) FILTER (WHERE length(term) > 3 AND (n_title > 0 OR n_content >= 2)) AS n_core, count(*) AS n_found, count(*) FILTER (WHERE n_title > 0) AS n_title
  FROM (SELECT query_id, unnest(list_distinct(terms)) AS term FROM terms) JOIN idx USING (term) GROUP BY 1, 2),
qp AS (SELECT *, trim(lower(query)) AS q, lower(title) AS lt, lower(content) AS lc, len(list_distinct(terms)) AS n_terms, greatest(1, len(list_filter(terms, lambda t: length(t) > 3))) AS core, len(list_filter(terms, lambda t: regexp_matches(t, '{R.IT_QUERY}'))) > 0 AND NOT regexp_matches(lower(content), '{R.IT_CONTENT}') AS astray FROM hits JOIN terms USING (query_id) JOIN v_pages USING (page_id)),
rel AS (
  SELECT query_id, page_id, round(keyword, 4) AS keyword, phrase, CAST(floor(round(least(CAST(CASE WHEN astray THEN {R.IT_CAP} ELSE 100 END AS DOUBLE), keyword + phrase + rest), 6) + 0.5) AS BIGINT) AS relevance
  FROM (SELECT query_id, page_id, astray, greatest(CAST(0 AS DOUBLE), least(CAST(40 AS DOUBLE), CAST(points AS DOUBLE) * CASE WHEN CAST(n_core AS DOUBLE) / core < 1 THEN CAST(0.1 AS DOUBLE) ELSE 1 END - CASE WHEN astray THEN 30 ELSE 0 END)) AS keyword,
    CASE WHEN len(terms) < 2 THEN 0 WHEN contains(lt, q) THEN 15 WHEN len(terms) >= 3 AND len(list_filter(range(1, len(terms)), lambda i: contains(lt, terms[i] || ' ' || terms[i + 1]))) > 0 THEN 12
      WHEN contains(lc, q) THEN 10 WHEN n_found < n_terms THEN -3
      WHEN len(list_filter(string_split_regex(lc, '[.!?\\n]+'), lambda s: len(list_intersect({TOKENS.format('s')}, terms)) = n_terms)) > 0 THEN 8 WHEN n_title = n_terms THEN 8
      WHEN length(lc) > 150 AND len(list_filter(range(0, greatest(0, length(lc) - 151) + 1, 30), lambda i: len(list_intersect({TOKENS.format('substring(lc, i + 1, 150)')}, terms)) = n_terms)) > 0 THEN 4 ELSE 0 END AS phrase,
    CASE WHEN word_count > 2000 THEN 15 WHEN word_count > 1000 THEN 12 WHEN word_count > 500 THEN 8 WHEN word_count > 200 THEN 4 ELSE 0 END
    + CASE WHEN intent = 'NEWS' AND {AGE} <= 3 THEN least(15, CASE WHEN {AGE} <= 1 THEN 15 ELSE 14 END + 3) WHEN {AGE} <= 1 THEN 15 WHEN {AGE} <= 3 THEN 14 WHEN {AGE} <= 7 THEN 12 WHEN {AGE} <= 30 THEN 9 WHEN {AGE} <= 180 THEN 5 WHEN {AGE} <= 365 THEN 2 ELSE 0 END
    + least(10, CASE WHEN readability_score >= 70 THEN 15 WHEN readability_score >= 50 THEN 12 WHEN readability_score >= 30 THEN 7 ELSE 0 END + CASE WHEN avg_word_length BETWEEN 3 AND 8 THEN 3 ELSE 0 END + CASE WHEN avg_sentence_length BETWEEN 8 AND 15 THEN 2 ELSE 0 END)
    + least(10, CASE WHEN ctr >= 8 THEN 6 WHEN ctr >= 5 THEN 4 WHEN ctr >= 2 THEN 2 ELSE 0 END + CASE WHEN dwell_ms >= 3000 THEN 5 WHEN dwell_ms >= 1500 THEN 3 WHEN dwell_ms >= 500 THEN 1 ELSE 0 END + CASE WHEN comment_count > 50 THEN 4 WHEN comment_count > 10 THEN 2 ELSE 0 END)
    + least(7, CASE WHEN has_table THEN 4 ELSE 0 END + CASE WHEN has_steps THEN 4 ELSE 0 END + CASE WHEN image_count >= 5 THEN 3 ELSE 0 END + CASE WHEN video_count > 0 THEN 3 ELSE 0 END + CASE WHEN internal_link_density >= 0.1 THEN 2 ELSE 0 END)
    + CASE WHEN (intent = 'INFORMATIONAL' AND (category = 'news' OR word_count > 1000)) OR (intent = 'COMMERCIAL' AND (category = 'shop' OR regexp_matches(lc, 'preis|kaufen|bestellen|angebot'))) OR (intent = 'NEWS' AND category = 'news') THEN 3 ELSE 0 END AS rest
    FROM qp))"""
YMYL, CARS = ("[" + ", ".join(f"'{w}'" for w in ws) + "]" for ws in (R.YMYL_WORDS, R.CAR_WORDS))
PROFILE = f"CASE WHEN list_has_any({TOKENS.format('query')}, {YMYL}) THEN 'YMYL' WHEN list_has_any({TOKENS.format('query')}, {CARS}) THEN 'COMMERCIAL' WHEN intent IN ('YMYL', 'NEWS', 'COMMERCIAL', 'ENTERTAINMENT', 'INFORMATIONAL') THEN intent ELSE 'DEFAULT' END"

FAMILY = "CASE " + " ".join("WHEN name IN (" + ", ".join(f"'{m}'" for m in members.split()) + f") THEN '{family}'" for family, members in L.FAMILIES.items()) + " ELSE name END"
REGISTRABLE = rf"regexp_extract(domain, '([^.]+\.(?:(?:{L.SECOND_LEVEL})\.[a-z]{{2}}|[^.]+))$', 1)"
CLAMP = "round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST({} AS DOUBLE))), 6)"
SIGNAL_SQL = {
    "freshness": f"CASE WHEN intent = 'NEWS' AND {AGE} <= 3 THEN least(1, CASE WHEN {AGE} <= 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END * CAST(1.08 AS DOUBLE)) WHEN {AGE} <= 1 THEN 1.0 WHEN {AGE} <= 3 THEN 0.9 WHEN {AGE} <= 7 THEN 0.78 WHEN {AGE} <= 30 THEN 0.6 WHEN {AGE} <= 180 THEN 0.38 WHEN {AGE} <= 365 THEN 0.18 ELSE 0.04 END",
    "phrase": "CAST(phrase + 3 AS DOUBLE) / 18",
    "community": "CASE WHEN pos + neg + neu < 5 OR pos + neg = 0 THEN 0.5 ELSE CAST(pos AS DOUBLE) / (pos + neg) END",
    "engagement": "CAST(CASE WHEN ctr >= 8 THEN 0.6 WHEN ctr >= 5 THEN 0.4 WHEN ctr >= 2 THEN 0.2 ELSE 0 END + CASE WHEN dwell_ms >= 3000 THEN 0.5 WHEN dwell_ms >= 1500 THEN 0.3 WHEN dwell_ms >= 500 THEN 0.1 ELSE 0 END + CASE WHEN comment_count > 50 THEN 0.4 WHEN comment_count > 10 THEN 0.2 ELSE 0 END AS DOUBLE) / 1.5",
    "ad_free": "CASE WHEN relevance < 30 THEN least(CAST(0.15 AS DOUBLE), free) WHEN relevance < 40 THEN least(CAST(0.35 AS DOUBLE), free) ELSE free END",
    "ux": "CASE WHEN mobile_friendly THEN 0.35 ELSE 0 END + CASE WHEN secure THEN 0.2 ELSE 0 END + CASE WHEN load_ms <= 0 THEN 0 WHEN load_ms < 800 THEN 0.45 WHEN load_ms < 2000 THEN 0.25 WHEN load_ms < 3500 THEN 0.05 WHEN load_ms > 3500 THEN -0.2 ELSE 0 END",
    "structure": "CASE WHEN has_table THEN 0.32 ELSE 0 END + CASE WHEN has_steps THEN 0.32 ELSE 0 END + CASE WHEN image_count >= 5 THEN 0.18 ELSE 0 END + CASE WHEN video_count > 0 THEN 0.18 ELSE 0 END + CASE WHEN internal_link_density >= 0.1 THEN 0.08 ELSE 0 END",
    "authority": "coalesce(greatest(CAST(0 AS DOUBLE), domain_trust - CASE WHEN spam_score >= 50 THEN 0.3 ELSE 0 END), least(CAST(1 AS DOUBLE), CAST(coalesce(authority_bonus, 0) AS DOUBLE) / 10))",
    "reliability": "(coalesce(reliability_net, 0) + 5) / 10", "semantic": "coalesce(semantic_score, 0)", "originality": "coalesce(originality_score, 0.5)",
}
RANKED = (SEARCH + ",\n" + EXPANDED + ",\n" + FILTERED + ",\n" + MEANT + ",\n" + RELEVANCE.replace("JOIN terms USING", "JOIN meant USING") + f""",
{with_views('', 'v_domain_votes', 'v_edges').rstrip().removeprefix('WITH ')},
{G.TRUST}, {G.SPAM},
malus AS ({G.AD_DENSITY}),
aff AS ({G.AFFILIATE}),
auth AS (SELECT domain, CAST(least(10, floor(round(log10(count(*) + 1) * CAST(4.3 AS DOUBLE), 6) + 0.5)) AS BIGINT) AS authority_bonus FROM (SELECT DISTINCT from_url, {{HOST.format('to_url')}} AS domain FROM v_edges WHERE {{HOST.format('from_url')}} <> {{HOST.format('to_url')}}) GROUP BY domain),
kept AS (SELECT * FROM spam WHERE {G.KEPT}),
reliable AS (SELECT page_id, reliability_net FROM ({G.RELIABILITY})),
alike AS (SELECT query_id, page_id, round(greatest(0, least(1, CASE WHEN s >= 0.65 THEN (s - CAST(0.65 AS DOUBLE)) / CAST(0.35 AS DOUBLE) ELSE greatest(CAST(0.1 AS DOUBLE), s / CAST(0.65 AS DOUBLE) * CAST(0.5 AS DOUBLE)) END)), 4) AS semantic_score
  FROM (SELECT f.query_id, f.page_id, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))) AS s FROM filtered f JOIN embeddings a ON a.vec_id = f.query_id JOIN embeddings b ON b.vec_id = f.page_id AND len(a.embedding) = len(b.embedding))),
original AS (SELECT page_id, CASE WHEN page_id = min(page_id) OVER w THEN CAST(1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) / count(*) OVER w END AS originality_score FROM v_pages WINDOW w AS (PARTITION BY {TOKENS.format('title')})),
rows AS (SELECT r.*, k.* EXCLUDE (page_id), t.query, t.intent, {PROFILE} AS profile, coalesce(positive, 0) AS pos, coalesce(negative, 0) AS neg, coalesce(neutral, 0) AS neu, authority_bonus, reliability_net, semantic_score, originality_score,
    greatest(0, greatest(0, CAST(CASE WHEN ad_count < 1 THEN 1 WHEN ad_count < 2 THEN 0.75 WHEN ad_count < 3 THEN 0.5 WHEN ad_count < 4 THEN 0.28 WHEN ad_count < 5 THEN 0.1 ELSE 0 END AS DOUBLE) - CAST(affiliate_malus AS DOUBLE) / 20) - CAST(ad_malus AS DOUBLE) / 25) AS free
  FROM rel r JOIN filtered USING (query_id, page_id) JOIN kept k USING (page_id) JOIN meant t USING (query_id) JOIN malus USING (page_id) JOIN aff USING (page_id) LEFT JOIN v_domain_votes d ON d.domain = k.domain LEFT JOIN auth ON auth.domain = k.domain LEFT JOIN reliable ON reliable.page_id = k.page_id LEFT JOIN alike ON alike.query_id = r.query_id AND alike.page_id = r.page_id LEFT JOIN original ON original.page_id = k.page_id),
sig AS (SELECT *, CASE profile WHEN 'YMYL' THEN 60 WHEN 'NEWS' THEN 30 WHEN 'COMMERCIAL' THEN 30 WHEN 'ENTERTAINMENT' THEN 20 WHEN 'INFORMATIONAL' THEN 35 ELSE 40 END AS w_trust, CASE profile WHEN 'YMYL' THEN 25 WHEN 'NEWS' THEN 30 WHEN 'COMMERCIAL' THEN 40 WHEN 'ENTERTAINMENT' THEN 40 ELSE 35 END AS w_relevance,
    {', '.join(f"{CLAMP.format(e)} AS s_{n}" for n, e in SIGNAL_SQL.items())} FROM rows),
valued AS (SELECT *, {' + '.join(f"s_{n} * CAST({w} AS DOUBLE)" for n, w in R.SIGNALS.items())} AS quality FROM sig),
weighed AS (SELECT *, quality * (100 - w_trust - w_relevance) * CASE WHEN intent <> 'COMMERCIAL' AND (category = 'shop' OR regexp_matches(lower(url), '/products?/')) THEN CAST(0.2 AS DOUBLE) ELSE 1 END AS q0 FROM valued),
final AS (SELECT *, CAST(greatest(0, least(100, floor(round(CAST(trust_score AS DOUBLE) / 100 * CAST(trust_score AS DOUBLE) / 100 * w_trust + CAST(relevance AS DOUBLE) / 100 * CAST(relevance AS DOUBLE) / 100 * w_relevance + CASE WHEN relevance < 50 THEN least(8, q0) WHEN relevance < 65 THEN least(12, q0) ELSE q0 END - {_mismatch_case('query')}, 6) + 0.5))) AS BIGINT) AS final_score FROM weighed),
named AS (SELECT *, coalesce(nullif({REGISTRABLE}, ''), domain) AS name FROM final),
ranked AS (SELECT *, {FAMILY} AS family, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, url) AS rank FROM named)""").replace("{HOST.format('to_url')}", HOST.format("to_url")).replace("{HOST.format('from_url')}", HOST.format("from_url"))
_RAW = RANKED.index("floor(round(", RANKED.index("final AS (SELECT")) + len("floor(round(")
#: The score of a row before it is rounded and cut to 0 to 100.
RAW = RANKED[_RAW : RANKED.index(", 6) + 0.5))) AS BIGINT) AS final_score", _RAW)]
BRANDS = r"""families AS (SELECT query_id, arg_max(family, (n, family)) AS family, max(n) AS n, sum(n) AS total FROM (SELECT query_id, family, count(*) AS n FROM ranked WHERE rank <= 20 GROUP BY 1, 2) GROUP BY 1),
brands AS (SELECT query_id, coalesce(named_, site, CASE WHEN word THEN family END) AS brand, CASE WHEN named_ IS NOT NULL THEN 'domain in query' WHEN site IS NOT NULL THEN 'site operator' WHEN word THEN 'domain word in query' END AS reason
  FROM (SELECT query_id, family, nullif(regexp_extract(lower(query), '([a-z0-9-]+\.(?:de|com|org|net|at|ch|io|eu|gov|edu))(?:[^a-z0-9_]|$)', 1), '') AS named_, CASE WHEN starts_with(query, 'site:') THEN regexp_extract(query, '^site:\s*([^\s/]+)', 1) END AS site,
    total >= 5 AND length(split_part(family, '.', 1)) >= 3 AND n >= 5 AND list_contains(string_split(lower(query), ' '), split_part(family, '.', 1)) AS word FROM v_queries LEFT JOIN families USING (query_id)))""".replace("\\\\", "\\")

SEMANTIC = """SELECT query_id, page_id, round(greatest(0, least(1, CASE WHEN s >= 0.65 THEN (s - CAST(0.65 AS DOUBLE)) / CAST(0.35 AS DOUBLE) ELSE greatest(CAST(0.1 AS DOUBLE), s / CAST(0.65 AS DOUBLE) * CAST(0.5 AS DOUBLE)) END)), 4) AS score
      FROM (SELECT q.vec_id AS query_id, p.vec_id AS page_id, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(p.embedding[i] AS DOUBLE))) AS s FROM embeddings q JOIN embeddings p ON q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id)"""

QUERIES = {
    "query_profiles": (query_profiles, ASKED + f"""
      SELECT *, 100 - w_trust - w_relevance AS w_quality FROM (SELECT *, CASE profile WHEN 'YMYL' THEN 60 WHEN 'NEWS' THEN 30 WHEN 'COMMERCIAL' THEN 30 WHEN 'ENTERTAINMENT' THEN 20 WHEN 'INFORMATIONAL' THEN 35 ELSE 40 END AS w_trust,
        CASE profile WHEN 'YMYL' THEN 25 WHEN 'NEWS' THEN 30 WHEN 'COMMERCIAL' THEN 40 WHEN 'ENTERTAINMENT' THEN 40 ELSE 35 END AS w_relevance
      FROM (SELECT query_id, array_to_string(terms, ' ') AS terms, intent, CASE WHEN regexp_matches(query, '^(wie|was|wer|wo|wann|warum|how|what|who|where|when|why)\\b|\\?$') THEN 'question' WHEN regexp_matches(query, 'kaufen|preis|buy|price|shop') THEN 'shopping' WHEN regexp_matches(query, 'news|aktuell|heute') THEN 'news' ELSE 'general' END AS search_type,
        list_contains(['wer','was','wie','wo','wann','warum','wieso','weshalb','woher','wohin','welche','welcher','welches','who','what','how','where','when','why','which'], string_split(query, ' ')[1]) OR ends_with(query, '?') AS is_question, {PROFILE} AS profile FROM terms))"""),
    "corrected_intents": (corrected_intents, SEARCH + ",\n" + EXPANDED + ",\n" + FILTERED + ",\n" + MEANT + f""" SELECT *, 100 - w_trust - w_relevance AS w_quality FROM (SELECT query_id, intent_before, intent, profile, CASE profile WHEN 'YMYL' THEN 60 WHEN 'NEWS' THEN 30 WHEN 'COMMERCIAL' THEN 30 WHEN 'ENTERTAINMENT' THEN 20 WHEN 'INFORMATIONAL' THEN 35 ELSE 40 END AS w_trust,
      CASE profile WHEN 'YMYL' THEN 25 WHEN 'NEWS' THEN 30 WHEN 'COMMERCIAL' THEN 40 WHEN 'ENTERTAINMENT' THEN 40 ELSE 35 END AS w_relevance FROM (SELECT *, {PROFILE} AS profile FROM meant JOIN (SELECT query_id, intent AS intent_before FROM terms) USING (query_id)))"""),
    "expanded_terms": (expanded_terms, ASKED + ",\n" + EXPANDED + " SELECT query_id, array_to_string(expanded, ' ') AS expanded FROM expanded"),
    "term_counts": (term_counts, SEARCH + " SELECT term, count(*) AS n_pages, CAST(sum(n_title) AS BIGINT) AS in_titles, CAST(sum(n_content) AS BIGINT) AS in_contents FROM idx GROUP BY term"),
    "candidate_pages": (candidate_pages, SEARCH + " SELECT DISTINCT query_id, page_id FROM (SELECT query_id, unnest(terms) AS term FROM terms) JOIN idx USING (term)"),
    "top_candidates": (top_candidates, SEARCH + ",\n" + with_views("", "v_asked").rstrip().removeprefix("WITH ") + f""",
      both_ AS (SELECT 'q' || query_id AS query_id, terms FROM terms UNION ALL SELECT 'c' || query_id, list_filter(list_filter(string_split_regex(trim(lower(query)), '\\s+'), lambda w: w <> ''), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w)) FROM v_asked)
      SELECT query_id, page_id, CAST(points AS INT) AS points, CAST(i AS INT) AS rank FROM (SELECT query_id, page_id, sum(CASE WHEN n_title > 0 THEN 20 ELSE 0 END + CASE WHEN n_content >= 2 THEN 5 ELSE 0 END) AS points, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, page_id) AS i
        FROM (SELECT query_id, unnest(list_distinct(terms)) AS term FROM both_) JOIN idx USING (term) GROUP BY 1, 2) WHERE i <= 40"""),
    "keyword_filtered": (keyword_filtered, SEARCH + ",\n" + EXPANDED + ",\n" + FILTERED + " SELECT * FROM filtered"),
    "relevance_scores": (relevance_scores, SEARCH + ",\n" + RELEVANCE + " SELECT * FROM rel"),
    "quality_signals": (quality_signals, RANKED + f" SELECT query_id, page_id, {', '.join(f's_{n}' for n in R.SIGNALS)}, round(quality, 6) AS quality FROM ranked"),
    "final_ranking": (final_ranking, RANKED.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + BRANDS + r""",
      walled AS (SELECT DISTINCT domain AS wd FROM v_pages WHERE page_id % 20 = 7),
      boosted AS (SELECT r.* EXCLUDE (rank, final_score), brand, CASE WHEN brand IS NOT NULL AND regexp_matches(url, '^https?://[^/?#]+(/?)(?:[?#].*)?$') THEN least(100, final_score + 20) ELSE final_score END AS f FROM ranked r JOIN brands USING (query_id)),
      walked AS (SELECT b.*, CASE WHEN has_paywall OR wd IS NOT NULL THEN greatest(0, f - 12) ELSE f END AS score FROM boosted b LEFT JOIN walled ON wd = domain),
      line AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS i, CASE intent WHEN 'NEWS' THEN 10 WHEN 'COMMERCIAL' THEN 2 WHEN 'INFORMATIONAL' THEN 2 ELSE 3 END AS top, CASE intent WHEN 'NEWS' THEN 20 WHEN 'COMMERCIAL' THEN 3 WHEN 'INFORMATIONAL' THEN 4 ELSE 5 END AS most FROM walked),
      pass AS (SELECT query_id, i, page_id, true AS keep, [family] AS kept FROM line WHERE i = 1
        UNION ALL SELECT query_id, i, page_id, ok, CASE WHEN ok THEN list_append(kept, family) ELSE kept END
        FROM (SELECT l.query_id, l.i, l.page_id, l.family, p.kept, l.brand IS NOT NULL OR NOT ((len(p.kept) < 10 AND len(list_filter(p.kept, lambda x: x = l.family)) >= l.top) OR len(list_filter(p.kept, lambda x: x = l.family)) >= l.most) AS ok FROM pass p JOIN line l ON l.query_id = p.query_id AND l.i = p.i + 1)),
      placed AS (SELECT l.*, row_number() OVER (PARTITION BY query_id ORDER BY l.i) AS rank FROM line l JOIN pass p USING (query_id, page_id) WHERE keep),
      counted AS (SELECT *, count(*) FILTER (WHERE score >= 35) OVER (PARTITION BY query_id) AS n FROM placed)
      SELECT query_id, page_id, url, score AS final_score, CAST(rank AS INT) AS rank, rank = 1 AND score > 65 AND trust_score > 70 AS best_match FROM counted WHERE n < 3 OR score >= 35"""),
    "result_diversity": (diversity, RANKED + """, tops AS (SELECT query_id, count(*) AS n_families, CAST(sum(c) AS DOUBLE) AS n, CAST(sum(c * c) AS DOUBLE) AS sq FROM (SELECT query_id, family, count(*) AS c FROM ranked WHERE rank <= 10 GROUP BY 1, 2) GROUP BY 1),
      herf AS (SELECT query_id, n_families, least(CAST(1 AS DOUBLE), (sq / (n * n) - CAST(1 AS DOUBLE) / n) / (CAST(1 AS DOUBLE) - CAST(1 AS DOUBLE) / n + CAST(0.0001 AS DOUBLE))) AS s FROM tops),
      dom AS (SELECT query_id, sum(c) >= 5 AND max(c) >= CAST(0.7 AS DOUBLE) * sum(c) AS dominated FROM (SELECT query_id, family, count(*) AS c FROM ranked WHERE rank <= 20 GROUP BY 1, 2) GROUP BY 1)
      SELECT query_id, n_families, floor(round(s * 100, 6) + 0.5) / 100 AS score, CASE WHEN round(s, 6) < 0.1 THEN 'high' WHEN round(s, 6) < 0.25 THEN 'good' WHEN round(s, 6) < 0.45 THEN 'medium' WHEN round(s, 6) < 0.65 THEN 'low' ELSE 'very low' END AS level, dominated FROM herf JOIN dom USING (query_id)"""),
    "refined_intents": (refined_intents, RANKED + " SELECT query_id, arg_max(category, (n, category)) AS refined FROM (SELECT query_id, category, count(*) AS n FROM ranked WHERE rank <= 5 GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1"),
    "first_page": (first_page, RANKED + """ SELECT query_id, CAST(rank AS INT) AS rank, url, CASE WHEN len(list_filter(terms, lambda t: length(t) > 2)) > 0 THEN regexp_replace(title, '(' || array_to_string(list_filter(terms, lambda t: length(t) > 2), '|') || ')', '<mark>\\1</mark>', 'gi') ELSE title END AS marked_title FROM ranked JOIN (SELECT query_id, terms FROM terms) USING (query_id) WHERE rank <= 10"""),
    "personalised": (personalised, RANKED + f""", likes AS (SELECT user_id, domain, category, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM (SELECT *, {v.K} AS k FROM events) e JOIN v_pages p ON p.page_id = e.k WHERE event_type IN ('signup', 'purchase')),
      newest AS (SELECT * FROM likes WHERE i <= 100), often AS (SELECT user_id, category, count(*) AS n FROM newest GROUP BY 1, 2),
      boosted AS (SELECT u.user_id, r.*, CASE WHEN (u.user_id, r.domain) IN (SELECT (user_id, domain) FROM newest) THEN 15 ELSE 0 END + CASE WHEN o.n >= 5 THEN 5 WHEN o.n >= 2 THEN 3 ELSE 0 END AS personal_boost
        FROM (SELECT DISTINCT user_id FROM newest) u JOIN ranked r ON r.query_id = u.user_id % 12 + 1 LEFT JOIN often o ON o.user_id = u.user_id AND o.category = r.category),
      scored AS (SELECT * EXCLUDE (final_score), CAST(greatest(0, least(100, floor(round({RAW} + personal_boost, 6) + 0.5))) AS BIGINT) AS final_score FROM boosted)
      SELECT user_id, query_id, page_id, personal_boost, final_score, CAST(row_number() OVER (PARTITION BY user_id, query_id ORDER BY final_score DESC, url) AS INT) AS rank FROM scored"""),
    "brand_queries": (brand_queries, RANKED + ", " + BRANDS + " SELECT * FROM brands"),
    "category_mismatches": (category_mismatches, MISMATCHES),
    "semantic_scores": (semantic_scores, SEMANTIC),
    "semantic_top": (semantic_top, f"SELECT query_id, page_id, score, CAST(i AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS i FROM ({SEMANTIC})) WHERE i <= 10"),
}
