"""Queries over keywords, answers, widget candidates, products, facts and contradictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions.stems import BEFORE_R1, BEFORE_R2, BEFORE_S, BEFORE_ST, VOWELS
from pageloom.operators import answers as A
from pageloom.operators import articles as C
from pageloom.operators import behaviour as B
from pageloom.operators import moderation as M
from pageloom.operators import ranking as R
from pageloom.operators import trends as T
from pageloom.operators import votes as V
from pageloom.plans import posts as S
from pageloom.plans import ranking as K
from pageloom.sources import views as v
from pageloom.sources.views import AS_OF, with_views

#: A time within the events of all tables.
NOW = "2024-01-10 12:00:00"
WORDS = r"string_split_regex(trim(lower({})), '\s+')"


def _list(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def keywords(spark, d):
    """Names of parts as a keyword table, and the names and their first words as queries."""
    part = v.read(spark, d, "part")
    kinds = F.array(*map(F.lit, ("Nachrichten", "Gesundheit", "Onlineshop", "Garten", "Sport & Musik")))
    return part.groupBy(F.col("p_name").alias("keyword")).agg(F.max("p_size").alias("score"), F.min("p_partkey").alias("k")).select("keyword", F.element_at(kinds, (F.col("k") % 5 + 1).cast("int")).alias("category"), "score", "k")


def wanted(spark, d):
    names = keywords(spark, d).select(F.col("k").alias("query_id"), F.col("keyword").alias("query"))
    return names.unionByName(names.groupBy(F.substring_index("query", " ", 1).alias("query")).agg((-1 - F.min("query_id")).alias("query_id")))


KEYWORDS = """kw AS (SELECT keyword, ['Nachrichten', 'Gesundheit', 'Onlineshop', 'Garten', 'Sport & Musik'][CAST(k % 5 + 1 AS INT)] AS category, score, k FROM (SELECT p_name AS keyword, max(p_size) AS score, min(p_partkey) AS k FROM part GROUP BY 1)),
wanted AS (SELECT k AS query_id, keyword AS query FROM kw UNION ALL SELECT -1 - min(k), string_split(keyword, ' ')[1] FROM kw GROUP BY 2)"""


def keyword_lookup(spark, d):
    return A.keyword_lookup(wanted(spark, d), keywords(spark, d))


def single_words(spark, d):
    """The words of all names as keywords of one word."""
    return keywords(spark, d).select(F.explode(F.split("keyword", " ")).alias("keyword"), "category", "score").groupBy("keyword").agg(F.max_by("category", F.struct("score", "category")).alias("category"), F.max("score").alias("score"))


def keyword_intents(spark, d):
    return A.keyword_intent(wanted(spark, d), single_words(spark, d))


def resolved_intents(spark, d):
    return A.resolve_intent(R.classify_intent(wanted(spark, d)), keyword_intents(spark, d)).select("query_id", "intent", "resolved")


INTENT_OF = "CASE " + " ".join(f"WHEN contains(lower(category), '{part}') THEN '{intent}'" for part, intent in A.CATEGORY_INTENTS) + " END"
KEYWORD_INTENTS = KEYWORDS + f""", words AS (SELECT keyword, arg_max(category, (score, category)) AS category, max(score) AS score FROM (SELECT unnest(string_split(keyword, ' ')) AS keyword, category, score FROM kw) GROUP BY 1),
chosen AS (SELECT query_id, keyword, category, {INTENT_OF} AS intent_override FROM (SELECT query_id, keyword, category, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, keyword) AS i
  FROM wanted JOIN words ON list_contains({WORDS.format('query')}[1:4], keyword) OR starts_with(lower(keyword), {WORDS.format('query')}[1])) WHERE i = 1)"""


def answers(spark, d):
    """The first answer of every conversation to what the user said first."""
    said = v.read(spark, d, "conversations").where("role = 'assistant' and text is not null").groupBy("conv_id").agg(F.min_by("text", "turn").alias("answer"))
    return v.v_asked(spark, d).join(said, F.col("query_id") == F.col("conv_id")).select(F.col("conv_id").alias("answer_id"), F.col("query").alias("question"), "answer")


def questions(spark, d):
    """Search queries, and every hundredth question itself."""
    own = answers(spark, d).where("answer_id % 100 = 0").select((F.col("answer_id") + 1000).alias("query_id"), F.col("question").alias("query"))
    return v.v_queries(spark, d).unionByName(own)


def qa_fulltext(spark, d):
    """Every sentence of what users said first, looked up in all questions and answers; a sentence's id is a thousand times its conversation's, plus its place."""
    cut = v.v_asked(spark, d).select("query_id", F.posexplode(F.split("query", r"[.!?]+")).alias("i", "query"))
    return A.qa_fulltext(cut.select((F.col("query_id") * 1000 + F.col("i")).alias("query_id"), "query"), answers(spark, d))


def faq(spark, d):
    """Questions of users and their answers; source, trust and age follow the id."""
    k = F.col("answer_id")
    return answers(spark, d).select(k.alias("faq_id"), F.concat("question", F.when(k % 3 > 0, "?").otherwise("")).alias("question"), "answer", F.substring_index("question", " ", 1).alias("topic"), F.when(k % 4 == 0, "general").otherwise("site").alias("source"), F.nullif(k % 7, F.lit(0)).alias("trust"), (k % 50).alias("created"))


def faq_search(spark, d):
    return A.faq_search(questions(spark, d), faq(spark, d), K.synonyms(spark))


def qa_lookup(spark, d):
    return A.qa_lookup(questions(spark, d), answers(spark, d))


QA = with_views("", "v_asked", "v_queries").rstrip() + f""",
a AS (SELECT query_id AS answer_id, query AS question, answer FROM v_asked JOIN (SELECT conv_id AS query_id, arg_min(text, turn) AS answer FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY 1) USING (query_id)),
asking AS (SELECT query_id, query FROM v_queries UNION ALL SELECT answer_id + 1000, question FROM a WHERE answer_id % 100 = 0),
long AS (SELECT *, list_filter({WORDS.format('query')}, lambda w: length(w) > 2) AS ws FROM asking),
q AS (SELECT *, list_filter(ws, lambda w: NOT list_contains({_list(A.QUESTION_STOP_WORDS)}, w)) AS ts FROM long),
t AS (SELECT query_id, query, CASE WHEN len(ts) > 0 THEN ts ELSE list_filter(ws, lambda w: length(w) > 3) END AS terms FROM q),
e AS (SELECT query_id, min(answer_id) AS answer_id FROM t JOIN a ON lower(query) = lower(question) GROUP BY 1)
SELECT query_id, answer_id, 0 AS tier, 1 AS rank FROM e UNION ALL SELECT query_id, answer_id, 1, CAST(i AS INT) FROM (
  SELECT query_id, answer_id, row_number() OVER (PARTITION BY query_id ORDER BY length(answer), answer_id) AS i FROM t JOIN a ON len(list_filter(terms, lambda w: contains(lower(question), w) OR contains(lower(answer), w))) > 0
  WHERE query_id NOT IN (SELECT query_id FROM e)) WHERE i <= 5"""


def results(spark, d):
    """Pages that pass the keyword filter of each query, in the order of their ids, with a recipe's title on every third one and a section on every seventh."""
    pages, p = v.v_pages(spark, d), F.col("page_id")
    rows = K.keyword_filtered(spark, d).join(pages.select("page_id", "url", "title", "category", "image", "price"), "page_id").join(v.v_queries(spark, d), "query_id")
    rows = rows.withColumns({"title": F.when(p % 3 == 0, F.concat(F.lit("Rezept: "), "title")).when(p % 4 == 1, F.concat(F.lit("Was "), "title", F.lit("?"))).otherwise(F.col("title")), "section": F.when(p % 7 == 0, F.lit("Produkte")), "best_match": p % 11 == 0, "is_fact": p % 13 == 0})
    return A.first_n(rows, ["query_id"], ["page_id"], 2**31 - 1)


RESULTS = K.SEARCH + ",\n" + K.EXPANDED + ",\n" + K.FILTERED + """, results AS (SELECT query_id, query, page_id, url, image, price, category, row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS place, page_id % 11 = 0 AS best_match, page_id % 13 = 0 AS is_fact,
  CASE WHEN page_id % 3 = 0 THEN 'Rezept: ' || title WHEN page_id % 4 = 1 THEN 'Was ' || title || '?' ELSE title END AS title, CASE WHEN page_id % 7 = 0 THEN 'Produkte' END AS section
  FROM filtered JOIN (SELECT page_id, url, title, category, image, price FROM v_pages) USING (page_id) JOIN v_queries USING (query_id))"""
USABLE = "coalesce(length(image) > 10 AND NOT starts_with(image, 'data:'), false)"


def _top(name: str, where: str, n: int) -> str:
    return RESULTS + f" SELECT query_id, page_id, CAST(i AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS i FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_rows FROM results WHERE {where}){' WHERE n_rows >= 3' if name == 'recipe' else ''}) WHERE i <= {n}"


def product_candidates(spark, d):
    return A.product_candidates(results(spark, d)).select("query_id", "page_id", "rank")


def recipe_candidates(spark, d):
    return A.recipe_candidates(results(spark, d)).select("query_id", "page_id", "rank")


def news_candidates(spark, d):
    return A.news_candidates(results(spark, d)).select("query_id", "page_id", "rank")


def faq_fallback(spark, d):
    return A.faq_fallback(results(spark, d).withColumnRenamed("title", "question"))


def thesaurus(spark, d):
    return keywords(spark, d).groupBy(F.substring_index("keyword", " ", -1).alias("key")).agg(F.array_sort(F.collect_set(F.substring_index("keyword", " ", 1))).alias("terms"))


def related_terms(spark, d):
    last = keywords(spark, d).select((F.col("k") + 100_000).alias("query_id"), F.substring_index("keyword", " ", -1).alias("query"))
    return A.related_terms(wanted(spark, d).unionByName(last), thesaurus(spark, d))


RELATED = KEYWORDS + """, th AS (SELECT string_split(keyword, ' ')[-1] AS key, list_sort(list(DISTINCT string_split(keyword, ' ')[1])) AS terms FROM kw GROUP BY 1),
q AS (SELECT query_id, lower(query) AS q FROM wanted UNION ALL SELECT k + 100000, string_split(keyword, ' ')[-1] FROM kw),
e AS (SELECT query_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS rank FROM q JOIN th ON q = key),
n AS (SELECT query_id, key, unnest(terms) AS term, generate_subscripts(terms, 1) AS place FROM q JOIN th ON contains(key, q) OR contains(q, key) WHERE q NOT IN (SELECT key FROM th)),
f AS (SELECT query_id, term, min((key, place)) AS spot FROM n GROUP BY 1, 2)
SELECT query_id, term, CAST(rank AS INT) AS rank FROM e UNION ALL SELECT query_id, term, CAST(i AS INT) FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY spot) AS i FROM f) WHERE i <= 6"""


def inputs(spark, d):
    asked = v.v_asked(spark, d).select(F.lit("query").alias("kind"), F.col("query_id").alias("id"), F.col("query").alias("value"))
    urls = v.read(spark, d, "pages").select(F.lit("url"), "page_id", F.when(F.col("page_id") % 4 == 0, F.substring("url", 3, 500)).otherwise(F.col("url")))
    mails = v.read(spark, d, "customer").select(F.lit("email"), "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("@mail.example.com"))))
    return asked.unionAll(urls).unionAll(mails)


def valid_inputs(spark, d):
    return A.validate_inputs(inputs(spark, d)).select("kind", "id", "valid")


def found_lists(spark, d):
    lists = v.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("description"), F.col("p_type").alias("category"), F.array(F.concat(F.lit("T"), (F.col("p_size") % 9).cast("string"))).alias("tags"))
    asked = keywords(spark, d).select(F.col("k").alias("query_id"), F.substring_index("keyword", " ", -1).alias("query")).groupBy("query").agg(F.min("query_id").alias("query_id"))
    return A.search_lists(lists, asked.unionByName(spark.createDataFrame([("t3", -1), ("BRAND#1", -2)], "query string, query_id long")))


def products(spark, d):
    p = F.col("p_partkey")
    return v.read(spark, d, "part").select(p.alias("product_id"), p.alias("page_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.when(p % 3 == 0, F.concat(F.lit("http://shop.example.com/"), p.cast("string"))).alias("url"), F.when(p % 5 == 0, F.concat(F.lit("http://img.example.com/"), p.cast("string"))).alias("image"), F.when(p % 2 == 0, p % 40).alias("rating_count"))


def product_search(spark, d):
    q = wanted(spark, d).unionByName(spark.createDataFrame([(-1000, "brand#2"), (-1001, "eco")], "query_id long, query string"))
    return A.product_search(q, products(spark, d), v.v_pages(spark, d))


SITES = ("www.heise.de", "Spiegel.de", "amazon.de", "kicker.de", "de.wikipedia.org", "ct.de", "arxiv.org", "www.booking.com")
PATHS = ("https://www.chefkoch.de/rezepte/1", "https://www.kochbar.de/rezept/2", "https://www.Duden.de/rechtschreibung/x")
GOODS = ("100% Bio-Baumwolle, Regular Fit, schwarz und weiß", "Slim fit Print navy blue black", "wasserdicht, grau, rotes Leder", "Logo, atmungsaktiv, rot/grün/red")


def categories(spark, d):
    """Domains and urls of pages, beside known ones."""
    p, pages = F.col("page_id"), v.v_pages(spark, d)
    site = F.when(p % 2 == 0, F.element_at(F.array(*map(F.lit, SITES)), (p % 8 + 1).cast("int"))).otherwise(F.col("domain"))
    url = F.when(p % 5 == 0, F.element_at(F.array(*map(F.lit, PATHS)), (p % 3 + 1).cast("int"))).otherwise(F.col("url"))
    return pages.select("page_id", C.infer_category(site).alias("domain_category"), C.detect_category(url, F.col("category")).alias("url_category"))


DOMAIN_CASE = "CASE " + " ".join(f"WHEN len(list_filter({_list(parts)}, lambda m: contains(lower(site), m))) > 0 THEN '{name}'" for name, parts in C.DOMAIN_CATEGORIES.items()) + " END"
URL_CASE = "CASE " + " ".join(f"WHEN contains(lower(u), '{part}') THEN '{name}'" for part, name in C.URL_CATEGORIES) + " ELSE category END"


def attributes(spark, d):
    p = F.col("page_id")
    text = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, GOODS)), (p % 4 + 1).cast("int")), "title")
    return C.product_attributes(v.v_pages(spark, d).select("page_id", text.alias("text"))).select("page_id", F.array_join("attributes", "|").alias("attributes"), F.array_join("colours", ",").alias("colours"))


def _colours() -> str:
    groups: dict[str, list[str]] = {}
    for name, colour in C.COLOURS.items():
        groups.setdefault(colour, []).append(name)
    word = lambda n: rf"regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_]){n}(?:[^\p{{L}}\p{{N}}_]|$)')"
    return ", ".join("CASE " + " ".join(f"WHEN {word(n)} THEN '{n}'" for n in names) + " END" for names in groups.values())


ATTRIBUTES = rf"""SELECT page_id, array_to_string(list_filter([nullif(regexp_extract(text, '{C.MATERIAL}', 1), ''), nullif(regexp_extract(text, '{C.FIT}', 1), ''), CASE WHEN regexp_matches(text, '{C.PRINTED}') THEN 'Premium Print' END, CASE WHEN regexp_matches(text, '{C.FUNCTIONAL}') THEN 'Funktional' END], lambda x: x IS NOT NULL)[1:3], '|') AS attributes,
  array_to_string(list_filter([{_colours()}], lambda x: x IS NOT NULL)[1:4], ',') AS colours FROM (SELECT page_id, {_list(GOODS)}[CAST(page_id % 4 + 1 AS INT)] || ' ' || title AS text FROM v_pages)"""


def semantic_bonuses(spark, d):
    pairs = K.candidate_pages(spark, d).join(v.v_queries(spark, d), "query_id").join(v.v_pages(spark, d).select("page_id", F.slice(F.split("title", " "), 1, 9).alias("entities")), "page_id")
    return C.semantic_bonus(pairs).select("query_id", "page_id", "bonus")


def reasons(spark, d):
    pages = v.v_pages(spark, d).select("page_id", F.when(F.col("word_count") > 1000, 12).otherwise(4).alias("depth"), (F.col("readability_score") / 7).alias("readability"), F.col("ctr").alias("engagement"), (yes4("has_table") + yes4("has_steps")).alias("structure"), "image_count")
    return C.relevance_reasons(K.relevance_scores(spark, d).join(pages, "page_id")).select("query_id", "page_id", F.array_join("reasons", ",").alias("reasons"))


def yes4(name: str):
    return F.when(F.col(name), 4).otherwise(0)


REASONS = K.SEARCH + ",\n" + K.RELEVANCE + """ SELECT query_id, page_id, array_to_string(list_filter([CASE WHEN keyword > 20 THEN 'Relevant' END, CASE WHEN phrase > 8 THEN 'Exakter Treffer' END, CASE WHEN phrase > 4 THEN 'Thematisch passend' END, CASE WHEN word_count > 1000 THEN 'Ausführlich' END,
  CASE WHEN readability_score / 7 > 10 THEN 'Lesbar' END, CASE WHEN ctr > 8 THEN 'Popular' END, CASE WHEN CASE WHEN has_table THEN 4 ELSE 0 END + CASE WHEN has_steps THEN 4 ELSE 0 END > 5 THEN 'Strukturiert' END, CASE WHEN image_count > 3 THEN 'Multimedia' END], lambda x: x IS NOT NULL)[1:3], ',') AS reasons
  FROM rel JOIN (SELECT page_id, word_count, readability_score, ctr, has_table, has_steps, image_count FROM v_pages) USING (page_id)"""


def disputed(spark, d):
    e = v.read(spark, d, "lineitem")
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("factual", "rating", "style"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return e.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), name("p", a).alias("url_a"), name("d", a % 10).alias("domain_a"), name("o", a % 3).alias("owner_a"), name("s", b).alias("url_b"), name("d", b % 10).alias("domain_b"), F.when(b % 4 > 0, name("o", b % 3)).alias("owner_b"), kind.alias("kind"), (F.col("l_quantity") * 2).cast("int").alias("confidence"), F.col("l_shipdate").alias("created_at"))


DISPUTED = """x AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'p' || l_partkey AS url_a, 'd' || (l_partkey % 10) AS domain_a, 'o' || (l_partkey % 3) AS owner_a, 's' || l_suppkey AS url_b, 'd' || (l_suppkey % 10) AS domain_b, CASE WHEN l_suppkey % 4 > 0 THEN 'o' || (l_suppkey % 3) END AS owner_b,
  ['factual', 'rating', 'style'][l_linenumber % 3 + 1] AS kind, CAST(l_quantity * 2 AS INT) AS confidence, l_shipdate AS created_at FROM lineitem),
good AS (SELECT * FROM x WHERE confidence >= 80 AND kind IN ('factual', 'rating')),
sides AS (SELECT url_a AS url, url_b AS other_url, domain_b AS other_domain, confidence, created_at, id, CASE WHEN owner_a = owner_b THEN owner_a || ' (intern!)' ELSE concat_ws(' vs ', owner_a, owner_b) END AS owners FROM good
  UNION ALL SELECT url_b, url_a, domain_a, confidence, created_at, id, CASE WHEN owner_a = owner_b THEN owner_b || ' (intern!)' ELSE concat_ws(' vs ', owner_b, owner_a) END FROM good)"""


def contradictions(spark, d):
    return C.contradictions(disputed(spark, d))


def top_contradictions(spark, d):
    return C.contradictions(disputed(spark, d), None, 5)


def articles(spark, d):
    k = F.col("o_orderkey")
    return v.read(spark, d, "orders").select(k.alias("web_id"), F.when(k % 4 > 0, k - k % 7).alias("original_id"), F.col("o_orderpriority").alias("similarity_type"))


def similarity_report(spark, d):
    index = v.read(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("https://a.example.com/"), F.col("o_orderkey").cast("string")).alias("url"))
    return C.similarity_report(articles(spark, d), index)


def page_facts(spark, d):
    e = v.v_events(spark, d)
    return e.select(F.col("event_id").alias("fact_id"), F.col("k").alias("page_id"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("u"), (F.col("k") % 30).cast("string"))).alias("url"), F.when(F.col("event_type") == "view", "summary").otherwise(F.col("event_type")).alias("class"))


PAGE_FACTS = f"""f AS (SELECT fact_id, coalesce(f.url, p.url) AS url, class FROM (SELECT event_id AS fact_id, k AS page_id, CASE WHEN event_id % 3 > 0 THEN 'u' || (k % 30) END AS url, CASE WHEN event_type = 'view' THEN 'summary' ELSE event_type END AS class FROM (SELECT *, {v.K} AS k FROM events)) f LEFT JOIN pages p USING (page_id))"""


def facts_with_urls(spark, d):
    return C.facts_with_urls(page_facts(spark, d), v.v_pages(spark, d)).select("fact_id", "url", "class")


def fact_counts(spark, d):
    return C.fact_counts(page_facts(spark, d), v.v_pages(spark, d))


def visible_messages(spark, d):
    e = v.v_events(spark, d)
    said = e.select(F.col("event_id").alias("id"), (F.col("k") % 10).alias("room"), F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("author"), F.col("ts").alias("sent_at"))
    blocks = e.where("event_type = 'error' and k % 10 = 0").select(F.concat(F.lit("uSER"), F.col("user_id").cast("string")).alias("name"))
    return C.visible_messages(said, blocks).select("room", "rank", "id", "author")


def hidden_queue(spark, d):
    k = F.col("o_orderkey")
    lists = v.read(spark, d, "orders").select(k.alias("id"), (k % 5 == 0).alias("hidden"), (k % 3 == 0).alias("released"))
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    entries = v.read(spark, d, "lineitem").select(line.alias("id"), (line % 7 == 0).alias("hidden"), (line % 2 == 0).alias("released"))
    reports = v.v_events(spark, d).select(F.when(F.col("event_id") % 2 == 0, "list").otherwise("entry").alias("kind"), (F.col("k") * 5).alias("target_id"), F.col("event_type").alias("reason"))
    return C.hidden_queue(lists, entries, reports)


HIDDEN = f"""r AS (SELECT kind, id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS reasons FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'list' ELSE 'entry' END AS kind, {v.K} * 5 AS id, event_type FROM events) GROUP BY 1, 2)
SELECT kind, id, reasons FROM (SELECT 'list' AS kind, o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0 UNION ALL SELECT 'entry', l FROM (SELECT l_orderkey * 10 + l_linenumber AS l FROM lineitem) WHERE l % 7 = 0 AND l % 2 <> 0) LEFT JOIN r USING (kind, id)"""


def week_suggestions(spark, d):
    log = v.v_query_log(spark, d)
    stats = log.groupBy("query", F.date_trunc("week", F.col("ts")).alias("week")).agg(F.count("*").alias("searches"))
    return C.suggestions_with_week(log.select("query").distinct(), stats, NOW).select("query", "searches")


def security_counts(spark, d):
    e = v.v_events(spark, d)
    severity = F.when(F.col("value") > 50, "critical").when(F.col("value") > 10, "high").otherwise("low")
    return C.security_events(e.where("event_type in ('error', 'signup')").select(F.col("event_type").alias("type"), severity.alias("severity"), "ts"))


def collection_likes(spark, d):
    return C.collection_likes(v.v_events(spark, d).select((F.col("k") % 50).alias("collection_id"), "user_id"))


def visits(spark, d):
    """Click quality of urls, renewed at the last click of each before NOW."""
    c = v.v_clicks(spark, d).where(F.col("id") % 3 > 0).withColumn("url", F.concat("url", F.col("query")))
    return c.groupBy("url").agg(F.count("*").alias("n_clicks"), F.max("clicked_at").alias("updated_at"), F.count_if(F.col("dwell_ms") < 5000).alias("bad"), F.count_if(F.col("dwell_ms") >= 30_000).alias("good")).select("url", "n_clicks", "updated_at", F.round(F.col("bad") / F.col("n_clicks"), 4).alias("bad_rate"), F.round(F.col("good") / F.col("n_clicks"), 4).alias("good_rate"), (F.col("n_clicks") % 4 - 1).alias("bonus"))


VISITS = with_views("", "v_clicks").rstrip() + """,
q AS (SELECT url || query AS url, count(*) AS n_clicks, max(clicked_at) AS updated_at, round(CAST(count(*) FILTER (WHERE dwell_ms < 5000) AS DOUBLE) / count(*), 4) AS bad_rate, round(CAST(count(*) FILTER (WHERE dwell_ms >= 30000) AS DOUBLE) / count(*), 4) AS good_rate, count(*) % 4 - 1 AS bonus FROM v_clicks WHERE id % 3 > 0 GROUP BY 1)"""
LATE = "2024-01-22 00:00:00"


def fresh_bonuses(spark, d):
    return B.fresh_bonuses(visits(spark, d), LATE)


def visit_rates(spark, d):
    return B.visit_rates(visits(spark, d), LATE)


def decayed_trends(spark, d):
    log = v.v_query_log(spark, d).where(F.col("ts") <= F.to_timestamp(F.lit(NOW)))
    words = log.groupBy("query").agg(F.max("ts").alias("updated_at"), F.count("*").alias("n")).select("query", "updated_at", (F.col("n") % 3 > 0).alias("trending"), (F.col("n") % 5 + 1.0).alias("multiplier"), (F.col("n") * 0.5).cast("double").alias("trend_score"))
    return T.decay_trends(words, NOW).select("query", "trending", "multiplier", "trend_score")


def live_bans(spark, d):
    b = v.v_violations(spark, d)
    bans = b.select("id", "ip", F.col("ts").alias("banned_at"), (F.col("id") % 17 == 0).alias("permanent"), (F.col("ts") + F.make_dt_interval(days=(F.col("id") % 9).cast("int"))).alias("until"))
    return V.active_bans(bans.where(F.col("banned_at") <= F.to_timestamp(F.lit(NOW))), NOW).select("ip", "id", "permanent", "until")


def combined_verdicts(spark, d):
    posts = v.v_posts(spark, d)
    title = M.insult_check(posts.select("id", F.left("body", F.lit(60)).alias("title")), "title").select("id", F.col("insult_action").alias("title_action"))
    body = M.pattern_check(posts, spark.createDataFrame([(1, "license", "phrase", "license", 1, "flag", True), (2, "[0-9]{16}", "regex", "number", 2, "block", True)], "id int, pattern string, kind string, category string, priority int, action string, active boolean")).select("id", F.col("action").alias("body_action"))
    return M.combined_verdict(posts.select("id").join(title, "id", "left").join(body, "id", "left")).groupBy("verdict").agg(F.count("*").alias("n"))


def reviewed(spark, d):
    k = F.col("o_orderkey")
    content = v.read(spark, d, "orders").select(k.alias("id"), F.when(k % 6 > 0, k % 5 == 0).alias("hidden"))
    kinds = F.array(*map(F.lit, ("release", "delete", "ignore", "approve", "reject", "hide")))
    actions = v.v_events(spark, d).select((F.col("k") * 3).alias("id"), F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")).alias("action"), "ts", F.col("event_id").alias("action_id"))
    return M.apply_actions(content, actions).select("id", "hidden")


def anonymised(spark, d):
    e = v.v_events(spark, d)
    posts = e.select(F.col("event_id").alias("id"), F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("author_ip"), (F.col("ts") + F.make_dt_interval(days=F.lit(7))).alias("ip_deadline"))
    return M.visible_only(M.anonymise_ips(posts, NOW).withColumn("hidden", F.col("id") % 10 == 0)).select("id", "author_ip")


def all_semantic_matches(spark, d):
    e = v.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return M.semantic_matches(e, e.where("id % 100 = 0"), 0.3)


def latest_votes(spark, d):
    return C.latest(v.v_user_votes(spark, d), ["user_id", "domain"], ["created_at", "id"]).select("user_id", "domain", "value", "id")


def event_properties(spark, d):
    e = v.read(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.from_json("props", "k long, source string").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"), F.count_if(F.col("p.k") > 50).alias("n_large"), F.count("p.source").alias("n_sources"))


def _v(sql: str, *names: str) -> str:
    return with_views(sql, *names)


ANSWERS = with_views("", "v_asked", "v_queries").rstrip() + """,
a AS (SELECT query_id AS answer_id, query AS question, answer FROM v_asked JOIN (SELECT conv_id AS query_id, arg_min(text, turn) AS answer FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY 1) USING (query_id))"""
# The stemmer written with positions instead of patterns: r1 and r2 are where regions begin, n1 to n3 what each step takes off.
CUT = "left({0}, length({0}) - {1})"
STEMS = rf"""spelt AS (SELECT word, replace(word, 'ß', 'ss') AS s FROM words),
voiced AS (SELECT word, {'regexp_replace(' * 4}s{''.join(f", '([{VOWELS}]){x}([{VOWELS}])', '" + chr(92) + f"1{x.upper()}" + chr(92) + "2', 'g')" for x in 'uuyy')} AS s FROM spelt),
regions AS (SELECT *, CASE WHEN regexp_matches(s, '^{BEFORE_R1}') THEN greatest(3, length(regexp_extract(s, '^{BEFORE_R1}'))) ELSE 1000000 END AS r1, CASE WHEN regexp_matches(s, '^{BEFORE_R2}') THEN length(regexp_extract(s, '^{BEFORE_R2}')) ELSE 1000000 END AS r2 FROM voiced),
step1 AS (SELECT *, CASE WHEN ends_with(s, 'ern') THEN 3 WHEN regexp_matches(s, '(em|er|en|es)$') THEN 2 WHEN regexp_matches(s, '(e|[{BEFORE_S}]s)$') THEN 1 ELSE 0 END AS n1 FROM regions),
done1 AS (SELECT *, CASE WHEN n1 > 0 AND length(s) - n1 >= r1 THEN {CUT.format('s', "(n1 + CASE WHEN regexp_matches(s, 'niss(e|en|es)$') THEN 1 ELSE 0 END)")} ELSE s END AS t FROM step1),
step2 AS (SELECT *, CASE WHEN ends_with(t, 'est') THEN 3 WHEN regexp_matches(t, '(en|er)$') OR regexp_matches(t, '...[{BEFORE_ST}]st$') THEN 2 ELSE 0 END AS n2 FROM done1),
done2 AS (SELECT word, r1, r2, CASE WHEN n2 > 0 AND length(t) - n2 >= r1 THEN {CUT.format('t', 'n2')} ELSE t END AS u FROM step2),
step3 AS (SELECT *, CASE WHEN regexp_matches(u, '(end|ung)$') THEN 3 WHEN regexp_matches(u, '(lich|heit|keit)$') OR regexp_matches(u, '[^e]isch$') THEN 4 WHEN regexp_matches(u, '[^e](ig|ik)$') THEN 2 ELSE 0 END AS n3 FROM done2),
done3 AS (SELECT *, n3 > 0 AND length(u) - n3 >= r2 AS cut, CASE WHEN n3 > 0 AND length(u) - n3 >= r2 THEN {CUT.format('u', 'n3')} ELSE u END AS x FROM step3),
more3 AS (SELECT word, x, CASE WHEN NOT cut THEN 0 WHEN regexp_matches(u, '(end|ung)$') AND regexp_matches(x, '[^e]ig$') AND length(x) - 2 >= r2 THEN 2 WHEN regexp_matches(u, '(lich|heit)$') AND regexp_matches(x, '(er|en)$') AND length(x) - 2 >= r1 THEN 2
  WHEN ends_with(u, 'keit') AND ends_with(x, 'lich') AND length(x) - 4 >= r2 THEN 4 WHEN ends_with(u, 'keit') AND ends_with(x, 'ig') AND length(x) - 2 >= r2 THEN 2 ELSE 0 END AS n4 FROM done3),
st AS (SELECT word, translate({CUT.format('x', 'n4')}, 'UYäöü', 'uyaou') AS stem FROM more3)"""
FULLTEXT = ANSWERS + f""",
cut AS (SELECT query_id, string_split_regex(query, '[.!?]+') AS parts FROM v_asked),
asks AS (SELECT query_id * 1000 + i - 1 AS query_id, query FROM (SELECT query_id, unnest(parts) AS query, generate_subscripts(parts, 1) AS i FROM cut)),
spoken AS (SELECT answer_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT answer_id, {K.TOKENS.format("concat_ws(' ', question, answer)")} AS ws FROM a)),
asked AS (SELECT DISTINCT query_id, unnest({K.TOKENS.format('query')}) AS word FROM asks),
words AS (SELECT word FROM (SELECT word FROM spoken UNION SELECT word FROM asked) WHERE NOT list_contains({_list(A.QUESTION_STOP_WORDS)}, word)),
{STEMS},
idx AS (SELECT answer_id, stem, pos FROM spoken JOIN st USING (word)),
qs AS (SELECT DISTINCT query_id, stem FROM asked JOIN st USING (word)),
hit AS (SELECT query_id, answer_id, any_value(need) AS need, any_value(n) AS n FROM qs JOIN (SELECT query_id, count(*) AS need FROM qs GROUP BY 1) USING (query_id) JOIN (SELECT answer_id, stem, count(*) AS n FROM idx GROUP BY 1, 2) USING (stem) GROUP BY 1, 2 HAVING count(*) = any_value(need)),
far AS (SELECT query_id, answer_id, i.stem AS one, k.stem AS other, abs(i.pos - k.pos) AS gap FROM hit JOIN qs a USING (query_id) JOIN qs b USING (query_id) JOIN idx i USING (answer_id) JOIN idx k USING (answer_id) WHERE need > 1 AND a.stem < b.stem AND i.stem = a.stem AND k.stem = b.stem),
ranks AS (SELECT query_id, answer_id, round(list_sum(list_transform(range(1, least(n, 1000) + 1), lambda k: CAST({A.RANK_WEIGHT} AS DOUBLE) / (k * k))) / CAST({A.RANK_SCALE} AS DOUBLE), 6) AS rank FROM hit WHERE need = 1
  UNION ALL SELECT query_id, answer_id, round(1 - exp(sum(ln(1 - sqrt(CAST({A.RANK_WEIGHT * A.RANK_WEIGHT} AS DOUBLE) / (CAST(1.005 AS DOUBLE) + CAST(0.05 AS DOUBLE) * exp(gap / CAST(1.5 AS DOUBLE) - 2)))))), 6) FROM far WHERE gap <= {A.FAR} GROUP BY 1, 2)
SELECT query_id, answer_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, answer_id) AS i FROM ranks WHERE rank > {A.LEAST_RANK}) WHERE i = 1"""
FAQ = ANSWERS + f""", {K.SYN},
asking AS (SELECT query_id, query FROM v_queries UNION ALL SELECT answer_id + 1000, question FROM a WHERE answer_id % 100 = 0),
faq AS (SELECT answer_id AS faq_id, question || CASE WHEN answer_id % 3 > 0 THEN '?' ELSE '' END AS lq, lower(answer) AS la, string_split(question, ' ')[1] AS lt, answer_id % 4 = 0 AS general, nullif(answer_id % 7, 0) AS trust, answer_id % 50 AS created FROM a),
own AS (SELECT query_id, list_filter({WORDS.format('query')}, lambda w: length(w) > 2) AS ts FROM asking),
more AS (SELECT query_id, list_sort(list_distinct(flatten(list(g)))) AS m FROM (SELECT query_id, unnest(ts) AS t FROM own) JOIN syn ON list_contains(g, t) GROUP BY 1),
full_ AS (SELECT query_id, list_reduce(list_concat(ts, coalesce(m, [])), lambda s, x: CASE WHEN list_contains(s, x) THEN s ELSE list_append(s, x) END, CAST([] AS VARCHAR[]))[1:10] AS ts FROM own LEFT JOIN more USING (query_id) WHERE len(ts) > 0),
found AS (SELECT query_id, f.*, contains(lq, ts[1]) AS direct FROM faq f JOIN full_ ON length(lq) BETWEEN 10 AND 200 AND NOT starts_with(lq, 'was ist bekannt') AND NOT starts_with(lq, 'was sind aktuelle')
  AND len(list_filter(ts, lambda t: contains(lq, t) OR contains(la, t) OR contains(lt, t))) > 0 AND NOT (general AND NOT (contains(lq, ts[1]) OR contains(la, ts[1])))),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY direct DESC, trust DESC NULLS LAST, created DESC, faq_id) AS place FROM found),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, left(trim(lq), 80) ORDER BY place) AS u FROM best WHERE place <= 20)
SELECT query_id, faq_id, CAST(place AS INT) AS place FROM once WHERE u = 1 AND (contains(lq, '?') OR regexp_matches(trim(lq), '{A.ASKS}'))"""

QUERIES = {
    "qa_fulltext": (qa_fulltext, FULLTEXT),
    "faq_search": (faq_search, FAQ),
    "keyword_lookup": (keyword_lookup, "WITH " + KEYWORDS + " SELECT query_id, keyword, category, score, CAST(i AS INT) AS rank FROM (SELECT query_id, keyword, category, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, keyword) AS i FROM wanted JOIN kw ON contains(lower(keyword), lower(query))) WHERE i <= 10"),
    "keyword_intents": (keyword_intents, "WITH " + KEYWORD_INTENTS + " SELECT * FROM chosen"),
    "resolved_intents": (resolved_intents, "WITH " + KEYWORD_INTENTS + f" SELECT query_id, intent, coalesce(intent_override, intent) AS resolved FROM (SELECT query_id, {K.INTENT} AS intent FROM wanted) LEFT JOIN chosen USING (query_id)"),
    "qa_lookup": (qa_lookup, QA),
    "product_candidates": (product_candidates, _top("product", f"(category IN ('ecommerce-shops', 'shop') OR regexp_matches(lower(coalesce(section, '')), '{A.SHOP_SECTION}')) AND (coalesce(price > 0, false) OR {USABLE})", 3)),
    "recipe_candidates": (recipe_candidates, _top("recipe", f"(regexp_matches(lower(url), '{A.RECIPE_HOSTS}') OR regexp_matches(lower(title), '{A.RECIPE_TITLE}')) AND length(image) > 0 AND NOT best_match", 3)),
    "news_candidates": (news_candidates, _top("news", f"length(url) > 0 AND {USABLE} AND NOT is_fact", 4)),
    "faq_fallback": (faq_fallback, RESULTS + f""", h AS (SELECT query_id, page_id, title, CASE WHEN contains(title, '?') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(lower(title), '{A.QUESTION_START}') THEN 20 ELSE 0 END AS points FROM results
      WHERE NOT best_match AND len(list_filter({WORDS.format('query')}, lambda t: length(t) > 2 AND contains(lower(title), t))) > 0),
      o AS (SELECT *, row_number() OVER (PARTITION BY query_id, regexp_replace(trim(lower(title)), '\\s+', ' ', 'g') ORDER BY points DESC, page_id) AS u FROM h WHERE points > 0)
      SELECT query_id, page_id, points, CAST(i AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, page_id) AS i FROM o WHERE u = 1) WHERE i <= 6"""),
    "related_terms": (related_terms, "WITH " + RELATED),
    "valid_inputs": (valid_inputs, _v(f"""SELECT kind, id, coalesce(length(value) > 0 AND length(value) <= 500 AND CASE kind WHEN 'query' THEN regexp_matches(value, '{A.INPUT_PATTERNS['query'].replace("'", "''").replace(chr(92) + chr(34), chr(34))}') WHEN 'email' THEN regexp_matches(value, '{A.INPUT_PATTERNS['email']}') ELSE regexp_matches(value, '{A.INPUT_PATTERNS['url']}') END, false) AS valid FROM (
      SELECT 'query' AS kind, query_id AS id, query AS value FROM v_asked UNION ALL SELECT 'url', page_id, CASE WHEN page_id % 4 = 0 THEN substring(url, 3, 500) ELSE url END FROM pages UNION ALL SELECT 'email', c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || '@mail.example.com' END FROM customer)""", "v_asked")),
    "found_lists": (found_lists, "WITH " + KEYWORDS + """, q AS (SELECT min(k) AS query_id, string_split(keyword, ' ')[-1] AS q FROM kw GROUP BY 2 UNION ALL SELECT -1, 't3' UNION ALL SELECT -2, 'brand#1')
      SELECT query_id, p_partkey AS id FROM part JOIN q ON contains(lower(p_name), q) OR contains(lower(p_brand), q) OR contains(lower(p_type), q) OR lower('T' || (p_size % 9)) = q"""),
    "product_search": (product_search, "WITH " + KEYWORDS + """, q AS (SELECT query_id, lower(query) AS q FROM wanted UNION ALL SELECT -1000, 'brand#2' UNION ALL SELECT -1001, 'eco'),
      m AS (SELECT query_id, p_partkey AS product_id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 40 END AS rated, CASE WHEN lower(p_name) = q THEN 100 WHEN starts_with(lower(p_name), q) THEN 90 WHEN contains(lower(p_name), q) THEN 60 WHEN contains(lower(p_brand), q) THEN 40 WHEN contains(lower(p_type), q) THEN 30 END AS score FROM part, q),
      b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rated DESC NULLS LAST, product_id) AS i FROM m WHERE score IS NOT NULL)
      SELECT query_id, product_id, coalesce(CASE WHEN product_id % 3 = 0 THEN 'http://shop.example.com/' || product_id END, url) AS url, replace(coalesce(CASE WHEN product_id % 5 = 0 THEN 'http://img.example.com/' || product_id END, CASE WHEN page_id % 7 > 0 THEN 'https://img.example.com/' || page_id || '.jpg' END), 'http://', 'https://') AS image, score, CAST(i AS INT) AS rank
      FROM b LEFT JOIN pages ON page_id = product_id WHERE i <= 5"""),
    "page_categories": (categories, _v(f"SELECT page_id, {DOMAIN_CASE} AS domain_category, {URL_CASE} AS url_category FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN {_list(SITES)}[CAST(page_id % 8 + 1 AS INT)] ELSE domain END AS site, CASE WHEN page_id % 5 = 0 THEN {_list(PATHS)}[CAST(page_id % 3 + 1 AS INT)] ELSE url END AS u FROM v_pages)", "v_pages")),
    "product_attributes": (attributes, _v(ATTRIBUTES, "v_pages")),
    "semantic_bonuses": (semantic_bonuses, K.SEARCH + f""" SELECT query_id, page_id, CAST(least(30, 5 * len(list_filter(string_split(title, ' ')[1:9], lambda e: length(e) > 0 AND len(list_filter({WORDS.format('query')}, lambda w: length(w) > 2 AND (contains(lower(e), w) OR contains(w, lower(e))))) > 0))) AS INT) AS bonus
      FROM (SELECT DISTINCT query_id, page_id FROM (SELECT query_id, unnest(terms) AS term FROM terms) JOIN idx USING (term)) JOIN v_queries USING (query_id) JOIN (SELECT page_id, title FROM v_pages) USING (page_id)"""),
    "relevance_reasons": (reasons, REASONS),
    "contradictions": (contradictions, "WITH " + DISPUTED + """ SELECT url, other_url, other_domain, confidence, owners, CAST(i AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY confidence DESC, created_at DESC, id, other_url) AS i FROM (
      SELECT *, row_number() OVER (PARTITION BY url, other_domain ORDER BY confidence DESC, created_at DESC, id, other_url) AS u FROM sides) WHERE u = 1) WHERE i <= 3"""),
    "top_contradictions": (top_contradictions, "WITH " + DISPUTED + " SELECT url, other_url, other_domain, confidence, owners, CAST(i AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY confidence DESC, created_at DESC, id, other_url) AS i FROM sides) WHERE i <= 5"),
    "similarity_report": (similarity_report, """WITH a AS (SELECT o_orderkey AS web_id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey - o_orderkey % 7 END AS original_id, o_orderpriority AS similarity_type FROM orders)
      SELECT a.web_id, a.original_id, a.similarity_type, CASE WHEN a.original_id % 2 = 0 AND o.web_id IS NOT NULL THEN 'https://a.example.com/' || a.original_id END AS original_url, o.similarity_type AS original_type, a.original_id IS NULL OR a.original_id = a.web_id AS is_original FROM a LEFT JOIN a o ON o.web_id = a.original_id"""),
    "facts_with_urls": (facts_with_urls, "WITH " + PAGE_FACTS + " SELECT * FROM f"),
    "fact_counts": (fact_counts, "WITH " + PAGE_FACTS + " SELECT url, count(*) AS n_facts, bool_or(class = 'summary') AS has_summary FROM f WHERE url IS NOT NULL GROUP BY 1"),
    "visible_messages": (visible_messages, f"""SELECT room, CAST(i AS INT) AS rank, id, 'User' || user_id AS author FROM (SELECT event_id AS id, k % 10 AS room, user_id, row_number() OVER (PARTITION BY k % 10 ORDER BY ts DESC, event_id DESC) AS i FROM (SELECT *, {v.K} AS k FROM events)
      WHERE user_id NOT IN (SELECT user_id FROM (SELECT *, {v.K} AS k FROM events) WHERE event_type = 'error' AND k % 10 = 0)) WHERE i <= 50"""),
    "hidden_queue": (hidden_queue, "WITH " + HIDDEN),
    "week_suggestions": (week_suggestions, _v(f"SELECT query, coalesce(n, 0) AS searches FROM (SELECT DISTINCT query FROM v_query_log) LEFT JOIN (SELECT query, count(*) AS n FROM v_query_log WHERE date_trunc('week', ts) = date_trunc('week', TIMESTAMP '{NOW}') GROUP BY 1) USING (query)", "v_query_log")),
    "security_counts": (security_counts, "SELECT event_type AS type, CASE WHEN value > 50 THEN 'critical' WHEN value > 10 THEN 'high' ELSE 'low' END AS severity, count(*) AS n, max(ts) AS last_at FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2"),
    "collection_likes": (collection_likes, f"SELECT collection_id, count(DISTINCT user_id) AS likes FROM (SELECT {v.K} % 50 AS collection_id, user_id FROM events) GROUP BY 1"),
    "fresh_bonuses": (fresh_bonuses, VISITS + f" SELECT url, bonus FROM q WHERE bonus <> 0 AND updated_at >= TIMESTAMP '{LATE}' - INTERVAL 2 DAY"),
    "visit_rates": (visit_rates, VISITS + f" SELECT url, bad_rate, good_rate, n_clicks FROM q WHERE n_clicks >= 10 AND updated_at >= TIMESTAMP '{LATE}' - INTERVAL 7 DAY"),
    "decayed_trends": (decayed_trends, _v(f"""SELECT query, trending AND NOT old AS trending, CAST(CASE WHEN trending AND old THEN 1 ELSE n % 5 + 1 END AS DOUBLE) AS multiplier, CAST(CASE WHEN trending AND old THEN 0 ELSE n * CAST(0.5 AS DOUBLE) END AS DOUBLE) AS trend_score FROM (
      SELECT query, count(*) AS n, count(*) % 3 > 0 AS trending, max(ts) < TIMESTAMP '{NOW}' - INTERVAL 60 MINUTE AS old FROM v_query_log WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1)""", "v_query_log")),
    "live_bans": (live_bans, _v(f"""SELECT ip, id, permanent, until FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts DESC, id DESC) AS i FROM (SELECT *, id % 17 = 0 AS permanent, ts + to_days(CAST(id % 9 AS INTEGER)) AS until FROM v_violations WHERE ts <= TIMESTAMP '{NOW}') WHERE permanent OR until > TIMESTAMP '{NOW}') WHERE i = 1""", "v_violations")),
    "combined_verdicts": (combined_verdicts, S.POSTS + f"""titled AS (SELECT {S.rule_sql()} AS i, body FROM (SELECT {S.spoken_sql('left(body, 60)')} AS w, body FROM v_posts)), acted AS (SELECT {S.ACTIONS}[i] AS title_action, CASE WHEN regexp_matches(body, '[0-9]{{16}}') THEN 'block' WHEN contains(lower(body), 'license') THEN 'flag' END AS body_action FROM titled)
      SELECT CASE WHEN title_action = 'block' OR body_action = 'block' THEN 'block' WHEN title_action = 'flag' OR body_action = 'flag' THEN 'flag' ELSE 'allow' END AS verdict, count(*) AS n FROM acted GROUP BY 1"""),
    "reviewed": (reviewed, f"""WITH a AS (SELECT id, arg_max(action, (ts, event_id)) AS action FROM (SELECT {v.K} * 3 AS id, ['release', 'delete', 'ignore', 'approve', 'reject', 'hide'][CAST(event_id % 6 + 1 AS INT)] AS action, ts, event_id FROM events) GROUP BY 1)
      SELECT o_orderkey AS id, CASE WHEN action IN ('release', 'ignore', 'approve') THEN false WHEN action IN ('hide', 'reject') THEN true ELSE coalesce(CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 5 = 0 END, false) END AS hidden FROM orders LEFT JOIN a ON a.id = o_orderkey WHERE coalesce(action, '') <> 'delete'"""),
    "anonymised": (anonymised, f"SELECT event_id AS id, CASE WHEN ts + INTERVAL 7 DAY <= TIMESTAMP '{NOW}' THEN NULL ELSE '10.0.0.' || user_id END AS author_ip FROM events WHERE event_id % 10 <> 0"),
    "semantic_matches": (all_semantic_matches, """SELECT * FROM (SELECT v.vec_id AS id, p.vec_id AS pattern_id, round(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: CAST(v.embedding[i] AS DOUBLE) * p.embedding[i])) / (sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(p.embedding, lambda x: CAST(x AS DOUBLE) * x)))), 6) AS cosine
      FROM embeddings v JOIN embeddings p ON p.vec_id % 100 = 0 AND p.vec_id <> v.vec_id) WHERE cosine >= 0.3"""),
    "latest_votes": (latest_votes, _v("SELECT user_id, domain, value, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, domain ORDER BY created_at DESC, id DESC) AS i FROM v_user_votes) WHERE i = 1", "v_user_votes")),
    "event_properties": (event_properties, "SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k, count(*) FILTER (WHERE k > 50) AS n_large, count(s) AS n_sources FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.source') AS s FROM events) GROUP BY 1"),
}
