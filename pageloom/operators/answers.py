"""Lookups in tables of keywords, answers and frequently asked questions, and the candidates of result widgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.columns import tokens
from pageloom.functions.stems import stem
from pageloom.functions.tables import materialised

#: Stated queries that tasks hold at a time where every row is tried on each of them.
QUERY_BLOCK = 1_000

# Words that a question is looked up without.
QUESTION_STOP_WORDS = """der die das dem den des ein eine eines einem einen von zu in auf an über bei seit bis mit ohne für gegen nach ab beim zum zur im am vom ins ans ums
und oder aber denn weil dass wenn als ob damit obwohl wie was wer wo wann warum woher wieviel ist sind hat haben wurde wird worden größte großes größter größtem größten
klein kleinste kleinster kleinere kleiner höchste höchst höchster höchsta längste längst längster längere länger tiefste tiefst tiefster tiefere tiefer
schnellste schnellst schnellster schnellere schneller neu neuer neueste neuster alt alte älteste älterer bekannt bekannte bekannteste bekanntester""".split()
# Intents of keyword categories; the first one that a category's name holds counts.
CATEGORY_INTENTS = [
    ("nachrichten", "NEWS"), ("news", "NEWS"), ("politik", "NEWS"), ("gesundheit", "YMYL"), ("medizin", "YMYL"), ("finanzen", "YMYL"), ("recht", "YMYL"), ("produkt", "COMMERCIAL"), ("einkauf", "COMMERCIAL"),
    ("shop", "COMMERCIAL"), ("shopping", "COMMERCIAL"), ("unterhaltung", "ENTERTAINMENT"), ("sport", "ENTERTAINMENT"), ("musik", "ENTERTAINMENT"), ("film", "ENTERTAINMENT"), ("spiel", "ENTERTAINMENT"),
]
# What tells recipes, sections of shops and questions.
RECIPE_HOSTS = r"chefkoch\.de|kochbar\.de|eatsmarter\.de|lecker\.de|essen-und-trinken\.de|springlane\.de|kitchenstories\.com|einfachbacken\.de"
RECIPE_TITLE = r"rezept|kochen|backen|zubereitung|zutaten|gericht"
SHOP_SECTION = r"product|produkt|shop|e-commerce"
QUESTION_START = r"^(was|wie|wer|warum|wo|wann|welche|kann|ist)\s"
# Greatest length of an input, and what queries, mail addresses and urls look like.
MOST_INPUT = 500
INPUT_PATTERNS = {"query": r"^[a-zA-Z0-9\s\-+*/().,:;!?'\"$%=&@_#^|\[\]{}~\x{80}-\x{FFFF}]*$", "email": r"^[^\s@]+@[^\s@]+\.[^\s@]+$", "url": r"^https?://.+"}


def in_turns(rows: DataFrame, queries: DataFrame, key: str, on: Column) -> DataFrame:
    """rows joined to stated queries by any condition: tasks hold QUERY_BLOCK queries at a time and try each of their rows on them."""
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    return reduce(DataFrame.unionByName, (rows.join(F.broadcast(queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)), on) for i in range(n)))


def first_n(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def keyword_lookup(queries: DataFrame, keywords: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, keyword, category, score, rank): the n best keywords (keyword, category, score) that hold the query, in any case. They are joined by the query's first three characters, or all of a shorter one's."""
    text = F.lower("keyword")
    grams = lambda k: F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substr(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    cut = keywords.select("keyword", "category", "score", F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("gram"))
    q = queries.select("query_id", F.lower(F.trim("query")).alias("q")).where("q <> ''").withColumn("gram", F.left("q", F.lit(3)))
    found = q.join(cut, "gram").where(F.contains(F.lower("keyword"), F.col("q")))
    return first_n(found, ["query_id"], [F.desc("score"), "keyword"], n).select("query_id", "keyword", "category", "score", "rank")


def keyword_intent(queries: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, keyword, category, intent_override): the best keyword that is one of the query's first four words or begins with its first word, and the intent of its category."""
    words = F.slice(F.split(F.trim(F.lower("query")), r"\s+"), 1, 4)
    q = queries.select("query_id", words.alias("ws"))
    same = q.select("query_id", F.explode("ws").alias("keyword")).join(keywords, "keyword")
    starts = F.transform(F.sequence(F.lit(1), F.length("keyword")), lambda i: F.left(F.lower("keyword"), i))
    begun = q.select("query_id", F.element_at("ws", 1).alias("start")).where("start <> ''").join(keywords.where("keyword <> ''").withColumn("start", F.explode(starts)), "start")
    columns = ["query_id", "keyword", "category", "score"]
    best = first_n(same.select(columns).unionByName(begun.select(columns)).distinct(), ["query_id"], [F.desc("score"), "keyword"], 1)
    return best.select("query_id", "keyword", "category", category_intent(F.col("category")).alias("intent_override"))


def category_intent(category: Column) -> Column:
    return F.coalesce(*(F.when(F.contains(F.lower(category), F.lit(part)), intent) for part, intent in CATEGORY_INTENTS))


def resolve_intent(queries: DataFrame, overrides: DataFrame) -> DataFrame:
    """queries (query_id, intent) with resolved: the override of a keyword if there is one, else the intent."""
    return queries.join(overrides.select("query_id", "intent_override"), "query_id", "left").withColumn("resolved", F.coalesce("intent_override", "intent", F.lit("INFORMATIONAL")))


def qa_lookup(queries: DataFrame, answers: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, answer_id, tier, rank): tier 0 is the one answer whose question is the query, in any case; without it tier 1 are the n shortest answers with a term of the query in question or answer. Stop words aren't terms, unless there is nothing else."""
    words = F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda w: F.length(w) > 2)
    terms = F.filter(words, lambda w: ~w.isin(QUESTION_STOP_WORDS))
    q = queries.select("query_id", F.lower("query").alias("q"), F.when(F.size(terms) > 0, terms).otherwise(F.filter(words, lambda w: F.length(w) > 3)).alias("terms"))
    a = answers.select("answer_id", F.lower("question").alias("lq"), F.lower("answer").alias("la"))
    exact = first_n(q.join(a, F.col("q") == F.col("lq")), ["query_id"], ["answer_id"], 1).select("query_id", "answer_id", F.lit(0).alias("tier"), "rank")
    rest = q.join(exact, "query_id", "left_anti").where(F.size("terms") > 0)
    hit = F.exists("terms", lambda t: F.contains("lq", t) | F.contains("la", t))
    near = first_n(in_turns(a, rest, "query_id", hit), ["query_id"], [F.length("la"), "answer_id"], n)
    return exact.unionByName(near.select("query_id", "answer_id", F.lit(1).alias("tier"), "rank"))


def faq_fallback(rows: DataFrame, n: int = 6) -> DataFrame:
    """(query_id, page_id, points, rank): results (query_id, query, page_id, question, best_match) that hold a term of the query and look like a question, each question once, n at most."""
    terms = F.filter(F.split(F.trim(F.lower("query")), r"\s+"), lambda t: F.length(t) > 2)
    points = F.when(F.contains("question", F.lit("?")), 10).otherwise(0) + F.when(F.lower("question").rlike(QUESTION_START), 20).otherwise(0)
    found = rows.where(~F.col("best_match") & F.exists(terms, lambda t: F.contains(F.lower("question"), t))).withColumn("points", points).where("points > 0")
    found = found.withColumn("key", F.regexp_replace(F.trim(F.lower("question")), r"\s+", " "))
    once = first_n(found, ["query_id", "key"], [F.desc("points"), "page_id"], 1).drop("rank")
    return first_n(once, ["query_id"], [F.desc("points"), "page_id"], n).select("query_id", "page_id", "points", "rank")


def related_terms(queries: DataFrame, thesaurus: DataFrame, n: int = 6) -> DataFrame:
    """(query_id, term, rank): terms (an array) of the thesaurus' key that equals the query; without one, the first n distinct terms of keys that hold the query or are held by it, by key and place."""
    q = queries.select("query_id", F.lower(F.trim("query")).alias("q")).where(F.length("q") >= 2)
    exact = q.join(thesaurus, F.col("q") == F.col("key")).select("query_id", F.posexplode("terms").alias("rank", "term")).select("query_id", "term", (F.col("rank") + 1).alias("rank"))
    rest = q.join(thesaurus.select(F.col("key").alias("q")), "q", "left_anti")
    near = in_turns(thesaurus, rest, "query_id", F.contains("key", F.col("q")) | F.contains("q", F.col("key"))).select("query_id", "key", F.posexplode("terms").alias("place", "term"))
    first = near.groupBy("query_id", "term").agg(F.min(F.struct("key", "place")).alias("at"))
    return exact.unionByName(first_n(first, ["query_id"], ["at"], n).select("query_id", "term", "rank"))


def usable_image(image: Column) -> Column:
    return F.coalesce((F.length(image) > 10) & ~image.startswith("data:"), F.lit(False))


def product_candidates(results: DataFrame, n: int = 3) -> DataFrame:
    """The first n results (query_id, rank) of shops that have a price or a usable image."""
    shop = F.col("category").isin("ecommerce-shops", "shop") | F.lower(F.coalesce("section", F.lit(""))).rlike(SHOP_SECTION)
    rows = results.where(shop & (F.coalesce(F.col("price") > 0, F.lit(False)) | usable_image(F.col("image"))))
    return first_n(rows.withColumnRenamed("rank", "place"), ["query_id"], ["place"], n)


def recipe_candidates(results: DataFrame, n: int = 3) -> DataFrame:
    """The first n results with an image whose host or title tells a recipe, best matches apart; none for queries with fewer than n."""
    recipe = F.lower("url").rlike(RECIPE_HOSTS) | F.lower("title").rlike(RECIPE_TITLE)
    rows = results.where(recipe & (F.length("image") > 0) & ~F.col("best_match")).withColumnRenamed("rank", "place")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).where(F.col("n") >= n)
    return first_n(rows, ["query_id"], ["place"], n).drop("n")


def news_candidates(results: DataFrame, n: int = 4) -> DataFrame:
    """The first n results that have a url and a usable image and are no facts."""
    rows = results.where((F.length("url") > 0) & usable_image(F.col("image")) & ~F.col("is_fact")).withColumnRenamed("rank", "place")
    return first_n(rows, ["query_id"], ["place"], n)


def validate_inputs(inputs: DataFrame) -> DataFrame:
    """inputs (kind, value) with valid: there is a value, it isn't too long, and it looks like its kind; other kinds look like anything."""
    fits = F.coalesce(*(F.when(F.col("kind") == k, F.col("value").rlike(p)) for k, p in INPUT_PATTERNS.items()), F.lit(True))
    return inputs.withColumn("valid", F.coalesce((F.length("value") > 0) & (F.length("value") <= MOST_INPUT) & fits, F.lit(False)))


def search_lists(lists: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id): lists (id, title, description, category, tags) that have the query in one of three texts, in any case, or as a tag."""
    q = queries.select("query_id", F.lower(F.trim("query")).alias("q"))
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.col("q")), F.lit(False)) for c in ("title", "description", "category")))
    tagged = F.coalesce(F.exists("tags", lambda t: F.lower(t) == F.col("q")), F.lit(False))
    return in_turns(lists, q, "query_id", hit | tagged).select("query_id", "id")


def product_search(queries: DataFrame, products: DataFrame, pages: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, product_id, url, image, score, rank): products (product_id, page_id, name, brand, category, url, image, rating_count) that hold the query, with url and image of their page where they have none."""
    q = queries.select("query_id", F.lower(F.trim("query")).alias("q"))
    own = products.join(pages.select("page_id", F.col("url").alias("page_url"), F.col("image").alias("page_image")), "page_id", "left")
    name, q_ = F.lower("name"), F.col("q")
    score = F.when(name == q_, 100).when(name.startswith(q_), 90).when(F.contains(name, q_), 60).when(F.contains(F.lower("brand"), q_), 40).when(F.contains(F.lower("category"), q_), 30)
    found = in_turns(own, q, "query_id", score.isNotNull()).withColumn("score", score)
    best = first_n(found, ["query_id"], [F.desc("score"), F.col("rating_count").desc_nulls_last(), "product_id"], n)
    return best.select("query_id", "product_id", F.coalesce("url", "page_url").alias("url"), F.replace(F.coalesce("image", "page_image"), F.lit("http://"), F.lit("https://")).alias("image"), "score", "rank")


# Fixed values of full-text ranks: the weight of a word, the scale of one word's occurrences, and the rank that an answer must pass.
RANK_SCALE, RANK_WEIGHT, LEAST_RANK = 1.64493406685, 0.1, 0.01
#: Words further apart than this have no part in a rank.
FAR = 100
# Questions that say nothing, their lengths, and how real ones begin.
EMPTY_QUESTIONS, QUESTION_LENGTHS = ("was ist bekannt", "was sind aktuelle"), (10, 200)
ASKS = r"^(was|wie|wer|warum|wo|wann|welche|kann|ist|gibt|haben|sollte|darf|muss|kostet|dauert)"


def stem_places(texts: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, stem, pos): the stems of a text's words but stop words, with their places among all its words, from 0."""
    words = texts.select(id_col, F.posexplode(tokens(text)).alias("pos", "word")).where(~F.col("word").isin(QUESTION_STOP_WORDS))
    return words.select(id_col, stem(F.col("word")).alias("stem"), "pos")


def closeness(distance: Column) -> Column:
    """What two words at a distance of one word and more add to a rank: 0.1 side by side, little beyond ten words."""
    return F.sqrt(RANK_WEIGHT * RANK_WEIGHT / (1.005 + 0.05 * F.exp(distance / 1.5 - 2)))


def qa_fulltext(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, answer_id, rank): of the answers that have all stems of a query in question or answer, the one of most rank over 0.01 (ties by id).

    With one stem, its n occurrences give 0.1 * (1 + 1/4 + ... + 1/n^2) / 1.645. With more, every two occurrences of different stems within 100 words
    count by their closeness c, and the rank is 1 minus the product of all 1 - c: answers that say a query's words together come first. Null texts are
    empty, queries without stems have no row, equal queries the same one.

    Queries of equal stems are asked once. Answers are found by a query's two rarest stems, so common ones open no long lists, and only what has both meets the other stems. Occurrences meet in stretches of 100 words, so those of a long text are not all paired; stems travel as numbers.
    """
    places = stem_places(answers, "answer_id", F.concat_ws(" ", "question", "answer"))
    places = materialised(places, "stem-places")
    often = materialised(places.groupBy("stem").agg(F.countDistinct("answer_id").alias("df")).withColumn("s", F.monotonically_increasing_id()), "stems")
    places = places.join(often, "stem").select("answer_id", "s", "pos")
    index = materialised(places.groupBy("answer_id", "s").agg(F.count("*").alias("n")), "stem-index")
    asked = materialised(stem_places(queries, "query_id", F.col("query")).select("query_id", "stem").distinct(), "asked-stems")
    known = asked.join(often, "stem", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("stems"), F.count_if(F.col("s").isNull()).alias("unknown")).where("unknown = 0")
    members = materialised(known.select("query_id", F.col("stems.s").alias("stems")), "asked-sets")
    sets = members.groupBy("stems").agg(F.min("query_id").alias("set"))
    sets = materialised(sets.withColumn("need", F.size("stems")), "stem-sets")
    first = sets.select("set", "need", F.col("stems")[0].alias("s"), F.get("stems", F.lit(1)).alias("second")).join(index, "s")
    occurrences = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(1000)).cast("int")), F.lit(0.0), lambda s, k: s + F.lit(RANK_WEIGHT) / (k * k))
    single = first.where("need = 1").select("set", "answer_id", (occurrences / RANK_SCALE).alias("value"))
    held = index.select("answer_id", "s")
    both = materialised(first.where("need > 1").select("set", "answer_id", "need", F.col("second").alias("s")).join(held, ["answer_id", "s"]).drop("s"), "two-stems")
    others = sets.where("need > 2").select("set", F.explode(F.slice("stems", 3, F.size("stems"))).alias("s"))
    more = both.where("need > 2").join(others, "set").join(held, ["answer_id", "s"]).groupBy("set", "answer_id", "need").agg(F.count("*").alias("have")).where("have = need - 2")
    full = materialised(both.where("need = 2").select("set", "answer_id").unionByName(more.select("set", "answer_id")), "full-hits")
    wanted = sets.where("need > 1").select("set", F.explode("stems").alias("s"))
    own = full.join(wanted, "set").join(places, ["answer_id", "s"]).select("set", "answer_id", "s", "pos", F.expr(f"pos div {FAR}").alias("part"))
    a = own.select("set", "answer_id", F.col("s").alias("s_a"), F.col("pos").alias("pos_a"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    apart = F.col("pos") - F.col("pos_a")
    pairs = a.join(own, ["set", "answer_id", "part"]).where((F.col("s_a") != F.col("s")) & (apart > 0) & (apart <= FAR))
    several = pairs.groupBy("set", "answer_id").agg((1 - F.exp(F.sum(F.log1p(-closeness(apart))))).alias("value"))
    ranks = single.unionByName(several).withColumn("value", F.round("value", 6)).where(F.col("value") > LEAST_RANK)
    best = first_n(ranks, ["set"], [F.desc("value"), "answer_id"], 1).select("set", "answer_id", F.col("value").alias("rank"))
    return members.join(sets.select("stems", "set"), "stems").select("query_id", "set").join(best, "set").select("query_id", "answer_id", "rank")


def faq_search(queries: DataFrame, faq: DataFrame, synonyms: DataFrame, n: int = 20, most_terms: int = 10) -> DataFrame:
    """(query_id, faq_id, place): questions (faq_id, question, answer, topic, source, trust, created) with one of the query's first ten terms, or of their synonyms, in one of three texts, in any case.

    Questions that hold the first term come first, then the trusted, then the new; of the best n those that look like questions stay, each once by its first 80 characters. General sources must hold the first term in question or answer. synonyms has terms, an array a group.
    """
    words = F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda w: F.length(w) > 2)
    q = queries.select("query_id", F.array_distinct(words).alias("terms")).where(F.size("terms") > 0)
    groups = synonyms.select(F.explode("terms").alias("term"), F.col("terms").alias("__g"))
    more = q.select("query_id", F.explode("terms").alias("term")).join(groups, "term").groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__g")))).alias("more"))
    q = q.join(more, "query_id", "left").select("query_id", F.element_at("terms", 1).alias("first"), F.slice(F.array_union("terms", F.coalesce("more", F.array().cast("array<string>"))), 1, most_terms).alias("terms"))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    f = faq.where(F.length("question").between(*QUESTION_LENGTHS)).select("faq_id", low("question").alias("lq"), low("answer").alias("la"), low("topic").alias("lt"), "source", "trust", "created")
    for start in EMPTY_QUESTIONS:
        f = f.where(~F.col("lq").startswith(start))
    has = F.exists("terms", lambda t: F.contains("lq", t) | F.contains("la", t) | F.contains("lt", t))
    direct = F.contains("lq", F.col("first"))
    vague = F.coalesce(F.col("source") == "general", F.lit(False)) & ~(direct | F.contains("la", F.col("first")))
    found = in_turns(f, q, "query_id", has & ~vague)
    best = first_n(found.withColumn("direct", direct), ["query_id"], [F.desc("direct"), F.desc_nulls_last("trust"), F.desc("created"), "faq_id"], n)
    once = first_n(best.withColumnRenamed("rank", "place").withColumn("key", F.left(F.trim("lq"), F.lit(80))), ["query_id", "key"], ["place"], 1)
    return once.where(F.contains("lq", F.lit("?")) | F.trim("lq").rlike(ASKS)).select("query_id", "faq_id", "place")
