"""Categories of pages and domains, products, facts, contradictions between articles, and jobs that keep tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts of a domain that tell its category; the first category with a part in the domain counts.
DOMAIN_CATEGORIES = {
    "tech": "chip heise golem github stackoverflow developer computerbase notebookcheck techcrunch ct.de linux arduino raspberry bleepingcomputer".split(),
    "news": "spiegel stern zeit.de focus faz. tagesschau sueddeutsche welt.de handelsblatt reuters bbc. cnn. ard. zdf. ntv. ndr. mdr.".split(),
    "shopping": "amazon ebay otto.de zalando mediamarkt saturn. idealo geizhals mydealz check24 billiger.".split(),
    "sport": "kicker sportschau transfermarkt goal. sport1 ran.de".split(),
    "wiki": "wikipedia wikihow fandom.com wikia. wikidata".split(),
    "health": "netdoktor apotheke gesundheit doctolib jameda healthline".split(),
    "finance": "finanzen. boerse. comdirect sparkasse ing.de dkb.de consorsbank onvista".split(),
    "travel": "booking. tripadvisor airbnb holidaycheck expedia skyscanner".split(),
    "science": "nature.com sciencedirect pubmed arxiv studyflix simpleclub sofatutor".split(),
}
# Parts of a url that tell its category.
URL_CATEGORIES = [("chefkoch.de/rezepte", "recipe"), ("kochbar.de/rezept", "recipe"), ("duden.de/rechtschreibung", "dictionary")]
# Patterns of product attributes, and the colour that each name means.
MATERIAL = r"(?i)((\d+%?\s*)?(bio-)?(baumwolle|cotton|wolle|seide|leder|polyester|leinen))"
FIT = r"(?i)((regular|slim|oversized|loose|comfort)\s*fit)"
PRINTED, FUNCTIONAL = r"(?i)siebdruck|print|bestickt|logo", r"(?i)wasserdicht|atmungsaktiv"
COLOURS = {"schwarz": "#202124", "black": "#202124", "weiß": "#f1f3f4", "white": "#f1f3f4", "blau": "#1a73e8", "blue": "#1a73e8", "navy": "#0d47a1", "rot": "#ea4335", "red": "#ea4335", "grau": "#9aa0a6", "grey": "#9aa0a6", "anthrazit": "#5f6368", "grün": "#34a853", "green": "#34a853"}
# Least confidence and kinds of contradictions that are shown.
CONFIDENT, SHOWN_KINDS = 80, ("factual", "rating")


def infer_category(domain: Column) -> Column:
    low, out = F.lower(domain), None
    for name, parts in DOMAIN_CATEGORIES.items():
        test = low.rlike("|".join(p.replace(".", r"\.") for p in parts))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def detect_category(url: Column, category: Column) -> Column:
    return F.coalesce(*(F.when(F.contains(F.lower(url), F.lit(part)), name) for part, name in URL_CATEGORIES), category)


def product_attributes(products: DataFrame, text: str = "text") -> DataFrame:
    """products with attributes, up to three, and colours, up to four: the first name of each colour in the text."""
    t = F.col(text)
    some = F.array(F.nullif(F.regexp_extract(t, MATERIAL, 1), F.lit("")), F.nullif(F.regexp_extract(t, FIT, 1), F.lit("")), F.when(t.rlike(PRINTED), "Premium Print"), F.when(t.rlike(FUNCTIONAL), "Funktional"))
    by_colour: dict[str, list[str]] = {}
    for name, colour in COLOURS.items():
        by_colour.setdefault(colour, []).append(name)
    word = lambda name: t.rlike(rf"(?i)(?:^|[^\p{{L}}\p{{N}}_]){name}(?:[^\p{{L}}\p{{N}}_]|$)")
    colours = [F.coalesce(*(F.when(word(n), n) for n in names)) for names in by_colour.values()]
    return products.withColumns({"attributes": F.slice(F.array_compact(some), 1, 3), "colours": F.slice(F.array_compact(F.array(*colours)), 1, 4)})


def semantic_bonus(pairs: DataFrame) -> DataFrame:
    """pairs (query, entities) with bonus: 5 for every entity that holds a word of the query or is held by one, 30 at most."""
    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: F.length(w) > 2)
    hits = F.filter("entities", lambda e: (F.length(e) > 0) & F.exists(words, lambda w: F.contains(F.lower(e), w) | F.contains(w, F.lower(e))))
    return pairs.withColumn("bonus", F.least(F.lit(30), F.greatest(F.lit(0), F.size(hits)) * 5))


def relevance_reasons(rows: DataFrame) -> DataFrame:
    """rows with reasons: the first three labels whose part of the relevance is high."""
    rules = [("keyword", 20, "Relevant"), ("phrase", 8, "Exakter Treffer"), ("phrase", 4, "Thematisch passend"), ("depth", 10, "Ausführlich"), ("readability", 10, "Lesbar"), ("engagement", 8, "Popular"), ("structure", 5, "Strukturiert"), ("image_count", 3, "Multimedia")]
    return rows.withColumn("reasons", F.slice(F.array_compact(F.array(*(F.when(F.col(c) > least, label) for c, least, label in rules))), 1, 3))


def contradictions(pairs: DataFrame, per_side: int | None = 1, n: int = 3) -> DataFrame:
    """(url, other_url, other_domain, confidence, owners, rank): contradictions (url_a, domain_a, owner_a and the same of b, kind, confidence, created_at, id) seen from each side: the n most confident of each url, of which per_side, if given, may be of one other domain."""
    good = pairs.where((F.col("confidence") >= CONFIDENT) & F.col("kind").isin(*SHOWN_KINDS))

    def side(a: str, b: str) -> DataFrame:
        owners = F.when(F.col(f"owner_{a}") == F.col(f"owner_{b}"), F.concat(f"owner_{a}", F.lit(" (intern!)"))).otherwise(F.concat_ws(" vs ", f"owner_{a}", f"owner_{b}"))
        return good.select(F.col(f"url_{a}").alias("url"), F.col(f"url_{b}").alias("other_url"), F.col(f"domain_{b}").alias("other_domain"), "confidence", "created_at", "id", owners.alias("owners"))

    both = side("a", "b").unionByName(side("b", "a"))
    order = [F.desc("confidence"), F.desc("created_at"), F.col("id"), F.col("other_url")]
    if per_side:
        both = both.withColumn("i", F.row_number().over(Window.partitionBy("url", "other_domain").orderBy(*order))).where(F.col("i") <= per_side)
    best = both.withColumn("rank", F.row_number().over(Window.partitionBy("url").orderBy(*order))).where(F.col("rank") <= n)
    return best.select("url", "other_url", "other_domain", "confidence", "owners", "rank")


def similarity_report(articles: DataFrame, index: DataFrame) -> DataFrame:
    """articles (web_id, original_id, similarity_type) with is_original, and url and kind of the original."""
    own = index.select(F.col("id").alias("original_id"), F.col("url").alias("original_url"))
    kinds = articles.select(F.col("web_id").alias("original_id"), F.col("similarity_type").alias("original_type"))
    out = articles.join(own, "original_id", "left").join(kinds, "original_id", "left")
    return out.withColumn("is_original", F.col("original_id").isNull() | (F.col("original_id") == F.col("web_id")))


def facts_with_urls(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """facts (fact_id, page_id, url, class) with the url of their page where they have none."""
    return facts.join(pages.select("page_id", F.col("url").alias("page_url")), "page_id", "left").withColumn("url", F.coalesce("url", "page_url")).drop("page_url")


def fact_counts(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, n_facts, has_summary)."""
    return facts_with_urls(facts, pages).where("url is not null").groupBy("url").agg(F.count("*").alias("n_facts"), F.max(F.col("class") == "summary").alias("has_summary"))


def visible_messages(messages: DataFrame, blocks: DataFrame, n: int = 50) -> DataFrame:
    """The newest n messages (id, room, author, sent_at) of each room whose author isn't blocked, in any case."""
    free = messages.withColumn("who", F.lower("author")).join(blocks.select(F.lower("name").alias("who")).distinct(), "who", "left_anti").drop("who")
    return free.withColumn("rank", F.row_number().over(Window.partitionBy("room").orderBy(F.desc("sent_at"), F.desc("id")))).where(F.col("rank") <= n)


def hidden_queue(lists: DataFrame, entries: DataFrame, reports: DataFrame) -> DataFrame:
    """(kind, id, reasons): hidden lists and hidden entries that no reviewer released, with the distinct reasons of their reports."""
    shut = lambda df, kind: df.where("hidden and not released").select(F.lit(kind).alias("kind"), "id")
    why = reports.groupBy("kind", F.col("target_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return shut(lists, "list").unionByName(shut(entries, "entry")).join(why, ["kind", "id"], "left")


def suggestions_with_week(dictionary: DataFrame, stats: DataFrame, as_of: str) -> DataFrame:
    """dictionary (query) with the searches of the week of as_of; stats has query, week and searches."""
    week = F.date_trunc("week", F.to_timestamp(F.lit(as_of)))
    return dictionary.join(stats.where(F.col("week") == week).select("query", "searches"), "query", "left").withColumn("searches", F.coalesce("searches", F.lit(0)))


def security_events(events: DataFrame) -> DataFrame:
    """(type, severity, n, last_at) of security events."""
    return events.groupBy("type", "severity").agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))


def collection_likes(log: DataFrame) -> DataFrame:
    """(collection_id, likes): users that like a collection, each once."""
    return log.select("collection_id", "user_id").distinct().groupBy("collection_id").agg(F.count("*").alias("likes"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key: an upsert of appended rows."""
    newest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__i", F.row_number().over(newest)).where("__i = 1").drop("__i")
