"""Filters, lists, joins and top-k over pages, posts, collections and articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.columns import tokens, yes
from pageloom.functions.tables import materialised

# Parameters that only track, by name or by prefix.
TRACKING_NAMES = "fbclid gclid dclid msclkid yclid igshid mc_cid mc_eid ref ref_src source spm".split()
TRACKING_PREFIXES = ("utm_", "pk_", "mtm_")


def clean_url(url: Column) -> Column:
    """url without fragment and tracking parameters; the order of the others stays."""
    bare = F.regexp_replace(url, r"#.*$", "")
    path, query = F.regexp_replace(bare, r"\?.*$", ""), F.regexp_extract(bare, r"\?(.*)$", 1)

    def keeps(p: Column) -> Column:
        name = F.lower(F.substring_index(p, "=", 1))
        tracks = name.isin(TRACKING_NAMES)
        for prefix in TRACKING_PREFIXES:
            tracks |= name.startswith(prefix)
        return (p != "") & ~tracks

    kept = F.array_join(F.filter(F.split(query, "&"), keeps), "&")
    return F.concat(path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def normalise_query(query: Column) -> Column:
    """Lower case, marks out, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(query), r"[^\p{L}\p{N}\s-]", " "), r"\s+", " "))


def search_operators(queries: DataFrame) -> DataFrame:
    """queries with site, intitle and filetype (null if absent) and plain, the query without them."""
    take = lambda name: F.nullif(F.regexp_extract("query", rf"(?i)(?:^|\s){name}:(\S+)", 1), F.lit(""))
    plain = F.trim(F.regexp_replace(F.regexp_replace("query", r"(?i)(^|\s)(?:site|intitle|filetype):\S+", " "), r"\s+", " "))
    return queries.withColumns({"site": F.lower(take("site")), "intitle": F.lower(take("intitle")), "filetype": F.lower(take("filetype")), "plain": plain})


def apply_search_operators(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, page_id) of pages that satisfy the operators of each query that has any. Queries are few and held by every task."""
    q = search_operators(queries).where("site is not null or intitle is not null or filetype is not null").select("query_id", "site", "intitle", "filetype")
    path = F.regexp_replace(F.lower("url"), r"[?#].*$", "")
    fits = F.coalesce(F.contains("domain", F.col("site")), F.lit(True)) & F.coalesce(F.contains(F.lower("title"), F.col("intitle")), F.lit(True)) & F.coalesce(F.endswith(path, F.concat(F.lit("."), F.col("filetype"))), F.lit(True))
    return pages.select("page_id", "url", "domain", "title").join(F.broadcast(q), fits).select("query_id", "page_id")


def filter_time(pages: DataFrame, code: str, as_of: str) -> DataFrame:
    """Pages of the last day, week or month (d, w, m); rows without a date go."""
    days = {"d": 1, "w": 7, "m": 30}[code]
    return pages.where(F.col("published_at") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {days} days"))


def filter_lang(pages: DataFrame, lang: str) -> DataFrame:
    return pages.where(F.coalesce("language", F.lit("de")) == lang)


def filter_tab(ranking: DataFrame, tab: str) -> DataFrame:
    test = {"images": F.coalesce(F.length("image"), F.lit(0)) > 0, "videos": F.col("video_count") > 0, "news": F.col("category") == "news"}
    return ranking.where(test[tab]) if tab in test else ranking


def apply_retention(events: DataFrame, ts: str, days: int, as_of: str) -> DataFrame:
    return events.where(F.col(ts) >= F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {days} days"))


def collections_with_counts(collections: DataFrame, entries: DataFrame) -> DataFrame:
    """collections with n_entries, the entries that aren't hidden."""
    n = entries.where(~yes("hidden")).groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("n_entries"))
    return collections.join(n, "id", "left").withColumn("n_entries", F.coalesce("n_entries", F.lit(0)))


def top_collections(collections: DataFrame, n: int = 20) -> DataFrame:
    """The n collections of most likes, then most entries, then smallest id."""
    return collections.orderBy(F.desc("likes"), F.desc("n_entries"), "id").limit(n)


def browse_collections(collections: DataFrame, category: str, key: str, n: int = 20) -> DataFrame:
    """The n first collections whose category contains a text in any case, by likes or date."""
    order = {"likes": F.desc("likes"), "date": F.desc("created_at")}[key]
    return collections.where(F.col("category").ilike(f"%{category}%")).orderBy(order, "id").limit(n)


def list_entries(collections: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, n, url, place): visible entries of every collection in order."""
    visible = entries.where(~yes("hidden")).join(collections.select(F.col("id").alias("collection_id")), "collection_id", "left_semi")
    return visible.select(F.col("collection_id").alias("id"), "n", "url", F.row_number().over(Window.partitionBy("collection_id").orderBy("n", "url")).alias("place"))


def similar_articles(articles: DataFrame, n: int = 10) -> DataFrame:
    """(web_id, other_id, rank): up to n articles in one's neighbours, in those of its neighbours, or with the same original, by originality. articles has web_id, original_id, similar_ids and originality.

    Ids with very many neighbours would square in the second hop, so neighbours are cut to the n most original of each id first: no other can be among the n best of a hop.
    """
    direct = articles.select("web_id", F.explode("similar_ids").alias("other_id")).where("web_id <> other_id").distinct()
    known = articles.select(F.col("web_id").alias("other_id"), "originality")
    best = Window.partitionBy("web_id").orderBy(F.desc("originality"), "other_id")
    near = direct.join(known, "other_id").withColumn("i", F.row_number().over(best)).where(F.col("i") <= n + 1).select("web_id", "other_id")
    second = near.select("web_id", F.col("other_id").alias("via")).join(near.select(F.col("web_id").alias("via"), "other_id"), "via").select("web_id", "other_id")
    group = articles.where("original_id is not null").select("original_id", F.col("web_id").alias("other_id"), "originality")
    top = Window.partitionBy("original_id").orderBy(F.desc("originality"), "other_id")
    mates = articles.select("web_id", "original_id").join(group.withColumn("i", F.row_number().over(top)).where(F.col("i") <= n + 1), "original_id").select("web_id", "other_id")
    pairs = near.unionByName(second).unionByName(mates).where("web_id <> other_id").distinct()
    ranked = pairs.join(known, "other_id").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= n).select("web_id", "other_id", "rank")


def apply_blacklist(ranking: DataFrame, blocked: DataFrame) -> DataFrame:
    """ranking (user_id, domain) without hosts that the user blocks."""
    return ranking.join(blocked.select("user_id", F.lower("host").alias("domain")), ["user_id", "domain"], "left_anti")


def apply_whitelist(ranking: DataFrame, allowed: DataFrame, preferences: DataFrame) -> DataFrame:
    """ranking with only allowed hosts for users who switched that on and have a list."""
    on = preferences.where("only_allowed").select("user_id").join(allowed.select("user_id").distinct(), "user_id", "left_semi").withColumn("__on", F.lit(True))
    ok = allowed.select("user_id", F.lower("host").alias("domain"), F.lit(True).alias("__ok")).distinct()
    out = ranking.join(on, "user_id", "left").join(ok, ["user_id", "domain"], "left")
    return out.where(~yes("__on") | yes("__ok")).drop("__on", "__ok")


def blocked_domains(blocked: DataFrame, n: int = 20) -> DataFrame:
    return blocked.groupBy("host").agg(F.countDistinct("user_id").alias("n_users")).orderBy(F.desc("n_users"), "host").limit(n)


def paywall_domains(reports: DataFrame) -> DataFrame:
    """(domain, n_reports) of distinct reports of a url by a user."""
    return reports.select("domain", F.md5("url").alias("url_hash"), "reporter_id").dropDuplicates(["url_hash", "reporter_id"]).groupBy("domain").agg(F.count("*").alias("n_reports"))


def reputation(scored: DataFrame, votes: DataFrame) -> DataFrame:
    """(domain, trust, positive, negative): domains of scored pages with their mean trust, and domains that only have votes."""
    pages = scored.groupBy("domain").agg(F.round(F.avg("trust_score"), 4).alias("trust")).join(votes.select("domain", "positive", "negative"), "domain", "left")
    only = votes.join(scored.select("domain"), "domain", "left_anti").select("domain", F.lit(None).cast("double").alias("trust"), "positive", "negative")
    return pages.unionByName(only)


def star_ratings(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("domain").agg(F.round(F.avg("stars"), 1).alias("mean_stars"), F.count("*").alias("n"), F.count_if("approved").alias("n_approved"))


def _grams(text: Column, k: int) -> Column:
    """Each run of k characters of a text, in one pass over it."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), 1)


def autocomplete(queries: DataFrame, pages: DataFrame, n: int = 8) -> DataFrame:
    """(query_id, title, score, rank): the best n titles, shorter ones first among equals. A title counts 100 if it is the query, 90 if it begins with it, 80 if one of its words does, 60 if it holds it and 30 if it has its letters in order; below 50 the page's content may count instead, 5 for each time it holds the query and 30 at most. A url that holds the query adds 20. All in any case; of pages with one title the best counts. Empty queries and titles have no rows; null contents and urls are empty. pages has page_id, title, content and url.

    A page that holds a query has all its runs of three characters (or all of a shorter one), and a title with its letters in order has each two of them that follow one another, in that order. So pages are looked up by the one of these that fewest pages have, and only what is found is scored. Of the pages' own runs and pairs only those that some query has are stored.
    """
    from pageloom.operators.similarity import match_score

    asked = queries.select("query_id", F.lower(F.trim("query")).alias("q")).where("q <> ''")
    size = F.length("q")
    rows = pages.where("title <> ''").select("page_id", "title", F.lower(F.coalesce("content", F.lit(""))).alias("content"), F.lower(F.coalesce("url", F.lit(""))).alias("url"))
    low = F.lower(F.trim("title"))
    text = F.concat_ws("\n", low, "content", "url")
    letters = F.filter(F.split(low, ""), lambda c: c != "")
    behind = lambda c: F.array_distinct(F.slice("letters", F.array_position("letters", c) + 1, F.size("letters")))
    pairs = F.flatten(F.transform(F.array_distinct("letters"), lambda c: F.transform(behind(c), lambda d: F.concat(c, d))))
    marked = lambda kind, parts: F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("part")))
    needs = F.concat(marked("run", F.when(size >= 3, _grams(F.col("q"), 3)).otherwise(F.array("q"))), marked("pair", _grams(F.col("q"), 2)))
    needs = materialised(asked.select("query_id", "q", F.inline(F.array_distinct(needs))), "completion-needs")
    runs = rows.select("page_id", F.explode(F.array_distinct(F.concat(*(_grams(text, k) for k in (1, 2, 3))))).alias("part")).withColumn("kind", F.lit("run"))
    ordered = rows.select("page_id", letters.alias("letters")).select("page_id", F.explode(pairs).alias("part")).withColumn("kind", F.lit("pair"))
    held = materialised(runs.unionByName(ordered).join(needs.select("kind", "part").distinct(), ["kind", "part"], "left_semi"), "completion-parts")
    often = held.groupBy("kind", "part").agg(F.count("*").alias("n"))
    rarest = needs.join(often, ["kind", "part"], "left").groupBy("query_id", "q", "kind").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("least"))
    found = rarest.where("least.n > 0").select("query_id", "q", "kind", "least.part").join(held, ["kind", "part"]).select("query_id", "q", "page_id").distinct()
    times = F.floor((F.length("content") - F.length(F.replace("content", F.col("q"), F.lit("")))) / size)
    by_title = match_score(F.col("q"), F.col("title"))
    score = F.greatest(by_title, F.when(by_title < 50, F.least(F.lit(30), times * 5)).otherwise(0)) + F.when(F.contains("url", F.col("q")), 20).otherwise(0)
    scored = found.join(rows, "page_id").groupBy("query_id", "title").agg(F.max(score).cast("int").alias("score")).where("score > 0")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.length("title"), "title")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def title_match(queries: DataFrame, index: DataFrame, pages: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, page_id, rank): pages with all terms of a query in the title, by trust. queries have terms, pages trust_score."""
    q = queries.select("query_id", F.size(F.array_distinct("terms")).alias("need"), F.explode(F.array_distinct("terms")).alias("term"))
    hit = q.join(index.where("n_title > 0"), "term").groupBy("query_id", "page_id", "need").agg(F.count("*").alias("n")).where("n = need")
    best = Window.partitionBy("query_id").orderBy(F.desc("trust_score"), "page_id")
    return hit.join(pages.select("page_id", "trust_score"), "page_id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("query_id", "page_id", "rank")


def top_facts_per_domain(facts: DataFrame, n: int = 10, each: int = 7) -> DataFrame:
    """(host, url, fact_id, class, place): of each host the n urls of the newest facts, and their facts: summaries first, then the newest, each of every other class. facts has host, url, fact_id, class and ts."""
    urls = facts.groupBy("host", "url").agg(F.max("ts").alias("newest"))
    urls = urls.withColumn("u", F.row_number().over(Window.partitionBy("host").orderBy(F.desc_nulls_last("newest"), "url"))).where(F.col("u") <= n)
    by_class = Window.partitionBy("host", "url", "class").orderBy(F.desc("ts"), "fact_id")
    kept = facts.join(urls.select("host", "url"), ["host", "url"], "left_semi").withColumn("i", F.row_number().over(by_class)).where((F.col("class") == "summary") | (F.col("i") <= each))
    order = Window.partitionBy("host", "url").orderBy(F.when(F.col("class") == "summary", 0).otherwise(1), F.desc("ts"), "fact_id")
    return kept.withColumn("place", F.row_number().over(order)).select("host", "url", "fact_id", "class", "place")


def sample_rows(rows: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows in a seeded random order of their ids."""
    return rows.orderBy(F.md5(F.concat_ws(" ", F.col(id_col), F.lit(seed))), id_col).limit(n)


def sample_news(rows: DataFrame, n: int, seed: int, as_of: str, day: int = 24, week: int = 168) -> DataFrame:
    """n rows (url, fact_id, ts), one a url, in a seeded random order: of the last day, or of the last week where the day has fewer than n urls. Each url stands with its first row in that order."""
    key = F.md5(F.concat_ws(" ", "fact_id", F.lit(seed)))
    now = F.to_timestamp(F.lit(as_of))

    def drawn(hours: int) -> DataFrame:
        recent = rows.where((F.col("ts") >= now - F.make_dt_interval(hours=F.lit(hours))) & F.col("url").isNotNull())
        one = recent.groupBy("url").agg(F.min(F.struct(key.alias("key"), "fact_id", "ts")).alias("r"))
        return one.orderBy("r.key", "r.fact_id").limit(n).select("url", "r.fact_id", "r.ts")

    fresh = materialised(drawn(day), "fresh-news")
    return fresh if fresh.count() == n else drawn(week)
