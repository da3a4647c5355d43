"""Queries over posts, similar texts, collections and lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pageloom.functions.tables import materialised
from pageloom.operators import lists as L
from pageloom.operators import moderation as M
from pageloom.operators import similarity as S
from pageloom.operators import page_scores as P
from pageloom.plans import pages as G
from pageloom.plans import ranking as K
from pageloom.sources import views as v
from pageloom.sources.views import AS_OF, with_views

TOKENS = K.TOKENS


def patterns(spark, d):
    """The first three words of every benchmark item as a phrase, and two regular expressions."""
    phrases = v.read(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("id"), F.substring_index("text", " ", 3).alias("pattern"), F.lit("phrase").alias("kind"), F.lit("leak").alias("category"), F.col("item_id").cast("int").alias("priority"), F.when(F.col("item_id") % 2 == 0, "block").otherwise("flag").alias("action"), F.lit(True).alias("active"))
    return phrases.unionByName(spark.createDataFrame([(-100, "[0-9]{16}", "regex", "number", 50, "flag", True), (-101, "MIT License", "regex", "license", 60, "block", True), (-102, "the", "phrase", "off", 99, "block", False)], "id int, pattern string, kind string, category string, priority int, action string, active boolean"))


def text_spam(spark, d):
    return M.text_spam(v.v_posts(spark, d)).select("id", "spam_ok", F.array_join("spam_issues", ",").alias("spam_issues"))


def insults(spark, d):
    return M.insult_check(v.v_posts(spark, d)).select("id", "insult_action", "insult_category")


def pattern_hits(spark, d):
    return M.pattern_check(v.v_posts(spark, d), patterns(spark, d))


def moderated(spark, d):
    posts = v.v_posts(spark, d)
    return M.moderate(posts, patterns(spark, d), S.repeats(posts))


def verdict_log(spark, d):
    return M.verdicts(M.insult_check(v.v_posts(spark, d)), AS_OF)


def moderation_stats(spark, d):
    return M.moderation_stats(verdict_log(spark, d), AS_OF)


def moderation_queue(spark, d):
    return M.moderation_queue(verdict_log(spark, d))


def pattern_stats(spark, d):
    return M.pattern_stats(patterns(spark, d))


def reports(spark, d):
    e = v.v_events(spark, d)
    return e.select(F.col("event_id").alias("report_id"), F.lit("item").alias("kind"), (F.col("k") * 3).alias("target_id"), F.element_at(F.array(*map(F.lit, ("spam", "insult", "illegal", "wrong", "other", "nonsense"))), (F.col("event_id") % 6 + 1).cast("int")).alias("reason"), F.col("ts").alias("created_at"))


def report_intake(spark, d):
    return M.ingest_reports(reports(spark, d), v.v_posts(spark, d))


def auto_hidden(spark, d):
    return M.auto_hide(v.v_posts(spark, d).select("id", "kind"), report_intake(spark, d), 15)


def suspicious_texts(spark, d):
    return M.flag_injection(v.v_posts(spark, d), "body").groupBy("suspicious").agg(F.count("*").alias("n"))


def semantic_hits(spark, d):
    e = v.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return M.semantic_check(e, e.where("id % 100 = 0"), 0.3)


def nearest_phrases(spark, d):
    """Documents against the phrases of the benchmark, else vectors of their ids against those of ids divisible by 100."""
    e = v.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    posts = v.v_posts(spark, d).where("kind = 'item'")
    return M.nearest_phrase(posts, e.join(posts.select("id"), "id", "left_semi"), patterns(spark, d), e.where("id % 100 = 0"), 0.3)


def sentence_verdicts(spark, d):
    """Documents with the vectors of their ids, against those of ids divisible by 100 as a list of sentences."""
    e = v.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    texts = v.v_posts(spark, d).where("kind = 'item'").select("id", F.col("body").alias("text")).join(e, "id")
    actions, k = F.array(*map(F.lit, ("flag", "block", "flag", "log"))), F.col("id")
    listed = e.where("id % 100 = 0").select("id", "embedding", F.concat(F.lit("c"), (k % 700).cast("string")).alias("category"), (k % 900).alias("priority"), F.element_at(actions, (k / 100 % 4 + 1).cast("int")).alias("action"), (k % 1100 != 0).alias("active"))
    return M.sentence_verdicts(texts, listed, 0.3)


def validated_lists(spark, d):
    """Pages as lists, with title and description; vectors of their ids are those of descriptions, and every second pattern vector flags."""
    pages, e = v.v_pages(spark, d), v.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    field = lambda c, name, place: pages.select(F.col("page_id").alias("id"), F.lit(name).alias("field"), F.lit(place).alias("place"), F.lit(place == 0).alias("required"), F.lit(name).alias("kind"), F.col(c).alias("body"))
    near = M.semantic_check(e, e.where("id % 100 = 0"), 0.3).select("id", F.lit("description").alias("field"), F.when(F.col("pattern_id") % 200 == 0, "flag").otherwise("allow").alias("action"), F.lit("near").alias("category"))
    repeats = S.repeats(pages.select(F.col("page_id").alias("id"), F.lit("lists").alias("scope"), F.trim("title").alias("body"))).select("id", F.lit("title").alias("field"))
    return M.validate_fields(field("title", "title", 0).unionByName(field("content", "description", 1)), patterns(spark, d), repeats, near)


def word_simhash(spark, d):
    return S.word_simhash(v.read(spark, d, "documents")).select("doc_id", "simhash_hex")


def near_duplicates(spark, d):
    return S.near_duplicates(materialised(S.word_simhash(v.read(spark, d, "documents")), "word-simhash"))


def deduped_results(spark, d):
    """The documents of each language and source as a ranked list, longest first."""
    docs = v.read(spark, d, "documents").withColumn("url", F.col("doc_id").cast("string"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("n_chars"), "doc_id")
    ranked = docs.select(F.concat_ws("/", "lang", "source").alias("query_id"), "url", F.row_number().over(order).alias("rank"))
    return S.dedupe_results(ranked, materialised(S.word_simhash(docs, "url"), "word-simhash"))


def shingle_duplicates(spark, d):
    return S.shingle_duplicates(v.v_posts(spark, d)).select("scope", "id_a", "id_b", "similarity")


def exact_repeats(spark, d):
    return S.repeats(v.v_posts(spark, d))


def vocabulary(spark, d):
    return S.vocabulary(v.v_pages(spark, d))


def misspelt(words):
    """The words of five characters and more with their third and fourth letters swapped, of ten and more with the last letter doubled."""
    w = words.where("length(word) >= 5")
    swapped = F.concat(F.substring("word", 1, 2), F.substring("word", 4, 1), F.substring("word", 3, 1), F.substring("word", 5, 1000))
    return w.select(F.conv(F.substring(F.md5("word"), 1, 15), 16, 10).cast("long").alias("query_id"), F.when(F.length("word") >= 10, F.concat("word", F.right("word", F.lit(1)))).otherwise(swapped).alias("query"))


def did_you_mean(spark, d):
    words = materialised(vocabulary(spark, d), "vocabulary")
    return S.did_you_mean(misspelt(words), words)


def autocorrected(spark, d):
    words = materialised(vocabulary(spark, d), "vocabulary")
    return S.autocorrect(S.did_you_mean(misspelt(words), words, 1, 90))  # the best word only, and none that can't pass


def changed_documents(spark, d):
    pages = v.v_pages(spark, d)
    known = pages.where("page_id % 3 > 0").select("page_id", F.sha1(F.concat_ws(" ", "title", "title", F.when(F.col("page_id") % 3 == 1, F.col("content")).otherwise("old"))).alias("text_hash"))
    return S.changed_documents(pages, known, "page_id")  # several pages may have one url


def letter_shares(texts: list[str]) -> list[list[float]]:
    """A small stand-in for a model: the shares of three letters."""
    return [[t.count(c) / len(t) for c in "ens"] for t in texts]


def embedded_pages(spark, d):
    """Vectors of the pages whose urls changed_documents names, each page once."""
    new = v.v_pages(spark, d).select("page_id", "url", "content").join(changed_documents(spark, d), "url", "left_semi")
    return S.embed(new, letter_shares, "page_id").select("page_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("shares")).select("page_id", *(F.get("shares", i).alias(f"share_{c}") for i, c in enumerate("ens")))


def url_keys(spark, d):
    return v.read(spark, d, "pages").select("page_id", S.url_key(F.col("url")).alias("url_key"), L.clean_url(F.col("url")).alias("clean_url"))


def recent_pages(spark, d):
    return L.filter_lang(L.filter_time(v.v_pages(spark, d), "m", AS_OF), "en").select("page_id", "published_at")


def tab_counts(spark, d):
    pages = v.v_pages(spark, d)
    return L.filter_tab(pages, "images").select(F.lit("images").alias("tab")).unionAll(L.filter_tab(pages, "videos").select(F.lit("videos"))).unionAll(L.filter_tab(pages, "news").select(F.lit("news"))).groupBy("tab").agg(F.count("*").alias("n"))


def operator_hits(spark, d):
    q = spark.createDataFrame([(1, "site:example.org the"), (2, "intitle:the"), (3, "word filetype:html"), (4, "plain words")], "query_id long, query string")
    return L.apply_search_operators(q, v.v_pages(spark, d))


def collection_counts(spark, d):
    return L.collections_with_counts(v.v_collections(spark, d), v.v_entries(spark, d)).select("id", "likes", "n_entries")


def top_collections(spark, d):
    return L.top_collections(collection_counts(spark, d))


def browsed_collections(spark, d):
    return L.browse_collections(v.v_collections(spark, d), "urgent", "date").select("id", "category", "created_at")


def entry_lists(spark, d):
    return L.list_entries(v.v_collections(spark, d), v.v_entries(spark, d))


def retained_events(spark, d):
    return L.apply_retention(v.v_events(spark, d), "ts", 7, AS_OF).select("event_id")


def similar_articles(spark, d):
    e = v.read(spark, d, "orders")
    k = F.col("o_orderkey")
    return L.similar_articles(e.select(k.alias("web_id"), (k % 500).alias("original_id"), F.array(k + 1, k + 2, k * 7 % 1000).alias("similar_ids"), (k * 13 % 97).cast("double").alias("originality")))


def reputations(spark, d):
    return L.reputation(P.score_trust(v.v_pages(spark, d)), v.v_domain_votes(spark, d))


def blocklist(spark, d):
    return v.v_clicks(spark, d).where("position > 15").select("user_id", F.col("domain").alias("host"))


def unblocked_clicks(spark, d):
    return L.apply_blacklist(v.v_clicks(spark, d), blocklist(spark, d)).select("id")


def allowed_clicks(spark, d):
    prefs = v.v_clicks(spark, d).select("user_id").distinct().select("user_id", (F.col("user_id") % 2 == 0).alias("only_allowed"))
    return L.apply_whitelist(v.v_clicks(spark, d), blocklist(spark, d), prefs).select("id")


def blocked_domains(spark, d):
    return L.blocked_domains(blocklist(spark, d))


def paywall_domains(spark, d):
    return L.paywall_domains(v.v_clicks(spark, d).select("url", "domain", F.col("user_id").alias("reporter_id")))


def star_ratings(spark, d):
    return L.star_ratings(v.v_clicks(spark, d).select("domain", (F.col("id") % 5 + 1).alias("stars"), (F.col("id") % 3 > 0).alias("approved")))


def autocompletions(spark, d):
    return L.autocomplete(v.v_queries(spark, d), v.v_pages(spark, d)).select("query_id", "title", "score", "rank")


def title_matches(spark, d):
    return L.title_match(K.terms(spark, d), K.index(spark, d), materialised(P.score_trust(v.v_pages(spark, d)), "trust"))


def facts(spark, d):
    e = v.v_events(spark, d)
    return e.select(F.concat(F.lit("h"), (F.col("k") % 10).cast("string")).alias("host"), F.concat(F.lit("u"), F.col("k").cast("string"), F.lit("-"), (F.col("user_id") % 9).cast("string")).alias("url"), F.col("event_id").alias("fact_id"), F.when(F.col("event_type") == "view", "summary").otherwise(F.col("event_type")).alias("class"), "ts")


def top_facts(spark, d):
    return L.top_facts_per_domain(facts(spark, d))


def sampled_facts(spark, d):
    return L.sample_rows(facts(spark, d).where("class = 'summary'"), "fact_id", 25, 7).select("fact_id")


def sampled_news(spark, d):
    return L.sample_news(facts(spark, d).where("class = 'summary'"), 25, 7, AS_OF).select("url", "fact_id")


def missing_embeddings(spark, d):
    pages = v.v_pages(spark, d).withColumn("crawled_at", F.col("published_at"))
    return S.missing_embeddings(pages, pages.where("page_id % 3 > 0").select("url"), 100)


def _posts(sql: str) -> str:
    return with_views(sql, "v_posts")


def spoken_sql(text: str) -> str:
    """The words of a text as moderation reads them, between single spaces."""
    out = rf"regexp_replace(translate(lower(coalesce({text}, '')), '0134578', 'oieastb'), '[*!@#$%^&_+.]', '', 'g')"
    for c in "abcdefghijklmnopqrstuvwxyzäöüß":  # no back-references here
        out = f"regexp_replace({out}, '{c}{{3,}}', '{c}{c}', 'g')"
    return f"' ' || array_to_string({TOKENS.format(out)}, ' ') || ' '"


def rule_sql() -> str:
    """The place of the first insult rule that the words w break."""
    says = lambda p: f"regexp_matches(w, ' ({p}) ')"

    def test(words, needs, excludes):
        if needs and needs.startswith(M.AFTER):
            return f"regexp_matches(w, ' ({words}) (.* )?({needs.removeprefix(M.AFTER)}) ')"
        return " AND ".join([says(words), *([says(needs)] if needs else []), *(f"NOT {says(e)}" for e in excludes)])

    return "CASE " + " ".join(f"WHEN {test(words, needs, excludes)} THEN {i}" for i, (words, _, _, needs, excludes) in enumerate(M.INSULT_RULES, 1)) + " END"


ACTIONS, CATEGORIES = ("[" + ", ".join(f"'{r[i]}'" for r in M.INSULT_RULES) + "]" for i in (1, 2))
INSULTS = f"insulted AS (SELECT * EXCLUDE w, {ACTIONS}[i] AS insult_action, {CATEGORIES}[i] AS insult_category FROM (SELECT *, {rule_sql()} AS i FROM (SELECT *, {spoken_sql('body')} AS w FROM v_posts)))"
LIMIT = ["CASE kind " + " ".join(f"WHEN '{k}' THEN {x[i]}" for k, x in M.LENGTHS.items()) + f" ELSE {M.OTHER_LENGTHS[i]} END" for i in (0, 1)]
COUNT = "len(regexp_extract_all(t, '{}'))"
SPAM_TESTS = {
    "empty": "n = 0", "too_short": f"n > 0 AND n < {LIMIT[0]}", "too_long": f"n > {LIMIT[1]}", "too_many_urls": COUNT.format(r"https?://\S+|www\.\S+") + f" > {M.MAX_URLS}", "too_many_emojis": COUNT.format(M.EMOJI) + f" > {M.MAX_EMOJIS}",
    "excessive_caps": f"n > 10 AND letters > 0 AND {COUNT.format('[A-ZÄÖÜ]')} > letters * CAST({M.MAX_UPPER} AS DOUBLE)",
    "repeating_chars": f"len(list_filter(range(1, len(c) - {M.MAX_REPEAT - 1}), lambda i: c[i] <> chr(10) AND c[i] <> chr(13) AND " + " AND ".join(f"c[i] = c[i + {k}]" for k in range(1, M.MAX_REPEAT + 1)) + ")) > 0",
    "too_many_special_chars": "n > 10 AND " + COUNT.format(r"[^\p{L}\p{N}\s\x0B]") + f" > n * CAST({M.MAX_SPECIAL} AS DOUBLE)",
    "spam_phrase": " OR ".join(f"contains(lower(t), '{p}')" for p in M.SPAM_PHRASES),
}
SPAM = "spam AS (SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in SPAM_TESTS.items()) + f"], lambda x: x IS NOT NULL), ',') AS spam_issues FROM (SELECT *, length(t) AS n, {COUNT.format('[a-zA-ZäöüÄÖÜ]')} AS letters, regexp_extract_all(t, '(?s).') AS c FROM (SELECT id, kind, trim(coalesce(body, '')) AS t FROM v_posts)))"
LOG = "log AS (SELECT id AS post_id, kind, left(body, 500) AS text, CASE insult_action WHEN 'block' THEN 1.0 WHEN 'flag' THEN 0.5 ELSE 0 END AS score, insult_category AS category, coalesce(insult_action = 'block', false) AS blocked, coalesce(insult_action = 'flag', false) AS flagged FROM insulted)"
POSTS = with_views("", "v_posts").rstrip() + ",\n"
PATTERNS = """patterns AS (SELECT CAST(item_id AS INT) AS id, array_to_string(string_split(text, ' ')[1:3], ' ') AS pattern, 'phrase' AS kind, 'leak' AS category, CAST(item_id AS INT) AS priority, CASE WHEN item_id % 2 = 0 THEN 'block' ELSE 'flag' END AS action, true AS active FROM benchmark
  UNION ALL SELECT -100, '[0-9]{16}', 'regex', 'number', 50, 'flag', true UNION ALL SELECT -101, 'MIT License', 'regex', 'license', 60, 'block', true UNION ALL SELECT -102, 'the', 'phrase', 'off', 99, 'block', false)"""
HITS = PATTERNS + """, hits AS (SELECT id, pattern_id, action, category FROM (SELECT v.id, p.id AS pattern_id, action, category, row_number() OVER (PARTITION BY v.id ORDER BY priority DESC, p.id) AS i FROM v_posts v JOIN patterns p ON active AND CASE WHEN p.kind = 'phrase' THEN contains(lower(body), lower(pattern)) ELSE regexp_matches(body, pattern) END) WHERE i = 1)"""
REPORTS = f"""reports AS (SELECT event_id AS report_id, 'item' AS kind, k * 3 AS target_id, ['spam', 'insult', 'illegal', 'wrong', 'other', 'nonsense'][CAST(event_id % 6 + 1 AS INT)] AS reason, ts AS created_at FROM (SELECT *, {v.K} AS k FROM events)),
taken AS (SELECT *, created_at + INTERVAL 1 YEAR AS ip_deadline FROM reports WHERE reason <> 'nonsense' AND target_id IN (SELECT id FROM v_posts WHERE kind = 'item'))"""
CLEAN_KEY = "md5(array_to_string(" + TOKENS.format("body") + ", ' '))"
NEAREST = """SELECT id, pattern_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, pattern_id) AS i FROM (
      SELECT v.vec_id AS id, p.vec_id AS pattern_id, round(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: CAST(v.embedding[i] AS DOUBLE) * p.embedding[i])) / (sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(p.embedding, lambda x: CAST(x AS DOUBLE) * x)))), 6) AS cosine FROM embeddings v JOIN embeddings p ON p.vec_id % 100 = 0 AND p.vec_id <> v.vec_id)) WHERE i = 1 AND cosine > 0.3"""
SENTENCES = """listed AS (SELECT vec_id AS sid, embedding AS se, 'c' || (vec_id % 700) AS category, vec_id % 900 AS priority, ['flag', 'block', 'flag', 'log'][CAST((vec_id // 100) % 4 + 1 AS INT)] AS action FROM embeddings WHERE vec_id % 100 = 0 AND vec_id % 1100 <> 0 ORDER BY priority DESC, vec_id LIMIT 100),
near AS (SELECT * FROM (SELECT vec_id AS id, sid, category, priority, action, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * se[i])) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(se, lambda x: CAST(x AS DOUBLE) * x)))), 6) AS cosine
  FROM embeddings JOIN documents ON doc_id = vec_id AND length(trim(text)) >= 10 JOIN listed ON len(se) = len(embedding)) WHERE cosine >= 0.3),
seen AS (SELECT *, CASE action WHEN 'block' THEN 0 WHEN 'flag' THEN 1 ELSE 2 END AS grade FROM (SELECT *, coalesce(sum(CASE WHEN action = 'block' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY priority DESC, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM near) WHERE stops = 0)
SELECT id, ['block', 'flag', 'allow'][grade + 1] AS verdict, sid AS sentence_id, category, cosine AS similarity, n_matches FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n_matches, row_number() OVER (PARTITION BY id ORDER BY grade, priority DESC, sid) AS i FROM seen) WHERE i = 1"""
CHANGED = "SELECT url, now AS text_hash FROM (SELECT url, sha1(title || ' ' || title || ' ' || content) AS now, CASE page_id % 3 WHEN 1 THEN sha1(title || ' ' || title || ' ' || content) WHEN 2 THEN sha1(title || ' ' || title || ' old') END AS old FROM v_pages) WHERE now IS DISTINCT FROM old"
REPEATS = f"repeats AS (SELECT id, original_id FROM (SELECT id, min(id) OVER (PARTITION BY scope, {CLEAN_KEY}) AS original_id FROM v_posts WHERE length(body) >= 40) WHERE id > original_id)"
LISTS = with_views("", "v_pages").rstrip() + """,
v_posts AS (SELECT page_id * 2 AS id, page_id, 0 AS place, 'title' AS kind, 'lists' AS scope, trim(coalesce(title, '')) AS body FROM v_pages
  UNION ALL SELECT page_id * 2 + 1, page_id, 1, 'description', 'texts', trim(coalesce(content, '')) FROM v_pages WHERE trim(coalesce(content, '')) <> ''),
""" + ",\n".join((SPAM, INSULTS, HITS, REPEATS)) + f""", near AS ({NEAREST}),
steps AS (SELECT page_id, place, kind, spam_issues, insult_category, h.category AS h_category, CASE WHEN body = '' THEN 'required' WHEN spam_issues <> '' THEN 'spam' WHEN insult_action = 'block' THEN 'insult' WHEN h.action IN ('block', 'flag') THEN 'pattern'
    WHEN h.action IS NULL AND place = 1 AND n.pattern_id % 200 = 0 THEN 'semantic' WHEN place = 0 AND original_id IS NOT NULL THEN 'duplicate' END AS step
  FROM insulted i JOIN spam USING (id) LEFT JOIN hits h USING (id) LEFT JOIN repeats USING (id) LEFT JOIN near n ON n.id = page_id),
failed AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS f FROM steps WHERE step IS NOT NULL)
SELECT p.page_id AS id, step IS NULL AS ok, kind AS field, step, CASE step WHEN 'spam' THEN spam_issues WHEN 'insult' THEN insult_category WHEN 'pattern' THEN h_category WHEN 'semantic' THEN 'near' END AS detail FROM (SELECT DISTINCT page_id FROM v_pages) p LEFT JOIN failed ON failed.page_id = p.page_id AND f = 1"""
URL_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://(www\.)?', ''), '[?#].*$', ''), '/+$', '')"
NAMES = "[" + ", ".join(f"'{n}'" for n in L.TRACKING_NAMES) + "]"
CLEAN_URL = rf"""regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', '') || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS clean_url FROM (SELECT *, array_to_string(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT list_contains({NAMES}, lower(split_part(p, '=', 1))) AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'pk_') AND NOT starts_with(p, 'mtm_')), '&') AS kept FROM pages)"""
FACTS = f"""facts AS (SELECT 'h' || (k % 10) AS host, 'u' || k || '-' || (user_id % 9) AS url, event_id AS fact_id, CASE WHEN event_type = 'view' THEN 'summary' ELSE event_type END AS class, ts FROM (SELECT *, {v.K} AS k FROM events))"""
BLOCKED = "blocked AS (SELECT DISTINCT user_id, domain AS host FROM v_clicks WHERE position > 15)"

# Letters beyond ASCII become signs that no word has, as edits are counted in bytes here.
ASCII = "translate({}, 'àáâãäåæçèéêëìíîïñòóôõöøùúûüýßÿ', '!\"#$%&()*+,-./:;<=>?@[]^`{{|}}~ ')"
VOCABULARY = f"vocabulary AS (SELECT DISTINCT word FROM (SELECT unnest(list_concat({TOKENS.format('title')}, {TOKENS.format('left(content, 100)')})) AS word FROM v_pages) WHERE length(word) > 3)"
GRAMS = "list_distinct(list_transform(range(1, length({0}) + 3), lambda i: substring('__' || {0} || '__', i, 3)))"
FOLDED = "replace(replace(replace(replace({}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
SPELT = with_views("", "v_pages").rstrip() + ",\n" + VOCABULARY + f""",
asked AS (SELECT CAST('0x' || substr(md5(word), 1, 15) AS BIGINT) AS query_id, CASE WHEN length(word) >= 10 THEN word || right(word, 1) ELSE substr(word, 1, 2) || substr(word, 4, 1) || substr(word, 3, 1) || substr(word, 5) END AS q FROM vocabulary WHERE length(word) >= 5),
a AS (SELECT query_id, q, len({GRAMS.format('q')}) AS n_q, unnest({GRAMS.format('q')}) AS g FROM asked WHERE q NOT IN (SELECT word FROM vocabulary)),
b AS (SELECT word, len({GRAMS.format('word')}) AS n_w, unnest({GRAMS.format('word')}) AS g FROM vocabulary),
common AS (SELECT query_id, q, word, floor(round(count(*) * CAST(200 AS DOUBLE) / (n_q + n_w), 6) + 0.5) AS dice, greatest(length(q), length(word)) AS longest FROM a JOIN b USING (g) GROUP BY query_id, q, word, n_q, n_w),
raw AS (SELECT query_id, word, round(least(CAST(100 AS DOUBLE), floor(round((1 - CAST(levenshtein({ASCII.format('q')}, {ASCII.format('word')}) AS DOUBLE) / longest) * 100, 6) + 0.5) * CAST(0.7 AS DOUBLE) + dice * CAST(0.3 AS DOUBLE)
    + CASE WHEN {FOLDED.format('q')} = {FOLDED.format('word')} THEN 5 ELSE 0 END + CASE WHEN left(q, 2) = left(word, 2) THEN 2 ELSE 0 END + CASE WHEN abs(length(q) - length(word)) <= 1 THEN 1 ELSE 0 END), 6) AS raw FROM common),
spelt AS (SELECT query_id, word, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, word) AS rank FROM (SELECT query_id, word, CAST(floor(raw + 0.5) AS BIGINT) AS score FROM raw WHERE raw >= 60))"""
SIMHASH_STOP = "[" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + "]"
HALVES = [f"CAST('0x' || substr(md5(w), {1 + 8 * k}, 8) AS BIGINT)" for k in (0, 1)]
BITS = [f"sum(CASE WHEN ({HALVES[k]} >> {31 - b}) & 1 = 1 THEN 1 ELSE -1 END) > 0" for k in (0, 1) for b in range(32)]
SIMHASH = f"""each AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-zäöüß0-9\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 3 AND NOT list_contains({SIMHASH_STOP}, x))) AS w FROM documents WHERE length(text) >= {S.MIN_TEXT}),
top AS (SELECT doc_id, w FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, w) AS i FROM each GROUP BY 1, 2) WHERE i <= {S.TOP_WORDS}),
prints AS (SELECT d.doc_id, coalesce(h, '0000000000000000') AS simhash_hex FROM documents d LEFT JOIN (SELECT doc_id, {' || '.join(f"format('{{:08x}}', CAST({' + '.join(f'CASE WHEN {BITS[32 * k + b]} THEN {1 << (31 - b)} ELSE 0 END' for b in range(32))} AS BIGINT))" for k in (0, 1))} AS h FROM top GROUP BY doc_id) USING (doc_id))"""

QUERIES = {
    "text_spam": (text_spam, POSTS + SPAM + " SELECT id, spam_issues = '' AS spam_ok, spam_issues FROM spam"),
    "insults": (insults, POSTS + INSULTS + " SELECT id, insult_action, insult_category FROM insulted"),
    "pattern_hits": (pattern_hits, POSTS + HITS + " SELECT * FROM hits"),
    "moderated": (moderated, POSTS + ",\n".join((SPAM, INSULTS, HITS, REPEATS)) + """ SELECT id, step IS NULL AS ok, step, CASE step WHEN 'spam' THEN spam_issues WHEN 'insult' THEN insult_category WHEN 'pattern' THEN h_category END AS detail
      FROM (SELECT i.id, CASE WHEN trim(coalesce(body, '')) = '' THEN 'required' WHEN spam_issues <> '' THEN 'spam' WHEN insult_action = 'block' THEN 'insult' WHEN h.action = 'block' THEN 'pattern' WHEN original_id IS NOT NULL THEN 'duplicate' END AS step, spam_issues, insult_category, h.category AS h_category
        FROM insulted i JOIN spam USING (id) LEFT JOIN hits h USING (id) LEFT JOIN repeats USING (id))"""),
    "moderation_stats": (moderation_stats, POSTS + INSULTS + ",\n" + LOG + " SELECT category, count(*) AS n, count(*) FILTER (WHERE blocked) AS blocked, count(*) FILTER (WHERE flagged) AS flagged, round(avg(CAST(score AS DOUBLE)), 4) AS mean_score FROM log GROUP BY category"),
    "moderation_queue": (moderation_queue, POSTS + INSULTS + ",\n" + LOG + " SELECT post_id, kind, CASE WHEN blocked THEN 'blocked' ELSE 'flagged' END AS status, left(text, 200) AS preview, category FROM log WHERE blocked OR flagged ORDER BY post_id DESC LIMIT 100"),
    "pattern_stats": (pattern_stats, "WITH " + PATTERNS + " SELECT category, count(*) AS n, count(*) FILTER (WHERE active) AS active, round(avg(priority), 4) AS mean_priority, string_agg(DISTINCT action, ',' ORDER BY action) AS actions FROM patterns GROUP BY category"),
    "report_intake": (report_intake, with_views("", "v_posts").rstrip() + ",\n" + REPORTS + " SELECT * FROM taken"),
    "auto_hidden": (auto_hidden, with_views("", "v_posts").rstrip() + ",\n" + REPORTS + " SELECT id, kind, coalesce(n, 0) AS report_count, coalesce(n, 0) >= 15 AS hidden FROM v_posts LEFT JOIN (SELECT target_id AS id, kind, count(*) AS n FROM taken GROUP BY 1, 2) USING (id, kind)"),
    "suspicious_texts": (suspicious_texts, _posts(r"SELECT regexp_matches(body, '(?i)(union\s+select|drop\s+table|insert\s+into|delete\s+from|;\s*--|<script|javascript:|onerror\s*=)') AS suspicious, count(*) AS n FROM v_posts GROUP BY 1")),
    "semantic_hits": (semantic_hits, NEAREST),
    "sentence_verdicts": (sentence_verdicts, "WITH " + SENTENCES),
    "validated_lists": (validated_lists, LISTS),
    "nearest_phrases": (nearest_phrases, POSTS + HITS + f""", held AS (SELECT hits.id, pattern_id FROM hits JOIN v_posts USING (id) WHERE kind = 'item'), near AS ({NEAREST})
      SELECT id, pattern_id, CAST(1 AS DOUBLE) AS similarity FROM held UNION ALL SELECT id, pattern_id, cosine FROM near WHERE id IN (SELECT doc_id FROM documents) AND id NOT IN (SELECT id FROM held)"""),
    "word_simhash": (word_simhash, "WITH " + SIMHASH + " SELECT * FROM prints"),
    "near_duplicates": (near_duplicates, "WITH " + SIMHASH + f""", n AS (SELECT doc_id, CAST('0x' || substr(simhash_hex, 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(simhash_hex, 9, 8) AS BIGINT) AS lo FROM prints WHERE simhash_hex <> '0000000000000000')
      SELECT a.doc_id, min(b.doc_id) AS duplicate_of FROM n a JOIN n b ON b.doc_id < a.doc_id AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {S.MAX_BITS} GROUP BY a.doc_id"""),
    "deduped_results": (deduped_results, "WITH RECURSIVE " + SIMHASH + f""", h AS (SELECT doc_id, concat_ws('/', lang, source) AS query_id, CAST(doc_id AS VARCHAR) AS url, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rank, CAST('0x' || substr(simhash_hex, 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(simhash_hex, 9, 8) AS BIGINT) AS lo FROM prints JOIN documents USING (doc_id)),
      near AS (SELECT b.query_id, b.rank, list(a.rank ORDER BY a.rank) AS before FROM h a JOIN h b ON a.query_id = b.query_id AND a.rank < b.rank AND (a.hi, a.lo) <> (0, 0) AND (b.hi, b.lo) <> (0, 0) AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {S.MAX_BITS} GROUP BY 1, 2),
      walk AS (SELECT query_id, CAST(0 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS owners FROM h WHERE rank = 1
        UNION ALL SELECT query_id, rank, list_append(owners, coalesce(list_filter(before, lambda x: owners[x] = 0 AND len(list_filter(owners, lambda o: o = x)) < {S.MAX_GROUP})[1], 0))
        FROM (SELECT h.query_id, h.rank, w.owners, coalesce(n.before, CAST([] AS BIGINT[])) AS before FROM walk w JOIN h ON h.query_id = w.query_id AND h.rank = w.rank + 1 LEFT JOIN near n ON n.query_id = h.query_id AND n.rank = h.rank)),
      owned AS (SELECT query_id, rank, nullif(owners[rank], 0) AS owner FROM walk WHERE rank > 0)
      SELECT h.query_id, CAST(h.rank AS INT) AS rank, h.url, c.url AS canonical_url, owner IS NOT NULL AS is_duplicate FROM h JOIN owned o ON o.query_id = h.query_id AND o.rank = h.rank LEFT JOIN h c ON c.query_id = o.query_id AND c.rank = o.owner"""),
    "shingle_duplicates": (shingle_duplicates, POSTS + f"""classes AS (SELECT scope, min(id) AS id, arg_min(body, id) AS body FROM v_posts WHERE length(body) >= 40 GROUP BY scope, {CLEAN_KEY}),
      cut AS (SELECT scope, id, {TOKENS.format('body')} AS ws FROM classes), sets AS (SELECT scope, id, list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) AS ss FROM cut WHERE len(ws) >= 4),
      each AS (SELECT scope, id, len(ss) AS n, unnest(ss) AS s FROM sets), pairs AS (SELECT a.scope, a.id AS id_a, b.id AS id_b, CAST(count(*) AS DOUBLE) / (a.n + b.n - count(*)) AS j FROM each a JOIN each b ON a.scope = b.scope AND a.s = b.s AND a.id < b.id GROUP BY a.scope, a.id, b.id, a.n, b.n)
      SELECT scope, id_a, id_b, round(j, 4) AS similarity FROM pairs WHERE j >= {S.MIN_JACCARD}"""),
    "exact_repeats": (exact_repeats, POSTS + REPEATS + " SELECT * FROM repeats"),
    "vocabulary": (vocabulary, with_views(f"SELECT DISTINCT word FROM (SELECT unnest(list_concat({TOKENS.format('title')}, {TOKENS.format('left(content, 100)')})) AS word FROM v_pages) WHERE length(word) > 3", "v_pages")),
    "did_you_mean": (did_you_mean, SPELT + " SELECT query_id, word, score, CAST(rank AS INT) AS rank FROM spelt WHERE rank <= 5"),
    "autocorrected": (autocorrected, SPELT + " SELECT query_id, word FROM spelt WHERE rank = 1 AND score > 90"),
    "changed_documents": (changed_documents, with_views(CHANGED, "v_pages")),
    "embedded_pages": (embedded_pages, with_views("SELECT page_id, " + ", ".join(f"round(CAST(CAST((length(content) - length(replace(content, '{c}', ''))) / CAST(length(content) AS DOUBLE) AS FLOAT) AS DOUBLE), 4) AS share_{c}" for c in "ens") + f" FROM v_pages WHERE length(content) > {S.MIN_EMBEDDED} AND url IN (SELECT url FROM ({CHANGED}))", "v_pages")),
    "url_keys": (url_keys, f"SELECT page_id, {URL_KEY} AS url_key, {CLEAN_URL}"),
    "recent_pages": (recent_pages, with_views(f"SELECT page_id, published_at FROM v_pages WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND language = 'en'", "v_pages")),
    "tab_counts": (tab_counts, with_views("SELECT tab, count(*) AS n FROM (SELECT 'images' AS tab FROM v_pages WHERE length(image) > 0 UNION ALL SELECT 'videos' FROM v_pages WHERE video_count > 0 UNION ALL SELECT 'news' FROM v_pages WHERE category = 'news') GROUP BY tab", "v_pages")),
    "operator_hits": (operator_hits, with_views(r"SELECT 1 AS query_id, page_id FROM v_pages WHERE contains(domain, 'example.org') UNION ALL SELECT 2, page_id FROM v_pages WHERE contains(lower(title), 'the') UNION ALL SELECT 3, page_id FROM v_pages WHERE ends_with(regexp_replace(lower(url), '[?#].*$', ''), '.html')", "v_pages")),
    "collection_counts": (collection_counts, with_views("SELECT id, likes, coalesce(n, 0) AS n_entries FROM v_collections LEFT JOIN (SELECT collection_id AS id, count(*) AS n FROM v_entries WHERE hidden IS NOT TRUE GROUP BY 1) USING (id)", "v_collections", "v_entries")),
    "top_collections": (top_collections, with_views("SELECT id, likes, coalesce(n, 0) AS n_entries FROM v_collections LEFT JOIN (SELECT collection_id AS id, count(*) AS n FROM v_entries WHERE hidden IS NOT TRUE GROUP BY 1) USING (id) ORDER BY likes DESC, n_entries DESC, id LIMIT 20", "v_collections", "v_entries")),
    "browsed_collections": (browsed_collections, with_views("SELECT id, category, created_at FROM v_collections WHERE category ILIKE '%urgent%' ORDER BY created_at DESC, id LIMIT 20", "v_collections")),
    "entry_lists": (entry_lists, with_views("SELECT collection_id AS id, n, url, CAST(row_number() OVER (PARTITION BY collection_id ORDER BY n, url) AS INT) AS place FROM v_entries WHERE hidden IS NOT TRUE AND collection_id IN (SELECT id FROM v_collections)", "v_collections", "v_entries")),
    "retained_events": (retained_events, f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"),
    "similar_articles": (similar_articles, """WITH a AS (SELECT o_orderkey AS web_id, o_orderkey % 500 AS original_id, [o_orderkey + 1, o_orderkey + 2, o_orderkey * 7 % 1000] AS similar_ids, CAST(o_orderkey * 13 % 97 AS DOUBLE) AS originality FROM orders),
      d AS (SELECT DISTINCT web_id, unnest(similar_ids) AS other_id FROM a), n AS (SELECT d.* FROM d JOIN a ON a.web_id = other_id WHERE d.web_id <> other_id),
      p AS (SELECT * FROM n UNION SELECT x.web_id, y.other_id FROM n x JOIN n y ON y.web_id = x.other_id UNION SELECT x.web_id, y.web_id FROM a x JOIN a y USING (original_id))
      SELECT web_id, other_id, CAST(rank AS INT) AS rank FROM (SELECT p.web_id, other_id, row_number() OVER (PARTITION BY p.web_id ORDER BY originality DESC, other_id) AS rank FROM p JOIN a ON a.web_id = other_id WHERE p.web_id <> other_id) WHERE rank <= 10"""),
    "reputations": (reputations, with_views("", "v_pages", "v_domain_votes").rstrip() + ",\n" + G.TRUST + " SELECT coalesce(t.domain, d.domain) AS domain, trust, positive, negative FROM (SELECT domain, round(avg(CAST(trust_score AS DOUBLE)), 4) AS trust FROM trust GROUP BY 1) t FULL JOIN v_domain_votes d ON t.domain = d.domain"),
    "unblocked_clicks": (unblocked_clicks, with_views("", "v_clicks").rstrip() + ",\n" + BLOCKED + " SELECT id FROM v_clicks c WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.user_id = c.user_id AND b.host = c.domain)"),
    "allowed_clicks": (allowed_clicks, with_views("", "v_clicks").rstrip() + ",\n" + BLOCKED + " SELECT id FROM v_clicks c WHERE user_id % 2 = 1 OR user_id NOT IN (SELECT user_id FROM blocked) OR EXISTS (SELECT 1 FROM blocked b WHERE b.user_id = c.user_id AND b.host = c.domain)"),
    "blocked_domains": (blocked_domains, with_views("", "v_clicks").rstrip() + ",\n" + BLOCKED + " SELECT host, count(DISTINCT user_id) AS n_users FROM blocked GROUP BY host ORDER BY n_users DESC, host LIMIT 20"),
    "paywall_domains": (paywall_domains, with_views("SELECT domain, count(*) AS n_reports FROM (SELECT DISTINCT domain, url, user_id FROM v_clicks) GROUP BY domain", "v_clicks")),
    "star_ratings": (star_ratings, with_views("SELECT domain, round(avg(id % 5 + 1), 1) AS mean_stars, count(*) AS n, count(*) FILTER (WHERE id % 3 > 0) AS n_approved FROM v_clicks GROUP BY domain", "v_clicks")),
    "autocompletions": (autocompletions, with_views(r"""SELECT query_id, title, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(title), title) AS rank FROM (
      SELECT query_id, title, max(CAST(greatest(named, CASE WHEN named < 50 THEN least(30, 5 * times) ELSE 0 END) + CASE WHEN contains(url, q) THEN 20 ELSE 0 END AS INT)) AS score
      FROM (SELECT *, (length(content) - length(replace(content, q, ''))) // length(q) AS times, CASE WHEN t = q THEN 100 WHEN starts_with(t, q) THEN 90 WHEN len(list_filter(string_split_regex(t, '\s+'), lambda w: starts_with(w, q))) > 0 THEN 80
        WHEN contains(t, q) THEN 60 WHEN regexp_matches(t, array_to_string(list_transform(string_split(q, ''), lambda c: regexp_escape(c)), '.*'), 's') THEN 30 ELSE 0 END AS named
        FROM (SELECT query_id, lower(trim(query)) AS q FROM v_queries), (SELECT title, trim(lower(title)) AS t, lower(coalesce(content, '')) AS content, lower(coalesce(url, '')) AS url FROM v_pages WHERE title <> '') WHERE q <> '')
      GROUP BY query_id, title HAVING score > 0)) WHERE rank <= 8""", "v_pages", "v_queries")),
    "title_matches": (title_matches, K.SEARCH + ",\n" + G.TRUST + """ SELECT query_id, page_id, CAST(rank AS INT) AS rank FROM (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY trust_score DESC, page_id) AS rank FROM (
      SELECT query_id, page_id FROM (SELECT query_id, len(list_distinct(terms)) AS need, unnest(list_distinct(terms)) AS term FROM terms) JOIN idx USING (term) WHERE n_title > 0 GROUP BY query_id, page_id, need HAVING count(*) = need) JOIN trust USING (page_id)) WHERE rank <= 5"""),
    "top_facts": (top_facts, "WITH " + FACTS + """, u AS (SELECT host, url FROM (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY max(ts) DESC NULLS LAST, url) AS u FROM facts GROUP BY host, url) WHERE u <= 10),
      kept AS (SELECT f.*, row_number() OVER (PARTITION BY host, url, class ORDER BY ts DESC, fact_id) AS i FROM facts f JOIN u USING (host, url))
      SELECT host, url, fact_id, class, CAST(row_number() OVER (PARTITION BY host, url ORDER BY CASE WHEN class = 'summary' THEN 0 ELSE 1 END, ts DESC, fact_id) AS INT) AS place FROM kept WHERE class = 'summary' OR i <= 7"""),
    "sampled_news": (sampled_news, "WITH " + FACTS + f""", keyed AS (SELECT url, fact_id, ts, md5(fact_id || ' 7') AS key FROM facts WHERE class = 'summary' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY),
      day AS (SELECT url, arg_min(fact_id, (key, fact_id)) AS fact_id, min(key) AS key FROM keyed WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY GROUP BY 1), week AS (SELECT url, arg_min(fact_id, (key, fact_id)) AS fact_id, min(key) AS key FROM keyed GROUP BY 1)
      SELECT url, fact_id FROM (SELECT * FROM day WHERE (SELECT count(*) FROM day) >= 25 UNION ALL SELECT * FROM week WHERE (SELECT count(*) FROM day) < 25) ORDER BY key, fact_id LIMIT 25"""),
    "missing_embeddings": (missing_embeddings, with_views("SELECT url, published_at AS crawled_at FROM v_pages WHERE page_id % 3 = 0 AND length(coalesce(title, '') || coalesce(content, '')) > 50 ORDER BY published_at DESC NULLS LAST, url LIMIT 100", "v_pages")),
    "sampled_facts": (sampled_facts, "WITH " + FACTS + " SELECT fact_id FROM facts WHERE class = 'summary' ORDER BY md5(fact_id || ' 7'), fact_id LIMIT 25"),
}
