"""Rows below, at and above the limits of rules, and folds against plain versions."""

import itertools
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pageloom.operators import behaviour, links, lists, moderation, page_scores, ranking, reliability, similarity, trends, votes
from pageloom.sources import sinks
from pageloom.sources.html import extract_page_features

T0 = datetime(2024, 1, 1)


def test_expected_ctr_and_labels(spark):
    df = spark.createDataFrame([(p,) for p in (0, 1, 10, 11, 20, 21)], "p int").select(behaviour.expected_ctr(F.col("p")))
    assert [round(r[0], 6) for r in df.collect()] == [0.005, 0.285, 0.024, 0.02, 0.008, 0.005]
    df = spark.createDataFrame([(d,) for d in (None, 7_999, 8_000, 44_999, 45_000)], "d long").select(behaviour.dwell_label(F.col("d")))
    assert [r[0] for r in df.collect()] == ["open", "pogo", "neutral", "neutral", "good"]


def test_closing_clicks(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    clicks = spark.createDataFrame([(1, "s", at(0)), (2, "s", at(5)), (3, "t", at(0)), (4, "u", at(0))], "id long, session_id string, clicked_at timestamp")
    returns = spark.createDataFrame([("s", at(6), None), ("s", at(7), 9), ("t", at(31), None), ("u", at(30), 77), ("x", at(1), 5)], "session_id string, ts timestamp, dwell_ms long")
    got = {r.id: r.dwell_ms for r in behaviour.close_clicks(clicks, returns).collect()}
    assert got == {1: 9, 2: 60_000, 3: None, 4: 77}  # the second return finds click 2 closed and closes click 1, which is open and seven minutes old


def test_hard_block_limits(spark):
    rows = [("CRITICAL", 90), ("HIGH", 29), ("HIGH", 30), ("SAFE", 19), ("SAFE", 20)]
    assert [tuple(r) for r in page_scores.hard_block(spark.createDataFrame(rows, "spam_level string, trust_score int")).collect()] == [("HIGH", 30), ("SAFE", 20)]


def test_vote_folds(spark):
    seq = [(1, "d", 1), (1, "d", 1), (2, "d", 1), (2, "d", -1), (3, "d", 0), (3, "d", 1), (3, "d", 1), (3, "d", -1)]
    df = spark.createDataFrame([(u, d, v, T0 + timedelta(seconds=i), i) for i, (u, d, v) in enumerate(seq)], "user_id long, domain string, value int, created_at timestamp, id long")
    assert [tuple(r) for r in votes.fold_votes(df).collect()] == [("d", 0, 0, 2)]
    times = [0, 100, 200, 300, 400, 500, 550, 601, 700, 1300]
    df = spark.createDataFrame([(1, i, T0 + timedelta(seconds=t)) for i, t in enumerate(times)], "user_id long, id long, created_at timestamp")
    kept, want = [], []
    for t in times:
        live = [k for k in kept if k >= t - 600]
        want.append(len(live) < 5)
        if want[-1]:
            kept.append(t)
    assert [r.accepted for r in votes.accept_votes(df).orderBy("id").collect()] == want
    assert [r.rejected for r in votes.vote_bursts(df).orderBy("id").collect()] == [sum(0 <= t - s <= 600 for s in times[:i]) >= 5 for i, t in enumerate(times)]


def test_weight_tiers(spark):
    df = spark.createDataFrame([(s,) for s in (14, 15, 30, 31, 50, 51, 65, 66, 80, 81)], "s int").select(votes.weight_tier(F.col("s")))
    assert [r[0] for r in df.collect()] == [0, 0.1, 0.1, 0.25, 0.25, 0.5, 0.5, 0.75, 0.75, 1.0]


def test_diversity_of_families_by_hand(spark):
    urls = [f"https://{d}/{i}" for i, d in enumerate(["a.com"] * 6 + ["b.com"] * 3 + ["x.com", "twitter.com", "c.co.uk", "www.c.co.uk"] + ["d.com"] * 4 + ["a.com"] * 3)]
    df = spark.createDataFrame([(1, "GENERAL", u, 100 - i) for i, u in enumerate(urls)], "query_id long, intent string, url string, final_score int")
    got = [r.url for r in ranking.diversify(df.withColumn("rank", F.lit(0))).orderBy("rank").collect()]
    family = {"a.com": "a", "b.com": "b", "x.com": "t", "twitter.com": "t", "c.co.uk": "c", "www.c.co.uk": "c", "d.com": "d"}
    kept, n = [], Counter()
    for u in urls:
        f = family[u.split("/")[2]]
        if (len(kept) < 10 and n[f] >= 3) or n[f] >= 5:
            continue
        n[f] += 1
        kept.append(u)
    assert got == kept


def test_domain_families(spark):
    names = ["amazon.co.uk", "shop.amazon.de", "x.com", "a.b.example.org", "foo.co.uk", "www2.foo.co.uk", "localhost"]
    df = spark.createDataFrame([(n,) for n in names], "d string").select(links.domain_family(F.col("d")))
    assert [r[0] for r in df.collect()] == ["amazon", "amazon", "twitter", "example.org", "foo.co.uk", "foo.co.uk", "localhost"]


def test_insults_and_spam(spark):
    rows = [(1, "du bist so dumm"), (2, "ich bin dumm, sagst du"), (3, "das ist dumm"), (4, "1di0t!"), (5, "wir killen den boss im level, kommst du"), (6, "du willst ihn töten"), (7, ""), (8, None), (9, "loser sind dort"),
            (10, "du alter nazi"), (11, "ein nazi wie dich brauchen wir nicht"), (12, "die nazis im 2. weltkrieg"), (13, "du weißt, was ein nazi war"), (14, "ihr faschisten")]
    got = {r.id: (r.insult_action, r.insult_category) for r in moderation.insult_check(spark.createDataFrame(rows, "id int, body string")).collect()}
    assert got == {1: ("block", "insult"), 2: (None, None), 3: (None, None), 4: ("block", "insult"), 5: (None, None), 6: ("block", "threat"), 7: (None, None), 8: (None, None), 9: (None, None),
                   10: ("block", "hate"), 11: ("block", "hate"), 12: (None, None), 13: (None, None), 14: (None, None)}
    texts = [("item", "x" * 9), ("item", "fine text here."), ("item", "HALLO IHR ALLE DA"), ("item", "soooooo gut ist das"), ("comment", ""), ("item", "http://a.b http://c.d http://e.f text"), ("title", "click here now")]
    got = [r.spam_issues for r in moderation.text_spam(spark.createDataFrame(texts, "kind string, body string")).collect()]
    assert got == [["too_short", "repeating_chars"], [], ["excessive_caps"], ["repeating_chars"], ["empty"], ["too_many_urls"], ["spam_phrase"]]


def test_near_hashes_are_all_found(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(40)]
    hashes = sorted({0, *base, *(b ^ sum(1 << x for x in rng.sample(range(63), rng.randint(1, 8))) for b in base for _ in range(4))})
    want = {(a, b): (a ^ b).bit_count() for a, b in itertools.combinations(hashes, 2) if a and (a ^ b).bit_count() <= 6}
    got = [(r.hash_a, r.hash_b, r.distance) for r in similarity.near_hashes(spark.createDataFrame([(h,) for h in hashes], "simhash long")).collect()]
    assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want


def test_shingle_pairs_match_brute_force(spark):
    import random

    rng = random.Random(6)
    words = [f"word{i}" for i in range(300)]
    texts = [[rng.choice(words) for _ in range(60)] for _ in range(12)]
    for t in list(texts):
        for n in (1, 2, 4):
            c = t.copy()
            for i in rng.sample(range(60), n):
                c[i] = rng.choice(words)
            texts.append(c)
    posts = [(i, "s" if i % 5 else "t", " ".join(t)) for i, t in enumerate(texts)] + [(900, "s", posts_text) for posts_text in [" ".join(texts[1])]]
    sets = {i: {tuple(x[k : k + 4]) for k in range(57)} for i, _, p in posts for x in [p.split()]}
    want = {(a, b) for (a, s, x), (b, u, y) in itertools.combinations(posts[:-1], 2) if s == u and x != y and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.65}
    got = {(r.id_a, r.id_b) for r in similarity.shingle_duplicates(spark.createDataFrame(posts, "id long, scope string, body string")).collect()}
    assert got == want and want
    assert [tuple(r) for r in similarity.repeats(spark.createDataFrame(posts, "id long, scope string, body string")).collect()] == [(900, 1)]


def test_spelling(spark):
    words = spark.createDataFrame([(w,) for w in ("fenster", "ferien", "garten", "über", "gärten")], "word string")
    queries = spark.createDataFrame([(1, "fesnter"), (2, "garten"), (3, "two words"), (4, "gaerten")], "query_id long, query string")
    got = defaultdict(list)
    for r in similarity.did_you_mean(queries, words).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.word)
    assert got[1][0] == "fenster" and 2 not in got and 3 not in got and set(got[4]) == {"garten", "gärten"}


def test_urls_and_operators(spark):
    df = spark.createDataFrame([("https://a.b/c?utm_source=x&id=3&fbclid=1#top",), ("https://a.b/?ref=x",)], "u string").select(lists.clean_url(F.col("u")))
    assert [r[0] for r in df.collect()] == ["https://a.b/c?id=3", "https://a.b/"]
    q = lists.search_operators(spark.createDataFrame([(1, "site:x.org intitle:Rust the book filetype:pdf")], "query_id long, query string")).first()
    assert (q.site, q.intitle, q.filetype, q.plain) == ("x.org", "rust", "pdf", "the book")


def test_trend_tiers(spark):
    as_of = T0 + timedelta(days=20)
    log = [(q, as_of - timedelta(minutes=i)) for q, n in (("fourteen", 14), ("fifteen", 15), ("abc", 40)) for i in range(n)]
    past = spark.createDataFrame([("fifteen", (T0 + timedelta(days=10 + i)).date(), 60) for i in range(3)], "query string, search_date date, daily_count long")
    got = trends.scan_trends(spark.createDataFrame(log, "query string, ts timestamp"), past, str(as_of)).collect()
    assert [(r.query, r.n_recent, r.expected, r.factor, r.multiplier, r.score) for r in got] == [("fifteen", 15, 5.0, 3.0, 1.5, 9)]


def test_good_links_count_in_order(spark):
    urls = lambda *hosts: [f"https://{h}/x" for h in hosts]
    pages = [(1, "self.com", urls("en.wikipedia.org", "good.com", "top.com", "arxiv.org", "github.com", "self.com")), (2, "b.com", urls("ads-net.com", "bad.com", "bad.com")), (3, "c.com", None)]
    rep = [("good.com", None, 19, 1), ("top.com", 85.0, 0, 0), ("bad.com", 5.0, 1, 9), ("github.com", 15.0, 0, 0)]
    got = reliability.score_reliability(spark.createDataFrame(pages, "page_id long, domain string, outbound_links array<string>"), spark.createDataFrame(rep, "domain string, trust double, positive long, negative long"))
    assert sorted((r.page_id, r.reliability_penalty, r.reliability_bonus) for r in got.collect()) == [(1, 8, 4.5), (2, 23, 0.0), (3, 0, 0.0)]


def test_diversity_is_a_pass_down_the_list(spark):
    """Against a plain pass over many rows of few families, one of them with the best 300."""
    rng, rows = random.Random(3), []
    for q, intent in enumerate(["NEWS", "COMMERCIAL", "INFORMATIONAL", "OTHER", "OTHER"]):
        for i in range(400):
            site = "hot" if i < 300 and q != 3 else rng.choice("abcdefgh")
            rows.append((q, intent, f"https://www.{site}.com/{i:04d}", 1000 - i))
    df = spark.createDataFrame(rows, "query_id int, intent string, url string, final_score int")
    brands = spark.createDataFrame([(4, "hot.com"), (1, None)], "query_id int, brand string")
    got = {}
    for r in ranking.diversify(df.withColumn("rank", F.lit(0)), brands).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.url)
    limits = {"NEWS": (10, 20), "COMMERCIAL": (2, 3), "INFORMATIONAL": (2, 4)}
    for q in range(5):
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: -r[3])
        most_top, most = limits.get(mine[0][1], (3, 5))
        kept, seen = [], {}
        for _, _, url, _ in mine:
            family = url.split("/")[2]
            n = seen.get(family, 0)
            if q == 4 or not ((len(kept) < 10 and n >= most_top) or n >= most):
                kept.append(url)
                seen[family] = n + 1
        assert got[q] == kept, q


def test_folded_votes_are_those_of_the_fold(spark):
    from itertools import product

    want, rows = [], []
    for user, values in enumerate(v for n in range(1, 6) for v in product((1, 0, -1), repeat=n)):
        state = None
        for i, x in enumerate(values):
            rows.append((user, "d", x, f"2024-01-01 00:00:{i:02}", i))
            state = None if state == x else x
        want.append(state)
    df = spark.createDataFrame(rows, "user_id int, domain string, value int, created_at string, id int").withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert votes.fold_votes(df).first() == ("d", want.count(1), want.count(0), want.count(-1))


def test_related_searches_by_session_and_word(spark):
    log = [("a", "red shoes"), ("a", "blue hat"), ("a", "blue hat"), ("b", "old red shoes"), ("b", "coat"), ("c", "red wine"), ("c", "socks"), ("d", "running shoes"), ("d", "password red"), ("e", "re"), ("f", None)]
    df = spark.createDataFrame([(s, q, "2024-01-30 00:00:00") for s, q in log], "session_id string, query string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = trends.related_searches(df, spark.createDataFrame([("Red shoes",)], "query string"), "2024-01-31 00:00:00")
    assert [(r.related, r.n) for r in got.orderBy("rank").collect()] == [("blue hat", 2), ("coat", 1), ("old red shoes", 1), ("red wine", 1), ("running shoes", 1)]


def test_page_features_of_html(spark):
    page = """<html lang="de"><head><title>Ein Titel</title><meta name="viewport" content="w"><meta name="author" content="A. B."><meta property="og:image" content="https://i/x.png">
      <script type="application/ld+json">{"@type": "Product", "price": "12.50", "ratingValue": 4.5, "reviewCount": 7, "datePublished": "2024-01-02"}</script></head>
      <body><h1>Kopf</h1><p>Zwei Worte. Noch drei Worte!</p><img src="a"><IMG src="b"><table></table><ol><li>x</li></ol><div class="box ad">Kauf</div><div class="shadow"></div>
      <a href="/in">i</a><a href="https://other.org/x">o</a><a class="q" href="https://shop.org/?tag=me">s</a><div class="paywall-box"></div><iframe src="https://youtube.com/e"></iframe></body></html>"""
    got = {r.page_id: r for r in extract_page_features(spark.createDataFrame([(1, "u", page), (2, "u", ""), (3, "u", None)], "page_id int, url string, html string")).collect()}
    r = got[1]
    assert (r.title, r.language, r.author, r.image, r.schema_type, r.price, r.rating_value, r.rating_count, r.published) == ("Ein Titel", "de", "A. B.", "https://i/x.png", "Product", 12.5, 4.5, 7, "2024-01-02")
    assert (r.image_count, r.video_count, r.has_table, r.has_steps, r.heading_count, r.link_count, r.internal_links, r.affiliate_link_count, r.ad_count) == (2, 1, True, True, 1, 3, 1, 1, 1)
    assert (r.mobile_friendly, r.has_paywall, r.outbound_links, r.content) == (True, True, ["https://other.org/x", "https://shop.org/?tag=me"], "Ein Titel Kopf Zwei Worte. Noch drei Worte! x Kauf i o s")
    assert r.avg_sentence_length == 6.5 and got[2].word_count == got[3].word_count == 1 and got[3].text_to_code == 0 and got[2].author is None


def test_sinks(spark, tmp_path):
    old, new = (spark.createDataFrame(rows, "k string, n int") for rows in ([("a", 1), ("b", 2), (None, 3)], [("b", 5), (None, 6), ("c", 7)]))
    path = str(tmp_path / "t")
    sinks.append(old, path)
    sinks.append(new, path)
    assert spark.read.parquet(path).count() == 6
    assert sorted(map(repr, map(tuple, sinks.upsert(old, new, ["k"]).collect()))) == ["('a', 1)", "('b', 5)", "('c', 7)", "(None, 6)"]
    raw = spark.createDataFrame([("Wie?", "x" * 6000, "s" * 60, 2, 1), ("wie?", "y", None, 1, 2), ("WAS?", "z", "s", 1, 3), (None, "a", "s", 1, 4), ("Wo?", None, "s", 1, 5)], "question string, answer string, source string, ts int, id int")
    got = sinks.ingest_answers(raw, spark.createDataFrame([("was?",)], "question string")).collect()
    assert [(r.question, r.answer, r.source) for r in got] == [("wie?", "y", None)]
    assert sinks.ingest_votes(spark.createDataFrame([("s", "u", "up", 1), ("", "u", "up", 1), ("s", None, "up", 1), ("s", "u", "sideways", 1)], "session_id string, url string, vote_type string, ts int")).count() == 1


def test_letters_in_order_take_linear_time(spark):
    rows = [("abc", "a-b-c"), ("abc", "acb"), ("aab", "ab"), ("a.c", "a.xc"), ("a.c", "abc"), ("aaaaaaaaab", "a" * 5_000), ("ba", "ab"), ("", "x")]
    df = spark.createDataFrame(rows, "q string, t string")
    assert [r[0] for r in df.select(similarity.match_score(F.col("q"), F.col("t"))).collect()] == [30, 0, 0, 30, 0, 0, 0, 0]


def test_personal_boost_by_hand(spark):
    rows = spark.createDataFrame([(1, "a.de", "news"), (1, "b.de", "news"), (1, "c.de", "shop"), (2, "a.de", "news")], "user_id long, domain string, category string")
    liked = spark.createDataFrame([(1, "a.de", "news", 3), (1, "x.de", "news", 2), (1, "y.de", "shop", 1), (3, "a.de", "news", 9)], "user_id long, domain string, category string, times long")
    got = {(r.user_id, r.domain): r.personal_boost for r in ranking.personalise(rows, liked).collect()}
    assert got == {(1, "a.de"): 20, (1, "b.de"): 5, (1, "c.de"): 0, (2, "a.de"): 0}


def test_news_of_the_week_fill_up_a_short_day(spark):
    rows = spark.createDataFrame([(f"u{i // 2}", i, T0 - timedelta(hours=h)) for i, h in enumerate([1, 2, 3, 4, 30, 40, 50, 60, 200, 210])] + [(None, 99, T0)], "url string, fact_id long, ts timestamp")
    names = lambda n: [r.url for r in lists.sample_news(rows, n, 7, str(T0)).collect()]
    assert set(names(2)) == {"u0", "u1"} and set(names(4)) == {"u0", "u1", "u2", "u3"} == set(names(9)) and len(names(3)) == 3


def test_pages_without_embedding_newest_first(spark):
    pages = spark.createDataFrame([("a", "t" * 30, "c" * 30, T0), ("b", None, "c" * 51, T0 + timedelta(1)), ("c", "t", None, T0), ("d", None, "c" * 60, None), ("e", None, "c" * 60, T0)], "url string, title string, content string, crawled_at timestamp")
    known = spark.createDataFrame([("e",), ("e",)], "url string")
    assert [r.url for r in similarity.missing_embeddings(pages, known).collect()] == ["b", "a", "d"]
    assert [r.url for r in similarity.missing_embeddings(pages, known, 1).collect()] == ["b"]
