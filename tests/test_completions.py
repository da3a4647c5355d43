from pageloom.operators import lists

PAGES = [
    (1, "Garten", "alles im garten, garten und Garten", "https://a.de/garten"),
    (2, "Garten", "", "https://b.de/"),
    (3, "Gartenbau heute", None, None),
    (4, "Der Garten", "", "https://c.de/x"),
    (5, "Wintergarten", "", ""),
    (6, "Gast hat Renten", "", ""),
    (7, "Andere Seite", "garten " * 4, "https://d.de/"),
    (8, "Noch eine Seite", "GARTEN " * 9, "https://e.de/garten"),
    (9, "Ganz fremd", "nichts", "https://f.de/"),
    (10, "", "garten garten", "https://g.de/garten"),
    (11, "a.c", "", ""),
    (12, "abc", "", ""),
    (13, None, "garten", "garten"),
    (14, "\U0001f600\U0001f601 lachen", "", ""),
]


def asked(spark, *queries, n=8):
    rows = lists.autocomplete(spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"), spark.createDataFrame(PAGES, "page_id long, title string, content string, url string").repartition(3), n)
    found = {}
    for r in rows.orderBy("query_id", "rank").collect():
        found.setdefault(queries[r.query_id], []).append((r.title, r.score))
    return found


def test_titles_contents_and_urls_count(spark):
    got = asked(spark, " Garten ", "a.c", "ac", "x", "", "\U0001f600\U0001f601", "zzz", None)
    assert got[" Garten "] == [("Garten", 120), ("Gartenbau heute", 90), ("Der Garten", 80), ("Wintergarten", 60), ("Noch eine Seite", 50), ("Gast hat Renten", 30), ("Andere Seite", 20)]
    assert got["a.c"] == [("a.c", 100)]
    assert got["ac"][:3] == [("\U0001f600\U0001f601 lachen", 60), ("a.c", 30), ("abc", 30)]
    assert got["x"] == [("Der Garten", 20)]
    assert got["\U0001f600\U0001f601"] == [("\U0001f600\U0001f601 lachen", 90)]
    assert "" not in got and "zzz" not in got and None not in got


def test_the_best_are_kept(spark):
    assert asked(spark, "garten", n=2) == {"garten": [("Garten", 120), ("Gartenbau heute", 90)]}
    assert asked(spark, "") == {}


def test_a_long_content_is_read_whole(spark):
    pages = spark.createDataFrame([(1, "lang", "wort " * 200_000 + "nadel", "")], "page_id long, title string, content string, url string")
    got = lists.autocomplete(spark.createDataFrame([(1, "nadel")], "query_id int, query string"), pages).collect()
    assert [tuple(r) for r in got] == [(1, "lang", 5, 1)]
