"""Sentence lists, entries of several fields, and intents that results correct, on hand-made rows."""

from pageloom.operators import moderation, ranking, similarity


def test_sentence_list_stops_at_the_first_block(spark):
    sentences = [(1, [1.0, 0.0], "a", 50, "flag", True), (2, [1.0, 0.1], "b", 90, "log", True), (3, [1.0, 0.0], "c", 40, "block", True), (4, [1.0, 0.0], "d", 30, "block", True), (5, [0.0, 1.0], "e", 99, "block", False), (6, [0.0, 2.0], "f", 10, "flag", True), (7, [3.0, 4.0], "g", 5, "log", True)]
    texts = [(1, "long enough", [2.0, 0.0]), (2, "long enough", [0.0, 1.0]), (3, " short    ", [2.0, 0.0]), (4, "long enough", None), (5, "long enough", [0.0, 0.0]), (6, "long enough", [4.0, 3.0]), (7, "long enough", [1.0]), (8, "long enough", [-1.0, 0.0])]
    df = spark.createDataFrame(texts, "id long, text string, embedding array<double>")
    listed = spark.createDataFrame(sentences, "id long, embedding array<double>, category string, priority int, action string, active boolean")
    got = {r.id: tuple(r)[1:] for r in moderation.sentence_verdicts(df, listed, 0.96).collect()}
    assert got == {1: ("block", 3, "c", 1.0, 3), 2: ("flag", 6, "f", 1.0, 1), 6: ("allow", 7, "g", 0.96, 1)}  # a cosine of just the limit counts
    assert {r.id: r.verdict for r in moderation.sentence_verdicts(df, listed, 0.96, first=2).collect()} == {1: "flag"}


def test_fields_are_judged_in_order(spark):
    good, text = "A fine title", "This description says enough about it"
    entries = {
        1: (good, text), 2: ("  ", text), 3: (None, None), 4: (good, " "), 5: (good, None), 6: ("ok", "viagra"), 7: (good, "too short"), 8: (good, text + " secret word here"), 9: (good, text + " 1234"),
        10: (good, text), 11: (good, text), 12: (good, text + " secret word here"),
    }
    rows = [(i, f, p, p == 0, f, e[p]) for i, e in entries.items() for p, f in enumerate(("title", "description"))]
    fields = spark.createDataFrame(rows, "id long, field string, place int, required boolean, kind string, body string")
    patterns = spark.createDataFrame([(1, "SECRET word", "phrase", "p", 1, "flag", True), (2, "[0-9]{4}", "regex", "q", 1, "allow", True)], "id int, pattern string, kind string, category string, priority int, action string, active boolean")
    copies = spark.createDataFrame([(10, "title"), (10, "title"), (11, "description")], "id long, field string")
    near = spark.createDataFrame([(9, "description", "block", "n"), (11, "description", "flag", "n"), (4, "description", "block", "n")], "id long, field string, action string, category string")
    got = {r.id: tuple(r)[1:] for r in moderation.validate_fields(fields, patterns, copies, near).collect()}
    fine = (True, None, None, None)
    assert got == {
        1: fine, 2: (False, "title", "required", None), 3: (False, "title", "required", None), 4: fine, 5: fine, 6: (False, "title", "spam", "too_short"), 7: (False, "description", "spam", "too_short"),
        8: (False, "description", "pattern", "p"), 9: fine, 10: (False, "title", "duplicate", None), 11: (False, "description", "semantic", "n"), 12: (False, "description", "pattern", "p"),
    }
    assert moderation.validate_fields(fields.limit(0), patterns, copies, near).count() == 0


def test_results_correct_intents(spark):
    asked = spark.createDataFrame([(1, "GENERAL"), (2, "NEWS"), (3, "GENERAL"), (4, "COMMERCIAL"), (5, "GENERAL"), (6, None)], "query_id long, intent string")
    found = {1: ["Shop", "shop", "x", "shop", "x"], 2: ["shop"] * 5, 3: ["news", "news"], 4: ["garden"] * 5, 5: ["x", "x", "x", "blog", "blog", "blog"], 6: ["blog", "blog", "blog"]}
    rows = [(q, i, c.lower()) for q, cs in found.items() for i, c in enumerate(cs, 1)]
    got = ranking.correct_intent(asked, spark.createDataFrame(rows, "query_id long, rank int, category string"))
    assert {r.query_id: r.intent for r in got.collect()} == {1: "COMMERCIAL", 2: "NEWS", 3: "GENERAL", 4: "COMMERCIAL", 5: "GENERAL", 6: "INFORMATIONAL"}


def test_first_pages_are_originals(spark):
    pages = spark.createDataFrame([(3, "Ein Titel"), (1, "ein  titel!"), (2, "Anders"), (4, None), (5, ""), (6, "EIN TITEL")], "page_id long, title string")
    got = {r.page_id: round(r.originality_score, 4) for r in similarity.originality(pages).collect()}
    assert got == {1: 1, 3: 0.3333, 6: 0.3333, 2: 1, 4: 1, 5: 0.5}


def test_similarity_of_pairs(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "query_id long, embedding array<float>")
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [-1.0, 0.0]), (4, [0.825, 0.0]), (5, None)], "page_id long, embedding array<float>")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (2, 1), (3, 1)], "query_id long, page_id long")
    got = {(r.query_id, r.page_id): r.semantic_score for r in ranking.pair_similarity(pairs, q, p).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.3846, (1, 3): 0.1, (1, 4): 0.5}
