"""Spelling suggestions against a comparison of every query with every word."""

import math
import random

from pageloom.operators import similarity


def grams(w):
    w = f"__{w}__"
    return {w[i : i + 3] for i in range(len(w) - 2)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def score(q, w):
    half_up = lambda x: math.floor(round(x, 6) + 0.5)
    plain = lambda x: x.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss")
    a, b, longest = grams(q), grams(w), max(len(q), len(w))
    sound = 5 * (plain(q) == plain(w)) + 2 * (q[:2] == w[:2]) + (abs(len(q) - len(w)) <= 1)
    raw = round(min(100, half_up((1 - distance(q, w) / longest) * 100) * 0.7 + half_up(200 * len(a & b) / (len(a) + len(b))) * 0.3 + sound), 6)
    return half_up(raw) if a & b and raw >= 60 else None


def test_suggestions_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("aeioustrnß" if rng.random() < 0.9 else "äöü") for _ in range(rng.randrange(1, 14))) for _ in range(150)} | {"ststst", "stststst", "ä", "ae", "aeae"}
    words |= {"sch" + w[:4] + "en" for w in sorted(words)[:200]}
    asked = {w[:i] + rng.choice(["", "x", "ae", w[i : i + 1] * 2]) + w[i + 1 :] for w in sorted(words) for i in (rng.randrange(len(w)),)} | {w.replace("ä", "ae").replace("ö", "oe") for w in words}
    queries = [(i, q) for i, q in enumerate(sorted(q for q in asked if len(q) >= 2 and q not in words))]
    listed = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    df = spark.createDataFrame(queries, "query_id long, query string")
    want = []
    for i, q in queries:
        best = sorted((-s, w) for w in words if (s := score(q, w)) is not None)[:5]
        want += [(i, w, -s, k) for k, (s, w) in enumerate(best, 1)]
    assert sorted(map(tuple, similarity.did_you_mean(df, listed).collect())) == sorted(want) and len(want) > 300
    # Most pairs that share a trigram can't reach the score, and never leave the join.
    sharing = sum(bool(grams(q) & grams(w)) for _, q in queries for w in words)
    assert similarity.spelling_pairs(df.withColumnRenamed("query", "q"), listed, 60).count() < sharing / 5


def test_corrections_need_no_other_suggestions(spark):
    words = spark.createDataFrame([(w,) for w in ("fenster", "fensterbank", "fensterbrett", "gartenzaun", "gartenzaum", "ähren")], "word string")
    queries = spark.createDataFrame(list(enumerate(("fensterbankk", "fensterbretl", "gartenzauu", "aehren", "fesnter", "zzz"))), "query_id int, query string")
    plain = sorted(map(tuple, similarity.autocorrect(similarity.did_you_mean(queries, words)).collect()))
    assert plain == sorted(map(tuple, similarity.autocorrect(similarity.did_you_mean(queries, words, 1, 90)).collect())) and plain
    asked = queries.withColumnRenamed("query", "q")
    assert similarity.spelling_pairs(asked, words, 90).count() < similarity.spelling_pairs(asked, words, 60).count()
