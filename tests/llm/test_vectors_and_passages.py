"""Hard negatives, vector codes and repeated passages against plain versions and on odd rows."""

import math
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import hard_negatives, queries, substrings, vector_codes
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_vector_codes", "op13_substrings"])
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


# Hard negatives


def plain_negatives(rows):
    ok = [(i, k, [math.floor(256 * x) for x in v], label) for k, (i, v, label) in enumerate(rows) if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, k, v, label in ok:
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, n, m) for j, n, w, m in ok if n != k and len(w) == len(v)), key=lambda r: r[:4])
        for p in [r for r in scored if r[4] == label][:5]:
            fit = [r for r in scored if r[4] != label and 50 * -p[0] <= 100 * -r[0] <= 95 * -p[0]][:3]
            out += [(i, None if p[1] else p[2], rank + 1, None if r[1] else r[2], -p[0], -r[0]) for rank, r in enumerate(fit)]
    return sorted(map(repr, out))


def test_negatives_with_ties_copies_odd_rows_and_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 40)  # several blocks of rows and anchors
    rng = random.Random(3)
    rows = [(i, [float(rng.choice([0, 0.25, 0.5, 1])) for _ in range(4)], rng.choice([1, 1, 2, 3])) for i in range(400)]
    rows += [(50, [0.5, 0.5, 0.5, 0.5], 1)] * 3 + [(0, [0.0] * 4, 2), (100, [-1.0, 0.0, 0.0, 0.0], 1)]
    rows += [(None, [1.0, 1.0, 1.0, 1.0], 1), (None, [0.5, 0.5, 0.5, 0.5], 3), (150, None, 1), (200, [1.0, None, 0.0, 0.0], 2), (250, [float("nan"), 0.0, 0.0, 0.0], 1), (300, [float("inf")] * 4, 1), (350, [1.0] * 4, None)]
    rows += [(400, [1.0, 2.0], 1), (401, [1.0, 2.0], 1), (402, [0.5, 1.0], 2), (450, [], 1), (451, [], 1), (452, [], 2)]
    frame = spark.createDataFrame(rows, VECTORS).withColumn("uid", F.lit(1)).withColumn("score", F.lit("x")).repartition(5)
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 50 == 0)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_negatives(rows)


def test_negatives_of_large_integers_stay_exact(spark):
    big = 2.0**20  # products of 2^56 lie between doubles
    rows = [(0, [big, 1.0], 1), (1, [big, 1.0], 1), (2, [big * 0.75, 1 / 256], 2), (3, [big * 0.75, 0.0], 2), (4, [1e300, 1.0], 1)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_negatives(rows[:4])


def test_negatives_of_an_empty_table_and_of_string_ids(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).collect() == []
    rows = spark.createDataFrame([("a", [1.0], 1), ("b", [1.0], 1), ("c", [0.75], 2)], "vec_id string, embedding array<float>, label int")
    assert [tuple(r) for r in hard_negatives.hard_negatives(rows, F.col("vec_id") == "a").collect()] == [("a", "b", 1, "c", 65536, 49152)]
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(rows, F.lit(True), high=101)


# Vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    ok = [(i, label, [math.floor(4096 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(ok[0][2])
    sizes = [len(x) for x in np.array_split(range(d), parts)]
    at = [sum(sizes[:j]) for j in range(parts)]
    cut = lambda v, j: v[at[j] : at[j] + sizes[j]]
    books = [[cut(v, j) for _, _, v in ok[:entries]] for j in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, j: min(range(len(books[j])), key=lambda e: (far(cut(v, j), books[j][e]), e))
    for _ in range(rounds):
        new = []
        for j in range(parts):
            own = defaultdict(list)
            for _, _, v in ok:
                own[near(v, j)].append(cut(v, j))
            new.append([[sum(c) // len(c) for c in zip(*own[e])] if e in own else b for e, b in enumerate(books[j])])
        books = new
    out = [(i, label, "".join(f"{near(v, j):02x}" for j in range(parts)), sum(far(cut(v, j), books[j][near(v, j)]) for j in range(parts))) for i, label, v in ok]
    totals = defaultdict(int)
    for _, label, _, e in out:
        totals[label] += e
    return sorted(repr((*r, totals[r[1]])) for r in out), books


@pytest.mark.parametrize("d", [8, 19])
def test_codes_with_ties_copies_and_odd_rows(spark, d):
    rng = random.Random(d)
    rows = [(i, [rng.choice([0.0, 0.25, 0.5, -0.5]) if i % 3 else rng.gauss(0, 1) for _ in range(d)], rng.choice([1, 1, 2, None])) for i in range(300)]
    rows += [rows[5]] * 200 + [(None, [0.1] * d, 1), (3, [0.2] * d, 2), (301, None, 1), (302, [None] * d, 1), (303, [float("nan")] * d, 1), (304, [float("-inf")] * d, 1)]
    frame = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit(1)).withColumn("error", F.lit(1)).repartition(4)
    got, books = vector_codes.vector_codes(frame)
    want, plain_books = plain_codes(rows)
    assert sorted(repr((r[0], r[1], r[2], r[3], r[4])) for r in got.collect()) == want
    assert [b.tolist() for b in books] == plain_books


def test_codes_of_few_rows_large_values_and_an_empty_table(spark):
    rows = [(2, [1e5] * 8, 1), (1, [-1e5] * 8, 1), (3, [1e300] * 8, 1), (4, [1.0] * 9, 1)]
    got, books = vector_codes.vector_codes(spark.createDataFrame(rows, VECTORS))
    assert sorted((r.vec_id, r.code, r.error) for r in got.collect()) == [(1, "00" * 8, 0), (2, "01" * 8, 0)] and len(books[0]) == 2
    got, books = vector_codes.vector_codes(spark.createDataFrame([], VECTORS))
    assert got.collect() == [] and vector_codes.digest(books) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


@pytest.mark.parametrize("spread", [3, 40, 100_000])
def test_trees_assign_like_all_distances(spread):
    rng = np.random.default_rng(spread)
    points, entries = rng.integers(-spread, spread, (700, 3)), rng.integers(-spread, spread, (16, 3))
    code, totals, counts = vector_codes.assign(points, vector_codes.Tree.over(points, 16), entries, vector_codes.Tree.over(entries, 1))
    want = vector_codes.distances(points, entries).argmin(axis=1)
    assert (code == want).all() and (counts == np.bincount(want, minlength=16)).all()
    assert all((totals[e] == points[want == e].sum(axis=0)).all() for e in range(16))


# Repeated passages

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_kept(rows, window=13):
    """(id, words, removed, kept) with every window looked up; a null id is larger than any other."""
    said = [(i, WORDS.findall(t or "")) for i, t in rows]
    first = {}
    for i, words in said:
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if i is not None:
                first[w] = min(i, first.get(w, i))
    out = []
    for i, words in said:
        gone = set()
        for s in range(len(words) - window + 1):
            lo = first.get(tuple(words[s : s + window]))
            if lo is not None and (i is None or lo < i):
                gone |= set(range(s, s + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(map(repr, out))


def test_every_pair_of_places_shares_an_anchor():
    for period, cover in substrings.COVERS.items():
        for i in range(period):
            for j in range(period):
                assert any((i + k) % period in cover and (j + k) % period in cover for k in range(period))
    assert substrings.cover_of(13) == (7, (0, 1, 3)) and substrings.cover_of(1) == (1, (0,)) and substrings.cover_of(50)[0] == 21


@pytest.mark.parametrize("window", [13, 5])
@pytest.mark.parametrize("unit", [3_000_000, 500])
def test_passages_at_any_place(spark, monkeypatch, window, unit):
    monkeypatch.setattr(substrings, "UNIT_CHARS", unit)
    rng = random.Random(window)
    words = [f"w{k}" for k in range(3000)]
    some = lambda n: rng.choices(words, k=n)
    passages = [some(n) for n in (12, 13, 14, 20, 60, 200)]
    rows = []
    for i in range(120):
        text = some(rng.randrange(30))
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "other"
            text += p + some(rng.randrange(15))
        rows.append((i, " ".join(text)))
    rows += [(200, "a b " * 300), (201, "a b " * 20), (202, "b " + "a b " * 8), (7, " ".join(passages[4])), (7, " ".join(passages[5])), (7, " ".join(passages[4]))]
    rows += [(300, None), (301, ""), (302, " \n\t "), (None, " ".join(passages[4] + passages[5])), (None, " ".join(some(20))), (303, "\x1c".join(passages[3])), (304, " ".join(passages[3]) + " ퟿ é 😀")]
    rows += [(400, " ".join(some(30_000))), (399, "  ".join(rows[0][1].split()))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("n_words", F.lit("x")).repartition(6)
    got = substrings.without_repeats(frame, window=window)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_kept(rows, window)


def test_passages_when_bitmaps_are_full(spark, monkeypatch):
    """With filters that mark nearly everything, all windows are compared, and the result is the same."""
    full = substrings.bitmap
    monkeypatch.setattr(substrings, "bitmap", lambda hashes: full(hashes, 64))
    rng = random.Random(1)
    passage = [str(k) for k in range(40)]
    rows = [(i, " ".join(rng.choices("abcdefgh", k=20) + passage[rng.randrange(20) :] + rng.choices("abcdefgh", k=20))) for i in range(60)]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_kept(rows)


def test_passages_of_string_ids_and_of_an_empty_table(spark):
    text = " ".join(map(str, range(20)))
    rows = [("b", text), ("a", text), (None, text), ("c", "x y")]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted(((r.doc_id or "-"), r.n_removed) for r in got.collect()) == [("-", 20), ("a", 0), ("b", 20), ("c", 0)]
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
