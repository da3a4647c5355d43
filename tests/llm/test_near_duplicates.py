import itertools
import math
import random

import numpy as np
import pytest
import xxhash

from pageloom.llm import embeddings, simhash
from pageloom.llm.components import components
from pageloom.llm.queries import op1_simhash, op10_embeddings
from tests.conftest import DATA


def plain_fingerprint(text):
    words = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in words)
    for c in b"\t\n\x0b\x0c\r":
        words = words.replace(bytes([c]), b" ")
    words = [w for w in words.split(b" ") if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def plain_groups(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    roots = roots_of(len(rows), near)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(least.get(r, i), i)
    return sorted((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots))


def test_fingerprints_match_a_plain_version():
    for text in ["", None, "   \n", "One", "one two", "A b C d", "x " * 70_000, "ÄÖ ü ß\tq\r\nw\x0be\x0cr", "a a a a a a a"]:
        if text is None or len(text) < 1000:
            assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint("x " * 70_000) == xxhash.xxh64(b"x x x", seed=42).intdigest()


def test_whole_table_matches_brute_force(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op1_simhash(spark, f"{DATA}/sf0.001").collect())) == plain_groups(rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(3, None, "x"), (1, "", "y"), (2, "same words here", "z"), (2, "same words here", "z"), (9, "Same  words\nhere", "w"), (None, "lonely text of five words", "v")], "doc_id long, text string, shard string")
    got = simhash.simhash_groups(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(1, 1), (2, 2), (2, 2), (3, 1), (9, 2)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect()) == ["1", "2", "None"]
    assert simhash.simhash_groups(docs.limit(0)).collect() == []


def test_trees_lose_no_pair_even_in_dense_clusters():
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(3000)} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(800)}
    points = np.array(sorted(fps), np.uint64)
    near = {(a, b) for a in range(len(points)) for b in np.flatnonzero(np.bitwise_count(points ^ points[a]) <= 3).tolist() if a < b}
    met = set()
    for h in (0, 1):
        half = (points >> np.uint64(32 * h)) & np.uint64(0xFFFFFFFF)
        rows, shards = simhash.deal(simhash.fit_tree(half, 1, 1.0, 100, h), half, 1)
        for s in set(shards.tolist()):
            own = np.unique(rows[shards == s])
            d = np.bitwise_count(points[own][:, None] ^ points[own][None]) <= 3
            met |= {(int(own[i]), int(own[j])) for i, j in zip(*np.nonzero(d)) if i < j}
    assert met == near


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(900 + i, 901 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    want = roots_of(1000, pairs)
    assert got == {n: want[n] for p in pairs if p[0] != p[1] for n in p}


def plain_vectors(rows):
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
        return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))

    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i][2] == rows[j][2] and usable(*rows[i][1:]) and usable(*rows[j][1:]) and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= 0.98]
    n = [sum(i in p for p in links) for i in range(len(rows))]
    roots = roots_of(len(rows), links)
    least = {}
    for (i, *_), r in zip(rows, roots):
        least[r] = min(least.get(r, i), i)
    return sorted((rows[i][0], n[i], least[roots[i]], rows[i][0] == least[roots[i]]) for i in range(len(rows)))


def test_vectors_match_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()]
    assert sorted(map(tuple, op10_embeddings(spark, f"{DATA}/sf0.001").collect())) == plain_vectors([(a, b, c) for a, b, c in rows])


def test_odd_and_dense_vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.05 * rng.standard_normal(16)).tolist(), 1) for i in range(300)]
    rows += [(300 + i, rng.standard_normal(16).tolist(), 1 + i % 2) for i in range(300)]
    rows += [(700, [0.0] * 16, 1), (701, None, 1), (702, [float("nan")] * 16, 1), (703, rows[0][1], None), (704, rows[0][1], 1), (704, rows[0][1], 1), (705, [1.0, 2.0], 1), (706, [2.0, 4.0], 1), (707, [], 1), (708, [1.0, None], 1), (709, [float("inf"), 1.0], 1)]
    rows += [(720, [1e200, 1e200], 1), (721, [1e200, 1e200], 1), (722, [3e-170, 0.0], 1), (723, [1e-170, 0.0], 1), (724, [5e-324, 0.0], 1), (725, [1.7e308, 0.0], 1), (726, [-0.0, -2.0], 1), (727, [0.0, -3.0], 1)]
    got = sorted(map(tuple, embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    want = plain_vectors(rows)
    assert len(got) == len(want) and [r[0] for r in got] == [r[0] for r in want]
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and [r[2:] for r in got] == [r[2:] for r in want]


@pytest.mark.parametrize("cap", [40])
def test_blocks_of_large_groups(spark, cap, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF_CAP", cap)
    monkeypatch.setattr(simhash, "SHARD_CAP", cap)
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()]
    assert sorted(map(tuple, op10_embeddings(spark, f"{DATA}/sf0.001").collect())) == plain_vectors(rows)
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op1_simhash(spark, f"{DATA}/sf0.001").collect())) == plain_groups(docs)


def test_recall_against_all_rows_of_a_larger_table(spark):
    """Every vector whose id is divisible by 10 gets three noisy copies around the threshold; those divisible by 100 are held against all rows."""
    df = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label")
    rows, rng = [tuple(r) for r in df.collect()], np.random.default_rng(6)
    points = np.array([r[1] for r in rows], np.float32)
    noise = np.linalg.norm(points, axis=1, keepdims=True) / points.shape[1] ** 0.5
    added = [(int(1_000_000 * k + v), (points[i] + 0.12 * noise[i] * rng.standard_normal(points.shape[1])).tolist(), label) for i, (v, _, label) in enumerate(rows) if v % 10 == 0 for k in (1, 2, 3)]
    every = df.unionByName(spark.createDataFrame(added, df.schema))
    got = {r.vec_id: r.n_links for r in embeddings.embedding_groups(every).collect()}
    points = np.array([r[1] for r in rows + added], np.float32).astype(float)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    label = np.array([-1 if r[2] is None else r[2] for r in rows + added])
    asked = [i for i, r in enumerate(rows + added) if r[0] % 100 == 0]
    want = [((points[label == label[i]] @ points[i] >= 0.98).sum() - 1) * (label[i] >= 0) for i in asked]
    have = [got[(rows + added)[i][0]] for i in asked]
    assert sum(want) > 100 and sum(have) >= 0.95 * sum(want) and all(h <= w for h, w in zip(have, want))


def test_skewed_table_lies_in_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SAMPLE", 500)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(24)
    rows = [(i, (centre + 0.2 * rng.standard_normal(24)).tolist() if i % 3 == 0 else rng.standard_normal(24).tolist(), i % 2) for i in range(3000)]
    rows += [(3000 + i, (np.array(rows[7 * i][1]) * (1 + i)).tolist(), rows[7 * i][2]) for i in range(400)]
    got = sorted(map(tuple, embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    points = np.array([r[1] for r in rows])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    near = (points @ points.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    assert sum(r[1] for r in got) >= 0.95 * (near.sum() - len(rows)) and all(g[1] <= n - 1 for g, n in zip(got, near.sum(1)))


def test_dropped_ids_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(None, "no id", "en", None, 5)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    want = sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect())
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    for bits in (64, 1 << 20):
        monkeypatch.setattr(simhash, "MOST_BITS", bits)
        assert sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect()) == want


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", 1, 2)], "doc_id long, text string, fp long, component_id long")
    assert [tuple(r) for r in simhash.keep_one(docs).collect()] == [(1, "a b c d", 1, 2)] and simhash.keep_one(docs.limit(0)).collect() == []
    vectors = spark.createDataFrame([(1, [1.0], 1, "x")], "vec_id long, embedding array<float>, label int, node string")
    assert embeddings.embedding_groups(vectors.limit(0)).collect() == [] and [tuple(r) for r in embeddings.embedding_groups(vectors).collect()] == [(1, 0, 1, True)]
