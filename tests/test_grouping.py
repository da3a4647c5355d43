import random
from collections import Counter

from pageloom.operators import similarity


def by_pass(rows, hashes, bits=6, most=5):
    """Plain pass down one list of (rank, url)."""
    kept, to = [], {}
    for rank, url in sorted(rows):
        h = hashes.get(url) or 0
        near = next((k for k in kept if h and k[2] < most and (k[1] ^ h).bit_count() <= bits), None)
        if near:
            near[2] += 1
            to[url] = near[0]
        else:
            if h:
                kept.append([url, h, 0])
            to[url] = None
    return to


def lists_of(rng):
    """Lists of copies, of chains whose ends are far apart, of both mixed, and of rows without a fingerprint."""
    lists, hashes = {}, {}
    for q, (families, steps, copies, n) in enumerate([(3, 0, 1.0, 100), (2, 6, 0.3, 200), (6, 4, 0.7, 400), (1, 9, 0.9, 300), (40, 1, 0.2, 300)]):
        pool = []
        for _ in range(families):
            h = rng.getrandbits(62)
            pool.append(h)
            for _ in range(steps):
                h ^= sum(1 << x for x in rng.sample(range(62), 4))
                pool.append(h)
        rows = []
        for i in range(n):
            url = f"{q}/{i:04d}"
            hashes[url] = pool[0] if rng.random() < copies else rng.choice(pool)
            if i % 37 == 0:
                hashes[url] = 0
            elif i % 41 == 0:
                del hashes[url]
            rows.append((i + 1, url))
        lists[q if q else None] = rows
    return lists, hashes


def test_lists_are_grouped_as_by_a_pass(spark):
    lists, hashes = lists_of(random.Random(8))
    ranking = spark.createDataFrame([(q, rank, url) for q, rows in lists.items() for rank, url in rows], "query_id int, rank int, url string").repartition(5)
    got = similarity.dedupe_results(ranking, spark.createDataFrame(list(hashes.items()), "url string, simhash long")).collect()
    want = {(q, url): to for q, rows in lists.items() for url, to in by_pass(rows, hashes).items()}
    assert len(got) == len(want) and {(r.query_id, r.url): r.canonical_url for r in got} == want
    assert all(r.is_duplicate == (r.canonical_url is not None) for r in got)
    assert max(Counter(r.canonical_url for r in got if r.canonical_url).values()) == 5


def test_one_long_list_of_copies(spark):
    """A list of 100,000 rows, a third of them one text's copies with near texts among them."""
    rng = random.Random(9)
    hot = rng.getrandbits(62)
    near = [hot ^ sum(1 << x for x in rng.sample(range(62), 3)) for _ in range(5)]
    hashes = {f"{i:06d}": hot if i % 3 == 0 else near[i % 5] if i % 1000 == 1 else rng.getrandbits(62) | 1 << 62 for i in range(100_000)}
    rows = list(enumerate(hashes))
    ranking = spark.createDataFrame([(1, rank, url) for rank, url in rows], "query_id int, rank int, url string").repartition(8)
    got = similarity.dedupe_results(ranking, spark.createDataFrame(list(hashes.items()), "url string, simhash long")).collect()
    tied = {url: h for url, h in hashes.items() if h == hot or h in near}
    want = by_pass([(rank, url) for rank, url in rows if url in tied], tied)
    assert len(got) == len(hashes) and {r.url: r.canonical_url for r in got if r.url in tied} == want
    assert not [r.url for r in got if r.url not in tied and r.is_duplicate]


def test_empty_lists(spark):
    ranking, hashes = spark.createDataFrame([], "query_id int, rank int, url string"), spark.createDataFrame([], "url string, simhash long")
    assert similarity.dedupe_results(ranking, hashes).collect() == []


def test_components(spark):
    edges = [("s", i, i + 1) for i in range(30)] + [("s", 50, 51), ("t", 3, 50), ("t", 50, 7)]
    got = {(r.scope, r.node): r.first for r in similarity.components(spark.createDataFrame(edges, "scope string, a long, b long")).collect()}
    assert got == {**{("s", i): 0 for i in range(31)}, ("s", 50): 50, ("s", 51): 50, ("t", 3): 3, ("t", 50): 3, ("t", 7): 3}
