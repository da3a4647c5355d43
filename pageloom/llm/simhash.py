"""SimHash near-duplicates: fingerprints are dealt over vantage-point trees, and each shard is searched exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import MOST_BITS, Roots, bitmap, buffered, by_group, in_blocks, marked, partitions, stored, unlike
from pageloom.llm.components import components

#: Fingerprints that fit the trees: one of SAMPLE_PART, between these two numbers (16 MB at most); every fingerprint is dealt by them. So trees have up to some 80,000 shards each.
SAMPLE, MOST_SAMPLE, SAMPLE_PART = 16_384, 2_097_152, 256
#: Points of a node on which its vantage points are tried.
PROBE = 4_096
#: Fingerprints of a shard that one task compares; larger shards are compared in pairs of blocks.
SHARD_CAP = 50_000
#: Ids of dropped documents of up to this number (8 MB) are broadcast, so that texts needn't be shuffled. More are told from the others by a bitmap of hashes, and only texts that it marks are joined.
BROADCAST_IDS = 1_000_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit majority of the shingle hashes as an unsigned integer: A-Z is lower-cased, words are split at ASCII white space, a shingle is width words with one space between (the whole sequence if it has fewer words), repeats count; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 32_768):
        end = min(n, start + 32_768)
        tails = [words[start + k : end + k] for k in range(min(width, len(words)))] if len(words) >= width else [[w] for w in words]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(s, 42) for s in map(b" ".join, zip(*tails))), np.uint64, end - start)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: str = "text", width: int = 3):
    """The fingerprint as a signed long column."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return of(F.col(text))


def fit_tree(points: np.ndarray, radius: int, per_point: float, leaf: float, seed: int) -> list[tuple]:
    """Nodes (vantage point, split distance, left, right), or (None, shard) for leaves. A node is split where the fewest points lie within radius of the
    boundary; it stays whole when it is expected to hold no more than leaf points or when the boundary would hold most of them."""
    rng, nodes, shards = np.random.default_rng(seed), [], 0
    todo = [(points, -1, 0)]
    while todo:
        own, parent, side = todo.pop()
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        best = None
        if len(own) * per_point > leaf and len(own) >= 24:
            probe = own if len(own) <= PROBE else rng.choice(own, PROBE, replace=False)
            for vantage in rng.choice(probe, min(12, len(probe)), replace=False):
                d = np.bitwise_count(probe ^ vantage)
                for cut in {int(x) for x in np.quantile(d, (0.3, 0.5, 0.7))}:
                    left, over = np.mean(d <= cut), np.mean((d > cut - radius) & (d <= cut + radius))
                    if 0.15 <= left <= 0.85 and over <= 0.6:
                        cost = over + 0.5 * abs(left - 0.5)
                        if best is None or cost < best[0]:
                            best = (cost, vantage, cut)
        if best is None:
            nodes.append([None, shards])
            shards += 1
        else:
            nodes.append([best[1], best[2], 0, 0])
            here, d = len(nodes) - 1, np.bitwise_count(own ^ best[1])
            todo += [(own[d <= best[2]], here, 0), (own[d > best[2]], here, 1)]
    return [tuple(n) for n in nodes]


def deal(nodes: list[tuple], points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) pairs: the home of every point, and each shard beyond a boundary that lies within radius of it.

    By the triangle inequality two points within radius differ by no more than that in their distance to any vantage point. Of two such points with homes on different sides, the left one visits the right side, so only one of them is copied; copies then visit both sides of later boundaries."""
    rows, shards = [], []
    todo = [(0, np.arange(len(points)), np.arange(0))]
    while todo:
        at, home, visit = todo.pop()
        if not len(home) and not len(visit):
            continue
        if nodes[at][0] is None:
            rows += [home, visit]
            shards.append(np.full(len(home) + len(visit), nodes[at][1]))
            continue
        vantage, cut, left, right = nodes[at]
        d, v = (np.bitwise_count(points[i] ^ vantage).astype(np.int16) for i in (home, visit))
        todo.append((left, home[d <= cut], visit[v <= cut + radius]))
        todo.append((right, home[d > cut], np.concatenate([visit[v > cut - radius], home[(d <= cut) & (d > cut - radius)]])))
    return (np.concatenate(rows), np.concatenate(shards)) if rows else (np.arange(0), np.arange(0))


def _forest_edges(own: np.ndarray, points: np.ndarray, cross: bool, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links at bits or fewer: (member, root) positions. cross: only between different own."""
    roots = Roots(len(points))
    for start in range(0, len(points), 512):
        near = np.bitwise_count(points[start : start + 512, None] ^ points[None, start:]) <= bits
        if cross:
            near &= own[start : start + 512, None] != own[None, start:]
        i, j = np.nonzero(near)
        later = j > i
        roots.link(i[later] + start, j[later] + start)
    flat = roots.flat()
    members = np.flatnonzero(flat != np.arange(len(points)))
    return members, flat[members]


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs: rows whose fingerprints differ in bits or fewer bits are linked, component_id is the smallest id reachable.

    Null and empty texts have fingerprint 0 and are linked like any other; rows with equal text share a fingerprint, and repeated rows give repeated rows. Null ids never become a component_id unless all ids of the component are null. An empty table gives an empty one; other columns are ignored.

    Copies are first folded into distinct fingerprints. Each 64-bit fingerprint is cut in two halves: two fingerprints within bits differ in one half by bits // 2 at most, so one vantage-point tree per half with that radius finds every pair. A tree is fitted on a bounded sample, but each shard is searched in full, so no link is lost whatever the sample. Only a spanning forest of each shard's links leaves its task.
    """
    spark = docs.sparkSession
    each = stored(docs.select(F.col(id_col).alias("id"), fingerprint_column(text_col, width).alias("fp")), "fingerprints")
    distinct = stored(each.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct-fingerprints")
    n = distinct.count()
    size = min(MOST_SAMPLE, max(SAMPLE, n // SAMPLE_PART))
    sample = distinct.select("fp", F.xxhash64("fp", F.lit(1)).alias("order"))
    if n > 2 * size:  # so many at least come below this hash, but for odds that don't matter; fewer would do as well
        sample = sample.where(F.col("order") < int(-(2**63) + 2**64 * 1.5 * size / n))
    points = sample.orderBy("order", "fp").limit(size).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    leaf = min(20_000, max(256, n / (4 * partitions(spark))))
    halves = [(np.uint64(32 * h), fit_tree((points >> np.uint64(32 * h)) & np.uint64(0xFFFFFFFF), bits // 2, n / max(1, len(points)), leaf, h)) for h in (0, 1)]
    first = sum(node[0] is None for node in halves[0][1])

    def to_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in buffered(batches, 65_536):
            fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for h, (shift, nodes) in enumerate(halves):
                rows, shards = deal(nodes, (fps >> shift) & np.uint64(0xFFFFFFFF), bits // 2)
                yield pd.DataFrame({"shard": shards + h * first, "fp": fps[rows].view(np.int64)})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, b1, b2), group in by_group(batches, ["shard", "b1", "b2"]):
            group = group.sort_values("fp")  # so that the root of a tree is its smallest member, and no root has many smaller neighbours
            fps = group["fp"].to_numpy()
            members, roots = _forest_edges(group["own"].to_numpy(), fps.view(np.uint64), b1 != b2, bits)
            if len(members):
                yield pd.DataFrame({"a": fps[members], "b": fps[roots]})

    dealt = stored(distinct.select("fp").mapInPandas(to_shards, "shard long, fp long"), "shards")
    dealt = in_blocks(dealt, dealt.groupBy("shard").agg(F.count("*").alias("n")), "shard", SHARD_CAP, "fp")
    dealt = dealt.repartitionByRange(max(4 * partitions(spark), 2), "shard", "b1", "b2").sortWithinPartitions("shard", "b1", "b2")
    links = stored(dealt.mapInPandas(search, "a long, b long"), "fingerprint-links")
    found = components(links, "a", "b")
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    ids = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")
    of = stored(rooted.join(ids, "root").select("fp", "component_id"), "component-of")
    hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return each.join(of, "fp").select(F.col("id").alias(id_col), hex_.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the smallest id (of rows that repeat this id, one). Rows with null id are kept. Null and empty texts are one group, ties can't arise but between rows that repeat an id. Other columns are kept, whatever their names; an empty table gives an empty one."""
    groups = stored(simhash_groups(docs, id_col, text_col, width, bits).select(F.col(id_col).alias("id"), (F.col("component_id") == F.col(id_col)).alias("first")), "groups")
    drop = stored(groups.where("not first").select("id").distinct(), "dropped")
    kept = without(docs, drop, id_col)
    if groups.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))


def without(docs: DataFrame, drop: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is not in drop, a table of distinct ids id."""
    other = unlike("dropped", docs.columns)
    drop = drop.withColumnRenamed("id", other)
    same = F.col(id_col) == F.col(other)
    if drop.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(drop), same, "left_anti")
    hash_ = lambda id_: F.xxhash64(id_, F.lit(5))
    maybe = marked(bitmap(drop.select(hash_(other).alias("h")), MOST_BITS), hash_(id_col))
    return docs.where(~maybe).unionByName(docs.where(maybe).join(drop, same, "left_anti"))
