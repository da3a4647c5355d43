"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Roots, buffered, by_group, in_blocks, partitions, stored
from pageloom.llm.components import components

TREES = 6
#: Distance to a split below which a unit vector goes to both sides. Two vectors of cosine 0.98 are 0.2 apart at most, about 0.2 / sqrt(d) along a random direction.
SPILL = 0.035
#: Vectors that fit the trees: one of SAMPLE_PART, SAMPLE at least, as long as they take SAMPLE_BYTES at most; every vector is indexed.
SAMPLE, SAMPLE_PART, SAMPLE_BYTES = 20_000, 64, 128 << 20
#: Vectors that are dealt at once, and vectors of a leaf that one task compares.
DEAL, LEAF_CAP = 8_192, 8_192


@lru_cache(maxsize=200_000)
def direction(tree: int, node: int, turn: int, d: int) -> np.ndarray:
    """The random unit vector of a node; trees carry its number only."""
    found = np.random.default_rng((tree, node, turn, d)).standard_normal(d).astype(np.float32)
    return found / np.linalg.norm(found)


def fit(points: np.ndarray, per_point: float, leaf: float, tree: int) -> list[tuple]:
    """One tree: nodes (turn, split, left, right) or (None, leaf); turn says which of a node's random directions is taken. Splits are medians; a node stays whole when it is expected to hold no more than leaf points or when spill would copy most of it."""
    nodes, leaves = [], 0
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:
        own, parent, side = todo.pop()
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        split = None
        if len(own) * per_point > leaf and len(own) >= 16:
            for turn in range(6):
                at = points[own] @ direction(tree, len(nodes), turn, points.shape[1])
                cut = float(np.median(at))
                if np.mean(np.abs(at - cut) <= SPILL) <= 0.5:
                    split = (turn, cut, at)
                    break
        if split is None:
            nodes.append([None, leaves])
            leaves += 1
        else:
            nodes.append([split[0], split[1], 0, 0])
            here = len(nodes) - 1
            todo += [(own[split[2] <= split[1] + SPILL], here, 0), (own[split[2] > split[1] - SPILL], here, 1)]
    return [tuple(n) for n in nodes]


def leaves_of(nodes: list[tuple], points: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs of one tree."""
    rows, leaves = [np.arange(0)], [np.arange(0)]
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if nodes[at][0] is None:
            rows.append(own)
            leaves.append(np.full(len(own), nodes[at][1]))
        else:
            turn, cut, left, right = nodes[at]
            d = points[own] @ direction(tree, at, turn, points.shape[1])
            todo += [(left, own[d <= cut + SPILL]), (right, own[d > cut - SPILL])]
    return np.concatenate(rows), np.concatenate(leaves)


def unit(vectors: list, kind=float) -> np.ndarray:
    points = np.array(vectors, float)
    return (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(kind)


def once(value: Column, body) -> Column:
    """body(value), with value computed once for the row."""
    return F.transform(F.array(value), body)[0]


def scaled(v: Column, largest: Column) -> Column:
    """v divided by the power of two below its largest component, in two steps, as one power of two may be too small or too large for a double."""
    two = F.lit(2.0)
    step = lambda e: F.struct(F.pow(two, F.floor(e / 2)).alias("a"), F.pow(two, e - F.floor(e / 2)).alias("b"))
    return once(once(F.floor(F.log2(largest)), step), lambda s: F.transform(v, lambda x: x / s["a"] / s["b"] + 0.0))


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, trees: int = TREES) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: rows of equal, not null label and equal dimension are linked when the cosine in double precision reaches the threshold; n_links counts the other rows linked directly, component_id is the smallest id reachable, kept says that it is the row's own.

    Vectors of any scale count: each is divided by a power of two near its largest component, which changes no ratio. Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, have no links and are their own component. Repeated rows and copies are rows of their own and link with each other; a null id never becomes the component of another row. An empty table gives an empty one; other columns are ignored.

    Equal vectors of a label are folded first. Each tree deals the distinct vectors into leaves, with copies near a split on both sides; vectors are compared within leaves only. A pair that meets in several leaves is counted in the first one: every row carries all its leaves, and a later leaf leaves out pairs that share an earlier one. So only counts and a spanning forest leave a task, never the pairs of a dense group. Leaves of more than LEAF_CAP vectors are compared in pairs of blocks.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    largest = F.array_max(F.transform(v, F.abs))
    usable = F.col(label_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (largest > 0)
    usable = F.coalesce(usable, F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.when(usable, scaled(v, largest)).alias("v"))
    rows = stored(rows.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v"))), "vectors")
    distinct = rows.where("v is not null").groupBy("label", "v", "h").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    # A hash tells distinct vectors apart; should two of them share one, a running number within it keeps them apart.
    distinct = distinct.withColumn("node", F.concat_ws(":", F.hex("h"), F.md5(F.concat_ws(",", "label", F.array_join(F.transform("v", lambda x: x.cast("string")), ",")))))
    distinct = stored(distinct, "distinct-vectors")
    sizes = {r["d"]: r["n"] for r in distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").collect()}  # one row a dimension
    labels = max(1, distinct.select("label").distinct().count())
    leaf = min(2_000, max(64, sum(sizes.values()) / (4 * partitions(spark)))) * labels ** 0.5
    sizes = {d: n for d, n in sizes.items() if n > leaf}  # fewer vectors are one leaf anyway
    forests = {}
    for d, n in sizes.items():
        most = max(SAMPLE, min(n // SAMPLE_PART, SAMPLE_BYTES // (4 * d)))
        sample = distinct.where(F.size("v") == d).select("v", "node", F.xxhash64("h", F.lit(1)).alias("order"))
        if n > 2 * most:  # so many at least come below this hash, but for odds that don't matter; fewer would do as well
            sample = sample.where(F.col("order") < int(-(2**63) + 2**64 * 1.5 * most / n))
        points = unit(sample.orderBy("order", "node").limit(most).select(F.col("v").cast("array<float>").alias("v")).toPandas()["v"].tolist(), np.float32)
        forests[d] = [fit(points, n / len(points), leaf, t) for t in range(trees)]

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """(rows of one length, their dimension, row numbers, leaves): leaves of tree t start at t * 1,000,000,000."""
        for batch in buffered(batches, DEAL):
            for d, part in batch.groupby(batch["v"].map(len)):
                points = unit(part["v"].tolist(), np.float32)
                found = [leaves_of(nodes, points, t) for t, nodes in enumerate(forests.get(d, [[(None, 0)]]))]
                yield part, d, np.concatenate([r for r, _ in found]), np.concatenate([t * 1_000_000_000 + x for t, (_, x) in enumerate(found)])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, d, row, leaf_ in places(batches):
            yield pd.DataFrame({"label": part["label"].to_numpy()[row], "d": d, "leaf": leaf_}).value_counts().rename("n").reset_index()

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, d, row, leaf_ in places(batches):
            own: list[list[int]] = [[] for _ in range(len(part))]
            for i, x in zip(row.tolist(), leaf_.tolist()):
                own[i].append(x)
            for k in range(0, len(row), DEAL):
                r = row[k : k + DEAL]
                yield pd.DataFrame({"label": part["label"].to_numpy()[r], "d": d, "leaf": leaf_[k : k + DEAL], "node": part["node"].to_numpy()[r], "copies": part["copies"].to_numpy()[r], "v": part["v"].to_numpy()[r], "leaves": [own[i] for i in r]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (group, b1, b2), part in by_group(batches, ["grp", "b1", "b2"]):
            for (_, _, leaf_), same in part.groupby(["label", "d", "leaf"], sort=False):
                yield from compare(same, leaf_, b1 != b2)

    def compare(part: pd.DataFrame, leaf_: int, cross: bool) -> Iterator[pd.DataFrame]:
        part = part.sort_values("node")  # so that the root of a tree is its smallest member, and no root has many smaller neighbours
        points = unit(part["v"].tolist())
        copies, own, node = part["copies"].to_numpy(), part["own"].to_numpy(), part["node"].to_numpy()
        earlier = part["leaves"].map(lambda x: frozenset(y for y in x if y < leaf_)).tolist()
        links, roots = np.zeros(len(part), np.int64), Roots(len(part))
        for start in range(0, len(part), 1024):
            near = points[start : start + 1024] @ points[start:].T >= cosine - 1e-9
            if cross:
                near &= own[start : start + 1024, None] != own[None, start:]
            i, j = np.nonzero(near)
            i, j = i[j > i] + start, j[j > i] + start
            for k in range(0, len(i), 1 << 20):
                a, b = i[k : k + (1 << 20)], j[k : k + (1 << 20)]
                exact = np.einsum("ij,ij->i", points[a], points[b]) >= cosine
                a, b = a[exact], b[exact]
                fresh = np.fromiter((earlier[x].isdisjoint(earlier[y]) for x, y in zip(a.tolist(), b.tolist())), bool, len(a))
                np.add.at(links, a[fresh], copies[b[fresh]])
                np.add.at(links, b[fresh], copies[a[fresh]])
                roots.link(a, b)
        flat = roots.flat()
        some = np.flatnonzero((links > 0) | (flat != np.arange(len(part))))
        if len(some):
            yield pd.DataFrame({"node": node[some], "links": links[some], "up": node[flat[some]]})

    # Leaves are counted first, as rows with all their copies would be stored for that else.
    group = F.xxhash64("label", "d", "leaf").alias("grp")
    counts = distinct.select("label", "v").mapInPandas(count, "label string, d int, leaf long, n long").groupBy(group).agg(F.sum("n").alias("n"))
    dealt = distinct.select("label", "node", "copies", "v").mapInPandas(deal, "label string, d int, leaf long, node string, copies long, v array<double>, leaves array<long>")
    dealt = in_blocks(dealt.withColumn("grp", group), counts, "grp", LEAF_CAP, "node")
    dealt = dealt.repartition(max(4 * partitions(spark), 2), "grp", "b1", "b2").sortWithinPartitions("grp", "b1", "b2")
    found = stored(dealt.mapInPandas(search, "node string, links long, up string"), "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = distinct.select("label", "v", "h", "first_id", "copies", "node").join(counts, "node", "left").join(components(found, "node", "up").withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
    rooted = stored(rooted.select("label", "v", "h", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "rooted-vectors")
    ids = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")
    of = stored(rooted.join(ids, "root").select(F.col("label").alias("l"), F.col("v").alias("w"), F.col("h").alias("k"), "n_links", "component_id"), "links-of")
    same = (F.col("h") == F.col("k")) & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))
    out = rows.join(of, same, "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
