"""Vectors as short codes: codebooks of their parts by Lloyd's rounds over two trees, one of parts and one of entries."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import stored
from pageloom.llm.hard_negatives import usable_integers

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors whose parts form one tree, parts of a leaf, and trees that a task reads at once.
BLOCK, LEAF, TREES_AT_ONCE = 1_024, 16, 16
#: Labels of up to this number (some MB) are broadcast with their sums; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
#: Fixed value: no integer is larger, so that they fit 32 bits and squared distances fit a long.
LARGEST = 2**30


@dataclass
class Tree:
    """A binary tree over points (or codebook entries): order lays the points of each node side by side; per node the first and last of them, the children (-1: a leaf), the box, and the sum of the points."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray, leaf: int) -> Tree:
        """Nodes are halved along the widest side of their box until they have leaf points at most, or equal ones only; children are neighbours."""
        order, spans, left = np.arange(len(points)), [(0, len(points))], [-1]
        for at, (a, b) in enumerate(spans):  # grows meanwhile
            own = points[order[a:b]]
            side = np.ptp(own, axis=0) if b - a > leaf else np.zeros(0)
            if side.size and side.max() > 0:
                widest, half = int(side.argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, widest], half)]
                left[at] = len(spans)
                spans += [(a, a + half), (a + half, b)]
                left += [-1, -1]
            else:
                order[a:b].sort()  # so that the first of equal entries stands for them
        start, end = np.array(spans).T
        sorted_ = points[order].astype(np.int64)
        sums = np.r_[np.zeros((1, points.shape[1]), np.int64), np.cumsum(sorted_, axis=0)]
        low = np.array([sorted_[a:b].min(axis=0) for a, b in spans]).reshape(len(spans), -1)
        high = np.array([sorted_[a:b].max(axis=0) for a, b in spans]).reshape(len(spans), -1)
        return cls(order, start, end, np.array(left), low, high, sums[end] - sums[start])


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances in integers."""
    return ((points[:, None, :].astype(np.int64) - entries[None, :, :]) ** 2).sum(axis=2)


def _beaten(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether every point of a box is nearer to entry a than to entry b (or as near, where a comes first): the difference of the two distances is linear, so its greatest value in the box is at a corner."""
    low, high, a, b = (x.astype(float) for x in (low, high, a, b))
    slope = 2 * (b - a)
    most = (np.where(slope > 0, slope * high, slope * low) + a * a - b * b).sum(axis=1)
    slack = 1e-9 * (np.abs(slope) * np.maximum(np.abs(low), np.abs(high)) + a * a + b * b).sum(axis=1)  # more than doubles can be off by
    exact = slack < 0.25  # then all of these integers are exact in doubles
    return np.where(exact, np.where(first, most <= 0, most < 0), most < -slack)


def assign(points: np.ndarray, tree: Tree, entries: np.ndarray, split: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each point, sum of the points of each entry, their number): the nearest entry, of equally near ones the first.

    Pairs of a node of points and a node of entries go down both trees. Of a node's pairs those are dropped whose least distance exceeds the smallest greatest distance of any, and single entries that another one beats in the whole box. A node with one entry left is assigned as it is, with its cached sum; leaves with several are compared point by point, in integers."""
    k, d = entries.shape
    code, totals, counts = np.zeros(len(points), np.int64), np.zeros((k, d), np.int64), np.zeros(k, np.int64)
    node, entry = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(node):
        lows, highs, elow, ehigh = tree.low[node], tree.high[node], split.low[entry], split.high[entry]
        least = (np.maximum(0, np.maximum(lows - ehigh, elow - highs)) ** 2).sum(axis=1)
        greatest = (np.maximum(highs - elow, ehigh - lows) ** 2).sum(axis=1)
        bound = np.full(len(tree.start), np.iinfo(np.int64).max)
        np.minimum.at(bound, node, greatest)
        keep = least <= bound[node]
        node, entry, greatest = node[keep], entry[keep], greatest[keep]
        if (deeper := split.left[entry] >= 0).any():
            a, b = node[deeper], split.left[entry[deeper]]
            node, entry = np.r_[node[~deeper], a, a], np.r_[entry[~deeper], b, b + 1]
            continue
        # All entries are single now; each node's pairs are held against the entry of the smallest greatest distance.
        index = split.order[split.start[entry]]
        order = np.lexsort((index, greatest, node))
        node, entry, index = node[order], entry[order], index[order]
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        rival = np.repeat(index[first], np.diff(np.r_[first, len(node)]))
        keep = (index == rival) | ~_beaten(tree.low[node], tree.high[node], entries[rival], entries[index], rival < index)
        node, entry, index = node[keep], entry[keep], index[keep]
        alone = np.bincount(node, minlength=len(tree.start))[node] == 1
        for n, i in zip(node[alone].tolist(), index[alone].tolist()):
            code[tree.order[tree.start[n] : tree.end[n]]] = i
        np.add.at(totals, index[alone], tree.total[node[alone]])
        np.add.at(counts, index[alone], (tree.end - tree.start)[node[alone]])
        node, entry, index = node[~alone], entry[~alone], index[~alone]
        leaf = tree.left[node] < 0
        if leaf.any():
            unsure = np.unique(node[leaf])
            allowed = np.zeros((len(tree.start), k), bool)
            allowed[node[leaf], index[leaf]] = True
            at = np.concatenate([tree.order[tree.start[n] : tree.end[n]] for n in unsure])
            far = distances(points[at], entries)
            far[~np.repeat(allowed[unsure], (tree.end - tree.start)[unsure], axis=0)] = np.iinfo(np.int64).max
            code[at] = nearest = far.argmin(axis=1)
            np.add.at(totals, nearest, points[at].astype(np.int64))
            counts += np.bincount(nearest, minlength=k)
        node, entry = node[~leaf], entry[~leaf]
        node, entry = np.r_[tree.left[node], tree.left[node] + 1], np.r_[entry, entry]
    return code, totals, counts


@contextmanager
def _few_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run meanwhile send so many rows at once to Python: rows are large."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _split(d: int, parts: int) -> list[tuple[int, int]]:
    cuts = np.cumsum([0, *(len(x) for x in np.array_split(np.arange(d), parts))]).tolist()
    return list(zip(cuts, cuts[1:]))


def part_trees(rows: DataFrame, d: int, parts: int) -> DataFrame:
    """(ids, labels, tree): some rows (id, label, q) each, with a tree over each part of their vectors."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                some = batch.slice(k, BLOCK)
                values = some.column("q").flatten().to_numpy().reshape(some.num_rows, d).astype(np.int32)
                trees = [(values[:, a:b], Tree.over(values[:, a:b], LEAF)) for a, b in _split(d, parts)]
                ends = pa.array([0, some.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, some.column(c)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([pickle.dumps(trees)], pa.binary())], ["ids", "labels", "tree"])

    id_, label = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    return rows.select("id", "label", "q").mapInArrow(grow, f"ids array<{id_}>, labels array<{label}>, tree binary")


def _updated(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: the codebooks after all parts went to their nearest entries. Sums leave a task, one for each entry's component."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splits = [Tree.over(book, 1) for book in books]
        totals, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for blob in batch["tree"]:
                for j, (points, tree) in enumerate(pickle.loads(blob)):
                    _, t, n = assign(points, tree, books[j], splits[j])
                    totals[j] += t
                    counts[j] += n
        for j, (t, n) in enumerate(zip(totals, counts)):
            i, k = np.nonzero(np.broadcast_to(n[:, None] > 0, t.shape))
            yield pd.DataFrame({"j": j, "i": i, "k": k, "total": t[i, k], "n": n[i]})

    found = trees.select("tree").mapInPandas(sums, "j int, i int, k int, total long, n long")
    new = [b.copy() for b in books]
    for r in found.groupBy("j", "i", "k").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():  # entries times dimension
        new[r["j"]][r["i"], r["k"]] = int(r["total"]) // r["n"]
    return new


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks): rows has (id, label, code, error, label_error) for each usable row of vectors, where code names the nearest entry of each part in two hex digits, error sums the squared distances and label_error the errors of all rows of that label, nulls together. codebooks has the entries of each part.

    Vectors become integers floor(scale * component) and are cut into equal parts (the first ones a component longer where that doesn't come out even). Each part's codebook starts as the parts of the vectors with the smallest ids, null ids last, equal ids by their vectors, and is moved by so many of Lloyd's rounds in integers: nearest entry, ties to the first; floor of the mean; unused entries stay.

    Rows whose vector is null or has null or non-finite components are dropped, and so are those whose integers exceed 2^30, or what their dimension lets a squared distance hold, and those of another dimension than the row with the smallest id. Fewer rows than entries make shorter codebooks, an empty table an empty one with empty codebooks. Repeated rows are rows of their own; other columns are ignored.

    Trees over parts are grown once, where the rows lie, and stored; every round reads them and sends one sum for each entry's component. Only codebooks and such sums meet in the driver, whatever the number of rows.
    """
    spark = vectors.sparkSession
    d = F.size(vector_col)
    most = F.least(F.lit(LARGEST), F.floor(F.sqrt(2.0**61 / F.greatest(d, F.lit(1)))))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), usable_integers(F.col(vector_col), scale, most).alias("q")).where("q is not null")
    rows = stored(rows, "integers")
    order = (F.col("id").asc_nulls_last(), "q")
    head = rows.orderBy(*order).limit(1).collect()
    dim = len(head[0]["q"]) if head else 0
    rows = rows.where(F.size("q") == dim)
    start = [r["q"] for r in rows.orderBy(*order).limit(entries).collect()]
    start = np.array(start, np.int64).reshape(len(start), dim)
    books = [start[:, a:b].copy() for a, b in _split(dim, parts)]
    with _few_at_once(spark, TREES_AT_ONCE * BLOCK):
        trees = stored(part_trees(rows, dim, parts), "part-trees") if head else None
    for _ in range(rounds if head else 0):
        with _few_at_once(spark, TREES_AT_ONCE):
            books = _updated(trees, books)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = [Tree.over(book, 1) for book in books]
        for batch in batches:
            for ids, labels, blob in zip(batch.column("ids"), batch.column("labels"), batch.column("tree")):
                codes, errors = [], 0
                for book, split, (points, tree) in zip(books, splits, pickle.loads(blob.as_py())):
                    code = assign(points, tree, book, split)[0]
                    codes.append(code)
                    errors = errors + ((points - book[code]) ** 2).sum(axis=1)
                text = [x.tobytes().hex() for x in np.array(codes).T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(text), pa.array(errors)], ["id", "label", "code", "error"])

    id_, label = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    schema = f"id {id_}, label {label}, code string, error long"
    with _few_at_once(spark, TREES_AT_ONCE):
        out = stored(trees.mapInArrow(final, schema), "codes") if head else spark.createDataFrame([], schema)
    sums = stored(out.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "label-errors")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    out = out.join(sums, F.col("label").eqNullSafe(F.col("l"))).select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error")
    return out, books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
