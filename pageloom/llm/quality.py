"""Quality scores by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.tables import materialised

#: Weight of the squared norm of the weights against the mean loss of a pair.
RIDGE = 1e-3
#: Distance of the nodes that margins are interpolated on. Sums over pairs keep some seven digits.
STEP = 1 / 16
#: Newton steps at most; some 15 are taken.
ROUNDS = 60
#: Bins that a search for a quantile cuts a range into.
BINS = 4_096

PUNCTUATION = b".,;:!?'\"()-"
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in PUNCTUATION)
_UPPER, _LETTER, _DIGIT = (bytes(c for c in range(128) if f(chr(c))) for f in (str.isupper, str.isalpha, str.isdigit))


#: First bytes of letters beyond ASCII in UTF-8. E2 (signs and dashes) and F0 (mostly pictures) count as none.
_LETTER_LEADS = bytes([*range(0xC3, 0xE2), *range(0xE3, 0xF0)])
_CONTINUED = bytes(range(0x80, 0xC0))


def features(text: str | None) -> np.ndarray:
    """Shares and log sizes of a whole text, of characters in any script; zeros for null and empty texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros(16)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    n, letters, m = len(raw) - count(_CONTINUED), count(_LETTER + _LETTER_LEADS), len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), float, m)
    pairs = set(zip(words, words[1:]))
    return np.array([
        count(_UPPER) / max(1, letters), letters / n, count(_DIGIT) / n, count(_SYMBOL) / n, count(b".") / m, count(b"!") / m, count(b"|") / m, count(b",") / m,
        np.log1p(m), len(set(words)) / m, len(pairs) / m, len(set(lines)) / max(1, len(lines)), np.log(lengths.mean()), min(50.0, lengths.std()), np.log1p(m / max(1, len(lines))), len(set(words)) / m ** 0.7,
    ])


def expand(x: np.ndarray) -> np.ndarray:
    """Features with their squares, so that too little and too much of one can both count."""
    return np.hstack([x, x * x])


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float  # the margin at the score quantile that parts the classes
    slope: float

    def points(self, x: np.ndarray) -> np.ndarray:
        return np.clip((expand(x) - self.mean) / self.scale, -8, 8)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Margins of features, each added up on its own, so that a row gets the same margin in any batch."""
        return (self.points(x) * self.weights).sum(axis=1)

    def score(self, texts) -> np.ndarray:
        margin = self.margins(np.array([features(t) for t in texts]).reshape(-1, 16))
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin - self.cut), -500, 500)))


def nodes_of(margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first node, weights) of cubic interpolation: a smooth function of each margin is the weighted sum of its values at four nodes."""
    at = np.floor(margins / STEP)
    f = margins / STEP - at
    return at.astype(np.int64) - 1, np.stack([-f * (f - 1) * (f - 2) / 6, (f + 1) * (f - 1) * (f - 2) / 2, -(f + 1) * f * (f - 2) / 2, (f + 1) * f * (f - 1) / 6])


Visit = Callable[[Iterator[tuple[np.ndarray, np.ndarray]]], Iterator[tuple[np.ndarray, np.ndarray]]]


def summed(rows: DataFrame, visit: Visit, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums) in order of keys: visit sees a partition's batches of features and labels and yields keys with arrays of that width, which are added up by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, 16), b.column("__label").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows)
        for keys, values in visit(parts):
            values = np.ascontiguousarray(values, float)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width, dtype=np.int32)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), lists], ["key", "sums"])

    found = rows.select("x", "__label").mapInArrow(run, "key long, sums array<double>").groupBy("key").agg(F.reduce(F.collect_list("sums"), F.array_repeat(F.lit(0.0), width), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("sums")).collect()  # an array a task and key
    found.sort(key=lambda r: r["key"])
    return np.array([r["key"] for r in found], np.int64), np.array([r["sums"] for r in found], float).reshape(-1, width)


def totals(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(labels, number and sums) of what of makes of the rows' features with their squares."""

    def visit(batches):
        held = np.zeros((2, 33))
        for x, y in batches:
            np.add.at(held, y, np.hstack([np.ones((len(x), 1)), of(expand(x))]))
        some = np.flatnonzero(held[:, 0])
        yield some, held[some]

    return summed(rows, visit, 33)


def at_nodes(rows: DataFrame, model: Ranker) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, numbers, sums of points) of the rows of each label, dealt to the nodes around their margins. There are as many nodes as margins can reach, never more than the weights allow."""
    most = int(8 * np.abs(model.weights).sum() / STEP) + 4

    def visit(batches):
        held = np.zeros((2, 2 * most + 1, 33))
        for x, y in batches:
            at, shares = nodes_of(model.margins(x))
            z = np.hstack([np.ones((len(x), 1)), model.points(x)])
            order = np.lexsort((at, y))
            at, y, z, shares = at[order], y[order], z[order], shares[:, order]
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (y[1:] != y[:-1])])
            for k in range(4):  # runs of equal label and node differ, so no place is added to twice at once
                held[y[starts], at[starts] + k + most] += np.add.reduceat(z * shares[k][:, None], starts, axis=0)
        label, node = np.nonzero(held.any(axis=2))
        yield 2 * (node - most) + label, held[label, node]

    keys, sums = summed(rows, visit, 33)
    return {c: (keys[keys % 2 == c] // 2, sums[keys % 2 == c, 0], sums[keys % 2 == c, 1:]) for c in (0, 1)}


def scatter(rows: DataFrame, model: Ranker, curves: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum of z z' over all rows, each weighted by its label's curve (margins, values) at its margin."""

    def visit(batches):
        total = np.zeros((32, 32))
        for x, y in batches:
            z, s = model.points(x), model.margins(x)
            total += (z * np.where(y == 1, *(np.interp(s, *curves[c]) for c in (1, 0)))[:, None]).T @ z
        yield np.arange(32), total

    return summed(rows, visit, 32)[1]


@dataclass
class PairSums:
    loss: float
    gradient: np.ndarray
    curves: dict[int, tuple[np.ndarray, np.ndarray]]  # margins, and what a row of each label weighs in the second derivative there
    cross: np.ndarray


def over_pairs(nodes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> PairSums:
    """Sums over all pairs of a good and a bad document of the logistic loss of their margins' difference and its derivatives. Differences of nodes are whole numbers of steps, so each is looked up."""
    (j, m, zb), (i, n, zg) = nodes[0], nodes[1]
    first = int(i.min() - j.max())
    apart = np.arange(first, int(i.max() - j.min()) + 1) * STEP
    loss, miss = np.logaddexp(0, -apart), np.exp(-np.logaddexp(0, apart))
    bend = miss * (1 - miss)
    total, cross = 0.0, np.zeros((32, 32))
    good, bad = np.zeros((2, len(i))), np.zeros((2, len(j)))  # sums of miss and bend over the other side
    some = max(1, 1_000_000 // len(j))
    for k in range(0, len(i), some):
        part = slice(k, k + some)
        at = i[part, None] - j[None] - first
        total += n[part] @ loss[at] @ m
        missed, bent = miss[at], bend[at]
        good[:, part] = missed @ m, bent @ m
        bad += n[part] @ missed, n[part] @ bent
        cross += zg[part].T @ (bent @ zb)
    return PairSums(float(total), good[0] @ zg - bad[0] @ zb, {1: (i * STEP, good[1]), 0: (j * STEP, bad[1])}, cross)


def ranked(values: DataFrame, k: int) -> tuple[float, float]:
    """The k-th smallest value, from 1, of a column of doubles and the one after it. Bins of the range are counted, and the bin of the k-th is cut again until it holds one value."""
    v = F.col(values.columns[0])
    low, high = values.agg(F.min(v), F.max(v)).first()
    below, after = 0, high
    while low < high:
        at = F.least(F.floor((v - low) / (high - low) * BINS), F.lit(BINS - 1)).alias("at")
        bins = sorted(values.where(v.between(low, high)).groupBy(at).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).collect())  # BINS rows at most
        ends = below + np.cumsum([b["n"] for b in bins])
        hit = int(np.searchsorted(ends, k))
        if ends[hit] == k and hit + 1 < len(bins):
            after = bins[hit + 1]["low"]
        elif ends[hit] > k:
            after = bins[hit]["high"]
        below, low, high = int(ends[hit]) - bins[hit]["n"], bins[hit]["low"], bins[hit]["high"]
    return low, after


def fit_pairs(rows: DataFrame) -> Ranker:
    """Bradley-Terry on rows of x and __label: P(a preferred to b) is the logistic function of the difference of their scores, here w . (x_a - x_b); w minimises the mean logistic loss over all pairs of a good and a bad row, with a small penalty, by Newton steps. Pairs are summed by way of the nodes around margins, in two passes over the rows a step, and never formed. The threshold is the quantile of all rows' margins at the share of rejected ones. Numbers are rounded to single precision, so that sums in another order give the same ranker."""
    single = lambda v: np.array(v, np.float32).astype(float)
    labels, sizes = totals(rows, lambda x: x)
    if len(labels) < 2:
        return Ranker(np.zeros(32), np.ones(32), np.zeros(32), 0.0, 1.0)
    (bad, good), n = (int(k) for k in sizes[:, 0]), int(sizes[:, 0].sum())
    mean = sizes[:, 1:].sum(axis=0) / n
    scale = single(np.sqrt(totals(rows, lambda x: (x - mean) ** 2)[1][:, 1:].sum(axis=0) / n))
    mean = single(mean)
    scale[scale <= 1e-6 * np.abs(mean)] = np.inf  # columns without differences count for nothing
    w, step, least = np.zeros(32), np.zeros(32), np.inf
    for _ in range(ROUNDS):
        model = Ranker(mean, scale, w, 0.0, 1.0)
        pairs = over_pairs(at_nodes(rows, model))
        loss = pairs.loss / (good * bad) + RIDGE / 2 * w @ w
        if loss > least + 1e-7:  # too far
            step = step / 2
            w = w - step
            continue
        least = loss
        hessian = (scatter(rows, model, pairs.curves) - pairs.cross - pairs.cross.T) / (good * bad) + RIDGE * np.eye(32)
        step = np.linalg.solve(hessian, pairs.gradient / (good * bad) - RIDGE * w)
        step *= min(1.0, 50 / max(1e-9, np.abs(step).sum()))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    model = Ranker(mean, scale, single(w), 0.0, 1.0)

    @F.pandas_udf("double")
    def margin(xs: pd.Series) -> pd.Series:
        return pd.Series(model.margins(np.array(xs.tolist(), float).reshape(-1, 16)))

    margins = materialised(rows.select(margin("x").alias("margin")), "quality-margins")
    model.cut = sum(ranked(margins, bad)) / 2
    return model


def learning(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be learned: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string")) % 3 != 1


def known_labels(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """(__id, __label) of learnable ids; null ids and ids with labels of both classes are left out."""
    return labels.select(F.col(id_col).alias("__id"), F.col(label).alias("__given")).where(F.col("__given").isin(0, 1) & learning("__id")).groupBy("__id").agg(F.min("__given").alias("__label"), F.max("__given").alias("__most")).where("__label = __most").drop("__most")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__text, __label) of up to sample learnable ids of each class. Only ids are chosen before the texts are read, so texts aren't shuffled; null ids and ids with labels of both classes are left out. Ids may be of any type, and a text whose id repeats is there as often."""
    known = known_labels(labels, label, id_col)
    order = [F.xxhash64(F.col("__id"), F.lit(3)), F.col("__id")]
    chosen = [r for c in (0, 1) for r in known.where(F.col("__label") == c).orderBy(*order).limit(sample).select("__id", "__label").collect()]
    few = docs.sparkSession.createDataFrame([(r[0], int(r[1])) for r in chosen], T.StructType([T.StructField("__id", labels.schema[id_col].dataType), T.StructField("__label", T.IntegerType())]))  # 2 * sample rows at most
    return docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("__text")).join(F.broadcast(few), F.col("__own") == F.col("__id")).select("__text", "__label")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Ranker:
    """Fits the ranker on all learnable labelled rows: null ids and ids with labels of both classes are left out, ids may be of any type, and a text whose id repeats counts as often. Only features meet labels, so texts aren't shuffled; they are stored, as each Newton step passes over them. The order and the partitions of rows don't count. Without labels of both classes every text scores 0.5."""

    @F.pandas_udf("array<double>")
    def as_features(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).tolist() for t in texts])

    own = docs.where(learning(id_col)).select(F.col(id_col).alias("__own"), as_features(F.col(text_col)).alias("x"))
    rows = own.join(known_labels(labels, label, id_col), F.col("__own") == F.col("__id")).select("x", F.col("__label").cast("int").alias("__label"))
    return fit_pairs(materialised(rows, "quality-features"))


def score_column(model: Ranker, text_col: str = "text") -> Column:
    """The score, 0 to 1, of every whole text, of its text only: equal texts score alike, null and empty texts get the score of zero features, an empty table gives an empty one."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    return score(F.col(text_col))
