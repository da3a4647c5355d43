"""Hard negatives for contrastive training: a secondary sort lays each anchor's rows down by score, and one pass over them opens a window for each positive."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import by_group, partitions, stored

#: Rows and anchors of a block that one task scores, and scores that it holds at once.
ROWS, SCORES = 8_192, 2_000_000


def usable_integers(vector: Column, scale: int, most: Column) -> Column:
    """floor(scale * x) of each component in double precision; null where the vector is null, holds a null or non-finite component, or an integer beyond most."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) <= most))
    return F.when(vector.isNotNull() & fits, F.transform(v, lambda x: F.floor(x * scale)))


def _matrix(values: pd.Series, d: int) -> np.ndarray:
    return np.array(values.tolist(), np.int64).reshape(len(values), d)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every partial sum is an integer that a double holds, else in longs."""
    high = rows.shape[1] * int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0))
    if high < 1 << 53:
        return (anchors.astype(float) @ rows.T.astype(float)).astype(np.int64)
    return anchors @ rows.T


def best(score: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """The positions among at of the most highest scores; of equal ones the first."""
    if len(at) > most:
        own = score[at]
        at = at[own >= np.partition(own, len(own) - most)[len(own) - most]]
    return at[np.argsort(-score[at], kind="stable")][:most]


def _paired(rows: DataFrame, anchors: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Rows (side 1) and anchors (side 0) of the same keys in blocks of a bounded size, so that each row meets each anchor in one group (keys, rb, ab). Groups lie in order, anchors first, then rows by id."""
    spark = rows.sparkSession
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("nr")).join(anchors.groupBy(*keys).agg(F.ceil(F.count("*") / ROWS).cast("int").alias("na")), keys)
    counts = stored(counts, "blocks")
    deal = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    many = rows.join(counts, keys).select(*keys, deal("nr").alias("rb"), each("na").alias("ab"), F.lit(1).alias("side"), *[c for c in rows.columns if c not in keys])
    few = anchors.join(counts, keys).select(*keys, each("nr").alias("rb"), deal("na").alias("ab"), F.lit(0).alias("side"), *[c for c in anchors.columns if c not in keys])
    both = many.unionByName(few, allowMissingColumns=True)
    both = both.repartitionByRange(max(2, 2 * partitions(spark)), *keys, "rb", "ab").sortWithinPartitions(*keys, "rb", "ab", "side", F.col("id").asc_nulls_last(), "uid")
    return both.withColumn("id", F.col("id").cast("string"))  # a number beside nulls would become a double in pandas


def _strips(part: pd.DataFrame, d: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray]]:
    """(anchors, rows, scores) of a group, some anchors at a time."""
    side = part["side"].to_numpy()
    few, many = part[side == 0], part[side == 1]
    if len(few) and len(many):
        a, b, step = _matrix(few["q"], d), _matrix(many["q"], d), max(1, SCORES // len(many))
        for k in range(0, len(few), step):
            yield few.iloc[k : k + step], many, scores(a[k : k + step], b)


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row of vectors for which anchor holds and each of its best positives (other rows of its label), the best negatives (rows of another label) whose score is low to high percent of the positive's. A score is the inner product with the anchor of the integers floor(scale * component); higher ones come first, equal ones by the smaller id, null ids last.

    Rows with a null label or vector, or a null or non-finite component take no part, and so do those whose integers are so large that a score may not fit a long (sqrt(2^63 / dimension) and more). Rows of different dimension don't meet; vectors without components score 0. Rows that repeat an id are rows of their own. All ids and labels that have an order will do; other columns are ignored, and an empty table gives an empty one. high is 100 at most, as a window opens at its positive.

    Anchors meet rows in blocks. First only rows of their own label, however common: each block passes on its best few. Once an anchor's positives are known, a block of any rows passes on the first few negatives of each window. Then keys (anchor, descending score, positives first, id) are dealt by anchor and sorted within partitions, and a single pass over them, which holds no more than an anchor's open windows, gives ranks.
    """
    if high > 100:
        raise ValueError("high is 100 at most")
    spark = vectors.sparkSession
    d = F.size(vector_col)
    most = F.floor(F.sqrt((2.0**63 - 1) / F.greatest(d, F.lit(1)))) - 1
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), d.alias("d"), usable_integers(F.col(vector_col), scale, most).alias("q"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = stored(rows.where("label is not null and q is not null"), "integers")
    anchors, rows = rows.where("anchor").drop("anchor"), rows.drop("anchor")
    block = min(ROWS, max(256, math.ceil(rows.count() / max(1, 2 * partitions(spark)))))
    kind = rows.schema["id"].dataType.simpleString()

    def same_label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, dim, _, _), part in by_group(batches, ["label", "d", "rb", "ab"]):
            for few, many, score in _strips(part, dim):
                uid, ids, out = many["uid"].to_numpy(), many["id"].to_numpy(), []
                for i, own in enumerate(few["uid"].to_numpy()):
                    at = best(score[i], np.flatnonzero(uid != own), positives)
                    out.append(pd.DataFrame({"anchor": own, "score": score[i][at], "id": ids[at], "uid": uid[at]}))
                yield pd.concat(out, ignore_index=True)

    def in_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (dim, _, _), part in by_group(batches, ["d", "rb", "ab"]):
            codes = pd.factorize(part["label"])[0]
            part = part.assign(label=codes)
            for few, many, score in _strips(part, dim):
                uid, ids, label, out = many["uid"].to_numpy(), many["id"].to_numpy(), many["label"].to_numpy(), []
                for i, (own, mine, found) in enumerate(zip(few["uid"], few["label"], few["found"])):
                    bounds = {(-(-low * int(p) // 100), high * int(p) // 100) for p in found if p >= 0}
                    if not bounds:
                        continue
                    s = score[i]
                    maybe = np.flatnonzero((s >= min(b[0] for b in bounds)) & (s <= max(b[1] for b in bounds)))
                    maybe = maybe[label[maybe] != mine]
                    picked = [best(s, maybe[(s[maybe] >= a) & (s[maybe] <= b)], negatives) for a, b in bounds]
                    at = np.unique(np.concatenate(picked))
                    if len(at):
                        out.append(pd.DataFrame({"anchor": own, "score": s[at], "id": ids[at], "uid": uid[at]}))
                if out:
                    yield pd.concat(out, ignore_index=True)

    schema = "anchor long, score long, id string, uid long"
    own = F.col("id").cast(rows.schema["id"].dataType)
    near = _paired(rows, anchors, ["label", "d"], block).mapInPandas(same_label, schema).withColumn("id", own)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "uid")
    near = stored(near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).drop("n"), "positives")
    of = near.groupBy("anchor").agg(F.collect_list("score").alias("found"))
    asking = stored(anchors.join(of, F.col("uid") == F.col("anchor")).drop("anchor"), "anchors")
    far = _paired(rows, asking, ["d"], block).mapInPandas(in_windows, schema).withColumn("id", own)

    names = asking.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    keyed = near.withColumn("kind", F.lit(0)).unionByName(far.withColumn("kind", F.lit(1))).join(names, "anchor")
    keyed = keyed.select("anchor", (-F.col("score")).alias("minus"), "kind", F.col("id").isNull().alias("last"), "id", "uid", "anchor_id")
    parts = max(2, 2 * partitions(spark))
    sorted_ = keyed.rdd.map(lambda r: (tuple(r[:6]), r[6])).repartitionAndSortWithinPartitions(parts, lambda k: (k[0] * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32)

    def ranked(records: Iterator[tuple]) -> Iterator[tuple]:
        anchor_, windows = None, []
        for (own, minus, kind_, _, id_, _), anchor_id in records:
            if own != anchor_:
                anchor_, windows = own, []
            if kind_ == 0:
                windows.append([id_, -minus, 0])
                continue
            for w in windows:
                if w[2] < negatives and low * w[1] <= -100 * minus <= high * w[1]:
                    w[2] += 1
                    yield anchor_id, w[0], w[2], id_, w[1], -minus

    out = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    return spark.createDataFrame(sorted_.mapPartitions(ranked), out)
