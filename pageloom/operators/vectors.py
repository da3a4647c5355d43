"""Inner products of all vectors with a stated few, block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors and others whose products a task holds at once, about what a processor's cache does.
ROWS, OTHERS = 1024, 128

#: Chooses, of vectors a and b (one each row, in doubles, a in the order of their ids), the pairs to keep as positions in a and in b; None keeps all. The third argument tells the pairs that don't count, if any.
Choice = Callable[[np.ndarray, np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]]


def all_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each of a with each of b, added up component by component as a fold does it, so that both give the same bits."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        out += np.multiply.outer(x, y)
    return out


def pair_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in the order of all_dots."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        out += x * y
    return out


def matrices(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, matrix, rows that hold a null) of the vectors of each length."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = pa.array(np.flatnonzero(lengths == d))
        flat = lists.take(at).flatten()
        null = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), d).any(axis=1)
        yield ids.take(at), flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(at), d), null


def dots(vectors: DataFrame, few: DataFrame, block: int, choose: Choice | None = None, itself: bool = False) -> DataFrame:
    """(id, other_id, dot, norms) of vectors (id, v) with few (other_id, o) of the same length: the inner product, null if a vector holds a null, and the product of their norms. choose may leave pairs out. Pairs of one id, and those with null ids, only with itself. Tasks hold a block of few at a time, which the driver hands out, and so many products at a time as fit a cache; null vectors have no row."""
    vectors, few = vectors.select("id", "v").where("v is not null"), few.select("other_id", "o").where("o is not null")
    if not itself:
        vectors, few = vectors.where("id is not null"), few.where("other_id is not null")
    spark = vectors.sparkSession
    schema = T.StructType([vectors.schema["id"], few.schema["other_id"], T.StructField("dot", T.DoubleType()), T.StructField("norms", T.DoubleType())])
    blocks = max(1, -(-few.count() // block))

    def scored(i: int) -> DataFrame:
        held = few.where(F.pmod(F.xxhash64("other_id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        own = {}
        if len(held):
            one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            for ids, m, null in matrices(one(held["other_id"]), one(held["o"])):
                own[m.shape[1]] = ids, m, null
        shared = spark.sparkContext.broadcast(own)

        def strip(ids: pa.Array, a: np.ndarray, null_a: np.ndarray, others: pa.Array, b: np.ndarray, null_b: np.ndarray) -> pa.RecordBatch:
            same = None if itself else np.equal.outer(ids.to_numpy(zero_copy_only=False), others.to_numpy(zero_copy_only=False))
            with np.errstate(all="ignore"):
                if choose is None:
                    x, y = np.indices((len(a), len(b))).reshape(2, -1) if itself else np.nonzero(~same)
                    dot = all_dots(a, b)[x, y]
                else:
                    x, y = choose(a, b, same)
                    dot = pair_dots(a[x], b[y])
                norms = np.sqrt(pair_dots(a, a))[x] * np.sqrt(pair_dots(b, b))[y]
            out = [ids.take(pa.array(x)), others.take(pa.array(y)), pa.array(dot, mask=null_a[x] | null_b[y]), pa.array(norms)]
            return pa.RecordBatch.from_arrays(out, names=["id", "other_id", "dot", "norms"])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, m, null in matrices(batch.column("id"), batch.column("v")) if batch.num_rows else ():
                    if m.shape[1] not in shared.value:
                        continue
                    order = pc.sort_indices(ids)
                    ids, m, null = ids.take(order), m[order], null[order]
                    for k in range(0, len(m), ROWS):
                        for j in range(0, len(shared.value[m.shape[1]][0]), OTHERS):
                            yield strip(*(x[k : k + ROWS] for x in (ids, m, null)), *(x[j : j + OTHERS] for x in shared.value[m.shape[1]]))

        return vectors.mapInArrow(work, schema)

    return reduce(DataFrame.unionByName, [scored(i) for i in range(blocks)])


def near(least: float) -> Choice:
    """Pairs whose cosine may reach least; what has no cosine stays in."""

    def choose(a: np.ndarray, b: np.ndarray, same: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        cosine = a @ b.T / np.multiply.outer(np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1)))
        keep = ~(cosine < least - 1e-5)
        return np.nonzero(keep if same is None else keep & ~same)

    return choose


def best(n: int, score: Callable[[np.ndarray], np.ndarray]) -> Choice:
    """Of each strip the n pairs of b's vectors that score most to four places, equal ones by the order of a; also those whose place hangs on how they are rounded, or that are no numbers. score takes inner products."""

    def choose(a: np.ndarray, b: np.ndarray, same: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        value = score(all_dots(a, b)) * 10_000 + 0.5
        sure = np.abs(value - np.rint(value)) > 1e-6  # what is no number isn't sure
        counts = np.ones(value.shape, bool) if same is None else ~same
        place = np.where(sure & counts, np.floor(value), -np.inf)
        top = np.argsort(-place, axis=0, kind="stable")[:n]
        keep = counts & ~sure
        np.put_along_axis(keep, top, np.take_along_axis(counts, top, 0), 0)
        return np.nonzero(keep)

    return choose
