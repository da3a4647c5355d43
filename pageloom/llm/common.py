"""Small helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.tables import materialised as stored
from pageloom.functions.tables import shared_dir

__all__ = ["WORD", "Generations", "Roots", "bitmap", "by_group", "buffered", "in_blocks", "is_marked", "marked", "partitions", "shared_dir", "small_batches", "stored", "table", "unlike"]

#: What separates words in every contract of this package, as a Java / RE2 character class.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that go to a Python worker at once where the session leaves Spark's own number; texts may be long.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Keeps few whole texts in a task's memory: the default of 10,000 rows a batch is lowered, a number that the session sets is kept."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting, "10000") == "10000":
        spark.conf.set(setting, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unlike(name: str, columns: list[str]) -> str:
    """A column name made of name that none of columns has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_group(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of equal keys in batches that are sorted by these keys; a run may span batches."""
    held: list[pd.DataFrame] = []
    now: tuple | None = None
    for batch in batches:
        if batch.empty:
            continue
        values = batch[keys].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(batch)]):
            key = tuple(values[start])
            if key != now:
                if held:
                    yield now, pd.concat(held, ignore_index=True)
                held, now = [], key
            held.append(batch.iloc[start:end])
    if held:
        yield now, pd.concat(held, ignore_index=True)


def buffered(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Neighbouring batches put together until they have so many rows."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def in_blocks(rows: DataFrame, sizes: DataFrame, key: str, cap: int, spread: str) -> DataFrame:
    """Adds own, b1 and b2: members of a group of more than cap rows are dealt over blocks by a hash of spread, and each row goes to every pair of blocks
    that holds its own, so that all pairs of a huge group meet in tasks of bounded size. Smaller groups are one block. sizes has key and n for every group."""
    sizes = stored(sizes.where(F.col("n") > cap).select(key, F.ceil(F.col("n") / cap).alias("n_blocks")), "large-groups")
    whole = [F.lit(0).alias(c) for c in ("own", "b1", "b2")]
    if sizes.isEmpty():
        return rows.select("*", *whole)
    own = F.pmod(F.xxhash64(F.col(spread), F.lit(7)), F.coalesce("n_blocks", F.lit(1))).cast("int")
    dealt = rows.join(sizes, key, "left").withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (F.coalesce("n_blocks", F.lit(1)) - 1).cast("int"))))
    return dealt.select(*rows.columns, "own", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"))


#: Bits of a bitmap of hashes at most (32 MB).
MOST_BITS = 1 << 28
#: Bits of a bitmap that reach the driver as one value.
SLICE_BITS = 1 << 18


def bitmap(hashes: DataFrame, most: int = MOST_BITS) -> Broadcast:
    """A broadcast bitmap of a table of one column of 64-bit hashes, some 16 bits for each up to the given size. What it doesn't mark isn't in the table; what it marks may be."""
    (name,) = hashes.columns
    bits = min(most, 1 << (16 * max(4, hashes.count())).bit_length())
    at = F.col(name).bitwiseAND(bits - 1).alias("at")
    size = min(bits, SLICE_BITS)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            places = np.sort(batch["at"].to_numpy(np.int64))
            cuts = np.flatnonzero(np.r_[True, places[1:] // size != places[:-1] // size]) if len(places) else []
            for own in np.split(places, cuts[1:]) if len(places) else []:
                marks = found.setdefault(int(own[0]) // size, np.zeros(size // 64, np.uint64))
                np.bitwise_or.at(marks, own % size >> 6, np.uint64(1) << (own & 63).astype(np.uint64))
        yield pd.DataFrame({"slice": list(found), "marks": [m.tobytes() for m in found.values()]})

    slices = hashes.select(at).repartition(F.shiftright("at", size.bit_length() - 1)).mapInPandas(pack, "slice long, marks binary")
    marks = np.zeros(bits // 64, np.uint64)
    for k, packed in slices.toLocalIterator():
        marks[k * (size // 64) : (k + 1) * (size // 64)] = np.frombuffer(packed, np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(marks)


def is_marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.int64(64 * len(marks) - 1)
    return (marks[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)) > 0


def marked(shared: Broadcast, hash_: Column) -> Column:
    """Whether a bitmap marks a hash."""

    @F.pandas_udf("boolean")
    def of(hashes: pd.Series) -> pd.Series:
        return pd.Series(is_marked(shared.value, hashes.to_numpy(np.int64)))

    return of(hash_)


class Generations(dict):
    """Results that were asked for lately: of two generations of so many at most, the older one goes when the younger is full."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def missing(self, keys: set) -> list:
        """The keys without a result. All keys that have one are in the younger generation afterwards."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        new = []
        for k in keys:
            if k not in self:
                if k in self.older:
                    self[k] = self.older[k]
                else:
                    new.append(k)
        return new


class Roots:
    """Union-find over 0..n-1 that takes arrays of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def flat(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return self.parent
            self.parent = up

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            root = self.flat()
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if len(i):
                np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
