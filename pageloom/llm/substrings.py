"""Passages that an earlier document holds are removed: anchors at difference-cover positions find them, and their extensions to whole windows are compared."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import bitmap, by_group, is_marked, marked, partitions, stored

#: Words of a window.
WINDOW = 13
#: Difference covers. Modulo the period, every number is the difference of two positions of the cover.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Characters of texts that are looked at at once, anchors that one group compares, and windows of a stretch on average (a power of two).
UNIT_CHARS, GROUP_ANCHORS, STRETCH = 3_000_000, 2_000_000, 32
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """(period, cover): anchors have window - period + 1 words, half a window at least. Two equal windows, wherever they start, hold at one and the same offset below the period an anchor that is on the cover in both."""
    period = max(p for p in COVERS if 2 * p - 1 <= window)
    return period, COVERS[period]


class _Hashes(dict):
    """64 bits of each word; those met lately are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _P
    x = (x ^ (x >> np.uint64(29))) * _Q
    return x ^ (x >> np.uint64(32))


def _rolled(words: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    """A hash of every run of width words."""
    n = len(words) - width + 1
    total = np.zeros(max(0, n), np.uint64)
    for k in range(width if n > 0 else 0):
        total = total * factor + words[k : k + n]
    return _mixed(total)


@dataclass
class Unit:
    """The words of some texts end to end: hashes, the text that each belongs to, its place there and how many follow to the end of the text, itself included."""

    words: np.ndarray
    text: np.ndarray
    place: np.ndarray
    room: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], seen: _Hashes) -> Unit:
        hashes, sizes = [np.zeros(0, np.uint64)], []
        for t in texts:
            words = t.encode("utf-8", "surrogatepass").split() if t else []
            hashes.append(np.fromiter(map(seen.__getitem__, words), np.uint64, len(words)))
            sizes.append(len(words))
        n, ends = np.array(sizes, np.int64), np.cumsum(sizes, dtype=np.int64)
        at = np.arange(n.sum())
        return cls(np.concatenate(hashes), np.repeat(np.arange(len(texts)), n), at - np.repeat(ends - n, n), np.repeat(ends, n) - at)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of all anchors."""
        period, cover = cover_of(window)
        width = window - period + 1
        h = _rolled(self.words, width, _P)
        at = np.flatnonzero(np.isin(self.place % period, cover)[: len(h)] & (self.room[: len(h)] >= width))
        return at, h[at]

    def candidates(self, window: int, marks: np.ndarray, groups: int) -> np.ndarray:
        """Positions of the windows that hold a marked anchor."""
        period, _ = cover_of(window)
        at, h = self.anchors(window)
        hit = np.zeros(len(self.words) + period, np.int64)
        hit[at[_known(marks, _names(h, groups))]] = 1
        before = np.r_[0, np.cumsum(hit)]
        n = max(0, len(self.words) - window + 1)
        return np.flatnonzero((before[period : period + n] > before[:n]) & (self.room[:n] >= window))

    def stretches(self, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """Windows at the given positions and the stretches that they form: (two hashes of each window, index of each stretch's first window, two hashes of each stretch). A stretch ends where the windows do, or where a window's own hash says so, so that two copies of a passage are cut alike."""
        a, b = (_rolled(self.words ^ (self.words >> np.uint64(s)), window, f)[at] if len(at) else np.zeros(0, np.uint64) for s, f in ((32, _P), (31, _Q)))
        if not len(at):
            return a, b, at, a, b
        cut = (a & np.uint64(STRETCH - 1)) == 0
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (self.text[at[1:]] != self.text[at[:-1]])] | cut)
        return a, b, first, np.add.reduceat(_mixed(a), first), np.add.reduceat(_mixed(b ^ _P), first)


def _group(h: np.ndarray, groups: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(groups)) >> np.uint64(24)


def _names(h: np.ndarray, groups: int) -> np.ndarray:
    """What is left of an anchor's hash in its group of hashes: the group's number and 32 bits."""
    return (_group(h, groups) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _probes(names: np.ndarray) -> list[np.ndarray]:
    return [_mixed(names * _P + np.uint64(k)).view(np.int64) for k in (1, 2)]


def _known(marks: np.ndarray, names: np.ndarray) -> np.ndarray:
    return np.logical_and(*(is_marked(marks, p) for p in _probes(names)))


def _units(batch: pa.RecordBatch, seen: _Hashes) -> Iterator[tuple[pa.RecordBatch, Unit]]:
    """A batch in parts of about UNIT_CHARS; a longer text is a part of its own."""
    texts = batch.column("text").to_pylist()
    part = np.cumsum([len(t or "") for t in texts]) // UNIT_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a), Unit.of(texts[a:b], seen)


def repeated_anchors(rows: DataFrame, window: int, groups: int) -> DataFrame:
    """One column h: two hashes for each anchor that two rows or more hold.

    Anchors travel packed: of each part of the rows, 32 bits of its distinct anchors to each group of hashes, and apart from these the anchors that several rows of the part hold. So a very frequent anchor is folded before the shuffle. Within a group an unequal anchor has the same 32 bits once in 2,000; that costs a comparison later, and loses nothing."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Hashes()
        for batch in batches:
            for _, unit in _units(batch, seen):
                at, h = unit.anchors(window)
                order = np.argsort(h, kind="stable")
                h, text = h[order], unit.text[at[order]]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else order
                several = text[first] != text[np.r_[first[1:], len(h)] - 1] if len(h) else order.astype(bool)
                h = h[first]
                group = _group(h, groups)
                at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(h) else order
                parts = [(h[a:b].astype(np.uint32), several[a:b]) for a, b in zip(at, [*at[1:], len(h)])]
                yield pa.RecordBatch.from_arrays([pa.array(group[at].astype(np.int32)), pa.array([x[~m].tobytes() for x, m in parts], pa.binary()), pa.array([x[m].tobytes() for x, m in parts], pa.binary())], ["grp", "once", "several"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (group,), part in by_group(batches, ["grp"]):
            once = np.sort(np.frombuffer(b"".join(part["once"]), np.uint32))
            twice = np.unique(np.r_[once[1:][once[1:] == once[:-1]], np.frombuffer(b"".join(part["several"]), np.uint32)])
            for h in _probes((np.uint64(group) << np.uint64(32)) | twice.astype(np.uint64)):
                yield pd.DataFrame({"h": h})

    packed = rows.select("text").mapInArrow(pack, "grp int, once binary, several binary")
    packed = packed.repartition(max(2, partitions(rows.sparkSession)), "grp").sortWithinPartitions("grp")
    return stored(packed.mapInPandas(compare, "h long"), "repeated-anchors")


def _windows(rows: DataFrame, window: int, groups: int, marks: Broadcast, first: Broadcast | None) -> DataFrame:
    """Without first: every stretch of candidate windows as (a, b, doc, rk, start, n, k), where a and b are hashes and k one of the stretch and its row. With first, a bitmap of such k: (a, b, doc, rk, start) of the single windows of the stretches that it marks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Hashes()
        for batch in batches:
            for part, unit in _units(batch, seen):
                at = unit.candidates(window, marks.value, groups)
                a, b, starts, sa, sb = unit.stretches(at, window)
                size = np.diff(np.r_[starts, len(at)])
                keys = part.column("key").to_numpy().view(np.uint64)
                k = _mixed(sa ^ (sb * _P) ^ keys[unit.text[at[starts]]]).view(np.int64)
                if first is None:
                    where, own = at[starts], [sa.view(np.int64), sb.astype(np.uint32).view(np.int32)]
                else:
                    mine = np.repeat(is_marked(first.value, k), size)
                    where, own = at[mine], [a[mine].view(np.int64), b[mine].astype(np.uint32).view(np.int32)]
                row = pa.array(unit.text[where])
                out = [pa.array(own[0]), pa.array(own[1]), part.column("doc").take(row), part.column("rk").take(row), pa.array(unit.place[where].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(size.astype(np.int32)), pa.array(k)] if first is None else out, names)

    kind = rows.schema["doc"].dataType.simpleString()
    schema = f"a long, b int, doc {kind}, rk long, start int" + (", n int, k long" if first is None else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.select("doc", "rk", F.xxhash64("doc", "rk").alias("key"), "text").mapInArrow(of, schema)


def _earlier(found: DataFrame, how: str) -> DataFrame:
    """found with lo, the smallest doc of those rows that have the same a and b, where there are several. They are summed up before the shuffle, as one passage may be in very many documents, and stored, so that Spark can split the join at such a passage."""
    several = found.groupBy("a", "b").agg(F.min("doc").alias("lo"), F.count("*").alias("n")).where("n > 1").drop("n")
    return found.join(stored(several, "several"), ["a", "b"], how)


def kept_columns(text: Column, spans: Column, window: int) -> Column:
    """struct<n_words, n_removed, kept> of a text and array<struct<start, n>>, runs of n windows to remove."""

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def of(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, found in zip(texts, spans):
            words = (t or "").encode("utf-8", "surrogatepass").split()
            if found is None or not len(found):
                out.append((len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass")))
                continue
            change = np.zeros(len(words) + 1, np.int64)
            for s in found:
                change[s["start"]] += 1
                change[s["start"] + s["n"] - 1 + window] -= 1
            keep = np.cumsum(change[:-1]) == 0
            out.append((len(words), int(len(words) - keep.sum()), b" ".join(w for w, k in zip(words, keep.tolist()) if k).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return of(text, spans)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept) for every row of docs: kept is its words, with one space between, but for those covered by window consecutive words that also start in a document with a smaller id. Windows are judged on the input.

    Words are split at ASCII white space and are compared as they are. Texts are read whole. Null and empty texts have no words, shorter ones than a window stay. A null id counts as larger than any other. Rows that share an id never remove from each other; repeated rows give repeated rows. Ids may be of any type that has an order. Other columns are ignored. An empty table gives an empty one.

    Anchors of half a window are hashed at the positions of a difference cover modulo a period only, so any two equal windows share one at the same offset. Around every anchor that two rows hold, the windows that contain it are hashed whole (96 bits). Neighbouring ones form stretches that end where a window's hash says so: most repeats are settled by comparing stretches, and only the first document of each different stretch sends its single windows to the comparison. What is broadcast are bitmaps of 32 MB at most. They have no false negatives: should they fill up (some 10^8 repeated anchors), more windows are compared, up to all, and no repeat is lost. Texts that lose nothing are never shuffled.
    """
    spark = docs.sparkSession
    id_, text = F.col(id_col), F.col(text_col)
    sized = docs.select(F.sum(F.length(text).cast("long")).alias("n")).first()["n"] or 0
    groups = int(min(1 << 22, max(4 * partitions(spark), math.ceil(sized / 14 / GROUP_ANCHORS))))
    again = stored(docs.groupBy(id_.alias("doc")).count().where("count > 1 and doc is not null").select(F.xxhash64("doc").alias("h")), "repeated-ids")
    # Rows that share an id are told apart by their texts; the bitmap may take a few others for such, which does no harm.
    shared = F.coalesce(marked(bitmap(again), F.xxhash64(id_)), F.lit(False)) if not again.isEmpty() else F.lit(False)
    rk = F.when(id_.isNull() | shared, F.xxhash64(text)).otherwise(0)
    rows = docs.select(id_.alias("doc"), rk.alias("rk"), text.alias("text"))
    some = rows.where(text.isNotNull())
    marks = bitmap(repeated_anchors(some, window, groups))

    later = F.col("lo").isNotNull() & (F.col("doc").isNull() | (F.col("lo") < F.col("doc")))
    stretches = stored(_windows(some, window, groups, marks, None), "stretches")
    judged = stored(_earlier(stretches, "left").select("doc", "rk", "start", "n", "k", later.alias("later")), "judged-stretches")
    first = bitmap(judged.where("not later").select("k"))
    single = stored(_windows(some, window, groups, marks, first), "windows")
    single = _earlier(single, "inner").where(later).select("doc", "rk", "start", F.lit(1).alias("n"))
    gone = judged.where("later").select("doc", "rk", "start", "n").unionByName(single)
    gone = stored(gone.groupBy("doc", "rk").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "removed")

    touched = marked(bitmap(gone.select(F.xxhash64("doc", "rk", F.lit(1)).alias("h"))), F.xxhash64("doc", "rk", F.lit(1)))
    none = F.array().cast("array<struct<start:int,n:int>>")
    of = gone.select(F.col("doc").alias("d"), F.col("rk").alias("r"), "spans")
    joined = some.where(touched).join(of, F.col("doc").eqNullSafe(F.col("d")) & (F.col("rk") == F.col("r")), "left").select("doc", "text", "spans")
    rest = rows.where(F.col("text").isNull() | ~touched).select("doc", "text", none.alias("spans"))
    out = joined.unionByName(rest).select("doc", kept_columns(F.col("text"), F.col("spans"), window).alias("out"))
    return out.select(F.col("doc").alias(id_col), "out.n_words", "out.n_removed", "out.kept")
