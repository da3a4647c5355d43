"""Benchmark decontamination by spaced seeds: hits ignore fixed token positions, and each hit is verified along its diagonal."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import bitmap, is_marked, marked, stored, unlike

#: Token positions that each mask compares; every mask ignores some. Items of up to SHORT tokens have the first two, longer ones the other three. No overlap that counts escapes the masks of its item (tests go through all ways to place mismatches).
SHORT_MASKS, LONG_MASKS = ((0, 1, 2, 4), (0, 3, 4, 5)), ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 8, 9), (0, 2, 4, 5, 6, 7))
SHORT = 15
#: Tokens that a mask spans at most.
SPAN = 1 + max(m[-1] for m in (*SHORT_MASKS, *LONG_MASKS))
#: An overlap counts with so many matching tokens, or all but the allowed substitutions of a shorter item; of its length, so large a part must match.
OVERLAP, SIMILARITY = 13, 0.8
#: Items with fewer tokens are too short to tell and never match.
SHORTEST = 5
#: Hits, and tokens along diagonals, that a search looks at at once.
CHUNK = 1_000_000
#: A benchmark of up to so many tokens is broadcast with its seeds; the seeds of a larger one are joined, and items are compared in blocks of this size.
BLOCK_TOKENS = 2_000_000
#: Pairs of equal seeds of a text and an item beyond which the item's diagonals are counted token by token instead.
HOT_PAIRS = 20_000

_TOKEN = re.compile(r"\w+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _hashes(ids: np.ndarray, mask: tuple, places: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(places), len(mask) * 1_000_003, np.uint64)
        for k, m in enumerate(mask):
            h = (h ^ (ids[places + m].astype(np.uint64) * _FACTORS[k % 6])) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(31)
    return h


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    return SHORT_MASKS if n <= SHORT else LONG_MASKS


@dataclass
class Seeds:
    """The seeds of all items under one mask: sorted hashes, and for each the groups of an item's places that it has. starts has one more."""

    mask: tuple
    hashes: np.ndarray
    groups: np.ndarray
    item: np.ndarray
    starts: np.ndarray
    place: np.ndarray
    marks: np.ndarray  # whether some hash ends in these bits

    @classmethod
    def of(cls, mask: tuple, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Seeds:
        h, item, place = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((place, item, h))
        h, item, place = h[order], item[order], place[order]
        group = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (item[1:] != item[:-1])]) if len(h) else order
        first = np.flatnonzero(np.r_[True, h[group][1:] != h[group][:-1]]) if len(h) else order
        marks = np.zeros(1 << 20, bool)
        marks[h & np.uint64(len(marks) - 1)] = True
        return cls(mask, h[group][first], np.r_[first, len(group)], item[group], np.r_[group, len(h)], place, marks)

    def met(self, ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the windows whose tokens are all known and whose hash may be one of these."""
        n = len(ids) - self.mask[-1]
        at = np.flatnonzero(reduce(np.logical_and, (known[m : m + n] for m in self.mask))) if n > 0 else np.zeros(0, np.int64)
        h = _hashes(ids, self.mask, at)
        hit = self.marks[h & np.uint64(len(self.marks) - 1)]
        return at[hit], h[hit]


@dataclass
class Index:
    """One block of benchmark items. Tokens are numbered from 1; 0 is any token that no item has."""

    vocabulary: dict[str, int]
    items: list[tuple[object, np.ndarray]]
    seeds: list[Seeds]
    flat: np.ndarray  # tokens of all items end to end, where each starts, and how many must match
    starts: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]]) -> Index:
        vocabulary: dict[str, int] = {}
        items = [(i, np.array([vocabulary.setdefault(t, len(vocabulary) + 1) for t in ts], np.int64)) for i, text in rows if len(ts := tokens(text)) >= SHORTEST]
        seeds = []
        for mask in (*SHORT_MASKS, *LONG_MASKS):
            found = []
            for n, (_, ids) in enumerate(items):
                if mask in masks_of(len(ids)) and len(ids) > mask[-1]:
                    places = np.arange(len(ids) - mask[-1])
                    found.append((_hashes(ids, mask, places), np.full(len(places), n), places))
            if found:
                seeds.append(Seeds.of(mask, found))
        flat = np.concatenate([np.zeros(0, np.int64), *(ids for _, ids in items)])
        return cls(vocabulary, items, seeds, flat, np.cumsum([0, *(len(ids) for _, ids in items)]), np.array([needed(len(ids)) for _, ids in items], np.int64))

    def diagonals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, shift) of all diagonals with an equal seed; for an item that has very many pairs of equal seeds, all diagonals with enough equal tokens."""
        known, width, met, pairs = ids > 0, len(ids) + self.starts[-1] + 1, [], np.zeros(len(self.items), np.int64)
        for s in self.seeds:
            at, h = s.met(ids, known)
            if not len(at):
                continue
            slot = np.minimum(np.searchsorted(s.hashes, h), len(s.hashes) - 1)
            hit = s.hashes[slot] == h
            at, slot = at[hit], slot[hit]
            order = np.argsort(slot, kind="stable")
            at, slot = at[order], slot[order]
            first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else order
            times, own = np.diff(np.r_[first, len(slot)]), slot[first]
            group = _ranges(s.groups[own], s.groups[own + 1])
            each = np.repeat(np.arange(len(own)), s.groups[own + 1] - s.groups[own])
            places = s.starts[group + 1] - s.starts[group]
            np.add.at(pairs, s.item[group], times[each] * places)
            met.append((s, at, first[each], times[each], group, places))
        hot, keys = pairs > HOT_PAIRS, [np.zeros(0, np.int64)]
        for s, at, first, times, group, places in met:
            cold = ~hot[s.item[group]]
            first, times, group, places = first[cold], times[cold], group[cold], places[cold]
            for k in _chunks(times * places):
                count = times[k] * places[k]
                nth, of = _ranges(np.zeros_like(count), count), np.repeat(np.arange(len(count)), count)
                own = at[first[k][of] + nth // places[k][of]]
                place = s.place[s.starts[group[k]][of] + nth % places[k][of]]
                keys.append(np.unique(s.item[group[k]][of] * width + own - place + self.starts[-1]))
        for i in np.flatnonzero(hot):
            item = self.items[i][1]
            same = equal_tokens(ids, item)
            keys.append(i * width + np.flatnonzero(same >= self.least[i]) - (len(item) - 1) + self.starts[-1])
        item, shift = np.divmod(np.unique(np.concatenate(keys)), width)
        return item, shift - self.starts[-1]

    def search_all(self, texts: list[str | None]) -> list[dict[object, int]]:
        """The result of search for each text. Windows of many texts are hashed at once, and only texts with a hash of an item are looked at one by one."""
        out: list[dict[object, int]] = [{} for _ in texts]
        number, gap = self.vocabulary.get, np.zeros(SPAN, np.int64)
        held, size = [], 0
        for i, text in enumerate(texts):
            words = tokens(text)
            held.append((i, np.array([number(w, 0) for w in words], np.int64)))
            size += len(words) + SPAN
            if size >= CHUNK or i == len(texts) - 1:
                ids = np.concatenate([x for _, own in held for x in (own, gap)])
                ends = np.cumsum([len(own) + SPAN for _, own in held])
                known = ids > 0
                hits = [np.unique(np.searchsorted(ends, s.met(ids, known)[0], "right")) for s in self.seeds]
                for k in np.unique(np.concatenate([np.zeros(0, np.int64), *hits])):
                    out[held[k][0]] = self.search_ids(held[k][1])
                held, size = [], 0
        return out

    def search(self, text: str | None) -> dict[object, int]:
        """Item id -> matching tokens of its longest verified overlap with the whole text."""
        return self.search_all([text])[0]

    def search_ids(self, ids: np.ndarray) -> dict[object, int]:
        item, shift = self.diagonals(ids)
        start, end = np.maximum(0, -shift), np.minimum(np.diff(self.starts)[item], len(ids) - shift)
        best: dict[object, int] = {}
        for k in _chunks(end - start):
            own = _ranges(self.starts[item[k]] + start[k], self.starts[item[k]] + end[k])
            same = self.flat[own] == ids[_ranges(start[k] + shift[k], end[k] + shift[k])]
            cuts = np.r_[0, np.cumsum(end[k] - start[k])]
            total = np.r_[0, np.cumsum(same)]
            total = total[cuts[1:]] - total[cuts[:-1]]
            enough = np.flatnonzero(total >= self.least[item[k]])
            for j in enough[np.argsort(-total[enough], kind="stable")]:  # a diagonal with no more matches than an overlap that is known can't better it
                item_id = self.items[item[k][j]][0]
                if total[j] > best.get(item_id, 0) and (matched := overlap(same[cuts[j] : cuts[j + 1]])) >= self.least[item[k][j]]:
                    best[item_id] = max(best.get(item_id, 0), matched)
        return best


def equal_tokens(ids: np.ndarray, item: np.ndarray) -> np.ndarray:
    """How many tokens are equal on each diagonal, from the one where the item's last token meets the text's first: one correlation for each different token of the item."""
    n = len(ids) + len(item) - 1
    size = 1 << n.bit_length()
    total = np.zeros(size // 2 + 1, complex)
    for token in np.unique(item[item > 0]):
        total += np.fft.rfft(ids == token, size) * np.fft.rfft((item == token)[::-1], size)
    return np.rint(np.fft.irfft(total, size)[:n]).astype(np.int64)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0]..high[0]-1, low[1]..high[1]-1 and so on."""
    n = high - low
    return np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())


def _chunks(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of about CHUNK in all; one larger member is a slice of its own."""
    block = np.cumsum(sizes) // CHUNK
    cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(sizes)]
    return (slice(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b > a)


def needed(n: int) -> int:
    """Matching tokens with which an item of n tokens counts."""
    return min(OVERLAP, max(SHORTEST, math.ceil(Fraction(str(SIMILARITY)) * n)))


def overlap(same: np.ndarray) -> int:
    """Most matches in a stretch of a diagonal in which at least SIMILARITY of the tokens match. Along the diagonal a match counts up and a mismatch down what balances it at that share; from each start the farthest end that isn't lower has the most matches."""
    share = Fraction(str(SIMILARITY))
    total = np.r_[0, np.cumsum(np.where(same, share.denominator - share.numerator, -share.numerator))]
    ahead = np.maximum.accumulate(total[::-1])[::-1]
    far = np.searchsorted(-ahead, -total, "right") - 1
    matches = np.r_[0, np.cumsum(same)]
    return int((matches[far] - matches).max())


def token_hashes(words: list[str], seen: dict[str, int]) -> np.ndarray:
    """64 bits of each token; seen keeps those of tokens met before."""
    if len(seen) > 500_000:
        seen.clear()
    for w in words:
        if w not in seen:
            seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter((seen[w] for w in words), np.uint64, len(words))


def benchmark_rows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null").distinct()


def _found(rows: DataFrame) -> str:
    return f"array<struct<item:{rows.schema['item'].dataType.simpleString()},matched:int>>"


def broadcast_overlaps(docs: DataFrame, rows: DataFrame, text_col: str) -> Column:
    """array<struct<item, matched>> of each text, by item, from a benchmark whose items and seeds all tasks hold."""
    shared = docs.sparkSession.sparkContext.broadcast(Index.of([tuple(r) for r in rows.orderBy("item", "text").collect()]))  # of checked size

    @F.pandas_udf(_found(rows))
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"item": i, "matched": n} for i, n in sorted(found.items())] for found in shared.value.search_all(texts.tolist())])

    return of(F.col(text_col))


def seeds(rows: DataFrame, key: str, text_col: str, own: bool, marks: Broadcast | None = None) -> DataFrame:
    """(mask, h, key) of all windows of all texts, each once for a text. own: only under the masks of the text's own length, as for an item; marks leaves out hashes that a bitmap doesn't know."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for batch in batches:
            for k, text in zip(batch["key"], batch["text"]):
                ids = token_hashes(tokens(text), seen)
                for m, mask in enumerate((*SHORT_MASKS, *LONG_MASKS)):
                    if len(ids) <= mask[-1] or own and (len(ids) < SHORTEST or mask not in masks_of(len(ids))):
                        continue
                    h = np.unique(_hashes(ids, mask, np.arange(len(ids) - mask[-1])).view(np.int64))
                    h = h[is_marked(marks.value, h)] if marks else h
                    if len(h):
                        yield pd.DataFrame({"mask": np.int32(m), "h": h, "key": k})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(text_col).alias("text")).mapInPandas(of, f"mask int, h long, key {kind}")


def joined_overlaps(docs: DataFrame, rows: DataFrame, text_col: str, blocks: int) -> tuple[DataFrame, Broadcast]:
    """(key, overlaps), one row for each distinct text that overlaps an item, keyed by the text's SHA-256, and a bitmap of these keys.

    Windows of texts whose hash is none of the benchmark's leave their task nowhere. The others are joined to the benchmark's seeds by mask and hash, each hash once for a text and once for an item; the pairs of texts and items that this gives are joined to items and texts, an item block at a time in one row, and verified as with an index of these items.
    """
    key = F.sha2(F.col(text_col), 256)
    rows = rows.withColumn("n", F.xxhash64("item", "text"))  # ids may repeat, and may be of any type
    own = stored(seeds(rows, "n", "text", True).withColumnRenamed("key", "n"), "benchmark-seeds")
    hits = seeds(docs.select(key.alias("key"), F.col(text_col).alias("text")).where("key is not null"), "key", "text", False, bitmap(own.select("h").distinct()))
    pairs = stored(hits.join(own, ["mask", "h"]).select("key", "n").distinct(), "overlap-candidates")
    block = F.pmod("n", F.lit(blocks)).alias("block")
    found = pairs.join(rows.withColumnRenamed("text", "said"), "n").groupBy("key", block).agg(F.collect_list(F.struct("item", "said")).alias("items"))
    maybe = marked(bitmap(pairs.select(F.xxhash64("key").alias("h")).distinct()), F.xxhash64(key))

    @F.pandas_udf(_found(rows))
    def verified(texts: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([[{"item": i, "matched": n} for i, n in sorted(Index.of([(c["item"], c["said"]) for c in own]).search(t).items())] for t, own in zip(texts, items)])

    texts = docs.where(F.col(text_col).isNotNull() & maybe).select(key.alias("key"), F.col(text_col).alias("text"))
    checked = texts.join(found, "key").select("key", "block", verified("text", "items").alias("part")).where(F.size("part") > 0).dropDuplicates(["key", "block"])
    one = checked.select("key", F.explode("part").alias("o")).groupBy("key", F.col("o.item").alias("item")).agg(F.max("o.matched").alias("matched"))  # an id may be in several blocks with different texts
    checked = stored(one.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("item", "matched"))).alias("overlaps")), "overlaps")
    return checked, bitmap(checked.select(F.xxhash64("key").alias("h")))


def with_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "overlaps", id_col: str = "item_id", item_text_col: str = "text", most: int = BLOCK_TOKENS) -> DataFrame:
    """docs with a column of all benchmark items that each whole text overlaps: array<struct<item, matched>>, by item.

    Tokens are runs of letters, digits and underscores in lower case. Every window of a text is hashed under each mask and joined to the hashes of all benchmark windows; around a hit the two texts are compared along the diagonal. A benchmark of up to most tokens is broadcast; the seeds of a larger one are joined by a shuffle, which only windows that a bitmap of its hashes marks take part in. Texts that overlap nothing are never shuffled.

    Null and empty texts overlap nothing, an empty benchmark matches nothing, benchmark rows without id or text are ignored, those that share an id are one item with the better overlap. Ids may be of any type that has an order. Repeated rows are treated alike, very long texts are searched whole. Other columns, whatever their names, are kept, one with the name of out is replaced. An empty table gives an empty one.
    """
    rows = benchmark_rows(benchmark, id_col, item_text_col)
    size = int(rows.agg(F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+")))).first()[0] or 0)
    if size <= most:
        return docs.withColumn(out, broadcast_overlaps(docs, rows, text_col))
    found, marks = joined_overlaps(docs, stored(rows, "benchmark"), text_col, -(-size // most))
    key, none = F.sha2(F.col(text_col), 256), F.array().cast(_found(rows))
    maybe = F.coalesce(marked(marks, F.xxhash64(key)), F.lit(False)) & F.col(text_col).isNotNull()
    columns = [c for c in docs.columns if c != out]
    rest = docs.where(~maybe).select(*columns, none.alias(out))
    own = docs.where(maybe).select(F.struct(*columns).alias("row"), key.alias("own"))
    joined = own.join(found, F.col("own") == F.col("key"), "left")
    return rest.unionByName(joined.select(*(F.col("row").getField(c).alias(c) for c in columns), F.coalesce("overlaps", none).alias(out)))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that overlap no benchmark item; columns of any names are kept."""
    out = unlike("overlaps", docs.columns)
    return with_overlaps(docs, benchmark, text_col, out).where(F.size(out) == 0).drop(out)
