"""Token counts by unigram dynamic programming over a trie of distinct pre-tokens."""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.llm.common import Generations
from pageloom.llm.token_store import PATTERN

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Longer pre-tokens are counted on their own with the last scores only, so that one path of the trie stays short.
LONGEST = 4_096
CACHE = 150_000

_PIECES = regex.compile(PATTERN)


@lru_cache(maxsize=2)
def scores(path: str = VOCABULARY) -> tuple[dict[bytes, float], int]:
    """Log-probability of every piece of a ranked vocabulary under Zipf's law, log(1 / (rank + 2)) up to a constant, and the longest piece's length. All single bytes are pieces, so every text has a segmentation."""
    with open(path, "rb") as file:
        ranked = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    norm = math.log(sum(1 / (r + 2) for r in ranked.values()))
    return {p: -math.log(r + 2) - norm for p, r in ranked.items()}, max(map(len, ranked))


@lru_cache(maxsize=2)
def endings(path: str = VOCABULARY) -> dict[bytes, float]:
    """Every ending of a piece, with the score of those that are pieces themselves and minus infinity for the others. Bytes that are no ending begin no longer piece that ends there, so a look-back may stop at them."""
    score, _ = scores(path)
    return {p[k:]: score.get(p[k:], -math.inf) for p in score for k in range(len(p))}


def trie_counts(pretokens: list[bytes], path: str = VOCABULARY) -> list[int]:
    """Pieces in the best segmentation of each pre-token (highest score, then fewest pieces).

    The distinct pre-tokens form a trie; it is walked in sorted order, which visits its nodes depth first, and the forward score and count of each node are computed once from those above it, so words with a common prefix share them. The count at a word's last node is its result.
    """
    get, lowest = endings(path).get, -math.inf
    result = dict.fromkeys(pretokens, 0)
    best, count = [0.0], [0]
    before = b""
    for word in sorted(result):
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, least = lowest, 0
            for start in range(end - 1, -1, -1):
                s = get(word[start:end])
                if s is None:
                    break
                if s > lowest:
                    s += best[start]
                    if s > top or s == top and count[start] + 1 < least:
                        top, least = s, count[start] + 1
            best.append(top)
            count.append(least)
        result[word] = count[-1]
        before = word
    return [result[w] for w in pretokens]


def long_count(word: bytes, path: str = VOCABULARY) -> int:
    """The same for one long pre-token, in memory that doesn't grow with its length: place i of the forward scores is kept at i modulo the longest piece and one."""
    get, n = endings(path).get, scores(path)[1] + 1
    best, count = [0.0] * n, [0] * n
    for end in range(1, len(word) + 1):
        top, least = -math.inf, 0
        for start in range(end - 1, -1, -1):
            s = get(word[start:end])
            if s is None:
                break
            if s > -math.inf:
                s += best[start % n]
                if s > top or s == top and count[start % n] + 1 < least:
                    top, least = s, count[start % n] + 1
        best[end % n], count[end % n] = top, least
    return count[len(word) % n]


def pieces_of(text: str | None) -> list[str]:
    return _PIECES.findall(text) if text else []


def count_column(text_col: str = "text", path: str = VOCABULARY) -> Column:
    """Tokens of each whole text as a long; null and empty texts have 0, repeated rows the same each, an empty table gives an empty one. A pre-token of any length is counted whole.

    Each task counts the distinct pre-tokens of a batch of texts that it hasn't met lately in one trie and keeps a bounded number of results."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        cache = _kept.setdefault(path, Generations(CACHE))
        out: list[int] = []
        for start in range(0, len(texts), 256):
            own = [pieces_of(t) for t in texts.iloc[start : start + 256]]
            new = cache.missing({p for ps in own for p in ps})
            raw = [p.encode("utf-8", "surrogatepass") for p in new]
            long_ = [i for i, r in enumerate(raw) if len(r) > LONGEST]
            cache.update(zip(new, trie_counts([r if len(r) <= LONGEST else b"" for r in raw], path)))
            for i in long_:
                cache[new[i]] = long_count(raw[i], path)
            out += [sum(map(cache.__getitem__, ps)) for ps in own]
        return pd.Series(out, dtype="int64")

    return of(F.col(text_col))


_kept: dict[str, Generations] = {}
