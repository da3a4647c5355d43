"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Generations
from pageloom.llm.quality import labelled_texts

#: Labelled documents of each class that the model is fitted on, at most; landmarks of each class.
SAMPLE, LANDMARKS = 1_000, 240
#: A subsequence of three characters that spans s characters weighs DECAY ** s; wider ones than SPAN don't count. Characters fall into SYMBOLS classes.
DECAY, SPAN, SYMBOLS = 0.8, 5, 64
#: Weight of the hinge losses of each class against the norm of the weights.
COST = 3e4
#: Longer words are scored in overlapping windows of this length.
WINDOW = 24
CACHE = 75_000

#: Digits and signs that stand for letters inside words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_OUTSIDE = re.compile(r"[\W_]+")
#: Letters and separators have no character in common, so that no text takes more than linear time.
_SPACED = re.compile(r"(?<!\S)(?:[^\W_][\s.*_-]+){3,}[^\W_](?![^\W_])")


def words_of(token: str) -> list[str]:
    """Words of a token without white space: its parts between marks, and all parts joined; letters stand for digits and signs inside mixed tokens."""
    low = token.lower()
    if low.isalpha():
        return [low]
    parts = [p for p in _OUTSIDE.split(low) if p]
    whole = "".join(parts)
    found = [*parts, whole] if len(parts) > 1 else parts
    if not whole.isdigit() and not whole.isalpha() or "@" in low or "$" in low:
        found.append(_OUTSIDE.sub("", low.strip(".,;:!?$%&*#").translate(LEET)))
    return [w for w in found if len(w) > 2 and not w.isdigit()]


def tokens_of(text: str | None) -> set[str]:
    """Distinct tokens between white space, and runs of single letters read as one token."""
    text = text or ""
    return {*text.split(), *("".join(m.split()) for m in _SPACED.findall(text))}


@lru_cache(maxsize=None)
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n) if k - i < SPAN]
    return np.array(at, np.int64).reshape(-1, 3), np.array([DECAY ** (k - i + 1) for i, _, k in at])


def windows(word: str) -> list[str]:
    return [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def _codes(words: list[str], n: int) -> np.ndarray:
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.int32)
    return np.where((points >= 97) & (points <= 122), points - 96, 27 + points % (SYMBOLS - 27)).astype(np.int32)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of words of one length: features is words x places."""
    at, weights = _places(len(words[0]))
    c = _codes(words, len(words[0]))
    return (c[:, at[:, 0]] * SYMBOLS + c[:, at[:, 1]]) * SYMBOLS + c[:, at[:, 2]], weights


def norms(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square roots of the kernel of each word with itself; a subsequence that occurs more than once adds up first."""
    order = np.argsort(features, axis=1)
    f, w = np.take_along_axis(features, order, 1), weights[order]
    total = np.cumsum(w, axis=1)
    last = np.ones_like(f, bool)
    last[:, :-1] = f[:, 1:] != f[:, :-1]
    square = np.zeros(len(f))
    rows, cols = np.nonzero(last)
    ends = total[rows, cols]
    starts = np.where(np.r_[True, rows[1:] != rows[:-1]], 0.0, np.r_[0.0, ends[:-1]])
    np.add.at(square, rows, (ends - starts) ** 2)
    return np.sqrt(square)


def by_length(words: list[str], most: int = 8_192) -> Iterator[list[int]]:
    """Places of words of one length, so many at a time at most; words under three characters have no subsequences."""
    found: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        found.setdefault(len(w), []).append(i)
    for n, at in found.items():
        if n > 2:
            yield from (at[k : k + most] for k in range(0, len(at), most))


def dense(words: list[str], columns: np.ndarray, width: int) -> np.ndarray:
    """Normalised feature rows, restricted to the features that columns maps to a place below width."""
    out = np.zeros((len(words), width), np.float32)
    for at in by_length(words):
        f, w = subsequences([words[i] for i in at])
        to, value = columns[f], np.broadcast_to(w, f.shape) / norms(f, w)[:, None]
        hit = to >= 0
        np.add.at(out, (np.repeat(np.array(at), hit.sum(1)), to[hit]), value[hit])
    return out


@dataclass
class Machine:
    weights: np.ndarray  # of every subsequence; the support vector machine in Nystroem space is linear in them
    bias: float
    slope: float
    offset: float

    def margins(self, words: list[str]) -> np.ndarray:
        """Decision values of words; words without any weight in favour get the bias."""
        out = np.full(len(words), self.bias)
        for at in by_length(words):
            f, w = subsequences([words[i] for i in at])
            value = self.weights[f] @ w
            some = np.flatnonzero(value > 0)
            if len(some):
                out[np.array(at)[some]] = value[some] / norms(f[some], w) + self.bias
        return out

    def token_margins(self, tokens: list[str], most: int = 20_000) -> list[float]:
        out: list[float] = []
        for start in range(0, len(tokens), most):
            pieces = [[x for w in words_of(t) for x in windows(w)] for t in tokens[start : start + most]]
            flat = [x for p in pieces for x in p]
            values = iter(self.margins(flat).tolist() if flat else [])
            out += [max((next(values) for _ in p), default=self.bias) for p in pieces]
        return out

    def score(self, texts) -> np.ndarray:
        """A text scores as its best word; the value becomes a probability by a fitted logistic curve."""
        best = np.full(len(texts), self.bias)
        for start in range(0, len(texts), 256):
            own = [tokens_of(t) for t in texts[start : start + 256]]
            cache = self.__dict__.setdefault("_cache", Generations(CACHE))
            new = cache.missing({t for ts in own for t in ts})
            cache.update(zip(new, self.token_margins(new)))
            best[start : start + 256] = [max(map(cache.__getitem__, ts), default=self.bias) for ts in own]
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -500, 500)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_cache"}


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps in the primal; classes weigh alike."""
    z = np.hstack([x, np.ones((len(x), 1), np.float32)])
    c = np.where(y > 0, cost / max(1, (y > 0).sum()), cost / max(1, (y < 0).sum()))
    w = np.zeros(z.shape[1])
    ridge = np.r_[np.ones(x.shape[1]), 1e-3]
    for turn in range(30):
        slack = 1 - y * (z @ w)
        gram, right = np.diag(ridge), np.zeros(len(w))
        on = np.flatnonzero(slack > 0)
        for k in range(0, len(on), 2_048):
            part = z[on[k : k + 2_048]].astype(float)
            weight = c[on[k : k + 2_048]]
            gram += (part * weight[:, None]).T @ part
            right += part.T @ (weight * y[on[k : k + 2_048]])
        target = np.linalg.solve(gram, right)
        if np.abs(target - w).max() < 1e-5:
            break
        w = w + (target - w) * (1.0 if turn < 20 else 0.5)
    return w


def inserted(word: str, rng: np.random.Generator) -> str:
    """word with a random letter put in, so that the machine learns to bear such spellings."""
    at = int(rng.integers(1, max(2, len(word))))
    return (word[:at] + chr(97 + int(rng.integers(26))) + word[at:])[:WINDOW]


def logistic(values: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a calibrated probability (targets are drawn in a little, so that classes that part cleanly don't give an endless slope)."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * values + b, -50, 50)))
        g = np.array([np.sum((p - t) * values) + 1e-3 * a, np.sum(p - t)])
        s = p * (1 - p) + 1e-9
        h = np.array([[np.sum(s * values * values) + 1e-3, np.sum(s * values)], [np.sum(s * values), np.sum(s) + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(toxic: list[list[str]], clean: list[list[str]], landmarks: int = LANDMARKS, rounds: int = 4, seed: int = 1) -> Machine:
    """toxic and clean hold the distinct words of each text of a class. A toxic text need only have one toxic word, so the machine is fitted on witnesses, the best words of each toxic text, against words of clean texts, and witnesses and the hardest clean words are chosen anew each round (multiple-instance learning). The first witnesses are words whose subsequences are commoner in toxic texts."""
    rng, size = np.random.default_rng(seed), SYMBOLS**3
    vocabulary = list(dict.fromkeys(w for ws in (*toxic, *clean) for w in ws if len(w) > 2))
    place = {w: i for i, w in enumerate(vocabulary)}
    groups = [(at, *subsequences([vocabulary[i] for i in at])) for at in by_length(vocabulary)]
    features: list[np.ndarray] = [np.zeros(0, np.int32)] * len(vocabulary)
    for at, f, _ in groups:
        for i, row in zip(at, f):
            features[i] = row
    counts = []
    for texts in (toxic, clean):
        count = np.zeros(size)
        for ws in texts:
            if own := [features[place[w]] for w in ws if w in place]:
                count[np.unique(np.concatenate(own))] += 1
        counts.append(np.log((count + 0.3) / (len(texts) + 0.6)))
    odds = counts[0] - counts[1]
    value = np.zeros(len(vocabulary))
    for at, f, w in groups:
        value[at] = (odds[f] @ w) / w.sum()
    seen = {w for ws in clean for w in ws}
    candidates = [np.array([place[w] for w in ws if w in place and w not in seen], np.int64) for ws in toxic]
    candidates = [c for c in candidates if len(c)]
    bad = np.array([place[w] for w in seen if w in place], np.int64)
    if not candidates or not len(bad):
        return Machine(np.zeros(size, np.float32), 0.0, 1.0, 0.0)
    machine = None
    for _ in range(rounds):
        witnesses = np.concatenate([c[np.argsort(-value[c])[: 3 if machine is None else 2]] for c in candidates])
        if machine is not None:
            witnesses = witnesses[value[witnesses] > min(0.0, np.quantile(value[witnesses], 0.3))]
        hard = bad[np.argsort(-value[bad])[:3_000]]
        others = np.unique(np.r_[hard, rng.choice(bad, min(6_000, len(bad)), replace=False)])
        unique = np.unique(witnesses)
        marks = [vocabulary[i] for i in np.r_[rng.choice(unique, min(landmarks, len(unique)), replace=False), rng.choice(hard, min(landmarks, len(hard)), replace=False)]]
        columns = np.full(size, -1, np.int64)
        used = np.unique(np.concatenate([features[place[m]] for m in marks]))
        columns[used] = np.arange(len(used))
        base = dense(marks, columns, len(used))
        kernel = (base @ base.T).astype(float)
        roots, vectors = np.linalg.eigh(kernel)
        keep = roots > 1e-4
        project = vectors[:, keep] / np.sqrt(roots[keep])
        positive = [vocabulary[i] for i in witnesses]
        positive += [inserted(w, rng) for w in positive]
        rows = [*positive, *(vocabulary[i] for i in others)]
        x = np.vstack([dense(rows[k : k + 256], columns, len(used)) @ base.T @ project.astype(np.float32) for k in range(0, len(rows), 256)])
        y = np.r_[np.ones(len(positive)), -np.ones(len(others))]
        w = fit_svm(x, y, COST)
        table = np.zeros(size, np.float32)
        table[used] = (project @ w[:-1]) @ base
        machine = Machine(table, float(w[-1]), 1.0, 0.0)
        value = machine.margins(vocabulary)
    best = np.array([max((value[place[w]] for w in ws if w in place), default=machine.bias) for ws in (*toxic, *clean)])
    machine.slope, machine.offset = logistic(best, np.r_[np.ones(len(toxic)), -np.ones(len(clean))])
    return machine


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fits the machine on a bounded sample of labelled rows, in an order that doesn't depend on partitions; tasks cut their texts into distinct words. Repeated rows count as often, null texts have no words, other columns are ignored; without labels of both classes every text scores alike."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({x for t in tokens_of(text) for w in words_of(t) for x in windows(w)}) for text in texts])

    rows = labelled_texts(docs, labels, label, sample, id_col, text_col).select(cut("__text").alias("words"), "__label").orderBy("__label", F.xxhash64("words"), "words").toPandas()
    own = {c: [list(ws) for ws in rows["words"][rows["__label"] == c]] for c in (0, 1)}
    return fit(own[1], own[0])


def score_column(machine: Machine, text_col: str = "text") -> Column:
    """The score, 0 to 1, of every whole text, of its words only: equal texts score alike, null and empty texts get that of a text without words, an empty table gives an empty one."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(machine.score(texts.tolist()))

    return score(F.col(text_col))
