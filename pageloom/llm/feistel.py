"""A keyed permutation of 0..n-1: a Feistel network over the next even number of bits, walked until the value is below n."""

from __future__ import annotations

import hashlib

import numpy as np

ROUNDS = 6


def round_keys(key: str) -> np.ndarray:
    return np.frombuffer(hashlib.sha256(key.encode()).digest() + hashlib.sha256(b"2" + key.encode()).digest(), np.uint64)[:ROUNDS]


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permute(values: np.ndarray, n: int, key: str, inverse: bool = False) -> np.ndarray:
    """Places of values, each below n, under the permutation of 0..n-1 that key names."""
    if n <= 1:
        return np.zeros(len(values), np.int64)
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask, keys = (np.uint64(1) << half) - np.uint64(1), round_keys(key)
    out = np.asarray(values).astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)
