"""Hashed word n-grams of whole texts, and logistic models of them fitted by follow-the-regularised-leader.

Features are indicators: words and punctuation runs, pairs of them that follow each other, shapes of three in a row,
tenths of a few shares (upper-case words, punctuation, repeated neighbours), first bytes of words, and whether a text
has a feature more than once. A batch of texts is cut and hashed with array operations only; a score is the sum of the
weights of a text's features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .decontaminate import word_hashes

#: Hashed features; the next place is the intercept, and those after it are for values handed from model to model.
BITS = 18
SIZE = 1 << BITS
EXTRA = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# 0: white space and control, 1: letters, digits and non-ASCII, 2: other signs
_KIND = np.full(256, 2, np.int8)
_KIND[:33] = 0
_KIND[127] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def features(texts: list[bytes | None], pairs: bool = True, shapes: bool = True, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every occurrence in the texts; repeats included. prefixes: bytes at the start of longer words."""
    raw = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    kind = _KIND[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], kind, [0]]).astype(np.int8)) != 0)
    starts = edge[:-1][kind[edge[:-1]] != 0] if len(edge) else edge
    ends = edge[1:][kind[edge[:-1]] != 0] if len(edge) else edge
    lengths = np.array([len(t or b"") + 1 for t in texts], np.int64)
    text = np.searchsorted(np.cumsum(lengths), starts, "right")
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = word_hashes(_LOWER[raw], starts, ends, prefixes)
    owners, found = [text], [_mix(h[0] if prefixes else h)]
    for size, own in zip(prefixes, h[1:] if prefixes else ()):
        longer = (ends - starts >= size) & (kind[starts] == 1)
        owners.append(text[longer])
        found.append(_mix(own[longer] + np.uint64(size << 40)))
    h = h[0] if prefixes else h
    same = text[1:] == text[:-1]
    if pairs:
        owners.append(text[1:][same])
        found.append(_mix(h[1:] * np.uint64(3) + h[:-1])[same])
    if shapes:
        upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
        size = ends - starts
        caps = upper[ends] - upper[starts]
        word = kind[starts] == 1
        shout = word & (caps * 2 > size) & (size > 1)
        shape = (np.where(word, np.where(shout, 3, np.where(caps > 0, 2, 1)), 0) * 4 + np.minimum(size // 3, 3)).astype(np.uint64)
        three = same[1:] & same[:-1]
        owners.append(text[2:][three])
        found.append(_mix((shape[2:] * np.uint64(31) + shape[1:-1]) * np.uint64(31) + shape[:-2] + np.uint64(1 << 40))[three])
        n = np.bincount(text, minlength=len(texts))
        words = np.bincount(text, word, len(texts))
        again = np.bincount(text[1:], same & (h[1:] == h[:-1]), len(texts))
        for k, share in enumerate((np.bincount(text, shout, len(texts)) / np.maximum(words, 1), 1 - words / np.maximum(n, 1), again / np.maximum(n, 1))):
            owners.append(np.arange(len(texts)))
            found.append(_mix(np.uint64(k + 1) * np.uint64(1 << 33) + np.minimum(share * 10, 9).astype(np.uint64)))
    return np.concatenate(owners), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def indicators(texts: list[bytes | None], twice: bool = False, **kinds) -> np.ndarray:
    """text * SIZE + feature of the different features of each text, ascending; ``twice`` adds one of its own for each
    feature that a text has more than once."""
    owner, f = features(texts, **kinds)
    if not twice:
        return np.unique(owner * SIZE + f)
    key, n = np.unique(owner * SIZE + f, return_counts=True)
    again = key[n > 1]
    more = (_mix((again % SIZE).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.unique(np.concatenate([key, again // SIZE * SIZE + more]))


def lists(texts: list[bytes | None], **kinds) -> list[np.ndarray]:
    """The different features of each text, ascending."""
    key = indicators(texts, **kinds)
    cut = np.searchsorted(key, np.arange(1, len(texts)) * SIZE)
    return [x % SIZE for x in np.split(key, cut)] if len(texts) else []


def follow_the_leader(rows: list[np.ndarray], labels: np.ndarray, extra: np.ndarray | None = None, *, epochs: int = 4, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.3, l2: float = 1.0, seed: int = 0) -> np.ndarray:
    """Weights of a logistic model by FTRL-Proximal: hashed features, the intercept, then ``extra`` values of each row."""
    z, n = np.zeros(SIZE + 1 + EXTRA), np.zeros(SIZE + 1 + EXTRA)
    rng = np.random.default_rng(seed)
    k = 0 if extra is None else extra.shape[1]
    tail = SIZE + np.arange(1 + k)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = np.concatenate([rows[i], tail])
            x = np.ones(len(at))
            if k:
                x[-k:] = extra[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[i]) * x
            squared = ni + g * g
            z[at] = zi + g - (np.sqrt(squared) - np.sqrt(ni)) / alpha * w
            n[at] = squared
    return weights(z, n)


def scores(texts: list[bytes | None], weights: np.ndarray, extra: np.ndarray | None = None, **kinds) -> np.ndarray:
    """Probability of label 1 for each text: sparse dot products with whole texts' features."""
    return squash(sums(texts, [weights], **kinds)[0] + tail(weights, extra))


def tail(weights: np.ndarray, extra: np.ndarray | None) -> np.ndarray | float:
    own = weights[SIZE]
    return own if extra is None else own + extra @ weights[SIZE + 1 : SIZE + 1 + extra.shape[1]]


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def sums(texts: list[bytes | None], models: list[np.ndarray], **kinds) -> list[np.ndarray]:
    """Of each model the sum of its weights over the features of each text."""
    key = indicators(texts, **kinds)
    some = np.zeros(SIZE, bool)
    for w in models:
        some |= w[:SIZE] != 0
    key = key[some[key % SIZE]]
    owner, f = key // SIZE, key % SIZE
    return [np.bincount(owner, w[f], len(texts)) for w in models]


def in_slices(texts, rows: int = 512, size: int = 1 << 20):
    """(place, texts in bytes) of an Arrow text column, some rows of some size at a time; a longer text goes alone."""
    texts = texts.cast(pa.binary())
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = held = 0
    for k, n in enumerate(lengths.tolist()):
        if k > at and (held + n > size or k - at == rows):
            yield at, texts.slice(at, k - at).to_pylist()
            at, held = k, 0
        held += n
    if at < len(texts):
        yield at, texts.slice(at).to_pylist()
