"""Token ids of whole texts with the tokenizers library, at the speed of array look-ups.

Both vocabularies cut a text into words, numbers and signs before any merge is looked at, so the ids of a text are the
ids of its segments in a row. A group of texts is cut at borders that hold for either vocabulary whatever stands
beyond them, all at once; the library encodes each different segment, and a worker remembers those of its last texts,
MEMORY at most twice over. Tests hold the result against the library on whole texts.
"""

from __future__ import annotations

import os
import re

import numpy as np
import xxhash

#: Segments that a worker remembers before the older half may go, and ids of these for each.
MEMORY, IDS_EACH = 200_000, 8
#: Bytes of text that are cut at a time. A longer text is cut where a word of ASCII letters follows another.
GROUP = 1 << 20
_BORDER = re.compile(rb"[A-Za-z](?= [A-Za-z])")
#: Bytes of a segment that are compared as they are; of longer ones 128 bits of hash are.
LANES = 3

# Kinds of bytes: 1 ASCII letters, 2 digits, 3 other signs, 0 those at which nothing is cut by kind.
_KIND = np.full(256, 3, np.int8)
_KIND[:33] = 0
_KIND[39] = 0  # an apostrophe may begin an ending
_KIND[128:] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32, 255]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space beyond ASCII, controls that some take for white space, special tokens and what is not UTF-8.
_RARE = (b"<|", b"\xff", b"\x1c", b"\x1d", b"\x1e", b"\x1f")
_LEADS = (b"\xc2", b"\xe1", b"\xe2", b"\xe3", b"\xef")
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8d\xa8\xa9\xaf]|\x81[\x9f\xa0])|\xe3\x80\x80|\xef\xbb\xbf")
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _hash(keys: np.ndarray) -> np.ndarray:
    h = keys[0] * np.uint64(0x9E3779B97F4A7C15)
    for more in keys[1:]:
        h ^= h >> np.uint64(32)
        h = (h + more) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class _Known:
    """Segments and their ids: a sorted index of hashes over rows that are only added to."""

    def __init__(self):
        self.hashes, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.keys = np.zeros((LANES + 1, 1024), np.uint64)
        self.begin, self.ids = np.zeros(1025, np.int64), np.zeros(8192, np.uint32)
        self.n = 0

    def find(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rows of different segments in order of their hashes; -1 for those not known."""
        if not self.n:
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.n - 1)
        row = self.row[at]
        return np.where((self.hashes[at] == hashes) & (self.keys[:, row] == keys).all(0), row, -1)

    def add(self, hashes: np.ndarray, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Rows of new segments, in order of their hashes."""
        rows = self.n + np.arange(len(hashes))
        used = self.begin[self.n]
        while self.keys.shape[1] < self.n + len(rows):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], axis=1)
            self.begin = np.concatenate([self.begin, np.zeros(len(self.begin) - 1, np.int64)])
        while len(self.ids) < used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.keys[:, rows] = keys
        self.begin[rows + 1] = used + np.cumsum(counts)
        self.ids[used : used + len(ids)] = ids
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.row = np.insert(self.hashes, at, hashes), np.insert(self.row, at, rows)
        self.n += len(rows)
        return rows

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each row, and all ids in a row."""
        begin = self.begin[rows]
        counts = self.begin[rows + 1] - begin
        ends = np.cumsum(counts)
        return counts, self.ids[np.repeat(begin - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """``spaced``: white space is part of the ids (byte-level vocabulary); otherwise it only separates."""

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.spaced = spaced
        self.library = Tokenizer.from_file(path)
        if spaced:  # a line end between two segments is one id of its own
            (self.line_end,) = self.library.encode("\n", add_special_tokens=False).ids
        else:  # ids that end a word
            self.edge = np.zeros(self.library.get_vocab_size(), bool)
            self.edge[[i for k, i in self.library.get_vocab().items() if k.endswith("</w>")]] = True
        self.known, self.older = _Known(), _Known()

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        """The library's own ids of each text."""
        every = self.library.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in every]

    def _together(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and the ids of keys from few long texts, on which the library is faster.

        Keys hold no white space but a first space.
        """
        groups = [keys[i : i + 100] for i in range(0, len(keys), 100)]
        end = b"\n" if self.spaced else b""
        ids = np.concatenate([np.zeros(0, np.uint32), *self.whole([(end or b" ").join(g) + end for g in groups])])
        last = np.flatnonzero(ids == self.line_end if self.spaced else self.edge[ids])
        counts = np.diff(last, prepend=-1)
        if len(last) != len(keys):
            own = self.whole(keys)
            return np.array([len(x) for x in own], np.int64), np.concatenate(own)
        return (counts - 1, np.delete(ids, last)) if self.spaced else (counts, ids)

    def _learn(self, words: list[bytes], simple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and the ids of new segments."""
        easy, rest = np.flatnonzero(simple), np.flatnonzero(~simple)
        counts, ids = self._together([words[k] for k in easy.tolist()])
        others = self.whole([words[k] for k in rest.tolist()])
        every = np.empty(len(words), np.int64)
        every[easy], every[rest] = counts, [len(x) for x in others]
        owner = np.concatenate([np.repeat(easy, counts), np.repeat(rest, every[rest])])
        return every, np.concatenate([ids, *others])[np.argsort(owner, kind="stable")]

    def _cut(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end bytes of the segments of texts that are set apart by a byte of 255."""
        kind = _KIND[raw]
        apart = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        border = np.ones(len(raw) + 1, bool)
        if self.spaced:
            space = _SPACE[raw]
            border[1:-1] = apart
            border[1:-1] |= (raw[1:] == 10) & ~space[:-1]
            border[:-2] |= (raw[:-1] == 32) & ~space[1:]
            gap = raw == 255
        else:
            gap = (raw == 32) | (raw == 10) | (raw == 255)
            border[1:-1] = apart
        border[:-1] |= gap
        border[1:] |= gap
        at = np.flatnonzero(border)
        starts, ends = at[:-1], at[1:]
        keep = ~gap[starts]
        return starts[keep], ends[keep]

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts of a group's size, none of which is rare."""
        joined = b"\xff".join(texts) + b"\xff" + bytes(8 * LANES)
        if not self.spaced:
            joined = joined.lower()  # of ASCII letters; the vocabulary knows no others
        raw = np.frombuffer(joined, np.uint8)
        starts, ends = self._cut(raw[: len(raw) - 8 * LANES])
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        first = np.searchsorted(starts, np.cumsum(lengths) - lengths)
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(texts)
        size = ends - starts
        # eight bytes from any place on
        lanes = np.ndarray((len(raw) - 7,), "<u8", joined, strides=(1,))
        keys = np.empty((LANES + 1, len(starts)), np.uint64)
        for k in range(LANES):
            keys[k] = lanes[np.minimum(starts + 8 * k, len(lanes) - 1)] & _MASKS[np.clip(size - 8 * k, 0, 8)]
        for i in np.flatnonzero(size > 8 * LANES).tolist():
            x = xxhash.xxh3_128_intdigest(joined[starts[i] : ends[i]])
            keys[1, i], keys[2, i] = x >> 64, x & (1 << 64) - 1
        keys[LANES] = size
        h = _hash(keys)
        order = np.argsort(h)
        h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        one = order[new]
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        if (keys != keys[:, one][:, which]).any():  # two segments of one hash: they go the long way
            return self.whole(texts)
        rows = self._rows(h[new], keys[:, one], joined, starts[one], ends[one])
        counts, ids = self.known.gather(rows[which])
        total = np.concatenate([[0], np.cumsum(counts)])
        return np.split(ids, total[first[1:]])

    def _rows(self, h, keys, joined, starts, ends) -> np.ndarray:
        """Rows of different segments, learned where they are not known."""
        if self.known.n > MEMORY or self.known.begin[self.known.n] > MEMORY * IDS_EACH:
            self.older, self.known = self.known, _Known()
        rows = self.known.find(h, keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            old = self.older.find(h[new], keys[:, new])
            back = old >= 0
            if back.any():
                at = new[back]
                rows[at] = self.known.add(h[at], keys[:, at], *self.older.gather(old[back]))
                new = new[~back]
        if len(new):
            words = [joined[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            if self.spaced:
                simple = [len(x) == 1 and len(x[0]) == len(w) - (w[0] == 32) for w, x in ((w, w.split()) for w in words)]
            else:
                simple = [x.isalpha() and (x.isascii() or max(x) <= "\xff") for x in (w.decode("utf-8", "replace") for w in words)]
            rows[new] = self.known.add(h[new], keys[:, new], *self._learn(words, np.array(simple, bool)))
        return rows

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text in little-endian unsigned 32-bit integers; null is the empty text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        group: list[tuple[int, bytes]] = []
        held = 0

        def close():
            nonlocal held
            for (k, _), ids in zip(group, self._group([t for _, t in group])):
                out[k].append(ids)
            group.clear()
            held = 0

        for k, text in enumerate(texts):
            for part in _parts(text):
                if any(x in part for x in _RARE) or any(x in part for x in _LEADS) and _WIDE.search(part):
                    close() if group and group[-1][0] == k else None
                    out[k] += self.whole([part])
                    continue
                group.append((k, part))
                held += len(part)
                if held >= GROUP:
                    close()
        if group:
            close()
        return [(x[0] if len(x) == 1 else np.concatenate(x)).astype("<u4", copy=False).tobytes() if x else b"" for x in out]


def _parts(text: bytes | None):
    """A text in parts of a group's size; each ends with a letter before a space and a letter."""
    at = 0
    text = text or b""
    while len(text) - at > GROUP:
        found = _BORDER.search(text, at + GROUP)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    if at < len(text):
        yield text[at:]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder for each worker process."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]
