"""Verbatim benchmark passages in documents, found with suffix arrays of the training text.

Every shard of training text gets a suffix array over the words that any benchmark item uses, and every suffix of every
item is looked up in it by binary search; suffixes that begin with the same words meet the same run of the array and are
looked up once. Finds that follow each other in both texts make up the longest verbatim matches, with their places. The
benchmark goes to the executors in blocks of bounded size, of which a task holds one at a time, so that it may be of
any size; the documents are read once and are not shuffled. A text longer than a shard is cut into pieces that overlap
by one word less than a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_pieces, table

#: Bytes of benchmark text in a block, and of document text in a shard.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 1 << 20
#: Suffixes that are looked up at a time.
LOOKUPS = 1 << 15

# Word bytes after lower-casing: digits, a-z, and all of non-ASCII characters.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True

#: Bytes of text that are hashed at a time, and of a word that is hashed on its own.
_SLICE, _LONG = 1 << 18, 1 << 12
_P = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts in a row, starts and ends of their words, and each text's first word (one more)."""
    joined = _LOWER[np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)]
    inside = np.zeros(len(joined) + 2, bool)
    inside[1:-1] = _WORD[joined]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    lengths = np.array([len(t or b"") + 1 for t in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    return joined, starts, ends, np.append(np.searchsorted(starts, begins), len(starts))


def word_hashes(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """A polynomial hash of each word, from running sums over slices of bounded size; equal words have equal hashes.

    With ``prefixes`` there are further rows: hashes of each word's first so many bytes, or of all of a shorter one.
    """
    if not _POWERS:
        for p in (_P, pow(_P, -1, 1 << 64)):
            steps = np.full(_SLICE + _LONG + 1, p, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps))
    out = np.empty((1 + len(prefixes), len(starts)), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = int(np.searchsorted(starts, base + _SLICE))
        part = joined[base : min(ends[to - 1], base + _SLICE + _LONG)].astype(np.uint64)
        part += np.uint64(1)
        part *= _POWERS[0][: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        a, b = starts[at:to] - base, np.minimum(ends[at:to] - base, len(part))
        out[0, at:to] = (sums[b] - sums[a]) * _POWERS[1][a]
        for k, size in enumerate(prefixes, 1):
            out[k, at:to] = (sums[np.minimum(a + size, b)] - sums[a]) * _POWERS[1][a]
        at = to
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    for i in np.flatnonzero(ends - starts > _LONG):
        out[0, i] = xxhash.xxh3_64_intdigest(joined[starts[i] : ends[i]].tobytes())
    return out if prefixes else out[0]


class Items:
    """A block of the benchmark: its words as numbers, and its suffixes, those of equal first words together."""

    def __init__(self, rows: list[tuple], window: int):
        joined, starts, ends, first = words_of([r[1] for r in rows])
        self.item = [r[0] for r in rows]
        self.first = first
        data = joined.tobytes()
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        distinct = list(known)
        where = np.zeros(len(distinct), np.int64)
        where[ids[::-1]] = np.arange(len(ids))[::-1]
        hashes = word_hashes(joined, starts, ends)[where]
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]  # equal ones, of words that differ, are told apart by `twin`
        self.twin = bool((self.hashes[1:] == self.hashes[:-1]).any())
        self.words = [distinct[i] for i in order.tolist()]
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(1, len(order) + 1)
        self.ids = np.concatenate([number[ids], np.zeros(window, np.int32)]) if len(ids) else np.zeros(window, np.int32)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        size = np.minimum(window, np.diff(first))
        many = np.where(size > 0, np.diff(first) - size + 1, 0)
        owner = np.repeat(np.arange(len(rows)), many)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[:-1][owner]
        heads = self.ids[place[:, None] + np.arange(window)]
        heads[np.arange(window) >= size[owner][:, None]] = 0
        _, at, group = np.unique(heads, axis=0, return_index=True, return_inverse=True)
        by = np.argsort(group.reshape(-1), kind="stable")
        self.suffix, self.owner = place[by], owner[by]  # suffixes that begin alike are neighbours
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(group.reshape(-1), minlength=len(at)))])
        self.start, self.size = place[at], size[owner][at]
        self.least = int(self.size.min()) if len(at) else 0


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ids in order of their first ``depth`` values, by doubling."""
    rank = ids
    n = len(ids)
    k = 1
    while k < depth:
        second = np.zeros(n, np.int64)
        second[: max(n - k, 0)] = rank[k:] + 1
        order = np.lexsort((second, rank))
        new = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank = np.zeros(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(new)])
        k *= 2
    return np.argsort(rank, kind="stable")


def search(ids: np.ndarray, order: np.ndarray, queries: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run of the suffix array whose suffixes begin with each query, by binary search of all queries at once."""
    n, width = len(ids), queries.shape[1]
    padded = np.concatenate([ids, np.full(width, -1, ids.dtype)])
    inside = np.arange(width) < size[:, None]

    def bound(strict: bool) -> np.ndarray:
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), n, np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            text = padded[order[np.minimum(mid, n - 1)][:, None] + np.arange(width)]
            unlike = (text != queries) & inside
            at = np.argmax(unlike, axis=1)
            rows = np.arange(len(queries))
            differs = unlike[rows, at]
            less = np.where(differs, text[rows, at] < queries[rows, at], strict)
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    return bound(False), bound(True)


def _numbers(items: Items, joined, starts, ends, hashes) -> tuple[np.ndarray, np.ndarray]:
    """(word, number) of the words that the items use, by hash, and by their bytes where hashes of two items' words meet."""
    maybe = np.flatnonzero(items.bits[(hashes >> np.uint64(44)).astype(np.int64)])
    place = np.searchsorted(items.hashes, hashes[maybe])
    known = items.hashes[np.minimum(place, len(items.hashes) - 1)] == hashes[maybe]
    maybe, place = maybe[known], place[known]
    if items.twin:
        keep = np.ones(len(maybe), bool)
        for k, w in enumerate(maybe.tolist()):
            own = joined[starts[w] : ends[w]].tobytes()
            same = [p for p in range(place[k], int(np.searchsorted(items.hashes, hashes[w], "right"))) if items.words[p] == own]
            keep[k] = bool(same)
            place[k] = same[0] if same else 0
        maybe, place = maybe[keep], place[keep]
    return maybe, place + 1


def find(shard, items: Items, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, suffix) of every place of the shard where a suffix of ``items`` begins, numbered as in items.suffix."""
    joined, starts, ends, first, hashes = shard
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(items.size) or not len(starts):
        return none
    maybe, ids = _numbers(items, joined, starts, ends, hashes)
    while True:
        word, which, used = _occurrences(maybe, ids, first, items, window)
        # equal hashes do not make equal words: one that was taken for another is forgotten, and all is looked up again
        like = np.fromiter((joined[starts[maybe[k]] : ends[maybe[k]]].tobytes() == items.words[ids[k] - 1] for k in used.tolist()), bool, len(used))
        if like.all():
            break
        maybe, ids = np.delete(maybe, used[~like]), np.delete(ids, used[~like])
    many = items.begins[which + 1] - items.begins[which]
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(word, many), np.repeat(items.begins[which], many) + inside


def _occurrences(maybe, ids, first, items: Items, window: int):
    """(word, run of equal suffixes) of every find, and the places in ``maybe`` of the words in these."""
    none = np.zeros(0, np.int64)
    # runs of known words within one text; those shorter than any window cannot match
    text = np.searchsorted(first, maybe, "right")
    cut = np.ones(len(maybe), bool)
    cut[1:] = (np.diff(maybe) != 1) | (np.diff(text) != 0)
    run = np.cumsum(cut) - 1
    keep = np.flatnonzero(np.bincount(run)[run] >= items.least) if len(run) else none
    if not len(keep):
        return none, none, none
    run = run[keep]
    gap = np.cumsum(np.concatenate([[0], np.diff(run) != 0]))
    train = np.zeros(len(keep) + gap[-1] + 1, np.int64)  # 0 between runs
    origin = np.full(len(train), -1)
    train[np.arange(len(keep)) + gap] = ids[keep]
    origin[np.arange(len(keep)) + gap] = keep
    order = suffix_array(train, window)
    # a suffix whose first, second or last word is nowhere in the shard need not be looked up
    here = np.zeros(len(items.words) + 1, bool)
    here[ids[keep]] = True
    ahead = [items.ids[items.start + np.minimum(k, items.size - 1)] for k in (0, 1, window - 1)]
    asked = np.flatnonzero(here[ahead[0]] & here[ahead[1]] & here[ahead[2]])
    words, which = [none], [none]
    for at in range(0, len(asked), LOOKUPS):
        some = asked[at : at + LOOKUPS]
        lo, hi = search(train, order, items.ids[items.start[some][:, None] + np.arange(window)].astype(np.int64), items.size[some])
        many = hi - lo
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        words.append(origin[order[np.repeat(lo, many) + inside]])
        which.append(np.repeat(some, many))
    word, which = np.concatenate(words), np.concatenate(which)
    used = np.zeros(len(maybe) + 1, np.int64)
    np.add.at(used, word, 1)
    np.add.at(used, word + items.size[which], -1)
    return maybe[word], which, np.flatnonzero(np.cumsum(used[:-1]) > 0)


def matches(item, at, word, size) -> tuple[np.ndarray, ...]:
    """Longest matches from finds: those that follow each other in both texts are one.

    All are arrays: the item, the place in the item, the place in the text, the words of the find. Returns the same of
    the matches.
    """
    order = np.lexsort((word, word - at, item))
    item, at, word, size = item[order], at[order], word[order], size[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (np.diff(word - at) != 0) | (np.diff(word) > 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(item))[: len(head)] - 1
    return item[head], at[head], word[head], word[last] - word[head] + size[last]


def _pieces(text: bytes, window: int, limit: int):
    """(piece, words of it that the one before has too) of a text; a piece is cut where no word is."""
    start = 0
    again = 0
    while True:
        size = limit
        while True:
            end = min(start + size, len(text))
            while end < len(text) and _WORD[_LOWER[text[end]]]:
                end += 1
            piece = text[start:end]
            if end == len(text):
                yield piece, again
                return
            begins = words_of([piece])[1]
            if len(begins) >= 2 * window:  # else the next piece would begin where this one does
                break
            size *= 2
        yield piece, again
        again = window - 1
        start += int(begins[len(begins) - again]) if again else len(piece)


def _blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """Broadcast values of the benchmark, a block at a time; the driver holds one block."""
    sc = benchmark.sparkSession.sparkContext
    rows, size = [], 0
    out = []

    def send():
        sent = sc.broadcast(Items(rows, window))
        sent._value = None  # the driver does not need it again
        out.append(sent)

    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).where("text is not null").toLocalIterator():
        rows.append((r[0], bytes(r[1])))
        size += len(r[1])
        if size >= block_bytes:
            send()
            rows, size = [], 0
    if rows:
        send()
    return out


SPAN = "array<struct<item_id:long,item_word:int,doc_word:int,n_words:int>>"
_KIND = pa.struct([("item_id", pa.int64()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])


def _judge(texts: list[bytes | None], blocks, window: int):
    """Of each text: words, and arrays (text, item, place in the item, place in the text, words) of the longest matches.

    ``texts`` are of a shard's size together, or one longer text.
    """
    if len(texts) == 1 and texts[0] and len(texts[0]) > SHARD_BYTES:
        shards = [([p], again) for p, again in _pieces(texts[0], window, SHARD_BYTES)]
    else:
        shards = [(texts, 0)]
    n_words = np.zeros(len(texts), np.int64)
    found = []
    names: list = []  # of item numbers, which go on from block to block
    for sent in blocks:
        items = sent.value
        seen = 0
        for some, again in shards:
            joined, starts, ends, first = words_of(some)
            seen -= again
            word, suffix = find((joined, starts, ends, first, word_hashes(joined, starts, ends)), items, window)
            owner = items.owner[suffix]
            text = np.searchsorted(first, word, "right") - 1
            size = np.minimum(window, items.first[owner + 1] - items.first[owner])
            found.append((text, owner + len(names), items.suffix[suffix] - items.first[owner], word - first[text] + seen, size))
            n_words = np.diff(first) if len(shards) == 1 else np.array([seen + len(starts)])
            seen += len(starts)
        names += items.item
        if len(blocks) > 1:
            vars(sent).pop("_value", None)  # read again from the worker's disk for the next shard
    if not blocks:
        n_words = np.diff(words_of(texts)[3])
    text, item, at, word, size = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
    if len(shards) > 1 and len(text):  # short items may lie in what two pieces share
        text, item, at, word, size = np.unique(np.stack([text, item, at, word, size]), axis=1)
    base = np.cumsum(n_words + 1) - n_words - 1  # a place between texts, so that no match runs on into the next one
    item, at, word, size = matches(item, at, word + base[text], size)
    text = np.searchsorted(base, word, "right") - 1
    return n_words, names, (text, item, at, word - base[text], size)


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10, *, keep: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What each document shares with the benchmark, a row a document.

    doc_id, n_words, n_hit (words inside an occurrence of a window), items (ids of items with a window that occurs,
    sorted as strings, without null), contaminated, longest (words of the longest verbatim match, 0 without one) and
    spans: the longest verbatim matches in order of the text, each with its item, its place in the item and in the
    document, and its words. With ``keep`` the row has instead all columns of docs and the column ``keep``, the length
    of the longest match. A window is ``window`` words of an item in a row, or a shorter item as a whole.

    Null, empty and wordless texts have no words and no match; so have items, and an empty benchmark finds nothing.
    Equal documents are each judged, equal items all count. Texts of any length are read whole, in pieces.
    """
    blocks = _blocks(benchmark, window, block_bytes)
    text_at = docs.columns.index("text") if keep else 1

    def rows_of(batch, texts):
        n = len(texts)
        n_words, names, (text, item, at, word, size) = _judge(texts, blocks, window)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, text, size)
        if keep:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(longest)], [*batch.schema.names, keep])
        base = np.cumsum(n_words) - n_words
        hit = np.zeros(n_words.sum() + 1, np.int64)
        np.add.at(hit, base[text] + word, 1)
        np.add.at(hit, base[text] + word + size, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
        n_hit = covered[base + n_words] - covered[base]
        own: list[list] = [[] for _ in range(n)]
        found: list[set] = [set() for _ in range(n)]
        for t, i, a, w, s in zip(*(x.tolist() for x in (text, item, at, word, size))):
            own[t].append((names[i], a, w, s))
            found[t].add(names[i])
        order = lambda x: (x[2], x[0] is None, str(x[0]), x[1])
        spans = [[dict(zip(("item_id", "item_word", "doc_word", "n_words"), x)) for x in sorted(some, key=order)] for some in own]
        items = [sorted(x - {None}, key=str) for x in found]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.list_(_KIND))
        columns = [pa.array(x, k) for x, k in zip((n_words, n_hit, items, n_hit > 0, longest, spans), kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_hit", "items", "contaminated", "longest", "spans"])

    def run(batches):
        for batch in in_pieces(batches, 4096):
            texts = batch.column(text_at).cast(pa.binary())
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            a = total = 0
            for b, s in enumerate([*size.tolist(), SHARD_BYTES + 1]):
                if b > a and total + s > SHARD_BYTES:  # a longer text is a shard of its own
                    yield rows_of(batch.slice(a, b - a), texts.slice(a, b - a).to_pylist())
                    a, total = b, 0
                total += s

    if keep:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return docs.mapInArrow(run, f"{fields}, `{keep}` long")
    schema = f"doc_id long, n_words long, n_hit long, items array<long>, contaminated boolean, longest long, spans {SPAN}"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, **how) -> DataFrame:
    """Documents without a verbatim match of a window of the benchmark or of a whole shorter item.

    Columns stay as they are, whatever their names; null and empty texts stay, repeated rows are each judged, an empty
    benchmark removes nothing.
    """
    longest = free_name(docs, "longest")
    return find_passages(docs, benchmark, window, keep=longest, **how).where(F.col(longest) == 0).drop(longest)


def op4_benchmark_passages(spark, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark, by windows of ten words: the digest columns, then the longest match and all of them.

    Null and empty texts have no words; every row gives one, repeated ones too; other columns are not read.
    """
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.transform("items", lambda x: x.cast("string")), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        "contaminated", "longest", "spans",
    )
