"""Token ids in files of Simple-8b words.

A segment is one value: a header, the documents' ids and lengths, an offset for each block of BLOCK ids, then 64-bit
words. The top four bits of a word select how many values of how many bits it packs. Selector 0 is the escape: the
next word is one raw value, for those of over 60 bits. Blocks end at word borders, so that any of them can be decoded
on its own, and all of them at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, prefix_sums, table, written
from .tokens import encoder

#: Fixed values of Simple-8b: (values, bits) of selectors 1 to 15.
PACKS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNT = np.array([1] + [n for n, _ in PACKS])
BITS = np.array([64] + [b for _, b in PACKS])
BLOCK = 1024
#: Ids after which a segment is closed, at the end of a document.
SEGMENT = 1 << 19
MAGIC = b"MSW8"
HEAD = "<4sIQQQQ"
END = 2


def _widths(x: np.ndarray) -> np.ndarray:
    """The fewest bits of any selector that hold each value."""
    w = np.zeros(x.shape, np.uint8)
    under = 0
    for bits in sorted({b for _, b in PACKS} - {0}) + [64]:
        w[x >= np.uint64(1 << under)] = bits
        under = bits
    return w


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and, for each block of BLOCK values, the offset of its first word. All blocks are packed side by side."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    pad = int(COUNT.max())
    grid = np.zeros((blocks, BLOCK + pad), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = values
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    width = _widths(grid)
    # most[p][:, i]: the widest of the p values from i on, for powers of two
    most, p = {1: width}, 1
    while p * 2 <= pad:
        m = most[p].copy()
        np.maximum(m[:, :-p], most[p][:, p:], out=m[:, :-p])
        p *= 2
        most[p] = m
    choice = np.zeros((blocks, BLOCK), np.uint8)  # 0: the escape
    for selector in range(15, 0, -1):
        count, bits = PACKS[selector - 1]
        p = 1 << (count.bit_length() - 1)
        widest = np.maximum(most[p][:, :BLOCK], most[p][:, count - p : count - p + BLOCK])
        choice[widest <= bits] = selector
    at = np.zeros(blocks, np.int64)
    end = np.minimum(BLOCK, n - BLOCK * np.arange(blocks))
    rows, words, order = [], [], []
    live = np.arange(blocks)
    step = 0
    while len(live):
        here = at[live]
        selector = choice[live, here]
        word = np.zeros(len(live), np.uint64)
        for s in map(int, np.unique(selector)):
            own = np.flatnonzero(selector == s)
            if s == 0:
                rows.append(live[own])
                order.append(np.full(len(own), 2 * step))
                words.append(np.zeros(len(own), np.uint64))
                word[own] = grid[live[own], here[own]]
                continue
            count, bits = PACKS[s - 1]
            w = np.full(len(own), s << 60, np.uint64)
            if bits:
                cells = grid[live[own][:, None], here[own][:, None] + np.arange(count)]
                w |= np.bitwise_or.reduce(cells << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
            word[own] = w
        rows.append(live)
        order.append(np.full(len(live), 2 * step + 1))
        words.append(word)
        at[live] += COUNT[selector]
        live = live[at[live] < end[live]]
        step += 1
    rows, order, words = np.concatenate(rows), np.concatenate(order), np.concatenate(words)
    by = np.lexsort((order, rows))
    offsets = np.zeros(blocks + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=blocks), out=offsets[1:])
    return words[by], offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values again, all blocks at once."""
    blocks = len(offsets) - 1
    out = np.zeros(blocks * BLOCK, np.uint64)
    if not n:
        return out[:0]
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, bool)
    if (selector == 0).any() or (words == 0).any():
        # the word after an escape is raw, whatever it looks like; runs of zero words alternate
        for i in np.flatnonzero(selector == 0):
            if not raw[i]:
                raw[i + 1] = True
    raw = raw[:-1]
    count = np.where(raw, 1, np.where(selector == 0, 0, COUNT[selector]))
    block = np.repeat(np.arange(blocks), np.diff(offsets))
    ends = np.cumsum(count)
    starts = ends - count
    starts -= np.concatenate([[0], ends])[offsets[:-1]][block]
    room = np.where(np.arange(blocks) == blocks - 1, n - BLOCK * (blocks - 1), BLOCK)[block]
    out[(block * BLOCK + starts)[raw]] = words[raw]
    for s in range(2, 16):  # selector 1 is all zeros
        own = np.flatnonzero((selector == s) & ~raw)
        if not len(own):
            continue
        many, bits = PACKS[s - 1]
        place = starts[own][:, None] + np.arange(many)
        cells = (words[own][:, None] >> (np.arange(many, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
        fits = place < room[own][:, None]
        out[(block[own][:, None] * BLOCK + place)[fits]] = cells[fits]
    return out[:n]


def segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One segment. ids: each document's token ids, little-endian unsigned 32 bits."""
    values = np.frombuffer(b"".join(ids), "<u4")
    words, offsets = encode(values)
    null = np.packbits(np.array([d is None for d in doc_ids], bool))
    head = struct.pack(HEAD, MAGIC, BLOCK, len(doc_ids), len(values), len(offsets) - 1, len(words))
    lengths = np.array([len(x) // 4 for x in ids], "<u8")
    return b"".join((head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), lengths.tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()))


def parse(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Of a segment: document ids, lengths, and all token ids in a row."""
    magic, block, n_docs, n, blocks, n_words = struct.unpack_from(HEAD, data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a segment of this format")
    at = struct.calcsize(HEAD)

    def take(kind, k):
        nonlocal at
        out = np.frombuffer(data, kind, k, at)
        at += out.nbytes
        return out

    ids = take("<i8", n_docs)
    null = np.unpackbits(take("u1", -(-n_docs // 8)))[:n_docs]
    lengths = take("<u8", n_docs).astype(np.int64)
    offsets = take("<u8", blocks + 1).astype(np.int64)
    words = take("<u8", n_words)
    return [None if z else int(i) for i, z in zip(ids, null)], lengths, decode(words, offsets, n).astype("<u4")


def write_tokens(docs: DataFrame, tokenizer: str, spaced: bool = False) -> DataFrame:
    """Files of all documents' ids, in ascending doc_id order (null first; equal ids by text, then in any order).

    Returns the table of segments: part and place of each in the order, the first of its ids within the part, the
    number of its ids and the bytes. Equal doc_ids, however many, are spread over parts by text and partition. A null
    or empty text is its end id alone; an empty table gives no segment. Other columns are not read.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_ms_text"), F.spark_partition_id().alias("_ms_from"))
    order = ["doc_id", "_ms_text", "_ms_from"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode_part(batches):
        from pyspark import TaskContext

        part, start, seq = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer, spaced)
        ids: list[bytes] = []
        own: list[int | None] = []
        held = 0
        names = ["part", "seq", "start", "n_ids", "data"]

        def close():
            nonlocal ids, own, held, seq, start
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.array([segment(own, ids)], pa.binary())]
            start, seq, ids, own, held = start + held, seq + 1, [], [], 0
            return pa.RecordBatch.from_arrays(row, names)

        end = struct.pack("<I", END)
        for batch in in_pieces(batches, 1024):
            doc, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for at in range(0, len(doc), 256):
                for d, x in zip(doc[at : at + 256], enc.encode(texts.slice(at, 256).to_pylist())):
                    own.append(d)
                    ids.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= SEGMENT:
                        yield close()
        if own:
            yield close()

    return written(dealt.mapInArrow(encode_part, "part int, seq int, start long, n_ids long, data binary"), "tokens")


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row a document from the files: doc_id, start, n_tokens and ids_crc32, and the ids themselves if asked for."""
    parts = prefix_sums(files.groupBy("part").agg(F.sum("n_ids").alias("n")), "part", "n", "_ms_before")
    parts = F.broadcast(parts)  # a row of two numbers for each partition that wrote
    placed = files.join(parts, "part").select((F.col("_ms_before") + F.col("start")).alias("start"), "data")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def parse_all(batches):
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc, lengths, ids = parse(data.as_buffer())
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
                cols = [pa.array(doc, pa.int64()), pa.array(begins + start), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[a:b] for a, b in zip(begins, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return placed.mapInArrow(parse_all, schema)


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents' ids with the word vocabulary, written in Simple-8b segments and read back: a row a document.

    A null or empty text is its end id; repeated rows each have their place; other columns are not read.
    """
    import public_tokenizers

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
