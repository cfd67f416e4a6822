"""Importance resampling of documents towards a target corpus, over hashed runs of one to three words.

Two passes of Arrow batches. The first counts buckets, a vector of fixed length for each partition, and adds these up in
a tree. The second gathers the gain of each run's bucket from a broadcast vector and sums it up by document. The draw
adds seeded Gumbel noise and takes the highest scores.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_pieces, plain, prefix_sums, table
from .linear import in_slices

BUCKETS = 10_000
#: Longest run of words.
RUN = 3
#: Longest words that are extended by table; the CRC of a longer one is shifted bit by bit of its length.
SHORT = 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True  # after lower-casing


def _table() -> np.ndarray:
    """The CRC's step for each byte value, from the polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _table()


def _step(crc: np.ndarray, byte) -> np.ndarray:
    """Checksums one byte on; before and after the final inversion this is the same linear step."""
    return _TABLE[(crc ^ byte) & np.uint32(255)] ^ (crc >> np.uint32(8))


#: [n, k, b]: what byte k of a checksum, of value b, becomes n zero bytes later.
_SHIFTS = np.empty((SHORT + 1, 4, 256), np.uint32)
_SHIFTS[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
for _n in range(SHORT):
    _SHIFTS[_n + 1] = _step(_SHIFTS[_n], np.uint32(0))


def _doublings() -> list[np.ndarray]:
    """Shift tables of 1, 2, 4, ... zero bytes."""
    out = [_SHIFTS[1]]
    for _ in range(40):
        out.append(_gather(out[-1], out[-1].reshape(-1)).reshape(4, 256))
    return out


def _gather(t: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]


_POWERS = _doublings()


def _joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of two strings after each other, from those of each and the length of the second."""
    n = np.minimum(length, SHORT)
    out = _SHIFTS[n, 0, first & 255] ^ _SHIFTS[n, 1, first >> 8 & 255] ^ _SHIFTS[n, 2, first >> 16 & 255] ^ _SHIFTS[n, 3, first >> 24]
    for i in np.flatnonzero(length > SHORT):
        rest, c = int(length[i]) - SHORT, out[i : i + 1]
        for k in range(rest.bit_length()):
            if rest >> k & 1:
                c = _gather(_POWERS[k], c)
        out[i] = c[0]
    return out ^ second


def _spaced(crc: np.ndarray) -> np.ndarray:
    """Checksums one space on. A finished CRC is inverted, so that it is inverted back around the step."""
    return ~_step(~crc, np.uint32(32))


def word_checksums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word's bytes, a byte of all words at a time; long words go through the library."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    at, length = starts[order], size[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    long = int(np.count_nonzero(length > SHORT))
    left = np.searchsorted(-length[long:], -np.arange(SHORT + 1), "left") + long  # words longer than k
    for k in range(SHORT):
        n = left[k]
        if n == long:
            break
        crc[long:n] = _step(crc[long:n], raw[at[long:n] + k])
    crc = ~crc
    for i in range(long):
        crc[i] = zlib.crc32(raw[at[i] : at[i] + length[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def runs(texts: list[bytes | None], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, CRC-32) of every run of 1 to ``run`` consecutive words joined by one space, and the words of each text."""
    raw = _LOWER[np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _WORD[raw], [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    lengths = np.array([len(t or b"") + 1 for t in texts], np.int64)
    owner = np.searchsorted(np.cumsum(lengths), starts, "right")
    words = np.bincount(owner, minlength=len(texts))
    if not len(starts):
        return owner, np.zeros(0, np.uint32), words
    own = word_checksums(raw, starts, ends)
    owners, found, crc, size = [owner], [own], own, ends - starts
    for k in range(1, run):
        if len(crc) < 2:
            break
        crc = _joined(_spaced(crc[:-1]), own[k:], size[k:])
        same = owner[k:] == owner[:-k]
        owners.append(owner[k:][same])
        found.append(crc[same])
    return np.concatenate(owners), np.concatenate(found), words


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences in each bucket over all rows of a text column: a vector for each partition, added up in a tree."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in in_pieces(batches):
            for _, part in in_slices(batch.column(0)):
                total += np.bincount(runs(part)[1] % np.uint32(buckets), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    vectors = texts.select("text").mapInArrow(count, "counts binary")
    none = texts.sparkSession.createDataFrame([(bytes(8 * buckets),)], "counts binary")  # a table may have no partition
    merged = vectors.unionAll(none).rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.int64)).treeReduce(lambda a, b: a + b)
    return merged.copy()


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the source, one added to every count."""
    s, t, n = source.tolist(), target.tolist(), len(source)
    all_s, all_t = sum(s) + n, sum(t) + n
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)], np.float64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """docs with _ms_words, n_features and weight, the sum of gains over all runs of a text."""
    model = docs.sparkSession.sparkContext.broadcast(gain)
    names = docs.columns
    schema = docs.withColumns({c: F.lit(0).cast("long") for c in ("_ms_words", "n_features", "weight")}).schema

    def run(batches):
        own = model.value
        for batch in in_pieces(batches):
            weight, words = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for at, part in in_slices(batch.column(names.index("text"))):
                owner, crc, n = runs(part)
                words[at : at + len(part)] = n
                weight[at : at + len(part)] = np.bincount(owner, own[crc % np.uint32(len(own))], len(part))
            n_features = sum(np.maximum(words - k, 0) for k in range(RUN))
            more = [pa.array(x) for x in (words, n_features, weight.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "_ms_words", "n_features", "weight"])

    return docs.mapInArrow(run, schema)


def gumbel(seed: int, doc_id):
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256(``seed:doc_id``); a null doc_id is empty there."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """All rows and columns of docs with n_features, weight, score and rank; ``percent`` of the rows of ``least_words``
    words and more are drawn, those of the highest scores, ties to the smaller doc_id, null doc_ids first.

    Rank is null for rows that are not drawn. Null and empty texts have no features and a weight of 0. Repeated rows are
    drawn each by itself. Input columns of the names added are replaced. Without target texts all gains come from the
    documents alone; an empty docs gives an empty frame.
    """
    scratch = scratch or Scratch()
    spark = docs.sparkSession
    docs = plain(docs).drop("n_features", "weight", "score", "rank")
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = scratch.written(weigh(docs, gain).withColumn("score", F.col("weight") + gumbel(seed, "doc_id")).withColumn("_ms_row", F.monotonically_increasing_id()), "scored")
    enough = scored.where(F.col("_ms_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), "_ms_row"]
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = enough.select("_ms_row", "score", "doc_id").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = scratch.written(own.select("_ms_row", F.spark_partition_id().alias("_ms_part"), F.monotonically_increasing_id().alias("_ms_at")), "order")
    sizes = place.groupBy("_ms_part").count()
    n = place.count()
    before = prefix_sums(sizes, "_ms_part", "count", "_ms_before")  # a row for each of the partitions above
    rank = F.col("_ms_before") + F.col("_ms_at").bitwiseAND((1 << 33) - 1) + 1
    drawn = place.join(F.broadcast(before), "_ms_part").select("_ms_row", rank.alias("rank")).where(F.col("rank") <= percent * n // 100)
    return scored.join(drawn, "_ms_row", "left").drop("_ms_words", "_ms_row")


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Features, weight, score and rank of every document, towards the benchmark's texts; nulls as in resample()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = resample(docs, table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_features", "weight", "score", "rank")])
