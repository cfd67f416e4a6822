"""Importance resampling against counting in a loop."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marlstone.llm import resample

from ..conftest import SF

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def expected(docs, target):
    s, t = [0] * 10_000, [0] * 10_000
    for text in docs:
        for b in buckets_of(text[1]):
            s[b] += 1
    for text in target:
        for b in buckets_of(text):
            t[b] += 1
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (all_s + 10_000) / ((a + 1) * (all_t + 10_000)))) for a, b in zip(s, t)]
    rows = []
    for doc, text in docs:
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        own = buckets_of(text)
        weight = sum(gain[b] for b in own)
        rows.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    enough = [r for r, (_, text) in zip(rows, docs) if len(words_of(text)) >= 20]
    enough.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(enough[: 5 * len(enough) // 100]):
        r[4] = k + 1
    return sorted(map(str, rows))


def got(df):
    return sorted(str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in df.collect())


def test_checksums_of_runs():
    texts = [None, "", " ", "A", "a-b", "x" * 48 + " " + "y" * 49 + " z " + "w" * 5000 + " end", "Ünï ÇØ 9z\0ü", "one two three four"]
    owner, crc, n = resample.runs([t.encode() if t else t for t in texts])
    for k, t in enumerate(texts):
        assert sorted(crc[owner == k] % 10_000) == sorted(buckets_of(t)) and n[k] == len(words_of(t))


def test_shared_documents(spark):
    docs = [tuple(r.values()) for r in pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text"]).to_pylist()]
    target = pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()
    assert got(resample.op12_importance_resampling(spark, SF)) == expected(docs, target)


LONG = "alpha beta gamma delta " * 10


@pytest.fixture(scope="module")
def odd():
    rows = [(1, LONG), (1, LONG), (None, LONG), (None, "q " * 40), (2, None), (3, ""), (4, "... !"), (5, "word"), (6, "v" * 200_000 + " tail"), (7, "x " * 30_000)]
    return rows + [(k, f"alpha {k} " * 15) for k in range(10, 70)]


def test_odd_rows(spark, odd):
    """Nulls, empty and long texts, ties and repeated rows; columns of the operator's names are replaced."""
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("rank", "score", "weight", "_ms_row", "counts")})
    target = spark.createDataFrame([("alpha beta",), (None,)], "text string")
    done = resample.resample(df.repartition(3), target)
    assert got(done) == expected(odd, ["alpha beta", None])
    assert done.columns == ["doc_id", "text", "counts", "n_features", "weight", "score", "rank"]


def test_empty_tables(spark, odd):
    df = spark.createDataFrame(odd, "doc_id long, text string")
    assert got(resample.resample(df, df.select("text").limit(0))) == expected(odd, [])
    assert resample.resample(df.limit(0), df).count() == 0


def test_counts_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert np.array_equal(resample.bucket_counts(docs.repartition(7)), resample.bucket_counts(docs.coalesce(1)))
