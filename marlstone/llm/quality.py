"""Quality scores by a hashed word n-gram logistic regression, fitted with follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, table
from .linear import SIZE, follow_the_leader, in_slices, lists, squash, sums, tail

#: Labelled rows that a model is fitted on, those of the smallest hashes; a documented bound, scoring covers all rows.
SAMPLE = 8000


def sampled(docs: DataFrame, labels: DataFrame, columns: list[str], sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """(text, *columns) of at most ``sample`` labelled rows, picked by a seeded hash of doc_id; null labels are left out."""
    known = labels.select("doc_id", *columns).where(" and ".join(f"{c} is not null" for c in ["doc_id", *columns]))
    picked = known.withColumn("_ms_hash", F.xxhash64(F.lit(seed), "doc_id")).orderBy("_ms_hash", "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("_ms_hash", "text", *columns)


def fit(rows: DataFrame, label: str = "quality", **how) -> np.ndarray:
    """Weights from a bounded set of rows (text, label), learned in one task; equal input gives equal weights."""
    own = rows.select("_ms_hash", "text", F.col(label).cast("int").alias("y"))

    def hashed(batches):
        for batch in in_pieces(batches):
            for at, texts in in_slices(batch.column(1)):
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists(texts), pa.list_(pa.int64())), part.column(2)], ["h", "f", "y"])

    def learn(batches):
        x, y = [], []
        for batch in batches:
            x += [np.array(v.as_py(), np.int64) for v in batch.column(1)]
            y += batch.column(2).to_pylist()
        w = follow_the_leader(x, np.array(y), **how) if x else np.zeros(SIZE + 17)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["at", "w"])

    got = own.mapInArrow(hashed, "h long, f array<long>, y int").coalesce(1).sortWithinPartitions("h", "f").mapInArrow(learn, "at long, w double").toArrow()
    out = np.zeros(SIZE + 17)
    out[got.column("at").to_numpy()] = got.column("w").to_numpy()
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row of docs from its whole text alone; null is the empty text, which has its score too."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = model.value
        for batch in in_pieces(batches):
            out = np.zeros(batch.num_rows)
            for at, texts in in_slices(batch.column(1)):
                out[at : at + len(texts)] = squash(sums(texts, [w])[0] + tail(w, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id="doc_id"):
    """Rows that no label is learned from: crc32 of doc_id as text, modulo 5. A null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, learned only from labelled rows that are not held out.

    Null and empty texts have the score of the empty text; without labels all scores are one half; repeated rows are
    each scored; other columns are not read.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit(sampled(docs, labels.where(~held_out()), ["quality"]))
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
