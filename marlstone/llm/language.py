"""Language identification by compression: a text is of the language whose dictionary compresses it best.

A language's dictionary is raw content, runs of its training texts. Every whole text is compressed by zstandard with
each dictionary, in blocks so that the dictionary counts as much at its end as at its start; the smallest sum of sizes
wins, and what is hardly smaller than the next is rejected.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_pieces, table
from .quality import held_out

#: Bytes of a dictionary, bytes that one document gives to it at most, and documents of each language that may give.
DICTIONARY, SLICE, DOCUMENTS = 64 << 10, 4 << 10, 256
#: Distinct languages that are learned at most; a column of more does not name languages, and is an error.
LANGUAGES = 1000
LEVEL, BLOCK = 6, 4096
#: Ahead of each block, so that even a few words are compressed and not stored.
FILLER = bytes(64)
#: Share of the smallest size by which the next has to be larger.
MARGIN = 0.02
UNKNOWN = "und"

_GAP = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes | None:
    """Lower-case words of a text, one space around each; None for a text without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    return f" {_GAP.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace")


def learn(docs: DataFrame, *, seed: int = 0) -> list[tuple[str, bytes]]:
    """(language, dictionary) from rows (doc_id, text, lang) with none of these null, the commonest language first.

    A bounded sample: the documents of the smallest seeded hashes of each language, and of each a run from a hashed
    place. The counts that order the languages are of all rows.
    """
    known = docs.select("doc_id", "text", "lang").dropna()
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"lang has over {LANGUAGES} values; it does not name languages")
    ranked = known.select("doc_id", "lang").withColumn("_ms_hash", F.xxhash64(F.lit(seed), "doc_id"))
    order = Window.partitionBy("lang").orderBy("_ms_hash", "doc_id")  # Spark keeps so many rows of each task only
    picked = ranked.withColumn("_ms_n", F.row_number().over(order)).where(F.col("_ms_n") <= DOCUMENTS).select("doc_id", "lang", "_ms_hash").distinct()
    rows = known.join(F.broadcast(picked), ["doc_id", "lang"]).select("lang", "_ms_hash", "text")

    def cut(batches):
        for batch in in_pieces(batches, 64):
            out = []
            for h, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = letters(text) or b""
                at = h % max(1, len(own) - SLICE + 1)
                out.append(own[at : at + SLICE])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["lang", "h", "run"])

    given = defaultdict(list)
    for r in rows.mapInArrow(cut, "lang string, h long, run binary").toArrow().to_pylist():
        given[r["lang"]].append((r["h"], r["run"]))
    return [(r.lang, b"".join(run for _, run in sorted(given[r.lang]))[:DICTIONARY]) for r in counts]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    own = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    if len(dictionary) < 8:  # the least that the library takes
        return zstandard.ZstdCompressor(level=LEVEL, **own)
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=content, **own)


def sizes(text: bytes, compressors: list) -> np.ndarray:
    """Bytes of a whole text with each dictionary."""
    blocks = [FILLER + text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    return np.array([sum(len(c.compress(b)) for b in blocks) for c in compressors])


def identify(docs: DataFrame, model: list[tuple[str, bytes]], margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of docs, from its text alone.

    Equal sizes go to the commoner language. The score is the winner's share when every byte more halves a language's;
    rejected is true where the next size is within ``margin``. Null texts and texts without a letter, and all texts where
    nothing was learned, are ``und`` with a score of 0 and rejected. Repeated rows are each judged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names = [n for n, _ in shared.value]
        compressors = [_compressor(d) for _, d in shared.value]
        for batch in in_pieces(batches, 256):
            out = []
            for text in batch.column(1).to_pylist():
                own = letters(text) if names else None
                if own is None:
                    out.append((UNKNOWN, 0.0, True))
                    continue
                n = sizes(own, compressors)
                best = int(n.argmin())
                rest = np.delete(n, best)
                narrow = bool(len(rest) and rest.min() - n[best] < margin * n[best])
                out.append((names[best], float(1 / np.exp2(-np.minimum(n - n[best], 1000.0)).sum()), narrow))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.float64(), pa.bool_())))], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op13_compression_language(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned only from rows that are not held out and have a lang."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
