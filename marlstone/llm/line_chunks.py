"""Repeated passages, by content-defined chunks of lines.

A rolling hash over line hashes runs over the texts: that of the shortest run of lines from each line on that has so
many words. A line is a border if its hash is the least among those of the lines in the next so many words, so that
borders depend on what stands around them alone and survive any shift; the run that begins there is a chunk. Chunks are
counted by hash over the whole corpus. Those that repeat are extended line by line, to the shortest runs of lines with
enough words that begin or end at each line around them; such runs that repeat have their bytes compared, and all but
the first are removed.

Nothing is lost by way of the chunks. A passage of enough words is covered by runs within it, of twice a chunk's words;
the border that is chosen from a run's first line, and the chunk there, lie within the run, and so are the same wherever
it stands: a run repeats only if its chunk does. So passages go whole, wherever they begin and end.
"""

from __future__ import annotations

import itertools
from collections import deque

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, in_pieces, plain, table, written

#: Words that a passage needs to be removed.
HEAVY = 24
#: What a rolling hash is multiplied by for each line.
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


class Rolling:
    """Hashes of any run of some lines, from sums of the line hashes that roll along; runs by words."""

    def __init__(self, lines: list[bytes]):
        self.words = [0, *itertools.accumulate(line.count(b" ") + 1 if line else 0 for line in lines)]
        self.sums, self.powers = [0], [1]
        for line in lines:
            self.sums.append((self.sums[-1] * _BASE + xxhash.xxh3_64_intdigest(line)) & _MASK)
            self.powers.append(self.powers[-1] * _BASE & _MASK)

    def __call__(self, a: int, b: int) -> int:
        h = (self.sums[b] - self.sums[a] * self.powers[b - a]) & _MASK
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & _MASK  # so that the least hash is any line's with the same chance
        h ^= h >> 32
        return h - (1 << 64) if h >> 63 else h

    def ends(self, least: int) -> list[int]:
        """Of each line on which a run of so many words begins, the end of the shortest; the last lines may have none."""
        out, b, n = [], 0, len(self.words) - 1
        for a in range(n):
            b = max(b, a + 1)
            while b < n and self.words[b] - self.words[a] < least:
                b += 1
            if self.words[b] - self.words[a] < least:
                break
            out.append(b)
        return out


def borders(roll: Rolling, words: int) -> tuple[list[int], list[int], list[int]]:
    """The border chosen from each line, the ends of the chunks of so many words that begin at lines, and their hashes."""
    ends = roll.ends(words)
    hashes = [roll(a, b) for a, b in enumerate(ends)]
    chosen, least, j = [], deque(), 0
    for a in range(len(ends)):
        while j < len(ends) and (j <= a or roll.words[j] - roll.words[a] <= words):
            while least and hashes[least[-1]] > hashes[j]:
                least.pop()
            least.append(j)
            j += 1
        while least[0] < a:
            least.popleft()
        chosen.append(least[0])
    return chosen, ends, hashes


def chunks(lines: list[bytes], heavy: int = HEAVY) -> list[tuple[int, int, int]]:
    """(first line, end, words) of the chunks at the borders."""
    roll = Rolling(lines)
    chosen, ends, _ = borders(roll, heavy // 2)
    return [(a, ends[a], roll.words[ends[a]] - roll.words[a]) for a in dict.fromkeys(chosen)]


def units(roll: Rolling, heavy: int = HEAVY) -> list[tuple[int, int]]:
    """(first line, end) of the shortest heavy run from each line on, and of the shortest up to each line."""
    out = dict.fromkeys(enumerate(roll.ends(heavy)))
    total = roll.words
    a = 0
    for b in range(1, len(total)):
        while a + 1 < b and total[b] - total[a + 1] >= heavy:
            a += 1
        if total[b] - total[a] >= heavy:
            out[a, b] = None
    return list(out)


_KEYS = "_ms_id long, _ms_text long"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the key that stands for a row; rows equal in doc_id and text share it, and their fate."""
    return docs.withColumn("_ms_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("_ms_text", F.xxhash64("text"))


def _chunked(docs: DataFrame, heavy: int) -> DataFrame:
    """(row, chunk, runs) of every chunk, with the runs that it is extended to if it repeats."""
    run_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("h", pa.int64())]))

    def run(batches):
        for batch in in_pieces(batches):
            rows = ([], [], [], [])
            for key, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                roll = Rolling(text.as_py().split(b"\n"))
                own = units(roll, heavy)
                if not own:
                    continue
                chosen, _, hashes = borders(roll, heavy // 2)
                by_border = {}
                for a, b in own:
                    by_border.setdefault(chosen[a], []).append({"a": a, "b": b, "h": roll(a, b)})
                for border, found in by_border.items():
                    for column, value in zip(rows, (key, h, hashes[border], found)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int64(), pa.int64(), run_type))], ["_ms_id", "_ms_text", "chunk", "runs"])

    return docs.where("text is not null").select("_ms_id", "_ms_text", "text").mapInArrow(run, f"{_KEYS}, chunk long, runs array<struct<a:int,b:int,h:long>>")


def _occurrences(chunked: DataFrame) -> DataFrame:
    """(row, a, b, h) of the runs around chunks that repeat; hashes are counted before anything is shuffled."""
    repeated = chunked.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1").select("chunk")
    return chunked.join(repeated, "chunk", "left_semi").select("_ms_id", "_ms_text", F.explode("runs").alias("u")).select("_ms_id", "_ms_text", "u.*")


def _apply(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs without the lines of marks that go, and the marked units' hashes and bytes. One shuffle of the texts."""
    lists = marks.groupBy("_ms_id", "_ms_text").agg(F.collect_list(F.struct("a", "b", "h", "cut")).alias("_ms_marks"))
    joined = docs.join(lists, ["_ms_id", "_ms_text"], "left")
    joined = joined.select(*[c for c in joined.columns if c != "_ms_marks"], "_ms_marks")
    at_text, at_marks = joined.columns.index("text"), len(joined.columns) - 1
    unit = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("h", pa.int64()), ("bytes", pa.binary())]))

    def run(batches):
        for batch in in_pieces(batches):
            texts, marked, removed = [], [], []
            for text, own in zip(batch.column(at_text).cast(pa.binary()), batch.column(at_marks)):
                own = own.as_py()
                text = text.as_py()
                if not own:
                    texts.append(text)
                    marked.append(None)
                    removed.append(0)
                    continue
                lines = text.split(b"\n")
                gone = set()
                for m in own:
                    gone.update(range(m["cut"], m["b"]))
                texts.append(b"\n".join(line for i, line in enumerate(lines) if i not in gone))
                marked.append([{"a": m["a"], "b": m["b"], "h": m["h"], "bytes": b"\n".join(lines[m["a"] : m["b"]])} for m in own])
                removed.append(len(gone))
            cols = list(batch.columns[:-1])
            cols[at_text] = pa.array(texts, pa.binary()).cast(batch.column(at_text).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, pa.int32()), pa.array(marked, unit)], [*batch.schema.names[:-1], "_ms_removed", "_ms_units"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1])
    return joined.mapInArrow(run, f"{fields}, _ms_removed int, _ms_units array<struct<a:int,b:int,h:long,bytes:binary>>")


def _cut():
    """The line from which on a unit goes: its end if it is the first of its hash, past the first if they overlap."""
    place = F.struct("_ms_id", "_ms_text", "a", "b")
    same = (F.col("first._ms_id") == F.col("_ms_id")) & (F.col("first._ms_text") == F.col("_ms_text"))
    return F.when(F.col("first") == place, F.col("b")).when(same, F.least("b", F.greatest("a", "first.b"))).otherwise(F.col("a"))


def remove_repeats(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """docs without the passages that occurred before, and ``n_removed_lines``.

    The first occurrence, by doc_id (null first), text hash and place, stays; a passage repeated within a text goes as
    well. Texts that lose all lines become empty, rows never go, null and empty texts stay as they are. Rows equal in
    doc_id and text count as one document and share its fate. Texts of any length are read whole. Other columns pass
    through, but for those whose names begin as the operators' own do.
    """
    keyed = _keyed(plain(docs).drop("n_removed_lines"))
    chunked = written(_chunked(keyed, heavy), "chunks")
    found = written(_occurrences(chunked), "runs")
    dropped(chunked)
    place = F.struct("_ms_id", "_ms_text", "a", "b")
    repeated = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    again = written(found.join(repeated, "h", "left_semi"), "again")
    firsts = again.groupBy("h").agg(F.min(place).alias("first"))
    # rows with one key say the same twice; where nothing else repeats, no mark goes
    marks = again.join(firsts, "h").select("_ms_id", "_ms_text", "a", "b", "h", _cut().alias("cut")).distinct()
    marks = written(marks, "marks")
    out = written(_apply(keyed, marks), "lines")
    exploded = out.select("_ms_id", "_ms_text", F.explode("_ms_units").alias("u")).select("_ms_id", "_ms_text", "u.*")
    # bytes are equal for a hash exactly if their least and greatest are
    unlike = exploded.groupBy("h").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi")).where("lo != hi").select("h")
    unlike = written(unlike, "unlike")
    if not unlike.isEmpty():
        # different bytes met under one hash: these are told apart by the bytes themselves
        own = exploded.join(unlike, "h", "left_semi").select("_ms_id", "_ms_text", "a", "b", "h", "bytes").distinct()
        firsts = own.groupBy("h", "bytes").agg(F.min(place).alias("first"))
        exact = own.join(firsts, ["h", "bytes"]).select("_ms_id", "_ms_text", "a", "b", "h", _cut().alias("cut"))
        first, out = out, written(_apply(keyed, marks.join(unlike, "h", "left_anti").unionByName(exact)), "lines")
        dropped(first)
    for done in (found, again, marks, unlike):
        dropped(done)
    return out.withColumnRenamed("_ms_removed", "n_removed_lines").drop("_ms_id", "_ms_text", "_ms_units")


def op6_line_chunks(spark, sf_dir: str) -> DataFrame:
    """Every document without the passages that occurred before, and how many lines went.

    Null and empty texts stay so; repeated rows share their fate; other columns are not returned.
    """
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed_lines")
