"""Best-fit packing by a grouping genetic algorithm.

Islands start from best fit in shaken orders. Crossover injects whole well-filled bins and packs the pieces that they
displace into the gaps; children are polished by emptying a few bins and filling each again with the pieces that fit
it best; elites move on to the next island.

Documents of one length are interchangeable, so an instance is the count of pieces of each length: at most
``capacity`` numbers, whatever the size of the corpus. A packing is a set of *kinds of bins* - the lengths in a bin,
largest first - with the number of bins of each kind. The islands evolve such packings in Spark tasks; a seeded
two-level rank then puts every piece in its place without gathering the pieces of a length anywhere.
"""

from __future__ import annotations

import bisect
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_pieces, plain, table, written
from .tokens import encoder

END = np.array([2], "<u4").tobytes()
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Packing = dict[tuple[int, ...], int]
#: Times that bins of a child are emptied and filled again.
POLISH = 400


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Token pieces of each document: ids of the whole text and an end id, cut into ``capacity`` ids if longer.

    The first piece of a longer document takes the remainder, the others are full. A null or empty text is its end
    id alone. ``with_ids`` adds the ids themselves; equal rows each get their own pieces, other columns are not read.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches):
        enc = encoder(tokenizer, True)
        for batch in in_pieces(batches, 1024):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for at in range(0, len(ids), 256):
                rows = []
                for doc, own in zip(ids[at : at + 256], enc.encode(texts.slice(at, 256).to_pylist())):
                    own += END
                    n = len(own) // 4
                    start = 0
                    for k in range(-(-n // capacity)):
                        end = n - capacity * (-(-n // capacity) - 1 - k)
                        part = own[4 * start : 4 * end]
                        rows.append((doc, k, start, end - start, zlib.crc32(part), part))
                        start = end
                cols = [pa.array(x, t) for x, t in zip(list(zip(*rows))[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(r[5], "<i4") for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


# The genetic algorithm, on counts


def best_fit(left: dict[int, int], bins: Packing, capacity: int, order=None) -> Packing:
    """Put ``left`` (length: pieces) into ``bins``, each into the tightest gap that takes it, opening bins as needed."""
    gaps: dict[int, dict[tuple, int]] = {}
    for kind, n in bins.items():
        gaps.setdefault(capacity - sum(kind), {})[kind] = n
    sizes = sorted(gaps)

    def put(kind, n):
        gap = capacity - sum(kind)
        if gap not in gaps:
            gaps[gap] = {}
            bisect.insort(sizes, gap)
        gaps[gap][kind] = gaps[gap].get(kind, 0) + n

    for size in order or sorted(left, reverse=True):
        n = left.get(size, 0)
        while n:
            at = bisect.bisect_left(sizes, size)
            if at == len(sizes):
                most = capacity // size
                if n >= most:
                    put((size,) * most, n // most)
                if n % most:
                    put((size,) * (n % most), 1)
                break
            gap = sizes[at]
            kind, there = gaps[gap].popitem()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            each = min(gap // size, n)
            take = min(there, n // each)
            put(tuple(sorted(kind + (size,) * each, reverse=True)), take)
            if there > take:
                put(kind, there - take)
            n -= take * each
    return {kind: n for some in gaps.values() for kind, n in some.items()}


def exchange(bins: Packing, left: dict[int, int], capacity: int, most: int = 256) -> tuple[Packing, dict[int, int]]:
    """Fill bins up by changing one or two of their pieces, or none, for one or two larger ones that are ``left``.

    The emptiest ``most`` kinds of bins are tried once, one bin of each; what comes out of a bin is left in its place.
    """
    bins, left = dict(bins), {s: n for s, n in left.items() if n}
    kinds = sorted((k for k in bins if sum(k) < capacity), key=lambda k: (sum(k), k))[:most]
    for kind in kinds:
        gap = capacity - sum(kind)
        sizes = sorted(left)
        if not sizes:
            break
        best = (0, (), ())
        outs = {()} | {(a,) for a in kind} | {(a, b) for i, a in enumerate(kind) for b in kind[i + 1 :]}
        pairs = None
        for out in sorted(outs):
            room = sum(out) + gap
            at = bisect.bisect_right(sizes, room) - 1
            if at >= 0 and sizes[at] - sum(out) > best[0]:
                best = (sizes[at] - sum(out), out, (sizes[at],))
            if best[0] == gap:
                break
            if pairs is None:
                pairs = _pair_sums(sizes, left, capacity)
            total = int(pairs[0][min(room, capacity)])
            if total - sum(out) > best[0]:
                best = (total - sum(out), out, (total - int(pairs[1][total]), int(pairs[1][total])))
            if best[0] == gap:
                break
        if not best[0]:
            continue
        _, out, in_ = best
        bins[kind] -= 1
        if not bins[kind]:
            del bins[kind]
        now = list(kind)
        for a in out:
            now.remove(a)
            left[a] = left.get(a, 0) + 1
        for a in in_:
            left[a] -= 1
            if not left[a]:
                del left[a]
        key = tuple(sorted([*now, *in_], reverse=True))
        bins[key] = bins.get(key, 0) + 1
    return bins, left


def _pair_sums(sizes: list[int], left: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest sum of two pieces up to each number, 0 for none, and one piece of each sum."""
    x = np.array(sizes)
    i, j = np.triu_indices(len(x))
    fine = ((i != j) | (np.array([left[s] for s in sizes])[i] > 1)) & (x[i] + x[j] <= capacity)
    part = np.zeros(capacity + 1, np.int64)
    part[(x[i] + x[j])[fine]] = x[j][fine]
    return np.maximum.accumulate(np.where(part > 0, np.arange(capacity + 1), 0)), part


def repaired(bins: Packing, left: dict[int, int], capacity: int, order=None) -> Packing:
    """All pieces packed again: what is left goes by exchange into bins that have room, then by best fit."""
    bins, left = exchange(bins, left, capacity)
    return best_fit(left, bins, capacity, order)


def crossover(mother: Packing, father: Packing, counts: dict[int, int], capacity: int, rng: random.Random) -> Packing:
    """Inject whole well-filled bins of the father, drop the mother's bins that hold a piece twice now, and pack the
    displaced pieces into the gaps."""
    used: Counter = Counter()
    child: Packing = {}

    def add(kind, n):
        need = Counter(kind)
        n = min([n, *((counts[s] - used[s]) // k for s, k in need.items())])
        if n > 0:
            child[kind] = child.get(kind, 0) + n
            for s, k in need.items():
                used[s] += k * n

    full = sorted(father, key=lambda k: (capacity - sum(k), k))
    share = rng.uniform(0.2, 0.7)
    for kind in full[: max(1, int(len(full) * share))]:
        if rng.random() < 0.8:
            add(kind, father[kind])
    own = sorted(mother, key=lambda k: (capacity - sum(k), rng.random()))
    for kind in own[: max(1, int(len(own) * 0.9))]:
        add(kind, mother[kind])
    return repaired(child, {s: c - used[s] for s, c in counts.items() if c > used[s]}, capacity)


def mutate(bins: Packing, capacity: int, rng: random.Random) -> Packing:
    """Empty the worst bins and some others, one of a kind, and pack their pieces into the gaps in a shaken order."""
    kinds = sorted(bins, key=lambda k: sum(k))
    some = max(2, min(40, len(kinds) // 20))
    gone = dict.fromkeys([*kinds[: rng.randint(1, some)], *rng.sample(kinds, min(len(kinds), rng.randint(1, some)))])
    left: Counter = Counter()
    rest = dict(bins)
    for k in gone:
        n = min(rest[k], rng.randint(1, 3))
        for s in k:
            left[s] += n
        rest[k] -= n
        if not rest[k]:
            del rest[k]
    order = sorted(left, key=lambda s: -s * rng.uniform(0.9, 1.0))
    return repaired(rest, left, capacity, order + sorted(set().union(*rest) - set(order), reverse=True) if rest else order)


def fullest(pieces: list[int], room: int) -> list[int]:
    """Places of the pieces of the largest sum up to room, by the sums that can be reached as bits of a number."""
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for size in pieces:
        reach.append((reach[-1] | reach[-1] << size) & mask)
    total = reach[-1].bit_length() - 1
    out = []
    for k in range(len(pieces) - 1, -1, -1):
        if not reach[k] >> total & 1:
            out.append(k)
            total -= pieces[k]
    return out


def refill(pieces: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Bins of the pieces: the largest one left and the others that fill up its bin best, again and again."""
    pieces = sorted(pieces, reverse=True)
    out = []
    while pieces:
        first = pieces.pop(0)
        picked = fullest(pieces, capacity - first)
        out.append((first, *sorted((pieces[k] for k in picked), reverse=True)))
        for k in picked:  # from the last on
            del pieces[k]
    return out


def polish(bins: Packing, capacity: int, rng: random.Random, tries: int) -> Packing:
    """Empty one of the emptiest bins and a few others, and keep what refill makes of them where that is not worse.

    Empty room so gathers in few bins until one of them is not needed any more.
    """
    bins = dict(bins)
    square = lambda kinds: sum((sum(k) / capacity) ** 2 for k in kinds)
    kinds: list[tuple[int, ...]] = []
    for turn in range(tries):
        if turn % 50 == 0 or len(kinds) < 2:
            kinds = sorted(bins, key=lambda k: (sum(k), k))
            if len(kinds) < 2:
                break
        low = kinds[min(int(rng.expovariate(0.3)), len(kinds) - 1)]
        some = [low, *(kinds[rng.randrange(len(kinds))] for _ in range(rng.randint(2, 9)))]
        taken = Counter(some)
        if any(bins.get(k, 0) < n for k, n in taken.items()):
            taken = Counter({k: min(n, bins.get(k, 0)) for k, n in taken.items() if bins.get(k, 0)})
        old = list(taken.elements())
        if len(old) < 2:
            continue
        new = refill([s for k in old for s in k], capacity)
        if (len(new), -square(new)) <= (len(old), -square(old)):
            for k in old:
                bins[k] -= 1
                if not bins[k]:
                    del bins[k]
            for k in new:
                bins[k] = bins.get(k, 0) + 1
            kinds += new
    return bins


def fitness(bins: Packing, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then fuller ones, by the squares of their fill."""
    return sum(bins.values()), -sum(n * (sum(k) / capacity) ** 2 for k, n in bins.items())


def evolve(counts: dict[int, int], capacity: int, seed: int, start: list[Packing], size: int, generations: int) -> list[Packing]:
    """One island's epoch: its population after some generations, best first. It stops at the bound that no packing beats."""
    rng = random.Random(seed)
    bound = -(-sum(s * c for s, c in counts.items()) // capacity)
    alive = list(start)
    while len(alive) < size:
        shake = 0.0 if not alive and seed % 1000 == 0 else rng.uniform(0.02, 0.3)
        order = sorted(counts, key=lambda s: -s * rng.uniform(1 - shake, 1))
        alive.append(best_fit(counts, {}, capacity, order))
    ranked = sorted(((fitness(p, capacity), i, p) for i, p in enumerate(alive)), key=lambda x: x[:2])
    made = len(ranked)
    for _ in range(generations):
        if ranked[0][0][0] <= bound:
            break
        a, b = sorted(rng.sample(range(size), 2))
        children = [crossover(ranked[b][2], ranked[a][2], counts, capacity, rng), crossover(ranked[a][2], ranked[b][2], counts, capacity, rng)]
        children += [mutate(rng.choice(children), capacity, rng), ranked[0][2]]
        children = [polish(p, capacity, rng, POLISH) for p in children]
        seen = {x[0] for x in ranked}
        for p in children:
            made += 1
            f = fitness(p, capacity)
            if f not in seen:  # one of each fitness, so that an island does not fill up with one packing
                seen.add(f)
                ranked.append((f, made, p))
        ranked = sorted(ranked, key=lambda x: x[:2])[:size]
    return [p for _, _, p in ranked]


def islands(spark, counts: dict[int, int], capacity: int, *, n_islands: int = 4, size: int = 6, epochs: int = 3, generations: int = 8, seed: int = 0) -> Packing:
    """Evolve the islands, one task each, and send each one's elite to the next island between epochs.

    What a task gets and gives is bounded by ``capacity`` lengths and ``size`` packings of them.
    """
    bound = -(-sum(s * c for s, c in counts.items()) // capacity)
    if not counts:
        return {}
    alive: list[list[Packing]] = [[] for _ in range(n_islands)]
    for epoch in range(epochs):
        rows = [(i, bytearray(pickle.dumps(p))) for i, p in enumerate(alive)]

        def run(batches, epoch=epoch):
            for batch in batches:
                for i, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out = evolve(counts, capacity, seed + 1000 * i + epoch, pickle.loads(own), size, generations)
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(out)], pa.binary())], ["island", "alive"])

        frame = spark.createDataFrame(rows, "island long, alive binary").repartition(n_islands)
        got = {r.island: pickle.loads(bytes(r.alive)) for r in frame.mapInArrow(run, "island long, alive binary").collect()}
        alive = [got[i] for i in range(n_islands)]
        best = min((p[0] for p in alive), key=lambda p: fitness(p, capacity))
        if fitness(best, capacity)[0] <= bound:
            break
        elites = [p[0] for p in alive]
        alive = [p[:-1] + [elites[i - 1]] for i, p in enumerate(alive)]
        alive = [sorted(p, key=lambda x: fitness(x, capacity)) for p in alive]
    return best


def _slots(best: Packing, capacity: int) -> dict[int, tuple]:
    """For each length, runs of ranks: the first rank, copies of the length in a bin, first bin, offset in the bin."""
    out: dict[int, list] = {}
    taken: Counter = Counter()
    first = 0
    for kind in sorted(best):
        offset = 0
        for s, k in sorted(Counter(kind).items(), reverse=True):
            out.setdefault(s, []).append((taken[s], k, first, offset))
            taken[s] += k * best[kind]
            offset += s * k
        first += best[kind]
    return {s: tuple(np.array(x, np.int64) for x in zip(*runs)) for s, runs in out.items()}


def pack(parts: DataFrame, capacity: int = 1024, **how) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; parts has a length from 1 to ``capacity`` and is read several times.

    All other columns pass through, but for those whose names begin as the operators' own do; equal rows each have a
    place. Empty input gives empty output.
    """
    spark = parts.sparkSession
    parts = plain(parts)
    salts = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A bucket has no meaning of its own, so the rows of one length are dealt by their partition and place in it.
    bucketed = written(parts.withColumn("_ms_bucket", F.pmod(F.xxhash64(*[parts[c] for c in ("doc_id", "piece") if c in parts.columns], F.spark_partition_id()), F.lit(salts))), "parts")
    cells = bucketed.groupBy("length", "_ms_bucket").count()
    cells = written(cells.withColumn("_ms_before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_ms_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "cells")
    counts = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    lengths = {int(s): int(n) for s, n in counts.items()}
    full = lengths.pop(capacity, 0)
    best = islands(spark, lengths, capacity, **how)
    if full:
        best = {**best, (capacity,): full}
    slots = spark.sparkContext.broadcast(_slots(best, capacity))

    def place(batches):
        runs = slots.value
        for batch in batches:
            length = batch.column(batch.schema.names.index("length")).to_numpy()
            rank = batch.column(batch.schema.names.index("_ms_rank")).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                own = np.flatnonzero(length == s)
                lo, k, first, at = runs[int(s)]
                r = rank[own]
                run = np.searchsorted(lo, r, "right") - 1
                sequence[own] = first[run] + (r - lo[run]) // k[run]
                offset[own] = at[run] + (r - lo[run]) % k[run] * s
            keep = [c for c in batch.schema.names if not c.startswith("_ms_")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(sequence), pa.array(offset)], keep + ["sequence_id", "offset"])

    inside = F.row_number().over(Window.partitionBy("length", "_ms_bucket").orderBy("doc_id", "piece")) - 1
    ranked = bucketed.withColumn("_ms_in", inside).join(cells.select("length", "_ms_bucket", "_ms_before"), ["length", "_ms_bucket"])
    ranked = ranked.withColumn("_ms_rank", F.col("_ms_before") + F.col("_ms_in")).drop("_ms_bucket", "_ms_in", "_ms_before")
    ranked = ranked.select(*[c for c in parts.columns if c not in ("sequence_id", "offset")], "_ms_rank")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if not f.name.startswith("_ms_")]
    return ranked.mapInArrow(place, ", ".join(fields + ["sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, with_ids: bool = False, **how) -> DataFrame:
    """Pack whole documents into sequences of ``capacity`` token ids: a row a piece, see ``pieces`` and ``pack``.

    Null and empty texts are one id; texts of any length are encoded whole and cut; an empty table gives no row.
    """
    return pack(pieces(docs, tokenizer, capacity, with_ids), capacity, **how)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents' ids in sequences of 1024: a row a piece, with its place.

    A null or empty text is its end id alone; repeated rows each have their pieces; other columns are not read.
    """
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
