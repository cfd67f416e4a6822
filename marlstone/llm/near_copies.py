"""Near-copies by the similarity of their word shingles, found through SimHash.

One fingerprint of few differing bits finds only the nearest copies. Here each text has many short fingerprints
(views) of its five-word shingles; the binary trie joins each view with itself, and what it finds is compared by
bounds first and by the shingles themselves in the end, so that a link means a Jaccard similarity of at least 0.8.
Texts of equal words are one node from the start.

Comparisons go from the cheapest on, and each skips what is connected by then, so that a group of n near-copies costs
no n x n rows: nodes of an equal view with the smallest of them; then each node with the nearest that a task knows,
if it is very near; then
every pair of near views whose nodes are not connected yet. Where nodes have many such partners, as in a family of texts
that are all a little less than similar, these nodes are not paired but compared exactly (crowd): in any order of
shingles that all texts share, two similar texts have one in common among their first few (prefix), so that of such a
family only those meet that share a rare shingle.

Two texts of a similarity of just 0.8 differ in a bit with a chance of 0.15, so that a view shows them with 0.19 and
30 views miss 2 in 1000 such pairs; the nearer they are, the fewer. Signs of few shingles vary more, so short texts are
all compared by prefixes as well.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, dropped, in_pieces, release, written
from .components import components
from .simhash import _LANES, DEEPER, HOT, trie_pairs

VIEWS, BITS, BUDGET = 30, 36, 3
#: Two fingerprints that link agree in one of these blocks at least; the trie of a rotation starts below it.
BLOCKS = BUDGET + 1
WIDTH = BITS // BLOCKS
REST = BITS - WIDTH
#: Fingerprints of a trie's leaf, and pairs that a task makes at once.
LEAF = 512
AT_ONCE = 1 << 18
#: Texts to be compared whose ids are sent to all executors, 8 bytes each; with more, the join is left to Spark.
BROADCAST_IDS = 1 << 20
#: Texts of fewer shingles are compared exactly, and so with those of up to a quarter more, which could be similar.
SHORT = 100
#: Bits that a node and its nearest may differ in at first, and partners in one task above which it is of a crowd.
AT_FIRST, CROWD = 1, 1
#: Texts, about, whose shingles are counted to put common ones last in the order, and shingles so put. Any order finds
#: the same links; with common shingles last, fewer pairs are compared.
SAMPLE, COMMON = 20_000, 1 << 18
#: Longs in a text's parity marks. Marks of two texts differ in no more bits than their sets in shingles.
MARKS = 16
_SEEDS = np.array([0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF for k in range(VIEWS)], np.uint64)
_WEIGHTS = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


def shingle_set(text: bytes | None, words: int) -> tuple[bytes, np.ndarray]:
    """Words joined by a space, A-Z lower-cased, and the different hashes of the runs of ``words``; shorter: of all."""
    own = (text or b"").lower().split()
    whole = b" ".join(own)
    if len(own) <= words:
        return whole, np.array([xxhash.xxh3_64_intdigest(whole)] if own else [], np.uint64)
    ends = list(itertools.accumulate(map(len, own), lambda a, b: a + b + 1))
    view = memoryview(whole)
    h = xxhash.xxh3_64_intdigest
    found = [h(view[a:b]) for a, b in zip([0] + [e + 1 for e in ends], ends[words - 1 :])]
    return whole, np.unique(np.array(found, np.uint64))


def views(shingles: np.ndarray) -> list[int]:
    """Short SimHashes of a set: in each, a bit is set if it is in over half of the shingles' hashes."""
    n = len(shingles)
    if not n:
        return [0] * VIEWS
    counts = np.zeros((len(_SEEDS), 8, 8), np.int64)
    for at in range(0, n, 255):
        m = shingles[None, at : at + 255] ^ _SEEDS[:, None]
        m = (m ^ (m >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        m = (m ^ (m >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        m ^= m >> np.uint64(31)
        for k in range(8):
            lanes = np.add.reduce((m >> np.uint64(k)) & _LANES, axis=1)
            counts[:, :, k] += lanes.view(np.uint8).reshape(len(_SEEDS), 8)
    set_ = (2 * counts.reshape(len(_SEEDS), 64) > n).astype(np.uint64)
    return [int(x) for x in set_[:, :BITS] @ _WEIGHTS]


def _common(docs: DataFrame, words: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of a sample of short texts, sorted, and how many have each."""

    def run(batches):
        for batch in in_pieces(batches):
            own = [x for x in (shingle_set(t.as_py(), words)[1] for t in batch.column(0).cast(pa.binary())) if len(x) < most]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64) if own else [], pa.int64())], ["token"])

    every = max(1, docs.count() // SAMPLE)  # which shingles come last is a matter of speed alone
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    counts = some.mapInArrow(run, "token long").groupBy("token").count().where("count > 2").orderBy(F.desc("count"), "token").limit(COMMON).toArrow()
    tokens, times = counts.column("token").to_numpy().view(np.uint64), counts.column("count").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], times[order]


def prefix(shingles: np.ndarray, tokens: np.ndarray, times: np.ndarray, similarity: float) -> np.ndarray:
    """So many of the set's first shingles, rare ones first, that a set of enough similarity shares one of its own."""
    n = len(shingles)
    seen = np.zeros(n, np.int64)
    if n and len(tokens):
        at = np.minimum(np.searchsorted(tokens, shingles), len(tokens) - 1)
        seen = np.where(tokens[at] == shingles, times[at], 0)
    return shingles[np.lexsort((shingles, seen))[: n - int(np.ceil(similarity * n - 1e-6)) + 1]]


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bits that are set where an odd number of the shingles fall."""
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % (64 * MARKS), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _near(similarity: float):
    """False only where the sizes or the marks of a and b prove that the similarity is less."""
    apart = sum((F.bit_count(F.col("mark_a")[k].bitwiseXOR(F.col("mark_b")[k])) for k in range(1, MARKS)), F.bit_count(F.col("mark_a")[0].bitwiseXOR(F.col("mark_b")[0])))
    sizes = F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b")
    return sizes & (apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) + 1e-6)


def _nodes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    most = SHORT / similarity
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs, words, most))

    def run(batches):
        tokens, times = sent.value
        for batch in in_pieces(batches):
            rows = ([], [], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                whole, own = shingle_set(text.as_py(), words)
                node = xxhash.xxh64_intdigest(whole, 3)
                first = prefix(own, tokens, times, similarity).view(np.int64) if len(own) < most else []
                for column, value in zip(rows, (doc, node - (1 << 64) if node >> 63 else node, len(own), views(own), parity(own), first)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["doc_id", "key", "n", "sig", "mark", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, key long, n int, sig array<long>, mark array<long>, prefix array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(key, set) of the texts wanted (doc_id, key); hashes are made again, as most texts are never compared."""

    def run(batches):
        for batch in in_pieces(batches):
            keys, sets = [], []
            for text in batch.column(0).cast(pa.binary()):
                whole, own = shingle_set(text.as_py(), words)
                key = xxhash.xxh64_intdigest(whole, 3)
                keys.append(key - (1 << 64) if key >> 63 else key)
                sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["key", "set"])

    ids = wanted.select("doc_id").distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    some = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text")
    every = some.mapInArrow(run, "key long, set array<long>")
    return every.join(wanted.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Of the pairs (a, b) those of enough similarity: by size, by parity marks, then by the shingles."""
    side = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "mark", "doc_id", "key")])
    both = pairs.join(side("a"), "a").where("n_a > 0").join(side("b"), "b").where(_near(similarity))
    near = scratch.written(both.select("a", "b", "doc_id_a", "doc_id_b", "key_a", "key_b"), "near")
    of = lambda x: near.select(F.col(f"doc_id_{x}").alias("doc_id"), F.col(f"key_{x}").alias("key"))
    wanted = scratch.written(of("a").unionByName(of("b")).distinct(), "wanted")
    sets = scratch.written(_sets(docs, wanted, words), "sets")
    compared = near.join(sets.select(F.col("key").alias("key_a"), F.col("set").alias("set_a")), "key_a").join(sets.select(F.col("key").alias("key_b"), F.col("set").alias("set_b")), "key_b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    links_ = scratch.written(compared.where(shared >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b"), "links")
    scratch.drop(near, wanted, sets)
    return links_


def _rotated(fp, r: int):
    """A fingerprint with block r on top."""
    by = r * WIDTH
    return F.shiftleft(fp, by).bitwiseAND(F.lit((1 << BITS) - 1)).bitwiseOR(F.shiftright(fp, BITS - by)) if by else fp


def _equal_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first block, in the order of rotations, in which fingerprints agree that a rotation shows."""
    apart = a ^ b
    first = np.full(len(a), BLOCKS, np.int64)
    for r in reversed(range(BLOCKS)):  # on the fingerprint as it is, block r is r widths from the top
        first[(apart >> np.uint64(REST - r * WIDTH)) & np.uint64((1 << WIDTH) - 1) == 0] = r
    return first


def _product(a0, a1, b0, b1):
    """Index pairs of every two ranges [a0, a1) and [b0, b1), some at a time."""
    size = (a1 - a0) * (b1 - b0)
    at = 0
    total = np.cumsum(size)
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
        n, wide = size[at:to], b1[at:to] - b0[at:to]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.maximum(np.repeat(wide, n), 1)
        yield np.repeat(a0[at:to], n) + k // wide, np.repeat(b0[at:to], n) + k % wide
        at = to


def near_views(k: np.ndarray, label: np.ndarray, fronts=None, bit: int = REST - 1, equal: bool = True):
    """(i, j, bits) of places of different labels whose fingerprints differ in BUDGET bits at most, in chunks.

    k: (view * BLOCKS + rotation) << BITS | the rotated fingerprint, in whole blocks, ordered by k and label. A pair is
    found in the first rotation only in which it agrees on the block; ``equal``: those of equal fingerprints as well.
    """
    k = k.astype(np.uint64)
    change = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    end = np.append(change[1:], len(k))
    v = k[change]
    mixed = label[end - 1] != label[change]
    rotation = ((v >> np.uint64(BITS)) % np.uint64(BLOCKS)).astype(np.int64)
    # places of labels, from 0; fingerprints of several labels have a place of their own, so that nothing is skipped
    _, place = np.unique(label[change], return_inverse=True)
    place = np.where(mixed, len(v) + np.arange(len(v)), place)
    if equal:  # nodes of an equal fingerprint, each with those of later labels; by the trie, these are no pairs
        for x in np.flatnonzero(mixed & (rotation == 0)).tolist():
            at = np.arange(change[x], end[x])
            after = change[x] + np.searchsorted(label[change[x] : end[x]], label[at], "right")
            for i, j in _product(at, at + 1, after, np.full(len(at), end[x])):
                yield i, j, np.zeros(len(i), np.int64)
    if fronts is None:
        head = v >> np.uint64(REST)
        first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        last = np.append(first[1:], len(v))
        many = last - first > 1
        a, b = first[many], last[many]
        given = [(a, b, a.copy(), b.copy(), np.zeros(len(a), np.int64))] if many.any() else []
    else:
        given = fronts(v)
    full = np.uint64((1 << BITS) - 1)
    for i, j in trie_pairs(v, given, bit, BUDGET, place, LEAF):
        by = np.uint64(WIDTH) * rotation[i].astype(np.uint64)
        back = lambda x: ((x >> by) | (x << (np.uint64(BITS) - by))) & full  # noqa: B023, E731
        first = _equal_block(back(v[i] & full), back(v[j] & full)) == rotation[i]
        i, j = i[first], j[first]
        for x, y in _product(change[i], end[i], change[j], end[j]):
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            yield x, y, np.bitwise_count((k[x] ^ k[y]) & full).astype(np.int64)


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _nearest(k, node, label, **how):
    """(a, b): each node with its nearest partner within AT_FIRST bits, the first by label and node of equally near ones."""
    best = np.full(len(k), np.iinfo(np.int64).max)
    rank = np.empty(len(k), np.int64)
    by = np.lexsort((node, label))
    rank[by] = np.arange(len(k))
    for x, y, bits in near_views(k, label, **how):
        near = bits <= AT_FIRST
        x, y, bits = x[near], y[near], bits[near]
        np.minimum.at(best, x, bits * len(k) + rank[y])
        np.minimum.at(best, y, bits * len(k) + rank[x])
    x = np.flatnonzero(best != np.iinfo(np.int64).max)
    y = by[best[x] % len(k)]
    both = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]), axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], schema=_FOUND)


def _all(k, node, label, **how):
    """(a, b) of every two partners of which one is of no crowd, and (a, null) of the nodes of a crowd."""
    degree = np.zeros(len(k), np.int64)
    for x, y, _ in near_views(k, label, **how):
        np.add.at(degree, x, 1)
        np.add.at(degree, y, 1)
    crowd = degree > CROWD
    for x, y, _ in near_views(k, label, **how):
        few = ~(crowd[x] & crowd[y])
        x, y = node[x[few]], node[y[few]]
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=_FOUND)
    own = np.unique(node[crowd])
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.int64())], schema=_FOUND)


def _found(tables: list, pick, **how):
    t = pa.Table.from_batches(tables) if isinstance(tables, list) else tables
    k, node, label = (t.column(c).to_numpy() for c in ("k", "node", "label"))
    order = np.lexsort((node, label, k))
    yield from pick(k[order], node[order], label[order], **how)


def _candidates(seen: DataFrame, labels: DataFrame, pick) -> DataFrame:
    """What ``pick`` makes of nodes with different labels and a near view: (a, b), and (a, null) for nodes of a crowd.

    seen: (node, view, fp); labels: (node, root) of the nodes that are connected. A task holds some blocks at a time.
    """
    rows = seen.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("label"), "view", "fp")
    spun = F.explode(F.array(*[(F.shiftleft(F.col("view") * BLOCKS + r, BITS)).bitwiseOR(_rotated(F.col("fp"), r)) for r in range(BLOCKS)]))
    rows = rows.select(spun.alias("k"), "node", "label")
    block = F.shiftright("k", REST)
    hot = rows.groupBy(block.alias("block")).count().where(F.col("count") > HOT).select("block")  # few: each has HOT rows at least
    hot = [r.block for r in hot.collect()]

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            head = batch.column(0).to_numpy() >> REST
            start = 0
            if size >= HOT and len(head):  # the partition is sorted: cut where a block ends
                cut = 0 if head[0] != last else int(np.searchsorted(head, last, "right"))
                if cut < len(head):
                    held.append(batch.slice(0, cut))
                    yield from _found(held, pick)
                    held, size, start = [], 0, cut
            if batch.num_rows:
                held.append(batch.slice(start))
                size += batch.num_rows - start
                last = head[-1]
        if held:
            yield from _found(held, pick)
        held = []
        release()

    cold = rows.where(~block.isin(hot)) if hot else rows
    found = cold.repartition(block).sortWithinPartitions("k").mapInArrow(run, "a long, b long")
    return found.unionByName(_hot_candidates(rows.where(block.isin(hot)), pick)) if hot else found


def _hot_candidates(rows: DataFrame, pick) -> DataFrame:
    """The same for blocks of many rows: a task for each pair of trie nodes DEEPER levels down that are near enough."""
    below = REST - DEEPER
    own = F.shiftright("k", below).bitwiseAND(F.lit((1 << DEEPER) - 1))
    near = [m for m in range(1 << DEEPER) if bin(m).count("1") <= BUDGET]
    spread = rows.select("k", "node", "label", own.alias("x"), F.explode(F.array(*map(F.lit, near))).alias("m")).withColumn("y", F.col("x").bitwiseXOR(F.col("m")))
    dealt = spread.select(F.shiftright("k", REST).alias("block"), F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "k", "node", "label")

    def run(key, got):
        lo, hi = key[1].as_py(), key[2].as_py()

        def fronts(v):
            n = len(v)
            at = int(np.searchsorted((v >> np.uint64(below)) & np.uint64((1 << DEEPER) - 1), lo, "right"))
            if lo == hi:
                return [tuple(np.array([x]) for x in (0, n, 0, n, 0))] if n > 1 else []
            spent = bin(lo ^ hi).count("1")
            return [tuple(np.array([x]) for x in (0, at, at, n, spent))] if 0 < at < n else []

        # equal fingerprints meet where lo is hi
        return pa.Table.from_batches(_found(got, pick, fronts=fronts, bit=below - 1, equal=lo == hi), _FOUND)

    return dealt.groupBy("block", "lo", "hi").applyInArrow(run, "a long, b long")


def _unconnected(firsts: DataFrame, nodes: DataFrame, tree: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """All pairs (a, b) of nodes that share a shingle of their prefixes (node, prefix) and are not connected in the tree."""
    w = Window.partitionBy("token")
    held = firsts.where("size(prefix) > 0").select("node", F.explode("prefix").alias("token"))
    often = held.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    held = scratch.written(held.join(often, "token"), "held")
    labelled = held.join(tree.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("token", "node", F.coalesce("root", "node").alias("label"))
    mixed = labelled.withColumns({"lo": F.min("label").over(w), "hi": F.max("label").over(w)}).where("lo != hi").drop("lo", "hi")
    mixed = scratch.written(mixed.join(nodes.select("node", "n", "mark"), "node"), "mixed")
    side = lambda x: mixed.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "mark", "label")])
    both = side("a").join(side("b"), "token").where((F.col("label_a") < F.col("label_b")) & _near(similarity))
    pairs = scratch.written(both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "pairs")
    scratch.drop(held, mixed)
    return pairs


def _firsts(crowd: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, prefix) of the nodes of crowd (node, doc_id), in an order of shingles of their own."""
    some = crowd if crowd.count() > BROADCAST_IDS else F.broadcast(crowd)
    texts = docs.select("doc_id", "text").join(some, "doc_id").dropDuplicates(["node"])
    sent = docs.sparkSession.sparkContext.broadcast(_common(texts, words, float("inf")))

    def run(batches):
        for batch in in_pieces(batches):
            own = [prefix(shingle_set(t.as_py(), words)[1], *sent.value, similarity).view(np.int64) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["node", "prefix"])

    return texts.select("node", "text").mapInArrow(run, "node long, prefix array<long>")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, group): the smallest doc_id that each row is linked to, itself included.

    Texts without words (null, empty, blank) are one group, linked to no other; so are those of equal words, and
    repeated rows. A null doc_id counts as the smallest. Texts are read whole, whatever their length. Columns other
    than doc_id and text are not read. An empty table gives an empty one.
    """
    scratch = Scratch()
    own = scratch.written(_nodes(docs, words, similarity), "views")
    one = own.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("sig", "mark", "prefix")]).where("doc_id is not null")
    nodes = scratch.written(one.withColumn("node", F.monotonically_increasing_id()), "nodes")
    names = scratch.written(own.select("doc_id", "key"), "names")
    scratch.drop(own)
    seen = nodes.where("n > 0").select("node", F.posexplode("sig").alias("view", "fp")).withColumn("view", F.col("view").cast("long"))
    view = F.shiftleft("view", BITS).bitwiseOR(F.col("fp")).alias("k")
    least = seen.groupBy(view).agg(F.min("node").alias("least"), F.count("*").alias("c")).where("c > 1").select("k", "least")
    stars = seen.select(view, "node").join(least, "k").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links_ = _verified(stars, nodes, docs, words, similarity, scratch)
    tree = components(links_)
    firsts = [nodes.select("node", "prefix")]
    for pick in (_nearest, _all):
        found = scratch.written(_candidates(seen, tree, pick).distinct(), "found")
        links_ = links_.unionByName(_verified(found.where("b is not null"), nodes, docs, words, similarity, scratch))
        crowd = scratch.written(found.where("b is null").select(F.col("a").alias("node")).join(nodes.select("node", "doc_id"), "node"), "crowd")
        scratch.drop(found)
        dropped(tree)
        tree = components(links_)
    firsts.append(_firsts(crowd, docs, words, similarity))
    rest = [_unconnected(own, nodes, tree, similarity, scratch) for own in firsts]
    links_ = links_.unionByName(_verified(rest[0].unionByName(rest[1]).distinct(), nodes, docs, words, similarity, scratch))
    dropped(tree)
    whole = components(links_)
    grouped = nodes.select("node", "key", "doc_id").join(whole, "node", "left").select("key", "doc_id", F.coalesce("root", "node").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("doc_id").alias("group"))
    named = grouped.join(smallest, "root").select("key", "group")
    out = written(names.join(named, "key", "left").select("doc_id", F.coalesce("group", "doc_id").alias("group")), "groups")
    dropped(whole)
    scratch.drop()
    return out


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near-copies: the one of the smallest doc_id, and one row of equal ones.

    Rows without a doc_id cannot be told apart and stay. Columns stay as they are.
    """
    groups = near_copies(docs, words, similarity)
    first = groups.where("doc_id = group").select("doc_id").distinct()
    stay = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.select(*docs.columns).unionByName(docs.where("doc_id is null"))
