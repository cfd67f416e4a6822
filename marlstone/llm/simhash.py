"""SimHash fingerprints and the self-join of a binary trie over them.

The trie is a sorted array: a node is a run of it, and its children meet at the first value with the next bit set.
Node pairs are traversed together, level by level for all pairs at once; a pair whose differing bits exceed the budget
is pruned with everything below it. To share the work out, fingerprints are cut into budget + 1 blocks: two that
link agree on one block at least, so the trie of each rotation starts at that block, with nothing spent, and the
tries below different blocks never meet. Blocks that hold too many fingerprints are dealt out again as pairs of nodes
some levels further down.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, in_pieces, table, written
from .components import components

#: Fingerprints below one block that a task traverses alone, and the levels that a larger block is dealt out by.
HOT = 100_000
DEEPER = 8
#: Node pairs that a task looks at together.
FRONT = 1 << 20


def shingle_hashes(text: bytes | None, words: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of words, repeats included. Fewer words: of all of them. None: nothing."""
    if not text:
        return []
    own = text.lower().split()
    if not own:
        return []
    whole = b" ".join(own)
    h = xxhash.xxh64_intdigest
    if len(own) <= words:
        return [h(whole, seed)]
    ends = list(itertools.accumulate(map(len, own), lambda a, b: a + b + 1))
    starts = [0] + [e + 1 for e in ends]
    view = memoryview(whole)
    return [h(view[a:b], seed) for a, b in zip(starts, ends[words - 1 :])]


_LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set; bit 0 is the lowest."""
    out = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), 255):
        part = hashes[at : at + 255]
        for k in range(8):
            lanes = np.add.reduce((part >> np.uint64(k)) & _LANES)
            out[:, k] += np.frombuffer(int(lanes).to_bytes(8, "little"), np.uint8)
    return out.reshape(-1)


_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(hashes: list[int]) -> int:
    """A bit is set if it is in over half of the hashes; 0 for none. As a signed 64-bit integer."""
    if not hashes:
        return 0
    set_in = bit_counts(np.array(hashes, np.uint64))
    return int(np.add.reduce(_WEIGHTS[2 * set_in > len(hashes)], dtype=np.uint64).astype(np.int64))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of whole texts; A-Z lower-cased, words split at ASCII white space."""

    def run(batches):
        for batch in in_pieces(batches):
            texts = batch.column(1).cast(pa.binary())
            fps = pa.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def trie_pairs(v: np.ndarray, fronts: list[tuple], bit: int, budget: int, label: np.ndarray | None = None, leaf: int = 1):
    """Index pairs (i < j) of the sorted values v under the node pairs of ``fronts`` that differ in at most budget bits.

    A node pair is five arrays: first and end of either node and the bits spent; the nodes share no value unless they
    are one and the same. ``bit`` is the next to branch on. With labels, nothing within one label is looked for.
    """
    steps = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])]) if label is not None else None
    stack = [(f, bit) for f in fronts]
    while stack:
        (a, b, c, d, spent), bit = stack.pop()
        if len(a) > FRONT:
            half = len(a) // 2
            stack += [(tuple(x[:half] for x in (a, b, c, d, spent)), bit), (tuple(x[half:] for x in (a, b, c, d, spent)), bit)]
            continue
        if steps is not None:
            dull = (steps[b - 1] == steps[a]) & (steps[d - 1] == steps[c]) & (label[a] == label[c])
            a, b, c, d, spent = (x[~dull] for x in (a, b, c, d, spent))
        if leaf > 1:
            small = (b - a <= leaf) & (d - c <= leaf)
            for p, q, r, s in zip(a[small].tolist(), b[small].tolist(), c[small].tolist(), d[small].tolist()):
                i, j = np.nonzero(np.bitwise_count(v[p:q, None] ^ v[None, r:s]) <= budget)
                once = i < j if p == r else slice(None)
                i, j = i[once] + p, j[once] + r
                if len(i):
                    yield np.minimum(i, j), np.maximum(i, j)
            a, b, c, d, spent = (x[~small] for x in (a, b, c, d, spent))
        single = (b - a == 1) & (d - c == 1)
        if single.any():
            i, j = a[single], c[single]
            far = np.bitwise_count(v[i] ^ v[j]) > budget
            ok = ~far & (i != j)
            if ok.any():
                i, j = i[ok], j[ok]
                yield np.minimum(i, j), np.maximum(i, j)
            a, b, c, d, spent = (x[~single] for x in (a, b, c, d, spent))
        if not len(a):
            continue
        if bit < 0:  # equal values, which fingerprints are not
            continue
        low = np.uint64((1 << bit) - 1)

        def middle(first, end):
            # the first value of the node with the bit set
            to = (v[first] & ~low) | np.uint64(1 << bit)
            return np.clip(np.searchsorted(v, to), first, end)

        one = (a == c) & (b == d)
        m, n = middle(a, b), middle(c, d)
        nodes = (((a, m), (c, n), 0, None), ((m, b), (n, d), 0, None), ((a, m), (n, d), 1, None), ((m, b), (c, n), 1, ~one))
        out = []
        for (p, q), (r, s), cost, only in nodes:
            keep = (q > p) & (s > r) & (spent + cost <= budget)
            if only is not None:
                keep &= only
            keep &= ~((p == r) & (q == s) & (q - p == 1))
            out.append((p[keep], q[keep], r[keep], s[keep], spent[keep] + cost))
        stack.append((tuple(np.concatenate(x) for x in zip(*out)), bit - 1))


def forest(n: int, pairs) -> np.ndarray:
    """Roots of n places under the links of pairs: the smallest place that each is linked to."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _rotate(v: np.ndarray, by: int, bits: int) -> np.ndarray:
    if by == 0:
        return v
    full = np.uint64((1 << bits) - 1)
    return ((v << np.uint64(by)) | (v >> np.uint64(bits - by))) & full


def links(fps: DataFrame, budget: int = 3, bits: int = 64, spanning: bool = True) -> DataFrame:
    """(view, a, b): pairs of different fingerprints that differ in at most ``budget`` bits.

    fps: view int, fp long, label long, each (view, fp) once. ``spanning``: of the links that a task finds only as many
    as connect the same fingerprints, so that a group of n close ones costs n rows. Otherwise all links between
    different labels; a label stands for fingerprints that are connected already.
    """
    blocks = budget + 1
    width = bits // blocks
    if bits % blocks:
        raise ValueError("bits must be a multiple of budget + 1")
    rest = bits - width

    def top(rotation):
        return F.shiftrightunsigned("fp", bits - width * (rotation + 1)).bitwiseAND(F.lit((1 << width) - 1))

    dealt = fps.select("view", "fp", "label", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), top(r).alias("top")) for r in range(blocks)])).alias("k")).select("view", "k.r", "k.top", "fp", "label")
    # at most one row for each block of 2^width and view, and only of those over HOT
    hot = dealt.groupBy("view", "r", "top").count().where(F.col("count") > HOT).select("view", "r", "top", F.lit(True).alias("hot"))
    hot = written(hot, "hot")
    if hot.isEmpty():
        return _below(dealt, budget, bits, width, rest, spanning)
    marked = dealt.join(F.broadcast(hot), ["view", "r", "top"], "left")
    cold = _below(marked.where("hot is null").drop("hot"), budget, bits, width, rest, spanning)
    return cold.unionByName(_hot_below(marked.where("hot").drop("hot"), budget, bits, width, rest, spanning))


def _emit(view, v, original, label, pairs, spanning):
    if spanning:
        root = forest(len(v), pairs)
        i = np.flatnonzero(root != np.arange(len(v)))
        j = root[i]
    else:
        found = [(i[label[i] != label[j]], j[label[i] != label[j]]) for i, j in pairs]
        i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), view, np.int32)), pa.array(original[i].view(np.int64)), pa.array(original[j].view(np.int64))], ["view", "a", "b"])


def _below(dealt, budget, bits, width, rest, spanning):
    """Tries of whole blocks: those of a partition side by side, one view and rotation at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held)
            view, r, label = (t.column(c).to_numpy() for c in ("view", "r", "label"))
            fp = t.column("fp").to_numpy().view(np.uint64)
            for one in np.unique(view * 100 + r):
                own = np.flatnonzero(view * 100 + r == one)
                rotation = int(one % 100)
                v = _rotate(fp[own], width * rotation, bits)
                order = np.argsort(v)
                v, original, lab = v[order], fp[own][order], label[own][order]
                head = v >> np.uint64(rest)
                first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
                end = np.append(first[1:], len(v))
                many = end - first > 1
                if many.any():
                    a, b = first[many], end[many]
                    front = (a, b, a.copy(), b.copy(), np.zeros(len(a), np.int64))
                    yield _emit(one // 100, v, original, lab, trie_pairs(v, [front], rest - 1, budget, None if spanning else lab), spanning)

        size = 0
        last = None
        for batch in batches:
            # a block is whole within its partition; the partition is sorted, so cut between blocks only
            key = [batch.column(c).to_numpy() for c in ("view", "r", "top")]
            change = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            start = 0
            if size >= HOT and batch.num_rows:
                cut = 0 if last != tuple(k[0] for k in key) else int(change[0]) if len(change) else batch.num_rows
                if cut < batch.num_rows or last != tuple(k[0] for k in key):
                    held.append(batch.slice(0, cut))
                    yield from flush()
                    held, size, start = [], 0, cut
            if batch.num_rows:
                held.append(batch.slice(start))
                size += batch.num_rows - start
                last = tuple(k[-1] for k in key)
        if held:
            yield from flush()

    return dealt.repartition("view", "r", "top").sortWithinPartitions("view", "r", "top").mapInArrow(run, "view int, a long, b long")


def _hot_below(dealt, budget, bits, width, rest, spanning):
    """Blocks of many fingerprints: a task for each pair of nodes DEEPER levels down that are near enough."""
    deeper = min(DEEPER, rest)
    masks = [m for m in range(1 << deeper) if bin(m).count("1") <= budget]

    def spread(batches):
        for batch in batches:
            fp, r = batch.column(batch.schema.names.index("fp")).to_numpy().view(np.uint64), batch.column(batch.schema.names.index("r")).to_numpy()
            x = np.zeros(len(fp), np.int64)
            for one in np.unique(r):
                own = r == one
                x[own] = ((_rotate(fp[own], int(width * one), bits) >> np.uint64(rest - deeper)) & np.uint64((1 << deeper) - 1)).astype(np.int64)
            again = pa.array(np.repeat(np.arange(len(fp)), len(masks)))
            x = np.repeat(x, len(masks))
            y = x ^ np.tile(np.array(masks), len(fp))
            out = batch.take(again)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], [*out.schema.names, "lo", "hi"])

    def run(key, t):
        view, r, lo, hi = (int(key[k].as_py()) for k in (0, 1, 3, 4))
        fp, label = t.column("fp").to_numpy().view(np.uint64), t.column("label").to_numpy()
        v = _rotate(fp, width * r, bits)
        order = np.argsort(v)
        v, original, lab = v[order], fp[order], label[order]
        at = int(np.searchsorted((v >> np.uint64(rest - deeper)) & np.uint64((1 << deeper) - 1), lo, "right"))
        n = len(v)
        spent = bin(lo ^ hi).count("1")
        if (lo != hi and at in (0, n)) or n < 2:
            out = _emit(view, v, original, lab, [], spanning)
        else:
            a, b, c, d = (0, n, 0, n) if lo == hi else (0, at, at, n)
            front = tuple(np.array([x]) for x in (a, b, c, d, spent))
            out = _emit(view, v, original, lab, trie_pairs(v, [front], rest - deeper - 1, budget, None if spanning else lab), spanning)
        return pa.Table.from_batches([out])

    schema = "view int, r int, top long, fp long, label long, lo long, hi long"
    return dealt.select("view", "r", "top", "fp", "label").mapInArrow(spread, schema).groupBy("view", "r", "top", "lo", "hi").applyInArrow(run, "view int, a long, b long")


def simhash_components(docs: DataFrame, words: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    Equal fingerprints are one node. Null, empty and blank texts have fingerprint zero; texts of any length are read
    whole. component_id is the smallest doc_id reachable, null where all of these are null; repeated rows each have
    it. Columns other than doc_id and text are not read. An empty table gives an empty one.
    """
    own = written(fingerprints(docs, words), "fps")
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = links(nodes.select(F.lit(0).cast("int").alias("view"), "fp", F.col("fp").alias("label")), budget)
    tree = components(found)
    grouped = nodes.join(tree, nodes.fp == tree.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(grouped.join(least, "root").select("fp", "component_id"), "named")
    dropped(nodes)
    dropped(tree)
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash_components(spark, sf_dir: str) -> DataFrame:
    """Fingerprint of 3-word shingles and component of every document, linked at three differing bits or fewer.

    Null, empty and blank texts have fingerprint zero; repeated rows share theirs; other columns are not read.
    """
    return simhash_components(table(spark, sf_dir, "documents"))
