"""Nearest neighbours by score-aware (anisotropic) product quantisation.

Vectors are cut into pairs of dimensions, each with sixteen centroids: four bits. Codes and codebooks minimise a loss
that weighs the part of the residual parallel to the vector more than the rest, as that part moves the scores of the
queries that matter. A query scans the codes with a table of partial scores, two codes to a look-up, and the best of
every block of rows are scored again on the original vectors, in double precision; so are all others that their codes
and residuals do not prove to be worse than those, so that the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Vectors that the codebooks are fitted on, those of the smallest hashes. Every row is encoded and scanned.
SAMPLE = 20_000
#: Rows in a block, and those of each block that are scored exactly for each query before any bound is known.
BLOCK = 32_768
RERANK = 96
#: Queries that are sent to the executors at a time.
QUERIES = 1 << 16
CENTROIDS = 16
_SUB = 2


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def eta(dim: int, threshold: float = 0.2) -> float:
    """How much more the parallel residual weighs, for scores above the threshold."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def assign(x: np.ndarray, books: np.ndarray, weight: float, rounds: int = 2) -> np.ndarray:
    """Codes of unit vectors: nearest centroids first, then coordinate descent on the anisotropic loss."""
    n, m = len(x), len(books)
    parts = x.reshape(n, m, _SUB)
    far = ((parts[:, :, None, :] - books[None]) ** 2).sum(-1)
    codes = far.argmin(-1)
    own = (parts**2).sum(-1)
    along = own[:, :, None] - np.einsum("nms,mcs->nmc", parts, books)  # parallel residual of each choice
    rows = np.arange(n)
    total = along[rows[:, None], np.arange(m), codes].sum(1)
    for _ in range(rounds):
        for k in range(m):
            rest = total - along[rows, k, codes[:, k]]
            loss = far[:, k] + (weight - 1) * (rest[:, None] + along[:, k]) ** 2
            codes[:, k] = loss.argmin(1)
            total = rest + along[rows, k, codes[:, k]]
    return codes


def train(x: np.ndarray, rounds: int = 6, seed: int = 0) -> tuple[np.ndarray, float]:
    """Codebooks (subspaces, centroids, dimensions of one) from unit vectors, and the weight they are made for."""
    n, d = x.shape
    m = d // _SUB
    weight = eta(d)
    rng = np.random.default_rng(seed)
    parts = x.reshape(n, m, _SUB)
    books = parts[rng.integers(0, n, CENTROIDS)].transpose(1, 0, 2).copy()
    books += rng.normal(0, 1e-4, books.shape)
    for step in range(2 * rounds):
        plain = step < rounds
        codes = ((parts[:, :, None, :] - books[None]) ** 2).sum(-1).argmin(-1) if plain else assign(x, books, weight, 1)
        own = (parts**2).sum(-1)
        chosen = books[np.arange(m), codes]
        along = own - (parts * chosen).sum(-1)
        for k in range(m):
            rest = along.sum(1) - along[:, k]
            for c in range(CENTROIDS):
                who = np.flatnonzero(codes[:, k] == c)
                if not len(who):
                    continue
                p = parts[who, k]
                if plain:
                    books[k, c] = p.mean(0)
                else:
                    t = rest[who] + own[who, k]
                    left = len(who) * np.eye(_SUB) + (weight - 1) * p.T @ p
                    books[k, c] = np.linalg.solve(left, p.sum(0) + (weight - 1) * (p * t[:, None]).sum(0))
            if not plain:
                along[:, k] = own[:, k] - (parts[:, k] * books[k][codes[:, k]]).sum(-1)
    return books, weight


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def search(vectors: DataFrame, is_query, k: int = 5, *, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest cosine found for each query, ties to smaller ids.

    ``is_query``: condition on vec_id; every row of another vec_id is a candidate. Rows without an id, null, zero or
    with null or non-finite components take no part; of several dimensions only the most frequent does (the smaller of
    equals). A vec_id that several queries have is searched once, with the least of its vectors. Copies of a vector
    share a code, and the smallest ids of a block come first among them.
    """
    spark = vectors.sparkSession
    fine = _valid(vectors)
    dims = fine.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dims is None:
        return empty
    dim = dims.dim
    padded = dim + dim % _SUB
    fine = fine.where(F.size("embedding") == dim)
    sample = fine.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(SAMPLE).toArrow()
    x = np.zeros((sample.num_rows, padded))
    x[:, :dim] = _unit(_matrix(sample.column("embedding").combine_chunks(), dim))
    books, weight = train(x)
    queries = fine.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    found = None

    def scan(sent):
        def run(batches):
            qid, q = sent.value
            own: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0

            def close():
                ids, rows = (np.concatenate(z) for z in zip(*own))
                order = np.argsort(ids, kind="stable")
                return _block(ids[order], rows[order], qid, q, books, weight, k, rerank)

            for batch in batches:
                if batch.num_rows:
                    own.append((batch.column(0).to_numpy(), _matrix(batch.column(1), dim)))
                    size += batch.num_rows
                if size >= BLOCK:
                    yield close()
                    own, size = [], 0
            if own:
                yield close()

        return run

    def rounds():
        ids, rows = [], []
        for r in queries.toLocalIterator():
            ids.append(r[0])
            rows.append(np.array(r[1]))
            if len(ids) == QUERIES:
                yield np.array(ids), np.array(rows)
                ids, rows = [], []
        if ids:
            yield np.array(ids), np.array(rows)

    for one in rounds():
        sent = spark.sparkContext.broadcast(one)
        part = fine.mapInArrow(scan(sent), "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(written(part, "found"))
    if found is None:
        return empty
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(ids, rows, qid, q, books, weight, k, rerank) -> pa.RecordBatch:
    """The k best of a block (in order of ids) for each query: table scan of the codes, then exact scores."""
    m = len(books)
    dim = rows.shape[1]
    x = np.zeros((len(rows), m * _SUB))
    x[:, :dim] = _unit(rows)
    codes = np.concatenate([assign(x[a : a + 4096], books, weight) for a in range(0, len(x), 4096)]).astype(np.uint8)
    # lengths of the residuals, with room for the single precision of the scan
    left = np.sqrt(((x - books[np.arange(m), codes].reshape(x.shape)) ** 2).sum(1)) + 1e-4
    if m % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
    pairs = np.ascontiguousarray((codes[:, ::2] * 16 + codes[:, 1::2]).T)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    out = []
    for i in range(len(q)):
        y = np.zeros(m * _SUB)
        y[:dim] = q[i]
        tables = np.einsum("ms,mcs->mc", y.reshape(m, _SUB), books)
        if m % 2:
            tables = np.concatenate([tables, np.zeros((1, CENTROIDS))])
        two = (tables[::2, :, None] + tables[1::2, None, :]).reshape(len(pairs), 256).astype(np.float32)
        near = two[0][pairs[0]]
        for t, c in zip(two[1:], pairs[1:]):
            near += t[c]
        near[ids == qid[i]] = -np.inf
        most = min(rerank, len(near))
        edge = np.partition(near, len(near) - most)[len(near) - most]
        above = np.flatnonzero(near > edge)
        pick = np.sort(np.concatenate([above, np.flatnonzero(near == edge)[: most - len(above)]]))
        pick = pick[ids[pick] != qid[i]]
        exact = np.einsum("ij,j->i", rows[pick], q[i]) / (norms[pick] * np.sqrt(np.einsum("i,i->", q[i], q[i])))
        first = np.lexsort((ids[pick], -exact))[:k]
        # a score is at most that of the code and the residual's length; rows that could come among the best are scored too
        size = np.sqrt(np.einsum("i,i->", q[i], q[i]))
        least = exact[first[-1]] if len(first) == k else -np.inf
        could = near / size + left >= least
        could[pick] = False
        rest = np.flatnonzero(could)
        rest = rest[ids[rest] != qid[i]]
        if len(rest):
            more = [np.einsum("ij,j->i", rows[r], q[i]) / (norms[r] * size) for r in np.split(rest, range(4096, len(rest), 4096))]
            pick, exact = np.concatenate([pick, rest]), np.concatenate([exact, *more])
            first = np.lexsort((ids[pick], -exact))[:k]
        out.append((np.full(len(first), qid[i]), ids[pick][first], exact[first]))
    a, b, c = (np.concatenate(z) for z in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])


def op5_anisotropic_search(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector among all others, by cosine.

    Null, zero and non-finite vectors take no part; an empty table gives an empty one; other columns are not read.
    """
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
