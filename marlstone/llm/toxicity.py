"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear models of hashed words; each model also gets the
probabilities of the categories before it. For training these come from models that had not seen the row (out of fold),
as they will at scoring time. Categories are columns of the labels; where these only tell toxic rows from others, the
toxic ones are split into kinds by the words that set them apart from the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, plain, table
from .linear import EXTRA, SIZE, follow_the_leader, in_slices, lists, squash, sums, tail
from .quality import SAMPLE, sampled

#: Kinds that toxic rows are split into where no column names them, and the features that the split looks at.
SPLIT, TELLING = 3, 256
FOLDS = 3
#: Settings that did best on labelled rows that a model had not seen: words, their first 6 and 8 bytes, each once and
#: more than once; few weights other than zero.
KINDS = {"pairs": False, "shapes": False, "prefixes": (6, 8), "twice": True}
HOW = {"epochs": 5, "alpha": 1.0, "l1": 2.0, "l2": 0.0}


def learned_kinds(rows: list[np.ndarray], toxic: np.ndarray, kinds: int = SPLIT, rounds: int = 10) -> np.ndarray:
    """A 0/1 column a kind: the toxic rows in groups of like words, by k-means of angles from rows far apart.

    Rows are given by their features. Kinds without rows are all zero.
    """
    out = np.zeros((len(rows), kinds))
    own = np.flatnonzero(toxic == 1)
    if not len(own):
        return out
    count = lambda which: np.bincount(np.concatenate([rows[i] for i in which]) if len(which) else np.zeros(0, np.int64), minlength=SIZE)
    rest = np.flatnonzero(toxic != 1)
    lift = count(own) / len(own) - count(rest) / max(len(rest), 1)
    telling = np.sort(np.argsort(-lift, kind="stable")[:TELLING])
    x = np.array([np.isin(telling, rows[i], assume_unique=True) for i in own], float)
    x /= np.maximum(np.sqrt(x.sum(1)), 1)[:, None]
    seeds = [int(np.argmax(x.sum(1)))]
    while len(seeds) < min(kinds, len(own)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    centres = x[seeds]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        centres = np.array([x[near == k].mean(0) if (near == k).any() else centres[k] for k in range(len(centres))])
        centres /= np.maximum(np.sqrt((centres**2).sum(1)), 1e-12)[:, None]
    out[own, near] = 1
    return out


def fit_chain(rows: DataFrame, categories: list[str], last: str = "toxic", kinds: int = SPLIT, **how) -> list[np.ndarray]:
    """A model for each link, in order, from a bounded set of rows (text, *categories, last), learned in one task.

    Without categories the first ``kinds`` links are learned from the rows of the last.
    """
    columns = [*categories, last]
    own = rows.select("_ms_hash", "text", F.array(*[F.col(c).cast("int") for c in columns]).alias("y"))
    links = len(columns) if categories else kinds + 1
    settings = HOW | how

    def hashed(batches):
        for batch in in_pieces(batches):
            for at, texts in in_slices(batch.column(1)):
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists(texts, **KINDS), pa.list_(pa.int64())), part.column(2)], ["h", "f", "y"])

    def learn(batches):
        x, y = [], []
        for batch in batches:
            x += [np.array(v.as_py(), np.int64) for v in batch.column(1)]
            y += batch.column(2).to_pylist()
        if not x:
            return
        y = np.array(y, float)
        if not categories:
            y = np.column_stack([learned_kinds(x, y[:, 0], kinds), y])
        fold = np.arange(len(x)) % FOLDS
        before = np.zeros((len(x), 0))
        for k in range(links):
            w = follow_the_leader(x, y[:, k], before, **settings)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(w[at])], ["link", "at", "w"])
            if k == links - 1:
                break
            unseen = np.zeros(len(x))
            for f in range(FOLDS):
                rest = np.flatnonzero(fold != f)
                v = follow_the_leader([x[i] for i in rest], y[rest, k], before[rest], **settings) if len(rest) else np.zeros(SIZE + 1 + EXTRA)
                for i in np.flatnonzero(fold == f):
                    unseen[i] = squash(v[x[i]].sum() + tail(v, before[i : i + 1])[0])
            before = np.column_stack([before, unseen])

    got = own.mapInArrow(hashed, "h long, f array<long>, y array<int>").coalesce(1).sortWithinPartitions("h", "f").mapInArrow(learn, "link long, at long, w double").toArrow()
    out = [np.zeros(SIZE + 1 + EXTRA) for _ in range(links)]
    for k, at, w in zip(*(got.column(c).to_numpy() for c in ("link", "at", "w"))):
        out[k][at] = w
    return out


def score_chain(docs: DataFrame, models: list[np.ndarray], links: list[str]) -> DataFrame:
    """All columns of docs and ``p_<link>`` for each link, from the whole text; null is the empty text.

    Columns of docs so named are replaced.
    """
    names = [f"p_{c}" for c in links]
    docs = docs.drop(*names)
    chain = docs.sparkSession.sparkContext.broadcast(models)
    at_text = docs.columns.index("text")

    def run(batches):
        own = chain.value
        for batch in in_pieces(batches):
            out = np.zeros((len(own), batch.num_rows))
            for at, texts in in_slices(batch.column(at_text)):
                before = np.zeros((len(texts), 0))
                for k, x in enumerate(sums(texts, own, **KINDS)):
                    p = squash(x + tail(own[k], before))
                    out[k, at : at + len(texts)] = p
                    before = np.column_stack([before, p])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], [*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, fields + "".join(f", `{n}` double" for n in names))


def toxicity(docs: DataFrame, source: DataFrame, labels: DataFrame, categories: list[str] = (), sample: int = SAMPLE, kinds: int = SPLIT) -> DataFrame:
    """docs with the chain's probabilities, the last of them p_toxic.

    The chain is fitted on ``sample`` labelled rows of source at most. categories: columns of the labels; without any,
    ``kinds`` are learned and named kind_1 and so on. Labels of unknown documents and null labels are left out, equal
    labelled rows count as often as they are there; without any label all probabilities are one half. Rows with null
    or empty texts are scored as empty texts; no row goes, and other columns pass through.
    """
    categories = list(categories)
    links = [*(categories or [f"kind_{k + 1}" for k in range(kinds)]), "toxic"]
    rows = sampled(source, labels, [*categories, "toxic"], sample, seed=2)
    return score_chain(plain(docs), fit_chain(rows, categories, kinds=kinds), links)


def op2_classifier_chain(spark, sf_dir: str) -> DataFrame:
    """Probabilities of the learned kinds and of toxicity of every document, and 1 where the last is over one half.

    Null and empty texts are scored as empty ones; every row gives one, repeated ones too; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, docs, table(spark, sf_dir, "labels"))
    kinds = [f"p_kind_{k + 1}" for k in range(SPLIT)]
    return scored.select("doc_id", *kinds, "p_toxic", (F.col("p_toxic") > 0.5).cast("int").alias("toxic"))
