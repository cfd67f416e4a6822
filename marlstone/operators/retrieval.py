"""Ranked retrieval from an index, which reads only the words asked for.

The index is a folder: ``postings`` (a row for each entry that has a word), ``tops`` (of each word and block of entries
the most that the word can add to a score there), both in buckets of words, ``entries`` and the values of their
``attributes``. A search adds up the tops of its words, scores the best blocks, and then reads only those blocks that
could still hold one of the best k; what it leaves out cannot be among them, so that the result is score_entries()'s.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.scratch import written

#: What a word adds at most by the field that it is in, of a query of one word.
FIELDS = {"title": 0.35, "keywords": 0.25, "tags": 0.15, "content": 0.075}
REGIME, TIMEFRAME, LEAST = 0.15, 0.10, 0.02
BUCKETS, BLOCK = 64, 1024
#: Best blocks that are scored first, to know what the others must reach.
FIRST = 4


def _tokens(c):
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: x != ""))


def _bucket(token, buckets: int):
    return (F.crc32(token.cast("binary")) % buckets).cast("int")


def build_index(entries: DataFrame, path: str, buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """Write the index of entries (id, title, keywords, tags, content, type, market_regime, timeframe); ids are unique."""
    empty = F.array().cast("array<string>")
    joined = lambda c: _tokens(F.array_join(F.coalesce(c, empty), " "))
    n = max(1, -(-entries.count() // block))
    own = entries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    own.select("id", "title", "type").write.mode("overwrite").parquet(f"{path}/entries")
    named = lambda kind, c: F.transform(F.coalesce(c, empty), lambda v: F.struct(F.concat(F.lit(f"\1{kind}:"), F.lower(v)).alias("token"), F.lit(kind).alias("field")))
    word = lambda field, tokens: F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(field).alias("field")))
    every = F.concat(word("title", _tokens("title")), word("keywords", joined("keywords")), word("tags", joined("tags")), word("content", _tokens(F.substring("content", 1, 200))), named("regime", "market_regime"), named("timeframe", "timeframe"))
    rows = own.select("id", "type", "block", F.explode(every).alias("t")).select("id", "type", "block", "t.*")
    has = lambda field: F.max((F.col("field") == field).cast("int")).alias(field)
    postings = rows.groupBy("token", "block", "id", "type").agg(*[has(f) for f in FIELDS]).withColumn("bucket", _bucket(F.col("token"), buckets))
    postings.repartition("bucket").sortWithinPartitions("bucket", "token", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = entries.sparkSession.read.parquet(f"{path}/postings")
    field = {f: F.col(f) * w for f, w in FIELDS.items()}
    most = F.when(F.col("token").startswith("\1regime"), REGIME).when(F.col("token").startswith("\1timeframe"), TIMEFRAME).otherwise(field["title"] + field["keywords"] + F.greatest(field["tags"], field["content"]))
    tops = stored.groupBy("bucket", "token", "block").agg(F.max(most).alias("top"))
    tops.repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/tops")
    stored.where(F.col("token").startswith("\1")).select("token").distinct().coalesce(1).write.mode("overwrite").parquet(f"{path}/attributes")


def _matching(spark: SparkSession, path: str, regime: str | None, timeframe: str | None) -> dict[str, list[str]]:
    """The index's attribute values that fit; of these there are as many as kinds of markets and time frames."""
    values = spark.read.parquet(f"{path}/attributes")
    text = lambda kind: F.substring("token", len(kind) + 3, 10_000)
    out = {}
    if regime:
        wanted = regime.lower().replace(" ", "_")
        v = text("regime")
        out["regime"] = values.where(F.col("token").startswith("\1regime:") & (v.contains(wanted) | F.lit(wanted).contains(v)))
    if timeframe:
        v = text("timeframe")
        out["timeframe"] = values.where(F.col("token").startswith("\1timeframe:") & (v.contains(timeframe.lower()) | (v == "all")))
    return {k: [r.token for r in df.collect()] for k, df in out.items()}


def _stored(spark: SparkSession, path: str, name: str, tokens: list[str], buckets: int) -> DataFrame:
    """The rows of some words; the others' buckets are not read."""
    numbers = sorted({zlib.crc32(t.encode()) % buckets for t in tokens})
    return spark.read.parquet(f"{path}/{name}").where(F.col("bucket").isin(numbers) & F.col("token").isin(tokens))


def _scored(postings: DataFrame, words: list[str], named: dict[str, list[str]], kind: str | None) -> DataFrame:
    n = float(max(len(words), 1))
    own = postings if kind is None else postings.where(F.col("type") == kind)
    word = F.col("token").isin(words)
    hits = {f: F.coalesce(F.sum(F.when(word, F.col(f))), F.lit(0)) for f in FIELDS}
    tag = F.greatest(hits["tags"].cast("double"), hits["content"] * 0.5)
    # in the order of score_entries, so that equal scores are equal to the last bit
    score = 0.35 * (hits["title"] / n) + 0.25 * (hits["keywords"] / n) + 0.15 * F.least(tag / n, F.lit(1.0))
    for name, weight in (("regime", REGIME), ("timeframe", TIMEFRAME)):
        if named.get(name):
            score = score + F.when(F.max(F.col("token").isin(named[name])), weight).otherwise(0.0)
    return own.groupBy("id").agg(score.alias("score"))


def search(spark: SparkSession, path: str, query: str, regime: str | None = None, timeframe: str | None = None, kind: str | None = None, k: int = 5, buckets: int = BUCKETS) -> DataFrame:
    """(id, title, score) of the best k entries, as score_entries() has them; equal scores by id."""
    words = list(dict.fromkeys(w for w in re.split(r"[^A-Za-z0-9_]+", query.lower()) if w))
    named = _matching(spark, path, regime, timeframe)
    tokens = [*words, *(t for own in named.values() for t in own)]
    postings = _stored(spark, path, "postings", tokens, buckets)
    tops = _stored(spark, path, "tops", tokens, buckets)
    of = lambda name: F.coalesce(F.max(F.when(F.col("token").isin(named.get(name, [])), F.col("top"))), F.lit(0.0))
    in_words = F.coalesce(F.sum(F.when(F.col("token").isin(words), F.col("top"))), F.lit(0.0)) / max(len(words), 1)
    bounds = written(tops.groupBy("block").agg((in_words + of("regime") + of("timeframe")).alias("most")), "bounds")
    best = F.broadcast(bounds.orderBy(F.desc("most"), "block").limit(FIRST).select("block"))
    first = _scored(postings.join(best, "block"), words, named, kind).orderBy(F.desc("score"), "id").limit(k).collect()
    least = first[-1].score if len(first) == k else 0.0
    titles = spark.read.parquet(f"{path}/entries")
    if least > LEAST:
        wanted = bounds.where(F.col("most") >= least - 1e-9).select("block")
        found = _scored(postings.join(wanted, "block", "left_semi"), words, named, kind)
    else:  # entries without any match come in, so that all matches have to be known
        found = written(_scored(postings, words, named, kind), "matches")
        rest = titles if kind is None else titles.where(F.col("type") == kind)
        rest = rest.join(found.select("id"), "id", "left_anti").orderBy("id").limit(k).select("id", F.lit(LEAST).alias("score"))
        found = found.unionByName(rest)
    top = found.orderBy(F.desc("score"), "id").limit(k)
    return titles.select("id", "title").join(F.broadcast(top), "id").orderBy(F.desc("score"), "id").select("id", "title", "score")
