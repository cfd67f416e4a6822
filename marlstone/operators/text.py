"""Deduplication and merging of news and events, and retrieval over an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.scratch import dropped, written


def content_key(title: Column, content: Column) -> Column:
    return F.substring(F.md5(F.concat(title, content).cast("binary")), 1, 16)


def first_by(df: DataFrame, key: Column, *order) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy("_k").orderBy(*order)
    return df.withColumn("_k", key).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_k", "_rn")


def dedup_exact(news: DataFrame) -> DataFrame:
    return first_by(news, content_key(F.col("title"), F.col("content")), "id")


def dedup_prefix(news: DataFrame, n: int = 40) -> DataFrame:
    return first_by(news, F.substring(F.trim("title"), 1, n), "id")


def title_tokens(title: Column) -> Column:
    """Different words of a title: lower case, signs gone, white space collapsed."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " ")
    return F.array_distinct(F.filter(F.split(F.trim(plain), " "), lambda t: t != ""))


def dedup_similar(news: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Titles accepted in order of id: one goes if an accepted one before it has a token similarity of ``threshold``.

    Of titles of equal words only the first can stay, so that these are one from the start and are never paired.
    Candidates share one of the rarest words that two so similar titles must share (prefix filter). A title falls as
    soon as one that stays is near and before it; those with no open title before them stay. Chains settle from the
    front, a link a round, and every round settles some. What a round leaves is written, so that plans stay as small as
    the first one's. Titles without words, and null ones, all stay.
    """
    titled = news.select("id", F.array_sort(title_tokens(F.col("title"))).alias("t")).where(F.size("t") > 0)
    own = titled.groupBy("t").agg(F.min("id").alias("id"))
    words = own.select("id", F.explode("t").alias("w"))
    rarity = words.groupBy("w").agg(F.count("*").alias("n"))
    ordered = words.join(rarity, "w").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("o"))
    need = F.size("o") - F.ceil(F.size("o") * threshold).cast("int") + 1
    prefix = ordered.select("id", F.size("o").alias("n"), F.explode(F.slice("o", F.lit(1), need)).alias("p")).select("id", "n", "p.w")
    sets = own.select("id", "t")
    sizes = F.least("a.n", "b.n") >= F.lit(threshold) * F.greatest("a.n", "b.n")
    cand = prefix.alias("a").join(prefix.alias("b"), (F.col("a.w") == F.col("b.w")) & (F.col("a.id") < F.col("b.id")) & sizes).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    both = cand.join(sets.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    open_ = written(both.where(shared >= F.lit(threshold) * (F.size("ta") + F.size("tb") - shared)).select("a", "b"), "similar")
    fallen = open_.select(F.col("b").alias("id")).limit(0)
    paths = []
    while not open_.isEmpty():
        # those of the open pairs that nothing open precedes stay
        stays = open_.select(F.col("a").alias("id")).distinct().join(open_.select(F.col("b").alias("id")), "id", "left_anti")
        falls = written(open_.join(stays, open_.a == stays.id, "left_semi").select(F.col("b").alias("id")).distinct(), "fallen")
        paths.append(falls._path)
        fallen = falls.sparkSession.read.schema(falls.schema).parquet(*paths)
        # the pairs of one that stays go too, as their other title has fallen
        rest = written(open_.join(falls, open_.a == falls.id, "left_anti").join(falls, F.col("b") == falls.id, "left_anti").select("a", "b"), "similar")
        dropped(open_)
        open_ = rest
    copies = titled.join(own.select("id"), "id", "left_anti").select("id")
    return news.join(fallen.unionByName(copies), "id", "left_anti")


def event_key(symbol: Column, kind: Column, day: Column) -> Column:
    """Earnings count by quarter, other events by day."""
    when = F.when(kind == "earnings", F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return F.substring(F.md5(F.concat_ws("|", symbol, kind, when).cast("binary")), 1, 16)


def merge_events(events: DataFrame) -> DataFrame:
    """One row a key: its sources, and the first confidence with a boost for each further source, at most 1."""
    g = events.groupBy("key").agg(F.min_by("confidence", "id").alias("c0"), F.countDistinct("source").alias("source_count"), F.min("tier").alias("max_tier"))
    more = F.sequence(F.lit(1), F.greatest(F.col("source_count") - 1, F.lit(1)).cast("int"))
    boost = F.when(F.col("source_count") > 1, F.aggregate(more, F.lit(0.0), lambda s, i: s + F.least(i * 0.1, F.lit(0.3)))).otherwise(0.0)
    return g.select("key", "source_count", "max_tier", F.least(F.col("c0") + boost, F.lit(1.0)).alias("confidence"))


def inverted_index(docs: DataFrame) -> DataFrame:
    """(token, id) of every different token."""
    return docs.select("id", F.explode(title_tokens(F.col("text"))).alias("token"))


def search(docs: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Best k documents by the share of the query's words in the title (weight .35) and in the text (.25), over .02."""
    words = F.array_distinct(F.split(F.lit(query.lower()), " "))
    share = lambda t: F.size(F.array_intersect(words, t)) / F.size(words)
    score = 0.35 * share(title_tokens(F.col("title"))) + 0.25 * share(title_tokens(F.col("text")))
    return docs.select("id", F.round(score, 6).alias("score")).where("score > 0.02").orderBy(F.desc("score"), "id").limit(k)
