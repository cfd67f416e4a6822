"""Text queries: documents are news, their first 80 characters the title; events are merged by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import text
from marlstone.registry import query

from .views import table

NEWS = "news AS (SELECT doc_id AS id, text[:80] AS title, text AS content, CAST(replace(source, 'src', '') AS BIGINT) % 4 + 1 AS tier, source FROM documents)"


def news(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("content"), (F.regexp_replace("source", "src", "").cast("long") % 4 + 1).alias("tier"), "source")


@query("dedup_exact", f"WITH {NEWS} SELECT min(id) AS id FROM news GROUP BY md5(title || content)[:16]")
def dedup_exact(spark, sf_dir):
    return text.dedup_exact(news(spark, sf_dir)).select("id")


@query("dedup_prefix40", f"WITH {NEWS} SELECT min(id) AS id FROM news GROUP BY trim(title)[:40]")
def dedup_prefix40(spark, sf_dir):
    return text.dedup_prefix(news(spark, sf_dir)).select("id")


@query("dedup_jaccard")
def dedup_jaccard(spark, sf_dir):
    return text.dedup_similar(news(spark, sf_dir).select("id", "title")).select("id")


EV = "ev AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS symbol, CASE event_type WHEN 'purchase' THEN 'earnings' ELSE event_type END AS kind, CAST(ts AS DATE) AS day, CAST(json_extract(props, '$.k') AS DOUBLE) / 200 AS confidence, event_id % 5 AS source, event_id % 3 + 1 AS tier FROM events), k AS (SELECT *, md5(symbol || '|' || kind || '|' || CASE WHEN kind = 'earnings' THEN year(day) || 'Q' || quarter(day) ELSE strftime(day, '%Y-%m-%d') END)[:16] AS key FROM ev)"


def keyed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    own = e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("symbol"), F.when(F.col("event_type") == "purchase", "earnings").otherwise(F.col("event_type")).alias("kind"), F.to_date("ts").alias("day"), (F.from_json("props", "k double")["k"] / 200).alias("confidence"), (F.col("event_id") % 5).alias("source"), (F.col("event_id") % 3 + 1).alias("tier"))
    return own.withColumn("key", text.event_key(F.col("symbol"), F.col("kind"), F.col("day")))


@query("event_merge", f"WITH {EV}, g AS (SELECT key, first(confidence ORDER BY id) AS c0, count(DISTINCT source) AS n, min(tier) AS tier FROM k GROUP BY key) SELECT key, n AS source_count, tier AS max_tier, round(least(1, c0 + CASE n WHEN 1 THEN 0 WHEN 2 THEN 0.1 WHEN 3 THEN 0.3 WHEN 4 THEN 0.6 ELSE 0.9 END), 6) AS confidence FROM g")
def event_merge(spark, sf_dir):
    return text.merge_events(keyed(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("wiki_search", "WITH d AS (SELECT item_id AS id, list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(text[:60]), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda t: t <> '')) AS a, list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda t: t <> '')) AS b FROM benchmark) SELECT id, round(0.35 * len(list_intersect(['the', 'thatnd', 'in', 'heed'], a)) / 4.0::DOUBLE + 0.25 * len(list_intersect(['the', 'thatnd', 'in', 'heed'], b)) / 4.0::DOUBLE, 6) AS score FROM d WHERE score > 0.02 ORDER BY score DESC, id LIMIT 5")
def wiki_search(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.substring("text", 1, 60).alias("title"), "text")
    return text.search(b, "the thatnd in heed")


@query("inverted_index", "SELECT token, count(*) AS n FROM (SELECT item_id, unnest(list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda t: t <> ''))) AS token FROM benchmark) GROUP BY token")
def inverted_index(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return text.inverted_index(b).groupBy("token").agg(F.count("*").alias("n"))


@query("upsert_events", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'updated' ELSE event_type END AS event_type FROM events UNION ALL SELECT -event_id, 'new' FROM events WHERE event_id % 100 = 7")
def upsert_events(spark, sf_dir):
    from marlstone.sources.sinks import upsert

    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    fresh = e.where("event_id % 10 = 0").select("event_id", F.lit("updated").alias("event_type")).unionByName(e.where("event_id % 100 = 7").select((-F.col("event_id")).alias("event_id"), F.lit("new").alias("event_type")))
    return upsert(e, fresh, ["event_id"])
