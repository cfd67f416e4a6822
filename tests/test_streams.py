"""Sources, sinks and state of streams: restarts, repeated deliveries, crashes, and equality with the batch queries."""

import datetime
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone import registry
from marlstone.plans import news
from marlstone.sources import alerts, loads, messages
from marlstone.streaming import merge

from .conftest import SF

DAY = datetime.date


def line(group, user, text, when=1_700_000_000, **more):
    return json.dumps({"post_type": "message", "message_type": "group", "group_id": group, "user_id": user, "raw_message": text, "time": when} | more)


ODD = ["not json", "[1]", line(1, 2, "private", message_type="private"), json.dumps({"post_type": "notice"}), line("x", None, None, "late"), line("7", "8", "digits")]


def test_messages_are_parsed_and_filtered(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert messages.read_messages(spark, path).count() == 0
    assert messages.append(path, ODD) == 6 and messages.append(path, []) == 6
    messages.append(path, [line(1, 2, "two\nlines"), line(5, 2, "é")], log=3)
    rows = {(r.log, r.offset): r for r in messages.read_messages(spark, path).collect()}
    assert set(rows) == {(0, 4), (0, 5), (3, 0), (3, 1)}
    assert (rows[0, 4].group_id, rows[0, 4].user_id, rows[0, 4].time) == (None, None, None) and rows[0, 5].group_id == 7
    assert rows[3, 0].message == "two\nlines" and rows[3, 0].time.timestamp() == 1_700_000_000
    assert [r.group_id for r in messages.read_messages(spark, path, [5, 9]).collect()] == [5]


def drain(stream, out, checkpoint):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_messages_survive_restarts(spark, tmp_path):
    """Nothing is lost or given twice over three runs with one checkpoint, a failed batch among them."""
    path, out, checkpoint = f"file://{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    stream = lambda: messages.stream_messages(spark, path, [1, 2])
    messages.append(path, [line(k % 3, k, f"m{k}") for k in range(50)])
    drain(stream(), out, checkpoint)
    messages.append(path, [line(k % 3, k, f"m{k}") for k in range(50, 70)])
    messages.append(path, [line(k % 3, k, f"n{k}") for k in range(20)], log=1)

    def fail(batch, _):
        batch.count()
        raise ValueError("on the way")

    q = stream().writeStream.foreachBatch(fail).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(Exception):
        q.awaitTermination()
    messages.append(path, [line(1, k, f"m{k}") for k in range(70, 75)])
    drain(stream(), out, checkpoint)
    drain(stream(), out, checkpoint)
    got = sorted(r.message for r in spark.read.parquet(out).collect())
    assert got == sorted([f"m{k}" for k in range(70) if k % 3] + [f"n{k}" for k in range(20) if k % 3] + [f"m{k}" for k in range(70, 75)])


def test_lost_segments_are_an_error(tmp_path):
    path = f"file://{tmp_path}/log"
    messages.append(path, [line(1, 1, "a")])
    with pytest.raises(RuntimeError):
        messages._parts(path, {}, {"0": 5})


def test_collect_gives_the_first_poll_with_messages(spark, tmp_path):
    path, checkpoint = f"file://{tmp_path}/log", f"{tmp_path}/checkpoint"
    messages.append(path, [line(9, k, "other") for k in range(3)])
    messages.append(path, [line(1, 1, "first"), line(9, 1, "other"), line(1, 2, "second")])
    wanted = messages.stream_messages(spark, path, [1])
    assert messages.collect(wanted, f"{tmp_path}/a", checkpoint)
    batch = messages.first_poll(messages.read_messages(spark, path, [1]))
    assert sorted(r.message for r in spark.read.parquet(f"{tmp_path}/a").collect()) == sorted(r.message for r in batch.collect()) == ["first", "second"]
    assert not messages.collect(messages.stream_messages(spark, path, [1]), f"{tmp_path}/b", checkpoint, timeout=4)
    messages.append(path, [line(1, 3, "third")])
    assert messages.collect(messages.stream_messages(spark, path, [1]), f"{tmp_path}/b", checkpoint)
    assert [r.message for r in spark.read.parquet(f"{tmp_path}/b").collect()] == ["third"]


def bars(*rows):
    return [(t, DAY(2024, 1, d), float(c)) for t, d, c in rows]


BATCHES = [bars(("A", 1, 1), ("A", 2, 2), ("B", 1, 5)), bars(("A", 2, 9), ("A", 3, 3), ("B", 1, 9), ("C", 1, 7)), bars(("A", 1, 0), ("B", 9, 6)), [(None, DAY(2024, 1, 1), 1.0), ("A", None, 1.0)]]
KEPT = sorted(bars(("A", 1, 1), ("A", 2, 2), ("B", 1, 5), ("A", 3, 3), ("C", 1, 7), ("B", 9, 6)))


def stored(spark, path):
    return sorted((r.ticker, r.date, r.close) for r in loads.loaded(spark, path).collect())


def test_loads_by_marks(spark, tmp_path):
    path = f"file://{tmp_path}/load"
    frames = [spark.createDataFrame(b, "ticker string, date date, close double") for b in BATCHES]
    infos = [loads.load_batch(f, k, path) for k, f in enumerate(frames)]
    assert infos[0] == {"rows_added": 3, "keys_updated": 2, "keys_skipped": 0} and infos[1] == {"rows_added": 2, "keys_updated": 2, "keys_skipped": 1}
    assert stored(spark, path) == KEPT
    for k, f in enumerate(frames):  # all of them once more
        assert loads.load_batch(f, k, path) == infos[k]
    assert stored(spark, path) == KEPT
    marks = {r.ticker: r["last"] for r in loads.Ledger(spark, path).marks().collect()}
    assert marks == {"A": DAY(2024, 1, 3), "B": DAY(2024, 1, 9), "C": DAY(2024, 1, 1)}


def test_loads_stop_at_the_target_and_clean(spark, tmp_path):
    path = f"file://{tmp_path}/load"
    df = spark.createDataFrame(BATCHES[0] + BATCHES[1], "ticker string, date date, close double")
    loads.load_batch(df, 0, path, target=DAY(2024, 1, 2), clean=lambda d: d.dropDuplicates(["ticker", "date"]).where("close < 9"))
    assert {(t, d.day) for t, d, _ in stored(spark, path)} <= {("A", 1), ("A", 2), ("B", 1), ("C", 1)}


@pytest.mark.parametrize("when", ["before the ledger", "after the data"])
def test_crashes_leave_what_one_load_does(spark, tmp_path, monkeypatch, when):
    path = f"file://{tmp_path}/load"
    frames = [spark.createDataFrame(b, "ticker string, date date, close double") for b in BATCHES]
    loads.load_batch(frames[0], 0, path)
    with monkeypatch.context() as m:
        if when == "before the ledger":
            m.setattr(loads.Ledger, "commit", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        else:
            m.setattr(loads.Ledger, "marks", lambda self, seen=[]: (_ for _ in ()).throw(OSError("crash")))  # noqa: B006
        with pytest.raises(OSError):
            loads.load_batch(frames[1], 1, path)
    assert stored(spark, path) == sorted(BATCHES[0])  # what has no entry is not seen
    for k in (1, 2, 3):
        loads.load_batch(frames[k], k, path)
    assert stored(spark, path) == KEPT


def test_load_stream_delivered_twice(spark, tmp_path):
    """A new checkpoint delivers all batches again under the same numbers."""
    path = f"file://{tmp_path}/load"
    for k, b in enumerate(BATCHES):
        spark.createDataFrame(b, "ticker string, date date, close double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for run in range(2):
        own = spark.readStream.schema("ticker string, date date, close double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        loads.load_stream(own, path, f"{tmp_path}/checkpoint{run}").trigger(availableNow=True).start().awaitTermination()
    assert len(stored(spark, path)) == len(KEPT) and {(t, d) for t, d, _ in stored(spark, path)} == {(t, d) for t, d, _ in KEPT}


def test_alerts_once(spark, tmp_path):
    """A task that fails, a batch that is delivered again and a sender that fails leave no alert twice."""
    path, source = f"file://{tmp_path}/outbox", f"{tmp_path}/in"
    spark.range(20).selectExpr("id as alert_id", "'warning' as level").repartition(4).write.parquet(f"{source}/0")

    def flaky(batches):
        for b in batches:
            yield b
            if not (tmp_path / "well").exists() and b.num_rows:
                raise OSError("task fails after rows")

    def run(checkpoint):
        own = spark.readStream.schema("alert_id long, level string").parquet(f"{source}/*")
        q = alerts.write_alerts(own.mapInArrow(flaky, "alert_id long, level string"), path, checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception):
        run(f"{tmp_path}/a")
    assert alerts.published(spark, path, "alert_id long, level string").count() == 0
    (tmp_path / "well").touch()
    run(f"{tmp_path}/a")
    run(f"{tmp_path}/b")  # batch 0 again
    assert sorted(r.alert_id for r in alerts.published(spark, path, "alert_id long, level string").collect()) == list(range(20))
    sent = []

    def send(alert):
        if len(sent) == 3:
            sent.append(None)
            raise ConnectionError
        sent.append(alert["alert_id"])

    with pytest.raises(ConnectionError):
        alerts.deliver(path, send)
    alerts.deliver(path, send)
    assert alerts.deliver(path, send) == 0
    ids = [s for s in sent if s is not None]
    assert len(ids) == len(set(ids))


@pytest.mark.parametrize("parts,seed", [(1, 0), (5, 1), (9, 2)])
def test_merged_events_in_any_batches(spark, tmp_path, parts, seed):
    """The last row of each key is the batch query's, however events are cut into batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", merge.ROCKSDB)
    own = news.keyed(spark, SF).withColumns({"ts": F.col("day").cast("timestamp"), "until": merge.period_end(F.col("kind"), F.col("day"))})
    part = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(parts))
    columns = ["key", "id", "source", "tier", "confidence", "ts", "until"]
    own = own.select(*columns, part.alias("part")).cache()
    for k in range(parts):
        own.where(F.col("part") == k).select(*columns).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    schema = "key string, id long, source long, tier long, confidence double, ts timestamp, until timestamp"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    last = {}

    def take(batch, _):
        for r in batch.collect():
            last[r.key] = (r.source_count, r.max_tier, round(r.confidence, 6))

    merge.merge_stream(events, late="400 days").writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = {r[0]: (r[1], r[2], r[3]) for r in con.execute(registry.oracle_sql()["event_merge"]).fetchall()}
    assert set(last) == set(want)
    for key, (n, tier, confidence) in want.items():
        assert last[key][:2] == (n, tier) and abs(last[key][2] - confidence) < 2e-6


def test_merged_events_are_forgotten(spark, tmp_path):
    """Past its period and the watermark a key begins anew; until then sources add up and repeat without effect."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", merge.ROCKSDB)
    at = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    batches = [
        [("k", 2, "x", 3, 0.5, at(1), at(2))], [("k", 1, "y", 2, 0.2, at(1, 5), at(2)), ("k", 3, "y", 9, 0.9, at(1, 6), at(2)), ("k", 4, None, 1, 0.9, at(1, 7), at(2))],
        [("other", 5, "z", 1, 0.1, at(9), at(10))], [("other", 6, "z", 1, 0.1, at(9), at(10))], [("k", 7, "w", 4, 0.7, at(9), at(10))],
    ]
    schema = "key string, id long, source string, tier long, confidence double, ts timestamp, until timestamp"
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    seen = []

    def take(batch, _):
        seen.extend((r.key, r.source_count, r.max_tier, round(r.confidence, 6)) for r in batch.collect())

    for k in range(len(batches)):  # in this order
        events = spark.readStream.schema(schema).parquet(f"{tmp_path}/now/*")
        (tmp_path / "now").mkdir(exist_ok=True)
        (tmp_path / "in" / str(k)).rename(tmp_path / "now" / str(k))
        merge.merge_stream(events, late="1 hour").writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [s for s in seen if s[0] == "k"] == [("k", 1, 3, 0.5), ("k", 2, 1, 0.3), ("k", 1, 4, 0.7)]
