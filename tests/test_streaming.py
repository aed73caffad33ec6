"""Streams over the event log, in several batches, against the same on the whole table."""

import pytest
from pyspark.sql import functions as F

from panelframe.operators import ledger as L
from panelframe.streaming import ledger as S

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """The log's events in four files, in order, as a stream and as a table."""
    folder = tmp_path_factory.mktemp("log")
    events = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(4):
        events.where(f"event_id div 250 = {k}").coalesce(1).orderBy("event_id").write.mode("append").parquet(f"file://{folder}/log")
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/log")
    return stream, events, folder


def run(df, mode, folder, name, spark):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"file://{folder}/ckpt_{name}").start()
    q.awaitTermination(180)
    return spark.table(name)


def test_window_counts(spark, log):
    stream, events, folder = log
    got = run(S.windowed_counts(stream(), "ts", ["event_type"], late="365 days"), "update", folder, "win", spark).groupBy("start", "event_type").agg(F.max("n").alias("n"))
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count()
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == sorted((r["w"]["start"], r["event_type"], r["count"]) for r in want.collect())


def test_change_feed(spark, log):
    stream, events, folder = log
    got = run(S.change_feed(stream(), "user_id", "event_id", "event_type", {"purchase"}), "append", folder, "feed", spark)
    want = L.change_feed(events, "user_id", "event_id", ["event_type"], F.col("event_type") == "purchase")
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in want.collect())


def test_ledger_upsert(spark, log):
    stream, events, folder = log
    shape = lambda df: df.select(F.col("user_id").alias("session"), (F.col("event_id") % 12).cast("int").alias("step"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    path = f"file://{folder}/ledger"
    q = S.upsert_ledger(shape(stream()), path).trigger(availableNow=True).option("checkpointLocation", f"file://{folder}/ckpt_ledger").start()
    q.awaitTermination(180)
    last = spark.read.parquet(path).agg(F.max("version")).first()[0]
    got = spark.read.parquet(f"{path}/version={last}")
    assert sorted(map(tuple, got.select("session", "step", "status", "seq").collect())) == sorted(map(tuple, L.step_ledger(shape(events)).select("session", "step", "status", "seq").collect()))


def test_events_once(spark, log):
    stream, events, folder = log
    twice = stream().withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    got = run(S.once(twice, "ts", ["event_id"], late="365 days"), "append", folder, "once", spark)
    assert got.count() == events.count()


def test_story_memory(spark, log):
    stream, events, folder = log
    shape = lambda df: df.select((F.col("user_id") % 3).alias("series"), F.col("event_id").alias("idx"), F.col("event_type").alias("name"), F.lit("e").alias("event"))
    got = run(S.story_memory(shape(stream())), "update", folder, "memory", spark).groupBy("series", "name").agg(F.max_by(F.struct("first_seen", "last_seen", "mentions"), "mentions").alias("m"))
    want = shape(events).groupBy("series", "name").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.count(F.lit(1)).alias("n"))
    assert sorted((r["series"], r["name"], *r["m"]) for r in got.collect()) == sorted(map(tuple, want.collect()))


def test_stalled_runs_are_told_once(spark, log):
    stream, events, folder = log
    got = run(S.stalls(stream().where("user_id % 5 = 0"), "user_id", "ts", 3600), "append", folder, "stalls", spark).collect()
    newest = events.agg(F.max("ts")).first()[0]
    assert got and all((newest - r["last"]).total_seconds() > 3600 for r in got)
