import numpy as np
from pyspark.sql import functions as F

from panelflow.operators import monitor
from panelflow.streaming import bars
from panelflow.streaming import log, timed
from panelflow.streaming import monitor as stream


def drained(df, tmp_path, mode="append"):
    name = f"t{abs(hash(str(tmp_path)))}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def test_stream_gives_the_batch_events(spark, tmp_path):
    rng = np.random.default_rng(0)
    values = np.abs(rng.normal(0.05, 0.005, (30, 2)))
    values[20, 0], values[25, 1] = 0.3, 0.001
    rows = [("A", "BC"[j], i, float(v)) for i, row in enumerate(values) for j, v in enumerate(row)]
    updates = spark.createDataFrame(rows, "source string, target string, bar long, te double")
    folder = str(tmp_path / "in")
    for k in range(3):  # three files, in order
        updates.where(f"bar >= {10 * k} and bar < {10 * (k + 1)}").coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = sorted((r["bar"], r["event_type"], r["follower"]) for r in drained(stream.break_events(source, window=15), tmp_path))
    want = sorted((r["bar"], r["event_type"], r["follower"]) for r in monitor.breaks(updates, window=15).collect())
    assert got == want and (20, "te_spike", "B") in got and (25, "te_decay", "C") in got


def test_regime_stream(spark, tmp_path):
    rows = spark.createDataFrame([("k", 0, [0.9, 0.1]), ("k", 1, [0.1, 0.9]), ("k", 2, [0.4, 0.6])], "key string, bar long, prob array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    got = drained(stream.regime_events(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), tmp_path)
    assert [(r["bar"], r["new_value"]) for r in got] == [(1, 1.0)]


def test_event_time_bars(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = drained(bars.windowed_bars(source), tmp_path, "complete")
    want = events.groupBy(F.window("ts", "1 hour"), "event_type").count().count()
    assert len(got) == want and sum(r["n"] for r in got) == events.count()


def test_session_bars(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", 1, 1.0), ("2024-01-01 00:20:00", 1, 2.0), ("2024-01-01 02:00:00", 1, 4.0)], "t string, user_id long, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r["n"], r["total"]) for r in bars.session_bars(rows).collect()) == [(1, 4.0), (2, 3.0)]
    assert bars.windowed_bars(rows.withColumn("event_type", F.lit("x")), "1 hour", "30 minutes").count() == 4


def breaking_updates(spark, n=40):
    rng = np.random.default_rng(1)
    values = np.abs(rng.normal(0.05, 0.005, (n, 3)))
    values[20, 0], values[25, 1], values[33, 2] = 0.3, 0.001, 0.4
    rows = [("A", "BCD"[j], i, float(v)) for i, row in enumerate(values) for j, v in enumerate(row)]
    df = spark.createDataFrame(rows, "source string, target string, bar long, te double")
    return df.withColumn("ts", (F.lit("2024-01-01").cast("timestamp").cast("long") + F.col("bar") * 86_400).cast("timestamp"))


def written_in_files(updates, folder, groups):
    for rows in groups:
        updates.where(F.col("bar").isin(rows)).coalesce(1).write.mode("append").parquet(folder)


def keyed(rows):
    return sorted((r["bar"], r["event_type"], r["follower"], round(r["old_value"], 9), r["description"]) for r in rows)


def test_events_of_rows_out_of_order_and_a_restart(spark, tmp_path):
    """Stopped in the middle and started again: the batch operator's events, once each, and told once."""
    timed.use_rocksdb(spark)
    updates, folder, told = breaking_updates(spark), str(tmp_path / "in"), []
    end = updates.agg(F.max("ts").alias("ts")).select(F.lit("Z").alias("source"), F.lit("Z").alias("target"), F.lit(0).cast("long").alias("bar"), F.lit(0.0).alias("te"), (F.col("ts") + F.expr("interval 60 days")).alias("ts"))
    source = lambda: timed.timed_events(spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(folder), window=15, late="10 days")
    tell = lambda text: told.append(text) or True
    first = [[1, 0, 5, 4], [3, 2, 8, 9, 11], [*range(6, 8), 10, *range(13, 20)], [12, 21, 22, 20, 24]]
    written_in_files(updates, folder, first)
    q = log.start(source(), str(tmp_path / "log"), tell, availableNow=True)
    q.awaitTermination(300)
    assert q.exception() is None
    half = keyed(log.read(spark, str(tmp_path / "log")).collect())
    written_in_files(updates, folder, [[25, 23, 27], [26, *range(28, 40)]])
    end.coalesce(1).write.mode("append").parquet(folder)
    q = log.start(source(), str(tmp_path / "log"), tell, availableNow=True)
    q.awaitTermination(300)
    got = log.read(spark, str(tmp_path / "log")).collect()
    want = keyed(monitor.breaks(updates.drop("ts"), window=15).collect())
    assert keyed(got) == want and len(half) < len(want) and {(20, "te_spike", "B"), (25, "te_decay", "C"), (33, "te_spike", "D")} <= {w[:3] for w in want}
    assert sum(t.count("transfer entropy") for t in told) == len(want)


def test_a_repeated_batch_is_logged_and_told_once(spark, tmp_path):
    events = monitor.breaks(breaking_updates(spark).drop("ts"), window=15)
    told, folder = [], str(tmp_path / "log")
    write = log.log_batch(folder, lambda text: told.append(text) or len(told) > 1)
    for number in (0, 0, 0, 1):  # telling fails at first and is tried again
        write(events, number)
    assert sorted(tuple(r) for r in log.read(spark, folder).groupBy("batch").count().collect()) == [(0, events.count()), (1, events.count())]
    assert len(told) == 3 and log.read(spark, str(tmp_path / "none")).count() == 0


def test_a_silent_pair_is_forgotten(spark, tmp_path):
    timed.use_rocksdb(spark)
    updates = breaking_updates(spark).where("target = 'B' and bar <> 20 and bar < 30")
    later = updates.withColumns({"bar": F.col("bar") + 400, "ts": F.col("ts") + F.expr("interval 400 days")}).where("bar < 404")
    spike = later.where("bar = 403").withColumn("te", F.lit(9.0))
    rest = later.where("bar < 403")
    end = spike.withColumns({"source": F.lit("Z"), "ts": F.col("ts") + F.expr("interval 500 days")})
    folder = str(tmp_path / "in")
    for part in (updates, rest, spike, end):
        part.coalesce(1).write.mode("append").parquet(folder)
    source = lambda: spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    for forget, n in ((30 * 86_400_000, 0), (10_000 * 86_400_000, 1)):
        at = str(tmp_path / f"log{n}")
        log.start(timed.timed_events(source(), window=15, late="1 day", forget_ms=forget), at, availableNow=True).awaitTermination(300)
        assert log.read(spark, at).where("bar = 403").count() == n  # with its window lost, four values are too few to judge
