from pyspark.sql import functions as F

from ringside.streaming import events


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def folder(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).where("event_id < 400")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/e")
    return rows, f"file://{tmp_path}/e"


def test_windows(spark, data, tmp_path):
    rows, path = folder(spark, data, tmp_path)
    found = drain(events.windowed(events.stream(spark, path), late="3650 days"), "win", "complete")
    expected = rows.groupBy(F.window("ts", "1 day").start.alias("s"), "event_type").agg(F.count("*").alias("n"))
    assert sorted((r.window_start, r.event_type, r.n) for r in found.collect()) == sorted(map(tuple, expected.collect()))


def test_running_counts(spark, data, tmp_path):
    rows, path = folder(spark, data, tmp_path)
    found = {r.event_id: r.prior_events for r in drain(events.running_counts(events.stream(spark, path)), "run").collect()}
    own = rows.select("event_id", "user_id", "ts").collect()
    assert found == {r.event_id: sum(x.user_id == r.user_id and x.ts < r.ts for x in own) for r in own}
