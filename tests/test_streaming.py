"""Streams give what the batch operators give on the same rows."""

from pyspark.sql import functions as F

from docloom import streaming
from docloom.functions.thresholds import detect
from docloom.operators import overlay
from docloom.sources.fixtures import manual_lines

SF = "/root/testdata/sf0.001"


def drain(writer, folder):
    q = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def test_stream_of_lines(spark, tmp_path):
    lines = manual_lines(spark, SF).select("manual_id", "line_no", "page", "text")
    lines.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    drain(streaming.thresholds(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out"), tmp_path)
    cols = ["manual_id", "line_no", "threshold_id", "pattern_id", "at", "status"]
    want = detect(lines.withColumn("source", F.concat(F.lit("p."), (F.col("page") + 1).cast("string"), F.lit(" / text")))).select(cols)
    got = spark.read.parquet(f"{tmp_path}/out").select(cols)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_latest_changes_survive_a_repeated_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(5).write.parquet(f"{tmp_path}/in")
    key, order = ["user_id"], ["ts", "event_id"]
    read = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    drain(streaming.keep_latest(read(), f"{tmp_path}/log", key, order), tmp_path)
    want = overlay.latest(events, key, order)
    assert streaming.current(spark, f"{tmp_path}/log", key, order).exceptAll(want).count() == 0
    drain(streaming.keep_latest(read(), f"{tmp_path}/log", key, order), f"{tmp_path}/again")
    got = streaming.current(spark, f"{tmp_path}/log", key, order)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    small = streaming.compact(spark, f"{tmp_path}/log", f"{tmp_path}/small", key, order)
    assert small.count() == want.count() and small.exceptAll(want).count() == 0


def test_counts_by_time(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type")
    events.orderBy("ts").repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = streaming.counts(stream, "ts", "event_type", late="3650 days").writeStream.format("memory").queryName("by_time").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert spark.table("by_time").agg(F.sum("n")).first()[0] == events.count()
