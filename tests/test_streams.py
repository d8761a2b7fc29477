"""Jobs on streams: watermarks, late rows, several micro-batches."""

import os

from pyspark.sql import functions as F

from quillon.streaming import jobs


def write(spark, folder, number, rows, schema):
    """One file a call, in the order of their times."""
    path = f"{folder}/part{number}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    name = next(f for f in os.listdir(path) if f.endswith(".parquet"))
    os.rename(f"{path}/{name}", f"{folder}/in/{number}.parquet")
    os.utime(f"{folder}/in/{number}.parquet", (1_700_000_000 + number, 1_700_000_000 + number))


def test_sessions_close_by_the_watermark_and_drop_late_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "k string, s double"
    files = [
        [("a", 0.0), ("a", 1.0), ("a", 2.5), ("b", 0.0)],
        [("a", 4.0), ("b", 50.0), ("b", 51.0)],  # the first row is out of order but in time
        [("b", 52.0)],  # the watermark is at 41 by now and closes the sequence of a
        [("a", 5.5), ("a", 100.0), ("b", 100.0)],  # the first row is late
        [("a", 200.0), ("b", 200.0)],
    ]
    for i, rows in enumerate(files):
        write(spark, tmp_path, i, rows, schema)
    stream = jobs.ingest(spark, str(tmp_path / "in"), schema, files_per_trigger=1).withColumn("ts", F.timestamp_seconds("s"))
    assert stream.isStreaming
    out = jobs.sessions(stream, ["k"], "ts", "2 seconds", "10 seconds", least=3)
    q = out.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.k, r.n, r.a, r.b) for r in spark.table("closed").selectExpr("k", "n", "unix_seconds(first) as a", "unix_seconds(last) as b").collect()}
    assert got == {("a", 4, 0, 4), ("b", 3, 50, 52)}
    assert sum(int(o.get("numRowsDroppedByWatermark", 0)) for p in q.recentProgress for o in p["stateOperators"]) == 1


def test_progress_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "unit string, planned_s double, actual_s double"
    for i, rows in enumerate([[("x", 10.0, 20.0), ("x", 10.0, None)], [("x", 20.0, None), ("y", 5.0, None)], [("x", 10.0, 10.0)]]):
        write(spark, tmp_path, i, rows, schema)
    stream = jobs.ingest(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    q = jobs.progress(stream, ["unit"]).writeStream.format("memory").queryName("progress").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 3
    got = {r.unit: (r.n_done, r.n_total, r.rate, r.remaining_s) for r in spark.table("progress").collect()}
    assert got == {"x": (2, 4, 1.5, 45.0), "y": (0, 1, 1.0, 5.0)}


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    """Bytes and folders follow the batch; an older record doesn't win; a batch that runs again changes nothing."""
    (tmp_path / "in").mkdir()
    schema = "unit string, at long, state string"
    first = [(f"u{i}", 1, "new") for i in range(400)]
    for i, rows in enumerate([first, [("u7", 2, "run"), ("u8", 0, "late")], [("u7", 3, "done"), ("u7", 2, "run")]]):
        write(spark, tmp_path, i, rows, schema)
    table = str(tmp_path / "status")
    assert jobs.status_table(spark, table, schema).count() == 0
    stream = jobs.ingest(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    jobs.status_sink(stream, table, ["unit"], ["at"], str(tmp_path / "cp"), buckets=64).awaitTermination()
    want = {f"u{i}": (1, "new") for i in range(400)} | {"u7": (3, "done")}
    assert {r.unit: (r["at"], r.state) for r in jobs.status_table(spark, table, schema).collect()} == want
    written = {e: [f for f in os.listdir(f"{table}/data/epoch={e}") if f.startswith("bucket=")] for e in range(3)}
    assert len(written[0]) > 50 and len(written[1]) <= 2 and len(written[2]) == 1
    size = lambda e: sum(os.path.getsize(os.path.join(p, f)) for p, _, fs in os.walk(f"{table}/data/epoch={e}") for f in fs)
    assert size(2) < size(0) / 10
    again = jobs.ingest(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    jobs.status_sink(again, table, ["unit"], ["at"], str(tmp_path / "cp2"), buckets=64).awaitTermination()  # all epochs run again
    assert {r.unit: (r["at"], r.state) for r in jobs.status_table(spark, table, schema).collect()} == want
