"""Streams run to their end give what the batch gives."""

from __future__ import annotations

from quillgraph.streaming import events as ev


def run(spark, df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def source(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type")
    batch.write.mode("overwrite").parquet(str(tmp_path / "events"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))


def test_windows(spark, sf_dir, tmp_path):
    batch, stream = source(spark, sf_dir, tmp_path)
    got = run(spark, ev.windowed_counts(stream), tmp_path, "windows", "complete").collect()
    assert sorted(map(str, got)) == sorted(map(str, ev.windowed_counts(batch).collect()))


def test_sessions(spark, sf_dir, tmp_path):
    batch, stream = source(spark, sf_dir, tmp_path)
    got = run(spark, ev.sessions(stream), tmp_path, "sessions", "complete").collect()
    assert sorted(map(str, got)) == sorted(map(str, ev.sessions(batch).collect()))


def test_last_operations(spark):
    rows = spark.createDataFrame([("a", 1, "add"), ("a", 2, "remove"), ("b", 1, "add")], "name string, seq int, op string")
    assert {(r.name, r.op) for r in ev.last_operations(rows, ["name"], "seq").collect()} == {("a", "remove"), ("b", "add")}
