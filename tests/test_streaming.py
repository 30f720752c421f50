from pyspark.sql import functions as F

from graphloom.streaming import coalesce_intents, intent_step, publish_batches, windowed_counts


def test_steps():
    s, seen = {}, []
    for kind, g in (("hint", ["a"]), ("hint", ["a"]), ("hint", ["b"]), ("start", None), ("hint", ["b"]), ("hint", ["c"]), ("manual", ["m"]), ("hint", ["d"]), ("finish", None), ("finish", None)):
        s, outcome = intent_step(s, {"type": kind, "generations": g})
        seen.append(outcome)
    assert seen == ["queued", "unchanged", "replaced", "started", "unchanged", "follow_up", "queued_manual", "kept_manual", "finished", "refused"]


def test_streams(spark, tmp_path):
    rows = [("g", 1, "hint", ["a"]), ("g", 2, "hint", ["b"]), ("h", 3, "hint", ["a"])]
    schema = "graph_id string, seq bigint, type string, generations array<string>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    q = coalesce_intents(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("outcomes").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["seq"], r["outcome"]) for r in spark.table("outcomes").collect()} == {(1, "queued"), (2, "replaced"), (3, "queued")}


def test_windows(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = windowed_counts(events, "ts", ["event_type"], "1 day")
    q = out.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("daily").agg(F.sum("n")).first()[0] == 1000
    publish_batches(events.select("event_id"), f"{tmp_path}/pub", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/pub").count() == 1000
