from quern.streaming import events as stream


def test_tumbling_stream_equals_batch(spark, tiny, tmp_path):
    table = spark.read.parquet(f"{tiny}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    live = stream.read_events(spark, str(tmp_path / "in"), table.schema)
    made = stream.tumbling(live, "ts", "1 day", "400 days", ["event_type"], "value").drop("total")
    run = made.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    batch = stream.tumbling(table.withColumn("ts", table.ts.cast("timestamp")), "ts", "1 day", "400 days", ["event_type"], "value").drop("total")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch.collect()))


def test_sliding_counts_every_event_in_each_window(spark, tiny):
    table = spark.read.parquet(f"{tiny}/events.parquet")
    made = stream.sliding(table, "ts", "1 hour", "30 minutes", "1 hour", [])
    assert made.agg({"n": "sum"}).first()[0] == 2 * table.count()


def test_duplicates(spark, tiny, tmp_path):
    table = spark.read.parquet(f"{tiny}/events.parquet").limit(20)
    table.union(table).repartition(1).write.parquet(str(tmp_path / "in"))
    live = stream.deduplicate(stream.read_events(spark, str(tmp_path / "in"), table.schema), "ts", "400 days", ["event_id"])
    run = live.writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("once").count() == 20
