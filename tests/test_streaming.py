from tripleforge.streaming.scores import windowed_means


def test_windowed_means_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.select("ts", "event_type", "value").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    query = windowed_means(stream, "ts", "value", ["event_type"], "1 day").writeStream.outputMode("complete").format("memory").queryName("means").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("means").count()
    want = events.selectExpr("date_trunc('day', ts) as d", "event_type").distinct().count()
    assert got == want
