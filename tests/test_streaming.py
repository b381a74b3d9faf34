from papyrine.streaming import islands


def test_sessions_as_stream(spark, tmp_path):
    rows = [(k, f"2024-01-01 {h:02d}:{m:02d}:00", k % 2) for k, (h, m) in enumerate([(1, 0), (1, 5), (1, 20), (3, 0), (3, 1), (9, 0), (9, 0)])]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long").selectExpr("event_id", "timestamp(ts) AS ts", "user_id", "1.0D AS value")
    df.write.parquet(str(tmp_path / "events"))
    batch = {(r.user_id, r.start, r.stop, r.n) for r in islands.sessions(df).collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))
    q = islands.session_stream(stream).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = {(r.user_id, r.start, r.stop, r.n) for r in spark.sql("SELECT * FROM closed").collect()}
    assert closed and closed <= batch
