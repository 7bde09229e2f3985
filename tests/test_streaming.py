from arcorder.streaming import scores


def test_stream_ends_at_the_batch_score(spark, tmp_path):
    rows = [(0, 1, 5, "2026-01-01 00:10:00"), (0, 2, 3, "2026-01-01 00:20:00"), (2, 0, 4, "2026-01-01 01:10:00"), (2, 3, 6, "2026-01-01 01:20:00")]
    edges = spark.createDataFrame(rows, "src long, tgt long, weight long, ts string").selectExpr("src", "tgt", "weight", "CAST(ts AS TIMESTAMP) AS ts")
    edges.repartition(2).write.parquet(str(tmp_path / "edges"))
    positions = spark.createDataFrame([(i, float(i)) for i in range(4)], "node long, pos double")
    for name, job, mode in (("total", scores.running_score, "complete"), ("hours", scores.windowed_score, "complete")):
        stream = spark.readStream.schema(edges.schema).parquet(str(tmp_path / "edges"))
        query = job(stream, positions).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert tuple(spark.sql("SELECT score, total_weight FROM total").first()) == (14, 18)
    assert sorted((str(r["start"]), r["score"], r["total_weight"]) for r in spark.sql("SELECT * FROM hours").collect()) == [("2026-01-01 00:00:00", 8, 8), ("2026-01-01 01:00:00", 6, 10)]
