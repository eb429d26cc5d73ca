from lineloom.operators import graph
from lineloom.streaming.traces import strands


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, i, float((i * (k + 2)) % 7) / 2, float((i * 5) % 6) / 2) for k in (1, 2) for i in range(60)]
    names = "pattern_id int, step int, x double, y double"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 20 == part], names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(names).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = strands(stream).writeStream.format("memory").queryName("strand_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("strand_rows").collect())
    want = sorted(tuple(r) for r in graph.strands(graph.visits(spark.createDataFrame(rows, names))).collect())
    assert got == want
