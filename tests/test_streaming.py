from veritext.streaming.scores import running_accuracy


def test_running_accuracy(spark, tmp_path):
    gold = spark.createDataFrame([("1", True), ("2", False), ("3", None)], "id string, validity boolean")
    schema = "system string, id string, validity boolean"
    parts = [[("a", "1", True), ("b", "1", False), ("a", "9", True)], [("a", "2", True), ("b", "2", None), ("b", "3", True), ("a", "1", True)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_accuracy(stream, gold).writeStream.format("memory").queryName("scores").outputMode("complete").trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    got = {r.system: (r.total, r.correct) for r in spark.table("scores").collect()}
    assert got == {"a": (3, 2), "b": (1, 0)}
