from tallyweave.streaming import submissions


def test_coverage_over_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [[(1, "1", "v1"), (2, "0", "v1")], [(3, "1", "v2")]]
    for part in rows:
        spark.createDataFrame(part, "id int, ok string, formdef_version string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("id int, ok string, formdef_version string").option("maxFilesPerTrigger", 1).parquet(path)
    for name, df in (("cover", submissions.coverage(stream, "id", {"q": ([], "${ok} = '1'"), "never": (["0"], "")})), ("versions", submissions.versions(stream))):
        query = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(map(tuple, spark.table("cover").collect())) == [("never", 0, 3, True), ("q", 2, 1, False)]
    assert sorted(map(tuple, spark.table("versions").collect())) == [("v1", 2), ("v2", 1)]
