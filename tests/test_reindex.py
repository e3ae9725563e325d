from codelode.streaming import reindex


def test_only_changed_files_are_stored(spark, tmp_path):
    incoming, store, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "store", "check"))

    def arrive(rows, name):
        spark.createDataFrame(rows, reindex.FILES).coalesce(1).write.mode("append").parquet(incoming)
        reindex.reindex_stream(spark, incoming, store, checkpoint).awaitTermination()

    arrive([("a.py", "one", 1), ("b.py", "two", 1), ("b.py", "three", 2)], "first")
    arrive([("a.py", "one", 2), ("b.py", "four", 3), ("c.py", "", 1)], "second")
    arrive([("b.py", "four", 4)], "third")
    rows = spark.read.parquet(store)
    assert sorted((r.batch, r.path, r.text) for r in rows.collect()) == [(0, "a.py", "one"), (0, "b.py", "three"), (1, "b.py", "four"), (1, "c.py", "")]
    assert sorted((r.path, r.text) for r in reindex.latest(rows).collect()) == [("a.py", "one"), ("b.py", "four"), ("c.py", "")]
    before = reindex.stored_before(spark, store, 1)  # a repeated batch sees what came before it
    assert sorted(r.path for r in before.collect()) == ["a.py", "b.py"]
