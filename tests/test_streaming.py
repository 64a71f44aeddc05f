from datetime import datetime

from pyspark.sql import functions as F

from formquarry.streaming.changes import deliveries_per_window, stream_changes

SCHEMA = "k string, v timestamp_ntz, h string"


def test_changes_over_batches(spark, tmp_path):
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")

    def run(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = stream_changes(stream, ["k"], ["v"], [F.lower("h")], folder, str(tmp_path / "cp"))
        query.awaitTermination()
        return sorted((r.k, r.change_kind, r.batch) for r in spark.read.parquet(f"{folder}/changes/*").collect())

    t = lambda d: datetime(2025, 1, d)
    assert run(("a", t(2), "x"), ("b", t(2), "y")) == [("a", "added", 0), ("b", "added", 0)]
    assert run(("a", t(1), "late"), ("b", t(3), "Y"), ("c", t(3), None))[-1] == ("c", "added", 1)
    assert [r for r in run(("a", t(4), "z"), ("c", t(4), "q")) if r[2] == 2] == [("a", "changed", 2)]


def test_counts_per_window(spark, tmp_path):
    rows = [(datetime(2025, 1, 1, 3), "a"), (datetime(2025, 1, 1, 5), "a"), (datetime(2025, 1, 20), "a")]
    spark.createDataFrame(rows, "t timestamp_ntz, f string").write.parquet(str(tmp_path / "in"))
    stream = deliveries_per_window(spark.readStream.schema("t timestamp_ntz, f string").parquet(str(tmp_path / "in")), "t", by=["f"])
    query = stream.writeStream.format("memory").queryName("deliveries").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.deliveries for r in spark.table("deliveries").collect()) == [1, 2]
