import datetime as dt

from pyspark.sql import functions as F

from papersluice.operators.increments import VersionedTarget
from papersluice.operators.rules import Rule
from papersluice.streaming.feeds import apply_feed, detect_stream, hit_rates

FEED = "feed_id bigint, path string, size bigint, modified_ticks bigint, batch string, observed_at timestamp, arrived_at timestamp"


def test_detect_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("/a", "a.txt", "secret here", dt.datetime(2025, 1, 1, 0, 5)), ("/b", "b.txt", "nothing", dt.datetime(2025, 1, 1, 0, 6))], "path string, filename string, content string, ts timestamp").write.parquet(src)
    stream = spark.readStream.schema("path string, filename string, content string, ts timestamp").parquet(src)
    q = detect_stream(stream, [Rule("s", "secret", "keyword", "high")]).writeStream.format("memory").queryName("hits_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert [r.path for r in spark.table("hits_out").collect()] == ["/a"]
    rates = hit_rates(stream.select(F.lit("high").alias("risk"), "ts"), "ts")
    assert rates.isStreaming and rates.columns == ["start", "end", "risk", "n_hits"]


def test_apply_feed(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "target")
    d = [dt.datetime(2025, 1, x) for x in range(1, 5)]
    spark.createDataFrame([(1, "a", 1, 1, "b", d[0], d[0]), (2, "b", 1, 1, "b", d[0], d[0])], FEED).write.parquet(src)
    for _ in range(2):  # a restart finds nothing new
        apply_feed(spark.readStream.schema(FEED).parquet(src), root, str(tmp_path / "c")).awaitTermination(120)
    spark.createDataFrame([(3, "a", 2, 1, "b", d[1], d[1]), (4, "b", 1, 1, "b", d[1], d[1]), (5, "a", 9, 9, "b", d[0], d[2])], FEED).write.mode("append").parquet(src)
    apply_feed(spark.readStream.schema(FEED).parquet(src), root, str(tmp_path / "c")).awaitTermination(120)
    schema = spark.read.parquet(root + "/data/*").schema
    rows = VersionedTarget(spark, root, schema).read("deltas").where("emitted").orderBy("feed_id").collect()
    assert [(r.path, r.size) for r in rows] == [("a", 1), ("b", 1), ("a", 2)]
