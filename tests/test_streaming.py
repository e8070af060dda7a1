import datetime as dt

from pyspark.sql import functions as F

from tallyforge.streaming import debounce, refresh


def test_debounce_is_anchored(spark):
    rows = [("a", t) for t in (0, 200, 299, 300, 450, 599, 600, 2000)] + [("b", 5), (None, 1), ("b", None)]
    df = spark.createDataFrame(rows, "k string, ms long")
    got = sorted(map(tuple, debounce.debounce(df, "k", "ms", 300).collect()))
    assert got == [("a", 0, 300, 3), ("a", 300, 600, 3), ("a", 600, 900, 1), ("a", 2000, 2300, 1), ("b", 5, 305, 1)]
    assert debounce.debounce(df.limit(0), "k", "ms").count() == 0


def test_easing(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.5, 1.0), ("a", 100.0, 1.0)], "k string, t double, goal double")
    got = [r["eased"] for r in debounce.ease(df, "k", "t", "goal").orderBy("t").collect()]
    assert got[0] == 0.0 and 0.9 < got[1] < 1.0 and got[2] == 1.0


def test_debounce_stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    at = lambda ms: base + dt.timedelta(milliseconds=ms)
    src = tmp_path / "in"
    batches = [[("a", at(0)), ("a", at(100))], [("a", at(250)), ("a", at(400))], [("z", at(60_000))], [("z", at(120_000))]]
    schema = "k string, ts timestamp"
    spark.createDataFrame(batches[0], schema).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = debounce.debounce_stream(stream, "k", "ts", 300).writeStream.format("memory").queryName("bounced").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        for b in batches[1:]:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(src))
            q.processAllAvailable()
        q.processAllAvailable()
        rows = {(r["k"], r["events"]) for r in spark.table("bounced").collect()}
    finally:
        q.stop()
    assert ("a", 3) in rows and ("a", 1) in rows


def test_refresh(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.rs").write_text("fn a() {}")
    seen = []
    q = refresh.watch(refresh.file_events(spark, str(src)), lambda df, n: seen.append((n, sorted(r["path"].rsplit("/", 1)[1] for r in df.collect()))), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
        (src / "b.rs").write_text("fn b() {}")
        (src / "c.txt").write_text("no")
        q.processAllAvailable()
    finally:
        q.stop()
    assert [x for _, x in seen if x] == [["a.rs"], ["b.rs"]]
    one = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    two = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, content string")
    assert {tuple(r) for r in refresh.changes(one, two).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "created")}
    assert refresh.changes(one, one.withColumn("x", F.lit(1))).count() == 0
