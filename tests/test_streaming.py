"""The stream and its batch twin give the same rows."""

import pytest

from modalflow.streaming import live


def test_due_points():
    c = live.Live(window=5, stride=3)
    buf, n, out = c.feed("a", [], 0, [[float(i % 3)] for i in range(11)])
    assert [r[1] for r in out] == [5, 8, 11] and n == 11 and len(buf) == 5
    assert c.feed("a", buf, n, [None, [1.0]])[:2] == ([[1.0]], 1)
    with pytest.raises(ValueError):
        live.Live(window=0)
    with pytest.raises(ValueError):
        c.feed("a", [], 0, [[1.0, 2.0]])


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, f"2024-01-01 00:{i:02d}:00", i, [float((i * k) % 5), float(i)]) for k, s in enumerate(("a", "b"), 1) for i in range(20)]
    pts = spark.createDataFrame(rows, "series string, ts string, seq long, x array<double>").selectExpr("series", "cast(ts as timestamp) as ts", "seq", "x")
    pts.repartition(1).write.parquet(str(tmp_path / "in"))
    c = live.Live(window=8, dims=2, stride=4)
    want = sorted(map(str, live.batch(pts, c).collect()))
    src = spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in"))
    q = live.stream(src, c).writeStream.format("memory").queryName("live_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.sql("SELECT * FROM live_out").collect())) == want and want


def test_event_time_windows(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(200).write.parquet(str(tmp_path / "ev"))
    src = spark.readStream.schema(spark.read.parquet(str(tmp_path / "ev")).schema).parquet(str(tmp_path / "ev"))
    q = live.event_time(src).writeStream.format("memory").queryName("ev_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM ev_out").first()[0] == 200
