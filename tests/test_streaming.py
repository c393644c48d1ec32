"""Incremental ingest and windowed coverage on Structured Streaming."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from newslens.streaming.coverage import article_ts, coverage_windows
from newslens.streaming.ingest import start_ingest


def _land(folder, name, articles):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(json.dumps({"articles": articles}) + "\n")


def _a(url, ts, title="t"):
    return {"title": title, "clean_url": "bild.de", "link": url, "published_date": ts, "summary": "s",
            "language": "de"}


def test_ingest_dedupes_across_batches_and_replays(spark):
    root = tempfile.mkdtemp(prefix="newslens-stream-")
    landing, store, ckpt = (os.path.join(root, d) for d in ("landing", "store", "ckpt"))
    os.makedirs(landing)
    _land(landing, "r1.json", [_a("u1", "2024-11-06 10:00:00"), _a("u2", "2024-11-06 11:00:00"),
                               _a("u1", "2024-11-06 12:00:00", "dup")])
    start_ingest(spark, landing, store, ckpt).awaitTermination(120)
    first = spark.read.parquet(store)
    assert sorted(r.url for r in first.collect()) == ["u1", "u2"]
    assert first.where("url = 'u1'").first().title == "t"

    _land(landing, "r2.json", [_a("u2", "2024-11-07 09:00:00", "again"), _a("u3", "2024-11-07 10:00:00"),
                               _a("u4", None, "undated")])
    start_ingest(spark, landing, store, ckpt).awaitTermination(120)
    urls = sorted(r.url for r in spark.read.parquet(store).collect())
    assert urls == ["u1", "u2", "u3", "u4"]
    assert spark.read.parquet(store).where("url = 'u4'").first().datetime is None
    row = spark.read.parquet(store).where("url = 'u1'").first()
    assert row.datetime == "20241106100000"


def test_ingest_loses_nothing(spark):
    root = tempfile.mkdtemp(prefix="newslens-stream-")
    landing, store, ckpt = (os.path.join(root, d) for d in ("landing", "store", "ckpt"))
    os.makedirs(landing)
    _land(landing, "r1.json", [_a("far", "2099-01-01 00:00:00"), _a("u1", "2024-11-06 10:00:00"), _a("undated", None)])
    start_ingest(spark, landing, store, ckpt).awaitTermination(120)
    _land(landing, "r2.json", [_a("week_old", "2024-10-30 10:00:00"), _a("odd", "no date"), _a("u1", "2024-11-07 10:00:00")])
    with open(os.path.join(landing, "r3.json"), "w", encoding="utf-8") as f:
        f.write('{"articles": [{"title": \nnot json at all\n\n' + json.dumps({"articles": []}) + "\n" + json.dumps({"status": "ok"}) + "\n")
    start_ingest(spark, landing, store, ckpt).awaitTermination(120)
    assert sorted(r.url for r in spark.read.parquet(store).collect()) == ["far", "odd", "u1", "undated", "week_old"]
    rejects = spark.read.parquet(store + "_rejects").collect()
    assert sorted(r.body for r in rejects) == ["not json at all", '{"articles": [{"title": ']


def test_coverage_stream_equals_the_batch_query(spark):
    from newslens.streaming.coverage import compact_coverage, read_coverage, start_coverage

    root = tempfile.mkdtemp(prefix="newslens-cov-")
    landing, sink, ckpt = (os.path.join(root, d) for d in ("landing", "sink", "ckpt"))
    schema = "topic string, pol_leaning string, datetime string"
    rows = [[("A", "links", "20240101100000"), ("A", "links", "20240101110000"), ("A", "mitte", "20990102000000"), (None, "x", "20240101")],
            [("A", "links", "20240101120000"), ("C", "rechts", "20240110000000"), ("B", None, "20231231")],
            [("A", "links", "20240101130000"), ("A", "links", None)]]
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing).withColumn("ts", article_ts("datetime"))
        start_coverage(stream, sink, ckpt).awaitTermination(120)
    whole = spark.createDataFrame([r for part in rows for r in part], schema).withColumn("ts", article_ts("datetime"))
    want = sorted(map(str, coverage_windows(whole).collect()))
    assert sorted(map(str, read_coverage(spark, sink).collect())) == want and len(want) == 4
    compact_coverage(spark, sink, root + "/whole")
    assert sorted(map(str, spark.read.parquet(root + "/whole").collect())) == want


def test_event_time_does_not_depend_on_the_session_time_zone(spark):
    from newslens.streaming.coverage import utc_day

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("20240101000000",), ("20240101",), ("20240310023000",), ("20241301",),
                                    ("abc",), (None,)], "d string")
        ts = article_ts("d")
        got = [(r.s, str(r.day) if r.day else None)
               for r in df.select(F.unix_seconds(ts).alias("s"), utc_day(ts).alias("day")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    # 2024-03-10 02:30 does not exist in New York (clock change); read as UTC it does.
    assert got == [(1704067200, "2024-01-01"), (1704067200, "2024-01-01"), (1710037800, "2024-03-10"),
                   (None, None), (None, None), (None, None)]
