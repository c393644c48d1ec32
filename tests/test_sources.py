"""Readers and sinks."""

import json
import os
import tempfile

import pytest


from newslens.sources.articles import (load_articles, read_csv_articles, read_or_empty, write_articles,
                                       write_csv_articles)
from newslens.sources.headlines import read_responses, select_headlines
from newslens.sources.paged import url_batches, write_batches
from newslens.sources.tables import ENRICHED_SCHEMA, RAW_ARTICLE_SCHEMA, read_stored


def test_csv_reader_and_empty_fallback(spark):
    root = tempfile.mkdtemp(prefix="newslens-csv-")
    path = os.path.join(root, "a.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('title,source,url,publishedAt,description,content\n')
        f.write('"T ""q""",bild.de,https://www.bild.de/a,2024-11-06T12:34:56+01:00,None,"line1\nline2"\n')
    df = read_csv_articles(spark, path, RAW_ARTICLE_SCHEMA)
    r = df.first()
    assert r.title == 'T "q"' and r.description is None and r.content == "line1\nline2"
    empty = read_or_empty(spark, os.path.join(root, "missing"), RAW_ARTICLE_SCHEMA)
    assert empty.count() == 0 and empty.columns == RAW_ARTICLE_SCHEMA.fieldNames()


def test_csv_columns_by_header(spark):
    root = tempfile.mkdtemp(prefix="newslens-csvh-")
    path = os.path.join(root, "a.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write(",url,content,title,extra,topic_nr,entities\n0,http://u,c,t,x,7,[]\n1,http://v,d,None,y,seven,no json\n")
    got = read_csv_articles(spark, path, ENRICHED_SCHEMA, corrupt_col="errors").orderBy("url").collect()
    assert [(r.url, r.content, r.title, r.topic_nr, r.entities, r.source, r.errors) for r in got] == [
        ("http://u", "c", "t", 7, [], None, None), ("http://v", "d", None, None, None, None, "topic_nr,entities")]


def test_only_a_missing_path_is_an_empty_history(spark):
    root = tempfile.mkdtemp(prefix="newslens-hist-")
    with open(os.path.join(root, "part-0.parquet"), "w", encoding="utf-8") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        read_or_empty(spark, root, RAW_ARTICLE_SCHEMA).count()
    with pytest.raises(Exception):
        read_stored(spark, root)
    assert read_stored(spark, root + "/none") is None


def test_csv_round_trip_of_enriched_articles(spark):
    root = tempfile.mkdtemp(prefix="newslens-csvrt-")
    rows = [("T \"q\", x", "bild", "https://www.bild.de/a", "20241106123456", "d", "line1\nline2, more",
             "rechts", "line more", "line", "neutral", 3, "Wirtschaft",
             [("Olaf", "PER"), ("Berlin", "LOC"), ("Olaf", "PER")], {"Olaf": 2, "Berlin": 1},
             [("Politik", 2), ("Sport", 1)]),
            ("t2", "taz", "https://www.taz.de/b", "20241107", "d", "x", "links", "x", "x", "positive", -1, "None",
             [], {}, [])]
    df = spark.createDataFrame(rows, ENRICHED_SCHEMA)
    write_csv_articles(df, root + "/out")
    back = read_csv_articles(spark, root + "/out", ENRICHED_SCHEMA)
    got = {r.url: r for r in back.collect()}
    a = got["https://www.bild.de/a"]
    assert a.title == 'T "q", x' and a.content == "line1\nline2, more" and a.topic_nr == 3
    assert [(e.text, e.label) for e in a.entities] == [("Olaf", "PER"), ("Berlin", "LOC"), ("Olaf", "PER")]
    assert a.entity_counts == {"Olaf": 2, "Berlin": 1}
    assert [(t.topic, t.overlap) for t in a.related_topics] == [("Politik", 2), ("Sport", 1)]
    b = got["https://www.taz.de/b"]
    # The text None (a topic below the label cut-off) reads back as NULL, like a CSV reader does.
    assert b.topic is None and b.entities == [] and b.entity_counts == {} and b.related_topics == []


def test_load_articles_rules_and_persist(spark):
    root = tempfile.mkdtemp(prefix="newslens-load-")
    rows = [("u1", "20231031120000", "A"), ("u2", "20231101000000", "A"), ("u3", None, "A"),
            ("u4", "nan", "Börse"), ("u5", "20241301", None), ("u6", "abc", "A")]
    spark.createDataFrame(rows, "url string, datetime string, topic string").write.parquet(root + "/t")
    df = load_articles(spark, root + "/t", persist=True)
    # Month floor 202311 (unknown dates kept), the excluded topic dropped, NULL topics kept.
    assert sorted(r.url for r in df.collect()) == ["u2", "u3", "u5"]
    assert df.storageLevel.useMemory and df.storageLevel.useDisk
    df.unpersist()


def test_month_partitioned_store_prunes_and_keeps_the_load_rule(spark):
    root = tempfile.mkdtemp(prefix="newslens-part-")
    rows = [("u1", "20231031120000", "A"), ("u2", "20231101000000", "A"), ("u3", None, "A"),
            ("u4", "nan", "B"), ("u5", "20241301", None), ("u6", "abc", "A"), ("u7", "2024", "A"),
            ("u8", "20250101", "Börse")]
    df = spark.createDataFrame(rows, "url string, datetime string, topic string")
    write_articles(df, root + "/store")
    df.write.parquet(root + "/flat")
    part = load_articles(spark, root + "/store")
    flat = load_articles(spark, root + "/flat")
    assert sorted(r.url for r in part.collect()) == sorted(r.url for r in flat.collect()) == ["u2", "u3", "u4", "u5"]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "pub_month" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_url_batches_offsets(spark):
    urls = spark.createDataFrame([(f"u{i:03d}",) for i in range(25)], "url string").repartition(4)
    got = url_batches(urls, tie=(), start=5, end=17, size=5).orderBy("position").collect()
    # pages at offsets 5, 10, 15; the last page runs past the end (positions 15..19)
    assert [r.position for r in got] == list(range(5, 20))
    assert [r.url for r in got][:2] == ["u005", "u006"]
    assert {r.batch_start for r in got} == {5, 10, 15}
    root = tempfile.mkdtemp(prefix="newslens-batches-")
    write_batches(url_batches(urls, tie=(), size=10), root + "/out")
    parts = sorted(d for d in os.listdir(root + "/out") if d.startswith("batch_start="))
    assert parts == ["batch_start=0", "batch_start=10", "batch_start=20"]


def test_json_responses_and_request_filters(spark):
    root = tempfile.mkdtemp(prefix="newslens-json-")
    with open(os.path.join(root, "r.json"), "w", encoding="utf-8") as f:
        f.write(json.dumps({"articles": [
            {"title": "a", "clean_url": "bild.de", "link": "u1", "published_date": "2024-11-06 10:00:00",
             "language": "de"},
            {"title": "b", "clean_url": "bild.de", "link": "u2", "published_date": "2024-11-04 10:00:00",
             "language": "de"},
            {"title": "c", "clean_url": "taz.de", "link": "u3", "published_date": "2024-11-06 09:00:00",
             "language": "en"}]}) + "\n")
        f.write(json.dumps({"articles": []}) + "\n")
        f.write(json.dumps({"status": "error"}) + "\n")
    rows = read_responses(spark, root)
    assert rows.count() == 3
    assert rows.where("url = 'u1'").first().description is None
    sel = select_headlines(rows, "2024-11-06 12:00:00", sources=["bild.de", "taz.de"])
    assert [r.url for r in sel.collect()] == ["u1"]
    capped = select_headlines(rows, "2024-11-06 12:00:00", language=None, hours=72, per_source=1)
    assert sorted(r.url for r in capped.collect()) == ["u1", "u3"]
