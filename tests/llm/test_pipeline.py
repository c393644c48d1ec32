"""The pipeline's stages, each on its own input, and the whole run on odd rows."""

import random

import corpus_pipeline as CP
from newslens.llm import decontam, quality, secrets, simhash
from newslens.sources.tables import table

from conftest import SF_CHECK


def test_stages_in_order():
    assert [n for n, _ in CP.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination",
                                         "secret_scans", "best_fit_packing"]


def test_every_stage_on_the_small_table(spark):
    docs = table(spark, SF_CHECK, "documents")
    bad = {r.doc_id for r in table(spark, SF_CHECK, "labels").where("quality = 0").collect()}
    good = {r.doc_id for r in table(spark, SF_CHECK, "labels").where("quality = 1").collect()}
    kept = CP.quality_filter(spark, docs, SF_CHECK).cache()
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and len(ids & bad) <= 0.1 * len(bad) and len(ids & good) >= 0.97 * len(good)

    one = CP.near_dedup(spark, kept, SF_CHECK)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(kept).collect()}
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(set(groups.values()))

    clean = CP.decontaminate(spark, docs, SF_CHECK)
    leaked = {r.doc_id for r in decontam.contaminated(docs, table(spark, SF_CHECK, "benchmark")).collect()}
    assert leaked and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - leaked

    masked = {r.doc_id: r for r in CP.mask_secrets(spark, docs, SF_CHECK).collect()}
    assert list(masked[0].asDict()) == docs.columns
    for r in docs.collect():
        m = masked[r.doc_id]
        assert m.n_chars == len(m.text) and not secrets.base_spans(m.text)
        assert (m.text == r.text) == (not secrets.base_spans(r.text)) or secrets.MASK in m.text


def test_run_on_odd_rows(spark, tmpdir_run):
    rnd = random.Random(2)
    words = "the rain falls on every quiet town where people read long books at night".split()
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."
    item, copy = text(40), text(60)
    rows = [(i, text(30), "en", "s", 1) for i in range(40)] + [(i, copy, "en", "s", 1) for i in range(40, 50)]
    rows += [(60, text(20) + " " + item + " " + text(20), "en", "s", 1), (61, text(9) + " token = \"" + "a1" * 20 + "\" ok", "en", "s", 1),
             (62, None, None, None, None), (None, text(25), "en", "s", 1), (63, "", "en", "s", 0)]
    rows += [(100 + i, "BUY!! NOW!! " * 30 + text(3), "en", "s", 1) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmpdir_run}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmpdir_run}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmpdir_run}/benchmark.parquet")
    got = {r.doc_id for r in CP.run(spark, tmpdir_run).collect()}
    assert got >= {*range(41), 61, None} and not got & {*range(41, 50), 60, *range(100, 130)}
    empty = f"{tmpdir_run}/empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmpdir_run}/{t}.parquet").where("false").write.parquet(f"{empty}/{t}.parquet")
    assert CP.run(spark, empty).collect() == []
