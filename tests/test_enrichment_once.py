"""The enrichment run does the per-row text work once."""

from newslens.plans.daily_run import enrich_articles


def test_entities_are_extracted_once(spark):
    rows = [(i, f"Anna Berg trifft Olaf Scholz in Berlin{i % 2} wegen Haushalt und Steuern", i % 2) for i in range(8)]
    out = enrich_articles(spark.createDataFrame(rows, "url long, content string, n int"), class_col="n")
    assert "regexp_extract_all" not in out._jdf.queryExecution().executedPlan().toString()  # they come from the checkpoint
    got = out.orderBy("url").first()
    assert [e.text for e in got.entities][:2] == ["Anna Berg", "Olaf Scholz"] and got.entity_counts["Anna Berg"] == 1
    assert "_entities" not in out.columns
