"""Property tests (hypothesis) and whole-table invariants of the registered queries."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newslens.functions import patterns as P
from newslens.functions import text as tx
from newslens.operators import coverage as cov
from newslens.operators.dedupe import merge_history
from newslens.plans.dashboard import dashboard_articles

from conftest import SF_SMALL

SETTINGS = dict(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

keys = st.sampled_from(["a", "b", "c", None])
batch = st.lists(st.tuples(keys, st.integers(0, 5)), max_size=8)


def _expected_merge(hist, new):
    """Brute force: history rows first, then new rows, each by position; first row per key wins."""
    seen = {}
    for seq, rows in ((0, hist), (1, new)):
        for pos, (k, v) in sorted(enumerate(rows), key=lambda t: (t[1][1], t[0])):
            seen.setdefault(k, (seq, v))
    return sorted(seen.items(), key=str)


@settings(**SETTINGS)
@given(hist=batch, new=batch)
def test_merge_matches_brute_force(spark, hist, new):
    schema = "url string, v int, pos int"
    h = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(hist)], schema)
    n = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(new)], schema)
    got = merge_history(h, n, order=["v", "pos"])
    rows = sorted(((r.url, (r.ingest_seq, r.v)) for r in got.collect()), key=str)
    assert rows == _expected_merge(hist, new)
    # Idempotent: merging the same batch again changes nothing.
    again = merge_history(got.drop("ingest_seq"), n, order=["v", "pos"])
    assert sorted(((r.url, r.v) for r in again.collect()), key=str) == sorted(((k, v) for k, (_, v) in rows), key=str)
    # A store with one row per key: the incremental path gives the same rows.
    store = got.drop("ingest_seq")
    inc = merge_history(store, n, order=["v", "pos"], history_unique=True)
    full = merge_history(store, n, order=["v", "pos"])
    assert sorted(map(tuple, inc.select("url", "v", "ingest_seq").collect()), key=str) == \
        sorted(map(tuple, full.select("url", "v", "ingest_seq").collect()), key=str)


# Letters, digits and marks of several scripts, punctuation, symbols, separators and controls.
unicode_text = st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=60)


@settings(**SETTINGS)
@given(texts=st.lists(unicode_text, min_size=1, max_size=10))
def test_single_pass_tokenizer_equals_replace_then_split(spark, texts):
    """tokens() splits once at non-word runs; the original rule first turned every non-word
    character into a space. Both must give the same tokens for any text."""
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    t = F.regexp_replace(F.col("text"), P.DIGIT + "+", "")
    t = F.lower(F.regexp_replace(t, P.NON_WORD, " "))
    old = F.filter(F.split(t, P.NON_WORD + "+"),
                   lambda w: (F.length(w) >= 2) & (F.length(w) <= 15) & ~w.startswith("_"))
    for r in df.select(tx.tokens("text").alias("new"), old.alias("old")).collect():
        assert r.new == r.old


@settings(**SETTINGS)
@given(texts=st.lists(unicode_text, min_size=1, max_size=10))
def test_whitespace_collapse_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    once = F.regexp_replace("text", P.WS + "+", " ")
    twice = F.regexp_replace(once, P.WS + "+", " ")
    for r in df.select(once.alias("a"), twice.alias("b")).collect():
        assert r.a == r.b


def test_monthly_shares_sum_to_one_per_outlet(spark):
    m = cov.monthly_source_share(dashboard_articles(spark, SF_SMALL))
    sums = m.groupBy("topic", "source").agg(F.sum("share").alias("s")).collect()
    assert sums and all(math.isclose(r.s, 1.0, abs_tol=1e-9) for r in sums)


def test_sentiment_percent_sums_to_hundred_per_month(spark):
    m = cov.sentiment_month_pct(dashboard_articles(spark, SF_SMALL))
    sums = m.groupBy("topic", "month").agg(F.sum("pct").alias("s")).collect()
    assert sums and all(math.isclose(r.s, 100.0, abs_tol=1e-9) for r in sums)


def test_leaning_pct_sums_to_hundred_per_topic(spark):
    s = cov.leaning_share(dashboard_articles(spark, SF_SMALL))
    sums = s.groupBy("topic").agg(F.sum("pct").alias("s"), F.count("*").alias("n")).collect()
    # Each share is rounded to 2 places, so the sum is 100 within 5 × 0.005.
    assert sums and all(r.n == 5 and abs(r.s - 100.0) <= 0.025 + 1e-9 for r in sums)
