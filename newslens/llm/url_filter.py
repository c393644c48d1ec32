"""URL filters: host/path rules, and logistic regression on hashed character n-grams for the rest.

Everything here is DataFrame functions: URL splitting, rule matching, n-gram hashing, the
gradient steps of the training (an aggregate per step over the small labelled table) and
the scoring of every page.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.sources.tables import table

#: (verdict, host, path prefix): longest host+path wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: The labelled URL table: words of site names, by label; `labelled_urls` lays them out as URLs.
BLOCK_SITES = ("casino-royal", "win-casino", "casino-win", "online-casino", "poker-win", "free-bets", "bets-now",
               "best-bets", "sports-bets", "slots-win", "adult-x", "adult-cam", "x-adult", "xxx-tube", "porn-hub",
               "sex-chat", "cheap-pills", "pills-online", "buy-pills", "viagra-shop", "cheap-meds", "spam-farm",
               "link-farm", "content-farm", "seo-farm", "spam-blog", "ads-track", "track-ads", "ads-server",
               "click-track", "ad-banner", "popup-ads", "free-iphone", "win-prize", "cheap-loans", "payday-loans",
               "replica-watch", "crack-serial", "warez-free", "get-rich")
ALLOW_SITES = ("university", "library", "newspaper", "museum", "weather", "daily-news", "cooking", "gardening",
               "history", "science", "mountain", "physics", "travel-guide", "city-council", "hospital", "school",
               "orchestra", "river-watch", "farmers-market", "art-trade", "encyclopedia", "research-lab", "open-data",
               "community", "garden-club", "bookshop")
#: Words of ordinary sites; a site's name is one of them, or two neighbours (1, 2 or 5 apart) with a hyphen.
WORDS = ("garden", "history", "library", "science", "public", "music", "travel", "city", "school", "nature", "family", "market",
         "health", "sport", "local", "news", "recipe", "photo", "river", "mountain", "book", "museum", "farm", "blog")
#: Invented names of ordinary sites are pairs of these syllables.
SYLLABLES = ("th", "er", "tion", "an", "ing", "on", "ble", "re", "he", "st")
TLDS = ("example.com", "example.net", "example.org")
PATHS = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}?page=2")
PREFIXES = ("", "www.", "blog.", "m.")

NGRAMS = (3, 4, 5)
BUCKETS = 1 << 12
STEPS = 80
RATE = 30.0
L2 = 1e-4
#: Labelled rows that `train` accepts.
MAX_LABELLED = 20_000
#: A URL is blocked by the method from this probability on.
THRESHOLD = 0.5


def split_url(url: str | Column) -> tuple[Column, Column]:
    """(host, path) of a URL: the host follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
    A-Z lower-cased; the path goes on to ``?``, ``#`` or the end. NULL or no ``://``: both empty."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, NULL if none does. A rule fits its host and all of its
    subdomains if the path starts with the rule's. Ties in length go to ``block``."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1], r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(order):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, sizes: Sequence[int], buckets: int, salt: str) -> Column:
    """Hash buckets of the character n-grams of ``text``, repeats included."""
    parts = []
    for n in sizes:
        last = F.length(text) - F.lit(n - 1)
        parts.append(F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i, n=n:
                     F.pmod(F.xxhash64(F.lit(salt), F.substring(text, i, F.lit(n))), F.lit(buckets - 1)).cast("int") + 1))
                     .otherwise(F.array().cast("array<int>")))
    return F.concat(*parts)


def url_features(host: Column, path: Column, sizes: Sequence[int] = NGRAMS, buckets: int = BUCKETS) -> Column:
    """Buckets 1..buckets-1 of the n-grams of host and path (each between ``^`` and ``$``, digits written as 0),
    deduplicated; bucket 0 is the bias that every URL has."""
    def put(c):
        return F.concat(F.lit("^"), F.regexp_replace(c, "[0-9]+", "0"), F.lit("$"))

    grams = F.concat(_grams(put(host), sizes, buckets, "h"), _grams(put(path), sizes, buckets, "p"))
    return F.concat(F.array(F.lit(0)), F.array_distinct(grams))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, blocked 0/1): every listed site name, and the words, word pairs and syllable pairs
    as ordinary ones, with every path layout; top domain and host prefix go in turn."""
    rows, invented = [], [a + b for a in SYLLABLES for b in SYLLABLES]
    pairs = [f"{a}-{WORDS[(i + d) % len(WORDS)]}" for i, a in enumerate(WORDS) for d in (1, 2, 5)]
    for label, sites in ((1, BLOCK_SITES), (0, (*ALLOW_SITES, *WORDS, *pairs, *invented))):
        for i, site in enumerate(sites):
            for j, path in enumerate(PATHS):
                host = f"{PREFIXES[(i + j) % len(PREFIXES)]}{site}.{TLDS[(i + 2 * j) % len(TLDS)]}"
                rows.append({"url": f"https://{host}{path.format(100 + 37 * i + j)}", "blocked": label})
    parsed = F.from_json(F.lit(json.dumps(rows)), "array<struct<url:string,blocked:int>>")
    return spark.range(1).select(F.explode(parsed).alias("r")).select("r.url", "r.blocked")


def _probability(features: Column, weights: Column) -> Column:
    """Logistic function of the features' summed weights over the square root of their number."""
    total = F.aggregate(features, F.lit(0.0), lambda a, i: a + F.element_at(weights, i + 1))
    return 1.0 / (1.0 + F.exp(-total / F.sqrt(F.size(features).cast("double"))))


def train(labelled: DataFrame, steps: int = STEPS, rate: float = RATE, l2: float = L2,
          sizes: Sequence[int] = NGRAMS, buckets: int = BUCKETS, max_rows: int = MAX_LABELLED) -> list[float]:
    """Full-batch gradient descent on (url, blocked), as one SQL expression over the small labelled table.

    The rows are gathered into one array, with an inverted index from bucket to rows; a step computes every row's
    error, then moves every bucket by the summed errors of its rows. The result is one number per bucket, whatever
    the data. Rows without a URL or label are left out; without any usable row all weights are zero (probability
    0.5). More than ``max_rows`` rows are refused: this trainer is for a small table.
    """
    host, path = split_url("url")
    usable = labelled.where("url IS NOT NULL AND blocked IS NOT NULL")
    n, blocked = usable.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    if n > max_rows:
        raise ValueError(f"more than {max_rows} labelled URLs")
    if not n:
        return [0.0] * buckets
    share = {1: n / (2.0 * blocked or 1.0), 0: n / (2.0 * (n - blocked) or 1.0)}  # both labels weigh the same
    rows = usable.select(F.struct("url", F.col("blocked").cast("double").alias("y"),
                                  url_features(host, path, sizes, buckets).alias("f")).alias("r")) \
        .agg(F.sort_array(F.collect_list("r")).alias("rows"))
    lists = rows.select(F.posexplode("rows").alias("i", "r")).select("i", F.explode("r.f").alias("b")) \
        .groupBy("b").agg(F.sort_array(F.collect_list("i")).alias("l"))
    empty = F.array().cast("array<int>")
    index = labelled.sparkSession.range(buckets).join(lists, F.col("id") == F.col("b"), "left") \
        .agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("l", empty).alias("l")))).alias("index"))

    def step(w):
        errors = F.transform("rows", lambda r: (_probability(r["f"], w) - r["y"]) / F.sqrt(F.size(r["f"]).cast("double"))
                             * F.when(r["y"] == 1.0, share[1]).otherwise(share[0]))
        # a one-element array binds the errors, so that they are computed once a step and not once a bucket
        return F.aggregate(F.array(errors), w, lambda w, e: F.transform("index", lambda x, i:
                           F.element_at(w, i + 1) * (1.0 - rate * l2) - rate / n * F.aggregate(
                               x["l"], F.lit(0.0), lambda a, j: a + F.element_at(e, j + 1))))

    both = rows.select("rows", F.lit(None).alias("index")).unionByName(index, allowMissingColumns=True) \
        .agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("rows", "index")])
    return list(both.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array_repeat(F.lit(0.0), buckets),
                                        lambda w, _: step(w)).alias("w")).first()["w"])


def filter_urls(df: DataFrame, url: str, weights: Sequence[float], rules: Sequence[tuple[str, str, str]] = RULES,
                threshold: float = THRESHOLD, sizes: Sequence[int] = NGRAMS) -> DataFrame:
    """``df`` with host, path, rule, p_block and verdict. A rule decides where one fits; else the URL is blocked if
    its probability is at least ``threshold``. A NULL URL or one without ``://`` has an empty host and path, fits no
    rule, and is judged by the model on them. Columns of ``df`` by those five names are replaced."""
    host, path = split_url(url)
    parts = df.withColumns({"host": host, "path": path}) if url not in ("host", "path") else \
        df.withColumn("_url", F.col(url)).withColumns(dict(zip(("host", "path"), split_url("_url"), strict=True)))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    model = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    p = _probability(url_features(F.col("host"), F.col("path"), sizes, len(weights)), model)
    out = parts.withColumns({"rule": rule, "p_block": p, "verdict": verdict})
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("p_block") >= threshold, "block")
                                                .otherwise("allow")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, "url", train(labelled_urls(spark))).drop("url")
