"""Entities per article, entity counts per topic, top entities and related topics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslens import fixed
from newslens.functions import patterns as P
from newslens.functions import text as tx
from newslens.operators.joins import lookup_join
from newslens.session import cut_lineage


# A small default gazetteer (our own): names in lower case and the label of their entities.
GAZETTEER = {
    "berlin": "LOC", "hamburg": "LOC", "münchen": "LOC", "köln": "LOC", "frankfurt": "LOC", "deutschland": "LOC",
    "europa": "LOC", "ukraine": "LOC", "russland": "LOC", "israel": "LOC", "gaza": "LOC", "usa": "LOC", "china": "LOC",
    "olaf scholz": "PER", "scholz": "PER", "robert habeck": "PER", "christian lindner": "PER", "friedrich merz": "PER",
    "joe biden": "PER", "donald trump": "PER", "wladimir putin": "PER", "wolodymyr selenskyj": "PER",
    "bundestag": "ORG", "bundesregierung": "ORG", "deutsche bahn": "ORG", "europäische union": "ORG", "nato": "ORG",
    "spd": "ORG", "cdu": "ORG", "fdp": "ORG", "afd": "ORG", "die grünen": "ORG", "vereinte nationen": "ORG",
}
OTHER_LABEL = "MISC"


def capitalised_entities(text_col: str = "content", label: str = OTHER_LABEL, stop=(),
                         gazetteer: Mapping[str, str] | None = None) -> Column:
    """Default entity extractor: runs of words that start with an upper-case letter and are separated by single
    spaces, as ``array<struct<text, label>>`` in text order (a stand-in for a trained recogniser).

    Stop words are taken out of a run. The label is that of the lower-cased run in ``gazetteer``, a small fixed
    dictionary (for a table of names see `label_mentions`), else ``label``.
    """
    spans = F.regexp_extract_all(F.col(text_col), F.lit(P.CAPITALISED_RUN), 1)
    stop = tuple(stop)
    if stop:
        spans = F.transform(spans, lambda s: F.array_join(F.filter(F.split(s, " "), lambda w: ~F.lower(w).isin(*stop)), " "))
    spans = F.filter(spans, lambda s: s != "")
    names = F.create_map(*[F.lit(x) for kv in (gazetteer or {}).items() for x in kv]) if gazetteer else None

    def entity(s):
        own = F.lit(label) if names is None else F.coalesce(F.element_at(names, F.lower(s)), F.lit(label))
        return F.struct(s.alias("text"), own.alias("label"))

    return F.transform(spans, entity)


def label_mentions(mentions: DataFrame, gazetteer: DataFrame, entity_col: str = "entity",
                   label: str = OTHER_LABEL) -> DataFrame:
    """Adds ``label`` to mention or count rows from a gazetteer table (name, label); unknown names get ``label``. Names
    meet in lower case; of several labels of a name the first in order counts. The table is broadcast only if its
    measured size is small."""
    names = gazetteer.groupBy(F.lower("name").alias("_name")).agg(F.min("label").alias("label"))
    out = lookup_join(mentions.withColumn("_name", F.lower(entity_col)), names, "_name", "left")
    return out.withColumn("label", F.coalesce("label", F.lit(label))).drop("_name")


def entity_count_map(entities_col: str = "entities") -> Column:
    """``[(A,PER),(A,PER),(B,LOC)]`` → ``{A: 2, B: 1}`` (keys in first-seen order); NULL or no
    entities → empty map. A map cannot hold a NULL key, so NULL names are skipped.

    Evaluated inside the row, no shuffle, in O(n log n) for n mentions: the
    (name, position) pairs are sorted, each run of equal names gives one count
    and its first position, and the runs are put back in first-seen order.
    (Counting each distinct name with a filter over the list would be
    quadratic on a long article.)
    """
    names = F.filter(F.transform(F.coalesce(F.col(entities_col), F.array()), lambda e: e["text"]),
                     lambda x: x.isNotNull())
    pairs = F.array_sort(F.transform(names, lambda x, i: F.struct(x.alias("k"), i.alias("p"))))

    def runs(s):
        n = F.size(s)
        idx = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
        starts = F.filter(idx, lambda i: (i < n) & ((i == 0) | (s[i]["k"] != s[i - 1]["k"])))

        def per_run(st):
            m = F.size(st)
            ends = F.transform(st, lambda b, j: F.when(j + 1 < m, st[j + 1]).otherwise(n))
            r = F.transform(F.arrays_zip(st.alias("b"), ends.alias("e")), lambda z: F.struct(
                s[z["b"]]["p"].alias("p"), s[z["b"]]["k"].alias("k"), (z["e"] - z["b"]).cast("long").alias("c")))
            return F.array_sort(r)

        return tx.bind(starts, per_run)

    ordered = tx.bind(pairs, runs)
    return F.map_from_arrays(F.transform(ordered, lambda r: r["k"]), F.transform(ordered, lambda r: r["c"]))


def topic_entity_mentions(df: DataFrame, entities_col: str = "entities", topic_col: str = "topic") -> DataFrame:
    """(topic, entity, n_mentions) from articles that carry their own entity list and topic.

    The topic is on the article row, so the mentions are counted straight from
    the exploded lists (partial aggregation per task, no join back to the
    articles).
    """
    m = df.where(F.col(topic_col).isNotNull()).select(
        F.col(topic_col).alias("topic"), F.explode(F.col(entities_col)["text"]).alias("entity"))
    return m.where(F.col("entity").isNotNull()).groupBy("topic", "entity").agg(F.count("*").alias("n_mentions"))


def topic_entity_counts(articles: DataFrame, refs: DataFrame, entity_dim: DataFrame,
                        key: str = "article_id", ref: str = "item_id") -> DataFrame:
    """(topic, entity, n_mentions) when mentions point at an item table that names the entity.

    ``refs`` has one row per mention (``key``, ``ref``); ``entity_dim`` maps
    ``ref`` → ``entity``. Mentions are counted per (topic, item) first — a
    partial aggregate that shrinks the fact side before the item names are
    joined — and the counts are then summed per (topic, entity).
    """
    per_item = refs.join(articles.select(key, "topic"), key).where(F.col("topic").isNotNull()) \
        .groupBy("topic", ref).agg(F.count("*").alias("_n"))
    named = per_item.join(entity_dim, ref)
    return named.groupBy("topic", "entity").agg(F.sum("_n").alias("n_mentions"))


def top_entities(counts: DataFrame, n: int = fixed.TOP_ENTITIES) -> DataFrame:
    """The ``n`` most mentioned entities per topic (ties: entity name).

    ``row_number() <= n`` is planned as a window group limit, which keeps only
    the top ``n`` per topic inside every task before the shuffle.
    """
    w = Window.partitionBy("topic").orderBy(F.desc("n_mentions"), F.asc("entity"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def related_topics(top: DataFrame) -> DataFrame:
    """Pairs of different topics whose top-entity sets overlap, with the overlap size.

    Self equi-join on the entity: each topic brings at most ``n`` entities. An entity that is in the top of t
    topics gives t * (t - 1) / 2 rows, so the join is bounded by the number of topics squared (never by
    articles): fine for a label list, not for an unbounded topic column. Each pair is counted once (``a < b``) and
    mirrored after the aggregate. ``top`` is read twice and is written to the checkpoint folder once (it has at
    most n rows per topic).
    """
    top = cut_lineage(top.select("topic", "entity"))
    b = top.select(F.col("topic").alias("related_topic"), "entity")
    once = top.join(b, "entity").where(F.col("topic") < F.col("related_topic")) \
        .groupBy("topic", "related_topic").agg(F.count("*").alias("overlap"))
    both = F.explode(F.array(F.struct(F.col("topic").alias("x"), F.col("related_topic").alias("y")),
                             F.struct(F.col("related_topic").alias("x"), F.col("topic").alias("y"))))
    return once.select(both.alias("p"), "overlap").select(F.col("p.x").alias("topic"), F.col("p.y").alias("related_topic"), "overlap")


def attach_related(articles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds ``related_topics: array<struct<topic, overlap>>`` (overlap desc, topic asc) per article;
    topics without related topics get an empty array."""
    per_topic = pairs.groupBy("topic").agg(F.sort_array(F.collect_list(
        F.struct((F.lit(0) - F.col("overlap")).alias("neg"), F.col("related_topic").alias("t"))))
        .alias("_s"))
    per_topic = per_topic.select("topic", F.transform("_s", lambda s: F.struct(
        s["t"].alias("topic"), (F.lit(0) - s["neg"]).alias("overlap"))).alias("related_topics"))
    out = lookup_join(articles, cut_lineage(per_topic), "topic", "left")  # a row per topic, measured once
    empty = F.array().cast("array<struct<topic:string,overlap:bigint>>")
    return out.withColumn("related_topics", F.coalesce("related_topics", empty))
