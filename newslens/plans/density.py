"""Registered queries of topics found by density, over the vectors of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newslens.operators.density import core_clusters, density_topics
from newslens.sources.tables import table

#: Radius and points of a core region. Vectors have about unit length: this is a cosine of 0.28.
RADIUS, MIN_POINTS = 1.2, 5


def topic_core_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core_clusters(table(spark, sf_dir, "embeddings"), RADIUS, MIN_POINTS)


def topic_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_topics(table(spark, sf_dir, "embeddings"))


SPARK = {"topic_core_clusters": topic_core_clusters, "topic_density": topic_density}

ORACLE = {
    "topic_core_clusters": f"""
WITH RECURSIVE near AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
                                     lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))) <= {RADIUS}),
n AS (SELECT e.vec_id, count(near.y) AS n_near FROM embeddings e LEFT JOIN near ON near.x = e.vec_id GROUP BY e.vec_id),
core AS (SELECT vec_id FROM n WHERE n_near + 1 >= {MIN_POINTS}),
reach AS (
  SELECT vec_id AS x, vec_id AS y FROM core
  UNION SELECT reach.x, near.y FROM reach JOIN near ON near.x = reach.y JOIN core ON core.vec_id = near.y),
root AS (SELECT x, min(y) AS root FROM reach GROUP BY x)
SELECT n.vec_id, n.n_near, coalesce(root.root, -1) AS cluster FROM n LEFT JOIN root ON root.x = n.vec_id""",
}
