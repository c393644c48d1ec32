"""Article table sources: the enriched table on disk, and the article view over the test tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens import fixed
from newslens.functions import dates
from newslens.sources.tables import read_stored, table


def _is_nested(dt) -> bool:
    return isinstance(dt, (T.ArrayType, T.MapType, T.StructType))


def read_csv_articles(spark: SparkSession, path: str, schema, corrupt_col: str | None = None) -> DataFrame:
    """CSV edge reader: columns by the file's header, quoted multi-line fields.

    The header decides which column is which: other orders are fine, columns that ``schema`` does not name (such as a
    leading index without a name) are left out, and those the file lacks are NULL. All fields are read as text
    and cast; the text ``None`` that the original writes for missing labels is NULL. Nested columns (entities,
    entity counts, related topics) are stored as JSON text in CSV; text that does not parse gives NULL.
    ``corrupt_col`` names a column for the names of the fields that hold text which could not be read as their type.
    """
    reader = (spark.read.option("header", True).option("inferSchema", False).option("multiLine", True)
              .option("escape", '"').option("mode", "PERMISSIVE"))
    df = reader.option("enforceSchema", False).csv(path)  # every file's header must be that of the first
    if any(name == f"_c{i}" for i, name in enumerate(df.columns)):
        df = reader.option("enforceSchema", True).csv(path)  # a column without a name fails Spark's header check
    cols, broken = [], []
    for f in schema.fields:
        if f.name not in df.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        text = F.col(f"`{f.name}`")
        text = F.when(text != "None", text)
        value = text if isinstance(f.dataType, T.StringType) else \
            F.from_json(text, f.dataType) if _is_nested(f.dataType) else text.try_cast(f.dataType)
        cols.append(value.alias(f.name))
        broken.append(F.when(text.isNotNull() & value.isNull(), F.lit(f.name)))
    if corrupt_col:
        names = F.array_compact(F.array(*broken))
        cols.append(F.when(F.size(names) > 0, F.array_join(names, ",")).alias(corrupt_col))
    return df.select(cols)


def write_csv_articles(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV edge writer: nested columns as JSON text, no index column."""
    out = df.select([F.to_json(F.col(f.name)).alias(f.name) if _is_nested(f.dataType) else F.col(f.name)
                     for f in df.schema.fields])
    out.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_or_empty(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """History table, or an empty frame of ``schema`` if there is no such path yet. Other failures are raised."""
    if read_stored(spark, path, None if fmt == "csv" else schema, fmt) is None:
        return spark.createDataFrame([], schema)
    return read_csv_articles(spark, path, schema) if fmt == "csv" else spark.read.schema(schema).format(fmt).load(path)


def prepare_for_dashboard(df: DataFrame, month_floor: int | None = fixed.MONTH_FLOOR,
                          excluded_topic: str | None = fixed.EXCLUDED_TOPIC) -> DataFrame:
    """Load rules of the dashboard: month floor on ``datetime`` (unknown dates kept) and one
    excluded topic (NULL topics kept)."""
    out = df.where(dates.month_floor_ok("datetime", month_floor))
    if excluded_topic is not None:
        out = out.where(~F.col("topic").eqNullSafe(excluded_topic))
    return out


# Partition column of the stored article table: yyyyMM of ``datetime`` as an
# integer, NULL when the text does not start with six digits.
MONTH_PARTITION = "pub_month"


def write_articles(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store enriched articles as parquet partitioned by publication month.

    Readers that keep only recent months (the dashboard's month floor) then
    read only those partitions; unknown dates land in the NULL partition.
    """
    prefix = dates.month_prefix("datetime")
    month = F.when(prefix.rlike(r"^[0-9]{6}$"), prefix.try_cast("int"))
    df.withColumn(MONTH_PARTITION, month).write.mode(mode).partitionBy(MONTH_PARTITION).parquet(path)


def load_articles(spark: SparkSession, path: str, fmt: str = "parquet",
                  month_floor: int | None = fixed.MONTH_FLOOR,
                  excluded_topic: str | None = fixed.EXCLUDED_TOPIC, persist: bool = False) -> DataFrame:
    """Enriched article table with the dashboard's load rules applied.

    ``persist`` keeps the loaded rows (memory, spilling to disk) for a session
    that answers many queries over the same table, like the dashboard's
    memoised load; the caller ends it with ``unpersist()``.
    """
    df = spark.read.format(fmt).load(path)
    if month_floor is not None and MONTH_PARTITION in df.columns:
        # Partition filter, a superset of the exact rule below: only the
        # partitions of unknown or recent months are read.
        m = F.col(MONTH_PARTITION)
        df = df.where(m.isNull() | (m >= F.lit(month_floor)))
    out = prepare_for_dashboard(df, month_floor, excluded_topic)
    return out.persist(StorageLevel.MEMORY_AND_DISK) if persist else out


def leaning_of_nation(nationkey) -> F.Column:
    k = F.col(nationkey) if isinstance(nationkey, str) else nationkey
    return (F.when(k == 0, "rechts").when(k <= 2, "mitte_rechts").when(k <= 8, "mitte")
            .when(k <= 15, "mitte_links").otherwise("links"))


def article_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article table over the order tables: one article per order.

    topic from the customer key, outlet = nation name, leaning from the nation
    key, sentiment from the order status, ``datetime`` = order date as digits.
    The nation join is left to the planner: the dimension is tiny and its
    parquet size is known, so it is broadcast without a hint; the customer join
    is a shuffle join on the customer key (AQE splits a hot customer).
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    topic_no = F.floor(F.sqrt(F.col("o_custkey") % 1000)).cast("int").cast("string")
    return j.select(
        F.col("o_orderkey").alias("article_id"),
        F.concat(F.lit("https://www."), F.lower("n_name"), F.lit(".de/"),
                 F.col("o_orderkey").cast("string")).alias("url"),
        F.concat(F.lit("T"), F.lpad(topic_no, 2, "0")).alias("topic"),
        F.col("n_name").alias("source"),
        leaning_of_nation("c_nationkey").alias("pol_leaning"),
        F.when(F.col("o_orderstatus") == "F", "negative").when(F.col("o_orderstatus") == "O", "neutral")
        .otherwise("positive").alias("sentiment"),
        F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("datetime"),
    )


# SQL text of the same view, for the DuckDB oracle.
ARTICLE_VIEW_SQL = """articles AS (
  SELECT o_orderkey AS article_id,
         'https://www.' || lower(n_name) || '.de/' || cast(o_orderkey AS varchar) AS url,
         'T' || lpad(cast(cast(floor(sqrt(o_custkey % 1000)) AS integer) AS varchar), 2, '0') AS topic,
         n_name AS source,
         CASE WHEN c_nationkey = 0 THEN 'rechts' WHEN c_nationkey <= 2 THEN 'mitte_rechts'
              WHEN c_nationkey <= 8 THEN 'mitte' WHEN c_nationkey <= 15 THEN 'mitte_links'
              ELSE 'links' END AS pol_leaning,
         CASE o_orderstatus WHEN 'F' THEN 'negative' WHEN 'O' THEN 'neutral' ELSE 'positive' END AS sentiment,
         strftime(o_orderdate, '%Y%m%d%H%M%S') AS datetime
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
