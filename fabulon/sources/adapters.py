"""Driver tables in the shapes of the fact store, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(ts):
    return F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date"))


def _second(ts):
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("int")


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute facts with three time axes: each event is a fact about its user, open until the user's next event of its type."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", _day(F.col("ts")).alias("learned_chapter"), _second(F.col("ts")).alias("learned_offset"))
    e = e.withColumn("learned", F.col("learned_chapter").cast("long") * 1_000_000 + F.col("learned_offset")).withColumn("start", F.col("learned_chapter") * 24 + F.col("learned_offset") / 3600)
    order = [F.col(c).asc_nulls_last() for c in ("start", "event_id")]  # as the SQL has them
    same = Window.partitionBy("user_id", "event_type").orderBy(*order)
    user = Window.partitionBy("user_id").orderBy(*order)
    nxt = F.lead("start").over(same)
    error_after = F.min(F.when(F.col("event_type") == "error", F.col("learned"))).over(user.rowsBetween(1, Window.unboundedFollowing))
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("target_id"), F.col("event_type").alias("key"), "value",
        F.when(F.col("event_id") % 11 == 0, "dream").when(F.col("event_id") % 13 == 0, "loop").otherwise("main").alias("timeline_id"),
        F.col("start").alias("from_lb"), (F.col("start") + 1).alias("from_ub"),
        F.coalesce(nxt, F.col("start") + 1).alias("to_lb"), F.coalesce(nxt + 2, F.lit(float("inf"))).alias("to_ub"),
        "learned",
        F.when(F.col("event_id") % 3 == 0, "READER").when(F.col("event_id") % 3 == 1, "SYSTEM").otherwise(F.concat(F.lit("G"), (F.col("user_id") % 3).cast("string"))).alias("observer_id"),
        F.when(F.col("event_id") % 7 == 0, "FALSE").when(F.col("event_id") % 7 == 1, "CLAIMED").otherwise("TRUE").alias("truth_status"),
        F.when(F.col("event_id") % 5 == 0, error_after).alias("retracted"),
    )


EVENT_FACTS_SQL = """
e AS (SELECT event_id, user_id, event_type, value, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS ch,
        CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS off FROM events),
e2 AS (SELECT *, CAST(ch AS BIGINT) * 1000000 + off AS learned, ch * 24 + off / 3600.0::DOUBLE AS start FROM e),
facts AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS target_id, event_type AS "key", value,
    CASE WHEN event_id % 11 = 0 THEN 'dream' WHEN event_id % 13 = 0 THEN 'loop' ELSE 'main' END AS timeline_id,
    start AS from_lb, start + 1 AS from_ub,
    coalesce(lead(start) OVER same, start + 1) AS to_lb, coalesce(lead(start) OVER same + 2, 'infinity'::DOUBLE) AS to_ub, learned,
    CASE WHEN event_id % 3 = 0 THEN 'READER' WHEN event_id % 3 = 1 THEN 'SYSTEM' ELSE 'G' || CAST(user_id % 3 AS VARCHAR) END AS observer_id,
    CASE WHEN event_id % 7 = 0 THEN 'FALSE' WHEN event_id % 7 = 1 THEN 'CLAIMED' ELSE 'TRUE' END AS truth_status,
    CASE WHEN event_id % 5 = 0 THEN min(CASE WHEN event_type = 'error' THEN learned END) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS retracted
  FROM e2 WINDOW same AS (PARTITION BY user_id, event_type ORDER BY start, event_id))"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of questions: every user at two positions, for three observers, knowing all up to the position's day."""
    grid = spark.createDataFrame([(p, o, int(p // 24) * 1_000_000 + 86_400) for p in (240.0, 480.5) for o in ("READER", "SYSTEM", "G1")], "position double, observer string, known long")
    users = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("target_id")).distinct()
    # The grid has six rows whatever the corpus.
    return users.join(F.broadcast(grid))


REQUESTS_SQL = """
requests AS (SELECT target_id, position, observer, CAST(floor(position / 24) AS BIGINT) * 1000000 + 86400 AS known
  FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS target_id FROM events), (VALUES (240.0::DOUBLE), (480.5)) p(position), (VALUES ('READER'), ('SYSTEM'), ('G1')) o(observer))"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chapters, their lines as blocks."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chapter"), "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block_index", "text"))


BLOCKS_SQL = """
blocks AS (SELECT doc_id AS chapter, lang, source, CAST(i - 1 AS INTEGER) AS block_index, parts[i] AS text
  FROM (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) t(i))"""
