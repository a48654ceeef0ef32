"""Order-dependent operators as window expressions: islands, carries, epochs, turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str | Column], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a new one begins where `starts` holds (an expression that may use lag over the same order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_s", F.coalesce(starts.cast("int"), F.lit(1))).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_s")


def turn_taking(turns: DataFrame, key: str, order: str, speaker: str) -> DataFrame:
    """Guesses each speaker from the last four known ones: where these are exactly two, whoever did not speak last."""
    last = F.collect_list(speaker).over(Window.partitionBy(key).orderBy(order).rowsBetween(-4, -1))
    df = turns.withColumn("_last", last).withColumn("_two", F.array_distinct("_last"))
    latest = F.element_at("_last", F.size("_last"))
    return df.withColumn("guess", F.when(F.size("_two") == 2, F.when(latest == F.col("_two")[1], F.col("_two")[0]).otherwise(F.col("_two")[1]))).drop("_last", "_two")


def slots(df: DataFrame, key: str, order: str, unknown: Column, count: int = 4) -> DataFrame:
    """A rotating slot 1..count for each row of a run of unknown rows."""
    w = Window.partitionBy(key).orderBy(order)
    run = islands(df.withColumn("_u", unknown), [key], [order], F.col("_u") != F.lag("_u").over(w), "_run").filter("_u")
    return run.withColumn("slot", ((F.row_number().over(Window.partitionBy(key, "_run").orderBy(order)) - 1) % count + 1).cast("int")).drop("_u", "_run")


def carried(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """The last value that was not null, up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def epochs(changes: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Change points to half-open intervals, the last one open; repeats of the value in force are no change. Points without a place come last."""
    w = Window.partitionBy(key).orderBy(F.col(pos).asc_nulls_last())
    kept = changes.withColumn("_p", F.lag(value).over(w)).filter(F.col("_p").isNull() | (F.col("_p") != F.col(value))).drop("_p")
    return kept.select(key, value, F.col(pos).alias("from_pos"), F.coalesce(F.lead(pos).over(w).cast("double"), F.lit(float("inf"))).alias("to_pos"))


def merged_ranges(ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching ranges of a key as one. Ranges without a start come last and count with the last one."""
    order = [F.col(c).asc_nulls_last() for c in (start, end)]
    reach = F.max(end).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    grouped = islands(ranges, [key], order, F.coalesce(F.col(start) > reach, F.lit(False)))
    return grouped.groupBy(key, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n_ranges")).drop("island")
