"""The append-only log: numbering, replay, overlays and invalidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabulon.session import cut


def replay(events: DataFrame, up_to: int) -> DataFrame:
    """The fold of the log to a position: for each id and type the last value, its seq, and how many events there were."""
    return events.filter(F.col("learned") <= up_to).groupBy("id", "type").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"), F.count("*").alias("n_events"))


def numbered(batch: DataFrame, log: DataFrame, seq: str, order: str) -> DataFrame:
    """A batch with sequence numbers that continue the log's.

    Numbers run through the batch in order without meeting in one task: rows are range-dealt by
    the order column, counted by partition, and numbered inside it. A batch is small beside the
    log, but nothing depends on that.
    """
    spark = batch.sparkSession
    start = log.agg(F.coalesce(F.max(seq), F.lit(0)).alias("_start"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = batch.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id())
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    row = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.join(F.broadcast(before), "_part").crossJoin(F.broadcast(start)).select(*batch.columns, (F.col("_start") + F.col("_before") + row).cast("long").alias(seq))


def invalidated(artifacts: DataFrame, changed: DataFrame) -> DataFrame:
    """Artifacts whose read set holds a changed fact (ref): a semi-join on exploded sets, one row for each artifact."""
    hit = artifacts.select("id", F.explode("read_set").alias("ref")).join(changed, "ref", "left_semi").select("id").distinct()
    return artifacts.join(hit, "id", "left_semi")


def read_set_digest(reads: DataFrame) -> DataFrame:
    """id, digest of the sorted distinct refs read, and their number."""
    refs = F.array_sort(F.collect_set("ref"))
    return reads.groupBy("id").agg(F.sha2(F.array_join(refs, "\n"), 256).alias("read_set_hash"), F.size(refs).cast("long").alias("n_refs"))


def redirect_roots(merges: DataFrame) -> DataFrame:
    """from_id, root: each merge followed to where it ends, by pointer jumping (a chain of n takes log n joins).

    Ids on a cycle, and those that lead to one, end at the cycle's smallest id. After k rounds each id
    has seen the 2 ** k ids that follow it and carries the least of them; when all ids that still
    move have gone round (as many steps as there are merges), the least one seen by the id they
    stand at is their cycle's. Of several merges of one id the least target counts. Every round is
    cut from its lineage by a checkpoint in the session's shared folder.
    """
    edges = merges.filter("from_id is not null and to_id is not null").groupBy("from_id").agg(F.min("to_id").alias("to_id"))
    now = cut(edges.select("from_id", F.col("to_id").alias("at"), F.col("to_id").alias("least")))
    steps, n = 1, now.count()
    while steps < n + 1:
        hop = now.select(F.col("from_id").alias("at"), F.col("at").alias("_next"), F.col("least").alias("_least"))
        now = cut(now.join(hop, "at", "left").select("from_id", F.coalesce("_next", "at").alias("at"), F.least("least", F.coalesce("_least", "least")).alias("least"), F.col("_next").isNotNull().alias("moved")))
        steps *= 2
        if not now.filter("moved").limit(1).count():
            break
        now = now.drop("moved")
    on = now.select(F.col("from_id").alias("at"), F.col("least").alias("_cycle"))
    return now.join(on, "at", "left").select("from_id", F.coalesce("_cycle", "at").alias("root"))


def invalid_sequence(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Sequence numbers that a log holds more than once: none may."""
    return log.groupBy(seq).agg(F.count("*").alias("n")).filter("n > 1")
