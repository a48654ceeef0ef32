"""Mentions in text: dictionary match, word rates, seeds, variants, containment and nearest joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dictionary_match(docs: DataFrame, id_col: str, words: Column, phrases: DataFrame, n: int) -> DataFrame:
    """(id, phrase, n_hits, first): where phrases of n words occur. An equi-join on the n-gram, so the dictionary may be large."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("_w", i, n), " "))
    g = docs.select(F.col(id_col).alias("id"), words.alias("_w")).filter(F.size("_w") >= n).select("id", F.posexplode(grams).alias("at", "phrase"))
    return g.join(phrases.select("phrase").distinct(), "phrase").groupBy("id", "phrase").agg(F.count("*").alias("n_hits"), F.min("at").alias("first"))


def word_rates(docs: DataFrame, words: Column, determiners: tuple[str, ...] = ("the", "a", "an"), least: int = 8) -> DataFrame:
    """For each word its count and how often a determiner comes before it."""
    w = docs.select(words.alias("_w")).select(F.explode(F.arrays_zip(F.col("_w").alias("w"), F.concat(F.array(F.lit("")), F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0)))).alias("p"))).alias("z")).select("z.w", "z.p")
    return w.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("total"), F.sum(F.col("p").isin(*determiners).cast("long")).alias("determined")).filter(F.col("total") >= least)


def variant_families(surfaces: DataFrame, surface: str, key: Column) -> DataFrame:
    """Surfaces by comparison key: how many spellings, and the shortest one (ties by text) as canonical."""
    return surfaces.groupBy(key.alias("key")).agg(F.countDistinct(surface).alias("n_surfaces"), F.min(F.struct(F.length(surface).alias("n"), F.col(surface).alias("s")))["s"].alias("canonical"))


def first_containing(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, span_id: str) -> DataFrame:
    """Each point with the first span of its key that contains it, null if none (spans are half-open).

    Points and span starts are dealt by key and slot, SLOTS slots for the widest span of a key; a span is
    dealt to the slots it covers, so that a key with many points and spans spreads over many tasks, and
    only those of one slot meet. A key's slots are as wide as its longest span divided by SLOTS.
    """
    width = spans.groupBy(*keys).agg(F.greatest(F.max(F.col(end) - F.col(start)) / SLOTS, F.lit(1e-9)).alias("_w"))
    slot = lambda at: F.floor(F.col(at) / F.col("_w"))
    dealt = spans.filter(F.col(end) > F.col(start)).join(width, keys).withColumn("_slot", F.explode(F.sequence(slot(start), slot(end))))
    asked = points.join(width, keys, "left").withColumn("_slot", slot(point)).drop("_w")
    hit = asked.join(dealt.drop("_w"), [*keys, "_slot"]).filter((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end)))
    best = hit.groupBy(*keys, point).agg(F.min_by(span_id, F.struct(start, span_id)).alias(span_id))
    return points.join(best, [*keys, point], "left")


#: Slots that the longest span of a key covers, one more or less.
SLOTS = 4


def nearest(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, within: int, left_id: str, right_id: str, backward: bool = False) -> DataFrame:
    """For each left row the nearest right row of its key closer than `within` (before it, if backward); ties by id.

    Both sides run through one window a key, in order, carrying the last right row forwards and the next
    one back: no pairs are made. Right rows at one place count by their least id.
    """
    places = right.groupBy(*keys, b).agg(F.min(right_id).alias(right_id))
    both = left.select(*keys, F.col(a).alias("_at"), left_id, F.lit(None).alias("_r")).unionByName(places.select(*keys, F.col(b).alias("_at"), F.lit(None).alias(left_id), F.struct(F.col(b).alias("at"), F.col(right_id).alias("id")).alias("_r")))
    # Right rows come before left ones of the same place; backward means strictly before.
    order = Window.partitionBy(*keys).orderBy("_at", F.col("_r").isNull() if not backward else F.col("_r").isNotNull())
    carried = both.withColumn("_p", F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if not backward:
        carried = carried.withColumn("_n", F.first("_r", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    gap = lambda c: F.abs(F.col("_at") - F.col(c)["at"])
    choices = [F.when(gap(c) < within, F.struct(gap(c).alias("gap"), F.col(c)["id"].alias(right_id))) for c in (("_p",) if backward else ("_p", "_n"))]
    best = choices[0] if backward else F.least(*choices)
    return carried.filter(F.col("_r").isNull()).select(left_id, best.alias("_b")).filter("_b is not null").groupBy(left_id).agg(F.min("_b").alias("_b")).select(left_id, F.col("_b")[right_id].alias(right_id), F.col("_b")["gap"].alias("gap"))


def co_occurrence(mentions: DataFrame, scope: list[str], target: str, least: int = 2, top: int | None = None) -> DataFrame:
    """Unordered pairs of targets that share a scope, with weight and first scope; among the `top` targets with the most mentions, if given (ties by target).

    A scope's targets are gathered into one sorted array, and each pairs with those after it, so a scope is
    moved once and its pairs are made by the task that holds it.
    """
    if top is not None:
        kept = mentions.groupBy(target).agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), target).limit(top)
        mentions = mentions.join(F.broadcast(kept.select(target)), target, "left_semi")  # as many rows as asked for
    m = mentions.groupBy(*scope).agg(F.array_sort(F.collect_set(target)).alias("_all")).filter(F.size("_all") > 1)
    first = m.select(*scope, "_all", F.posexplode("_all").alias("_i", "a"))
    pairs = first.select(*scope, "a", F.explode(F.slice("_all", F.col("_i") + 2, F.size("_all"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight"), F.min(scope[0]).alias("first")).filter(F.col("weight") >= least)
