"""Evaluation: B-cubed, recall at k, conformal thresholds, Platt scaling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bcubed(mentions: DataFrame, gold: str, system: str) -> DataFrame:
    """precision, recall, f1 over mentions (system null: unresolved). Per-mention averages are sums over cells of the contingency table."""
    cells = mentions.groupBy(gold, system).agg(F.count("*").alias("n"))
    by_gold = cells.groupBy(gold).agg(F.sum("n").alias("g"))
    by_system = cells.filter(F.col(system).isNotNull()).groupBy(system).agg(F.sum("n").alias("s"))
    joined = cells.join(by_gold, gold).join(by_system, system, "left")
    scored = F.col("s").isNotNull()
    sums = joined.agg(
        F.sum(F.when(scored, F.col("n") * F.col("n") / F.col("s"))).alias("p"), F.sum(F.when(scored, F.col("n"))).alias("np"),
        F.sum(F.when(scored, F.col("n") * F.col("n") / F.col("g")).otherwise(0.0)).alias("r"), F.sum("n").alias("nr"),
    )
    out = sums.select((F.col("p") / F.col("np")).alias("precision"), (F.col("r") / F.col("nr")).alias("recall"))
    return out.select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 9).alias("f1"))


def recall_at(cases: DataFrame, kind: str, rank: str, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Cases found within k, overall (kind null) and by kind."""
    return cases.groupingSets([[], [F.col(kind)]], F.col(kind)).agg(F.count("*").alias("n_cases"), *[F.sum(F.when(F.col(rank) <= k, 1).otherwise(0)).cast("long").alias(f"hits_{k}") for k in ks])


def conformal(examples: DataFrame, score: str, correct: str, alpha: float = 0.05, margin: float = 0.05, fallback: tuple[float, float] = (0.80, 0.35), digits: int | None = 6) -> DataFrame:
    """link_threshold and new_threshold: order statistics at int(alpha * n) of wrong scores descending and right ones ascending.

    Scores are rounded to `digits`, which bounds how many different ones are ordered in one task; None takes them as they are.
    """

    def at(rows: DataFrame, order, name: str) -> DataFrame:
        n = rows.agg(F.count("*").alias("n"))
        w = Window.orderBy(order)
        # Scores are counted first, so what is ordered in one task is the distinct scores (rounded to six digits: a bounded number).
        counts = rows.groupBy("score").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(w))
        return counts.crossJoin(n).filter(F.col("upto") > F.floor(F.col("n") * alpha)).agg(F.min_by("score", "upto").alias(name))

    rounded = lambda c: c if digits is None else F.round(c, digits)
    rows = examples.select(rounded(F.col(score)).alias("score"), F.col(correct).alias("ok"))
    link = at(rows.filter("not ok"), F.col("score").desc(), "l")
    new = at(rows.filter("ok"), F.col("score").asc(), "r")
    t = link.crossJoin(new).select("l", F.least("r", F.col("l") - margin).alias("m"))
    good = F.col("l").isNotNull() & F.col("m").isNotNull() & (F.col("m") < F.col("l"))
    return t.select(rounded(F.when(good, F.col("l")).otherwise(fallback[0])).alias("link_threshold"), rounded(F.when(good, F.col("m")).otherwise(fallback[1])).alias("new_threshold"))


def platt(examples: DataFrame, score: str, correct: str, steps: int = 200, rate: float = 0.05, digits: int | None = 3) -> DataFrame:
    """a, b of sigmoid(a * score + b) by gradient descent on counts of scores rounded to `digits` (a bounded histogram on the driver); None takes them as they are, a row for each different score."""
    hist = examples.groupBy((F.col(score) if digits is None else F.round(score, digits)).alias("s")).agg(F.sum(F.col(correct).cast("double")).alias("y"), F.count("*").alias("n")).orderBy("s").collect()
    s, y, n = (np.array([r[i] for r in hist], dtype=np.float64) for i in range(3))
    a, b = 1.0, 0.0
    for _ in range(steps if len(s) else 0):
        g = n / (1 + np.exp(-np.clip(a * s + b, -60, 60))) - y
        a, b = a - rate * float((g * s).sum() / n.sum()), b - rate * float(g.sum() / n.sum())
    return examples.sparkSession.createDataFrame([(round(a, 6), round(b, 6), int(n.sum()))], "a double, b double, n_examples long")
