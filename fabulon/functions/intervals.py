"""Fuzzy intervals: each bound is a range, membership is certain, plausible or excluded.

An interval is half-open and given by four doubles, -inf and +inf included: it starts somewhere
in [from_lb, from_ub] and ends somewhere in [to_lb, to_ub].
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CERTAIN, PLAUSIBLE, EXCLUDED = "CERTAIN", "PLAUSIBLE", "EXCLUDED"
FIELDS = ("from_lb", "from_ub", "to_lb", "to_ub")


def columns(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + f) for f in FIELDS)


def contains(interval: tuple[Column, ...], pos: Column) -> Column:
    from_lb, from_ub, to_lb, to_ub = interval
    return F.when((pos < from_lb) | (pos >= to_ub), EXCLUDED).when((pos >= from_ub) & (pos < to_lb), CERTAIN).otherwise(PLAUSIBLE)


def overlaps(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return (
        F.when((a[3] <= b[0]) | (b[3] <= a[0]), EXCLUDED)
        .when((a[1] < b[2]) & (b[1] < a[2]), CERTAIN)
        .otherwise(PLAUSIBLE)
    )


def rank(certainty: Column) -> Column:
    """2, 1, 0: the conjunction of certainties is the least rank."""
    return F.when(certainty == CERTAIN, 2).when(certainty == PLAUSIBLE, 1).otherwise(0)


def named(rank_: Column) -> Column:
    return F.when(rank_ >= 2, CERTAIN).when(rank_ == 1, PLAUSIBLE).otherwise(EXCLUDED)


def conjunction(*certainties: Column) -> Column:
    ranks = [rank(c) for c in certainties]
    return named(F.least(*ranks) if len(ranks) > 1 else ranks[0])


def is_open(interval: tuple[Column, ...]) -> Column:
    return interval[3] == float("inf")


def is_start_known(interval: tuple[Column, ...]) -> Column:
    return interval[0] == interval[1]


def is_end_known(interval: tuple[Column, ...]) -> Column:
    return interval[2] == interval[3]


def valid(interval: tuple[Column, ...]) -> Column:
    a, b, c, d = interval
    return (a <= b) & (c <= d) & (d >= a)


def _struct(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.struct(*[x.cast("double").alias(f) for x, f in zip((a, b, c, d), FIELDS, strict=True)])


def point_known(start: Column, end: Column) -> Column:
    return _struct(start, start, end, end)


def open_ended(start: Column, start_ub: Column | None = None, last_evidence: Column | None = None) -> Column:
    ub = F.coalesce(start_ub, start) if start_ub is not None else start
    to_lb = F.coalesce(last_evidence, ub) if last_evidence is not None else ub
    return _struct(start, ub, to_lb, F.lit(float("inf")))


def since_before(first_evidence: Column) -> Column:
    return _struct(F.lit(float("-inf")), first_evidence, first_evidence, F.lit(float("inf")))


def unbounded() -> Column:
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    return _struct(low, low, high, high)


def with_evidence_through(interval: tuple[Column, ...], position: Column) -> Column:
    a, b, c, d = interval
    return _struct(a, b, F.greatest(c, position), F.greatest(d, position))


def with_end(interval: tuple[Column, ...], end_lb: Column, end_ub: Column) -> Column:
    return _struct(interval[0], interval[1], end_lb, end_ub)
