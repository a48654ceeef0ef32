"""What an observer knows at a position: scope, learning, truth and retraction as one predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fabulon.schema import SYSTEM


def in_scope(fact_observer: Column, observer: Column) -> Column:
    """SYSTEM sees all; anyone else only their own facts."""
    return (observer == SYSTEM) | (fact_observer == observer)


def visible(fact_observer: Column, learned: Column, truth: Column, retracted: Column, observer: Column, known: Column) -> Column:
    """Positions compare as structs or sortable numbers, in reading order.

    A retracted fact counts until its retraction, whatever its truth status; without one it
    counts unless it is FALSE.
    """
    believed = F.when(retracted.isNotNull(), known < retracted).otherwise(truth != "FALSE")
    return (observer == SYSTEM) | ((fact_observer == observer) & (learned <= known) & believed)
