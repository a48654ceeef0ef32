"""Registered queries and their SQL."""

from __future__ import annotations

from fabulon.plans import facts, narrative, speeches, texts

QUERIES: dict = facts.QUERIES | texts.QUERIES | speeches.QUERIES | narrative.QUERIES
SQL: dict[str, str] = facts.SQL | texts.SQL | speeches.SQL | narrative.SQL
