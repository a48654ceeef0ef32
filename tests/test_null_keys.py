"""Queries whose SQL orders nulls last, on tables with null, negative and very large keys, against that SQL."""

import datetime

import duckdb
import pytest

from fabulon.operators import anaphora
from fabulon.plans.registry import QUERIES, SQL

_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
_ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp"


def _same(spark, folder, name, query, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    c = duckdb.connect()
    c.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    df = QUERIES[query](spark, str(folder))
    found = c.execute(SQL[query])
    at = [[x[0] for x in found.description].index(n) for n in df.columns]
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)
    assert sorted(map(tuple, df.collect()), key=str) == want and want


def _events(shift=0, null_ts=0, null_id=0, null_user=0):
    day, gone = datetime.datetime(2024, 1, 3), lambda k, i: k and i % k == 0
    kinds = ("click", "view", "error", "signup", "purchase")
    return [(None if gone(null_id, i) else i * 100 + shift, None if gone(null_ts, i) else day + datetime.timedelta(minutes=i * 17), None if gone(null_user, i) else i % 3, kinds[(i + i // 7) % 5], float(i), "{}") for i in range(1, 60)]


@pytest.mark.parametrize("query", ["evidence_extend", "interval_constructors"])
def test_facts_without_a_time_come_last(spark, tmp_path, query):
    _same(spark, tmp_path, "events", query, _events(null_ts=7), _EVENTS)


@pytest.mark.parametrize("given", [{"null_id": 7}, {"shift": -3_100}, {"shift": 1 << 62}])
def test_epochs_of_any_number(spark, tmp_path, given):
    _same(spark, tmp_path, "events", "epochs", _events(**given), _EVENTS)


def test_ranges_without_a_start_count_with_the_last(spark, tmp_path):
    day = datetime.datetime(1995, 1, 1)
    rows = [(i, None if i % 5 == 4 else i % 4, None if i % 6 == 0 else day + datetime.timedelta(days=i * 23)) for i in range(60)]
    _same(spark, tmp_path, "orders", "range_merge", rows, _ORDERS)


def test_antecedents_need_a_scope(spark, tmp_path):
    _same(spark, tmp_path, "events", "antecedents", _events(null_user=4), _EVENTS)


def test_of_antecedents_at_one_place_the_greatest_id(spark):
    said = spark.createDataFrame([(1, 50, "m"), (1, 60, "m")], "user_id long, start long, gender string")
    for order in ((7, 3, 9), (9, 7, 3), (3, 9, 7)):
        m = spark.createDataFrame([(1, i, 40, f"N{i}", "RIGID_NAME", "m") for i in order], "user_id long, id long, offset long, text string, alias_type string, gender string").coalesce(1)
        assert sorted((r.start, r.mention_id, r.confidence) for r in anaphora.antecedents(said, m, ["user_id"]).collect()) == [(50, 9, 0.85), (60, 9, 0.85)]
