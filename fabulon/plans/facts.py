"""Queries over the fact store: intervals, visibility, state, log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulon.functions import intervals as iv
from fabulon.functions import names
from fabulon.functions.visibility import visible
from fabulon.operators import log, state
from fabulon.sources.adapters import EVENT_FACTS_SQL, REQUESTS_SQL, event_facts, requests, table

_CONTAINS = "CASE WHEN {p} < from_lb OR {p} >= to_ub THEN 'EXCLUDED' WHEN {p} >= from_ub AND {p} < to_lb THEN 'CERTAIN' ELSE 'PLAUSIBLE' END"
_RANK = "CASE {c} WHEN 'CERTAIN' THEN 2 WHEN 'PLAUSIBLE' THEN 1 ELSE 0 END"
_NAME = "CASE WHEN {r} >= 2 THEN 'CERTAIN' WHEN {r} = 1 THEN 'PLAUSIBLE' ELSE 'EXCLUDED' END"
_VISIBLE = "(observer = 'SYSTEM' OR (observer_id = observer AND learned <= known AND CASE WHEN retracted IS NOT NULL THEN known < retracted ELSE truth_status <> 'FALSE' END))"
SEEN_SQL = f"""seen AS (SELECT r.position, r.observer, r.known, f.*, {_CONTAINS.format(p='r.position')} AS certainty FROM requests r JOIN facts f USING (target_id)
  WHERE f.timeline_id = 'main' AND {_VISIBLE} AND NOT (r.position < from_lb OR r.position >= to_ub))"""
WITH_SEEN = f"WITH {EVENT_FACTS_SQL}, {REQUESTS_SQL}, {SEEN_SQL}"
WITH_FACTS = f"WITH {EVENT_FACTS_SQL}"
_ALIAS = "regexp_replace(lower(\"key\" || ' ' || (seq % 4)), '\\s+', ' ', 'g')"


def interval_contains(s: SparkSession, d: str) -> DataFrame:
    return event_facts(s, d).select("seq", iv.contains(iv.columns(), F.lit(300.0)).alias("certainty"), iv.is_open(iv.columns()).alias("is_open"), iv.is_start_known(iv.columns()).alias("start_known"), iv.is_end_known(iv.columns()).alias("end_known"))


def interval_overlaps(s: SparkSession, d: str) -> DataFrame:
    f = event_facts(s, d).select("seq", "target_id", *iv.FIELDS)
    g = f.select("target_id", F.col("seq").alias("other"), *[F.col(c).alias("o_" + c) for c in iv.FIELDS])
    return f.join(g, "target_id").filter("seq < other").groupBy(iv.overlaps(iv.columns(), iv.columns("o_")).alias("certainty")).agg(F.count("*").alias("n_pairs"))


def interval_conjunction(s: SparkSession, d: str) -> DataFrame:
    c = iv.contains(iv.columns(), F.lit(300.0))
    return event_facts(s, d).groupBy("target_id", "key").agg(iv.named(F.min(iv.rank(c))).alias("certainty"))


def interval_close(s: SparkSession, d: str) -> DataFrame:
    f = event_facts(s, d).withColumn("i", iv.with_end(iv.columns(), F.lit(400.0), F.lit(410.0)))
    return f.select("seq", "i.*").withColumn("valid", iv.valid(iv.columns()))


def evidence_extend(s: SparkSession, d: str) -> DataFrame:
    f = event_facts(s, d).withColumn("i", iv.with_evidence_through(iv.columns(), F.lit(500.0)))
    return f.select("seq", "i.*")


def interval_constructors(s: SparkSession, d: str) -> DataFrame:
    f = event_facts(s, d)
    made = {"known": iv.point_known(F.col("from_lb"), F.col("to_lb")), "open": iv.open_ended(F.col("from_lb"), F.col("from_ub"), F.col("to_lb")), "before": iv.since_before(F.col("from_lb")), "all": iv.unbounded()}
    return f.select("seq", *[v.alias(k) for k, v in made.items()]).select("seq", *[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in made for c in iv.FIELDS])


def state_of_attributes(s: SparkSession, d: str) -> DataFrame:
    return state.state_of_attributes(requests(s, d), event_facts(s, d))


def state_of_certainty(s: SparkSession, d: str) -> DataFrame:
    return state.state_certainty(requests(s, d), event_facts(s, d))


def state_of_certain_only(s: SparkSession, d: str) -> DataFrame:
    return state.state_of_attributes(requests(s, d), event_facts(s, d), include_plausible=False)


def state_of_voided(s: SparkSession, d: str) -> DataFrame:
    voided = state.voided_timelines(s.createDataFrame([("loop", "VOIDED"), ("loop", "CANONICAL"), ("dream", "CANONICAL")], "timeline_id string, canonicity string"))
    each = [state.state_of_attributes(requests(s, d), event_facts(s, d), timeline=t, voided=voided).withColumn("timeline_id", F.lit(t)) for t in ("dream", "loop")]
    return each[0].unionByName(each[1])


def _relations(s: SparkSession, d: str) -> DataFrame:
    return event_facts(s, d).withColumn("type", F.col("key")).withColumn("dst_self", F.concat(F.lit("s"), (F.col("seq") % 50).cast("string")))


def state_of(s: SparkSession, d: str) -> DataFrame:
    out = state.state_of(requests(s, d), _aliases(s, d), event_facts(s, d), _relations(s, d), _bodies(s, d), novel_id="n")
    pairs = F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.round(e["value"].cast("double"), 6).cast("decimal(20,6)").cast("string"), F.lit("null")))))
    return out.select(
        "target_id", "position", "observer", F.array_join("aliases", "|").alias("aliases"), F.array_join(pairs, "|").alias("attributes"),
        F.array_join(F.transform("relationships", lambda r: F.concat(r["type"], F.lit(">"), r["dst_self"])), "|").alias("relationships"),
        F.array_join("persona_ids", "|").alias("persona_ids"), "certainty", F.sha2(F.array_join("read_set", "\n"), 256).alias("read_set_hash"), F.size("read_set").cast("long").alias("n_read"),
    )


def state_of_retracted(s: SparkSession, d: str) -> DataFrame:
    seen = requests(s, d).join(event_facts(s, d).filter("retracted is not null"), "target_id")
    seen = seen.withColumn("seen", visible(F.col("observer_id"), F.col("learned"), F.col("truth_status"), F.col("retracted"), F.col("observer"), F.col("known")))
    return seen.groupBy("target_id", "position", "observer").agg(F.sum(F.col("seen").cast("long")).alias("n_seen"), F.count("*").alias("n_retracted"))


def state_of_observer_diff(s: SparkSession, d: str) -> DataFrame:
    full = state.state_of_attributes(requests(s, d), event_facts(s, d)).select("target_id", "position", "key", "observer", "value")
    all_, own = full.filter("observer = 'SYSTEM'").drop("observer"), full.filter("observer = 'READER'").select("target_id", "position", "key", F.col("value").alias("reader_value"))
    return all_.join(own, ["target_id", "position", "key"], "left").filter("reader_value is null or reader_value <> value").select("target_id", "position", "key", F.col("value").alias("system_value"), "reader_value")


def _aliases(s: SparkSession, d: str) -> DataFrame:
    f = event_facts(s, d).withColumn("alias", F.concat_ws(" ", "key", (F.col("seq") % 4).cast("string")))
    return f.withColumn("alias_norm", names.normalize_alias(F.col("alias")))


def state_of_aliases(s: SparkSession, d: str) -> DataFrame:
    return state.state_aliases(requests(s, d), _aliases(s, d))


def resolve_alias(s: SparkSession, d: str) -> DataFrame:
    asked = s.createDataFrame([("view 1", 300.0, "SYSTEM", 30_000_000), ("error 2", 300.0, "READER", 30_000_000), ("click 0", 480.5, "G1", 20_000_000)], "alias_norm string, position double, observer string, known long")
    return state.resolve_alias(asked, _aliases(s, d))


def _bodies(s: SparkSession, d: str) -> DataFrame:
    return event_facts(s, d).filter("key in ('signup', 'purchase')").withColumn("persona_id", F.concat(F.lit("body"), (F.col("seq") % 3 + 1).cast("string")))


def persona_at(s: SparkSession, d: str) -> DataFrame:
    return state.persona_at(requests(s, d).select("target_id", "position").distinct(), _bodies(s, d))


def concurrent_personas(s: SparkSession, d: str) -> DataFrame:
    return state.concurrent_personas(requests(s, d).select("target_id", "position").distinct(), _bodies(s, d))


def relations_at(s: SparkSession, d: str) -> DataFrame:
    return state.relations_of(requests(s, d), _relations(s, d))


def event_replay_upto(s: SparkSession, d: str) -> DataFrame:
    return log.replay(event_facts(s, d).select("seq", F.col("target_id").alias("id"), F.col("key").alias("type"), "value", "learned"), 15_000_000)


def event_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n_events"))


def next_seq_batch(s: SparkSession, d: str) -> DataFrame:
    base = table(s, d, "orders").select(F.col("o_orderkey").alias("seq"))
    return log.numbered(table(s, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("id")), base, "seq", "id")


def invalidate_by_facts(s: SparkSession, d: str) -> DataFrame:
    artifacts = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderkey").alias("id")).agg(F.array_distinct(F.collect_list(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")))).alias("read_set"))
    changed = table(s, d, "part").filter("p_size = 7").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("ref"))
    return log.invalidated(artifacts, changed).select("id")


def escalation_stats(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("tier", F.when(F.col("user_id") % 2 == 0, "LOCAL").otherwise("LARGE"))
    return e.groupBy(F.col("event_type").alias("stage"), "tier").agg(F.count("*").alias("n_calls"), F.sum((F.col("event_id") % 9 == 0).cast("long")).alias("n_escalated"), F.sum(F.length("props").cast("long")).alias("tokens"), F.round(F.avg("user_id"), 6).alias("avg_latency"))


def open_intervals(s: SparkSession, d: str) -> DataFrame:
    return event_facts(s, d).filter(iv.is_open(iv.columns())).groupBy("timeline_id").agg(F.count("*").alias("n_open"))


def redirect_roots(s: SparkSession, d: str) -> DataFrame:
    """Chains of up to four merges, and cycles of three that others lead into."""
    c = table(s, d, "customer").select("c_custkey")
    chains = c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("from_id"), (F.col("c_custkey") - 1).alias("to_id"))
    k = (F.col("c_custkey") * 4 + 10_000_000).alias("k")
    rings = c.select(k).select(F.explode(F.array(*[F.struct((F.col("k") + i).alias("from_id"), (F.col("k") + j).alias("to_id")) for i, j in ((0, 2), (2, 1), (1, 0), (3, 1))])).alias("e")).select("e.*")
    return log.redirect_roots(chains.unionByName(rings))


def voided_semijoin(s: SparkSession, d: str) -> DataFrame:
    facts = event_facts(s, d)
    late = facts.filter("retracted is not null").select("target_id").distinct()
    return facts.join(late, "target_id", "left_semi").groupBy("target_id").agg(F.count("*").alias("n_facts"))


def timelines(s: SparkSession, d: str) -> DataFrame:
    return event_facts(s, d).select("timeline_id").distinct()


def read_set_digest(s: SparkSession, d: str) -> DataFrame:
    return log.read_set_digest(table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("ref")))


def gold_merge(s: SparkSession, d: str) -> DataFrame:
    old = table(s, d, "events").filter("event_id % 2 = 0").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("base"), F.max((F.col("event_id") % 10 == 0).cast("int")).alias("confirmed"))
    new = table(s, d, "events").filter("event_id % 3 = 0").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("incoming"))
    return old.join(new, "id", "full_outer").select("id", F.when(F.coalesce("confirmed", F.lit(0)) == 1, F.col("base")).otherwise(F.coalesce("incoming", "base")).alias("identity"))


_S = "SELECT target_id, position, observer"
SQL = {
    "interval_contains": f"{WITH_FACTS} SELECT seq, {_CONTAINS.format(p='300.0')} AS certainty, to_ub = 'infinity'::DOUBLE AS is_open, from_lb = from_ub AS start_known, to_lb = to_ub AS end_known FROM facts",
    "interval_overlaps": f"""{WITH_FACTS} SELECT CASE WHEN a.to_ub <= b.from_lb OR b.to_ub <= a.from_lb THEN 'EXCLUDED' WHEN a.from_ub < b.to_lb AND b.from_ub < a.to_lb THEN 'CERTAIN' ELSE 'PLAUSIBLE' END AS certainty, count(*) AS n_pairs
        FROM facts a JOIN facts b ON a.target_id = b.target_id AND a.seq < b.seq GROUP BY 1""",
    "interval_conjunction": f"""{WITH_FACTS}, c AS (SELECT target_id, "key", {_CONTAINS.format(p='300.0')} AS c FROM facts), m AS (SELECT target_id, "key", min({_RANK.format(c='c')}) AS r FROM c GROUP BY 1, 2)
        SELECT target_id, "key", {_NAME.format(r='r')} AS certainty FROM m""",
    "interval_close": f"{WITH_FACTS} SELECT seq, from_lb, from_ub, 400.0::DOUBLE AS to_lb, 410.0::DOUBLE AS to_ub, from_lb <= from_ub AND 410.0 >= from_lb AS valid FROM facts",
    "evidence_extend": f"{WITH_FACTS} SELECT seq, from_lb, from_ub, greatest(to_lb, 500.0::DOUBLE) AS to_lb, greatest(to_ub, 500.0::DOUBLE) AS to_ub FROM facts",
    "interval_constructors": f"""{WITH_FACTS} SELECT seq, from_lb AS known_from_lb, from_lb AS known_from_ub, to_lb AS known_to_lb, to_lb AS known_to_ub,
        from_lb AS open_from_lb, from_ub AS open_from_ub, to_lb AS open_to_lb, 'infinity'::DOUBLE AS open_to_ub,
        '-infinity'::DOUBLE AS before_from_lb, from_lb AS before_from_ub, from_lb AS before_to_lb, 'infinity'::DOUBLE AS before_to_ub,
        '-infinity'::DOUBLE AS all_from_lb, '-infinity'::DOUBLE AS all_from_ub, 'infinity'::DOUBLE AS all_to_lb, 'infinity'::DOUBLE AS all_to_ub FROM facts""",
    "state_of_attributes": f"""{WITH_SEEN} {_S}, "key", arg_max(value, learned * 10000000000::HUGEINT + seq) AS value, arg_max(certainty, learned * 10000000000::HUGEINT + seq) AS certainty, count(*) AS n_facts FROM seen GROUP BY ALL""",
    "state_of_certainty": f"{WITH_SEEN}, m AS ({_S}, min({_RANK.format(c='certainty')}) AS r, count(*) AS n FROM seen GROUP BY ALL) {_S}, {_NAME.format(r='coalesce(r, 2)')} AS certainty, coalesce(n, 0) AS n_facts FROM requests LEFT JOIN m USING (target_id, position, observer)",
    "state_of_certain_only": f"""{WITH_SEEN} {_S}, "key", arg_max(value, learned * 10000000000::HUGEINT + seq) AS value, arg_max(certainty, learned * 10000000000::HUGEINT + seq) AS certainty, count(*) AS n_facts FROM seen WHERE certainty = 'CERTAIN' GROUP BY ALL""",
    "state_of_voided": f"""{WITH_SEEN.replace("f.timeline_id = 'main'", "f.timeline_id IN ('dream', 'loop') AND f.timeline_id NOT IN ('loop')")} {_S}, timeline_id, "key", arg_max(value, learned * 10000000000::HUGEINT + seq) AS value, arg_max(certainty, learned * 10000000000::HUGEINT + seq) AS certainty, count(*) AS n_facts FROM seen GROUP BY ALL""",
    "state_of": f"""{WITH_SEEN}, al AS ({_S}, {_ALIAS} AS norm, arg_min("key" || ' ' || (seq % 4), seq) AS alias, min(seq) AS q FROM seen GROUP BY ALL),
        att AS ({_S}, "key", arg_max(struct_pack(v := value), learned * 10000000000::HUGEINT + seq).v AS value FROM seen GROUP BY ALL),
        pe AS (SELECT r.position, r.observer, f.*, {_CONTAINS.format(p='r.position')} AS certainty FROM requests r JOIN facts f USING (target_id) WHERE f.timeline_id = 'main' AND f."key" IN ('signup', 'purchase') AND (observer = 'SYSTEM' OR (observer_id = observer AND learned <= known)) AND position >= from_lb AND position < to_ub),
        refs AS ({_S}, 'self:' || target_id AS ref FROM requests UNION {_S}, 'alias:n:' || norm FROM al UNION {_S}, 'self:s' || (seq % 50) FROM seen UNION {_S}, 'persona:body' || (seq % 3 + 1) FROM pe),
        ra AS ({_S}, string_agg(alias, '|' ORDER BY q) AS aliases FROM al GROUP BY ALL), rt AS ({_S}, string_agg("key" || '=' || coalesce(CAST(CAST(round(value, 6) AS DECIMAL(20, 6)) AS VARCHAR), 'null'), '|' ORDER BY "key" || '=') AS attributes FROM att GROUP BY ALL),
        rr AS ({_S}, string_agg("key" || '>s' || (seq % 50), '|' ORDER BY seq) AS relationships FROM seen GROUP BY ALL), rp AS ({_S}, string_agg('body' || (seq % 3 + 1), '|' ORDER BY seq) AS persona_ids FROM pe GROUP BY ALL),
        rc AS ({_S}, min({_RANK.format(c='certainty')}) AS rank FROM (SELECT target_id, position, observer, certainty FROM seen UNION ALL SELECT target_id, position, observer, certainty FROM pe) GROUP BY ALL),
        rs AS ({_S}, sha256(string_agg(ref, chr(10) ORDER BY ref)) AS read_set_hash, count(*) AS n_read FROM refs GROUP BY ALL)
        {_S}, coalesce(aliases, '') AS aliases, coalesce(attributes, '') AS attributes, coalesce(relationships, '') AS relationships, coalesce(persona_ids, '') AS persona_ids, {_NAME.format(r='coalesce(rank, 2)')} AS certainty, read_set_hash, n_read
        FROM requests LEFT JOIN ra USING (target_id, position, observer) LEFT JOIN rt USING (target_id, position, observer) LEFT JOIN rr USING (target_id, position, observer) LEFT JOIN rp USING (target_id, position, observer) LEFT JOIN rc USING (target_id, position, observer) LEFT JOIN rs USING (target_id, position, observer)""",
    "state_of_retracted": f"{WITH_FACTS}, {REQUESTS_SQL} {_S}, CAST(sum(CASE WHEN {_VISIBLE} THEN 1 ELSE 0 END) AS BIGINT) AS n_seen, count(*) AS n_retracted FROM requests JOIN facts USING (target_id) WHERE retracted IS NOT NULL GROUP BY ALL",
    "state_of_observer_diff": f"""{WITH_SEEN}, f AS ({_S}, "key", arg_max(value, learned * 10000000000::HUGEINT + seq) AS value FROM seen GROUP BY ALL)
        SELECT a.target_id, a.position, a."key", a.value AS system_value, b.value AS reader_value FROM f a LEFT JOIN f b ON a.target_id = b.target_id AND a.position = b.position AND a."key" = b."key" AND b.observer = 'READER'
        WHERE a.observer = 'SYSTEM' AND (b.value IS NULL OR b.value <> a.value)""",
    "state_of_aliases": f"""{WITH_SEEN} {_S}, {_ALIAS} AS alias_norm, arg_min("key" || ' ' || (seq % 4), seq) AS alias, min(seq) AS first_seq FROM seen GROUP BY ALL""",
    "resolve_alias": f"""{WITH_FACTS}, asked(alias_norm, position, observer, known) AS (VALUES ('view 1', 300.0::DOUBLE, 'SYSTEM', 30000000), ('error 2', 300.0, 'READER', 30000000), ('click 0', 480.5, 'G1', 20000000)),
        m AS (SELECT a.alias_norm, position, observer, f.target_id, max({_RANK.format(c=_CONTAINS.format(p='position'))}) AS r FROM asked a JOIN facts f ON a.alias_norm = {_ALIAS} WHERE timeline_id = 'main' AND {_VISIBLE} AND position >= from_lb AND position < to_ub GROUP BY ALL)
        SELECT alias_norm, position, observer, target_id, {_NAME.format(r='r')} AS certainty FROM m""",
    "persona_at": f"""{WITH_FACTS}, r AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS target_id, position FROM events, (VALUES (240.0::DOUBLE), (480.5)) p(position)),
        j AS (SELECT r.target_id, r.position, f.seq, from_lb, {_RANK.format(c=_CONTAINS.format(p='r.position'))} AS c FROM r LEFT JOIN facts f ON r.target_id = f.target_id AND f."key" IN ('signup', 'purchase')),
        n AS (SELECT *, row_number() OVER (PARTITION BY target_id, position ORDER BY seq IS NULL, c DESC, CASE WHEN c > 0 THEN from_lb ELSE -from_lb END DESC, seq DESC) AS rn FROM j)
        SELECT target_id, position, coalesce('body' || (seq % 3 + 1), 'body1') AS persona_id FROM n WHERE rn = 1""",
    "concurrent_personas": f"""{WITH_FACTS}, r AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS target_id, position FROM events, (VALUES (240.0::DOUBLE), (480.5)) p(position))
        SELECT r.target_id, r.position, string_agg(DISTINCT 'body' || (seq % 3 + 1), ',' ORDER BY 'body' || (seq % 3 + 1)) AS personas, count(DISTINCT seq % 3) AS n_personas FROM r JOIN facts f USING (target_id) WHERE f."key" IN ('signup', 'purchase') AND position >= from_lb AND position < to_ub GROUP BY ALL""",
    "relations_at": f"""{WITH_SEEN} {_S}, "key" AS "type", 's' || (seq % 50) AS dst_self, certainty, seq FROM seen""",
    "event_replay_upto": f"""{WITH_FACTS} SELECT target_id AS id, "key" AS "type", arg_max(value, seq) AS value, max(seq) AS seq, count(*) AS n_events FROM facts WHERE learned <= 15000000 GROUP BY ALL""",
    "event_counts": 'SELECT event_type AS "type", count(*) AS n_events FROM events GROUP BY 1',
    "next_seq_batch": "SELECT c_custkey AS id, (SELECT coalesce(max(o_orderkey), 0) FROM orders) + row_number() OVER (ORDER BY c_custkey) AS seq FROM customer WHERE c_nationkey = 3",
    "invalidate_by_facts": "SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_size = 7",
    "escalation_stats": "SELECT event_type AS stage, CASE WHEN user_id % 2 = 0 THEN 'LOCAL' ELSE 'LARGE' END AS tier, count(*) AS n_calls, CAST(sum(CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_escalated, CAST(sum(length(props)) AS BIGINT) AS tokens, round(avg(user_id), 6) AS avg_latency FROM events GROUP BY ALL",
    "open_intervals": f"{WITH_FACTS} SELECT timeline_id, count(*) AS n_open FROM facts WHERE to_ub = 'infinity'::DOUBLE GROUP BY 1",
    "redirect_roots": """WITH RECURSIVE m AS (SELECT c_custkey AS f, c_custkey - 1 AS t FROM customer WHERE c_custkey % 5 <> 0), w AS (SELECT f, t FROM m UNION ALL SELECT w.f, m.t FROM w JOIN m ON w.t = m.f)
        SELECT f AS from_id, min(t) AS root FROM w GROUP BY 1 UNION ALL SELECT c_custkey * 4 + 10000000 + i, c_custkey * 4 + 10000000 FROM customer, range(0, 4) r(i)""",
    "voided_semijoin": f"{WITH_FACTS} SELECT target_id, count(*) AS n_facts FROM facts WHERE target_id IN (SELECT target_id FROM facts WHERE retracted IS NOT NULL) GROUP BY 1",
    "timelines": f"{WITH_FACTS} SELECT DISTINCT timeline_id FROM facts",
    "read_set_digest": "SELECT l_orderkey AS id, sha256(string_agg(DISTINCT 'part:' || l_partkey, chr(10) ORDER BY 'part:' || l_partkey)) AS read_set_hash, count(DISTINCT l_partkey) AS n_refs FROM lineitem GROUP BY 1",
    "gold_merge": """WITH o AS (SELECT user_id AS id, max(event_id) AS base, max(CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS confirmed FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id AS id, max(event_id) AS incoming FROM events WHERE event_id % 3 = 0 GROUP BY 1)
        SELECT id, CASE WHEN coalesce(confirmed, 0) = 1 THEN base ELSE coalesce(incoming, base) END AS identity FROM o FULL JOIN n USING (id)""",
}
QUERIES = {k: globals()[k] for k in SQL}
