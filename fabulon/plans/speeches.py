"""Queries over spans, speakers, segments and small production tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabulon.functions import text
from fabulon.operators import speech
from fabulon.operators.incremental import resolve_windows
from fabulon.sources.adapters import table

_LINE = "case when turn % 3 = 0 then '\"' || text || '\" said R' || role || '.' when turn % 3 = 1 then 'R' || role || ' asked, \"' || text || '\" It was late.' else 'He thought \"' || text || '\" and left.' end"


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select("conv_id", "turn", "role", F.expr(_LINE).alias("text"))


def quote_spans(s: SparkSession, d: str) -> DataFrame:
    return speech.spans(_lines(s, d), ["conv_id", "turn"]).select("conv_id", "turn", "n", "text", "quoted", F.col("start").cast("long"), F.col("end").cast("long"))


def _around(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id", "turn").orderBy("n")
    return speech.spans(_lines(s, d), ["conv_id", "turn"]).withColumn("before", F.coalesce(F.lag("text").over(w), F.lit(""))).withColumn("after", F.coalesce(F.lead("text").over(w), F.lit("")))


def span_types(s: SparkSession, d: str) -> DataFrame:
    return _around(s, d).groupBy(speech.span_type(F.col("text"), F.col("quoted"), F.col("before"), F.col("after")).alias("span_type")).agg(F.count("*").alias("n_spans"))


def speaker_ladder(s: SparkSession, d: str) -> DataFrame:
    q = _around(s, d).filter("quoted").withColumn("explicit", speech.explicit_speaker(F.col("before"), F.col("after")))
    pov = F.when(F.col("before").rlike(rf"(?i)\b({speech.THOUGHT})\b"), F.lit("POV"))
    who, method, sure = speech.ladder([("EXPLICIT", F.col("explicit"), 0.95), ("POV", pov, 0.75)])
    return q.select("conv_id", "turn", who.alias("speaker"), method.alias("method"), sure.alias("confidence"))


def segment_pairing(s: SparkSession, d: str) -> DataFrame:
    return speech.paired_segments(table(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type", "signup", "purchase")


def scene_sessions(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long").alias("at"))
    return speech.sessions(e, "user_id", "at", 40_000)


def suspected_splits(s: SparkSession, d: str) -> DataFrame:
    return speech.suspected_splits(table(s, d, "part"), "p_name")


def parentheticals(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\(([^()\n]{2,40})\)"), F.lit(1))).alias("inner"))
    return p.groupBy("lang", F.when(p["inner"].rlike("^[0-9 +-]+$"), "NUMBER").otherwise("GLOSS").alias("kind")).agg(F.count("*").alias("n"))


def pronouns(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "documents").filter("lang = 'en'").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b(he|him|his|she|her|they|them|it)\b"), F.lit(1))).alias("pronoun"))
    return c.groupBy("source", "pronoun").agg(F.count("*").alias("n"))


def deferred_queue(s: SparkSession, d: str) -> DataFrame:
    tries = table(s, d, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.count("*").alias("attempts"))
    return tries.groupBy(F.when(F.col("attempts") < 3, "READY").otherwise("EXHAUSTED").alias("state")).agg(F.count("*").alias("n_cases"))


def voice_bucket(s: SparkSession, d: str) -> DataFrame:
    wanted = table(s, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "f").otherwise("m").alias("gender"), F.expr("array('child', 'young', 'adult', 'old')[cast(c_nationkey % 4 as int)]").alias("age"))
    bank = s.createDataFrame([("v1", "f", "young"), ("v2", "m", "adult"), ("v3", "m", "old"), ("v4", "f", "old")], "voice string, gender string, age string")
    return speech.nearest_voice(wanted, bank)


def panel_relevance(s: SparkSession, d: str) -> DataFrame:
    w = table(s, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"), F.max_by("text", "turn").alias("source"))
    a, b = F.array_distinct(text.terms(F.col("prompt"))), F.array_distinct(text.terms(F.col("source")))
    return w.select("conv_id", F.size(a).cast("long").alias("n_words"), F.size(F.array_intersect(a, b)).cast("long").alias("n_shared")).withColumn("score", F.when(F.col("n_words") > 0, F.round(F.col("n_shared") / F.col("n_words"), 9)).otherwise(0.0))


def chunk_text(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "documents").select("doc_id", speech.packed_text(F.split(F.coalesce("text", F.lit("")), "\n"), 2000).alias("chunks"))
    return c.select("doc_id", F.size("chunks").cast("long").alias("n_chunks"), F.aggregate("chunks", F.lit(0), lambda a, x: F.greatest(a, F.length(x))).alias("longest"))


def stride_sample(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber").distinct()
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey"))).filter("(rn - 1) % 50 = 0 and rn <= 250").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


def handoff_windows(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"), "user_id").distinct()
    before, after = e.filter("day between 10 and 11").select("user_id").distinct(), e.filter("day between 12 and 13").select("user_id").distinct()
    gone, new = before.join(after, "user_id", "left_anti"), after.join(before, "user_id", "left_anti")
    return gone.select("user_id", F.lit("VANISHED").alias("kind")).unionByName(new.select("user_id", F.lit("APPEARED").alias("kind")))


def gold_coverage(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg(F.col("toxic").cast("double")), 9).alias("share"))


def resolve_incremental(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").filter("text is not null")
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    terms = text.terms(F.col("text"))
    w = docs.select(F.col("doc_id").alias("group_id"), F.floor(F.col("doc_id") * 4 / (last + 1)).cast("long").alias("window"), F.get(terms, F.lit(0)).alias("key"), "text")
    return resolve_windows(w, 12.0, 4.0, terms)


def first_appearance(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min(F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey")).alias("first"))
    return l.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("first", "l_suppkey")).cast("long")).filter("place <= 3").select("l_orderkey", "l_suppkey", "place")


_SPANS = f"""WITH l AS (SELECT conv_id, turn, {_LINE} AS t FROM conversations), p AS (SELECT conv_id, turn, regexp_extract_all(t, '("[^"]*"|“[^”]*”|[^"“]+|["“])', 1) AS ps FROM l),
  s AS (SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS n, ps[i] AS text, length(ps[i]) > 1 AND regexp_matches(ps[i], '(?s)^["“].*["”]$') AS quoted FROM p, unnest(range(1, len(ps) + 1)) t(i)),
  a AS (SELECT *, coalesce(lag(text) OVER w, '') AS before, coalesce(lead(text) OVER w, '') AS after, sum(length(text)) OVER w AS e FROM s WINDOW w AS (PARTITION BY conv_id, turn ORDER BY n))"""
_AT = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT)"
_TERMS = "list_distinct(list_filter(string_split_regex(lower({t}), '[^a-z0-9\u0080-￿]+'), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(repr(x) for x in text.STOP) + ")))"
SQL = {
    "quote_spans": f'{_SPANS} SELECT conv_id, turn, n, text, quoted, CAST(e - length(text) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM a',
    "span_types": f"""{_SPANS} SELECT CASE WHEN quoted AND regexp_matches(right(before, 80) || ' ' || left(after, 80), '(?i)\\b({speech.THOUGHT})\\b') THEN 'INNER_MONOLOGUE' WHEN quoted THEN 'DIALOGUE' WHEN regexp_matches(text, '(?i)\\b(is|are|was|were|had)\\b') THEN 'DESCRIPTION' ELSE 'ACTION' END AS span_type, count(*) AS n_spans FROM a GROUP BY 1""",
    "speaker_ladder": f"""{_SPANS}, q AS (SELECT conv_id, turn, coalesce(nullif(regexp_extract(after, '^[\\s,.]*(?:{speech.SAID})\\s+([A-Z][\\w#-]*)', 1), ''), nullif(regexp_extract(after, '^[\\s,.]*([A-Z][\\w#-]*)\\s+(?:{speech.SAID})\\b', 1), ''), nullif(regexp_extract(before, '([A-Z][\\w#-]*)\\s+(?:{speech.SAID})[\\s,:]*$', 1), '')) AS x,
        CASE WHEN regexp_matches(before, '(?i)\\b({speech.THOUGHT})\\b') THEN 'POV' END AS p FROM a WHERE quoted)
        SELECT conv_id, turn, coalesce(x, p) AS speaker, CASE WHEN x IS NOT NULL THEN 'EXPLICIT' WHEN p IS NOT NULL THEN 'POV' ELSE 'UNRESOLVED' END AS "method", CASE WHEN x IS NOT NULL THEN 0.95 WHEN p IS NOT NULL THEN 0.75 ELSE 0.0 END::DOUBLE AS confidence FROM q""",
    "segment_pairing": """WITH m AS (SELECT user_id, event_id, event_type, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS x, max(event_id) OVER (PARTITION BY user_id) AS l FROM events)
        SELECT user_id, coalesce(x, l) AS "end", x IS NULL AS open, min(event_id) AS start FROM m WHERE event_type = 'signup' GROUP BY ALL""",
    "scene_sessions": f"""WITH e AS (SELECT user_id, {_AT} AS at_ FROM events), n AS (SELECT *, CASE WHEN at_ - lag(at_) OVER (PARTITION BY user_id ORDER BY at_) > 40000 THEN 1 ELSE 0 END AS s FROM e), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY at_ RANGE UNBOUNDED PRECEDING) AS g FROM n)
        SELECT user_id, min(at_) AS start, max(at_) AS "end", count(*) AS n_rows FROM g GROUP BY user_id, g""",
    "suspected_splits": "WITH s AS (SELECT DISTINCT p_name AS s, lower(regexp_extract(p_name, '(\\S+)$', 1)) AS head FROM part) SELECT x.s AS a, y.s AS b, x.head FROM s x JOIN s y ON x.head = y.head AND x.s < y.s AND abs(length(x.s) - length(y.s)) <= 12",
    "parentheticals": "WITH p AS (SELECT lang, unnest(regexp_extract_all(text, '\\(([^()\\n]{2,40})\\)', 1)) AS x FROM documents) SELECT lang, CASE WHEN regexp_matches(x, '^[0-9 +-]+$') THEN 'NUMBER' ELSE 'GLOSS' END AS kind, count(*) AS n FROM p GROUP BY ALL",
    "pronouns": "WITH p AS (SELECT source, unnest(regexp_extract_all(lower(text), '\\b(he|him|his|she|her|they|them|it)\\b', 1)) AS pronoun FROM documents WHERE lang = 'en') SELECT source, pronoun, count(*) AS n FROM p GROUP BY ALL",
    "deferred_queue": "WITH t AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) SELECT CASE WHEN k < 3 THEN 'READY' ELSE 'EXHAUSTED' END AS state, count(*) AS n_cases FROM t GROUP BY 1",
    "voice_bucket": """WITH w AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'm' END AS gender, c_nationkey % 4 AS a FROM customer), b(voice, g, a) AS (VALUES ('v1', 'f', 1), ('v2', 'm', 2), ('v3', 'm', 3), ('v4', 'f', 3)),
        c AS (SELECT gender, w.a, voice, abs(w.a - b.a) + CASE WHEN gender = g THEN 0 ELSE 10 END AS cost FROM w, b) SELECT gender, ['child', 'young', 'adult', 'old'][a + 1] AS age, (list(voice ORDER BY cost, voice))[1] AS voice, CAST(min(cost) AS BIGINT) AS cost FROM c GROUP BY gender, a""",
    "panel_relevance": f"""WITH c AS (SELECT conv_id, {_TERMS.format(t='arg_min(text, turn)')} AS a, {_TERMS.format(t='arg_max(text, turn)')} AS b FROM conversations GROUP BY 1) SELECT conv_id, len(a) AS n_words, len(list_intersect(a, b)) AS n_shared, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(a), 9) ELSE 0 END AS score FROM c""",
    "stride_sample": "WITH e AS (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM e) SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM r WHERE (rn - 1) % 50 = 0 AND rn <= 250",
    "handoff_windows": """WITH e AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d, user_id FROM events), b AS (SELECT DISTINCT user_id FROM e WHERE d BETWEEN 10 AND 11), a AS (SELECT DISTINCT user_id FROM e WHERE d BETWEEN 12 AND 13)
        SELECT user_id, 'VANISHED' AS kind FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT user_id, 'APPEARED' AS kind FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "gold_coverage": "SELECT quality, count(*) AS n, round(avg(CAST(toxic AS DOUBLE)), 9) AS share FROM labels GROUP BY 1",
    "first_appearance": "WITH l AS (SELECT l_orderkey, l_suppkey, min(CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) AS f FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY f, l_suppkey) AS place FROM l) SELECT l_orderkey, l_suppkey, place FROM r WHERE place <= 3",
}
QUERIES = {k: globals()[k] for k in (*SQL, "chunk_text", "resolve_incremental")}
