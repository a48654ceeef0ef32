"""Queries over text, sequences, retrieval, resolution, evaluation and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabulon.functions import names, rules, text
from fabulon.operators import evaluate, mentions, resolve, sequence
from fabulon.sources.adapters import BLOCKS_SQL, blocks, table

WITH_BLOCKS = f"WITH {BLOCKS_SQL}"
#: Blocks with something in most of them for the text rules to find.
_TELL = """CASE (chapter + block_index) % 9 WHEN 0 THEN 'Two years later he awoke. ' || text WHEN 1 THEN 'Back then, many years ago, a vision appeared. ' || text WHEN 2 THEN 'She said coldly and in a low voice: ' || text
  WHEN 3 THEN '* * *' WHEN 4 THEN '[Level: ' || chapter || ']' WHEN 5 THEN 'Translator note: ' || text WHEN 6 THEN 'Next chapter' WHEN 7 THEN 'A group of disciples and the clan elders. Enemies surrounded him, he shouted. ' || text ELSE text END"""
WITH_TOLD = f"{WITH_BLOCKS}, told AS (SELECT chapter, lang, source, block_index, {_TELL} AS text FROM blocks)"
_STRIP = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_BRACKETED = "(" + " OR ".join(f"(starts_with(t, '{a}') AND ends_with(t, '{b}'))" for a, b in rules.SYSTEM_DELIMITERS) + ")"
_BODY = f"CASE WHEN {_BRACKETED} THEN t[2:-2] ELSE t END"
_WORDS = "list_filter(string_split_regex(lower({t}), '[^a-z0-9\u0080-￿]+'), lambda w: w <> '')"
_TERMS = f"list_filter({_WORDS}, lambda w: length(w) > 2 AND w NOT IN ({', '.join(repr(x) for x in text.STOP)}))"


def _re(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


#: A text as RE2's ASCII word boundaries need it: Java's count accented letters as letters.
_PLAIN = "regexp_replace({t}, '[À-ɏ]', 'z', 'g')"
#: Fields of a block of one line: 1 if it has a key and a value, else 0.
_FIELD = f"(CASE WHEN trim(regexp_extract({_BODY}, {_re(rules.KEY_VALUE)}, 1)) <> '' AND trim(regexp_extract({_BODY}, {_re(rules.KEY_VALUE)}, 2)) <> '' THEN 1 ELSE 0 END)"


# -- text ---------------------------------------------------------------------------------------


def _told(s: SparkSession, d: str) -> DataFrame:
    return blocks(s, d).withColumn("text", F.expr(_TELL))


def block_classify(s: SparkSession, d: str) -> DataFrame:
    return _told(s, d).groupBy("lang", text.block_type(F.col("text")).alias("block_type")).agg(F.count("*").alias("n_blocks"))


def system_window(s: SparkSession, d: str) -> DataFrame:
    return _told(s, d).withColumn("n_fields", F.size(text.fields(F.col("text")))).filter("n_fields > 0").groupBy("chapter").agg(F.sum("n_fields").cast("long").alias("n_fields"), F.count("*").alias("n_blocks"))


def narrative_markers(s: SparkSession, d: str) -> DataFrame:
    return _told(s, d).select("lang", F.explode(text.narrative_markers(F.col("text"))).alias("m")).groupBy("lang", "m.kind", "m.confidence").agg(F.count("*").alias("n_markers"))


def delivery_markers(s: SparkSession, d: str) -> DataFrame:
    return _told(s, d).select("chapter", F.explode(text.delivery_markers(F.col("text"))).alias("m")).groupBy(F.col("chapter").alias("doc_id"), "m.polarity").agg(F.count("*").alias("n"))


def mob_phrases(s: SparkSession, d: str) -> DataFrame:
    return _told(s, d).groupBy("source").agg(F.sum(F.size(text.mobs(F.col("text")))).cast("long").alias("n_mobs"), F.count("*").alias("n_blocks"))


def content_words(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select("item_id", F.size(F.array_distinct(F.transform(text.terms(F.col("text")), text.singular))).cast("long").alias("n_words"))


def snippet(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").filter("lang = 'en'").select("doc_id", text.snippet(F.col("text"), F.lit("and the")).alias("snippet"))


def caption_times(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = table(s, d, "conversations").withColumn("len", F.length("text") / 16).withColumn("end", F.sum("len").over(w))
    return c.select("conv_id", "turn", text.ass_time(F.col("end") - F.col("len")).alias("starts"), text.ass_time(F.col("end")).alias("ends"))


def comparison_key(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "The Lord ").when(F.col("c_custkey") % 3 == 1, "Élder ").otherwise(""), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, "’s").otherwise(" Jr.")).alias("name"))
    return c.select("c_custkey", names.comparison_key(F.col("name")).alias("key"))


def name_containment(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", "p_name", "p_type")
    return p.select("p_partkey", F.round(names.name_containment(F.concat_ws(" ", "p_type", "p_name"), F.col("p_name")), 9).alias("containment"))


def jaro_winkler(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    return p.select("p_partkey", F.round(names.jaro_winkler("a", "b"), 6).alias("similarity"))


def close_keys(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).distinct()
    pairs = b.alias("x").join(b.alias("y"), "size").select(F.col("x.brand").alias("a"), F.col("y.brand").alias("b")).filter("a < b").distinct()
    return pairs.filter(names.close_keys(F.col("a"), F.col("b")))


# -- mentions -----------------------------------------------------------------------------------


def gazetteer_match(s: SparkSession, d: str) -> DataFrame:
    w = text.words(F.col("text"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " "))
    phrases = table(s, d, "benchmark").filter(F.size(w) >= 3).select(F.explode(grams).alias("phrase"))
    return mentions.dictionary_match(table(s, d, "documents").filter("text is not null"), "doc_id", text.words(F.col("text")), phrases, 3).select("id", "phrase", "n_hits")


def commonness(s: SparkSession, d: str) -> DataFrame:
    r = mentions.word_rates(table(s, d, "documents").filter("lang = 'en'"), text.words(F.col("text")))
    return r.withColumn("common", F.col("determined") / F.col("total") >= 0.08)


def seed_harvest(s: SparkSession, d: str) -> DataFrame:
    w = table(s, d, "documents").filter("lang = 'en'").select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{2,})"), F.lit(1))).alias("name"))
    return w.groupBy(F.lower("name").alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.countDistinct("source").alias("n_sources")).filter("n >= 2")


def variant_families(s: SparkSession, d: str) -> DataFrame:
    return mentions.variant_families(table(s, d, "part"), "p_name", names.normalize_romanization(F.col("p_name"))).filter("n_surfaces >= 1")


def hit_rate_by_window(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "documents").filter("text is not null").select(F.floor(F.col("doc_id") / 40).cast("long").alias("window"), text.words(F.col("text")).alias("w"))
    return b.groupBy("window").agg(F.sum(F.size("w")).cast("long").alias("n_words"), F.sum(F.size(F.filter("w", lambda x: x.isin("the", "and", "of")))).cast("long").alias("n_hits"))


def mention_in_span(s: SparkSession, d: str) -> DataFrame:
    spans = table(s, d, "orders").select(F.col("o_custkey").alias("block"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("start"), F.col("o_orderkey").alias("span")).withColumn("end", F.col("start") + 200)
    points = s.createDataFrame([(500,), (1000,), (1700,)], "offset int")
    p = table(s, d, "customer").select(F.col("c_custkey").alias("block")).join(F.broadcast(points))
    return mentions.first_containing(p, spans, ["block"], "offset", "start", "end", "span")


def mention_segment(s: SparkSession, d: str) -> DataFrame:
    return mention_in_span(s, d).select("block", "offset", F.coalesce(F.col("span").cast("string"), F.lit("MAIN_TIMELINE")).alias("segment"))


def _clicks(s: SparkSession, d: str, kind: str, name: str) -> DataFrame:
    e = table(s, d, "events").filter(F.col("event_type") == kind)
    return e.select("user_id", F.col("event_id").alias(name), (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long").alias(f"{name}_at"))


def gold_nearest(s: SparkSession, d: str) -> DataFrame:
    return mentions.nearest(_clicks(s, d, "purchase", "gold"), _clicks(s, d, "view", "system"), ["user_id"], "gold_at", "system_at", 36000, "gold", "system")


def antecedent_asof(s: SparkSession, d: str) -> DataFrame:
    return mentions.nearest(_clicks(s, d, "error", "pronoun"), _clicks(s, d, "click", "name"), ["user_id"], "pronoun_at", "name_at", 72000, "pronoun", "name", backward=True)


def cooccurrence_block(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "lineitem")
    return mentions.co_occurrence(l.select(F.col("l_orderkey").alias("block"), F.col("l_suppkey").alias("target")), ["block"], "target")


def cooccurrence_chapter(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("chapter"), F.col("c_nationkey").alias("target"))
    return mentions.co_occurrence(m, ["chapter"], "target", 1).select("a", "b", "weight", "first")


def descriptive_semijoin(s: SparkSession, d: str) -> DataFrame:
    b = blocks(s, d).filter(F.col("text").rlike("(?i)(licensed|released under)"))
    return b.join(table(s, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("chapter")), "chapter", "left_semi").groupBy("chapter").agg(F.count("*").alias("n_blocks"))


def lexicon_lookup(s: SparkSession, d: str) -> DataFrame:
    classes = s.createDataFrame([("error", "ERA_LOCKED", 2), ("error", "GENERIC", 5), ("view", "TRANSFERABLE", 1), ("click", "GENERIC", 5)], "term string, class string, priority int")
    terms = table(s, d, "events").groupBy(F.col("event_type").alias("term")).agg(F.count("*").alias("n"))
    return terms.join(F.broadcast(classes), "term", "left").groupBy("term", "n").agg(F.min_by("class", "priority").alias("class"))


# -- sequences ----------------------------------------------------------------------------------


def turn_taking(s: SparkSession, d: str) -> DataFrame:
    return sequence.turn_taking(table(s, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


def anon_slots(s: SparkSession, d: str) -> DataFrame:
    return sequence.slots(table(s, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") != "system").select("conv_id", "turn", "slot")


def crowd_runs(s: SparkSession, d: str) -> DataFrame:
    b = blocks(s, d).filter((F.length("text") <= 200) & (F.length("text") > 0)).select("chapter", "block_index")
    runs = sequence.islands(b, ["chapter"], ["block_index"], F.col("block_index") - F.lag("block_index").over(Window.partitionBy("chapter").orderBy("block_index")) > 2)
    return runs.groupBy("chapter", "island").agg(F.count("*").alias("n_lines"), F.min("block_index").alias("first")).filter("n_lines >= 3").select("chapter", "first", "n_lines")


def epochs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", F.col("event_id").alias("pos"), F.concat(F.lit("body"), F.expr("event_id div 700 % 3").cast("string")).alias("body"))
    return sequence.epochs(e, "user_id", "pos", "body")


def timeline_carry(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", "event_id", "event_type")
    return sequence.carried(e, "user_id", "event_id", F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_id")), "segment").select("event_id", "segment")


def beats_boundary(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", "event_id", "event_type")
    r = sequence.islands(e, ["user_id"], ["event_id"], F.col("event_type") != F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")), "beat")
    return r.groupBy("user_id", "beat", "event_type").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first"))


def range_merge(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_custkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("a")).withColumn("b", F.col("a") + 60)
    return sequence.merged_ranges(o, "o_custkey", "a", "b")


def fixed_windows(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("w", F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) / 40).cast("long"))
    return e.groupBy("user_id", F.col("w").alias("window")).agg(F.count("*").alias("n_events"), F.min("event_id").alias("first"))


def adjacent_copresence(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("surface"), (F.col("l_orderkey") % 50).alias("chapter"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offset"))
    return resolve.co_presence(l, "l_partkey", "surface", "chapter", "offset", 100_000)


# -- resolution ---------------------------------------------------------------------------------


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    posted = resolve.postings(table(s, d, "documents").filter("text is not null"), "doc_id", text.terms(F.col("text")))
    queries = table(s, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(text.terms(F.col("text"))).alias("term"))
    return resolve.top_k(resolve.bm25(posted, queries), "query", "score", "id", 10)


def cosine_topk(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "label", F.col("v").alias("q"))
    scored = e.join(q, "label").filter("vec_id <> query").select("query", "vec_id", F.round(resolve.cosine(F.col("q"), F.col("v")), 6).alias("score"))
    return resolve.top_k(scored, "query", "score", "vec_id", 10)


_EVIDENCE = {"surface": "l_quantity / 50", "context": "l_discount * 10", "partner": "l_tax * 12", "temporal": "1.0 * (l_linenumber % 3) / 2", "prior": "1.0 * (l_suppkey % 10) / 10"}


def _candidates(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.expr(f"cast({e} as double)").alias(k) for k, e in _EVIDENCE.items()])
    verdict, confidence = resolve.prefilter((F.col("l_partkey") % 17 == 0).cast("double"), F.col("temporal"), (F.col("l_partkey") % 23 == 0).cast("double"), (F.col("l_suppkey") % 29 == 0).cast("double"), F.col("surface"))
    p = resolve.probability(resolve.raw_score({k: F.col(k) for k in _EVIDENCE}))
    return l.withColumn("verdict", verdict).withColumn("confidence", confidence).withColumn("probability", F.round(p, 9)).withColumn("candidate", F.col("l_suppkey")).withColumn("position", F.expr("l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey"))


def prefilter(s: SparkSession, d: str) -> DataFrame:
    return _candidates(s, d).groupBy("verdict", "confidence").agg(F.count("*").alias("n"))


def score(s: SparkSession, d: str) -> DataFrame:
    return _candidates(s, d).select("l_orderkey", "l_linenumber", F.round("probability", 6).alias("probability"))


def ablation(s: SparkSession, d: str) -> DataFrame:
    c = _candidates(s, d)
    f = {k: F.col(k) for k in _EVIDENCE}
    return c.agg(*[F.round(F.avg(resolve.raw_score(f, (k,))), 6).alias(f"without_{k}") for k in _EVIDENCE])


def gate(s: SparkSession, d: str) -> DataFrame:
    return resolve.gate(_candidates(s, d), "l_orderkey", 0.75, 0.30)


def sweep_names(s: SparkSession, d: str) -> DataFrame:
    return resolve.conflicting_names(table(s, d, "lineitem"), "l_partkey", "l_suppkey", 20)


def sweep_attributes(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").selectExpr("p_brand as target", "'size' as key", "cast(p_size as string) as value")
    return resolve.attribute_conflict(p, "target", "key", "value", ("size",))


# -- evaluation and reports -----------------------------------------------------------------------


def bcubed(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select(F.col("label").alias("gold"), F.when(F.col("vec_id") % 9 != 0, F.col("vec_id") % 13).alias("system"))
    return evaluate.bcubed(e, "gold", "system")


def recall_at_k(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("event_type").alias("kind"), (F.col("event_id") % 30).alias("rank"))
    return evaluate.recall_at(e, "kind", "rank")


def _graded(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "labels").select(((F.col("doc_id") * 37 % 101) / 101 * 0.6 + F.col("quality") * 0.3).alias("score"), (F.col("quality") == 1).alias("correct"))


def conformal_thresholds(s: SparkSession, d: str) -> DataFrame:
    return evaluate.conformal(_graded(s, d), "score", "correct")


def platt_fit(s: SparkSession, d: str) -> DataFrame:
    return evaluate.platt(_graded(s, d), "score", "correct")


def prominence(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return c.select("user_id", F.when(F.col("n") >= 300, "PRINCIPAL").when(F.col("n") >= 30, "RECURRING").otherwise("MINOR").alias("tier"))


def traits_gender(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "documents").filter("lang = 'en'").select("source", F.regexp_count("text", F.lit(r"(?i)\b(he|his|him)\b")).alias("m"), F.regexp_count("text", F.lit(r"(?i)\b(she|her)\b")).alias("f"))
    g = c.groupBy("source").agg(F.sum("m").cast("long").alias("m"), F.sum("f").cast("long").alias("f"))
    return g.select("source", "m", "f", F.when((F.col("m") + F.col("f") >= 6) & (F.col("m") / (F.col("m") + F.col("f")) >= 0.7), "m").when((F.col("m") + F.col("f") >= 6) & (F.col("f") / (F.col("m") + F.col("f")) >= 0.7), "f").alias("gender"))


def review_report(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"), F.countDistinct("l_returnflag").alias("n_types"), F.mode("l_linestatus", True).alias("common"))
    return l.orderBy(F.col("n").desc(), "l_suppkey").limit(50)


def casting_graph(s: SparkSession, d: str) -> DataFrame:
    return cooccurrence_chapter(s, d).select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).groupBy(F.col("e.x").alias("target")).agg(F.countDistinct("e.y").alias("degree"))


def payload_statistics(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("n_targets"), F.sum("n").alias("n_mentions"), F.sum((F.col("n") <= 60).cast("long")).alias("n_small"))


def grouping_sets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def set_difference(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    early, late = (e.filter(f"event_id % 2 = {k} and event_type = 'signup'").select("user_id") for k in (0, 1))
    return early.exceptAll(late).groupBy("user_id").agg(F.count("*").alias("n")).unionByName(early.intersect(late).select("user_id", F.lit(-1).cast("long").alias("n")))


def page_extract(s: SparkSession, d: str) -> DataFrame:
    h = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return table(s, d, "pages").select("page_id", F.regexp_count("html", F.lit("(?i)<a ")).cast("long").alias("n_links"), F.regexp_count("html", F.lit("(?i)<p[ >]")).cast("long").alias("n_paragraphs"), F.length(F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", " "), r"[ \t\r\n]+", " "))).cast("long").alias("text_chars"))


def json_props(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.count("k").alias("n"))


_DAY = "date_diff('day', DATE '1992-01-01', CAST({c} AS DATE))"
_AT = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT)"
_POINT = f"""WITH sp AS (SELECT o_custkey AS block, {_DAY.format(c='o_orderdate')} AS a, o_orderkey AS span FROM orders), p AS (SELECT c_custkey AS block, "offset" FROM customer, (VALUES (500), (1000), (1700)) v("offset")),
  r AS (SELECT p.block, p."offset", arg_min(span, a * 10000000000::HUGEINT + span) AS span FROM p LEFT JOIN sp ON p.block = sp.block AND a <= p."offset" AND p."offset" < a + 200 GROUP BY ALL)"""
_NEAREST = """WITH e AS (SELECT user_id, event_id, event_type, {at} AS at FROM events), j AS (SELECT l.event_id AS x, r.event_id AS y, abs(l.at - r.at) AS gap FROM e l JOIN e r ON l.user_id = r.user_id AND l.event_type = '{a}' AND r.event_type = '{b}' WHERE {near})
  SELECT x AS {x}, arg_min(y, gap * 10000000000::HUGEINT + y) AS {y}, min(gap) AS gap FROM j GROUP BY 1"""
_CAND = """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS pos, l_quantity / 50 AS surface, l_discount * 10 AS context, l_tax * 12 AS partner, (l_linenumber % 3) / 2.0::DOUBLE AS temporal, (l_suppkey % 10) / 10.0::DOUBLE AS prior FROM lineitem),
  c AS (SELECT *, CASE WHEN l_partkey % 17 = 0 OR temporal <= 0 THEN 'BLOCK' WHEN l_partkey % 23 = 0 OR l_suppkey % 29 = 0 OR surface >= 0.86 THEN 'FORCE_LINK' ELSE 'SCORE' END AS verdict,
    CASE WHEN l_partkey % 17 = 0 OR temporal <= 0 THEN 0.0 WHEN l_partkey % 23 = 0 THEN 0.98 WHEN l_suppkey % 29 = 0 THEN 0.95 WHEN surface >= 0.86 THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence,
    round(1 / (1 + exp(-(-4.0::DOUBLE + 1.2::DOUBLE * CASE WHEN surface < 0.8 THEN 0.0 ELSE surface END + 2.0::DOUBLE * context + 1.5::DOUBLE * partner + 1.0::DOUBLE * temporal + 0.4::DOUBLE * prior))), 9) AS probability FROM l)"""
_CO = f"""WITH m AS (SELECT DISTINCT {_DAY.format(c='o_orderdate')} AS chapter, c_nationkey AS t FROM orders JOIN customer ON o_custkey = c_custkey), p AS (SELECT x.t AS a, y.t AS b, count(*) AS weight, CAST(min(x.chapter) AS INTEGER) AS first FROM m x JOIN m y ON x.chapter = y.chapter AND x.t < y.t GROUP BY ALL)"""
_NAME = "(CASE c_custkey % 3 WHEN 0 THEN 'the lord ' WHEN 1 THEN 'élder ' ELSE '' END)"
_JW = """WITH x AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part), y AS (SELECT *, jaro_similarity(a, b) AS j, CASE WHEN a[1:4] = b[1:4] THEN 4 WHEN a[1:3] = b[1:3] THEN 3 WHEN a[1:2] = b[1:2] THEN 2 WHEN a[1] = b[1] THEN 1 ELSE 0 END AS p FROM x) SELECT p_partkey, round(j + least(p, length(a), length(b)) * 0.1 * (1 - j), 6) AS similarity FROM y"""

SQL = {
    "block_classify": f"""{WITH_TOLD}, t AS (SELECT lang, {_STRIP} AS t FROM told), f AS (SELECT *, {_PLAIN.format(t='t')} AS a, {_BRACKETED} AS br, {_FIELD} AS n FROM t)
        SELECT lang, CASE WHEN t = '' THEN 'NON_DIEGETIC' WHEN {' OR '.join(f"regexp_matches(a, {_re('(?i)' + p)})" for p in rules.NON_DIEGETIC)} THEN 'NON_DIEGETIC'
        WHEN regexp_matches(a, {_re('(?i)' + rules.TRANSLATOR_NOTE.replace('(?=', '(?:'))}) THEN 'TRANSLATOR_NOTE' WHEN regexp_matches(a, {_re('(?i)' + rules.AUTHOR_NOTE)}) THEN 'AUTHOR_NOTE'
        WHEN (br OR regexp_matches(a, {_re('(?i)' + rules.SYSTEM_WORDS)})) AND n > 0 AND br AND length(t) < 200 THEN 'SYSTEM_WINDOW' ELSE 'PROSE' END AS block_type, count(*) AS n_blocks FROM f GROUP BY ALL""",
    "system_window": f"{WITH_TOLD}, t AS (SELECT chapter, {_STRIP} AS t FROM told), f AS (SELECT chapter, {_FIELD} AS n FROM t) SELECT chapter, CAST(sum(n) AS BIGINT) AS n_fields, count(*) AS n_blocks FROM f WHERE n > 0 GROUP BY 1",
    "narrative_markers": f"{WITH_TOLD}, b AS (SELECT lang, {_PLAIN.format(t='text')} AS text, regexp_matches({_STRIP}, {_re(rules.SCENE_BREAK)}) AS br FROM told), m AS (SELECT lang, 'SCENE_BREAK' AS kind, 1.0::DOUBLE AS confidence, 1 AS n FROM b WHERE br UNION ALL "
    + " UNION ALL ".join(f"SELECT lang, '{k}' AS kind, {c}::DOUBLE AS confidence, len(regexp_extract_all(text, {_re('(?i)(?:' + '|'.join(f'(?:{p})' for p in ps) + ')')})) AS n FROM b WHERE NOT br" for k, ps, c in rules.MARKERS)
    + ") SELECT lang, kind, confidence, CAST(sum(n) AS BIGINT) AS n_markers FROM m GROUP BY ALL HAVING sum(n) > 0",
    "delivery_markers": f"{WITH_TOLD}, w AS (SELECT chapter AS doc_id, unnest(regexp_extract_all(regexp_replace({_PLAIN.format(t='text')}, {_re(rules.QUOTED)}, ' ', 'g'), {_re('(?i)' + chr(92) + 'b(?:' + '|'.join(sorted((w for ws in rules.DELIVERY.values() for w in ws), key=len, reverse=True)) + ')' + chr(92) + 'b')})) AS word FROM told)"
    f" SELECT doc_id, polarity, count(*) AS n FROM w JOIN (VALUES {', '.join(str((w, k)) for k, ws in rules.DELIVERY.items() for w in ws)}) v(v, polarity) ON lower(word) = v GROUP BY ALL",
    "mob_phrases": f"{WITH_TOLD} SELECT source, CAST(sum(len(regexp_extract_all({_PLAIN.format(t='text')}, {_re('(?i)' + rules.MOB)})) + len(regexp_extract_all({_PLAIN.format(t='text')}, {_re('(?i)' + rules.MOB_SUBJECT)}))) AS BIGINT) AS n_mobs, count(*) AS n_blocks FROM told GROUP BY 1",
    "name_containment": "SELECT p_partkey, round(CASE WHEN len(string_split(p_name, ' ')) >= 2 THEN 0.8::DOUBLE + 0.15::DOUBLE * len(string_split(p_name, ' ')) / (len(string_split(p_name, ' ')) + len(string_split(p_type, ' '))) ELSE 0.0 END, 9) AS containment FROM part",
    "content_words": f"SELECT item_id, len(list_distinct(list_transform({_TERMS.format(t='text')}, lambda w: CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y' WHEN w LIKE '%es' AND length(w) > 4 THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN w[:-2] ELSE w END))) AS n_words FROM benchmark",
    "snippet": """WITH p AS (SELECT doc_id, text, instr(text, 'and the') AS pos FROM documents WHERE lang = 'en'), q AS (SELECT *, greatest(pos - 55, 1) AS st FROM p)
        SELECT doc_id, CASE WHEN pos > 0 THEN (CASE WHEN st > 1 THEN '…' ELSE '' END) || substr(text, st, 110) || (CASE WHEN st + 109 < length(text) THEN '…' ELSE '' END) END AS snippet FROM q""",
    "comparison_key": """WITH n AS (SELECT c_custkey, (CASE WHEN c_custkey % 3 = 1 THEN 'elder ' ELSE '' END) || lower(c_name) || (CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'jr' END) AS n FROM customer) SELECT c_custkey, regexp_replace(n, '[''’\\-–—.·\\s]', '', 'g') AS "key" FROM n""",
    "jaro_winkler": _JW,
    "close_keys": "WITH b AS (SELECT DISTINCT p_brand AS brand, p_size AS size FROM part) SELECT DISTINCT x.brand AS a, y.brand AS b FROM b x JOIN b y USING (size) WHERE x.brand < y.brand AND levenshtein(x.brand, y.brand) = 1",
    "gazetteer_match": f"""WITH w AS (SELECT doc_id AS id, {_WORDS.format(t='text')} AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT id, array_to_string(w[i:i + 2], ' ') AS phrase FROM w, unnest(range(1, len(w) - 1)) t(i)),
        b AS (SELECT {_WORDS.format(t='text')} AS w FROM benchmark), p AS (SELECT DISTINCT array_to_string(w[i:i + 2], ' ') AS phrase FROM b, unnest(range(1, len(w) - 1)) t(i)) SELECT id, phrase, count(*) AS n_hits FROM g JOIN p USING (phrase) GROUP BY ALL""",
    "commonness": f"""WITH w AS (SELECT {_WORDS.format(t='text')} AS w FROM documents WHERE lang = 'en'), g AS (SELECT w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS p FROM w, unnest(range(1, len(w) + 1)) t(i)),
        c AS (SELECT word, count(*) AS total, CAST(sum(CASE WHEN p IN ('the', 'a', 'an') THEN 1 ELSE 0 END) AS BIGINT) AS determined FROM g GROUP BY 1) SELECT *, determined / total >= 0.08 AS common FROM c WHERE total >= 8""",
    "seed_harvest": "WITH w AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '([A-Z][a-z]{2,})', 1)) AS name FROM documents WHERE lang = 'en') SELECT lower(name) AS \"key\", count(*) AS n, min(doc_id) AS first_doc, count(DISTINCT source) AS n_sources FROM w GROUP BY 1 HAVING count(*) >= 2",
    "variant_families": "SELECT regexp_replace(lower(p_name), '[''’\\-–—.·\\s]', '', 'g') AS \"key\", count(DISTINCT p_name) AS n_surfaces, min((length(p_name), p_name))[2] AS canonical FROM part GROUP BY 1",
    "hit_rate_by_window": f"WITH b AS (SELECT doc_id // 40 AS win, {_WORDS.format(t='text')} AS w FROM documents WHERE text IS NOT NULL) SELECT win AS \"window\", CAST(sum(len(w)) AS BIGINT) AS n_words, CAST(sum(len(list_filter(w, lambda x: x IN ('the', 'and', 'of')))) AS BIGINT) AS n_hits FROM b GROUP BY 1",
    "mention_in_span": f'{_POINT} SELECT block, "offset", span FROM r',
    "mention_segment": f"{_POINT} SELECT block, \"offset\", coalesce(CAST(span AS VARCHAR), 'MAIN_TIMELINE') AS segment FROM r",
    "gold_nearest": _NEAREST.format(at=_AT, a="purchase", b="view", near="abs(l.at - r.at) < 36000", x="gold", y="system"),
    "antecedent_asof": _NEAREST.format(at=_AT, a="error", b="click", near="l.at > r.at AND l.at - r.at < 72000", x="pronoun", y="name"),
    "cooccurrence_block": "WITH m AS (SELECT DISTINCT l_orderkey AS block, l_suppkey AS t FROM lineitem) SELECT x.t AS a, y.t AS b, count(*) AS weight, min(x.block) AS first FROM m x JOIN m y ON x.block = y.block AND x.t < y.t GROUP BY ALL HAVING count(*) >= 2",
    "cooccurrence_chapter": f"{_CO} SELECT * FROM p",
    "casting_graph": f"{_CO}, e AS (SELECT a AS t, b AS o FROM p UNION ALL SELECT b, a FROM p) SELECT t AS target, count(DISTINCT o) AS degree FROM e GROUP BY 1",
    "descriptive_semijoin": f"{WITH_BLOCKS} SELECT chapter, count(*) AS n_blocks FROM blocks WHERE regexp_matches(text, '(?i)(licensed|released under)') AND chapter IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1",
    "lexicon_lookup": "WITH t AS (SELECT event_type AS term, count(*) AS n FROM events GROUP BY 1), c(term, class, priority) AS (VALUES ('error', 'ERA_LOCKED', 2), ('error', 'GENERIC', 5), ('view', 'TRANSFERABLE', 1), ('click', 'GENERIC', 5)) SELECT t.term, n, arg_min(class, priority) AS class FROM t LEFT JOIN c USING (term) GROUP BY ALL",
    "turn_taking": """WITH t AS (SELECT conv_id, turn, role, list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS l FROM conversations)
        SELECT conv_id, turn, role, CASE WHEN len(list_distinct(l)) = 2 THEN list_filter(l, lambda x: x <> l[-1])[1] END AS guess FROM t""",
    "anon_slots": """WITH t AS (SELECT conv_id, turn, role <> 'system' AS u FROM conversations), r AS (SELECT *, CASE WHEN u = lag(u) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS s FROM t), i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM r)
        SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1) % 4 + 1 AS INTEGER) AS slot FROM i WHERE u""",
    "crowd_runs": f"""{WITH_BLOCKS}, b AS (SELECT chapter, block_index FROM blocks WHERE length(text) BETWEEN 1 AND 200), r AS (SELECT *, CASE WHEN block_index - lag(block_index) OVER (PARTITION BY chapter ORDER BY block_index) <= 2 THEN 0 ELSE 1 END AS s FROM b), i AS (SELECT *, sum(s) OVER (PARTITION BY chapter ORDER BY block_index ROWS UNBOUNDED PRECEDING) AS run FROM r)
        SELECT chapter, min(block_index) AS first, count(*) AS n_lines FROM i GROUP BY chapter, run HAVING count(*) >= 3""",
    "epochs": """WITH e AS (SELECT user_id, event_id AS pos, 'body' || CAST((event_id // 700) % 3 AS VARCHAR) AS body FROM events), k AS (SELECT *, lag(body) OVER (PARTITION BY user_id ORDER BY pos) AS p FROM e), f AS (SELECT * FROM k WHERE p IS NULL OR p <> body)
        SELECT user_id, body, pos AS from_pos, coalesce(lead(pos) OVER (PARTITION BY user_id ORDER BY pos)::DOUBLE, 'infinity'::DOUBLE) AS to_pos FROM f""",
    "timeline_carry": "SELECT event_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS segment FROM events",
    "beats_boundary": """WITH r AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS beat FROM r)
        SELECT user_id, beat, event_type, count(*) AS n_events, min(event_id) AS first FROM i GROUP BY ALL""",
    "range_merge": f"""WITH o AS (SELECT o_custkey, CAST({_DAY.format(c='o_orderdate')} AS INTEGER) AS a FROM orders), r AS (SELECT *, CASE WHEN a > max(a + 60) OVER (PARTITION BY o_custkey ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS s FROM o), i AS (SELECT *, sum(s) OVER (PARTITION BY o_custkey ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM r)
        SELECT o_custkey, min(a) AS start, max(a) + 60 AS "end", count(*) AS n_ranges FROM i GROUP BY o_custkey, g""",
    "fixed_windows": "WITH e AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 40 AS w FROM events) SELECT user_id, w AS \"window\", count(*) AS n_events, min(event_id) AS first FROM e GROUP BY ALL",
    "adjacent_copresence": """WITH m AS (SELECT l_partkey, l_suppkey, l_orderkey % 50 AS ch, l_orderkey * 10 + l_linenumber AS o FROM lineitem), p AS (SELECT *, lag(l_suppkey) OVER w AS s1, lag(ch) OVER w AS c1, lag(o) OVER w AS o1 FROM m WINDOW w AS (PARTITION BY l_partkey ORDER BY ch, o))
        SELECT l_partkey, count(*) AS n_pairs, min(ch) AS first_chapter FROM p WHERE s1 <> l_suppkey AND c1 = ch AND o - o1 <= 100000 GROUP BY 1""",
    "bm25_topk": f"""WITH w AS (SELECT doc_id AS id, unnest({_TERMS.format(t='text')}) AS term FROM documents WHERE text IS NOT NULL), p AS (SELECT id, term, count(*) AS tf FROM w GROUP BY ALL), l AS (SELECT id, sum(tf) AS len FROM p GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS al FROM l),
        q AS (SELECT item_id AS query, unnest({_TERMS.format(t='text')}) AS term FROM benchmark), qq AS (SELECT query, term, count(*) AS qn FROM q GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
        sc AS (SELECT query, id, round(sum(qn * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al))), 6) AS score FROM qq JOIN p USING (term) JOIN df USING (term) JOIN l USING (id), st GROUP BY ALL)
        SELECT query, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 10""",
    "cosine_topk": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e JOIN e q ON e.label = q.label AND q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)
        SELECT query, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "prefilter": f"{_CAND} SELECT verdict, confidence, count(*) AS n FROM c GROUP BY ALL",
    "score": f"{_CAND} SELECT l_orderkey, l_linenumber, round(probability, 6) AS probability FROM c",
    "ablation": _CAND + ", t AS (SELECT 1.2::DOUBLE * CASE WHEN surface < 0.8 THEN 0.0 ELSE surface END AS surface, 2.0::DOUBLE * context AS context, 1.5::DOUBLE * partner AS partner, temporal, 0.4::DOUBLE * prior AS prior FROM c) SELECT " + ", ".join(f"round(avg(-4.0::DOUBLE + {' + '.join(x for x in _EVIDENCE if x != k)}), 6) AS without_{k}" for k in _EVIDENCE) + " FROM t",
    "gate": f"""{_CAND}, g AS (SELECT l_orderkey, arg_min(l_suppkey, pos) FILTER (verdict = 'FORCE_LINK') AS forced, max(probability) FILTER (verdict = 'SCORE') AS best, (list(l_suppkey ORDER BY probability DESC, pos) FILTER (verdict = 'SCORE'))[1] AS bc, list(probability ORDER BY probability DESC) FILTER (verdict = 'SCORE') AS ps FROM c GROUP BY 1)
        SELECT l_orderkey, CASE WHEN forced IS NOT NULL THEN 'LINK' WHEN best IS NULL OR best <= 0.3 THEN 'NEW' WHEN best >= 0.75 AND NOT coalesce(len(ps) > 1 AND ps[1] - ps[2] < 0.05, false) THEN 'LINK' ELSE 'DEFER' END AS decision, CASE WHEN forced IS NOT NULL THEN forced WHEN best > 0.3 THEN bc END AS candidate, coalesce(len(ps), 0) AS n_allowed FROM g""",
    "sweep_names": "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_names FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 20",
    "sweep_attributes": "SELECT p_brand AS target, 'size' AS \"key\", count(DISTINCT p_size) AS n_values FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1",
    "bcubed": """WITH e AS (SELECT label AS g, CASE WHEN vec_id % 9 <> 0 THEN vec_id % 13 END AS s FROM embeddings), c AS (SELECT g, s, count(*) AS n FROM e GROUP BY ALL), a AS (SELECT n, s, sum(n) OVER (PARTITION BY g) AS gn, sum(n) OVER (PARTITION BY s) AS sn FROM c),
        m AS (SELECT sum(n * n / sn::DOUBLE) FILTER (s IS NOT NULL) / sum(n) FILTER (s IS NOT NULL) AS p, sum(CASE WHEN s IS NOT NULL THEN n * n / gn::DOUBLE ELSE 0 END) / sum(n) AS r FROM a) SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM m""",
    "recall_at_k": "SELECT event_type AS kind, count(*) AS n_cases, " + ", ".join(f"CAST(sum(CASE WHEN event_id % 30 <= {k} THEN 1 ELSE 0 END) AS BIGINT) AS hits_{k}" for k in (1, 5, 10, 20)) + " FROM events GROUP BY GROUPING SETS ((), (event_type))",
    "conformal_thresholds": """WITH e AS (SELECT round((doc_id * 37 % 101) / 101.0::DOUBLE * 0.6::DOUBLE + quality * 0.3::DOUBLE, 6) AS s, quality = 1 AS ok FROM labels), a AS (SELECT list(s ORDER BY s DESC) FILTER (NOT ok) AS w, list(s ORDER BY s) FILTER (ok) AS r FROM e),
        t AS (SELECT w[CAST(floor(len(w) * 0.05::DOUBLE) AS INTEGER) + 1] AS l, r[CAST(floor(len(r) * 0.05::DOUBLE) AS INTEGER) + 1] AS n FROM a), u AS (SELECT l, least(n, l - 0.05::DOUBLE) AS m FROM t)
        SELECT round(CASE WHEN m < l THEN l ELSE 0.8 END, 6) AS link_threshold, round(CASE WHEN m < l THEN m ELSE 0.35 END, 6) AS new_threshold FROM u""",
    "prominence": "SELECT user_id, CASE WHEN count(*) >= 300 THEN 'PRINCIPAL' WHEN count(*) >= 30 THEN 'RECURRING' ELSE 'MINOR' END AS tier FROM events GROUP BY 1",
    "traits_gender": r"""WITH g AS (SELECT source, CAST(sum(len(regexp_extract_all(text, '(?i)\b(he|his|him)\b'))) AS BIGINT) AS m, CAST(sum(len(regexp_extract_all(text, '(?i)\b(she|her)\b'))) AS BIGINT) AS f FROM documents WHERE lang = 'en' GROUP BY 1)
        SELECT source, m, f, CASE WHEN m + f >= 6 AND m / (m + f) >= 0.7 THEN 'm' WHEN m + f >= 6 AND f / (m + f) >= 0.7 THEN 'f' END AS gender FROM g""",
    "review_report": "WITH c AS (SELECT l_suppkey, l_linestatus, count(*) AS k FROM lineitem GROUP BY ALL), m AS (SELECT l_suppkey, (list(l_linestatus ORDER BY k DESC, l_linestatus))[1] AS common FROM c GROUP BY 1) SELECT l_suppkey, count(*) AS n, min(l_orderkey) AS first, max(l_orderkey) AS last, count(DISTINCT l_returnflag) AS n_types, any_value(common) AS common FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 50",
    "payload_statistics": "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS n_targets, CAST(sum(n) AS BIGINT) AS n_mentions, CAST(sum(CASE WHEN n <= 60 THEN 1 ELSE 0 END) AS BIGINT) AS n_small FROM c",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "set_difference": "WITH a AS (SELECT user_id FROM events WHERE event_id % 2 = 0 AND event_type = 'signup'), b AS (SELECT user_id FROM events WHERE event_id % 2 = 1 AND event_type = 'signup') SELECT user_id, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY 1 UNION ALL SELECT user_id, -1 AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b)",
    "page_extract": r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<a ')) AS n_links, len(regexp_extract_all(html, '(?i)<p[ >]')) AS n_paragraphs, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS text_chars FROM pages""",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY 1",
}
#: Without SQL: trained or laid out by rules that DuckDB has no short form for; their tests use brute force.
_ROWS_ONLY = ("caption_times", "platt_fit")
QUERIES = {k: globals()[k] for k in (*SQL, *_ROWS_ONLY)}
