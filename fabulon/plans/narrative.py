"""Queries over names in text, reference, speakers, retrieval, writes and production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulon.functions import names, rules, text
from fabulon.operators import anaphora, dialogue, gazetteer, lookups, production, retrieval, state
from fabulon.plans.facts import WITH_FACTS
from fabulon.plans.texts import _PLAIN, _re
from fabulon.sources.adapters import blocks, event_facts, table


def _turns(s: SparkSession, d: str) -> DataFrame:
    """Conversations as chapters: one block for each turn, with a name that speaks or acts and a quoted text."""
    who = F.concat(F.initcap("role"), F.lit(" "), F.element_at(F.array(*map(F.lit, ("Wang", "Li", "Moretti"))), (F.col("conv_id") % 3 + 1).cast("int")))
    said = F.concat(F.lit("“"), F.regexp_replace(F.coalesce("text", F.lit("")), "[“”]", ""), F.lit("”"))
    line = F.when(F.col("turn") % 4 == 0, F.concat(said, F.lit(" "), who, F.lit(" said."))).when(F.col("turn") % 4 == 1, F.concat(who, F.lit(" nodded. "), said)).when(F.col("turn") % 4 == 2, said).otherwise(F.concat(said, F.lit(" he asked.")))
    return table(s, d, "conversations").select(F.lit("n").alias("novel_id"), F.col("conv_id").cast("double").alias("chapter"), F.col("turn").cast("int").alias("block_index"), F.lit("PROSE").alias("block_type"), line.alias("text"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("italic_ranges"))


#: Sentences in which something happens to the identity of a part's type.
_VERBS = (" succeeded ", " turned out to be ", " was killed by ", " was reborn as ", " claimed to be ", " became famous throughout ", " saw ")
_HAPPENS = "upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || (case p_partkey % 7 " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(_VERBS)) + " end) || upper(substr(p_name, 1, 1)) || substr(p_name, 2) || '.'"


# -- names and reference -------------------------------------------------------------------------


def pronoun_counts(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "documents").select("doc_id", F.explode(anaphora.pronouns(F.col("text"))).alias("p"))
    return p.groupBy("doc_id", "p.gender", "p.number").agg(F.count("*").alias("n"))


def gender_cues(s: SparkSession, d: str) -> DataFrame:
    return anaphora.genders(table(s, d, "documents"), ["doc_id"])


def antecedents(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", "event_id", "event_type", (F.col("event_id") * 7 % 100_000).alias("at"))
    at = (F.col("event_id") % 3 + 1).cast("int")
    g = F.when(at != 0, F.element_at(F.array(*map(F.lit, "mfn")), at))
    m = e.filter("event_type in ('click', 'view')").select("user_id", F.col("event_id").alias("id"), F.col("at").alias("offset"), F.col("event_type").alias("text"), F.lit("RIGID_NAME").alias("alias_type"), g.alias("gender"))
    said = e.filter("event_type = 'error'").select("user_id", F.col("at").alias("start"), g.alias("gender"))
    found = anaphora.antecedents(said, m, ["user_id"], reach=6000)
    return found.select("user_id", "start", "mention_id", F.round("confidence", 6).alias("confidence"), "rule")


def detectors(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_HAPPENS).alias("text"))
    return retrieval.event_detectors(p, ["doc_id"]).select("doc_id", "kind", "subject", "object")


def entity_kinds(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", F.when(F.col("user_id") % 5 == 0, "location").when(F.col("user_id") % 5 == 1, F.when(F.col("event_id") % 50 == 0, "character").otherwise("organization")).when(F.col("user_id") % 5 == 2, "item").when(F.col("event_id") % 2 == 0, "location").otherwise("item").alias("entity_label"))
    return retrieval.entity_kind(e, ["user_id"])


def pov_holder(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select((F.col("event_id") % 200).alias("chapter"), "event_type", "user_id", (F.col("event_id") * 31 % 5000).alias("at"))
    m = e.filter("event_type <> 'signup'").select("chapter", F.col("at").alias("offset"), F.concat(F.lit("N"), (F.col("user_id") % 20).cast("string")).alias("text"), F.lit("RIGID_NAME").alias("alias_type"))
    return dialogue.pov_holder(m, e.filter("event_type = 'signup'").select("chapter", F.col("at").alias("start"), F.lit("INNER_MONOLOGUE").alias("span_type")), ["chapter"])


def age_band(s: SparkSession, d: str) -> DataFrame:
    return production.age_band(table(s, d, "documents").withColumn("text", F.concat_ws(" ", "text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a "), (F.col("doc_id") % 90).cast("string"), F.lit("-year-old"))).when(F.col("doc_id") % 3 == 1, "the old man and the elderly"))), ["doc_id"])


def display_labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").groupBy("p_brand").agg(names.display_label(F.concat(F.lit("The "), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "’s").otherwise(""))).alias("label"))


def gazetteer_longest(s: SparkSession, d: str) -> DataFrame:
    w = text.words(F.col("text"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.array(F.array_join(F.slice(w, i, 2), " "), F.array_join(F.slice(w, i, 3), " "))))
    phrases = table(s, d, "benchmark").filter(F.size(w) >= 3).select(F.explode(grams).alias("alias")).distinct().withColumn("alias_type", F.lit("RIGID_NAME"))
    hits = gazetteer.find(table(s, d, "documents"), ["doc_id"], gazetteer.admitted(phrases))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_hits"), F.sum(F.col("end") - F.col("start")).alias("n_chars"))


def seed_names(s: SparkSession, d: str) -> DataFrame:
    return gazetteer.seed(_turns(s, d))


def handoff_chapters(s: SparkSession, d: str) -> DataFrame:
    """Parts as chapters whose names lose their space half way through."""
    name = F.when(F.col("p_partkey") % 20 < 10, F.initcap("p_name")).otherwise(F.initcap(F.replace("p_name", F.lit(" "), F.lit(""))))
    p = table(s, d, "part").select((F.col("p_partkey") % 20).alias("chapter"), F.concat(F.lit("they met "), name, F.lit(" there")).alias("text"))
    return gazetteer.handoffs(p, least=1)


# -- speakers ------------------------------------------------------------------------------------


def chapter_spans(s: SparkSession, d: str) -> DataFrame:
    return dialogue.chapter_spans(_turns(s, d)).groupBy("chapter", "span_type").agg(F.count("*").alias("n_spans"), F.sum(F.size("delivery_markers")).cast("long").alias("n_markers"))


def speaker_tiers(s: SparkSession, d: str) -> DataFrame:
    t = _turns(s, d)
    return dialogue.ladder(dialogue.chapter_spans(t), t, ["chapter"]).groupBy("method", "span_type").agg(F.count("*").alias("n_spans"), F.count("speaker").alias("n_named"))


def identity_groups(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "lineitem").select(F.lit("n").alias("novel_id"), F.col("l_partkey").cast("string").alias("group_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), (F.col("l_orderkey") % 50).cast("double").alias("chapter"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offset"), F.col("l_suppkey").cast("string").alias("text"), F.when(F.col("l_linenumber") % 2 == 0, "PRESENT").otherwise("NARRATOR_REFERENCE").alias("reference_mode"), F.when(F.col("l_returnflag") == "R", "dream").otherwise("main").alias("timeline_id"))
    out = anaphora.validated(l, ["novel_id"], window=100_000)
    return out.groupBy("group_id", "violation").agg(F.count("*").alias("n_parts"), F.sum(F.size("mention_ids")).cast("long").alias("n_mentions"))


# -- retrieval and writes ------------------------------------------------------------------------


def blended_retrieval(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    m = p.select(F.col("p_brand").alias("target_id"), F.col("p_name").alias("text"), F.col("p_partkey").cast("double").alias("chapter"), F.concat_ws(" ", "p_type", "p_name").alias("context"))
    q = p.select("p_name", "p_type").distinct().select(F.xxhash64("p_name", "p_type").alias("query"), F.col("p_name").alias("surface"), F.col("p_type").alias("context"))
    return retrieval.retrieve(q, m, m.select("target_id", F.col("text").alias("alias")), 5).select("query", "id", F.round("score", 6).alias("score"), "rank")


def facts_as_of(s: SparkSession, d: str) -> DataFrame:
    return state.facts_as_of(event_facts(s, d), ["target_id"], "key", "value", F.lit(12_000_000))


def new_attributes(s: SparkSession, d: str) -> DataFrame:
    f = event_facts(s, d).select(F.lit("SELF").alias("target_kind"), "target_id", "timeline_id", "key", F.when(F.col("seq") % 4 > 0, F.floor(F.col("value")).cast("string")).alias("value"), F.floor(F.col("learned") / 1_000_000).alias("learned"), "observer_id", "truth_status", "seq")
    fresh = lookups.new_attributes(f.filter("seq % 2 = 0"), f.filter("seq % 2 = 1"))
    return fresh.groupBy("target_id").agg(F.count("*").alias("n_new"))


def retract_bindings(s: SparkSession, d: str) -> DataFrame:
    out = lookups.retracted(event_facts(s, d).select("seq", "key", "retracted", "truth_status"), F.col("key") == "error", F.lit(99_000_000).cast("long"))
    return out.groupBy("key", "truth_status").agg(F.count("*").alias("n"), F.sum("retracted").alias("retracted"))


# -- production ----------------------------------------------------------------------------------


def chapter_beats(s: SparkSession, d: str) -> DataFrame:
    spans = dialogue.chapter_spans(_turns(s, d)).withColumn("speaker", F.lit(None).cast("string"))
    b = production.beats(production.block_rows(spans, ["chapter"]), ["chapter"], most=3)
    return b.select("chapter", "beat", F.size("blocks").alias("n_blocks"), F.element_at("blocks", 1).alias("lead_block"), F.length("text").alias("n_chars"))


def chapter_scenes(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select((F.col("event_id") % 300).alias("chapter"), F.col("event_id").alias("block_index"), F.lit("s").alias("segment"), F.array((F.col("user_id") % 3).cast("string")).alias("cast"), F.when(F.col("event_type") == "signup", F.col("event_type")).when(F.col("event_type") == "error", "cave").alias("locale"))
    return production.scenes(e, ["chapter"]).groupBy("chapter").agg((F.max("scene") + 1).alias("n_scenes"), F.count("*").alias("n_blocks"))


def caption_cards(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").select("conv_id", F.col("turn").alias("n"), "text", F.lit("DIALOGUE").alias("span_type"), F.col("role").alias("speaker"), (F.length("text") / 16).alias("seconds"))
    return production.captions(c, ["conv_id"]).groupBy("conv_id", "n").agg(F.count("*").alias("n_cards"), F.round(F.min("start"), 6).alias("starts"), F.round(F.max("end"), 6).alias("ends"))


def clip_plan(s: SparkSession, d: str) -> DataFrame:
    b = blocks(s, d).select("chapter", "block_index", "text", (F.length("text") / 16.0).alias("duration"), F.floor(F.col("block_index") / 5).alias("scene"))
    return production.clip_blocks(production.block_scores(b, ["chapter"]), ["chapter"])


_PRONOUNS = ", ".join(str(p) for p in rules.PRONOUNS)
_WORDS = "|".join(sorted((p for p, *_ in rules.PRONOUNS), key=len, reverse=True))
_DETECT = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, trim(regexp_extract(m, {_re(f + p)}, 1)) AS subject, {'trim(regexp_extract(m, ' + _re(f + p) + ', 2))' if k in ('TRANSFER', 'DECEPTION', 'REVEAL') else chr(39) * 2} AS object FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_re(f + p)}, 0)) AS m FROM (SELECT p_partkey AS doc_id, {_HAPPENS} AS text FROM part))"
    for k, p, f in ((k, p, "" if k == "DEATH" else "(?i)") for k, p, _, _ in rules.DETECTORS)
)
SQL = {
    "pronoun_counts": f"WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all({_PLAIN.format(t='text')}, {_re('(?i)' + chr(92) + 'b(?:' + _WORDS + ')' + chr(92) + 'b')}))) AS p FROM documents) SELECT doc_id, gender, \"number\", count(*) AS n FROM w JOIN (VALUES {_PRONOUNS}) v(p, gender, \"number\") USING (p) GROUP BY ALL",
    "gender_cues": f"WITH c AS (SELECT doc_id, coalesce(sum(len(regexp_extract_all({_PLAIN.format(t='text')}, {_re('(?i)' + rules.MALE_CUES)}))), 0) AS m, coalesce(sum(len(regexp_extract_all({_PLAIN.format(t='text')}, {_re('(?i)' + rules.FEMALE_CUES)}))), 0) AS f FROM documents GROUP BY 1) SELECT doc_id, CASE WHEN m > 2 * f AND m >= 2 THEN 'm' WHEN f > 2 * m AND f >= 2 THEN 'f' ELSE 'n' END AS gender FROM c",
    "antecedents": """WITH e AS (SELECT user_id, event_id, event_type, event_id * 7 % 100000 AS at_, ['m', 'f', 'n'][event_id % 3 + 1] AS g FROM events),
        j AS (SELECT s.user_id, s.event_id AS sid, s.at_ AS start, s.g AS sg, m.event_id AS mention_id, m.at_ AS off, m.g AS mg FROM e s JOIN e m ON s.user_id = m.user_id AND m.event_type IN ('click', 'view') AND m.at_ < s.at_ AND s.at_ - m.at_ <= 6000 WHERE s.event_type = 'error' AND (s.g = 'n' OR m.g = 'n' OR s.g = m.g)),
        r AS (SELECT *, count(*) OVER (PARTITION BY sid) AS n, row_number() OVER (PARTITION BY sid ORDER BY off DESC) AS k FROM j)
        SELECT user_id, start, mention_id, round(CASE WHEN n = 1 THEN least(1.0, b + 0.1) ELSE b END, 6)::DOUBLE AS confidence, CASE WHEN n = 1 THEN 'unique_agreeing_antecedent' ELSE 'nearest_agreeing_antecedent' END AS rule
        FROM (SELECT *, (CASE WHEN mg <> 'n' AND sg <> 'n' THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END) * (CASE WHEN start - off > 3000 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END) AS b FROM r WHERE k = 1)""",
    "detectors": f"WITH h AS ({_DETECT}) SELECT doc_id, kind, CASE WHEN subject <> '' THEN subject ELSE object END AS subject, CASE WHEN subject <> '' AND object <> '' THEN object END AS object FROM h WHERE subject <> '' OR object <> ''",
    "entity_kinds": """SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'LOCATION' WHEN user_id % 5 = 1 THEN CASE WHEN bool_or(event_id % 50 = 0) THEN 'SELF' ELSE 'ORGANIZATION' END WHEN user_id % 5 = 2 THEN 'ITEM'
        WHEN count(DISTINCT event_id % 2) > 1 THEN 'SELF' WHEN min(event_id % 2) = 0 THEN 'LOCATION' ELSE 'ITEM' END AS kind FROM events GROUP BY user_id""",
    "pov_holder": """WITH e AS (SELECT event_id % 200 AS chapter, event_type, 'N' || (user_id % 20) AS t, event_id * 31 % 5000 AS p FROM events),
        c AS (SELECT s.chapter, m.t, count(*) AS n FROM e s JOIN e m ON s.chapter = m.chapter AND abs(m.p - s.p) < 400 WHERE s.event_type = 'signup' AND m.event_type <> 'signup' GROUP BY ALL)
        SELECT chapter, arg_max(t, n * 1000 + CAST(rk AS BIGINT)) AS pov FROM (SELECT *, rank() OVER (ORDER BY t) AS rk FROM (SELECT DISTINCT t FROM c)) JOIN c USING (t) GROUP BY chapter HAVING max(n) / sum(n) >= 0.02""",
    "age_band": """WITH t AS (SELECT doc_id, lower(concat_ws(' ', text, CASE WHEN doc_id % 3 = 0 THEN 'a ' || (doc_id % 90) || '-year-old' WHEN doc_id % 3 = 1 THEN 'the old man and the elderly' END)) AS t FROM documents),
        n AS (SELECT doc_id, t, list_min(list_transform(regexp_extract_all(t, '\\b(\\d{1,3})[\\s\\-]*year[\\s\\-]*old\\b', 1), lambda x: CAST(x AS INTEGER))) AS age, """
    + ", ".join("(" + " + ".join(f"len(regexp_extract_all(t, '{w}'))" for w in ws) + f") AS {b}_n" for b, ws in production.AGE_BANDS)
    + """ FROM t) SELECT doc_id, CASE WHEN age < 13 THEN 'child' WHEN age < 20 THEN 'youth' WHEN age < 60 THEN 'adult' WHEN age IS NOT NULL THEN 'elder' WHEN child_n >= 2 THEN 'child' WHEN youth_n >= 2 THEN 'youth' WHEN elder_n >= 2 THEN 'elder' END AS age_band FROM n""",
    "display_labels": """WITH p AS (SELECT p_brand, 'The ' || p_name || (CASE WHEN p_partkey % 2 = 0 THEN '’s' ELSE '' END) AS s, p_name AS n FROM part), b AS (SELECT p_brand, CASE WHEN length('The ' || n) > 4 AND n LIKE '%s' AND NOT (n LIKE '%ss' OR n LIKE '%us' OR n LIKE '%is') THEN n[:-2] ELSE n END AS label FROM p)
        SELECT p_brand, (list(label ORDER BY length(label) DESC, label DESC))[1] AS label FROM b GROUP BY 1""",
    "facts_as_of": f'{WITH_FACTS} SELECT target_id, "key", arg_max(value, learned * 10000000000::HUGEINT + seq) AS value FROM facts WHERE retracted IS NULL AND learned <= 12000000 GROUP BY ALL',
    "new_attributes": f"""{WITH_FACTS}, f AS (SELECT target_id, timeline_id, "key", CASE WHEN seq % 4 > 0 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value, CAST(floor(learned / 1000000) AS BIGINT) AS learned, observer_id, truth_status, seq FROM facts),
        n AS (SELECT target_id, timeline_id, "key", value, learned, observer_id, truth_status FROM f WHERE seq % 2 = 1 EXCEPT SELECT target_id, timeline_id, "key", value, learned, observer_id, truth_status FROM f WHERE seq % 2 = 0) SELECT target_id, count(*) AS n_new FROM n GROUP BY 1""",
    "retract_bindings": f"""{WITH_FACTS}, r AS (SELECT "key", CASE WHEN "key" = 'error' AND retracted IS NULL THEN 'FALSE' ELSE truth_status END AS truth_status, CASE WHEN "key" = 'error' THEN coalesce(retracted, 99000000) ELSE retracted END AS retracted FROM facts) SELECT "key", truth_status, count(*) AS n, CAST(sum(retracted) AS BIGINT) AS retracted FROM r GROUP BY ALL""",
}
#: Tested against expectations written by hand (tests/test_gazetteer.py, test_dialogue.py, test_store_operators.py, test_production.py).
_ROWS_ONLY = (
    "gazetteer_longest", "seed_names", "handoff_chapters", "chapter_spans", "speaker_tiers", "identity_groups", "blended_retrieval", "chapter_beats", "chapter_scenes",
    "caption_cards", "clip_plan",
)
QUERIES = {k: globals()[k] for k in (*SQL, *_ROWS_ONLY)}
