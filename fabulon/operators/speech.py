"""Spans and speakers: quotes, attribution tiers, scenes and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verbs of the attribution patterns (fixed values).
SAID = "said|asked|replied|shouted|whispered|answered"
THOUGHT = "thought|wondered|mused"


def quote_spans(text: Column) -> Column:
    """array of (text, quoted): the block cut at double quotes, straight or curly, in order; an unpaired quote stays in its span."""
    parts = F.regexp_extract_all(text, F.lit('("[^"]*"|“[^”]*”|[^"“]+|["“])'), F.lit(1))
    return F.transform(parts, lambda p: F.struct(p.alias("text"), ((F.length(p) > 1) & p.rlike('(?s)^["“].*["”]$')).alias("quoted")))


def spans(blocks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row for each span, with its order number and offsets in the block."""
    s = blocks.select(*keys, F.posexplode(quote_spans(F.col(text))).alias("n", "s")).select(*keys, "n", "s.text", "s.quoted")
    end = F.sum(F.length("text")).over(Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))


def span_type(text: Column, quoted: Column, before: Column, after: Column) -> Column:
    """Quoted text near a thought verb is inner monologue, other quoted text dialogue; the rest is action or description by its verbs."""
    near = F.concat_ws(" ", F.substr(before, F.lit(-80), F.lit(80)), F.substr(after, F.lit(1), F.lit(80)))
    return F.when(quoted & near.rlike(rf"(?i)\b({THOUGHT})\b"), "INNER_MONOLOGUE").when(quoted, "DIALOGUE").when(text.rlike(r"(?i)\b(is|are|was|were|had)\b"), "DESCRIPTION").otherwise("ACTION")


def explicit_speaker(before: Column, after: Column) -> Column:
    """The name in `said NAME` or `NAME said` right around a quote; null if none."""
    behind = F.regexp_extract(after, rf"^[\s,.]*(?:{SAID})\s+([A-Z][\w#-]*)", 1)
    ahead = F.regexp_extract(after, rf"^[\s,.]*([A-Z][\w#-]*)\s+(?:{SAID})\b", 1)
    lead = F.regexp_extract(before, rf"([A-Z][\w#-]*)\s+(?:{SAID})[\s,:]*$", 1)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (behind, ahead, lead)])


def ladder(tiers: list[tuple[str, Column, float]]) -> tuple[Column, Column, Column]:
    """Speaker, method and confidence of the first tier that has one; UNRESOLVED with 0 otherwise."""
    who = F.coalesce(*[t[1] for t in tiers])
    method, sure = F, F
    for name, value, confidence in tiers:
        method, sure = method.when(value.isNotNull(), name), sure.when(value.isNotNull(), confidence)
    return who, method.otherwise("UNRESOLVED"), sure.otherwise(0.0)


def paired_segments(marks: DataFrame, key: str, order: str, kind: str, enter: str, leave: str) -> DataFrame:
    """Each entry with the first exit after it, else open to the key's last mark; entries inside the segment before them are skipped by the exit they share."""
    after = Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    m = marks.withColumn("_exit", F.min(F.when(F.col(kind) == leave, F.col(order))).over(after)).withColumn("_last", F.max(order).over(Window.partitionBy(key)))
    opened = m.filter(F.col(kind) == enter).select(key, F.col(order).alias("start"), F.coalesce("_exit", "_last").alias("end"), F.col("_exit").isNull().alias("open"))
    return opened.groupBy(key, "end", "open").agg(F.min("start").alias("start"))


def sessions(rows: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """Runs of rows no further apart than gap."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    numbered = rows.withColumn("_new", new).withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_n").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n_rows")).drop("_n")


def packed_text(parts: Column, limit: int) -> Column:
    """Paragraphs packed in order into chunks of at most limit characters (a longer one is a chunk of its own)."""
    step = lambda acc, p: F.when((F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + 1 + F.length(p) <= limit), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws("\n", F.element_at(acc, -1), p)))).otherwise(F.concat(acc, F.array(p)))
    return F.aggregate(parts, F.array().cast("array<string>"), step)


def suspected_splits(surfaces: DataFrame, surface: str) -> DataFrame:
    """Pairs of spellings with one head noun, neither equal nor more than 12 characters apart; head nouns are the join key."""
    s = surfaces.select(F.col(surface).alias("s")).distinct().withColumn("head", F.lower(F.element_at(F.split("s", r"\s+"), -1)))
    return s.alias("x").join(s.alias("y"), "head").filter((F.col("x.s") < F.col("y.s")) & (F.abs(F.length("x.s") - F.length("y.s")) <= 12)).select(F.col("x.s").alias("a"), F.col("y.s").alias("b"), "head")


def nearest_voice(wanted: DataFrame, bank: DataFrame) -> DataFrame:
    """For each wanted (gender, age) the closest voices: exact gender and age, then by age distance, then any gender. Both tables are small by nature."""
    bands = F.array(*map(F.lit, ("child", "young", "adult", "old")))
    d = wanted.select("gender", "age").distinct().join(F.broadcast(bank.select("voice", F.col("gender").alias("_g"), F.col("age").alias("_a"))))
    d = d.withColumn("cost", F.abs(F.array_position(bands, F.col("age")) - F.array_position(bands, F.col("_a"))) + F.when(F.col("gender") == F.col("_g"), 0).otherwise(10))
    return d.groupBy("gender", "age").agg(F.min_by("voice", F.struct("cost", "voice")).alias("voice"), F.min("cost").cast("long").alias("cost"))
