"""Corrections by hand: read from a log, applied to mentions and spans as joins, left in the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabulon.functions import names
from fabulon.operators import log

_PAYLOAD = "from_id string, into_id string, mention_id string, span_id string, chapter double, target_id string, new_label string, speaker_id string, anon_slot int, new_type string, primary_span_id string, absorbed_span_id string, local_start int, local_end int, text string"


def pending(corrections: DataFrame) -> DataFrame:
    """Corrections to apply, their payload read: neither applied ones nor mere flags."""
    return corrections.filter("not coalesce(applied, false) and type <> 'flag'").withColumn("p", F.from_json("payload", _PAYLOAD))


def corrections_summary(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.coalesce("applied", F.lit(False)).cast("long")).alias("n_applied"))


def manual_id(novel: Column, correction: Column) -> Column:
    return F.concat_ws(":", novel, F.lit("manual"), correction)


def manual_entities(corrections: DataFrame, selves: DataFrame) -> DataFrame:
    """Entities that corrections name anew and that are not there yet: id, novel_id, canonical_label. Applying a log twice adds nothing."""
    made = pending(corrections).filter("p.new_label is not null and p.new_label <> ''").select(manual_id(F.col("novel_id"), F.col("id")).alias("id"), "novel_id", F.col("p.new_label").alias("canonical_label"))
    return made.join(selves.select("id"), "id", "left_anti")


def _target(p: str, field: str) -> Column:
    return F.when(F.coalesce(F.col(f"{p}.new_label"), F.lit("")) != "", manual_id(F.col("novel_id"), F.col("id"))).otherwise(F.col(f"{p}.{field}"))


def corrected_mentions(mentions: DataFrame, corrections: DataFrame) -> DataFrame:
    """mentions after a log: each takes the target that the last correction of it names (null: none), then targets follow the merges to their roots."""
    todo = pending(corrections)
    last = todo.filter("type = 'reassign_mention'").groupBy(F.col("p.mention_id").alias("_m")).agg(F.max_by(F.struct(_target("p", "target_id").alias("t")), F.struct("created_at", "id")).alias("_new"))
    out = mentions.join(last, mentions["id"] == last["_m"], "left").withColumn("target_id", F.when(F.col("_new").isNotNull(), F.col("_new.t")).otherwise(F.col("target_id"))).drop("_m", "_new")
    roots = log.redirect_roots(todo.filter("type = 'merge_entities' and p.from_id <> p.into_id").select(F.col("p.from_id").alias("from_id"), F.col("p.into_id").alias("to_id")))
    out = out.join(roots, out["target_id"] == roots["from_id"], "left").withColumn("target_id", F.coalesce("root", "target_id")).drop("from_id", "root")
    return out.select(*mentions.columns)


def created_mentions(spans: DataFrame, corrections: DataFrame) -> DataFrame:
    """Mentions that corrections mark in spans: id, novel_id, chapter, block_index, offset, text, reference_mode, target_id; those out of range or without a target are none."""
    c = pending(corrections).filter("type = 'create_mention'").select("id", "novel_id", "p", _target("p", "target_id").alias("target_id"))
    s = spans.select(F.col("id").alias("_s"), "chapter", "block_index", "start", F.col("text").alias("_text"), "span_type")
    hit = c.join(s, F.col("p.span_id") == F.col("_s")).filter("p.local_start >= 0 and p.local_start < p.local_end and p.local_end <= length(_text) and target_id is not null")
    own = F.substr(F.col("_text"), F.col("p.local_start") + 1, F.col("p.local_end") - F.col("p.local_start"))
    mode = F.when(F.col("span_type") == "DIALOGUE", "DIALOGUE_REFERENCE").otherwise("NARRATOR_REFERENCE")
    return hit.select(F.concat_ws(":", "novel_id", F.lit("correction"), "id", F.lit("mention")).alias("id"), "novel_id", "chapter", "block_index", (F.col("start") + F.col("p.local_start")).alias("offset"), F.coalesce("p.text", own).alias("text"), mode.alias("reference_mode"), "target_id")


def corrected_spans(spans: DataFrame, corrections: DataFrame, blocks: DataFrame) -> DataFrame:
    """spans after a log: speakers and kinds set by the last correction of a span, merged lines cut anew from their block.

    blocks: novel_id, chapter, block_index, text. Lines merge in their block only; the absorbed one goes.
    """
    todo = pending(corrections)
    at = F.struct("created_at", "id")
    slot = F.concat_ws(":", "novel_id", F.lit("anon"), chapter_text(F.col("p.chapter")), F.col("p.anon_slot").cast("string"))
    speaker = F.when(F.coalesce(F.col("p.new_label"), F.lit("")) != "", _target("p", "speaker_id")).when(F.col("p.anon_slot").isNotNull(), slot).otherwise(F.col("p.speaker_id"))
    method = F.when(F.col("p.anon_slot").isNotNull() & (F.coalesce(F.col("p.new_label"), F.lit("")) == ""), "ANONYMOUS_SLOT").when(speaker.isNotNull(), "EXPLICIT").otherwise("UNRESOLVED")
    said = todo.filter("type = 'reassign_speaker'").groupBy(F.col("p.span_id").alias("_a")).agg(F.max_by(F.struct(speaker.alias("s"), method.alias("m")), at).alias("_said"))
    kind = todo.filter("type = 'reassign_span_type'").groupBy(F.col("p.span_id").alias("_b")).agg(F.max_by(F.col("p.new_type"), at).alias("_kind"))
    place = spans.select("id", "novel_id", "chapter", "block_index", "start", "end")
    one, two = place.toDF("_p", "_n1", "_c1", "_b1", "_s1", "_e1"), place.toDF("_q", "_n2", "_c2", "_b2", "_s2", "_e2")
    pairs = todo.filter("type = 'merge_lines'").select(F.col("p.primary_span_id").alias("_p"), F.col("p.absorbed_span_id").alias("_q")).join(one, "_p").join(two, "_q").filter("_n1 = _n2 and _c1 = _c2 and _b1 = _b2 and _p <> _q")
    grown = pairs.groupBy("_p").agg(F.least(F.min("_s1"), F.min("_s2")).alias("_from"), F.greatest(F.max("_e1"), F.max("_e2")).alias("_to"))
    out = spans.join(pairs.select(F.col("_q").alias("id")), "id", "left_anti")
    out = out.join(said, out["id"] == said["_a"], "left").join(kind, out["id"] == kind["_b"], "left").join(grown, out["id"] == grown["_p"], "left")
    out = out.join(blocks.select("novel_id", "chapter", "block_index", F.col("text").alias("_block")), ["novel_id", "chapter", "block_index"], "left")
    new = {
        "speaker_self_id": F.when(F.col("_said").isNotNull(), F.col("_said.s")).otherwise(F.col("speaker_self_id")), "attribution_method": F.coalesce("_said.m", "attribution_method"),
        "span_type": F.coalesce("_kind", "span_type"), "start": F.coalesce("_from", "start"), "end": F.coalesce("_to", "end"),
        "text": F.when(F.col("_from").isNotNull() & F.col("_block").isNotNull(), F.trim(F.substr(F.col("_block"), F.col("_from") + 1, F.col("_to") - F.col("_from")))).otherwise(F.col("text")),
    }
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in spans.columns])


#: Events that corrections leave in the log.
EVENTS = {"merge_entities": "merge", "reassign_mention": "rebind", "reassign_speaker": "rebind", "create_mention": "rebind", "merge_lines": "void_span", "reassign_span_type": "remap_segment"}


def correction_events(corrections: DataFrame, events: DataFrame) -> DataFrame:
    """Events of pending corrections, numbered on from the log: id, type, payload, seq. A reassignment to nobody is a retraction."""
    todo = pending(corrections)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv]), F.col("type"))
    nobody = F.col("type").isin("reassign_mention", "reassign_speaker") & _target("p", "target_id").isNull() & F.col("p.speaker_id").isNull() & F.col("p.anon_slot").isNull()
    rows = todo.select(F.concat_ws(":", "novel_id", F.lit("correction"), "id").alias("id"), F.when(nobody, "retract").otherwise(kind).alias("type"), "payload", F.struct("created_at", "id").alias("_o"))
    return log.numbered(rows, events, "seq", "_o").drop("_o")


def retractable(bindings: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Standing alias bindings of a contradiction's target (target_id, surfaces) under one of its surfaces."""
    hit = contradictions.select("target_id", F.explode("surfaces").alias("_s")).select("target_id", names.normalize_alias(F.col("_s")).alias("alias_norm")).distinct()
    return bindings.filter("retracted is null").join(hit, ["target_id", "alias_norm"], "left_semi")


def split_events(contradictions: DataFrame, events: DataFrame) -> DataFrame:
    """A split event for each contradiction (target_id, kind, detail, surfaces, confidence), numbered on from the log."""
    rows = contradictions.select(F.concat_ws(":", "target_id", F.lit("split"), "kind").alias("id"), F.lit("split").alias("type"), F.to_json(F.struct("target_id", "kind", "detail", "surfaces")).alias("payload"), "confidence")
    return log.numbered(rows, events, "seq", "id")


def chapter_text(number: Column) -> Column:
    """A chapter's number as it stands in ids: without .0."""
    return F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))


def redirected(payload: DataFrame, corrections: DataFrame) -> DataFrame:
    """Preview: rows (target_id, n) with merges followed and counts added up again."""
    roots = log.redirect_roots(pending(corrections).filter("type = 'merge_entities' and p.from_id <> p.into_id").select(F.col("p.from_id").alias("from_id"), F.col("p.into_id").alias("to_id")))
    out = payload.join(roots, payload["target_id"] == roots["from_id"], "left").select(F.coalesce("root", "target_id").alias("target_id"), "n")
    return out.groupBy("target_id").agg(F.sum("n").alias("n"))


def draft_positions(blocks: DataFrame, drafts: DataFrame, around: int = 60) -> DataFrame:
    """Every occurrence of each drafted surface (identity, surface, chapter) in its chapter, no word character beside it, with its context."""
    hit = blocks.join(drafts, "chapter").filter(F.contains("text", "surface"))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length("text") - F.length("surface") + 1, F.lit(1))), lambda i: (F.substr(F.col("text"), i, F.length("surface")) == F.col("surface")) & ~F.substr(F.col("text"), F.greatest(i - 1, F.lit(1)), F.when(i > 1, 1).otherwise(0)).rlike(r"\w") & ~F.substr(F.col("text"), i + F.length("surface"), F.lit(1)).rlike(r"\w"))
    found = hit.withColumn("_at", F.explode(at))
    start = F.greatest(F.col("_at") - 1 - around, F.lit(0))
    return found.select("chapter", "block_index", "identity", "surface", (F.col("_at") - 1).alias("offset"), F.substr(F.col("text"), start + 1, F.col("_at") - 1 + F.length("surface") + around - start).alias("context"))
