"""Schemas of the fact store and its closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
MAIN_TIMELINE = "main"
READER, SYSTEM = "READER", "SYSTEM"
LAST_CHAPTER = 10**6
STEP = 1_000_000

_FACT = (
    "target_kind string, target_id string, timeline_id string, from_lb double, from_ub double, to_lb double, to_ub double, "
    "learned struct<chapter:int,offset:int>, observer_id string, asserted_by string, truth_status string, "
    "retracted struct<chapter:int,offset:int>, evidence string, confidence double, seq long"
)
SCHEMAS = {
    "chapter": "novel_id string, number double, title string, source_href string, blocks array<struct<index:int,block_type:string,text:string,italic_ranges:array<struct<start:int,end:int>>,system_fields:map<string,string>>>",
    "span": "id string, novel_id string, chapter double, block_index int, start int, end int, span_type string, text string, speaker_self_id string, attribution_method string, co_speaker_self_ids array<string>, delivery_markers array<string>, confidence double",
    "segment": "id string, novel_id string, chapter_from double, chapter_to double, offset_from int, offset_to int, timeline_id string, segment_type string, narrative_layer string, canonicity string, confidence double",
    "mention": "id string, novel_id string, segment_id string, chapter double, block_index int, offset int, text string, alias_type string, span_type string, reference_mode string, speaker_self_id string, target_kind string, target_id string, local_group_id string, confidence double, method string, provenance string, entity_label string",
    "alias_binding": _FACT + ", alias string, alias_norm string, alias_type string",
    "attribute": _FACT + ", key string, value string",
    "relation": _FACT + ", src_self string, dst_self string, type string",
    "self_persona_binding": _FACT + ", self_id string, persona_id string",
    "resolution_event": "id string, seq long, type string, payload string, cause struct<chapter:int,offset:int>, read_set_hash string, method string, confidence double",
    "derived_artifact": "id string, tier string, read_set array<string>, read_set_hash string, payload string, invalidated boolean",
    "llm_call": "stage string, tier string, model string, escalated boolean, escalation_reason string, prompt_tokens int, completion_tokens int, latency_ms int, ok boolean, novel_id string, chapter double",
}

STORY_BLOCKS = ("PROSE", "DIALOGUE", "SYSTEM_WINDOW")
PERSON_KINDS = ("SELF", "PERSONA")
TITLE_ALIASES = ("TRANSFERABLE_TITLE", "ERA_LOCKED_TITLE", "PROGRESSIVE_RANK")
VISUAL_SPANS = ("DIALOGUE", "ACTION", "DESCRIPTION")


def is_story_content(block_type: Column) -> Column:
    return block_type.isin(*STORY_BLOCKS)


def is_person(kind: Column) -> Column:
    return kind.isin(*PERSON_KINDS)


def sortable(chapter: Column, offset: Column) -> Column:
    """A position in reading order as one number."""
    return chapter.cast("int").cast("long") * STEP + offset


def fact_ref(kind: str, ident: Column, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), ident.cast("string"), *[p.cast("string") for p in parts])
