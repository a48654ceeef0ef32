"""Lookups in the fact store: filters and orders that prune by novel, chapter and target before anything moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabulon.functions import names


def chapter(chapters: DataFrame, novel_id: str, number: float) -> DataFrame:
    return chapters.filter((F.col("novel_id") == novel_id) & (F.col("number") == number))


def chapters_in_order(chapters: DataFrame, novel_id: str, first: float = float("-inf"), last: float = float("inf")) -> DataFrame:
    """Chapters of a novel from first to last, both included, in reading order."""
    return chapters.filter((F.col("novel_id") == novel_id) & F.col("number").between(first, last)).orderBy("number")


def chapter_numbers(chapters: DataFrame, novel_id: str) -> DataFrame:
    """Numbers only: no block is read."""
    return chapters.filter(F.col("novel_id") == novel_id).select("number").orderBy("number")


def chapter_count(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("novel_id").agg(F.count("*").alias("n_chapters"))


def spans_of(spans: DataFrame, novel_id: str, number: float | None = None) -> DataFrame:
    """Spans of a novel, or of one chapter, in reading order."""
    own = spans.filter(F.col("novel_id") == novel_id)
    own = own if number is None else own.filter(F.col("chapter") == number)
    return own.orderBy("chapter", "block_index", "start")


def segments_overlapping(segments: DataFrame, novel_id: str, number: float) -> DataFrame:
    """Segments that touch a chapter, by where they begin."""
    return segments.filter((F.col("novel_id") == novel_id) & (F.col("chapter_from") <= number) & (F.col("chapter_to") >= number)).orderBy("chapter_from", "offset_from")


def entities(selves: DataFrame, novel_id: str | None = None, id_: str | None = None) -> DataFrame:
    """Entities of a novel or by id; one without a kind is a SELF."""
    own = selves if novel_id is None else selves.filter(F.col("novel_id") == novel_id)
    own = own if id_ is None else own.filter(F.col("id") == id_)
    return own.withColumn("kind", F.coalesce("kind", F.lit("SELF")))


def persona(personas: DataFrame, id_: str) -> DataFrame:
    return personas.filter(F.col("id") == id_)


def bindings_of(bindings: DataFrame, self_id: str | None = None, persona_id: str | None = None) -> DataFrame:
    """Bindings of a self, of a persona, or of both together."""
    for column, value in (("self_id", self_id), ("persona_id", persona_id)):
        if value is not None:
            bindings = bindings.filter(F.col(column) == value)
    return bindings.orderBy("from_lb", "seq")


def aliases_of(aliases: DataFrame, kind: str | None = None, target_id: str | None = None) -> DataFrame:
    """Aliases of one target, or all, in the order written."""
    if target_id is not None:
        aliases = aliases.filter((F.col("target_kind") == kind) & (F.col("target_id") == target_id))
    return aliases.orderBy("seq")


def attributes_of(attributes: DataFrame, kind: str, target_id: str, key: str | None = None) -> DataFrame:
    own = attributes.filter((F.col("target_kind") == kind) & (F.col("target_id") == target_id))
    return (own if key is None else own.filter(F.col("key") == key)).orderBy("seq")


def relations_with(relations: DataFrame, id_: str, type_: str | None = None, either: bool = False) -> DataFrame:
    """Relations from an entity, or from or to it, of one type if named."""
    hit = F.col("src_self") == id_
    own = relations.filter(hit | (F.col("dst_self") == id_) if either else hit)
    return (own if type_ is None else own.filter(F.col("type") == type_)).orderBy("seq")


def mentions_in_order(mentions: DataFrame, novel_id: str, number: float | None = None) -> DataFrame:
    own = mentions.filter(F.col("novel_id") == novel_id)
    own = own if number is None else own.filter(F.col("chapter") == number)
    return own.orderBy("chapter", "block_index", "offset")


def mention_counts(mentions: DataFrame) -> DataFrame:
    return mentions.filter("target_id is not null").groupBy("novel_id", "target_id").agg(F.count("*").alias("n_mentions"))


def chapters_of(mentions: DataFrame, spans: DataFrame) -> DataFrame:
    """(target_id, chapter) where an entity is mentioned or speaks."""
    said = spans.filter("speaker_self_id is not null").select(F.col("speaker_self_id").alias("target_id"), "chapter")
    return mentions.filter("target_id is not null").select("target_id", "chapter").unionByName(said).distinct()


def body_presence(mentions: DataFrame) -> DataFrame:
    """(target_id, chapter, block_index) where an entity is physically present, once each."""
    return mentions.filter("reference_mode = 'PRESENT' and target_id is not null").select("target_id", "chapter", "block_index").distinct()


def speaker_keys(spans: DataFrame, selves: DataFrame) -> DataFrame:
    """(speaker_self_id, key) of everyone who speaks and whose label has a comparison key."""
    said = spans.filter("speaker_self_id is not null").select("speaker_self_id").distinct()
    label = selves.select(F.col("id").alias("speaker_self_id"), names.comparison_key(F.col("canonical_label")).alias("key"))
    return said.join(label, "speaker_self_id").filter("key <> ''")


def surfaces_of(aliases: DataFrame, mentions: DataFrame, shortest: int = 3) -> DataFrame:
    """(target_id, surface): aliases and mentioned forms of an entity, titles and generic ones left out."""
    a = aliases.filter("alias_type not in ('GENERIC_DESCRIPTOR', 'RELATIONAL_DEICTIC')").select("target_id", F.col("alias").alias("surface"))
    m = mentions.filter("target_id is not null and alias_type not in ('GENERIC_DESCRIPTOR', 'RELATIONAL_DEICTIC')").select("target_id", F.col("text").alias("surface"))
    return a.unionByName(m).filter(F.length("surface") >= shortest).distinct()


# -- predicates ----------------------------------------------------------------------------------

#: Fixed values of the closed vocabularies.
TITLES = ("TRANSFERABLE_TITLE", "PATHWAY_TITLE", "TAROT_TITLE")
VISUAL = ("DIALOGUE", "NARRATION_ACTION", "NARRATION_DESCRIPTION")
MODES = {"DIALOGUE": "DIALOGUE_REFERENCE", "NARRATION_ACTION": "PRESENT", "NARRATION_DESCRIPTION": "PRESENT", "INNER_MONOLOGUE": "INNER_THOUGHT_REFERENCE", "NARRATION_EXPOSITION": "NARRATOR_REFERENCE"}


def is_possible(certainty: Column) -> Column:
    return certainty != "EXCLUDED"


def enters_graph(alias_type: Column) -> Column:
    return alias_type != "GENERIC_DESCRIPTOR"


def is_transferable(alias_type: Column) -> Column:
    return alias_type.isin(*TITLES)


def is_speaker_relative(alias_type: Column) -> Column:
    return alias_type == "RELATIONAL_DEICTIC"


def is_spoken(span_type: Column) -> Column:
    return span_type == "DIALOGUE"


def is_visual(span_type: Column) -> Column:
    return span_type.isin(*VISUAL)


def is_present(mode: Column) -> Column:
    return mode == "PRESENT"


def is_standing(retracted: Column) -> Column:
    return retracted.isNull()


def graph_dependent(tier: Column) -> Column:
    """Whether graph events invalidate an artifact of this tier."""
    return tier != "TEXT"


def reference_mode(span_type: Column) -> Column:
    """How a mention in a span of this kind refers; NARRATOR_REFERENCE for all others."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv]), span_type), F.lit("NARRATOR_REFERENCE"))


# -- writes --------------------------------------------------------------------------------------


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in place of those that have the same keys (null keys are equal); of several new ones of a key any is as good as the other, so there must be one."""
    same = [table[k].eqNullSafe(rows[k]) for k in keys]
    return table.join(rows, same, "left_anti").unionByName(rows.select(*table.columns))


#: Columns by which an attribute is the same one.
SAME_ATTRIBUTE = ("target_kind", "target_id", "timeline_id", "key", "value", "learned", "observer_id", "truth_status")


def new_attributes(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that the table lacks, each once: equality over SAME_ATTRIBUTE, nulls included."""
    rows = rows.dropDuplicates(list(SAME_ATTRIBUTE))
    return rows.join(table, [rows[c].eqNullSafe(table[c]) for c in SAME_ATTRIBUTE], "left_anti")


def insertable_aliases(rows: DataFrame) -> DataFrame:
    """Alias bindings that may be written: no generic descriptors, bounds in order."""
    return rows.filter(enters_graph(F.col("alias_type")) & (F.col("from_lb") <= F.col("from_ub")) & (F.col("to_lb") <= F.col("to_ub")) & (F.col("to_ub") >= F.col("from_lb")))


def closed(bindings: DataFrame, which: Column, end_lb: float, end_ub: float) -> DataFrame:
    """Bindings with the end of those that hold set: they stopped being true."""
    return bindings.withColumns({"to_lb": F.when(which, F.lit(float(end_lb))).otherwise(F.col("to_lb")), "to_ub": F.when(which, F.lit(float(end_ub))).otherwise(F.col("to_ub"))})


def retracted(bindings: DataFrame, which: Column, at: Column) -> DataFrame:
    """Bindings with those that hold retracted: they never were true. Their interval stays; one already retracted keeps its position."""
    hit = which & F.col("retracted").isNull()
    return bindings.withColumns({"retracted": F.when(hit, at).otherwise(F.col("retracted")), "truth_status": F.when(hit, "FALSE").otherwise(F.col("truth_status"))})


def voided(segments: DataFrame, ids: list[str]) -> DataFrame:
    return segments.withColumn("canonicity", F.when(F.col("id").isin(*ids), "VOIDED").otherwise(F.col("canonicity")))


def without_bindings(bindings: DataFrame, self_id: str) -> DataFrame:
    return bindings.filter(~F.col("self_id").eqNullSafe(F.lit(self_id)))


def without_span(spans: DataFrame, span_id: str) -> DataFrame:
    return spans.filter(~F.col("id").eqNullSafe(F.lit(span_id)))


def prominence(n: Column, principal: int = 300, recurring: int = 30) -> Column:
    return F.when(n >= principal, "PRINCIPAL").when(n >= recurring, "RECURRING").otherwise("INCIDENTAL")


def with_prominence(selves: DataFrame, counts: DataFrame) -> DataFrame:
    """selves with the tier of their mention counts (target_id, n_mentions)."""
    n = F.coalesce("n_mentions", F.lit(0))
    return selves.drop("prominence").join(counts.select(F.col("target_id").alias("id"), "n_mentions"), "id", "left").withColumn("prominence", prominence(n)).drop("n_mentions")
