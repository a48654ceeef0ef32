"""The state of entities as observers know it: bulk as-of folds over fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabulon.functions import intervals as iv
from fabulon.functions.visibility import in_scope, visible
from fabulon.schema import SYSTEM, fact_ref

_INTERVAL = ("from_lb", "from_ub", "to_lb", "to_ub")
_FACT = ("timeline_id", *_INTERVAL, "learned", "observer_id", "truth_status", "retracted", "seq")


def applicable(requests: DataFrame, facts: DataFrame, timeline: str = "main", include_plausible: bool = True, voided: DataFrame | None = None) -> DataFrame:
    """Each request with each fact of its target that it may see, and the fact's certainty at its position.

    An equi-join on the target, so it scales with the facts; the rest is a residual of the join.
    voided: timelines (timeline_id) whose facts count nowhere.
    """
    if voided is not None:
        facts = facts.join(voided.select("timeline_id").distinct(), "timeline_id", "left_anti")
    joined = requests.join(facts.filter(F.col("timeline_id") == timeline), "target_id")
    joined = joined.filter(visible(F.col("observer_id"), F.col("learned"), F.col("truth_status"), F.col("retracted"), F.col("observer"), F.col("known")))
    joined = joined.withColumn("certainty", iv.contains(iv.columns(), F.col("position")))
    return joined.filter(F.col("certainty") != iv.EXCLUDED if include_plausible else F.col("certainty") == iv.CERTAIN)


def voided_timelines(segments: DataFrame) -> DataFrame:
    """timeline_id of every timeline that has a voided segment: one voids its whole timeline."""
    return segments.filter("canonicity = 'VOIDED'").select("timeline_id").distinct()


def latest(value: Column, learned: Column, seq: Column) -> Column:
    """The value learned last; of several learned together the later row's."""
    return F.max_by(value, F.struct(learned, seq))


def state_of(requests: DataFrame, aliases: DataFrame, attributes: DataFrame, relations: DataFrame | None = None, personas: DataFrame | None = None, novel_id: str = "", **how) -> DataFrame:
    """One row for each request: target_id, position, observer, aliases, attributes, relationships, persona_ids, certainty, read_set.

    Fact tables share target_id and the columns of a fact; besides these aliases have alias and
    alias_norm, attributes key and value, relations type and dst_self, personas persona_id. All kinds
    of facts go through one join with the requests. Aliases are distinct by normal form, the first
    written kept; of an attribute the value learned last stands; relations and personas are listed in
    the order in which they were written. A persona's binding must be learned, but neither its truth
    nor its retraction is asked. The certainty is the weakest of all facts that count, CERTAIN without
    any. read_set names what was looked at: the target, aliases, and the other ends of relations and bindings.
    """
    none = F.lit(None).cast("string")

    def part(kind: str, facts: DataFrame, name: Column, value: Column, ref: Column) -> DataFrame:
        return facts.select("target_id", *_FACT, F.lit(kind).alias("part"), name.alias("name"), value.alias("value"), ref.alias("ref"))

    parts = [
        part("alias", aliases, F.col("alias_norm"), F.col("alias"), fact_ref("alias", F.lit(novel_id), F.col("alias_norm"))),
        part("attribute", attributes, F.col("key"), F.col("value").cast("string"), none),
    ]
    if relations is not None:
        parts.append(part("relation", relations, F.col("type"), F.col("dst_self").cast("string"), fact_ref("self", F.col("dst_self"))))
    if personas is not None:
        open_ = personas.withColumn("truth_status", F.lit("TRUE")).withColumn("retracted", F.lit(None).cast(personas.schema["retracted"].dataType))
        parts.append(part("persona", open_, F.col("persona_id").cast("string"), none, fact_ref("persona", F.col("persona_id"))))
    facts = reduce(DataFrame.unionByName, parts)
    seen = applicable(requests, facts, **how)
    ask = ["target_id", "position", "observer"]
    # Aliases and attributes fold by name; of the others each row counts, so that the second fold has few rows.
    each = F.when(F.col("part").isin("relation", "persona"), F.col("seq")).otherwise(F.lit(-1))
    folded = seen.groupBy(*ask, "part", "name", each.alias("_each")).agg(
        F.min("seq").alias("seq"), F.min_by("value", "seq").alias("first"), latest(F.col("value"), F.col("learned"), F.col("seq")).alias("last"),
        F.min(iv.rank(F.col("certainty"))).alias("rank"), F.min("ref").alias("ref"),
    )
    rows = lambda kind, what: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == kind, F.struct("seq", what.alias("x"))))), lambda r: r["x"])
    pairs = F.collect_list(F.when(F.col("part") == "attribute", F.struct("name", "last")))
    out = folded.groupBy(*ask).agg(
        rows("alias", F.col("first")).alias("aliases"), F.map_from_entries(pairs).alias("attributes"),
        rows("relation", F.struct(F.col("name").alias("type"), F.col("first").alias("dst_self"))).alias("relationships"), rows("persona", F.col("name")).alias("persona_ids"),
        F.min("rank").alias("_rank"), F.collect_set("ref").alias("_refs"),
    )
    full = requests.select(*ask).distinct().join(out, ask, "left")
    empty = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("aliases", "relationships", "persona_ids", "_refs")}
    return full.select(
        *ask, empty["aliases"].alias("aliases"), F.coalesce("attributes", F.create_map().cast(out.schema["attributes"].dataType)).alias("attributes"),
        empty["relationships"].alias("relationships"), empty["persona_ids"].alias("persona_ids"), iv.named(F.coalesce("_rank", F.lit(2))).alias("certainty"),
        F.array_sort(F.array_distinct(F.concat(F.array(fact_ref("self", F.col("target_id"))), empty["_refs"]))).alias("read_set"),
    )


def state_of_attributes(requests: DataFrame, facts: DataFrame, **how) -> DataFrame:
    """One row for each request and key: the latest value, its certainty, and how many facts spoke."""
    seen = applicable(requests, facts, **how)
    return seen.groupBy("target_id", "position", "observer", "key").agg(
        latest(F.col("value"), F.col("learned"), F.col("seq")).alias("value"),
        latest(F.col("certainty"), F.col("learned"), F.col("seq")).alias("certainty"),
        F.count("*").alias("n_facts"),
    )


def state_certainty(requests: DataFrame, facts: DataFrame, **how) -> DataFrame:
    """The weakest certainty over all facts of each request; CERTAIN where none speaks."""
    seen = applicable(requests, facts, **how)
    ask = ["target_id", "position", "observer"]
    folded = seen.groupBy(*ask).agg(F.min(iv.rank(F.col("certainty"))).alias("_r"), F.count("*").alias("_n"))
    return requests.select(*ask).distinct().join(folded, ask, "left").select(*ask, iv.named(F.coalesce("_r", F.lit(2))).alias("certainty"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_facts"))


def state_aliases(requests: DataFrame, facts: DataFrame, **how) -> DataFrame:
    """Distinct aliases of each request by normal form, the first written kept."""
    seen = applicable(requests, facts, **how)
    return seen.groupBy("target_id", "position", "observer", "alias_norm").agg(F.min_by("alias", "seq").alias("alias"), F.min("seq").alias("first_seq"))


def relations_of(requests: DataFrame, relations: DataFrame, **how) -> DataFrame:
    """Relations that each request may see: target_id, position, observer, type, dst_self, certainty."""
    return applicable(requests, relations, **how).select("target_id", "position", "observer", "type", "dst_self", "certainty", "seq")


def resolve_alias(requests: DataFrame, aliases: DataFrame, timeline: str = "main") -> DataFrame:
    """Holders of each surface at a position: (alias_norm, position, observer, target_id, certainty)."""
    seen = applicable(requests.withColumnRenamed("alias_norm", "target_id"), aliases.withColumnRenamed("target_id", "holder").withColumnRenamed("alias_norm", "target_id"), timeline)
    return seen.groupBy(F.col("target_id").alias("alias_norm"), "position", "observer", F.col("holder").alias("target_id")).agg(iv.named(F.max(iv.rank(F.col("certainty")))).alias("certainty"))


def persona_at(requests: DataFrame, bindings: DataFrame, default: str = "body1") -> DataFrame:
    """The body in force for each request: of certain bindings the latest start, else of plausible ones, else the earliest, else the default."""
    b = bindings.withColumnRenamed("target_id", "_t")
    joined = requests.join(b, requests["target_id"] == b["_t"], "left").withColumn("_r", iv.rank(iv.contains(iv.columns(), F.col("position"))))
    best = F.max_by("persona_id", F.when(F.col("_t").isNotNull(), F.struct("_r", F.when(F.col("_r") > 0, F.col("from_lb")).otherwise(-F.col("from_lb")), "seq")))
    return joined.groupBy("target_id", "position").agg(F.coalesce(best, F.lit(default)).alias("persona_id"))


def concurrent_personas(requests: DataFrame, bindings: DataFrame, timeline: str | None = None) -> DataFrame:
    """All bodies that may be in force for each request (in one timeline, if named)."""
    if timeline is not None:
        bindings = bindings.filter(F.col("timeline_id") == timeline)
    joined = requests.join(bindings, "target_id").filter(iv.contains(iv.columns(), F.col("position")) != iv.EXCLUDED)
    return joined.groupBy("target_id", "position").agg(F.array_join(F.array_sort(F.collect_set("persona_id")), ",").alias("personas"), F.countDistinct("persona_id").alias("n_personas"))


def visible_personas(requests: DataFrame, bindings: DataFrame, timeline: str = "main", include_plausible: bool = True) -> DataFrame:
    """Bindings that each request may see: of its timeline, of its observer's scope, learned by then, in force at its position."""
    joined = requests.join(bindings.filter(F.col("timeline_id") == timeline), "target_id")
    joined = joined.filter(in_scope(F.col("observer_id"), F.col("observer")) & ((F.col("observer") == SYSTEM) | (F.col("learned") <= F.col("known"))))
    joined = joined.withColumn("certainty", iv.contains(iv.columns(), F.col("position")))
    return joined.filter(F.col("certainty") != iv.EXCLUDED if include_plausible else F.col("certainty") == iv.CERTAIN)


def known_by_default(position: Column, timeline: Column, last: int = 10**6) -> Column:
    """The chapter up to which an observer knows the text where the question does not say: the position's on the main timeline, all elsewhere and at infinity."""
    return F.when((timeline == "main") & (position < float("inf")), F.floor(position).cast("int")).otherwise(last)


def facts_as_of(facts: DataFrame, by: list[str], key: str, value: str, chapter: Column) -> DataFrame:
    """The latest value of each key among standing facts learned up to a chapter; ties go to the later row."""
    standing = facts.filter(F.col("retracted").isNull() & (F.col("learned") <= chapter))
    return standing.groupBy(*by, key).agg(latest(F.col(value), F.col("learned"), F.col("seq")).alias(value))


def chapters_by_body(chapters: DataFrame, bindings: DataFrame, default: str = "body1") -> DataFrame:
    """Chapters (target_id, chapter) grouped by the body in force half a chapter later: target_id, persona_id, chapters."""
    at = persona_at(chapters.select("target_id", (F.col("chapter") + 0.5).alias("position")).distinct(), bindings, default)
    return at.groupBy("target_id", "persona_id").agg(F.array_sort(F.collect_set(F.col("position") - 0.5)).alias("chapters"))
