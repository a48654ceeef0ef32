"""Who pronouns and kinship words denote: genders, backward as-of joins, groups of mentions and the checks that split them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulon.functions import rules
from fabulon.functions.text import find_all

#: How far back an antecedent may be, and the least confidence of a link that is kept.
REACH, LEAST = 600, 0.6
ANTECEDENTS = ("RIGID_NAME", "EPITHET", "RELATIONAL_DEICTIC")


def pronouns(text: Column, base: Column | None = None) -> Column:
    """array of (text, start, gender, number) of third-person pronouns."""
    words = sorted((p for p, *_ in rules.PRONOUNS), key=len, reverse=True)
    kind = F.create_map(*[x for p, g, n in rules.PRONOUNS for x in (F.lit(p), F.struct(F.lit(g).alias("gender"), F.lit(n).alias("number")))])
    at = F.lit(0) if base is None else base
    return F.transform(find_all(text, rf"(?i)\b(?:{'|'.join(words)})\b"), lambda m: F.struct(m["text"].alias("text"), (m["start"] + at).alias("start"), F.element_at(kind, F.lower(m["text"]))["gender"].alias("gender"), F.element_at(kind, F.lower(m["text"]))["number"].alias("number")))


def kinship_terms(text: Column, base: Column | None = None) -> Column:
    """array of (text, start) of bare kinship words."""
    at = F.lit(0) if base is None else base
    return F.transform(find_all(text, rf"(?i)\b(?:{'|'.join(rules.KINSHIP)})\b"), lambda m: F.struct(m["text"].alias("text"), (m["start"] + at).alias("start")))


def gender(male: Column, female: Column) -> Column:
    """m or f where its cues are two at least and more than twice the other's; else n."""
    return F.when((male > 2 * female) & (male >= 2), "m").when((female > 2 * male) & (female >= 2), "f").otherwise("n")


def genders(contexts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, gender from the cues around."""
    cues = contexts.groupBy(*by).agg(F.sum(F.regexp_count(F.col(text), F.lit("(?i)" + rules.MALE_CUES))).alias("_m"), F.sum(F.regexp_count(F.col(text), F.lit("(?i)" + rules.FEMALE_CUES))).alias("_f"))
    return cues.select(*by, gender(F.col("_m"), F.col("_f")).alias("gender"))


def antecedents(said: DataFrame, mentions: DataFrame, by: list[str], reach: int = REACH) -> DataFrame:
    """by, start, mention_id, name, confidence, rule for each pronoun (by, start, gender) that has an agreeing mention (by, id, offset, text, alias_type, gender) up to `reach` before it.

    Pronouns and mentions run through one window of each scope; the last mention of each gender is carried along (of
    several at one place that with the greatest id), so that no pairs are made. A scope with a null has no pairs. The nearest that agrees is taken: 0.85 if both genders are known, else 0.6; a fifth
    less beyond half the reach, 0.1 more if no other mention agrees.
    """
    m = mentions.filter(F.col("alias_type").isin(*ANTECEDENTS)).withColumn("gender", F.coalesce("gender", F.lit("n")))
    own = F.struct(F.col("offset").alias("at"), F.col("id").alias("id"), F.col("text").alias("name"), F.col("gender").alias("gender"))
    both = m.select(*by, F.col("offset").alias("_at"), own.alias("_own"), F.lit(None).cast("string").alias("_g")).unionByName(said.select(*by, F.col("start").alias("_at"), F.lit(None).alias("_own"), F.col("gender").alias("_g")), allowMissingColumns=True).dropna(subset=by)
    order = Window.partitionBy(*by).orderBy("_at")
    before, near = order.rangeBetween(Window.unboundedPreceding, -1), order.rangeBetween(-reach, -1)
    for g in "mfn":
        mine = F.col("_own.gender") == g
        both = both.withColumn(f"_{g}", F.max(F.when(mine, F.col("_own"))).over(before)).withColumn(f"_c{g}", F.count(F.when(mine, 1)).over(near))
    agrees = {g: F.lit(True) if g == "n" else (F.col("_g") == g) | (F.col("_g") == "n") for g in "mfn"}
    within = {g: F.when(agrees[g] & (F.col("_at") - F.col(f"_{g}.at") <= reach), F.col(f"_{g}")) for g in "mfn"}
    best = F.greatest(*[F.when(within[g].isNotNull(), F.struct(F.col(f"_{g}.at").alias("at"), F.col(f"_{g}").alias("m"))) for g in "mfn"])
    count = sum((F.when(agrees[g], F.col(f"_c{g}")).otherwise(0) for g in "mfn"), F.lit(0))
    found = both.filter("_g is not null").select(*by, F.col("_at").alias("start"), F.col("_g"), best.alias("_b"), count.alias("_n")).filter("_b is not null")
    base = F.when((F.col("_b.m.gender") != "n") & (F.col("_g") != "n"), 0.85).otherwise(0.6)
    base = F.when(F.col("start") - F.col("_b.at") > reach / 2, base * 0.8).otherwise(base)
    return found.select(
        *by, "start", F.col("_b.m.id").alias("mention_id"), F.col("_b.m.name").alias("name"),
        F.when(F.col("_n") == 1, F.least(F.lit(1.0), base + 0.1)).otherwise(base).alias("confidence"),
        F.when(F.col("_n") == 1, "unique_agreeing_antecedent").otherwise("nearest_agreeing_antecedent").alias("rule"),
    )


def kinship(terms: DataFrame, mentions: DataFrame, by: list[str], gap: int = 3) -> DataFrame:
    """Each kinship word (by, block_index, start, end, text) with whom it denotes: mention_id, confidence, rule.

    A rigid name that begins with the word (0.9, kinship_fused), else one right after it in its block (0.85,
    kinship_apposed_name), else whom the same word last denoted in its scope (0.55, kinship_sticky_binding).
    Mentions: by, block_index, offset, id, text, alias_type.
    """
    rigid = mentions.filter("alias_type = 'RIGID_NAME'").select(*by, "block_index", F.col("offset").alias("_o"), F.col("id").alias("_id"))
    t = terms.withColumn("_n", F.monotonically_increasing_id())
    hit = t.join(rigid, [*by, "block_index"]).filter((F.col("_o") == F.col("start")) | (F.col("_o") - F.col("end")).between(0, gap))
    best = hit.groupBy("_n").agg(F.min(F.struct(F.when(F.col("_o") == F.col("start"), 0).otherwise(1).alias("rule"), "_o", "_id")).alias("_b"))
    own = terms.columns
    joined = t.join(best, "_n", "left")
    order = Window.partitionBy(*by, F.lower("text")).orderBy("block_index", "start").rowsBetween(Window.unboundedPreceding, -1)
    sticky = F.last("_b._id", ignorenulls=True).over(order)
    out = joined.withColumn("_s", sticky)
    pick = lambda a, b, c: F.when(F.col("_b.rule") == 0, a).when(F.col("_b.rule") == 1, b).when(F.col("_s").isNotNull(), c)
    return out.select(*own, F.coalesce("_b._id", "_s").alias("mention_id"), pick(F.lit(0.9), F.lit(0.85), F.lit(0.55)).alias("confidence"), pick(F.lit("kinship_fused"), F.lit("kinship_apposed_name"), F.lit("kinship_sticky_binding")).alias("rule")).filter("mention_id is not null")


def groups(mentions: DataFrame, by: list[str]) -> DataFrame:
    """Rigid names of one spelling in a chapter are one group: by, label, mention_ids, n."""
    rigid = mentions.filter("alias_type = 'RIGID_NAME'")
    return rigid.groupBy(*by, F.col("text").alias("label")).agg(F.sort_array(F.collect_list("id")).alias("mention_ids"), F.count("*").alias("n"))


def timeline_of(mentions: DataFrame, segments: DataFrame, main: str = "main") -> DataFrame:
    """mentions with the timeline of the first segment (by its start) that holds their block; main where none does."""
    s = segments.select("novel_id", F.struct("chapter_from", "offset_from").alias("_lo"), F.struct("chapter_to", "offset_to").alias("_hi"), F.col("timeline_id").alias("_t"))
    place = F.struct(F.col("chapter").cast("double").alias("chapter_from"), F.col("block_index").alias("offset_from"))
    # Segments of a novel are few beside its mentions, but nothing is broadcast: the join is by novel and chapter span.
    spread = s.withColumn("_c", F.explode(F.sequence(F.floor("_lo.chapter_from").cast("long"), F.floor("_hi.chapter_to").cast("long"))))
    m = mentions.withColumn("_c", F.floor("chapter").cast("long")).withColumn("_p", place)
    hit = m.join(spread, ["novel_id", "_c"]).filter((F.col("_lo") <= F.col("_p")) & (F.col("_p") <= F.struct(F.col("_hi.chapter_to").alias("chapter_from"), F.col("_hi.offset_to").alias("offset_from"))))
    best = hit.groupBy("id").agg(F.min_by("_t", "_lo").alias("_t"))
    return mentions.join(best, "id", "left").withColumn("timeline_id", F.coalesce("_t", F.lit(main))).drop("_t")


def validated(mentions: DataFrame, by: list[str], concurrent: DataFrame | None = None, window: int = 200) -> DataFrame:
    """Groups of mentions (by, group_id, id, chapter, offset, text, reference_mode, timeline_id) after the checks: by, group_id, part, label, mention_ids, confidence, violation.

    A group is split by timeline first. A part in which two present mentions of different spelling stand within `window`
    characters of each other in one chapter is split by spelling, with a tenth less confidence, unless its group
    (group_id) is in `concurrent`, whose bodies may meet.
    """
    key = [*by, "group_id"]
    order = Window.partitionBy(*key, "timeline_id", "chapter", F.col("reference_mode") == "PRESENT").orderBy("offset", "id")
    clash = (F.col("reference_mode") == "PRESENT") & (F.lag("text").over(order) != F.col("text")) & (F.col("offset") - F.lag("offset").over(order) <= window)
    m = mentions.withColumn("_clash", F.coalesce(clash, F.lit(False)))
    if concurrent is not None:
        m = m.join(concurrent.select("group_id", F.lit(True).alias("_ok")).distinct(), "group_id", "left").withColumn("_clash", F.col("_clash") & F.col("_ok").isNull())
    m = m.withColumn("_split", F.max("_clash").over(Window.partitionBy(*key, "timeline_id"))).withColumn("_times", F.size(F.collect_set("timeline_id").over(Window.partitionBy(*key))))
    out = m.groupBy(*key, "timeline_id", "_split", "_times", F.when(F.col("_split"), F.col("text")).alias("_text")).agg(F.sort_array(F.collect_list("id")).alias("mention_ids"), F.max(F.struct(F.length("text").alias("n"), F.col("text").alias("t")))["t"].alias("_long"))
    part = F.concat_ws("~", "timeline_id", "_text")
    return out.select(*key, part.alias("part"), F.coalesce("_text", "_long").alias("label"), "mention_ids", F.when(F.col("_split"), 0.9).otherwise(1.0).alias("confidence"), F.when(F.col("_split"), "CO_PRESENCE").when(F.col("_times") > 1, "LAYER_BOUNDARY").alias("violation"))


def too_many_groups(groups_: DataFrame, mentions: DataFrame, by: list[str], ratio: float = 2.5) -> DataFrame:
    """Scopes with more than `ratio` times as many groups as different rigid names: by, n_groups, n_names."""
    g = groups_.groupBy(*by).agg(F.count("*").alias("n_groups"))
    n = mentions.filter("alias_type = 'RIGID_NAME'").groupBy(*by).agg(F.countDistinct("text").alias("n_names"))
    return g.join(n, by).filter((F.col("n_names") > 0) & (F.col("n_groups") > ratio * F.col("n_names")))


def present_cast(mentions: DataFrame, by: list[str], persons: DataFrame | None = None) -> DataFrame:
    """by, cast: spellings of those present, of persons (id) only if they are given."""
    here = mentions.filter("reference_mode = 'PRESENT'")
    if persons is not None:
        here = here.join(persons.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return here.groupBy(*by).agg(F.array_sort(F.collect_set("text")).alias("cast"))


def informative_label(text: Column, alias_type: Column, order: Column) -> Column:
    """Aggregate: the longest rigid name, of equally long ones the first; without one the first mention's text."""
    rigid = alias_type == "RIGID_NAME"
    return F.coalesce(F.max_by(F.when(rigid, text), F.when(rigid, F.struct(F.length(text), -order))), F.min_by(text, order))


# -- five routes ---------------------------------------------------------------------------------

#: Route to the attribution that it implies.
METHODS = {
    "ATTRIBUTION_ADJACENCY": "PROXIMAL", "RELATIONSHIP_GRAPH": "EXPLICIT", "POV_FIRST_PERSON": "POV_INFERRED", "UNATTRIBUTED_CHORUS": "UNATTRIBUTED_CHORUS",
    "NEAREST_ANTECEDENT": "PROXIMAL", "LLM_PARAGRAPH": "CONTEXTUAL_LLM", "UNRESOLVED": "UNRESOLVED",
}
#: A pronoun behind a named speech tag, first person, roles that speak.
_AFTER_TAG = rf"\b{rules.NAME}\s+(?:{rules.TAG_VERBS})\b[^.!?]{{0,120}}?[.!?]\s*(?:He|She|They)\b"
FIRST_PERSON = r"\b(?:I|me|my|mine|myself)\b"
ROLES = "Senior|Junior|Elder|Master|Senior Brother|Junior Brother|Senior Sister|Junior Sister|Martial Uncle|Father|Mother|Teacher|Sunbae|Hyung"
_ROLE_SAYS = rf"\b(?:{ROLES})\b\s+(?:{rules.TAG_VERBS})\b"


def method_of(route: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv]), route)


def adjacent(text: Column, base: Column) -> Column:
    """array of (start, referent): pronouns right behind a speech tag that names the speaker."""
    return F.transform(find_all(text, _AFTER_TAG), lambda m: F.struct((m["end"] - F.length(F.regexp_extract(m["text"], r"(\w+)$", 1)) + base).alias("start"), F.regexp_extract(m["text"], rf"^({rules.NAME})\s+(?:{rules.TAG_VERBS})\b", 1).alias("referent")))


def routed(spans: DataFrame, found: DataFrame, relations: DataFrame | None = None, pov: Column | None = None, speaker: str = "speaker") -> DataFrame:
    """Pronouns of spans (id, span_type, start, text and the speaker's column) by the cheapest route that answers: id, at, referent, route, confidence.

    A crowd's line is a chorus and nothing else. First person in thought is the POV holder's; a pronoun behind a
    named speech tag is the speaker's; a role that speaks is whoever bears it to the speaker (relations: speaker, role,
    referent). Every other pronoun takes its antecedent (found: id, start, name, confidence).
    """
    kind = lambda r, c: [F.lit(r).alias("route"), F.lit(c).alias("confidence")]
    open_ = spans.filter("span_type <> 'CROWD_REACTION'")
    chorus = spans.filter("span_type = 'CROWD_REACTION'").select("id", F.col("start").alias("at"), F.lit(None).cast("string").alias("referent"), *kind("UNATTRIBUTED_CHORUS", 1.0))
    parts = [open_.select("id", F.explode(adjacent(F.col("text"), F.col("start"))).alias("a")).select("id", F.col("a.start").alias("at"), "a.referent", *kind("ATTRIBUTION_ADJACENCY", 0.9))]
    if pov is not None:
        inner = open_.filter("span_type = 'INNER_MONOLOGUE'").filter(pov.isNotNull())
        parts.append(inner.select("id", F.explode(find_all(F.col("text"), FIRST_PERSON)).alias("a"), F.col("start").alias("_b"), pov.alias("referent")).select("id", (F.col("a.start") + F.col("_b")).alias("at"), "referent", *kind("POV_FIRST_PERSON", 0.85)))
    if relations is not None:
        roles = open_.filter(F.col(speaker).isNotNull()).select("id", F.col(speaker).alias("speaker"), "start", F.explode(find_all(F.col("text"), "(?i)" + _ROLE_SAYS)).alias("a"))
        roles = roles.withColumn("role", F.lower(F.regexp_extract("a.text", rf"(?i)^({ROLES})\s+(?:{rules.TAG_VERBS})\b", 1)))
        parts.append(roles.join(relations, ["speaker", "role"]).select("id", (F.col("a.start") + F.col("start")).alias("at"), "referent", *kind("RELATIONSHIP_GRAPH", 0.8)))
    first = parts[0]
    for p in parts[1:]:
        first = first.unionByName(p)
    rest = found.join(open_.select("id"), "id", "left_semi").select("id", F.col("start").alias("at"), F.col("name").alias("referent"), F.lit("NEAREST_ANTECEDENT").alias("route"), "confidence")
    rest = rest.join(first.select("id", "at"), ["id", "at"], "left_anti")
    return chorus.unionByName(first).unionByName(rest)


def needs_model(text: Column, resolved: Column) -> Column:
    """Whether a pronoun speaks in a text at none of the places resolved: only such ones are worth a call."""
    verbs = find_all(text, rf"(?i)\b(?:he|she|they)\s+(?:\w+\s+){{0,2}}?(?:{rules.TAG_VERBS})\b")
    return F.exists(verbs, lambda m: ~F.array_contains(resolved, m["start"]))


def by_model(paragraphs: DataFrame, answers: Callable[[DataFrame], DataFrame], by: list[str]) -> DataFrame:
    """Pronouns of paragraphs (by, text, cast) as a model resolves them.

    answers: a function from paragraphs to rows (by, pronoun, occurrence, referent); an answer counts if it names one of the
    cast and the pronoun occurs so often.
    """
    places = paragraphs.select(*by, "cast", F.explode(pronouns(F.col("text"))).alias("p")).select(*by, "cast", F.lower("p.text").alias("pronoun"), F.col("p.start").alias("at"))
    nth = places.withColumn("occurrence", F.row_number().over(Window.partitionBy(*by, "pronoun").orderBy("at")))
    said = answers(paragraphs).withColumn("pronoun", F.lower("pronoun"))
    return nth.join(said, [*by, "pronoun", "occurrence"]).filter(F.array_contains("cast", F.col("referent"))).select(*by, "at", "referent", F.lit("LLM_PARAGRAPH").alias("route"))
