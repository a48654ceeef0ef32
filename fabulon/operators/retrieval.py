"""Candidates for mentions: entity profiles, blended retrieval with its prominent tail, and the evidence for each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulon.functions import names
from fabulon.operators.resolve import bm25

#: Candidates of a mention, and how many times as many are looked at.
K, SHORTLIST = 10, 3
LEXICAL, CONTEXT = 0.65, 0.35
CONTAINMENT_FLOOR = 0.86
#: Words that are no terms.
STOP = (
    "the", "a", "an", "and", "or", "but", "if", "when", "while", "of", "to", "in", "on", "at", "by", "for", "with", "from", "as", "is", "was", "were",
    "are", "be", "been", "being", "he", "she", "it", "they", "them", "his", "her", "its", "their", "this", "that", "these", "those", "there", "here",
    "then", "now", "not", "no", "yes", "had", "has", "have", "do", "did", "does", "will", "would", "could", "should", "may", "might", "must", "one",
    "two", "said", "say", "says", "very", "much", "many", "more", "most",
)
#: Patterns that tell that one identity goes on under another name, and memories that tell nothing.
CONTINUITY = (
    r"\bmemor(?:y|ies)\b[^.!?]{0,60}?\b(?:flood|surg|surfac|return|rush|pour|emerg)",
    r"\bthis (?:the )?(?:present|current|new) (?:me|body|self)\b",
    r"\b(?:transmigrat|reincarnat)(?:ed|ing)\s+(?:into|as|in)\b",
    r"\b(?:took over|occupied|inhabit(?:ed|ing)|possess(?:ed|ing)) (?:the |this |another )?body\b",
)
OWNED = r"\b(?:his|her|their|my|our|your|its|own|childhood|fond|painful|happy|distant|old|past|earlier|previous)\s+(?:\w+\s+)?memor(?:y|ies)\b"


def terms(text: Column) -> Column:
    """array of content words: split at white space, punctuation off, over two characters, no stop words; repeats stay."""
    edge = r"""[.,;:!?"'“”‘’()\[\]—–\-]+"""
    bare = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, f"^{edge}", ""), f"{edge}$", ""))
    return F.filter(bare, lambda w: (F.length(w) > 2) & ~w.isin(*STOP))


def surface_terms(surface: Column) -> Column:
    """Terms of a surface, of its bare form if that differs, and its comparison key."""
    bare, key = names.strip_honorifics(surface), names.comparison_key(surface)
    none = F.array().cast("array<string>")
    return F.concat(terms(surface), F.when(bare != surface, terms(bare)).otherwise(none), F.when(key != "", F.array(key)).otherwise(none))


def profiles(mentions: DataFrame) -> DataFrame:
    """target_id, label, n_mentions, first_chapter, last_chapter of confirmed mentions (target_id, text, chapter, context). The label is the first surface."""
    return mentions.groupBy("target_id").agg(F.min_by("text", F.struct("chapter", "text")).alias("label"), F.count("*").alias("n_mentions"), F.min("chapter").alias("first_chapter"), F.max("chapter").alias("last_chapter"))


def alias_postings(aliases: DataFrame) -> DataFrame:
    """(id, term, tf) of the entities' documents: the terms of every different alias (target_id, alias)."""
    return aliases.select("target_id", "alias").distinct().select(F.col("target_id").alias("id"), F.explode(surface_terms(F.col("alias"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def context_postings(mentions: DataFrame) -> DataFrame:
    """(id, term, tf) of the contexts in which entities were seen."""
    return mentions.select(F.col("target_id").alias("id"), F.explode(terms(F.col("context"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def cosine_of_counts(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query, id, cosine) for pairs, of the term counts (query, term, n) and (id, term, tf); 0 where none is common."""
    norm = lambda df, key, n: df.groupBy(key).agg(F.sqrt(F.sum(F.col(n) * F.col(n)).cast("double")).alias("_norm"))
    dot = pairs.join(left, "query").join(right, ["id", "term"]).groupBy("query", "id").agg(F.sum(F.col("n") * F.col("tf")).cast("double").alias("_dot"))
    out = dot.join(norm(left, "query", "n").withColumnRenamed("_norm", "_q"), "query").join(norm(right, "id", "tf").withColumnRenamed("_norm", "_i"), "id")
    return pairs.join(out.select("query", "id", (F.col("_dot") / (F.col("_q") * F.col("_i"))).alias("_c")), ["query", "id"], "left").select("query", "id", F.coalesce("_c", F.lit(0.0)).alias("cosine"))


def retrieve(queries: DataFrame, mentions: DataFrame, aliases: DataFrame, k: int = K) -> DataFrame:
    """query, id, score, rank: the k best candidates of each query (query, surface, context).

    The shortlist are the 3 k best by BM25 of the surface over the entities' aliases; where it has fewer, the 3 k entities with
    the most mentions join it. The score is 0.65 of the lexical score, as a part of the query's best, and 0.35 of the cosine of
    context counts; candidates without any score are none. Ties go by id.
    """
    asked = queries.select("query", F.explode(surface_terms(F.col("surface"))).alias("term"))
    posted = alias_postings(aliases)
    lexical = bm25(posted, asked).filter("score > 0")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    short = lexical.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= SHORTLIST * k).drop("_r")
    top = profiles(mentions).orderBy(F.col("n_mentions").desc(), "target_id").limit(SHORTLIST * k).select(F.col("target_id").alias("id"))  # as many rows as asked for
    few = queries.select("query").join(short.groupBy("query").agg(F.count("*").alias("_n")), "query", "left").filter(F.coalesce("_n", F.lit(0)) < SHORTLIST * k).select("query")
    tail = few.join(F.broadcast(top)).join(short.select("query", "id"), ["query", "id"], "left_anti").select("query", "id", F.lit(0.0).alias("score"))
    seen = short.select("query", "id", "score").unionByName(tail)
    counts = queries.select("query", F.explode(terms(F.col("context"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("n"))
    cosine = cosine_of_counts(counts, context_postings(mentions), seen.select("query", "id"))
    high = F.max("score").over(Window.partitionBy("query"))
    blended = seen.withColumn("_l", F.when(high > 0, F.col("score") / high).otherwise(0.0)).join(cosine, ["query", "id"])
    scored = blended.select("query", "id", (LEXICAL * F.col("_l") + CONTEXT * F.col("cosine")).alias("score")).filter("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "id"))).filter(F.col("rank") <= k)


def ambiguous_tokens(aliases: DataFrame) -> DataFrame:
    """token of every name component that aliases of two entities or more have."""
    t = aliases.select("target_id", F.explode(names.name_tokens(F.col("alias"))).alias("token")).distinct()
    return t.groupBy("token").agg(F.count("*").alias("_n")).filter("_n > 1").select("token")


#: What an entity is by the label that all its mentions share.
KINDS = {"location": "LOCATION", "organization": "ORGANIZATION", "item": "ITEM"}


def entity_kind(mentions: DataFrame, by: list[str], label: str = "entity_label") -> DataFrame:
    """by, kind: that of the one label all labelled mentions share, SELF if any is a character's, if they differ or there is none."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col(label))
    labels = mentions.withColumn("_k", F.when(F.coalesce(F.col(label), F.lit("")) != "", F.coalesce(kind, F.lit("SELF"))))
    return labels.groupBy(*by).agg(F.when(F.countDistinct("_k") == 1, F.min("_k")).otherwise("SELF").alias("kind"))


def not_characters(mentions: DataFrame, by: list[str], label: str = "entity_label") -> DataFrame:
    """Entities that a reviewer should look at: every labelled mention calls them a place or an organisation."""
    return mentions.filter(F.coalesce(F.col(label), F.lit("")) != "").groupBy(*by).agg(F.min(F.col(label).isin("location", "organization")).alias("_all"), F.count("*").alias("n")).filter("_all").drop("_all")


def declared(context: Column, phrases: tuple[str, ...]) -> Column:
    """1.0 where a phrase that declares an identity stands in the context, else 0.0."""
    low, hit = F.lower(F.coalesce(context, F.lit(""))), F.lit(False)
    for p in phrases:
        hit = hit | low.contains(p.lower())
    return F.when(hit, 1.0).otherwise(0.0)


def _near(low: Column, hit: Column, surface: Column, within: int = 150) -> Column:
    """Whether the surface stands, as words of its own, at most `within` characters from a place."""
    start = F.greatest(hit["start"] - within - F.length(surface), F.lit(0))
    around = F.substr(low, start + 1, hit["end"] + within + F.length(surface) - start)
    return F.rlike(around, F.concat(F.lit(r"(?<!\w)\Q"), surface, F.lit(r"\E(?!\w)")))


def continuity(context: Column, a: Column, b: Column) -> Column:
    """1.0 where a phrase of going on under another name has both names within 150 characters of it, else 0.0. Memories that are someone's own tell nothing."""
    from fabulon.functions.text import find_all

    low, x, y = F.lower(F.coalesce(context, F.lit(""))), F.lower(a), F.lower(b)
    hit = F.lit(False)
    for i, p in enumerate(CONTINUITY):
        found = F.exists(find_all(low, p), lambda m: _near(low, m, x) & _near(low, m, y))
        hit = hit | (found & ~low.rlike(OWNED) if i == 0 else found)
    return F.when((x != "") & (y != "") & (x != y) & hit, 1.0).otherwise(0.0)


def audience_scope(scene: Column, known: Column, terms_: Column) -> Column:
    """Whether a scene's place fits an entity: 1.0 if its tag is among the entity's terms, 0.25 if not; null where it cannot be judged."""
    return F.when((F.coalesce(scene, F.lit("")) != "") & (F.size(known) > 0) & terms_.isNotNull(), F.when(F.array_contains(terms_, F.lower(scene)), 1.0).otherwise(0.25))


def evidence(pairs: DataFrame, aliases: DataFrame, phrases: tuple[str, ...] = ()) -> DataFrame:
    """pairs with their evidence: eleven features.

    pairs: pair, text, alias_type, chapter, context, speaker, target_id, label, first_chapter, certainty, cosine, partners (map of
    speaker to count, null: none), co_present and concurrent (arrays of labels), scene_scope, known_scopes, terms (of the entity),
    ambiguous (array of tokens, null: no opinion). aliases: target_id, alias.
    """
    key = lambda c: names.comparison_key(F.col(c))
    low = lambda c: F.lower(names.strip_honorifics(F.col(c)))
    each = pairs.select("pair", "target_id", "text", "ambiguous").join(aliases.select("target_id", "alias").distinct(), "target_id")
    each = each.withColumn("_a", low("text")).withColumn("_b", low("alias"))
    # Similarity of each different pair of strings once.
    pure = each.select("_a", "_b").distinct().withColumn("_s", names.jaro_winkler(F.col("_a"), F.col("_b")))
    held = F.when(F.col("ambiguous").isNull(), names.name_containment(F.col("text"), F.col("alias"))).otherwise(names.name_containment(F.col("text"), F.col("alias"), F.coalesce("ambiguous", F.array().cast("array<string>"))))
    best = each.join(pure, ["_a", "_b"]).groupBy("pair").agg(F.max("_s").alias("surface"), F.max(held).alias("containment"), F.max((key("text") != "") & (key("text") == key("alias"))).alias("exact"))
    p = pairs.join(best, "pair", "left")
    goes_on = continuity(F.col("context"), F.col("text"), F.col("label"))
    total = F.aggregate(F.map_values("partners"), F.lit(0).cast("long"), lambda s, x: s + x)
    partner = F.when((F.size("partners") > 0) & F.col("speaker").isNotNull(), F.least(F.lit(1.0), F.coalesce(F.try_element_at("partners", F.col("speaker")), F.lit(0)) / F.greatest(total, F.lit(1)) * 4))
    meets = F.array_contains("co_present", F.col("label")) & (key("text") != key("label")) & ~F.array_contains("concurrent", F.col("label")) & (F.coalesce("containment", F.lit(0.0)) < CONTAINMENT_FLOOR) & (goes_on < 1)
    return p.select(
        *pairs.columns, F.greatest(declared(F.col("context"), phrases), goes_on).alias("declaration_match"), F.when(F.col("exact"), 1.0).otherwise(0.0).alias("gazetteer_exact_match"),
        F.coalesce("surface", F.lit(0.0)).alias("surface_similarity"), F.coalesce("containment", F.lit(0.0)).alias("name_containment"), F.coalesce("cosine", F.lit(0.0)).alias("context_embedding_similarity"),
        F.coalesce(partner, F.lit(0.0)).alias("speech_partner_compatibility"), F.when(F.col("certainty") == "CERTAIN", 1.0).when(F.col("certainty") == "PLAUSIBLE", 0.5).otherwise(0.0).alias("temporal_validity"),
        F.when(meets, 1.0).otherwise(0.0).alias("co_presence_violation"), F.coalesce(audience_scope(F.col("scene_scope"), F.col("known_scopes"), F.col("terms")), F.lit(0.0)).alias("audience_scope_compatibility"),
        F.when((F.col("alias_type") == "RELATIONAL_DEICTIC") & F.col("speaker").isNotNull(), 0.5).otherwise(0.0).alias("relationship_deictic_resolution"),
        F.when(F.col("first_chapter") > F.col("chapter"), -1.0).otherwise(0.0).alias("first_attested_soft_prior"),
    )


def explained(weights: dict[str, float]) -> Column:
    """array of (feature, contribution) of a row's evidence, the largest by absolute value first."""
    parts = F.array(*[F.struct(F.lit(k).alias("feature"), (F.col(k) * w).alias("contribution")) for k, w in weights.items()])
    return F.array_sort(parts, lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).otherwise(0))


def wiki(mentions: DataFrame, aliases: DataFrame, attributes: DataFrame, least: int = 2, limit: int = 40, most_aliases: int = 8, most_terms: int = 12) -> DataFrame:
    """Summaries of the `limit` entities with the most mentions (`least` at least): aliases, longest first, most frequent terms, attributes that readers or the system know, the last written."""
    top = profiles(mentions).filter(F.col("n_mentions") >= least).orderBy(F.col("n_mentions").desc(), "target_id").limit(limit)
    longest = Window.partitionBy("target_id").orderBy(F.length("alias").desc(), "alias")
    a = aliases.select("target_id", "alias").distinct().withColumn("_r", F.row_number().over(longest)).filter(F.col("_r") <= most_aliases).groupBy("target_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "alias"))), lambda s: s["alias"]).alias("aliases"))
    often = Window.partitionBy("id").orderBy(F.col("tf").desc(), "term")
    t = context_postings(mentions.join(top.select("target_id"), "target_id", "left_semi")).withColumn("_r", F.row_number().over(often)).filter(F.col("_r") <= most_terms).groupBy(F.col("id").alias("target_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda s: s["term"]).alias("terms"))
    f = attributes.filter("observer_id in ('SYSTEM', 'READER')").groupBy("target_id", "key").agg(F.max_by("value", "seq").alias("value")).groupBy("target_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("attributes"))
    return top.join(a, "target_id", "left").join(t, "target_id", "left").join(f, "target_id", "left")


def self_retrieval_cases(mentions: DataFrame, aliases: DataFrame, most: int = 3, least: int = 2) -> DataFrame:
    """(target_id, surface): the `most` longest aliases of entities with `least` mentions or more."""
    often = profiles(mentions).filter(F.col("n_mentions") >= least).select("target_id")
    longest = Window.partitionBy("target_id").orderBy(F.length("alias").desc(), "alias")
    return aliases.select("target_id", "alias").distinct().join(often, "target_id", "left_semi").withColumn("_r", F.row_number().over(longest)).filter(F.col("_r") <= most).select("target_id", F.col("alias").alias("surface"))


def identity_targets(gold: DataFrame) -> DataFrame:
    """identity, target_id by majority of aligned mentions (identity, target_id); ties by id."""
    votes = gold.filter("target_id is not null").groupBy("identity", "target_id").agg(F.count("*").alias("n"))
    return votes.groupBy("identity").agg(F.max(F.struct("n", "target_id"))["target_id"].alias("target_id"))


def calibration_samples(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """Scored pairs (mention_id, target_id, score) labelled by gold (mention_id, identity): whether the pair's target is the identity's."""
    truth = gold.select("mention_id", "identity").join(identity_targets(gold), "identity").select("mention_id", F.col("target_id").alias("_t"))
    return scored.join(truth, "mention_id").select("mention_id", "target_id", "score", (F.col("target_id") == F.col("_t")).alias("correct"))


def entity_ids(founded: DataFrame, novel: str, entities: DataFrame) -> DataFrame:
    """New entities (label, kind, order) with ids novel:self1, novel:self2, ... that go on after those of `entities` (id)."""
    number = F.regexp_extract("id", r":self(\d+)$", 1)
    taken = entities.select(F.when(number != "", number.cast("long")).alias("seq"))
    from fabulon.operators.log import numbered

    return numbered(founded, taken, "seq", "order").select(F.concat(F.lit(f"{novel}:self"), F.col("seq").cast("string")).alias("id"), "label", "kind", "order")


def event_detectors(blocks: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, start, kind, event, subject, object, confidence of what happens to identities; a hit of the first three needs a subject or an object."""
    from fabulon.functions import rules
    from fabulon.functions.text import find_all

    parts = []
    for kind, pattern, confidence, event in rules.DETECTORS:
        flag = "" if kind == "DEATH" else "(?i)"
        plain = pattern.replace(f"({rules.NAME})", rules.NAME)
        hit = blocks.select(*by, F.explode(find_all(F.col(text), flag + plain)).alias("m"))
        subject = F.nullif(F.trim(F.regexp_extract("m.text", flag + pattern, 1)), F.lit(""))
        object_ = F.nullif(F.trim(F.regexp_extract("m.text", flag + pattern, 2)), F.lit("")) if kind in ("TRANSFER", "DECEPTION", "REVEAL") else F.lit(None).cast("string")
        parts.append(hit.select(*by, F.col("m.start").alias("start"), F.lit(kind).alias("kind"), F.lit(event).alias("event"), F.coalesce(subject, object_).alias("subject"), F.when(subject.isNotNull(), object_).alias("object"), F.lit(confidence).alias("confidence")).filter("subject is not null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
