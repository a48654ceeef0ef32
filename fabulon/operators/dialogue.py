"""Who says a line: the tiers of attribution as columns, and the ladder over a chapter with what it remembers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulon.functions import names, rules

#: Characters of the neighbouring text that a tier sees, and speakers that a scene remembers.
AROUND, RECENT = 220, 6
_V, _N = rules.SPEECH_VERBS, rules.NAME
_BETWEEN = r"\s+(?:\w+\s+){0,2}?"
NAME_SAYS, SAYS_NAME = rf"\b({_N}){_BETWEEN}(?:{_V})\b", rf"\b(?:{_V})\s+({_N})\b"
JOINT = rf"\b({_N})\s+and\s+({_N})\s+(?:both\s+|immediately\s+|together\s+)?(?:{_V})\b"
NAME_ACTS = rf"\b({_N}){_BETWEEN}(?:{rules.ACTION_VERBS})\b"
PRONOUN_SAYS = rf"(?i)\b(?:he|she|they|it){_BETWEEN}(?:{_V})\b"
EPITHET = rf"(?:the\s+)(?:[A-Z][\w'\-]*\s+){{0,3}}?(?:{'|'.join(rules.ROLE_EPITHETS)})"
EPITHET_SAYS, SAYS_EPITHET = rf"(?i)\b({EPITHET}){_BETWEEN}(?:{_V})\b", rf"(?i)\b(?:{_V})\s+({EPITHET})\b"


def is_known(name: Column, known: Column) -> Column:
    """Whether a name, or its comparison key, is in the array of known ones; with none known, any name is."""
    key = names.comparison_key(name)
    return (F.size(known) == 0) | F.array_contains(known, name) | ((key != "") & F.array_contains(known, key))


def _first(text: Column, pattern: str, known: Column, group: int = 1) -> Column:
    """The name of a pattern's first match, if known."""
    n = F.regexp_extract(text, pattern, group)
    return F.when((n != "") & is_known(n, known), n)


def _said(speaker: Column, method: str, confidence: float, also: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.when(speaker.isNotNull(), F.struct(speaker.alias("speaker"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), (none if also is None else also).alias("co_speaker")))


def explicit(preceding: Column, following: Column, known: Column) -> Column:
    """A verb of speech names the speaker, the following text first: two who speak together (0.9), else one (0.95)."""
    tiers = []
    for w in (following, preceding):
        both = F.when(_first(w, JOINT, known).isNotNull() & _first(w, JOINT, known, 2).isNotNull(), _first(w, JOINT, known))
        tiers += [_said(both, "JOINT", 0.9, _first(w, JOINT, known, 2)), _said(_first(w, NAME_SAYS, known), "EXPLICIT", 0.95), _said(_first(w, SAYS_NAME, known), "EXPLICIT", 0.95)]
    return F.coalesce(*tiers)


def epithet(following: Column) -> Column:
    """A title that speaks right behind the line (0.55)."""
    got = lambda p: F.when(F.regexp_extract(following, p, 1) != "", F.trim(F.regexp_extract(following, p, 1)))
    return _said(F.coalesce(got(EPITHET_SAYS), got(SAYS_EPITHET)), "EPITHET_SLOT", 0.55)


def epithet_mentioned(text: Column) -> Column:
    """The first title a text speaks of, or null."""
    got = F.regexp_extract(text, rf"(?i)({EPITHET})", 1)
    return F.when(got != "", F.trim(got))


def pronoun_epithet(preceding: Column, following: Column, current: Column) -> Column:
    """A pronoun that speaks stands for the title now spoken of (0.45)."""
    return F.when(current.isNotNull() & (following.rlike(PRONOUN_SAYS) | preceding.rlike(PRONOUN_SAYS)), _said(current, "EPITHET_SLOT", 0.45))


def proximal(preceding: Column, following: Column, known: Column) -> Column:
    """Who acts next to the line (0.75): the last known name before it, else the first after it."""
    acting = lambda w: F.filter(F.regexp_extract_all(w, F.lit(NAME_ACTS), F.lit(1)), lambda n: is_known(n, known))
    return _said(F.coalesce(F.try_element_at(acting(preceding), F.lit(-1)), F.try_element_at(acting(following), F.lit(1))), "PROXIMAL", 0.75)


def turn(recent: Column) -> Column:
    """The other one of two (0.6), where the last four speakers are exactly two."""
    last = F.slice(recent, F.greatest(F.size(recent) - 3, F.lit(1)), 4)
    two = F.array_distinct(last)
    return F.when((F.size(recent) >= 2) & (F.size(two) == 2), _said(F.when(F.element_at(recent, -1) == F.get(two, F.lit(1)), F.get(two, F.lit(0))).otherwise(F.get(two, F.lit(1))), "TURN_TAKING", 0.6))


def pov_holder(mentions: DataFrame, spans: DataFrame, by: list[str], within: int = 400, least: float = 0.02) -> DataFrame:
    """by, pov: the rigid name that stands most often near inner monologue (ties by name), if it has `least` of all such."""
    inner = spans.filter("span_type = 'INNER_MONOLOGUE'").select(*by, "start")
    near = inner.join(mentions.filter("alias_type = 'RIGID_NAME'").select(*by, "offset", "text"), by).filter(F.abs(F.col("offset") - F.col("start")) < within)
    counts = near.groupBy(*by, "text").agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.max(F.struct("n", "text")).alias("b"), F.sum("n").alias("total"))
    return best.filter(F.col("b.n") / F.col("total") >= least).select(*by, F.col("b.text").alias("pov"))


def ladder(spans: DataFrame, blocks: DataFrame, chapter: list[str], known: DataFrame | None = None, pov: DataFrame | None = None) -> DataFrame:
    """Each span of chapters (chapter columns, block_index, start, id, span_type, text) with speaker, method, confidence, co_speaker.

    The first tier that answers stands: a crowd's chorus, the POV holder's thought, explicit or joint, title, proximal, turn
    taking, title by pronoun. A line sees AROUND characters of its own block and the neighbouring one. blocks: chapter columns,
    block_index, text; known: chapter columns and an array `known` of the names and keys met so far; pov: chapter columns and pov.
    Turns go by the last speakers that were named, jointly named or acting since the last scene break. The title now spoken of is that
    of the last block with one, unless a block with a known name or a break, or a line with a named speaker, came since.
    Windows run over one chapter's blocks and spans.
    """
    none = F.array().cast("array<string>")
    by_block = Window.partitionBy(*chapter).orderBy("block_index")
    b = blocks.select(*chapter, "block_index", F.coalesce("text", F.lit("")).alias("_t"))
    b = b.join(known.select(*chapter, "known"), chapter, "left").withColumn("known", F.coalesce("known", none)) if known is not None else b.withColumn("known", none)
    broken = F.trim("_t") == "* * *"
    named = F.exists("known", lambda n: n.rlike("^[A-Z]") & F.rlike(F.col("_t"), F.concat(F.lit(r"\b\Q"), n, F.lit(r"\E\b"))))
    event = lambda e: F.struct(F.col("block_index").alias("at"), e.alias("e"))
    gone = F.lit(None).cast("string")
    b = b.withColumn("_event", F.when(broken, event(gone)).when(epithet_mentioned(F.col("_t")).isNotNull(), event(epithet_mentioned(F.col("_t")))).when(named, event(gone)))
    b = b.select(
        *chapter, "block_index", "known", F.coalesce(F.lag("_t").over(by_block), F.lit("")).alias("_prev"), F.coalesce(F.lead("_t").over(by_block), F.lit("")).alias("_next"),
        F.sum(broken.cast("int")).over(by_block).alias("_scene"), F.last("_event", ignorenulls=True).over(by_block).alias("_title_at"),
    )
    s = spans.join(b, [*chapter, "block_index"], "left").withColumn("known", F.coalesce("known", none))
    s = s.join(pov, chapter, "left") if pov is not None else s.withColumn("pov", gone)
    inside = Window.partitionBy(*chapter, "block_index").orderBy("start", "id")
    before, after = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(1, Window.unboundedFollowing)
    heard = F.concat_ws(" ", F.coalesce("_prev", F.lit("")), F.array_join(F.collect_list("text").over(before), " "))
    s = s.withColumn("_h", heard).withColumn("_p", F.when(F.length("_h") > AROUND, F.substr(F.col("_h"), F.lit(-AROUND), F.lit(AROUND))).otherwise(F.col("_h")))
    s = s.withColumn("_f", F.substr(F.concat_ws(" ", F.array_join(F.collect_list("text").over(after), " "), F.coalesce("_next", F.lit(""))), F.lit(1), F.lit(AROUND)))
    p, f, k = F.col("_p"), F.col("_f"), F.col("known")
    line = F.col("span_type").isin("DIALOGUE", "INNER_MONOLOGUE")
    chorus = F.when(F.col("span_type") == "CROWD_REACTION", F.struct(gone.alias("speaker"), F.lit("UNATTRIBUTED_CHORUS").alias("method"), F.lit(1.0).alias("confidence"), gone.alias("co_speaker")))
    thought = F.when(F.col("span_type") == "INNER_MONOLOGUE", _said(F.col("pov"), "POV_INFERRED", 0.7))
    # Turns and titles by pronoun rest on these, never on each other.
    s = s.withColumn("_sure", F.coalesce(thought, F.when(line, F.coalesce(explicit(p, f, k), epithet(f), proximal(p, f, k)))))
    order = Window.partitionBy(*chapter).orderBy("block_index", "start", "id").rowsBetween(Window.unboundedPreceding, -1)
    cleared = F.max(F.when(F.col("_sure.method") == "EXPLICIT", F.col("block_index"))).over(order)
    s = s.withColumn("_now", F.when(cleared.isNull() | (cleared < F.col("_title_at.at")), F.col("_title_at.e")))
    counts = (F.col("span_type") == "DIALOGUE") & F.col("_sure.method").isin("EXPLICIT", "JOINT", "PROXIMAL")
    said = F.collect_list(F.when(counts, F.col("_sure.speaker"))).over(Window.partitionBy(*chapter, "_scene").orderBy("block_index", "start", "id").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_recent", F.slice(said, F.greatest(F.size(said) - RECENT + 1, F.lit(1)), RECENT))
    s = s.withColumn("_a", F.coalesce(chorus, F.col("_sure"), F.when(line, turn(F.col("_recent"))), F.when(line, pronoun_epithet(p, f, F.col("_now")))))
    return s.select(*spans.columns, F.col("_a.speaker").alias("speaker"), F.coalesce("_a.method", F.lit("UNRESOLVED")).alias("method"), F.coalesce("_a.confidence", F.lit(0.0)).alias("confidence"), F.col("_a.co_speaker").alias("co_speaker"))


def growing_roster(spans: DataFrame, chapter: str = "chapter", name: str = "speaker") -> DataFrame:
    """chapter, known: names and comparison keys of all who were met up to and with a chapter."""
    met = spans.filter(F.col(name).isNotNull()).groupBy(chapter).agg(F.collect_set(name).alias("_n"))
    up_to = Window.partitionBy(F.lit(0)).orderBy(chapter).rowsBetween(Window.unboundedPreceding, 0)  # a row for each chapter of a novel
    all_ = F.array_distinct(F.flatten(F.collect_list("_n").over(up_to)))
    return met.select(chapter, F.array_distinct(F.concat(all_, F.transform(all_, names.comparison_key))).alias("known"))


def scene_roster(blocks: DataFrame, scenes: DataFrame, chapter: list[str], fallback: str = "roster") -> DataFrame:
    """Each block with the cast of the scene that holds it (block_from, block_to, cast), or the chapter's roster where that has none."""
    hit = blocks.join(scenes.withColumn("block_index", F.explode(F.sequence("block_from", "block_to"))).groupBy(*chapter, "block_index").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cast")))).alias("_c")), [*chapter, "block_index"], "left")
    return hit.withColumn("roster", F.when(F.size("_c") > 0, F.col("_c")).otherwise(F.col(fallback))).drop("_c")


def contextual(open_: DataFrame, choose: Callable[[DataFrame], DataFrame], most: int = 60) -> DataFrame:
    """Unresolved spans (id, known, roster, ...) as a model decides: `choose` gives rows (id, speaker, confidence).

    The roster shown has `most` names; an answer counts if it is a known name and its confidence is 0.5 at least, and no
    confidence is over 0.65.
    """
    asked = open_.withColumn("roster", F.slice("roster", 1, most))
    got = choose(asked).join(open_.select("id", "known"), "id")
    ok = got.filter((F.col("confidence") >= 0.5) & is_known(F.col("speaker"), F.col("known")))
    return ok.select("id", "speaker", F.lit("CONTEXTUAL_LLM").alias("method"), F.least("confidence", F.lit(0.65)).alias("confidence"))


def recovered(spans: DataFrame, blocks: DataFrame, links: DataFrame, within: int = 50) -> DataFrame:
    """Unattributed lines with the antecedent of the nearest pronoun outside them, at most `within` characters away: id, mention_id, confidence (a fifth less).

    spans: id, chapter, block_index, start, end, span_type, speaker; links: chapter, block_index, offset, mention_id, confidence.
    """
    open_ = spans.filter("speaker is null and span_type = 'DIALOGUE'")
    hit = open_.join(links, ["chapter", "block_index"]).filter(~F.col("offset").between(F.col("start"), F.col("end") - 1))
    gap = F.when(F.col("offset") < F.col("start"), F.col("start") - F.col("offset")).otherwise(F.col("offset") - F.col("end"))
    near = hit.withColumn("_gap", gap).filter(F.col("_gap") <= within)
    return near.groupBy("id").agg(F.min(F.struct("_gap", "offset", "mention_id", "confidence")).alias("b")).select("id", "b.mention_id", (F.col("b.confidence") * 0.8).alias("confidence"))


def speaker_index(spans: DataFrame, mentions: DataFrame, selves: DataFrame) -> DataFrame:
    """key, target_id of speakers' labels: the target that mentions of that key name most often, else the entity whose label has the key."""
    keyed = lambda df, c: df.withColumn("key", names.comparison_key(F.col(c))).filter("key <> ''")
    bound = keyed(mentions.filter("target_id is not null"), "text").groupBy("key", "target_id").agg(F.count("*").alias("n"))
    best = bound.groupBy("key").agg(F.max_by("target_id", F.struct("n", "target_id")).alias("t"))
    label = keyed(selves, "canonical_label").groupBy("key").agg(F.min("id").alias("l"))
    said = keyed(spans.filter("speaker is not null").select("speaker").distinct(), "speaker").select("key").distinct()
    return said.join(best, "key", "left").join(label, "key", "left").select("key", F.coalesce("t", "l").alias("target_id")).filter("target_id is not null")


def crowd_runs(spans: DataFrame, by: list[str], most: int = rules.CROWD_MAX, least: int = 3) -> DataFrame:
    """spans (by, n, span_type, text) with short quoted lines re-typed as a crowd's where `least` of them follow each other, at most one span apart."""
    quoted = F.col("span_type").isin("DIALOGUE", "CROWD_REACTION")
    short = quoted & (F.length("text") <= most)
    order = Window.partitionBy(*by).orderBy("n")
    # A run ends where a long line comes or the next short one is more than two spans on.
    lines = spans.filter(quoted).withColumn("_s", short).withColumn("_break", ~short | ~F.coalesce(F.lag(short).over(order), F.lit(False)) | (F.col("n") - F.lag("n").over(order) > 2))
    runs = lines.withColumn("_run", F.sum(F.coalesce("_break", F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    big = runs.filter("_s").withColumn("_size", F.count("*").over(Window.partitionBy(*by, "_run"))).filter(F.col("_size") >= least).select(*by, "n", F.lit("CROWD_REACTION").alias("_new"))
    return spans.join(big, [*by, "n"], "left").withColumn("span_type", F.coalesce("_new", "span_type")).drop("_new")


def chapter_spans(blocks: DataFrame, novel: str = "novel_id") -> DataFrame:
    """Typed spans of blocks (novel_id, chapter, block_index, block_type, text, italic_ranges): id, start, end, span_type, text, delivery.

    A status window and a block outside the story are one span each; delivery markers are read off narration only.
    """
    from fabulon.functions import text as t
    from fabulon.operators.corrections import chapter_text

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("text"), F.lit(False).alias("quoted"), F.lit(False).alias("emphasised")))
    story = F.col("block_type").isin("PROSE", "DIALOGUE")
    cut = blocks.withColumn("_s", F.when(story, t.split_block(F.col("text"), F.col("italic_ranges"))).otherwise(whole)).select("*", F.posexplode("_s").alias("n", "s"))
    near = lambda i: F.coalesce(F.get("_s", i)["text"], F.lit(""))
    kind = F.when(F.col("block_type") == "SYSTEM_WINDOW", "SYSTEM_WINDOW").when(~story, "NON_DIEGETIC").otherwise(t.span_type(F.col("s.text"), F.col("s.quoted"), F.col("s.emphasised"), F.when(F.col("n") > 0, near(F.col("n") - 1)).otherwise(""), near(F.col("n") + 1)))
    rows = cut.withColumn("span_type", kind).drop("_s")
    told = story & ~F.col("span_type").isin("DIALOGUE", "INNER_MONOLOGUE")
    rows = rows.select(novel, "chapter", "block_index", "n", F.concat_ws(":", novel, chapter_text(F.col("chapter")), F.col("block_index").cast("string"), F.col("n").cast("string")).alias("id"), "s.start", "s.end", "span_type", F.trim("s.text").alias("text"), F.when(told, F.transform(t.delivery_markers(F.col("s.text")), lambda m: m["text"])).otherwise(F.array().cast("array<string>")).alias("delivery_markers"))
    return crowd_runs(rows, [novel, "chapter", "block_index"])
