"""Names in text: a dictionary of any size with overlap resolution, heuristic detection, harvest, credits, evidence of commonness."""

from __future__ import annotations

import re
from bisect import bisect_right as bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from fabulon.functions import names, rules
from fabulon.functions.text import find_all

#: What folding drops between the tokens of a name.
_DROPPED = r"[\s'’\-–—.·]"
_TOKEN = regex.compile(r"[\p{L}\p{N}]+")
#: The most tokens of a name that is looked up.
TOKENS = 6
#: Capitalised words that begin sentences rather than name anyone, and particles in place of names.
STOPWORDS = (
    "The", "A", "An", "And", "But", "Or", "If", "When", "While", "After", "Before", "Because", "Although", "Though", "Since", "However", "Therefore",
    "Thus", "So", "Then", "Now", "Here", "There", "This", "That", "These", "Those", "They", "Them", "Their", "His", "Her", "Its", "He", "She", "It",
    "We", "You", "I", "Me", "My", "Our", "Your", "What", "Who", "Whom", "Which", "Why", "How", "Where", "Yes", "No", "Not", "All", "Some", "Any",
    "Every", "Each", "Both", "Either", "Neither", "One", "Two", "Three", "In", "On", "At", "To", "From", "By", "With", "For", "Of", "As", "Is", "Was",
    "Were", "Are", "Be", "Been", "Being", "Do", "Did", "Does", "Have", "Has", "Had", "Will", "Would", "Can", "Could", "Shall", "Should", "May",
    "Might", "Must", "Let", "Just", "Even", "Still", "Yet", "Only", "Also", "Very", "Too", "Much", "Many", "More", "Most", "Less", "Least", "Such",
    "Same", "Other", "Another", "Once", "Twice", "Again", "Ever", "Never", "Always", "Often", "Sometimes", "Perhaps", "Maybe", "Suddenly",
    "Immediately", "Finally", "Meanwhile", "Afterwards", "Nevertheless", "Moreover", "Chapter", "Prologue", "Epilogue", "Interlude", "Side", "Story",
    "Extra", "Volume", "Part", "Book",
)
INTERJECTIONS = (
    "Ah", "Ahh", "Aha", "Ha", "Haha", "Hah", "Heh", "Hmph", "Hmm", "Hm", "Hey", "Oh", "Ohh", "Oi", "Eh", "Uh", "Um", "Er", "Wow", "Whoa", "Alas",
    "Alright", "Right", "Okay", "Ok", "Well", "Yes", "No", "Nope", "Yeah", "Yep", "Nay", "Aye", "Sigh", "Tsk", "Tch", "Damn", "Hell", "Heavens",
    "Gods", "God", "Buddha", "Amen", "Please", "Sorry", "Thanks", "Thank", "Congratulations", "Indeed", "Certainly", "Absolutely", "Exactly",
    "Precisely", "Naturally", "Obviously", "Truly", "Really", "Wait", "Stop", "Look", "Listen", "Come", "Go", "Hurry", "Quick", "Silence", "Enough",
    "Impossible", "Incredible", "Unbelievable", "Amazing", "Interesting", "Good", "Great", "Fine", "Bad", "Terrible", "Excellent", "Perfect",
)
_HARVEST_NAME = r"[A-Z][\w’'\-]*(?:\s+[A-Z][\w’'\-]*){0,4}"
_HARVEST_VERBS = (
    "said|says|spoke|replied|replies|answered|asked|asks|shouted|shouts|yelled|screamed|roared|whispered|whispers|murmured|muttered|mumbled|called|"
    "cried|exclaimed|declared|continued|added|adds|responded|retorted|snapped|laughed|chuckled|sighed|sneered|sneers|scoffed|snorted|urged|explained|"
    "interrupted|interjected|greeted|repeated|stated|remarked|noted|agreed|admitted|warned|ordered|commanded|announced|questioned|countered|insisted|"
    "pleaded|begged"
)
#: Fixed values: (pattern with the name as its group, source) of harvested names.
HARVEST = (
    (rf"\b({_HARVEST_NAME})\s+(?:\w+\s+){{0,2}}?(?:{_HARVEST_VERBS})\b", "attribution"),
    (rf"\b(?:{_HARVEST_VERBS})\s+({_HARVEST_NAME})\b", "attribution"),
    (rf"[“\"']\s*({_HARVEST_NAME})\s*,", "address"),
)


def folded(s: Column) -> Column:
    """A name as it is looked up: case folded, without spaces, apostrophes, hyphens and dots."""
    return F.regexp_replace(F.lower(F.trim(s)), _DROPPED, "")


def admitted(aliases: DataFrame, blocked: tuple[str, ...] = ()) -> DataFrame:
    """Aliases (alias, alias_type, ...) that may enter the dictionary, with their folded key: no generic descriptors, none under two characters, none blocked; of one key the last alias by text."""
    a = aliases.withColumn("alias", F.trim("alias")).withColumn("key", folded(F.col("alias")))
    ok = (F.col("alias_type") != "GENERIC_DESCRIPTOR") & (F.length("alias") >= 2) & (F.col("key") != "")
    if blocked:
        ok = ok & ~F.lower("alias").isin(*blocked)
    rest = [c for c in aliases.columns if c != "alias"]
    return a.filter(ok).groupBy("key").agg(F.max(F.struct("alias", *rest)).alias("s")).select("key", "s.*")


_LED = re.compile(rf"(?:^|\W)(?:{rules.DETERMINERS})\s+$")
_CREDIT = re.compile(r"\b(?:" + "|".join(map(re.escape, rules.CREDITS)) + r")\b")


def _runs(texts: DataFrame, by: list[str], text: str, around: int = 0) -> DataFrame:
    """by, start, end, key, surface of all runs of one to TOKENS tokens of each text, in one pass; with `around`, whether a determiner leads a run and whether credit vocabulary stands within so many characters of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column("_t").to_pylist()):
                t = t or ""
                at = [(m.start(), m.end()) for m in _TOKEN.finditer(t)]
                low = [re.sub(_DROPPED, "", t[a:z].lower()) for a, z in at]
                gap = [re.sub(_DROPPED, "", t[at[j][1] : at[j + 1][0]]) for j in range(len(at) - 1)]
                credit = [(m.start(), m.end()) for m in _CREDIT.finditer(t)] if around else []
                ends = [z for _, z in credit]
                out = [[], [], [], [], [], []]
                for j, (a, _) in enumerate(at):
                    key, led = "", bool(around and _LED.search(t[max(0, a - 16) : a]))
                    k = bisect(ends, a - around)  # the first credit that is not wholly before the window
                    k += k < len(credit) and credit[k][0] < a - around
                    for n in range(j, min(j + TOKENS, len(at))):
                        key += (gap[n - 1] if n > j else "") + low[n]
                        z = at[n][1]
                        for o, v in zip(out, (a, z, key, t[a:z], led, k < len(credit) and credit[k][0] >= a - around and credit[k][1] <= z + around), strict=True):
                            o.append(v)
                if out[0]:
                    own = pa.array([i] * len(out[0]), pa.int64())
                    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(own) for c in by], *[pa.array(o, k) for o, k in zip(out, kinds, strict=True)]], names=[*by, "start", "end", "key", "surface", "led", "near"])

    rows = texts.select(*by, F.col(text).alias("_t"))
    kinds = StructType.fromDDL("start int, end int, key string, surface string, led boolean, near boolean")
    return rows.mapInArrow(run, StructType([*[rows.schema[c] for c in by], *kinds.fields]))


def _kept(n: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
    """Of each row's hits the numbers of those that stay, by place."""
    out = []
    for size, a, z in zip(n.to_pylist(), start.to_pylist(), end.to_pylist(), strict=True):
        taken, own = np.zeros(max(z, default=0) + 1, dtype=bool), []
        for i in sorted(range(len(size)), key=lambda i: (-size[i], a[i])):  # noqa: B023
            if not taken[a[i] : z[i]].any():
                taken[a[i] : z[i]] = True
                own.append(i)
        out.append(sorted(own, key=lambda i: a[i]))  # noqa: B023
    return pa.array(out, pa.list_(pa.int32()))


def longest_first(hits: Column) -> Column:
    """Of an array of (n, start, end, ...) those that stay when longer ones, then earlier ones, go first and others that touch them are dropped; by place. n: the length that counts."""
    part = lambda c: F.transform(hits, lambda h: h[c])
    return F.transform(F.arrow_udf(_kept, ArrayType(IntegerType()))(part("n"), part("start"), part("end")), lambda i: F.get(hits, i))


def find(texts: DataFrame, by: list[str], dictionary: DataFrame, text: str = "text") -> DataFrame:
    """by, start, end, surface and the dictionary's columns of each hit.

    Every run of up to six tokens is a key of an equi-join with the dictionary (from `admitted`), so the dictionary
    may be as large as it likes; a hit never begins or ends inside a word. Overlaps of one text are settled
    longest first. A text's hits are as many as its words at most.
    """
    rest = [c for c in dictionary.columns if c != "key"]
    hits = _runs(texts, by, text).select(*by, "key", "start", "end", "surface").join(dictionary, "key").select(*by, F.struct(F.length("key").alias("n"), "start", "end", "surface", *rest).alias("h"))
    kept = hits.groupBy(*by).agg(F.collect_list("h").alias("hs")).withColumn("hs", longest_first(F.col("hs"))).select(*by, F.explode("hs").alias("h"))
    return kept.select(*by, "h.start", "h.end", "h.surface", *[F.col("h")[c].alias(c) for c in rest])


def capitalised(text: Column, shortest: int = 2) -> Column:
    """array of (start, end, text, score): runs of up to five capitalised words without leading stop words; 0.8 for several words, 0.6 for one."""
    lead = rf"^(?:(?:{'|'.join(STOPWORDS)})(?:\s+|$))+"
    cut = lambda m: F.regexp_replace(m["text"], lead, "")
    found = F.transform(find_all(text, rf"\b{_HARVEST_NAME}"), lambda m: F.struct((m["end"] - F.length(cut(m))).alias("start"), m["end"].alias("end"), cut(m).alias("text"), F.when(cut(m).rlike(r"\s"), 0.8).otherwise(0.6).alias("score")))
    return F.filter(found, lambda m: F.length(m["text"]) >= shortest)


def detect(blocks: DataFrame, by: list[str], dictionary: DataFrame, text: str = "text") -> DataFrame:
    """Mentions of blocks: dictionary hits (confidence 0.95, method GAZETTEER_EXACT), then capitalised runs that touch none of them."""
    known = find(blocks, by, dictionary, text).select(*by, "start", "end", F.col("surface").alias("text"), "alias_type", F.lit(0.95).alias("confidence"), F.lit("GAZETTEER_EXACT").alias("method"))
    guessed = blocks.select(*by, F.explode(capitalised(F.col(text))).alias("m")).select(*by, "m.*")
    taken = known.groupBy(*by).agg(F.collect_list(F.struct("start", "end")).alias("_k"))
    free = guessed.join(taken, by, "left").filter(F.col("_k").isNull() | ~F.exists("_k", lambda k: (k["start"] < F.col("end")) & (F.col("start") < k["end"])))
    kind = names.alias_type(F.col("text"))["type"]
    rest = free.select(*by, "start", "end", "text", kind.alias("alias_type"), F.col("score").alias("confidence"), F.lit("SCORED").alias("method")).filter(F.col("alias_type") != "GENERIC_DESCRIPTOR")
    return known.unionByName(rest)


def located(texts: DataFrame, by: list[str], surfaces: DataFrame, text: str = "text") -> DataFrame:
    """Every occurrence of each surface in the texts of its `by` columns (a chapter's names in the chapter): by, surface, start."""
    s = surfaces.withColumn("surface", F.trim("surface")).filter(F.length("surface") >= 2).select(*by, "surface").distinct()
    # Every place where the surface's text begins, overlapping ones too.
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - F.length("surface") + 1, F.lit(1))), lambda i: F.substr(F.col(text), i, F.length("surface")) == F.col("surface"))
    return texts.join(s, by).filter(F.contains(text, "surface")).select(*by, "surface", F.explode(starts).alias("_at")).select(*by, "surface", (F.col("_at") - 1).alias("start"))


def harvest(text: Column) -> Column:
    """array of (name, source): names by what stands around them, stop words trimmed; the first pattern that finds a name says where it is from."""
    parts = []
    for pattern, source in HARVEST:
        parts.append(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), _from(source)))
    return F.filter(F.concat(*parts), lambda x: (F.length(x["name"]) >= 2) & ~x["name"].isin(*STOPWORDS))


def _from(source: str):
    return lambda n: F.struct(names.trim_words(n, STOPWORDS).alias("name"), F.lit(source).alias("source"))


def harvest_title(title: Column) -> Column:
    """array of names of several words in a chapter's title."""
    found = F.transform(F.regexp_extract_all(title, F.lit(rf"\b({_HARVEST_NAME})\b"), F.lit(1)), lambda n: names.trim_words(n, STOPWORDS))
    return F.filter(found, lambda n: (F.length(n) >= 3) & n.contains(" "))


def seed(blocks: DataFrame, chapter: str = "chapter", text: str = "text", titles: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Seed names by comparison key: count, first chapter, sources, shortest surface, best confidence; interjections and generic descriptors never."""
    found = blocks.select(chapter, F.explode(harvest(F.col(text))).alias("h")).select(chapter, "h.name", "h.source", F.when(F.col("h.source") == "address", 0.8).otherwise(0.9).alias("confidence"))
    if titles is not None:
        found = found.unionByName(titles.select(chapter, F.explode(harvest_title(F.col("title"))).alias("name"), F.lit("title").alias("source"), F.lit(0.7).alias("confidence")))
    bare = names.canonical_surface(F.col("name"))
    found = found.filter(~names.all_words_in(F.col("name"), INTERJECTIONS)).withColumn("surface", bare).withColumn("key", names.comparison_key(F.col("name")))
    found = found.filter((F.col("key") != "") & (names.alias_type(F.col("surface"))["type"] != "GENERIC_DESCRIPTOR"))
    return found.groupBy("key").agg(
        F.count("*").alias("n"), F.min(chapter).alias("first_chapter"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.min(F.struct(F.length("surface").alias("n"), F.col("surface").alias("s")))["s"].alias("surface"), F.max("confidence").alias("confidence"),
    ).filter(F.col("n") >= least)


def candidate_names(text: Column) -> Column:
    """array of capitalised runs of up to three words that do not begin with a stop word, repeats included."""
    found = F.regexp_extract_all(text, F.lit(r"(\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b)"), F.lit(1))
    stop = ("The", "A", "An", "He", "She", "It", "They", "We", "You", "I", "His", "Her", "But", "And", "Or", "If", "When", "After", "Before", "This", "That", "These", "Those", "There", "Then", "However", "Although", "Because", "While", "Chapter")
    return F.filter(found, lambda n: (F.length(n) >= 3) & ~F.element_at(F.split(n, r"\s+"), 1).isin(*stop))


def handoffs(blocks: DataFrame, chapter: str = "chapter", text: str = "text", window: int = 5, least: int = 20) -> DataFrame:
    """Chapters where many names change their spelling at once: chapter, changed_forms.

    Names of the `window` chapters before and from each chapter on; those seen twice on one side and never on the
    other are paired by comparison key. Of neighbouring chapters within a window the one with the most stands.
    """
    counts = blocks.select(chapter, F.explode(candidate_names(F.col(text))).alias("name")).groupBy(chapter, "name").agg(F.count("*").alias("c"))
    numbers = blocks.select(chapter).distinct().withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(chapter)))  # a row for each chapter of a novel
    total = numbers.agg(F.max("n").alias("total"))
    near = counts.join(numbers, chapter).select("name", "c", "n")
    # A chapter's names count before the chapters up to `window` after it, and after those up to `window` - 1 before it.
    sides = near.select("name", "c", F.explode(F.concat(
        F.transform(F.sequence(F.col("n") + 1, F.col("n") + window), lambda m: F.struct(m.alias("m"), F.lit(True).alias("before"))),
        F.transform(F.sequence(F.col("n") - window + 1, F.col("n")), lambda m: F.struct(m.alias("m"), F.lit(False).alias("before"))),
    )).alias("x")).select("name", "c", "x.m", "x.before")
    both = sides.groupBy("m", "name").agg(F.sum(F.when(F.col("before"), F.col("c")).otherwise(0)).alias("b"), F.sum(F.when(~F.col("before"), F.col("c")).otherwise(0)).alias("a"))
    one = both.filter("(b = 0 and a >= 2) or (a = 0 and b >= 2)").withColumn("key", names.comparison_key(F.col("name")))
    pairs = one.groupBy("m", "key").agg(F.sum((F.col("a") == 0).cast("int")).alias("gone"), F.sum((F.col("b") == 0).cast("int")).alias("come")).filter("gone > 0 and come > 0")
    found = pairs.groupBy("m").agg(F.sum("gone").alias("changed_forms")).filter(F.col("changed_forms") >= least).crossJoin(F.broadcast(total)).filter(F.col("m").between(window + 1, F.col("total") - window))
    reports = found.join(numbers, F.col("m") == F.col("n")).select(chapter, "changed_forms")
    order = Window.partitionBy(F.lit(0)).orderBy(chapter)  # a row for each report
    island = F.sum((F.coalesce(F.col(chapter) - F.lag(chapter).over(order), F.lit(window + 1)) > window).cast("int")).over(order)
    return reports.withColumn("_i", island).groupBy("_i").agg(F.max(F.struct("changed_forms", -F.col(chapter))).alias("s")).select((-F.col("s")["col2"]).alias(chapter), F.col("s.changed_forms").alias("changed_forms"))


def commonness(texts: DataFrame, candidates: DataFrame, text: str = "text") -> DataFrame:
    """surface, total, determiner_rate, plural_rate, common of each candidate (surface): whether its grammar is that of a common noun.

    A surface's words are keys of runs of tokens, so that all candidates are measured in one pass over the texts.
    """
    runs = _runs(texts.select(F.lower(F.col(text)).alias("_t")), [], "_t", 80).select("key", F.col("surface").alias("_said"), "led")
    keyed = candidates.select(F.lower(F.trim("surface")).alias("surface")).distinct().filter(F.length("surface") >= 2)
    forms = keyed.select("surface", F.explode(F.array(F.struct(folded(F.col("surface")).alias("key"), F.lit(False).alias("plural")), F.struct(folded(F.concat("surface", F.lit("s"))).alias("key"), F.lit(True).alias("plural")))).alias("f")).select("surface", "f.*")
    hits = runs.join(forms, "key").filter(F.col("_said") == F.when(F.col("plural"), F.concat("surface", F.lit("s"))).otherwise(F.col("surface")))
    counts = hits.groupBy("surface").agg(F.sum((~F.col("plural")).cast("long")).alias("total"), F.sum((~F.col("plural") & F.col("led")).cast("long")).alias("_d"), F.sum(F.col("plural").cast("long")).alias("_p"))
    out = keyed.join(counts, "surface", "left").select(
        "surface", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(F.when(F.col("total") > 0, F.col("_d") / F.col("total")), F.lit(0.0)).alias("determiner_rate"),
        F.coalesce(F.when(F.col("total") > 0, F.col("_p") / (F.col("total") + F.col("_p"))), F.lit(0.0)).alias("plural_rate"),
    )
    return out.withColumn("common", names.is_scale_term(F.col("surface")) | ((F.col("total") >= 8) & ((F.col("determiner_rate") >= 0.08) | (F.col("plural_rate") >= 0.05))))


def credited(texts: DataFrame, candidates: DataFrame, text: str = "text", rate: float = 0.5, around: int = 80) -> DataFrame:
    """Candidates (surface) with three occurrences or more of which at least `rate` stand within `around` characters of credit vocabulary."""
    keyed = candidates.select(F.lower(F.trim("surface")).alias("surface")).distinct().filter(F.length("surface") >= 3)
    runs = _runs(texts.select(F.lower(F.col(text)).alias("_t")), [], "_t", around).select("key", F.col("surface").alias("_said"), "near")
    hits = runs.join(keyed.withColumn("key", folded(F.col("surface"))), "key").filter(F.col("_said") == F.col("surface"))
    return hits.groupBy("surface").agg(F.count("*").alias("n"), F.avg(F.col("near").cast("double")).alias("rate")).filter((F.col("n") >= 3) & (F.col("rate") >= rate))


def support_tier(n: Column) -> Column:
    """How well a vocabulary's word is attested: HIGH from three samples on, MEDIUM two, LOW one."""
    return F.when(n >= 3, "HIGH").when(n == 2, "MEDIUM").otherwise("LOW")


def even_sample(chapters: DataFrame, count: int, number: str = "number") -> DataFrame:
    """`count` chapters evenly over the list: those of rank int(i * n / count)."""
    ranked = chapters.select(number).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(number)) - 1)  # a row for each chapter of a novel
    n = ranked.agg(F.count("*").alias("_n"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(max(count, 1) - 1)), lambda i: F.floor(i * F.col("_n") / count).cast("int"))
    return ranked.crossJoin(F.broadcast(n)).filter(F.array_contains(picks, F.col("_r").cast("int")) | (F.col("_n") <= count)).select(number)


def extracted_names(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, surface, label) of names that models return with labels: plausible ones, and of one with several labels "character" wins, else the least."""
    ok = found.withColumn("surface", F.regexp_replace(F.trim("surface"), r"[.!?;:,]+$", "")).filter(names.plausible_name(F.col("surface")) & F.lower("label").isin("character", "location", "organization"))
    return ok.groupBy(*by, "surface").agg(F.when(F.max(F.lower("label") == "character"), "character").otherwise(F.min(F.lower("label"))).alias("label"))
