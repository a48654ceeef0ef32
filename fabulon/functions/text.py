"""Text blocks: classification, spans, markers and small measures, in built-in functions.

Matches come with offsets from `find_all`, which needs no Python: a text is split at the matches of a
pattern, and the lengths of pieces and matches add up to the places.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fabulon.functions import rules

STOP = ("the", "and", "was", "that", "with", "for", "from", "this", "have")
#: Opening and closing quotes: of a curly run up to its closing mark, of a straight one to a mark that no word follows, or to the text's end.
_AFTER = r"(?=[\s.,;:!?)\]}—–\-]|\z)"
_QUOTE_RUN = "(?s)(?:" + "|".join(
    [f"{a}[^{b}]*(?:{b}|\\z)" for a, b in (("“", "”"), ("‘", "’"), ("「", "」"), ("『", "』"), ("«", "»"))]
    + [rf"(?<![^\s(\[{{—–\-]){q}(?=\S).*?(?:{q}{_AFTER}|\z)" for q in ('"', "'")]
) + ")"
_QUOTE_MARKS = "“‟‘‛\"'「『«”„’‚」』»"


def find_all(text: Column, pattern: str) -> Column:
    """array of (start, end, text) of all matches, offsets from 0; null text: none.

    For blocks and spans: places are added up one by one into an array, which grows with the square of a text's matches.
    """
    text = F.coalesce(text, F.lit(""))
    found, pieces = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1)
    both = F.zip_with(F.slice(pieces, 1, F.greatest(F.size(found), F.lit(0))), found, lambda p, m: F.struct(F.length(p).alias("before"), m.alias("text")))
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def add(acc, x):
        last = F.when(F.size(acc) > 0, F.element_at(acc, -1)["end"]).otherwise(0)
        start = last + x["before"]
        return F.concat(acc, F.array(F.struct(start.alias("start"), (start + F.length(x["text"])).alias("end"), x["text"].alias("text"))))

    return F.when(text.rlike(pattern), F.aggregate(both, none, add)).otherwise(none)  # most texts have no match: one look tells


def word_find_all(text: Column, literal: str) -> Column:
    """Places of a literal with no word character on either side."""
    return find_all(text, rf"(?<!\w){re.escape(literal)}(?!\w)")


# -- blocks --------------------------------------------------------------------------------------


def _inside(text: Column, a: str, b: str) -> Column:
    return text.startswith(a) & text.endswith(b)


def bracketed(text: Column) -> Column:
    t = F.trim(text)
    out = F.lit(False)
    for a, b in rules.SYSTEM_DELIMITERS:
        out = out | _inside(t, a, b)
    return out


def system_fields(text: Column) -> Column:
    """map of key to value of the lines of a status window, its brackets taken off; of a repeated key the last value."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    body = t
    for a, b in reversed(rules.SYSTEM_DELIMITERS):
        body = F.when(_inside(t, a, b), F.substr(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))).otherwise(body)
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), r"\r\n|\n|\r"), lambda x: x.rlike(rules.KEY_VALUE) & x.rlike(r"\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, rules.KEY_VALUE, 1)).alias("k"), F.trim(F.regexp_extract(x, rules.KEY_VALUE, 2)).alias("v")))
    pairs = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def fields(text: Column) -> Column:
    """Keys of the key: value lines of a status window."""
    return F.map_keys(system_fields(text))


def is_system_window(text: Column, least: int = 2) -> Column:
    n = F.size(fields(text))
    return (bracketed(text) | text.rlike("(?i)" + rules.SYSTEM_WORDS)) & ((n >= least) | ((n > 0) & bracketed(text) & (F.length(text) < 200)))


def block_type(text: Column, heading: Column | None = None) -> Column:
    """The kind of a block: the first rule that holds. heading: whether the source marks it as one."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    head = F.lit(False) if heading is None else F.coalesce(heading, F.lit(False))
    junk = F.lit(False)
    for p in rules.NON_DIEGETIC:
        junk = junk | t.rlike("(?i)" + p)
    return (
        F.when(t == "", "NON_DIEGETIC")
        .when(head & F.lower(t).isin(*rules.APPENDIX_HEADINGS), "NON_DIEGETIC").when(head, "HEADING")
        .when(junk, "NON_DIEGETIC")
        .when(t.rlike("(?i)" + rules.TRANSLATOR_NOTE), "TRANSLATOR_NOTE").when(t.rlike("(?i)" + rules.AUTHOR_NOTE), "AUTHOR_NOTE")
        .when(is_system_window(t), "SYSTEM_WINDOW").otherwise("PROSE")
    )


# -- markers -------------------------------------------------------------------------------------


def marker_set(*optional: str) -> tuple[str, ...]:
    """Kinds that are looked for: those of any prose, and the optional ones named ("all" for all of these)."""
    return rules.UNIVERSAL_KINDS + (rules.OPTIONAL_KINDS if optional == ("all",) else optional)


def _marker(kind: str, confidence: float):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["text"].alias("text"), F.lit(confidence).alias("confidence"))


def narrative_markers(text: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """array of (kind, start, text, confidence) by place; a scene break is a block's only marker."""
    kinds = marker_set("all") if kinds is None else kinds
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    parts = []
    for kind, patterns, confidence in rules.MARKERS:
        if kind in kinds:
            found = find_all(text, "(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")
            parts.append(F.transform(found, _marker(kind, confidence)))
    place = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    sorted_ = F.array_sort(F.concat(*parts), place) if parts else F.array().cast("array<struct<kind:string,start:int,text:string,confidence:double>>")
    break_ = F.array(F.struct(F.lit("SCENE_BREAK").alias("kind"), F.lit(0).alias("start"), t.alias("text"), F.lit(1.0).alias("confidence")))
    if "SCENE_BREAK" in rules.UNIVERSAL_KINDS:  # a break is one whatever is enabled
        return F.when(t.rlike(rules.SCENE_BREAK), break_).otherwise(sorted_)
    return sorted_


def masked_quotes(text: Column) -> Column:
    """text with quoted speech blanked out, offsets kept."""
    text = F.coalesce(text, F.lit(""))
    found, pieces = F.regexp_extract_all(text, F.lit(f"({rules.QUOTED})"), F.lit(1)), F.split(text, rules.QUOTED, -1)
    blank = F.transform(found, lambda m: F.repeat(F.lit(" "), F.length(m)))
    return F.array_join(F.zip_with(pieces, blank, lambda p, b: F.concat(p, F.coalesce(b, F.lit("")))), "")


def delivery_markers(text: Column) -> Column:
    """array of (start, end, text, polarity) of the delivery words of a speech tag, longest first, never inside quoted speech."""
    words = sorted((w for ws in rules.DELIVERY.values() for w in ws), key=len, reverse=True)
    polarity = F.create_map(*[F.lit(x) for p, ws in rules.DELIVERY.items() for w in ws for x in (w, p)])
    found = find_all(masked_quotes(text), r"(?i)\b(?:" + "|".join(map(re.escape, words)) + r")\b")
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.element_at(polarity, F.lower(m["text"])).alias("polarity")))


def dominant_polarity(markers: Column) -> Column:
    """FLAT if any marker is, else the first one's polarity; null without markers."""
    return F.when(F.exists(markers, lambda m: m["polarity"] == "FLAT"), "FLAT").when(F.size(markers) > 0, F.get(markers, F.lit(0))["polarity"])


def mobs(text: Column) -> Column:
    """array of (start, text, role): crowds with a quantifier, then those that begin a clause and surround, unless at a place already found."""
    one = F.transform(find_all(text, "(?i)" + rules.MOB.replace("(" + "|".join(rules.MOB_ROLES) + ")", "(?:" + "|".join(rules.MOB_ROLES) + ")")), lambda m: F.struct(m["start"].alias("start"), m["text"].alias("text"), F.lower(F.regexp_extract(m["text"], r"(\w+)$", 1)).alias("role")))
    two = F.transform(find_all(text, "(?i)" + rules.MOB_SUBJECT.replace("(" + "|".join(rules.MOB_ROLES) + ")", "(?:" + "|".join(rules.MOB_ROLES) + ")")), lambda m: F.struct(m["start"].alias("start"), m["text"].alias("text"), F.lower(F.regexp_extract(m["text"], r"^(\w+)", 1)).alias("role")))
    return F.concat(one, F.filter(two, lambda m: ~F.exists(one, lambda x: x["start"] == m["start"])))


# -- spans ---------------------------------------------------------------------------------------


def quote_runs(text: Column) -> Column:
    """array of (start, end, text) of quoted runs, marks included; an apostrophe is no quote, an unclosed run goes to the end."""
    return find_all(text, _QUOTE_RUN)


def split_block(text: Column, italics: Column | None = None) -> Column:
    """array of (start, end, text, quoted, emphasised): a block cut at quote and emphasis edges.

    italics: array of (start, end). Emphasis of under four characters is no edge; nor is a quote well inside
    one run of emphasis. Blank spans are left out.
    """
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int>>")
    cut = lambda a, b: F.substr(text, a + 1, b - a)
    given = none if italics is None else F.transform(F.coalesce(italics, none), lambda r: F.struct(F.greatest(r["start"], F.lit(0)).cast("int").alias("start"), F.least(r["end"], F.length(text)).cast("int").alias("end")))
    ranges = F.filter(given, lambda r: F.length(F.trim(cut(r["start"], r["end"]))) >= 4)
    quotes = F.transform(quote_runs(text), lambda q: F.struct(q["start"].alias("start"), q["end"].alias("end")))
    quotes = F.filter(quotes, lambda q: ~F.exists(ranges, lambda r: (r["start"] <= q["start"]) & (q["end"] <= r["end"]) & (r["end"] - r["start"] > q["end"] - q["start"] + 20)))
    edges = F.flatten(F.transform(F.concat(quotes, ranges), lambda r: F.array(r["start"], r["end"])))
    points = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.length(text)), edges)))
    pairs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points), F.lit(1))), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    pairs = F.filter(pairs, lambda p: p["end"].isNotNull() & cut(p["start"], p["end"]).rlike(r"\S"))
    covered = lambda p, ranges: F.exists(ranges, lambda r: (r["start"] <= p["start"]) & (p["end"] <= r["end"]))
    return F.transform(pairs, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), cut(p["start"], p["end"]).alias("text"), covered(p, quotes).alias("quoted"), covered(p, ranges).alias("emphasised")))


def span_type(text: Column, quoted: Column, emphasised: Column, before: Column, after: Column) -> Column:
    """The kind of a span: emphasis, thought verbs within 80 characters, short exclamations, then what narration tells."""
    marks = re.escape(_QUOTE_MARKS)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), f"^[{marks}]+|[{marks}]+$", ""), r"^\s+|\s+$", "")
    near = F.concat_ws(" ", F.when(F.length(before) > 80, F.substr(before, F.lit(-80), F.lit(80))).otherwise(before), F.substr(after, F.lit(1), F.lit(80)))
    return (
        F.when(emphasised, "INNER_MONOLOGUE")
        .when(quoted & near.rlike(r"(?i)\b(?:" + "|".join(rules.THOUGHT) + r")\b"), "INNER_MONOLOGUE")
        .when(quoted & (F.length(bare) <= rules.CROWD_MAX) & bare.rlike("(?i)" + rules.CROWD), "CROWD_REACTION")
        .when(quoted, "DIALOGUE")
        .when(bare.rlike("(?i)" + rules.EXPOSITION), "NARRATION_EXPOSITION").when(bare.rlike("(?i)" + rules.ACTION), "NARRATION_ACTION")
        .when(bare.rlike("(?i)" + rules.DESCRIPTION), "NARRATION_DESCRIPTION").otherwise("NARRATION_ACTION")
    )


# -- small measures ------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, non-ASCII characters included."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9\u0080-￿]+"), lambda w: w != "")


def terms(text: Column) -> Column:
    """Words of more than two characters that are not stop words."""
    return F.filter(words(text), lambda w: (F.length(w) > 2) & ~w.isin(*STOP))


def singular(w: Column) -> Column:
    return F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(F.substr(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when(w.endswith("es") & (F.length(w) > 4), F.substr(w, F.lit(1), F.length(w) - 2)).when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def snippet(text: Column, surface: Column, width: int = 110) -> Column:
    """A window around the first occurrence, with ellipses where it cuts; null where there is none."""
    at = F.instr(text, surface)
    start = F.greatest(at - width // 2, F.lit(1))
    cut = F.substr(text, start, F.lit(width))
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + width - 1 < F.length(text), "…").otherwise("")))


def evidence_context(text: Column, surface: Column, width: int = 400) -> Column:
    """width characters of a text from width / 2 before the first occurrence of a surface on; its first ones where there is none."""
    at = F.instr(text, surface)
    start = F.greatest(at - 1 - width // 2, F.lit(0))
    return F.substr(text, F.when(at > 0, start + 1).otherwise(1), F.lit(width))


def ass_time(seconds: Column) -> Column:
    """H:MM:SS.cc of a caption."""
    cs = F.round(seconds * 100).cast("long")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    whole = lambda c, n: F.floor(c / n)
    return F.concat(whole(cs, 360000).cast("string"), F.lit(":"), pad(whole(cs, 6000) % 60), F.lit(":"), pad(whole(cs, 100) % 60), F.lit("."), pad(cs % 100))
