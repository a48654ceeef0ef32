"""Names as keys: folding, honorifics, variants, similarity. Built-in functions throughout, but for Jaro-Winkler."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fabulon.functions import rules

def _folded() -> tuple[str, str]:
    """Letters that compatibility decomposition, without its marks, turns into one other character, and these; Latin, Greek, Cyrillic and full-width."""
    pairs = []
    for i in (*range(0xA0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(i):
            pairs.append((chr(i), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _folded()
_HEADS = "|".join(sorted(rules.HONORIFIC_PREFIXES, key=len, reverse=True))
_TAILS = "|".join(rules.HONORIFIC_SUFFIXES)


def normalize_alias(s: Column) -> Column:
    """White space squashed, case folded (sharp s as ss)."""
    return F.replace(F.lower(F.trim(F.regexp_replace(s, r"\s+", " "))), F.lit("ß"), F.lit("ss"))


def strip_diacritics(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, _MARKED, _PLAIN), "[\u0300-\u036f]", "")


def normalize_romanization(s: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(strip_diacritics(s)), F.lit("ß"), F.lit("ss")), r"['’\-–—.·\s]", "")


def strip_honorifics(s: Column, articles: bool = False) -> Column:
    """Every leading prefix (an article too, if asked) and trailing suffix removed."""
    lead = rf"(?:(?:{_HEADS})\.?\s+" + (r"|(?:the|a|an)\s+" if articles else "") + ")+"
    out = F.regexp_replace(F.trim(s), rf"(?i)^{lead}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, rf"(?i)(?:{_TAILS})+$", ""), rf"(?i)^{lead}", ""))


def strip_morphology(s: Column) -> Column:
    """Possessive endings, then a plural s of longer words that do not end in ss, us or is."""
    out = F.trim(F.regexp_replace(s, r"(?i)['’]s\b|s['’]$", ""))
    plural = (F.length(out) > 4) & out.rlike("[sS]$") & ~out.rlike("(ss|us|is)$")
    return F.trim(F.when(plural, F.substr(out, F.lit(1), F.length(out) - 1)).otherwise(out))


def comparison_key(s: Column) -> Column:
    return normalize_romanization(strip_morphology(strip_honorifics(s, articles=True)))


def are_variants(a: Column, b: Column) -> Column:
    return (F.length(a) > 0) & (F.length(b) > 0) & (comparison_key(a) == comparison_key(b))


def canonical_surface(s: Column) -> Column:
    """The bare name, or the name itself where nothing else is left."""
    bare = strip_honorifics(s)
    return F.when(bare != "", bare).otherwise(F.trim(s))


def bare_label(s: Column) -> Column:
    """A surface as it is shown: without inflection and leading article."""
    return F.trim(F.regexp_replace(strip_morphology(s), r"(?i)^(?:the|a|an)\s+", ""))


def display_label(surface: Column) -> Column:
    """Aggregate: the longest surface as shown; of equally long ones one that needed no change, then the last in order; empty if none is left."""
    bare = bare_label(surface)
    order = F.struct(F.length(bare), bare == F.trim(surface), bare)
    return F.coalesce(F.max_by(F.when(bare != "", bare), F.when(bare != "", order)), F.lit(""))


def name_tokens(s: Column) -> Column:
    return F.filter(F.transform(F.split(strip_morphology(strip_honorifics(s)), r"\s+"), normalize_romanization), lambda t: t != "")


def name_containment(a: Column, b: Column, ambiguous: Column | None = None) -> Column:
    """0.80 + 0.15 * short / long where the tokens of the shorter name end those of the longer; else 0.

    A single token counts only if `ambiguous`, the array of tokens that several entities bear, is given and lacks it.
    """
    x, y = name_tokens(a), name_tokens(b)
    swap = F.size(x) <= F.size(y)
    short, long_ = F.when(swap, x).otherwise(y), F.when(swap, y).otherwise(x)
    n, m = F.size(short), F.size(long_)
    ends = F.slice(long_, F.greatest(m - n + 1, F.lit(1)), F.greatest(n, F.lit(1))) == short
    enough = n >= 2
    if ambiguous is not None:
        enough = enough | ((n == 1) & ~F.array_contains(ambiguous, F.get(short, F.lit(0))))
    return F.when((n < m) & enough & ends, F.lit(0.80) + F.lit(0.15) * n / m).otherwise(F.lit(0.0))


def trim_words(s: Column, words: tuple[str, ...], both: bool = True) -> Column:
    """A name without the words of a list at its start (and end)."""
    one = "(?:" + "|".join(words) + ")"
    out = F.regexp_replace(F.trim(s), rf"^(?:{one}(?:\s+|$))+", "")
    return F.trim(F.regexp_replace(out, rf"(?:(?:^|\s+){one})+$", "") if both else out)


def all_words_in(s: Column, words: tuple[str, ...]) -> Column:
    """Whether a name has words and all are of a list (an interjection in place of a name, say)."""
    tokens = F.filter(F.split(F.trim(s), r"\s+"), lambda t: t != "")
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.isin(*words))


def decoration_only(a: Column, b: Column) -> Column:
    """Whether two surfaces differ in honorifics and articles alone."""
    strip = lambda x: F.lower(strip_honorifics(x, articles=True))
    return (a != b) & (strip(a) == strip(b))


def is_progressive_rank(s: Column, ranks: tuple[str, ...]) -> Column:
    """Whether a surface holds a rank that advances with its bearer."""
    low = F.lower(F.trim(s))
    out = F.lit(False)
    for r in ranks:
        out = out | low.contains(r.lower())
    return out


def strip_rank(s: Column, ranks: tuple[str, ...]) -> Column:
    """A surface without the longest such rank at its start."""
    t = F.trim(s)
    out = t
    for r in sorted(ranks, key=len):
        out = F.when(F.lower(t).startswith(r.lower()), F.trim(F.substr(t, F.lit(len(r) + 1), F.length(t)))).otherwise(out)
    return out


def plausible_name(s: Column, most_chars: int = 48, most_tokens: int = 6) -> Column:
    """Whether a surface can be a name: length, tokens, no inner punctuation, a letter, a capital first."""
    t = F.regexp_replace(F.trim(s), r"[.!?;:,]+$", "")
    return F.length(t).between(2, most_chars) & (F.size(F.split(t, r"\s+")) <= most_tokens) & ~t.rlike("[.!?;:,]") & t.rlike(r"\p{L}") & t.rlike(r"^\p{Lu}")


def is_scale_term(s: Column) -> Column:
    t = F.trim(s)
    return t.rlike("(?i)" + rules.SCALE) | t.rlike("(?i)" + rules.BARE_SCALE)


def looks_like_credit(surface: Column, context: Column | None = None) -> Column:
    """Whether a surface, or what stands around it, speaks of translation credits."""
    p = r"(?i)\b(?:" + "|".join(map(re.escape, rules.CREDITS)) + r")\b"
    return surface.rlike(p) | (F.lit(False) if context is None else F.coalesce(context, F.lit("")).rlike(p))


def alias_type(s: Column, known: Column | None = None, ranks: tuple[str, ...] = (), address: Column | None = None) -> Column:
    """struct(type, confidence) of a surface. known: the type that a lexicon gives it, or null; address: whether it is used in direct address."""

    def rule(t: Column) -> Column:
        low, rest = F.lower(t), F.regexp_replace(t, r"(?i)^(?:the|a|an|that|this|those|these)\s+", "")
        head = F.lower(F.element_at(F.split(rest, r"\s+"), -1))
        led = t.rlike(r"(?i)^(?:the|a|an|that|this|those|these)\s+")
        kind = lambda k, c: F.struct(F.lit(k).alias("type"), F.lit(c).alias("confidence"))
        return (
            F.when(low.rlike("^(this|my|your|our) "), kind("RELATIONAL_DEICTIC", 0.75))
            .when((F.lit(False) if address is None else address) & (F.size(F.split(t, r"\s+")) <= 2), kind("RELATIONAL_DEICTIC", 0.6))
            .when(led & rest.rlike(rf"(?i)\b(?:{rules.EPITHET_WORDS})\b") & ~head.isin(*rules.ROLE_NOUNS), kind("EPITHET", 0.7))
            .when(led & (head.isin(*rules.ROLE_NOUNS) | ~rest.rlike(r"^\p{Lu}")), kind("GENERIC_DESCRIPTOR", 0.85))
            .when(led, kind("EPITHET", 0.5))
            .when(low.isin(*rules.ROLE_NOUNS), kind("GENERIC_DESCRIPTOR", 0.8))
            .when(t.rlike(r"^[A-Z][\w’'\-]*(?:\s+[A-Z][\w’'\-]*)*$"), kind("RIGID_NAME", 0.7))
            .otherwise(kind("GENERIC_DESCRIPTOR", 0.4))
        )

    t = F.trim(s)
    out = rule(t)
    if ranks:
        bare = strip_rank(t, ranks)
        inner = rule(bare)
        out = F.when((bare != t) & (bare != ""), F.struct(inner["type"].alias("type"), (inner["confidence"] * 0.9).alias("confidence"))).otherwise(out)
    if known is not None:
        out = F.when(known.isNotNull(), F.struct(known.alias("type"), F.lit(0.95).alias("confidence"))).otherwise(out)
    return F.when(t == "", F.struct(F.lit("GENERIC_DESCRIPTOR").alias("type"), F.lit(1.0).alias("confidence"))).otherwise(out)


def close_keys(a: Column, b: Column) -> Column:
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.levenshtein(a, b) == 1)


def shares_head(a: Column, b: Column) -> Column:
    return F.lower(F.element_at(F.split(a, r"\s+"), -1)) == F.lower(F.element_at(F.split(b, r"\s+"), -1))


def shares_surname(a: Column, b: Column) -> Column:
    return F.lower(F.element_at(F.split(a, r"\s+"), 1)) == F.lower(F.element_at(F.split(b, r"\s+"), 1))


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, used, hits = max(0, max(len(a), len(b)) // 2 - 1), [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, u in zip(b, used, strict=True) if u]
    m, swaps = len(hits), sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        j, p = _jaro(x, y), 0
        while p < min(4, len(x), len(y)) and x[p] == y[p]:
            p += 1
        out.append(j + p * 0.1 * (1 - j))
    return pd.Series(out, dtype="float64")


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro similarity with 0.1 for each of up to four common leading characters, at any level; null if either is."""
    return F.pandas_udf(_jaro_winkler, DoubleType())(a, b)
