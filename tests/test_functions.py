"""Fixtures for functions and operators, against values worked out by hand or by brute force."""

import random

from pyspark.sql import functions as F

from fabulon.functions import intervals as iv
from fabulon.functions import names, text
from fabulon.operators import log, mentions, resolve, sequence
from fabulon.operators.incremental import resolve_windows

INF = float("inf")


def one(spark, **columns):
    df = spark.createDataFrame([(0,)], "x int")
    return df.select(*[c.alias(k) for k, c in columns.items()]).first()


def test_interval_edges(spark):
    rows = spark.createDataFrame([(0.0, 2.0, 5.0, 9.0), (-INF, -INF, INF, INF), (3.0, 3.0, 3.0, INF)], "from_lb double, from_ub double, to_lb double, to_ub double")

    def at(p):
        return [r[0] for r in rows.select(iv.contains(iv.columns(), F.lit(float(p)))).collect()]

    assert at(-1) == ["EXCLUDED", "CERTAIN", "EXCLUDED"]
    assert at(2) == ["CERTAIN", "CERTAIN", "EXCLUDED"]
    assert at(5) == ["PLAUSIBLE", "CERTAIN", "PLAUSIBLE"]  # to_lb itself is only plausible
    assert at(9) == ["EXCLUDED", "CERTAIN", "PLAUSIBLE"]


def test_touching_intervals_are_disjoint(spark):
    a, b = (tuple(F.lit(float(x)) for x in t) for t in ((0, 0, 2, 2), (2, 2, 4, 4)))
    assert one(spark, o=iv.overlaps(a, b)).o == "EXCLUDED"
    assert one(spark, c=iv.conjunction(F.lit("CERTAIN"), F.lit("PLAUSIBLE"))).c == "PLAUSIBLE"


def test_names(spark):
    r = one(
        spark, key=names.comparison_key(F.lit("The Lord Klein-Moretti’s")), fold=names.normalize_alias(F.lit("  Straße  X ")), marks=names.strip_diacritics(F.lit("Éñû")),
        only=names.strip_honorifics(F.lit("Lord")), jw=names.jaro_winkler(F.lit("audrey"), F.lit("alger")), close=names.close_keys(F.lit("abc"), F.lit("abd")), same=names.close_keys(F.lit("abc"), F.lit("abc")),
        part=names.name_containment(F.lit("Klein Moretti"), F.lit("Gu Klein Moretti")), equal=names.name_containment(F.lit("Klein Moretti"), F.lit("Sir Klein Moretti")),
        known=names.name_containment(F.lit("Dokja"), F.lit("Kim Dokja"), F.array(F.lit("kim"))), shared=names.name_containment(F.lit("Kim"), F.lit("Yoo Kim"), F.array(F.lit("kim"))), single=names.name_containment(F.lit("Moretti"), F.lit("Klein Moretti")),
    )
    assert (r.key, r.fold, r.marks, r.only) == ("kleinmoretti", "strasse x", "Enu", "Lord")
    assert round(r.jw, 3) == 0.630 and r.close and not r.same
    assert round(r.part, 3) == 0.9 and r.single == r.equal == r.shared == 0 and round(r.known, 3) == 0.875


def test_text(spark):
    r = one(spark, t=text.ass_time(F.lit(3725.5)), a=text.block_type(F.lit("")), b=text.block_type(F.lit("[HP: 3]")), c=text.block_type(F.lit("T/N: so")), d=text.block_type(F.lit("He left.")), s=text.singular(F.lit("stories")))
    assert (r.t, r.a, r.b, r.c, r.d, r.s) == ("1:02:05.50", "NON_DIEGETIC", "SYSTEM_WINDOW", "TRANSLATOR_NOTE", "PROSE", "story")


def test_redirects_follow_chains(spark):
    m = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 5)], "from_id long, to_id long")
    assert {r.root for r in log.redirect_roots(m).collect()} == {40}


def test_numbering_continues(spark):
    base = spark.createDataFrame([(7,)], "seq long")
    got = log.numbered(spark.createDataFrame([(i,) for i in range(50)], "id long"), base, "seq", "id").orderBy("id").collect()
    assert [r.seq for r in got] == list(range(8, 58))


def test_merged_ranges_against_brute_force(spark):
    r = random.Random(1)
    rows = [(k, a, a + r.randint(0, 9)) for k in range(5) for a in [r.randint(0, 60) for _ in range(12)]]
    want = set()
    for k in range(5):
        cur = None
        for a, b in sorted((a, b) for x, a, b in rows if x == k):
            if cur and a <= cur[1]:
                cur[1] = max(cur[1], b)
            else:
                cur and want.add((k, *cur))
                cur = [a, b]
        want.add((k, *cur))
    got = sequence.merged_ranges(spark.createDataFrame(rows, "k int, a int, b int"), "k", "a", "b").collect()
    assert {(x.k, x.start, x.end) for x in got} == want


def test_gate_rules(spark):
    rows = [
        (1, 10, "SCORE", 0.0, 0.9, 0), (1, 11, "SCORE", 0.0, 0.5, 1), (2, 20, "SCORE", 0.0, 0.90, 0), (2, 21, "SCORE", 0.0, 0.88, 1),
        (3, 30, "BLOCK", 0.0, 0.99, 0), (4, 40, "SCORE", 0.0, 0.99, 0), (4, 41, "FORCE_LINK", 0.95, 0.1, 1), (5, 50, "SCORE", 0.0, 0.5, 0), (6, 60, "SCORE", 0.0, 0.2, 0),
    ]
    df = spark.createDataFrame(rows, "g int, candidate int, verdict string, confidence double, probability double, position int")
    got = {r.g: (r.decision, r.candidate) for r in resolve.gate(df, "g").collect()}
    assert got == {1: ("LINK", 10), 2: ("DEFER", 20), 3: ("NEW", None), 4: ("LINK", 41), 5: ("DEFER", 50), 6: ("NEW", None)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    phrases = spark.createDataFrame([("a b",)], "phrase string")
    assert mentions.dictionary_match(docs, "doc_id", text.words(F.col("text")), phrases, 2).count() == 0
    assert resolve.bm25(resolve.postings(docs, "doc_id", text.terms(F.col("text"))), spark.createDataFrame([], "query long, term string")).count() == 0


def test_incremental_resolver(spark):
    rows = [
        (1, 0, "klein", ["moretti", "detective", "gray"]), (2, 0, "audrey", ["hall", "noble", "golden"]),
        (3, 1, "klein", ["other"]), (4, 1, "sherlock", ["moretti", "detective", "gray"]), (5, 1, "fors", ["writer"]), (6, 1, "fors", ["writer", "novel"]),
    ]
    groups = spark.createDataFrame(rows, "group_id long, window long, key string, terms array<string>")
    got = {r.group_id: (r.entity, r.decision) for r in resolve_windows(groups, 1.5, 0.1).collect()}
    assert got == {1: (1, "NEW"), 2: (2, "NEW"), 3: (1, "LINK"), 4: (1, "LINK"), 5: (5, "NEW"), 6: (5, "NEW")}
    assert resolve_windows(groups.limit(0), 1.0, 0.5).count() == 0


def test_exact_calibration(spark):
    import math

    from fabulon.operators import evaluate

    rows = [(0.1234567 + i / 1000.0003, i % 3 == 0) for i in range(90)]
    e = spark.createDataFrame(rows, "score double, ok boolean")
    wrong, right = sorted((s for s, ok in rows if not ok), reverse=True), sorted(s for s, ok in rows if ok)
    r = evaluate.conformal(e, "score", "ok", digits=None).first()
    link = wrong[int(0.05 * len(wrong))]
    new = min(right[int(0.05 * len(right))], link - 0.05)
    assert r.link_threshold == link and r.new_threshold == new
    a, b = 1.0, 0.0
    for _ in range(200):
        err = [1 / (1 + math.exp(-(a * s + b))) - ok for s, ok in rows]
        a, b = a - 0.05 * sum(x * s for x, (s, _) in zip(err, rows, strict=True)) / 90, b - 0.05 * sum(err) / 90
    p = evaluate.platt(e, "score", "ok", digits=None).first()
    assert abs(p.a - a) < 1e-5 and abs(p.b - b) < 1e-5
