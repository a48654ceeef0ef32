"""Lookups, writes, corrections, retrieval and evidence against expectations written by hand."""

import json

import pytest
from pyspark.sql import functions as F

from fabulon.operators import corrections as c
from fabulon.operators import log
from fabulon.operators import lookups as lk
from fabulon.operators import retrieval as rt
from fabulon.operators import state


def one(spark, **columns):
    return spark.range(1).select(*[x.alias(k) for k, x in columns.items()]).first()


def test_lookups(spark):
    ch = spark.createDataFrame([("n", x) for x in (2.0, 1.0, 3.5)] + [("o", 1.0)], "novel_id string, number double")
    assert [r.number for r in lk.chapters_in_order(ch, "n", 1, 3).collect()] == [1.0, 2.0] and [r.number for r in lk.chapter_numbers(ch, "n").collect()] == [1.0, 2.0, 3.5]
    assert lk.chapter(ch, "n", 3.5).count() == 1 and {r.novel_id: r.n_chapters for r in lk.chapter_count(ch).collect()} == {"n": 3, "o": 1}
    seg = spark.createDataFrame([("a", "n", 1.0, 2.0, 5, "CANONICAL"), ("b", "n", 3.0, 4.0, 0, "CANONICAL"), ("c", "n", 2.0, 9.0, 0, "CANONICAL")], "id string, novel_id string, chapter_from double, chapter_to double, offset_from int, canonicity string")
    assert [r.id for r in lk.segments_overlapping(seg, "n", 2.0).collect()] == ["a", "c"]
    assert {r.id: r.canonicity for r in lk.voided(seg, ["b"]).collect()}["b"] == "VOIDED"
    s = spark.createDataFrame([("e", "n", None, "Elder Wang"), ("f", "n", "LOCATION", "Tingen")], "id string, novel_id string, kind string, canonical_label string")
    assert {r.id: r.kind for r in lk.entities(s).collect()} == {"e": "SELF", "f": "LOCATION"} and lk.entities(s, id_="f").count() == 1
    m = spark.createDataFrame([("e", 1.0, 0, 3, "PRESENT", "n", "RIGID_NAME", "Wang"), ("e", 1.0, 0, 9, "PRESENT", "n", "RIGID_NAME", "Wang"), (None, 2.0, 0, 0, "PRESENT", "n", "EPITHET", "x")], "target_id string, chapter double, block_index int, offset int, reference_mode string, novel_id string, alias_type string, text string")
    sp = spark.createDataFrame([("n", 4.0, 0, 0, "e")], "novel_id string, chapter double, block_index int, start int, speaker_self_id string")
    assert sorted((r.target_id, r.chapter) for r in lk.chapters_of(m, sp).collect()) == [("e", 1.0), ("e", 4.0)] and lk.body_presence(m).count() == 1
    assert [(r.speaker_self_id, r.key) for r in lk.speaker_keys(sp, s).collect()] == [("e", "wang")] and [tuple(r) for r in lk.mention_counts(m).collect()] == [("n", "e", 2)]
    a = spark.createDataFrame([("e", "SELF", "Old Wang", "EPITHET", 2), ("e", "SELF", "the man", "GENERIC_DESCRIPTOR", 1)], "target_id string, target_kind string, alias string, alias_type string, seq long")
    assert sorted(tuple(r) for r in lk.surfaces_of(a, m).collect()) == [("e", "Old Wang"), ("e", "Wang")] and [r.seq for r in lk.aliases_of(a, "SELF", "e").collect()] == [1, 2]
    r = one(spark, a=lk.reference_mode(F.lit("DIALOGUE")), b=lk.reference_mode(F.lit("NON_DIEGETIC")), c=lk.prominence(F.lit(30)), d=lk.is_transferable(F.lit("TAROT_TITLE")), e=lk.graph_dependent(F.lit("TEXT")), f=lk.is_visual(F.lit("DIALOGUE")))
    assert tuple(r) == ("DIALOGUE_REFERENCE", "NARRATOR_REFERENCE", "RECURRING", True, False, True)
    assert {x.id: x.prominence for x in lk.with_prominence(s, spark.createDataFrame([("e", 400)], "target_id string, n_mentions long")).collect()} == {"e": "PRINCIPAL", "f": "INCIDENTAL"}


def test_writes(spark):
    t = spark.createDataFrame([(1, "a"), (None, "b")], "id int, v string")
    assert sorted(lk.upserted(t, spark.createDataFrame([(None, "c"), (2, "d")], t.schema), ["id"]).collect(), key=str) == sorted(spark.createDataFrame([(1, "a"), (None, "c"), (2, "d")], t.schema).collect(), key=str)
    schema = "target_kind string, target_id string, timeline_id string, key string, value string, learned long, observer_id string, truth_status string, extra int"
    old = spark.createDataFrame([("SELF", "e", "main", "hair", None, 1, "READER", "TRUE", 0)], schema)
    new = spark.createDataFrame([("SELF", "e", "main", "hair", None, 1, "READER", "TRUE", 9), ("SELF", "e", "main", "hair", "red", 1, "READER", "TRUE", 1), ("SELF", "e", "main", "hair", "red", 1, "READER", "TRUE", 2)], schema)
    assert [r.value for r in lk.new_attributes(old, new).collect()] == ["red"]
    b = spark.createDataFrame([("x", 1.0, 1.0, 2.0, 2.0, None, "TRUE"), ("y", 1.0, 1.0, 2.0, 2.0, 5, "TRUE")], "id string, from_lb double, from_ub double, to_lb double, to_ub double, retracted long, truth_status string")
    assert {r.id: (r.retracted, r.truth_status) for r in lk.retracted(b, F.lit(True), F.lit(9)).collect()} == {"x": (9, "FALSE"), "y": (5, "TRUE")}
    assert {r.id: r.to_ub for r in lk.closed(b, F.col("id") == "x", 7, 8).collect()} == {"x": 8.0, "y": 2.0}
    al = spark.createDataFrame([("GENERIC_DESCRIPTOR", 0.0, 0.0, 1.0, 1.0), ("EPITHET", 2.0, 1.0, 1.0, 1.0), ("EPITHET", 0.0, 1.0, 1.0, 2.0)], "alias_type string, from_lb double, from_ub double, to_lb double, to_ub double")
    assert lk.insertable_aliases(al).count() == 1
    assert [tuple(r) for r in log.invalid_sequence(spark.createDataFrame([(1,), (2,), (2,)], "seq long")).collect()] == [(2, 2)]


@pytest.fixture(scope="module")
def made(spark):
    rows = [
        ("1", "merge_entities", {"from_id": "a", "into_id": "b"}, 1.0, False), ("2", "merge_entities", {"from_id": "b", "into_id": "c"}, 2.0, False),
        ("3", "reassign_mention", {"mention_id": "m2", "target_id": "z"}, 3.0, False), ("4", "reassign_mention", {"mention_id": "m3"}, 4.0, False),
        ("5", "reassign_mention", {"mention_id": "m4", "new_label": "Zoe"}, 5.0, False), ("6", "reassign_speaker", {"span_id": "s1", "chapter": 1.0, "anon_slot": 2}, 6.0, False),
        ("7", "reassign_span_type", {"span_id": "s1", "chapter": 1.0, "new_type": "INNER_MONOLOGUE"}, 7.0, False), ("8", "merge_lines", {"primary_span_id": "s2", "absorbed_span_id": "s3", "chapter": 1.0}, 8.0, False),
        ("9", "create_mention", {"span_id": "s1", "chapter": 1.0, "local_start": 3, "local_end": 6, "target_id": "a"}, 9.0, False), ("10", "flag", {}, 10.0, False), ("11", "merge_entities", {"from_id": "q", "into_id": "r"}, 11.0, True),
        ("12", "create_mention", {"span_id": "s1", "chapter": 1.0, "local_start": 3, "local_end": 99, "target_id": "a"}, 12.0, False),
    ]
    return spark.createDataFrame([(i, "n", k, json.dumps(p), t, d) for i, k, p, t, d in rows], "id string, novel_id string, type string, payload string, created_at double, applied boolean")


def test_corrections(spark, made):
    m = spark.createDataFrame([("m1", "a"), ("m2", "a"), ("m3", "b"), ("m4", "x"), ("m5", None), ("m6", "q")], "id string, target_id string")
    assert {r.id: r.target_id for r in c.corrected_mentions(m, made).collect()} == {"m1": "c", "m2": "z", "m3": None, "m4": "n:manual:5", "m5": None, "m6": "q"}
    sp = spark.createDataFrame([("s1", "n", 1.0, 0, 0, 6, "DIALOGUE", "go Klein", "a", "EXPLICIT"), ("s2", "n", 1.0, 1, 0, 3, "DIALOGUE", "One", None, None), ("s3", "n", 1.0, 1, 5, 9, "DIALOGUE", "two.", None, None)], "id string, novel_id string, chapter double, block_index int, start int, end int, span_type string, text string, speaker_self_id string, attribution_method string")
    blocks = spark.createDataFrame([("n", 1.0, 1, "One, two.")], "novel_id string, chapter double, block_index int, text string")
    got = {r.id: r for r in c.corrected_spans(sp, made, blocks).collect()}
    assert set(got) == {"s1", "s2"} and (got["s1"].speaker_self_id, got["s1"].attribution_method, got["s1"].span_type) == ("n:anon:1:2", "ANONYMOUS_SLOT", "INNER_MONOLOGUE")
    assert (got["s2"].text, got["s2"].start, got["s2"].end) == ("One, two.", 0, 9)
    assert [(r.id, r.offset, r.text) for r in c.created_mentions(sp, made).collect()] == [("n:correction:9:mention", 3, "Kle")]
    none = spark.createDataFrame([], "id string, novel_id string, canonical_label string")
    assert [(r.id, r.canonical_label) for r in c.manual_entities(made, none).collect()] == [("n:manual:5", "Zoe")] and c.manual_entities(made, c.manual_entities(made, none)).count() == 0
    ev = {r.id: (r.type, r.seq) for r in c.correction_events(made, spark.createDataFrame([(7,)], "seq long")).collect()}
    assert len(ev) == 10 and ev["n:correction:1"] == ("merge", 8) and ev["n:correction:4"][0] == "retract" and ev["n:correction:5"][0] == "rebind" and sorted(s for _, s in ev.values()) == list(range(8, 18))
    assert {r.type: (r.n, r.n_applied) for r in c.corrections_summary(made).collect()}["merge_entities"] == (3, 1)
    assert {r.target_id: r.n for r in c.redirected(spark.createDataFrame([("a", 2), ("c", 3), ("x", 1)], "target_id string, n long"), made).collect()} == {"c": 5, "x": 1}
    b = spark.createDataFrame([("a", "old wang", None), ("a", "old wang", 3), ("b", "old wang", None)], "target_id string, alias_norm string, retracted long")
    x = spark.createDataFrame([("a", ["Old  Wang"], "CO_PRESENCE", "d", 0.8)], "target_id string, surfaces array<string>, kind string, detail string, confidence double")
    assert c.retractable(b, x).count() == 1 and [r.seq for r in c.split_events(x, spark.createDataFrame([(4,)], "seq long")).collect()] == [5]
    d = spark.createDataFrame([(1.0, "w", "an")], "chapter double, identity string, surface string")
    assert [(r.offset, r.context) for r in c.draft_positions(spark.createDataFrame([(1.0, 0, "an anna an")], "chapter double, block_index int, text string"), d, 3).orderBy("offset").collect()] == [(0, "an an"), (8, "na an")]


def test_redirects(spark):
    pairs = [(1, 2), (2, 1), (3, 1), (10, 11), (11, 12), (12, 13), (20, 22), (22, 21), (21, 20), (19, 22), (30, 30)]
    got = {r.from_id: r.root for r in log.redirect_roots(spark.createDataFrame(pairs, "from_id long, to_id long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 13, 11: 13, 12: 13, 20: 20, 21: 20, 22: 20, 19: 20, 30: 30}
    assert log.redirect_roots(spark.createDataFrame([], "from_id long, to_id long")).count() == 0


def test_retrieval(spark):
    rows = [("w", "Elder Wang", 1.0, "the sword of the clan"), ("w", "Wang", 2.0, "sword sword"), ("l", "Li Bo", 1.0, "river boat"), ("k", "Klein", 3.0, "fog castle")]
    m = spark.createDataFrame(rows, "target_id string, text string, chapter double, context string")
    a = m.select("target_id", F.col("text").alias("alias"))
    q = spark.createDataFrame([(1, "Wang", "a sword"), (2, "Nobody", "the fog"), (3, "zzz", "")], "query int, surface string, context string")
    got = {}
    for r in rt.retrieve(q, m, a, 2).collect():
        got.setdefault(r.query, []).append((r.rank, r.id, round(r.score, 4)))
    assert got[1][0][1] == "w" and got[1][0][2] > 0.65 and got[2] == [(1, "k", round(0.35 / 2**0.5, 4))] and 3 not in got
    p = {r.target_id: r for r in rt.profiles(m).collect()}
    assert (p["w"].label, p["w"].n_mentions, p["w"].first_chapter, p["w"].last_chapter) == ("Elder Wang", 2, 1.0, 2.0)
    al = spark.createDataFrame([("x", "Kim Dokja"), ("y", "Kim Namwoon"), ("x", "Dokja")], "target_id string, alias string")
    assert [r.token for r in rt.ambiguous_tokens(al).collect()] == ["kim"]
    k = spark.createDataFrame([("a", "location"), ("a", "location"), ("b", "location"), ("b", "character"), ("c", None), ("d", "item"), ("d", "location"), ("e", "organization")], "g string, entity_label string")
    assert {r.g: r.kind for r in rt.entity_kind(k, ["g"]).collect()} == {"a": "LOCATION", "b": "SELF", "c": "SELF", "d": "SELF", "e": "ORGANIZATION"} and {r.g for r in rt.not_characters(k, ["g"]).collect()} == {"a", "e"}
    assert sorted(tuple(r) for r in rt.self_retrieval_cases(m, a, 1).collect()) == [("w", "Elder Wang")]
    g = spark.createDataFrame([("m1", "I", "w"), ("m2", "I", "w"), ("m3", "I", "l")], "mention_id string, identity string, target_id string")
    s = spark.createDataFrame([("m1", "w", 0.9), ("m3", "l", 0.2)], "mention_id string, target_id string, score double")
    assert sorted((r.mention_id, r.correct) for r in rt.calibration_samples(s, g).collect()) == [("m1", True), ("m3", False)]
    n = rt.entity_ids(spark.createDataFrame([("A", "SELF", 2), ("B", "SELF", 1)], "label string, kind string, order int"), "n", spark.createDataFrame([("n:self4",), ("n:manual:1",)], "id string"))
    assert {r.label: r.id for r in n.collect()} == {"B": "n:self5", "A": "n:self6"}
    attrs = spark.createDataFrame([("w", "hair", "red", "READER", 1), ("w", "hair", "grey", "SYSTEM", 2), ("w", "eyes", "x", "G1", 3)], "target_id string, key string, value string, observer_id string, seq long")
    w = rt.wiki(m, a, attrs).collect()
    assert [r.target_id for r in w] == ["w"] and w[0].aliases == ["Elder Wang", "Wang"] and w[0].terms[0] == "sword" and w[0].attributes == {"hair": "grey"}


def test_evidence(spark):
    t = F.lit
    r = one(
        spark, a=rt.declared(t("His True Name was X"), ("true name was",)), b=rt.continuity(t("Memories flooded Fang's mind; he was Klein now."), t("Fang"), t("Klein")), c=rt.continuity(t("His memories surfaced, Fang and Klein"), t("Fang"), t("Klein")),
        d=rt.continuity(t("came memories flooded"), t("a"), t("Klein")), e=rt.audience_scope(t("Tingen"), F.array(t("x")), F.array(t("tingen"))), f=rt.audience_scope(t(""), F.array(t("x")), F.array(t("y"))), w=rt.terms(t("The Fox's (fog), and the dogs—")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (1.0, 1.0, 0.0, 0.0, 1.0, None) and r.w == ["fox's", "fog", "dogs"]
    schema = "pair int, text string, alias_type string, chapter double, context string, speaker string, target_id string, label string, first_chapter double, certainty string, cosine double, partners map<string,long>, co_present array<string>, concurrent array<string>, scene_scope string, known_scopes array<string>, terms array<string>, ambiguous array<string>"
    pairs = spark.createDataFrame([(1, "Wang", "RIGID_NAME", 5.0, "x", "A", "w", "Elder Wang", 1.0, "PLAUSIBLE", 0.5, {"A": 1, "B": 7}, ["Elder Wang"], [], None, [], None, None), (2, "Mo Bei", "RELATIONAL_DEICTIC", 1.0, "x", "A", "g", "Gu Yue Mo Bei", 2.0, "CERTAIN", None, None, ["Gu Yue Mo Bei"], [], "Fog", ["f"], ["fog"], None), (3, "Zed", "RIGID_NAME", 1.0, "x", None, "n", "Li", 1.0, "EXCLUDED", 0.0, None, ["Li"], [], None, [], None, None)], schema)
    al = spark.createDataFrame([("w", "Elder Wang"), ("w", "Old Wang"), ("g", "Gu Yue Mo Bei"), ("n", "Li")], "target_id string, alias string")
    got = {x.pair: x for x in rt.evidence(pairs, al).collect()}
    x = got[1]
    assert (x.gazetteer_exact_match, x.surface_similarity, x.temporal_validity, x.speech_partner_compatibility, x.co_presence_violation) == (1.0, 1.0, 0.5, 0.5, 0.0)
    x = got[2]
    assert round(x.name_containment, 3) == 0.875 and x.co_presence_violation == 0.0 and x.first_attested_soft_prior == -1.0 and x.relationship_deictic_resolution == 0.5 and x.audience_scope_compatibility == 1.0
    assert got[3].co_presence_violation == 1.0 and got[3].temporal_validity == 0.0
    e = rt.evidence(pairs, al).select("pair", rt.explained({"temporal_validity": 1.0, "name_containment": -3.0}).alias("e")).filter("pair = 2").first()
    assert [f.feature for f in e.e] == ["name_containment", "temporal_validity"]


def test_detectors(spark):
    b = spark.createDataFrame([(1, "Fang Yuan succeeded Old Li. Klein turned out to be Zhou Mingrui. Dunn was killed. The new Sect Master came.")], "c int, text string")
    got = {(r.kind, r.subject, r.object) for r in rt.event_detectors(b, ["c"]).collect()}
    assert ("REVEAL", "Klein", "Zhou Mingrui") in got and ("DEATH", "Dunn", None) in got and any(k == "TRANSFER" and s == "Fang Yuan" for k, s, _ in got)


def test_state_by_hand(spark):
    fact = "target_id string, timeline_id string, from_lb double, from_ub double, to_lb double, to_ub double, learned long, observer_id string, truth_status string, retracted long, seq long"
    base = lambda seq, learned=1, who="READER", truth="TRUE", gone=None, lo=0.0, hi=float("inf"): ("e", "main", lo, lo, hi, hi, learned, who, truth, gone, seq)
    al = spark.createDataFrame([(*base(1), "Old Wang", "old wang"), (*base(2), "old  wang", "old wang"), (*base(3, gone=5), "Liar", "liar"), (*base(4, who="G1"), "Secret", "secret")], fact + ", alias string, alias_norm string")
    at = spark.createDataFrame([(*base(1), "hair", "red"), (*base(2, learned=3), "hair", "grey"), (*base(3, learned=3), "hair", "white"), (*base(4, learned=99), "hair", "late"), (*base(5, truth="FALSE"), "eyes", "x"), (*base(6, lo=50.0), "age", "old")], fact + ", key string, value string")
    pe = spark.createDataFrame([(*base(1, truth="FALSE"), "body2"), (*base(2, learned=99), "body3")], fact + ", persona_id string")
    re_ = spark.createDataFrame([(*base(1), "brother", "f")], fact + ", type string, dst_self string")
    rq = spark.createDataFrame([("e", 10.0, "READER", 10), ("e", 10.0, "SYSTEM", 10), ("e", 10.0, "G9", 10), ("none", 10.0, "READER", 10)], "target_id string, position double, observer string, known long")
    got = {(r.target_id, r.observer): r for r in state.state_of(rq, al, at, re_, pe, novel_id="n").collect()}
    r = got["e", "READER"]
    assert (r.aliases, r.attributes, [tuple(x) for x in r.relationships], r.persona_ids, r.certainty) == (["Old Wang"], {"hair": "white"}, [("brother", "f")], ["body2"], "CERTAIN")
    assert r.read_set == ["alias:n:old wang", "persona:body2", "self:e", "self:f"]
    s = got["e", "SYSTEM"]
    assert s.aliases == ["Old Wang", "Liar", "Secret"] and s.attributes == {"hair": "late", "eyes": "x"} and s.persona_ids == ["body2", "body3"]
    assert got["e", "G9"].aliases == [] and got["none", "READER"].certainty == "CERTAIN" and got["none", "READER"].read_set == ["self:none"]
    assert [r.value for r in state.facts_as_of(at, ["target_id"], "key", "value", F.lit(3)).filter("key = 'hair'").collect()] == ["white"]
    d = one(spark, a=state.known_by_default(F.lit(4.5), F.lit("main")), b=state.known_by_default(F.lit(4.5), F.lit("dream")))
    assert tuple(d) == (4, 10**6)
    body = spark.createDataFrame([("e", "body1", 0.0, 0.0, 5.0, 5.0, 1), ("e", "body2", 5.0, 5.0, float("inf"), float("inf"), 2)], "target_id string, persona_id string, from_lb double, from_ub double, to_lb double, to_ub double, seq long")
    ch = spark.createDataFrame([("e", x) for x in (1.0, 4.0, 5.0, 9.0)], "target_id string, chapter double")
    assert {r.persona_id: r.chapters for r in state.chapters_by_body(ch, body).collect()} == {"body1": [1.0, 4.0], "body2": [5.0, 9.0]}
