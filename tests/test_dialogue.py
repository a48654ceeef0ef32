"""Speakers and references against expectations written by hand."""

from pyspark.sql import functions as F

from fabulon.operators import anaphora as an
from fabulon.operators import dialogue as d


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_tiers(spark):
    none = F.array().cast("array<string>")
    known = F.array(*[F.lit(x) for x in ("Klein", "wang")])
    t = F.lit
    r = one(
        spark, a=d.explicit(t(""), t("Klein quickly said."), none), b=d.explicit(t("Elder Wang asked:"), t("he left"), known), c=d.explicit(t(""), t("London said."), known), j=d.explicit(t(""), t("Klein and Elder Wang both said"), known),
        e=d.epithet(t("the Gu Yue clan head instructed.")), p=d.proximal(t("Wu Liao nodded, but Wu An turned."), t(""), none), q=d.pronoun_epithet(t(""), t("he said."), t("the clan head")), n=d.pronoun_epithet(t(""), t("he said."), t(None).cast("string")),
        two=d.turn(F.array(t("A"), t("B"), t("A"))), three=d.turn(F.array(t("A"), t("B"), t("C"))), m=d.epithet_mentioned(t("Then the Gu Yue clan head curled up")),
    )
    assert (r.a.speaker, r.a.method, r.a.confidence) == ("Klein", "EXPLICIT", 0.95) and r.b.speaker == "Elder Wang" and r.c is None
    assert (r.j.speaker, r.j.co_speaker, r.j.method) == ("Klein", "Elder Wang", "JOINT") and (r.e.speaker, r.e.confidence) == ("the Gu Yue clan head", 0.55)
    assert r.p.speaker == "Wu An" and r.q.confidence == 0.45 and r.n is None and r.two.speaker == "B" and r.three is None and r.m == "the Gu Yue clan head"


def test_ladder(spark):
    lines = [
        (0, "“One.” Klein said."), (1, "“Two,” Dunn asked."), (2, "“Three.”"), (3, "“Four.”"), (4, "* * *"), (5, "“Five.”"), (6, "Then the clan head frowned."), (7, "“Six,” he said."), (8, "“Wow!”"),
    ]
    blocks = spark.createDataFrame([(1.0, i, t) for i, t in lines], "chapter double, block_index int, text string")
    spans = []
    for i, t in lines:
        if t.startswith("“"):
            cut = t.index("”") + 1
            spans.append((1.0, i, 0, f"{i}a", "CROWD_REACTION" if i == 8 else "DIALOGUE", t[:cut]))
            if t[cut:].strip():
                spans.append((1.0, i, cut, f"{i}b", "NARRATION_ACTION", t[cut:].strip()))
        else:
            spans.append((1.0, i, 0, f"{i}a", "NARRATION_ACTION", t))
    s = spark.createDataFrame(spans, "chapter double, block_index int, start int, id string, span_type string, text string")
    got = {r.id: (r.speaker, r.method) for r in d.ladder(s, blocks, ["chapter"]).collect()}
    assert got["0a"] == ("Klein", "EXPLICIT") and got["1a"] == ("Dunn", "EXPLICIT")
    assert got["2a"] == ("Dunn", "EXPLICIT")  # the tag of the block before is still in sight
    assert got["3a"][1] == "TURN_TAKING" and got["5a"] == (None, "UNRESOLVED") and got["7a"] == ("the clan head", "EPITHET_SLOT") and got["8a"] == (None, "UNATTRIBUTED_CHORUS")
    assert got["0b"] == (None, "UNRESOLVED")


def test_rosters_and_recovery(spark):
    s = spark.createDataFrame([(1.0, "Elder Wang"), (2.0, "Klein"), (2.0, None)], "chapter double, speaker string")
    got = {r.chapter: set(r.known) for r in d.growing_roster(s).collect()}
    assert got == {1.0: {"Elder Wang", "wang"}, 2.0: {"Elder Wang", "wang", "Klein", "klein"}}
    spans = spark.createDataFrame([("a", 1.0, 0, 10, 20, "DIALOGUE", None), ("b", 1.0, 0, 90, 99, "DIALOGUE", None)], "id string, chapter double, block_index int, start int, end int, span_type string, speaker string")
    links = spark.createDataFrame([(1.0, 0, 12, "x", 0.9), (1.0, 0, 30, "y", 0.5), (1.0, 0, 4, "z", 0.8)], "chapter double, block_index int, offset int, mention_id string, confidence double")
    assert [(r.id, r.mention_id, round(r.confidence, 3)) for r in d.recovered(spans, None, links).collect()] == [("a", "z", 0.64)]
    m = spark.createDataFrame([(1, 100, "A", "RIGID_NAME"), (1, 150, "A", "RIGID_NAME"), (1, 460, "B", "RIGID_NAME"), (1, 900, "B", "RIGID_NAME")], "chapter int, offset int, text string, alias_type string")
    i = spark.createDataFrame([(1, 120, "INNER_MONOLOGUE"), (1, 950, "DIALOGUE")], "chapter int, start int, span_type string")
    assert [tuple(r) for r in d.pov_holder(m, i, ["chapter"]).collect()] == [(1, "A")]
    runs = spark.createDataFrame([(1, i, k, t) for i, (k, t) in enumerate([("DIALOGUE", "a"), ("NARRATION_ACTION", "x"), ("DIALOGUE", "b"), ("DIALOGUE", "c"), ("DIALOGUE", "l" * 90), ("DIALOGUE", "d"), ("DIALOGUE", "e")])], "c int, n int, span_type string, text string")
    assert [r.span_type for r in d.crowd_runs(runs, ["c"]).orderBy("n").collect()] == ["CROWD_REACTION", "NARRATION_ACTION", "CROWD_REACTION", "CROWD_REACTION", "DIALOGUE", "DIALOGUE", "DIALOGUE"]


def test_chapter_spans(spark):
    b = spark.createDataFrame([("n", 1.0, 0, "PROSE", "“Go,” he said coldly. <x>", None), ("n", 1.5, 1, "SYSTEM_WINDOW", "[A: b]", None), ("n", 2.0, 0, "HEADING", "One", None)], "novel_id string, chapter double, block_index int, block_type string, text string, italic_ranges array<struct<start:int,end:int>>")
    got = [(r.id, r.span_type, r.text, r.delivery_markers) for r in d.chapter_spans(b).orderBy("id").collect()]
    assert got == [("n:1.5:1:0", "SYSTEM_WINDOW", "[A: b]", []), ("n:1:0:0", "DIALOGUE", "“Go,”", []), ("n:1:0:1", "NARRATION_ACTION", "he said coldly. <x>", ["coldly"]), ("n:2:0:0", "NON_DIEGETIC", "One", [])]


def test_antecedents(spark):
    r = one(spark, p=an.pronouns(F.lit("She saw him. Herself?")), k=an.kinship_terms(F.lit("Uncle left"), F.lit(5)))
    assert [(x.text, x.start, x.gender, x.number) for x in r.p] == [("She", 0, "f", "sg"), ("him", 8, "m", "sg"), ("Herself", 13, "f", "sg")] and [(x.text, x.start) for x in r.k] == [("Uncle", 5)]
    m = spark.createDataFrame([(1, "a", 0, "Ann", "RIGID_NAME", "f"), (1, "b", 50, "Bob", "RIGID_NAME", "m"), (1, "c", 60, "x", "GENERIC_DESCRIPTOR", "m"), (1, "u", 500, "Uma", "EPITHET", None)], "c int, id string, offset int, text string, alias_type string, gender string")
    said = spark.createDataFrame([(1, 80, "f"), (1, 90, "m"), (1, 95, "n"), (1, 520, "m"), (1, 2000, "f"), (1, 0, "f")], "c int, start int, gender string")
    got = {r.start: (r.mention_id, round(r.confidence, 3), r.rule[:6]) for r in an.antecedents(said, m, ["c"]).collect()}
    assert got == {80: ("a", 0.95, "unique"), 90: ("b", 0.95, "unique"), 95: ("b", 0.6, "neares"), 520: ("u", 0.6, "neares")}
    g = spark.createDataFrame([("A", "he and his father"), ("B", "she"), ("C", "she, her; he")], "name string, text string")
    assert {r.name: r.gender for r in an.genders(g, ["name"]).collect()} == {"A": "m", "B": "n", "C": "n"}


def test_kinship(spark):
    m = spark.createDataFrame([(1, 0, 0, "w", "Uncle Wang", "RIGID_NAME"), (1, 1, 6, "g", "Gu", "RIGID_NAME"), (1, 2, 40, "f", "Far", "RIGID_NAME")], "c int, block_index int, offset int, id string, text string, alias_type string")
    t = spark.createDataFrame([(1, 0, 0, 5, "Uncle"), (1, 1, 0, 5, "uncle"), (1, 2, 0, 5, "Uncle"), (1, 2, 8, 12, "Aunt")], "c int, block_index int, start int, end int, text string")
    got = {(r.block_index, r.text): (r.mention_id, r.rule) for r in an.kinship(t, m, ["c"]).collect()}
    assert got == {(0, "Uncle"): ("w", "kinship_fused"), (1, "uncle"): ("g", "kinship_apposed_name"), (2, "Uncle"): ("g", "kinship_sticky_binding")}


def test_groups_split(spark):
    rows = [("g", "1", 1.0, 0, 0, "Wang", "PRESENT"), ("g", "2", 1.0, 0, 100, "Elder Wang", "PRESENT"), ("g", "3", 1.0, 7, 900, "Wang", "NARRATOR_REFERENCE"), ("h", "4", 1.0, 0, 0, "Li", "PRESENT"), ("h", "5", 2.0, 9, 50, "Li Bo", "PRESENT")]
    m = spark.createDataFrame([("n", *r) for r in rows], "novel_id string, group_id string, id string, chapter double, block_index int, offset int, text string, reference_mode string")
    seg = spark.createDataFrame([("n", 1.0, 2.0, 5, 8, "dream"), ("n", 2.0, 2.0, 9, 9, "late")], "novel_id string, chapter_from double, chapter_to double, offset_from int, offset_to int, timeline_id string")
    timed = an.timeline_of(m, seg)
    assert {r.id: r.timeline_id for r in timed.collect()} == {"1": "main", "2": "main", "3": "dream", "4": "main", "5": "late"}
    got = {(r.group_id, r.part): (r.label, r.mention_ids, r.violation) for r in an.validated(timed, ["novel_id"]).collect()}
    assert got == {("g", "main~Wang"): ("Wang", ["1"], "CO_PRESENCE"), ("g", "main~Elder Wang"): ("Elder Wang", ["2"], "CO_PRESENCE"), ("g", "dream"): ("Wang", ["3"], "LAYER_BOUNDARY"), ("h", "main"): ("Li", ["4"], "LAYER_BOUNDARY"), ("h", "late"): ("Li Bo", ["5"], "LAYER_BOUNDARY")}
    calm = {(r.group_id, r.part) for r in an.validated(timed, ["novel_id"], spark.createDataFrame([("g",)], "group_id string")).collect()}
    assert ("g", "main") in calm and len(calm) == 4
    assert [tuple(r) for r in an.present_cast(m, ["chapter"]).orderBy("chapter").collect()] == [(1.0, ["Elder Wang", "Li", "Wang"]), (2.0, ["Li Bo"])]


def test_routes(spark):
    s = spark.createDataFrame([("a", "CROWD_REACTION", 0, "he!", None, None), ("b", "INNER_MONOLOGUE", 10, "I know my way", "Klein", None), ("c", "NARRATION_ACTION", 0, "Wu An said nothing. He left. Senior Brother said so.", None, "Wu An")], "id string, span_type string, start int, text string, pov string, speaker string")
    rel = spark.createDataFrame([("Wu An", "senior brother", "Li")], "speaker string, role string, referent string")
    found = spark.createDataFrame([("a", 0, "X", 0.6), ("c", 20, "Y", 0.6), ("c", 2, "Z", 0.7)], "id string, start int, name string, confidence double")
    got = {(r.id, r.at): (r.referent, r.route) for r in an.routed(s, found, rel, F.col("pov")).collect()}
    assert got == {("a", 0): (None, "UNATTRIBUTED_CHORUS"), ("b", 10): ("Klein", "POV_FIRST_PERSON"), ("b", 17): ("Klein", "POV_FIRST_PERSON"), ("c", 20): ("Wu An", "ATTRIBUTION_ADJACENCY"), ("c", 29): ("Li", "RELATIONSHIP_GRAPH"), ("c", 2): ("Z", "NEAREST_ANTECEDENT")}
    r = one(spark, a=an.needs_model(F.lit("he said so"), F.array(F.lit(0))), b=an.needs_model(F.lit("he said so"), F.array(F.lit(3))), m=an.method_of(F.lit("LLM_PARAGRAPH")))
    assert (r.a, r.b, r.m) == (False, True, "CONTEXTUAL_LLM")
    p = spark.createDataFrame([(1, "He ran. he sat.", ["Klein"])], "c int, text string, cast array<string>")
    said = lambda df: spark.createDataFrame([(1, "He", 2, "Klein"), (1, "he", 3, "Klein"), (1, "he", 1, "Nobody")], "c int, pronoun string, occurrence int, referent string")
    assert [(r.at, r.referent) for r in an.by_model(p, said, ["c"]).collect()] == [(8, "Klein")]
