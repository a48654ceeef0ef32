"""Names in text against expectations written by hand."""

from pyspark.sql import functions as F

from fabulon.functions import names, text
from fabulon.operators import gazetteer as g


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_find_longest_first(spark):
    aliases = spark.createDataFrame([("Wang", "RIGID_NAME", "w"), ("Sect Master Wang", "TRANSFERABLE_TITLE", "s"), ("Shi-Cheng", "RIGID_NAME", "c"), ("the guard", "GENERIC_DESCRIPTOR", None), ("X", "RIGID_NAME", "x"), ("Veil", "RIGID_NAME", "v")], "alias string, alias_type string, target_id string")
    d = g.admitted(aliases, ("veil",))
    assert {r.key for r in d.collect()} == {"wang", "sectmasterwang", "shicheng"}
    texts = spark.createDataFrame([(1, "Sect  Master Wang's son met Wang, ShiCheng and Shi Cheng. Wangs? the guard, veil"), (2, None)], "id int, text string")
    got = [(r.start, r.surface, r.target_id) for r in g.find(texts, ["id"], d).orderBy("start").collect()]
    assert got == [(0, "Sect  Master Wang", "s"), (28, "Wang", "w"), (34, "ShiCheng", "c"), (47, "Shi Cheng", "c")]
    found = {(r.text, r.method) for r in g.detect(texts.withColumn("text", F.concat("text", F.lit(" Then Ba De left. ")).alias("text")), ["id"], d).collect()}
    assert ("Ba De", "SCORED") in found and ("Wang", "GAZETTEER_EXACT") in found and not any(t == "Wang" and m == "SCORED" for t, m in found)


def test_places_and_harvest(spark):
    rows = spark.createDataFrame([(1, "ana banana ana")], "id int, text string")
    s = spark.createDataFrame([(1, "ana"), (1, "a"), (1, "x y")], "id int, surface string")
    assert sorted(r.start for r in g.located(rows, ["id"], s).collect()) == [0, 5, 7, 11]
    r = one(spark, h=g.harvest(F.lit('Then Ba De quietly said no. "Master Li, go," urged Fang Yuan.')), t=g.harvest_title(F.lit("The Fall of Gu Yue Village")), c=g.candidate_names(F.lit("The Gate. Fang Yuan met He Lo")))
    assert {(x.name, x.source) for x in r.h} == {("Ba De", "attribution"), ("Master Li", "address"), ("Fang Yuan", "attribution")}
    assert r.t == ["Gu Yue Village"] and r.c == ["Fang Yuan"]
    blocks = spark.createDataFrame([(2.0, "Elder Wang said yes. Wang replied."), (3.0, "Wang asked."), (1.0, "Indeed said Hmm.")], "chapter double, text string")
    got = {x.key: x for x in g.seed(blocks).collect()}
    assert set(got) == {"wang"} and (got["wang"].n, got["wang"].first_chapter, got["wang"].surface) == (3, 2.0, "Wang")


def test_commonness_and_credits(spark):
    t = spark.createDataFrame([("The gate and a gate. His gates, gate gate gate gate gate gate.",), ("Klein left. Klein came. Klein, Klein, Klein Klein Klein Klein.",), ("Translator: Foo Bar. Edited by Foo Bar. Foo Bar is a translator.",)], "text string")
    c = spark.createDataFrame([("Gate",), ("Klein",), ("Rank One",), ("Foo Bar",)], "surface string")
    got = {r.surface: r for r in g.commonness(t, c).collect()}
    assert got["gate"].total == 8 and got["gate"].determiner_rate == 0.25 and got["gate"].common and abs(got["gate"].plural_rate - 1 / 9) < 1e-9
    assert not got["klein"].common and got["klein"].total == 8 and got["rank one"].common and not got["foo bar"].common
    assert [r.surface for r in g.credited(t, c).collect()] == ["foo bar"]


def test_handoffs(spark):
    old, new = [f"Shi Cheng{chr(97 + i)}" for i in range(22)], [f"Shi-Cheng{chr(97 + i)}" for i in range(22)]
    spell = lambda i: " and ".join(x.replace("-C", "C").replace("ShiC", "Shic") for x in (old if i < 8 else new))
    rows = [(float(i + 1), f"they saw {spell(i)} there") for i in range(16)]
    got = g.handoffs(spark.createDataFrame(rows, "chapter double, text string")).collect()
    assert [(r.chapter, r.changed_forms) for r in got] == [(9.0, 22)]
    assert g.handoffs(spark.createDataFrame(rows[:7], "chapter double, text string")).count() == 0


def test_samples_and_tiers(spark):
    c = spark.range(10).select((F.col("id") + 1).cast("double").alias("number"))
    assert sorted(r.number for r in g.even_sample(c, 4).collect()) == [1.0, 3.0, 6.0, 8.0] and g.even_sample(c, 40).count() == 10
    r = one(spark, a=g.support_tier(F.lit(5)), b=g.support_tier(F.lit(2)), c=g.support_tier(F.lit(1)))
    assert (r.a, r.b, r.c) == ("HIGH", "MEDIUM", "LOW")
    f = spark.createDataFrame([(1, "Klein!", "character"), (1, "Klein", "location"), (1, "he left, fast", "character"), (1, "Tingen", "location"), (1, "x", "character")], "chapter int, surface string, label string")
    assert sorted((x.surface, x.label) for x in g.extracted_names(f, ["chapter"]).collect()) == [("Klein", "character"), ("Tingen", "location")]


def test_text_rules(spark):
    r = one(
        spark, at=text.find_all(F.lit("abcabXab"), "ab"), none=text.find_all(F.lit(None).cast("string"), "a"), word=text.word_find_all(F.lit("an anna an"), "an"),
        d=text.delivery_markers(F.lit('"quietly, go!" he said coldly, in a low voice.')), m=text.masked_quotes(F.lit('a "b c" d')), flat=text.dominant_polarity(text.delivery_markers(F.lit("shouted calmly"))),
        mobs=text.mobs(F.lit("Enemies surrounded him. The clan elders and a group of disciples.")), f=text.system_fields(F.lit("【Name: Klein\n- Level：7\nName: Zhou】")),
        kinds=F.transform(F.array(*[F.lit(x) for x in ("Read more at foo.com now on x.net", "Copyright 2020", "Author's note: hi", "TL note", "[Level: 7]", "Level: 7\nStatus: ok", "He went.", "  ", "note: it was translated")]), lambda x: text.block_type(x)),
        heads=F.array(text.block_type(F.lit("Characters"), F.lit(True)), text.block_type(F.lit("One"), F.lit(True))), marks=text.narrative_markers(F.lit("Two years later he awoke. Back then, many years ago.")), br=text.narrative_markers(F.lit(" * * * ")),
        only=text.narrative_markers(F.lit("he awoke"), text.marker_set()), key=names.comparison_key(F.lit("Young Master Shi-Chengs")), a=names.alias_type(F.lit("the Crimson Emperor")), b=names.alias_type(F.lit("the old innkeeper")), c=names.alias_type(F.lit("this old man")),
        e=names.alias_type(F.lit("Golden Core Elder Wang"), ranks=("golden core",)), scale=names.is_scale_term(F.lit("Stage 3")), deco=names.decoration_only(F.lit("The Elder Wang"), F.lit("Wang")), rank=names.strip_rank(F.lit("Golden Core Wang"), ("golden", "golden core")),
    )
    assert [(x.start, x.end) for x in r.at] == [(0, 2), (3, 5), (6, 8)] and r.none == [] and [x.start for x in r.word] == [0, 8]
    assert [(x.text, x.polarity) for x in r.d] == [("coldly", "COLD"), ("in a low voice", "HUSHED")] and r.m == "a       d" and r.flat == "FLAT"
    assert [(x.text, x.role) for x in r.mobs] == [("The clan elders", "elders"), ("a group of disciples", "disciples"), ("Enemies surrounded", "enemies")]
    assert r.f == {"Level": "7", "Name": "Zhou"}
    assert r.kinds == ["NON_DIEGETIC", "NON_DIEGETIC", "AUTHOR_NOTE", "TRANSLATOR_NOTE", "SYSTEM_WINDOW", "SYSTEM_WINDOW", "PROSE", "NON_DIEGETIC", "TRANSLATOR_NOTE"]
    assert r.heads == ["NON_DIEGETIC", "HEADING"] and [x.kind for x in r.br] == ["SCENE_BREAK"] and r.only == []
    assert [(x.kind, x.text) for x in r.marks] == [("TIME_SKIP", "Two years later"), ("EXIT_DREAM", "he awoke"), ("ENTER_FLASHBACK", "Back then"), ("ENTER_FLASHBACK", "many years ago")]
    assert r.key == "shicheng" and (r.a.type, r.a.confidence) == ("EPITHET", 0.7) and (r.b.type, r.b.confidence) == ("GENERIC_DESCRIPTOR", 0.85) and r.c.type == "RELATIONAL_DEICTIC"
    assert (r.e.type, round(r.e.confidence, 3)) == ("RIGID_NAME", 0.63) and r.scale and r.deco and r.rank == "Wang"


def test_split_blocks(spark):
    line = "He said, “Go ‘now’.” It wasn't \"odd thing\" at all. ‘Why"
    italic = F.array(F.struct(F.lit(21).alias("start"), F.lit(23).alias("end")))
    r = one(spark, s=text.split_block(F.lit(line), italic), e=text.split_block(F.lit("Where am I? Calming down."), F.array(F.struct(F.lit(0).alias("start"), F.lit(11).alias("end")))))
    assert [(x.text, x.quoted) for x in r.s] == [("He said, ", False), ("“Go ‘now’.”", True), (" It wasn't ", False), ('"odd thing"', True), (" at all. ", False), ("‘Why", True)]
    assert [(x.text, x.emphasised) for x in r.e] == [("Where am I?", True), (" Calming down.", False)]
    kind = lambda t, q=False, e=False, b="", a="": text.span_type(F.lit(t), F.lit(q), F.lit(e), F.lit(b), F.lit(a))
    r = one(spark, a=kind("“Go.”", True, a=" he thought to himself"), b=kind("“Impossible!”", True), c=kind("“Go home, now.”", True), d=kind("x", e=True), e=kind("legend has it"), f=kind("He walked on."), g=kind("The pale sky."), h=kind("Nothing."))
    assert tuple(r) == ("INNER_MONOLOGUE", "CROWD_REACTION", "DIALOGUE", "INNER_MONOLOGUE", "NARRATION_EXPOSITION", "NARRATION_ACTION", "NARRATION_DESCRIPTION", "NARRATION_ACTION")
