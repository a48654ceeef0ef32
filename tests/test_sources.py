"""Sources, sinks and streams."""

import zipfile

from fabulon.operators import log
from fabulon.sources.adapters import event_facts
from fabulon.sources.files import FactStore, chapters, read_epub, read_gold, read_lexicon
from fabulon.streaming import live


def test_epub_to_blocks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("OPS/p.opf", '<package><manifest><item id="a" href="two.xhtml"/><item id="b" href="one.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("OPS/one.xhtml", "<html><head><title>x</title></head><body><h1>One</h1><p>He &amp; <i>she</i>\n left.</p><p>[HP: 3]</p></body></html>")
        z.writestr("OPS/two.xhtml", "<html><body><p>T/N: note</p></body></html>")
    got = chapters(read_epub(spark, str(tmp_path)), "n").orderBy("number").collect()
    assert [c.source_href for c in got] == ["OPS/one.xhtml", "OPS/two.xhtml"]
    assert [(b["index"], b.block_type, b.text) for b in got[0].blocks] == [(0, "PROSE", "One"), (1, "PROSE", "He & she left."), (2, "SYSTEM_WINDOW", "[HP: 3]")]
    assert got[1].blocks[0].block_type == "TRANSLATOR_NOTE"


def test_json_and_lexicon(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"novel_id": "n", "chapter": 1.5, "surface": "X", "confirmed": true}\n')
    assert read_gold(spark, str(tmp_path / "g.jsonl")).first().chapter == 1.5
    (tmp_path / "l.toml").write_text('[titles]\ntransferable = ["lord", "king"]\n[words]\nprefixes = ["sir"]\n')
    assert read_lexicon(spark, str(tmp_path / "l.toml")).count() == 3


def test_store_appends(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"))
    one = spark.sql("select 'LOCAL' stage, 'S' tier, 'm' model, true escalated, '' escalation_reason, 1 prompt_tokens, 2 completion_tokens, 3 latency_ms, true ok, 'n' novel_id, 1.0 chapter")
    store.append("llm_call", one)
    store.append("llm_call", one)
    assert store.read("llm_call").count() == 2


def test_stream_matches_batch(spark, sf_dir, tmp_path):
    facts = event_facts(spark, sf_dir).select("target_id", "key", "value", "learned", "seq")
    for i in range(3):
        facts.filter(f"seq % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.read_events(spark, str(tmp_path / "in"), "target_id string, key string, value double, learned long, seq long", files=1)
    live.upsert_state(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = {(r.target_id, r.key): (r.value, r.n_facts) for r in live.read_upserts(spark, str(tmp_path / "out")).collect()}
    want = {(r.target_id, r.key): (r.value, r.n_facts) for r in live.live_state(facts).collect()}
    assert got == want


def test_replay_is_a_prefix(spark, sf_dir):
    e = event_facts(spark, sf_dir).selectExpr("seq", "target_id as id", "key as type", "value", "learned")
    counts = [sum(r.n_events for r in log.replay(e, p).collect()) for p in (0, 10_000_000, 10**9)]
    assert counts[0] <= counts[1] <= counts[2] == e.count()
