"""Queries that read whole tables and whole texts, against brute force on small tables."""

import math
import re
from itertools import combinations

from fabulon.operators import speech
from fabulon.plans import speeches, texts


def _written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# -- candidates ------------------------------------------------------------------------------------

_LINEITEM = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double"


def _judged(rows):
    """(order, line, supplier, position, features, verdict, confidence, probability) of each row."""
    for o, n, part, supp, quantity, discount, tax in rows:
        f = {"surface": quantity / 50, "context": discount * 10, "partner": tax * 12, "temporal": n % 3 / 2, "prior": supp % 10 / 10}
        if part % 17 == 0 or f["temporal"] <= 0:
            verdict = "BLOCK", 0.0
        elif part % 23 == 0 or supp % 29 == 0 or f["surface"] >= 0.86:
            verdict = "FORCE_LINK", 0.98 if part % 23 == 0 else 0.95 if supp % 29 == 0 else 0.9
        else:
            verdict = "SCORE", 0.0
        terms = {"surface": 1.2 * f["surface"] * (f["surface"] >= 0.8), "context": 2 * f["context"], "partner": 1.5 * f["partner"], "temporal": f["temporal"], "prior": 0.4 * f["prior"]}
        yield o, n, supp, n * 10**12 + part * 10**5 + supp, terms, *verdict, round(1 / (1 + math.exp(4 - sum(terms.values()))), 9)


def test_candidates_of_every_order(spark, tmp_path):
    rows = [(o, n, o * 7 + n, (o * 5 + n) % 60 + 1, float((o * 11 + n * 7) % 50 + 1), (o + n) % 11 / 100, (o * n) % 9 / 100) for o in range(1, 42) for n in range(1, o % 5 + 2)]
    d, judged = _written(spark, tmp_path, lineitem=(rows, _LINEITEM)), list(_judged(rows))
    verdicts = {}
    for *_, verdict, confidence, _ in judged:
        verdicts[verdict, confidence] = verdicts.get((verdict, confidence), 0) + 1
    assert {(r.verdict, r.confidence): r.n for r in texts.prefilter(spark, d).collect()} == verdicts
    scores = {(r.l_orderkey, r.l_linenumber): r.probability for r in texts.score(spark, d).collect()}
    assert scores.keys() == {(j[0], j[1]) for j in judged} and all(abs(scores[j[0], j[1]] - j[7]) < 2e-6 for j in judged)
    means = texts.ablation(spark, d).first()
    for k in texts._EVIDENCE:
        assert abs(means[f"without_{k}"] - sum(sum(v for x, v in j[4].items() if x != k) - 4 for j in judged) / len(judged)) < 2e-6
    want = {}
    for o in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == o]
        forced = sorted((j[3], j[2]) for j in own if j[5] == "FORCE_LINK")
        allowed = sorted((-j[7], j[3], j[2]) for j in own if j[5] == "SCORE")
        best = -allowed[0][0] if allowed else 0.0
        tie = len(allowed) > 1 and best + allowed[1][0] < 0.05
        decision = "LINK" if forced else "NEW" if best <= 0.3 else "LINK" if best >= 0.75 and not tie else "DEFER"
        want[o] = decision, forced[0][1] if forced else allowed[0][2] if best > 0.3 else None, len(allowed)
    assert {r.l_orderkey: (r.decision, r.candidate, r.n_allowed) for r in texts.gate(spark, d).collect()} == want


# -- co-occurrence and spellings ---------------------------------------------------------------------


def test_co_occurrence_of_every_supplier(spark, tmp_path):
    rows = [(o, n, 1, (o % 7 * 40 + n * 33) % 260 + 1, 1.0, 0.0, 0.0) for o in range(1, 60) for n in range(1, 5)]
    shared = {}
    for o in range(1, 60):
        for pair in combinations(sorted({r[3] for r in rows if r[0] == o}), 2):
            shared.setdefault(pair, []).append(o)
    want = {(*p, len(x), min(x)) for p, x in shared.items() if len(x) > 1}
    assert any(a > 60 for a, *_ in want)
    got = texts.cooccurrence_block(spark, _written(spark, tmp_path, lineitem=(rows, _LINEITEM))).select("a", "b", "weight", "first")
    assert set(map(tuple, got.collect())) == want


def test_spellings_of_every_part(spark, tmp_path):
    rows = [(i, f"{'red' if i % 2 else 'pale blue'} {'tin' if i < 400 else 'brass'} {'lamp' if i % 3 else 'cup'}") for i in range(390, 420)]
    spelled = sorted({n for _, n in rows})
    want = {(a, b, a.split()[-1]) for a, b in combinations(spelled, 2) if a.split()[-1] == b.split()[-1] and abs(len(a) - len(b)) <= 12}
    got = speeches.suspected_splits(spark, _written(spark, tmp_path, part=(rows, "p_partkey long, p_name string"))).select("a", "b", "head")
    assert set(map(tuple, got.collect())) == want and any("brass" in a for a, *_ in want)


# -- all terms of a text -----------------------------------------------------------------------------

_DOCS = "doc_id long, text string"


def _many(stem, n):
    return " ".join(f"{stem}{i}x" for i in range(n))


def test_queries_of_every_term(spark, tmp_path):
    texts_ = [(1, _many("river", 14)), (2, _many("castle", 9)), (3, "riverbank " + _many("castle", 5)), (4, None)]
    asked = [(7, _many("river", 13) + " " + _many("castle", 6)), (8, _many("nothing", 20))]
    d = _written(spark, tmp_path, documents=(texts_, _DOCS), benchmark=(asked, "item_id long, text string"))
    words = {i: t.split() for i, t in texts_ if t}
    mean, want = sum(map(len, words.values())) / len(words), []
    for q, t in asked:
        for i, own in words.items():
            total = 0.0
            for w in t.split():
                df = sum(w in o for o in words.values())
                tf = own.count(w)
                total += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / mean))
            if total:
                want.append((q, i, total))
    got = {(r.query, r.id): r.score for r in texts.bm25_topk(spark, d).collect()}
    assert got.keys() == {(q, i) for q, i, _ in want} and all(abs(got[q, i] - s) < 2e-6 for q, i, s in want)


def test_profiles_of_every_term(spark, tmp_path):
    late = _many("harbour", 30)
    rows = [(0, "alpha " + _many("first", 9) + " " + late), (1, "beta " + _many("second", 30)), (2, "gamma " + _many("third", 30)), (9, "delta " + _many("fourth", 9) + " " + late)]
    got = {r.group_id: (r.entity, r.decision) for r in speeches.resolve_incremental(spark, _written(spark, tmp_path, documents=(rows, _DOCS))).collect()}
    assert got == {0: (0, "NEW"), 1: (1, "NEW"), 2: (2, "NEW"), 9: (0, "LINK")}


# -- whole turns -------------------------------------------------------------------------------------


def test_spans_of_whole_turns(spark, tmp_path):
    long = "She went down to the river and waited there for a long time. " * 3
    said = [long, long + 'Then "wait" was all they said.', "short", long + "“Curly” Anna said, and it was late.", long + 'He mused "no" again.']
    rows = [(c, n, "user", said[(c + n) % 5]) for c in range(5) for n in range(4)]
    shape = ('"{}" said R{}.', 'R{1} asked, "{0}" It was late.', 'He thought "{}" and left.')
    spans, kinds, speakers = [], {}, []
    for c, n, role, t in rows:
        line = shape[n % 3].format(t, role)
        parts = re.findall('"[^"]*"|“[^”]*”|[^"“]+|["“]', line)
        at = 0
        for i, p in enumerate(parts):
            quoted = len(p) > 1 and p[0] in '"“' and p[-1] in '"”'
            spans.append((c, n, i, p, quoted, at, at + len(p)))
            at += len(p)
            before, after = parts[i - 1] if i else "", parts[i + 1] if i + 1 < len(parts) else ""
            thought = re.search(rf"(?i)\b({speech.THOUGHT})\b", before[-80:] + " " + after[:80])
            kind = "INNER_MONOLOGUE" if quoted and thought else "DIALOGUE" if quoted else "DESCRIPTION" if re.search(r"(?i)\b(is|are|was|were|had)\b", p) else "ACTION"
            kinds[kind] = kinds.get(kind, 0) + 1
            if quoted:
                name = next((m[1] for m in (re.search(rf"^[\s,.]*(?:{speech.SAID})\s+([A-Z][\w#-]*)", after), re.search(rf"^[\s,.]*([A-Z][\w#-]*)\s+(?:{speech.SAID})\b", after), re.search(rf"([A-Z][\w#-]*)\s+(?:{speech.SAID})[\s,:]*$", before)) if m), None)
                pov = "POV" if re.search(rf"(?i)\b({speech.THOUGHT})\b", before) else None
                speakers.append((c, n, name or pov, "EXPLICIT" if name else pov or "UNRESOLVED"))
    d = _written(spark, tmp_path, conversations=(rows, "conv_id long, turn long, role string, text string"))
    got = speeches.quote_spans(spark, d).select("conv_id", "turn", "n", "text", "quoted", "start", "end")
    assert sorted(map(tuple, got.collect())) == sorted(spans) and any(len(s[3]) > 100 for s in spans)
    assert {r.span_type: r.n_spans for r in speeches.span_types(spark, d).collect()} == kinds
    got = speeches.speaker_ladder(spark, d).select("conv_id", "turn", "speaker", "method")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(speakers, key=str)
