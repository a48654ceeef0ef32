"""The incremental resolver in blocks, against every pair scored one by one."""

import math
import random

import numpy as np
import pytest

from fabulon.operators import incremental


def _brute(groups, link, new):
    keys, profiles, waiting, out = {}, {}, [], {}
    windows = sorted({w for _, w, _, _ in groups})
    for number in windows:
        own = [(g, 0) for g in groups if g[1] == number] + waiting
        mean = sum(sum(p.values()) for p in profiles.values()) / len(profiles) if profiles else 0
        found, waiting = [], []
        for (g, _, key, terms), tried in own:
            best, near = 0.0, None
            for e in sorted(profiles):
                p, score = profiles[e], 0.0
                for t in terms:
                    if t in p:
                        df = sum(t in q for q in profiles.values())
                        score += math.log1p((len(profiles) - df + 0.5) / (df + 0.5)) * p[t] * 2.5 / (p[t] + 1.5 * (0.25 + 0.75 * sum(p.values()) / mean))
                if round(score, 6) > best:
                    best, near = round(score, 6), e
            last = number == windows[-1] or tried >= incremental.ATTEMPTS - 1
            kind = "LINK" if key in keys or best >= link else "DEFER" if best > new and not last else "NEW"
            if kind == "DEFER":
                waiting.append(((g, number, key, terms), tried + 1))
            else:
                found.append((g, key, terms, kind, keys.get(key, near)))
        for g, key, terms, kind, entity in found:
            e = entity if kind == "LINK" else min(x[0] for x in found if x[1] == key and x[3] == "NEW")
            out[g] = (e, kind, number)
        for g, key, terms, _, _ in found:
            keys[key] = min(keys.get(key, out[g][0]), out[g][0])
            for t in terms:
                profiles.setdefault(out[g][0], {}).setdefault(t, 0)
                profiles[out[g][0]][t] += 1
    return out


@pytest.mark.parametrize(("cells", "many"), [(64, 12), (64, 400)])
def test_blocks_give_what_every_pair_gives(spark, monkeypatch, cells, many):
    for name, value in (("BLOCK_TERMS", 150), ("ASKED_TERMS", 70), ("_CELLS", cells), ("_SLAB", 3)):
        monkeypatch.setattr(incremental, name, value)
    r = random.Random(5)
    groups = [(i, i // 30, f"k{r.randrange(60)}", [f"w{int(r.random() ** 2 * many)}" for _ in range(r.randrange(1, 14))]) for i in range(120)]
    df = spark.createDataFrame([*groups, (999, 1, "none", [])], "group_id long, window long, key string, terms array<string>")
    got = {x.group_id: (x.entity, x.decision, x.window) for x in incremental.resolve_windows(df, 9.0, 2.0).collect()}
    assert got == _brute(groups, 9.0, 2.0)


@pytest.mark.parametrize("many", [6, 3000])
def test_the_best_of_a_block(monkeypatch, many):
    monkeypatch.setattr(incremental, "_CELLS", 100)
    r = np.random.default_rng(3)
    ids, terms = r.integers(0, 40, 600), r.integers(0, many, 600)
    own, words, i, t, n = incremental._counted(ids, terms, np.ones(600, dtype=np.int64), by_term=True)
    lengths = np.bincount(i, n, minlength=len(own))
    asked, all_terms, q, u, qn = incremental._counted(r.integers(0, 30, 300), r.integers(0, many, 300), np.ones(300, dtype=np.int64), by_term=False)
    idf, mean = r.random(len(all_terms)), lengths.mean()
    weights = np.zeros((len(own), many))
    weights[i, words[t]] = n * 2.5 / (n + 1.5 * (0.25 + 0.75 * lengths[i] / mean))
    want = np.zeros((len(asked), many))
    want[q, all_terms[u]] = idf[u] * qn
    want = np.round(want @ weights.T, 6)
    got = {a: (b, c) for x in incremental.best_of((own, lengths, words, np.bincount(t), i, n), (asked, all_terms, idf, np.bincount(q), u, qn), mean) for a, b, c in zip(*x, strict=True) if c > 0}
    best = {a: (own[w.argmax()], w.max()) for a, w in zip(asked, want, strict=True) if w.max() > 0}
    assert got.keys() == best.keys() and all(got[a][0] == best[a][0] and abs(got[a][1] - best[a][1]) < 1e-5 for a in best)
