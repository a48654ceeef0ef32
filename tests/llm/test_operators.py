"""The ten operators against brute force, round trips and held-out rows, edge cases included."""

import hashlib
import pickle
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fabulon.llm import chat, language, licenses, media, packing, pieces, queries, spherical, suffixes, toxicity
from fabulon.llm.common import groups_of, joined_bytes
from fabulon.llm.graph import components
from fabulon.llm.jaccard import join_similar

EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "é😀\x00"), (5, "word " * 30_000), (6, "same text here for both rows ok"), (6, "same text here for both rows ok"), (None, "same text here for both rows ok"), (7, "\\<s>[INST] x")]
DOCS = "doc_id long, text string, n_tokens string, lang string, key int"  # extra columns whose names clash with the operators' own


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "en", 0) for i, t in rows], DOCS)


# -- licence scan ----------------------------------------------------------------------------------


def test_license_scan(spark):
    mit = licenses.KNOWN["MIT"]
    shouted = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace("\n", "\n\n * ") + "\n"
    got = {r.doc_id: r.license_id for r in licenses.scan(docs(spark, [*EDGE, (20, mit), (21, shouted), (22, mit + " Except on Mondays."), (23, "Released under the MIT licence")])).collect()}
    assert got[20] == got[21] == "MIT" and got[22] is None and got[23] == "MIT line"
    assert got[1] is got[2] is got[5] is None and licenses.scan(docs(spark, [])).count() == 0


def test_whole_licenses_wrapped_anew(spark):
    import textwrap

    paragraphs = lambda text, width: "\n\n".join(p if re.search(r"copyright (\(c\)|\[yyyy)", p.lower()) else textwrap.fill(p, width, break_on_hyphens=False, break_long_words=False) for p in re.split(r"\n\s*\n", text))
    files = {"Apache-2.0": "Apache-2.0", "BSD-3-Clause Regents": "BSD", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    texts = {}
    for name, file in files.items():
        with open(f"/usr/share/common-licenses/{file}", encoding="utf-8") as f:
            texts[name] = f.read()
    texts |= {k: licenses.KNOWN[k] for k in ("ISC", "MIT", "0BSD")} | licenses.FULL
    notices = "Copyright (c) 2011-2020, Someone\nCopyright The Foo Authors.\n© 2020 Someone\nAll rights reserved.\n\n"
    rows, want = [], {}
    for name, text in texts.items():
        for shown in (text, notices + text, *(paragraphs(text, w) for w in range(40, 100, 3))):
            want[len(rows)] = name
            rows.append((len(rows), shown))
    rows.append((len(rows), licenses.KNOWN["ISC"].replace("the above copyright", "the above\ncopyright")))
    want[len(want)] = "ISC"
    assert {r.doc_id: r.license_id for r in licenses.scan(docs(spark, rows)).collect()} == want


def test_riders_in_other_scripts(spark):
    mit = licenses.KNOWN["MIT"]
    riders = ["Коммерческое использование запрещено.", "仅限非商业用途", "Μόνο για μη εμπορική χρήση", "للاستخدام غير التجاري فقط", "गैर-व्यावसायिक", "ß"]
    rows = [(i, text + "\n\n" + x) for i, (text, x) in enumerate((t, x) for t in (mit, "Released under the MIT License.") for x in riders)]
    rows += [(100, "仅限非商业用途"), (101, "Коммерческое"), (102, mit + "\n\n--- * ---")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert all(r.license_id is None for i, r in got.items() if i < 102) and got[102].license_id == "MIT"
    assert got[100].canonical_sha256 != got[101].canonical_sha256 and got[100].canonical_chars == 7


def test_license_sql_on_licenses(spark, tmp_path):
    import duckdb

    texts = [*licenses.KNOWN.values(), *licenses.FULL.values(), "Copyright (c) 2020 X\n" + licenses.KNOWN["ISC"], licenses.KNOWN["MIT"] + " 仅限", None, "", "v.\n2 of x", "copyright notice and this"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())}))
    want = sorted(c.execute(licenses.scan_sql()).fetchall())
    got = sorted(map(tuple, licenses.scan(rows).select("doc_id", "canonical_sha256", "canonical_chars", "license_id").collect()))
    assert got == want and sum(r[3] is not None for r in got) >= 13


# -- chat ------------------------------------------------------------------------------------------


def test_template_round_trip():
    r = random.Random(2)
    pieces_ = ["<", "|", "end|>", "<|text|>", "\\", "l", "b", "n", "[", "INST]", "</s>", "a", "\n", ""]
    for _ in range(500):
        turns = [(r.choice(["user", "assistant", "x\ny", ""]), "".join(r.choice(pieces_) for _ in range(r.randint(0, 8)))) for _ in range(r.randint(1, 5))]
        out, spans, rewrites = chat.spans(turns, chat.marked)
        assert chat.read_marked(out) == turns and rewrites == -1
        assert [chat.unescape(out[a:b]) for _, a, b, _ in spans] == [t for _, t in turns]
        assert out.count("<|end|>") == len(turns)


def test_other_templates():
    turns = [("user", "hi"), ("assistant", "abc"), ("user", "q")]
    closing = lambda ts: "<s>" + "".join(f"[{r}]{t}" for r, t in ts) + "</s>"
    out, spans, rewrites = chat.spans(turns, closing)
    assert rewrites == -1 and [out[a:b] for _, a, b, _ in spans] == ["hi", "abc", "q"]
    forgets = lambda ts: "".join(f"<{r}>{t if r == 'user' or i == len(ts) - 1 else ''}\n" for i, (r, t) in enumerate(ts))
    assert chat.spans(turns, forgets)[2] == 2


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (2, None, "user", "</s>[INST] ok [/INST]")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(t)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    wide = t.select("*", F.lit("x").alias("formatted"), F.lit(1).alias("rewrites_at"), F.lit(None).alias("n_turns"))  # names that clash
    assert sorted(map(str, chat.digests(chat.format_chats(wide)).collect())) == sorted(map(str, got.values()))
    long = spark.createDataFrame([(1, 0, "user", "é<|end|>" * 200_000), (1, 1, "assistant", "x" * 1_000_000)], t.schema)
    r = chat.digests(chat.format_chats(long)).first()
    assert r.n_turns == 2 and r.loss_chars == 1_000_000 and r.loss_sha256 == hashlib.sha256(b"x" * 1_000_000).hexdigest()
    assert got[None].n_turns == 1 and got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert chat.format_chats(t.limit(0)).count() == 0


# -- media -----------------------------------------------------------------------------------------


def test_media_round_trip_and_general_decoder(monkeypatch):
    r = np.random.default_rng(1)
    payload = r.integers(0, 256, 192 * 130, dtype=np.uint8).tobytes()
    rate, frames = media.read_avi(media.store(payload))
    assert rate == 40_000 and len(frames) == 65
    assert b"".join(media.payload_of(media.decode_jpeg(f)) for f in frames) == payload
    pixels, frame, back = media.decode_frames(frames)
    monkeypatch.setattr(media, "_fixed_width", lambda *a, **k: None)
    assert back == payload and frame.tolist() == np.repeat(np.arange(65), 2).tolist()
    slow = [media.decode_jpeg(f) for f in frames[:3]]
    assert (np.concatenate([media.luminance(f) for f in slow]) == pixels[:6]).all()
    small = media.jpeg_of(payload[:384])
    assert media.payload_of(media.decode_jpeg(small)) == payload[:384]
    with pytest.raises(ValueError):
        media.decode_jpeg(b"no")


def test_shots():
    h = np.zeros((40, 32))
    h[:, 3] = 1
    h[20:, 3], h[20:, 9] = 0, 1
    r = np.random.default_rng(2)
    for n in (2, 3, 5, 9):  # a cut that stands out is found in files of any length, even differences are none
        even = np.zeros((n, 32))
        even[np.arange(n), np.arange(n) % 2] = 1
        assert n == 2 or media.shots(even) == [(0, n)]
        near = np.abs(r.normal(1, 0.02, (n, 32)))
        near[n // 2 :, :16] += 3
        assert media.shots(near / near.sum(axis=1, keepdims=True)) == [(0, n // 2), (n // 2, n)]
    assert media.shots(h) == [(0, 20), (20, 40)] and media.shots(h[:20]) == [(0, 20)] and media.shots(h[:0]) == []


def test_media_rows(spark):
    got = media.read_media(media.store_text(docs(spark, EDGE))).collect()
    assert len(got) == len(EDGE)
    for r in got:
        raw = {i: t for i, t in EDGE}[r.doc_id] or ""
        payload = media.padded(raw.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    features = {r.doc_id: r.clips for r in got}
    for i, t in EDGE:  # clips by cosines written out
        payload = np.frombuffer(media.padded((t or "").encode()), dtype=np.uint8)[: 192 * 40].astype(int).reshape(-1, 3, 64)[:, 0]
        if len(t or "") > 192 * 40:
            continue
        c = np.where(payload >= 128, payload, payload - 255)
        block = np.zeros((len(c), 8, 8))
        block[:, media.ZIGZAG // 8, media.ZIGZAG % 8] = c
        k = np.arange(8)
        basis = np.array([[(0.5 if u else 8**-0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in k] for u in k])
        shade = np.clip(np.rint(np.einsum("buv,uy,vx->byx", block, basis, basis) + 128), 0, 255).astype(int) >> 3
        h = np.stack([np.bincount(shade[j : j + media.FRAME_MCUS].ravel(), minlength=32) / shade[j : j + media.FRAME_MCUS].size for j in range(0, len(shade), media.FRAME_MCUS)])
        want = [(a, z - a, round(float((h[a:z] @ (np.arange(32) * 8 + 3.5)).mean()), 2)) for a, z in media.shots(h)]
        assert [(x["first"], x["frames"]) for x in features[i]] == [w[:2] for w in want]
        assert all(abs(x["brightness"] - w[2]) < 0.1 for x, w in zip(features[i], want, strict=True))
    assert media.read_media(media.store_text(docs(spark, []))).count() == 0
    broken = spark.createDataFrame([(1, 0, bytearray(b"RIFFxxxx")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert all(r.error and r.clips is None for r in media.read_media(broken).collect())
    assert media.clip_rows(media.read_media(media.store_text(docs(spark, EDGE)))).count() >= len(EDGE)


# -- packing ---------------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    from itertools import combinations

    r = random.Random(4)
    for _ in range(60):
        tops = sorted(r.sample(range(0, 60), r.randint(1, 8)))
        counts = [r.randint(1, 9) for _ in tops]
        k = r.randint(1, 4)
        cost = lambda cuts: sum(c * min(b for b in cuts if b >= t) for t, c in zip(tops, counts, strict=True))  # noqa: B023, E731
        best = min(cost((*some, tops[-1])) for n in range(min(k, len(tops))) for some in combinations(tops[:-1], n))
        got = packing.boundaries(tops, counts, k)
        assert len(got) <= k and got[-1] == tops[-1] and cost(got) == best
    assert packing.boundaries([], [], 4) == []


def test_packing_rows(spark):
    rows = [*EDGE, *[(100 + i, "w " * (i % 37)) for i in range(300)]]
    got = packing.pack(docs(spark, rows), buckets=5, budget=100).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        assert 0 <= r.padding == r.boundary - r.n_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, _), own in batches.items():
        assert len({r.boundary for r in own}) == 1
        assert len(own) == 1 or len(own) * own[0].boundary <= 100 or own[0].boundary == 0
    for b in {k[0] for k in batches}:  # full but for the last
        sizes = [len(batches[b, i]) for i in range(1 + max(i for x, i in batches if x == b))]
        assert len(set(sizes[:-1])) <= 1 and sizes[-1] <= sizes[0]
    assert packing.pack(docs(spark, [])).count() == 0


# -- vectors -----------------------------------------------------------------------------------------


def brute_vectors(rows, least=0.93):
    ok = {i: np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(np.array(v, dtype=np.float64)).all() and any(v)}
    label, links = {i: l for i, _, l in rows}, {i: set() for i, *_ in rows}
    for i in ok:
        for j in ok:
            if i != j and label[i] == label[j] and len(ok[i]) == len(ok[j]) and float(ok[i] @ ok[j]) >= least:
                links[i].add(j)
    return links


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(spherical, "CHUNK", 16)
    r = np.random.default_rng(5)
    base = r.normal(size=(12, 24))
    rows = [(i, (base[i % 12] + r.normal(size=24) * 0.12 * (i % 4)).astype(np.float32).tolist(), int(i % 12 < 6)) for i in range(240)]
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, rows[0][1], None), (904, [1.0, 2.0], 1), (905, [1.0, 2.0], 1), (906, [], 1), (907, [1.0] * 23 + [None], 1), (908, [float("inf")] + [1.0] * 23, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: x for x in spherical.near_vectors(df.unionAll(df.limit(5))).collect()}
    want = brute_vectors(rows)
    assert len(got) == len(rows)
    found, all_ = sum(x.n_links for x in got.values()), sum(map(len, want.values()))
    assert all(got[i].n_links <= len(want[i]) for i in want) and found >= 0.99 * all_
    assert got[904].component_id == got[905].component_id == 904 and got[905].kept is False
    for i in (900, 901, 902, 903, 906, 907, 908):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert spherical.near_vectors(df.limit(0)).count() == 0
    many = [(i, (base[i % 3]).tolist(), 0 if i % 50 else None) for i in range(600)] + [(1000 + i, (base[0] * (1 + i)).tolist(), 0) for i in range(5)]  # copies, and copies at other lengths
    df = spark.createDataFrame(many, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as weight", "'x' as digest", "2 as n_links")
    want = brute_vectors([(i, v, l) for i, v, l in many])
    assert {x.vec_id: x.n_links for x in spherical.near_vectors(df).collect()} == {i: len(x) for i, x in want.items()}


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)] + [(500 + i, 501 + i) for i in range(40)] + [(None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges[:-1]:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in parent}


# -- texts -------------------------------------------------------------------------------------------


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for q in range(len(b) - length + 1):
            if b[q : q + length] in seen:
                gone[q : q + length] = b"\1" * length
            else:
                seen.add(b[q : q + length])
        kept = bytes(c for c, z in zip(b, gone, strict=True) if not z)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark):
    r = random.Random(3)
    passages = ["".join(r.choice("abcd é") for _ in range(r.randint(90, 260))) for _ in range(10)]
    rows = [(i, "".join(r.choice(passages)[r.randint(0, 40) :] if r.random() < 0.5 else "".join(r.choice("abcd é") for _ in range(r.randint(0, 150))) for _ in range(r.randint(0, 4)))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, "a" * 500), (903, "a" * 350), (904, "ab" * 200), (905, rows[5][1]), (906, "\x00" * 230), (907, "x" + "\x00" * 150), (None, passages[0] * 2)]
    got = suffixes.remove_repeats(docs(spark, rows), keep_text=True, carry=("lang",)).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == brute_repeats(rows)
    assert {x.lang for x in got} == {"en"}
    common = "".join(chr(0x400 + 5 * i % 64) for i in range(55))  # the repeat begins with the second byte of the letter before it
    cut = {x.doc_id: x.kept for x in suffixes.remove_repeats(docs(spark, [(1, "é" + common), (2, "abc" + "ĩ" + common + "xyz")]), keep_text=True).collect()}
    assert cut == {1: "é" + common, 2: "abcxyz"}
    twice = suffixes.remove_repeats(docs(spark, [(1, passages[0]), (1, passages[0]), (2, passages[0])])).collect()
    assert sorted((x.doc_id, x.n_removed > 0) for x in twice) == [(1, False), (1, False), (2, True)]
    assert suffixes.remove_repeats(docs(spark, [])).count() == 0


def test_loser_tree_shares_prefixes():
    def coded(strings):
        shared, tails, sizes, last = [], b"", [], b""
        for x in strings:
            n = suffixes.common(x, last, 0)
            shared.append(n)
            tails, last = tails + x[n:], x
            sizes.append(len(x) - n)
        return suffixes.Run(bytes(shared), tails, bytes(sizes))

    r = random.Random(3)
    for _ in range(200):
        runs = [sorted(bytes(r.choice(b"ab") for _ in range(12)) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 7))]
        out = [(runs[a][i], lcp) for a, i, lcp in suffixes.merged([coded(x) for x in runs])]
        assert [x for x, _ in out] == sorted(x for y in runs for x in y)
        assert all(lcp == suffixes.common(out[i][0], out[i - 1][0], 0) for i, (_, lcp) in enumerate(out) if i)


def brute_jaccard(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}) if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(r.choice([3, 6, 12, 30, 80]))] for _ in range(15)]
    rows = []
    for i in range(260):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 1 + len(w) // 12)):
            w[r.randrange(len(w))] = r.choice(words)
        w = w[: r.randint(1, len(w))] if r.random() < 0.3 else w
        w += r.choice(base)[:5] if r.random() < 0.3 else []
        rows.append((i, " ".join(x.upper() if r.random() < 0.2 else x for x in w)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "a\x1fb c"), (1004, "é É\x85x"), (1005, "é É\x85x"), (1006, "x " * 20_000)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in join_similar(docs(spark, rows)).collect()}
    assert got == brute_jaccard(rows)
    again = join_similar(docs(spark, EDGE)).collect()
    assert len(again) == len(EDGE) and {x.component_id for x in again if x.doc_id in (6, None)} == {6}
    assert join_similar(docs(spark, [])).count() == 0


def thue_morse(n):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_ngram_join_of_long_texts(spark):
    """Sets on both sides of each number of groups, families that share half of a text, and words that polynomials modulo 2**64 confuse."""
    r = random.Random(12)
    words = [f"v{i}" for i in range(3000)]
    rows = []
    for size in (120, 250, 330, 500, 680, 1000, 1350, 2600, 5200, 6500):
        base = [r.choice(words) for _ in range(size)]
        for k in range(5):
            w = [r.choice(words) if r.random() < 0.006 * k * k else x for x in base]
            rows.append((len(rows), " ".join(w + [r.choice(words) for _ in range(size * (k % 3) // 6)])))
        rows += [(len(rows) + k, " ".join(base[: size // 2] + [r.choice(words) for _ in range(size // 2)])) for k in range(3)]
    one, two = thue_morse(2048)
    rows += [(900, f"{one} b c d e {two} b c d"), (901, f"{two} b c d e {one} b c d"), (902, one), (903, two)]
    base = [r.choice(words) for _ in range(40)]
    rows += [(1000 + i, " ".join(base[: r.randint(33, 40)] + [f"z{i}"] * (i % 2))) for i in range(120)]  # one tree of more than a leaf
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in join_similar(docs(spark, rows)).collect()}
    assert got == brute_jaccard(rows)


def test_bounds_hold_across_numbers_of_groups():
    from fabulon.llm import jaccard

    r = np.random.default_rng(3)
    for n in (5, 16, 17, 100, 250, 256, 300, 511, 512, 513, 700, 1100, 4000):
        a = np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(1, int(0.9 * n))], r.integers(0, 1 << 62, max(1, n // 5), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        sizes = np.array([len(a), len(b)])
        raw = list(map(zlib.decompress, jaccard.points_of(np.concatenate([a, b]), np.concatenate([[0], np.cumsum(sizes)]))))
        assert [len(p) for p in raw] == jaccard.groups(sizes).tolist()
        if 100 * both >= 75 * (sizes.sum() - both):
            (x, y, bound), pairs = jaccard.small_trees(raw, sizes, np.array([0, 2]), 75), list(jaccard.searches(raw, sizes, np.arange(2), np.arange(2), 75))
            assert (x.tolist(), y.tolist()) == ([0], [1]) and bound[0] >= both and len(pairs) == 1


def test_groups_span_batches():
    r = random.Random(9)
    keys = sorted(r.randint(0, 12) for _ in range(200))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + n])], names=["k"]) for i, n in zip(range(0, 200, 7), [7] * 40, strict=False)]
    seen = [t.column("k").to_pylist() for t in groups_of(batches, "k")]
    assert [k for t in seen for k in t] == keys and all(a[-1] != b[0] for a, b in zip(seen, seen[1:], strict=False))


# -- pieces ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_match_the_library(vocabulary):
    r, lib = random.Random(1), vocabulary.library
    parts = [" ", "  ", "a", "b", "the", "er", "\n", ".", ",", "▁", "é", "ñ", "中", "😀", "\x00", "\t", "<s>", "</s>", "<0x0A>", "!", "|", "%%%", "ing", "⁇", " ", "�", "1", "'s", "_", "e."]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(4000)] + ["thering" * 400, "", " "]
    flat, offsets = vocabulary.encode_all(pa.array([*texts, None]))
    ids = lib.encode(texts)
    assert [flat[offsets[i] : offsets[i + 1]].tolist() for i in range(len(texts))] == ids and offsets[-1] == offsets[-2]
    lists = ids + [[r.randint(3, 31999) if r.random() < 0.6 else r.randint(0, 270) for _ in range(r.randint(0, 8))] for _ in range(4000)]
    got = vocabulary.decode_all(np.array([x for i in lists for x in i], dtype=np.int32), np.cumsum([0] + [len(i) for i in lists]))
    assert got.to_pylist() == lib.decode(lists)


def test_pieces_of_confusable_texts(vocabulary):
    texts = [t for n in (1024, 2048, 4096) for t in thue_morse(n)]
    flat, offsets = vocabulary.encode_all(pa.array(texts))
    assert [flat[offsets[i] : offsets[i + 1]].tolist() for i in range(len(texts))] == vocabulary.library.encode(texts)


def test_piece_rows(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.decode_pieces(pieces.encode_pieces(docs(spark, EDGE), path), path).collect()
    assert len(got) == len(EDGE) and {r.doc_id: r.decoded for r in got}[5] == "word " * 30_000


# -- classifiers -------------------------------------------------------------------------------------


def test_language(spark, sf_dir):
    d = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    truth = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    got = [r for r in language.identify(d).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert sum(truth[r.doc_id] == r.lang_pred for r in got) >= 0.97 * len(got)
    edge = {r.doc_id: r.lang_pred for r in language.identify(docs(spark, [*EDGE, (30, "123 !")]), train=d).collect()}
    assert edge[1] == edge[2] == edge[3] == edge[30] == "und" and edge[5] != "und"
    nothing = language.identify(docs(spark, EDGE), train=d.limit(0)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_cross_parsing_against_brute_force(monkeypatch):
    train = {"a": "the cat sat on the mat and the rat", "b": "le chat est sur le tapis et le rat"}
    model = language.Automata(train)

    def phrases(known, text):
        out, i = 0, 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and text[i:j] in known:
                j += 1
            out, i = out + 1, max(j - 1, i + 1)
        return out

    texts = ["the cat", "zzz the", "é", "le rat sat", "x1y2z", "chat  chat!"]
    texts += [train["a"] * 60, "zq" * 2000, "the cat sat" * 300, train["b"] + "x" * 1100 + train["a"] * 40]  # phrases run across blocks

    def check(model):
        codes, sizes = model.codes(texts)
        got = model.phrases(codes, sizes)
        for i, t in enumerate(texts):
            t = language.letters(t)
            assert sizes[i] == len(t) and got[i].tolist() == [phrases(train[k], t) for k in "ab"]

    check(model)
    monkeypatch.setattr(language, "BLOCK", 5)
    check(model)
    monkeypatch.setattr(language, "DENSE", 10)
    check(language.Automata(train))


def test_many_letters():
    """Languages of thousands of letters have tables that grow with their text, not with states times letters."""
    r = random.Random(6)
    train = {f"l{i}": "".join(chr(0x4E00 + 700 * i + r.randint(0, 4999)) for _ in range(20_000)) for i in range(4)} | {"en": "the cat sat on the mat " * 100}
    model = language.Automata(train)
    assert len(model.sparse) == 4 and len(model.next) < 1 << 20
    assert model.classify([train["l2"][500:900], "the mat", train["l0"][5:300]])[0] == ["l2", "en", "l0"]


def test_toxicity(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    d, labels = (spark.read.parquet(f"{big}/{n}.parquet") for n in ("documents", "labels"))
    y = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.classify(d, labels, limit=600).collect() if r.held_out and r.doc_id in y]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    right = sum(r.predicted == y[r.doc_id] for r in got)
    hits = sum(r.predicted and y[r.doc_id] for r in got)
    assert right >= 0.96 * len(got) and hits >= 0.8 * sum(y[r.doc_id] for r in got)


def test_toxicity_learns_from_every_row(spark, monkeypatch):
    """A word that only the last of many rows have counts as well, and thresholds are those of all rows put aside."""
    r = random.Random(4)
    monkeypatch.setattr(toxicity, "CHUNK_ROWS", 500)
    n = 6000
    rows = [(i, " ".join(r.choice("red green blue grey".split()) for _ in range(6)) + (f" vile{i % 3}" if i % 4 == 0 else ""), "en") for i in range(n)]
    d, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)], "doc_id long, toxic int")
    taught = []
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: taught.append(a))
    whole = toxicity.labelled(d, labels)
    assert whole.count() == sum(not h for (h,) in d.select(toxicity.held_out(F.col("doc_id"))).collect())
    model = pickle.loads(toxicity.fitted_on_all(d, labels, "doc_id", "text", "lang"))
    assert model.scores(pa.array(["red vile1 blue"]))[0] > 0.9 and model.scores(pa.array(["red green blue"]))[0] < 0.1 and not taught
    scored = [(r.choice(["en", "de"]), round(r.random(), 2), r.randrange(2)) for _ in range(300)] + [("fr", 0.5, 1)]
    got = toxicity.thresholds(spark.createDataFrame(scored, "lang string, score double, y int"))
    for lang in ("en", "de", "fr"):
        own = [x for x in scored if x[0] == lang]
        assert abs(got[lang] - toxicity.calibrated(np.array([x[1] for x in own]), np.array([x[2] for x in own]))) < 1e-9


def test_toxicity_moves_each_text_that_teaches_once(spark):
    """Where labels are too many to be broadcast, only texts to learn from are exchanged, once; the others stay where they are."""
    r = random.Random(8)
    n, size = 1500, 4000
    rows = [(i, f"{'vile' if i % 20 == 0 else 'fine'} " + "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=size)), "en") for i in range(n)]
    d, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(0, n, 10)], "doc_id long, toxic int")
    sc = spark.sparkContext._jsc.sc()

    def written():
        time.sleep(0.3)  # Spark tells its totals at most every 0.1 s, at the next task
        spark.sparkContext.parallelize([0], 1).count()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        toxicity.fitted_on_all(d, labels, "doc_id", "text", "lang")
        moved = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert n * size / 40 < moved < n * size / 5, moved  # some 6 in 100 teach


def test_toxicity_learns_from_the_rows_of_the_labels_whatever_the_bitmap(spark, monkeypatch):
    """Rows to learn from are those a plain join gives, each with its label, also where the bitmap is nearly full and ids are of other types, null, repeated or below zero."""
    r = random.Random(9)
    rows = [(r.choice([None, *range(-400, 400)]), r.choice([None, "", "a b", f"text {i}", f"text {i} again"]), "en") for i in range(3000)]
    known = [(r.choice([None, *range(-600, 600)]), r.choice([0, 1, None, 7])) for _ in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    best = {}
    for i, y in known:
        if i is not None and y in (0, 1) and not held(i):
            best[i] = max(y, best.get(i, 0))
    want = sorted((t or "", best[i]) for i, t, _ in rows if i in best)
    for kind in ("long", "int", "string"):
        labels = spark.createDataFrame([(str(i) if kind == "string" and i is not None else i, y) for i, y in known], f"doc_id {kind}, toxic int")
        for most in (26, 15, 4):
            monkeypatch.setattr(toxicity, "BITMAP", most)
            open_, y = toxicity.open_rows(d, "doc_id", "text", "lang"), toxicity.known_labels(d, labels, "doc_id")
            assert sorted((x.text, x.y) for x in toxicity.in_order(open_, y, len(want), 3).collect()) == want
            kept = toxicity.likely(open_, y, len(want))
            assert kept.columns == open_.columns and len(want) <= kept.count() <= open_.count()
    monkeypatch.setattr(toxicity, "BITMAP", 26)
    assert toxicity.likely(open_, y, 1000).count() < 1.2 * len(want) < open_.count()


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.classify(docs(spark, EDGE), labels).count() == len(EDGE)
    assert toxicity.classify(docs(spark, []), labels).count() == 0 and language.identify(docs(spark, [])).count() == 0
    assert {r.score for r in toxicity.classify(docs(spark, EDGE), labels.limit(0)).collect()} == {0.0}


def test_convolutions_against_brute_force():
    """Scores by loops over words, filters and places; and gradients that lower the loss of a separable sample."""
    texts = ["a bad day", "", "one two three four five", "Bad BAD good-day", "x"]
    model = toxicity.Model.fresh(3)
    rows, starts, ends = toxicity.indexed(pa.array(texts))
    for i, t in enumerate(texts):
        own = rows[starts[i] : ends[i] + max(toxicity.WIDTHS) - 1]
        assert len(own) >= len(re.findall(r"[^\W_]+", t))
        hidden = []
        for w, f, bias in zip(toxicity.WIDTHS, model.filters, model.bias, strict=True):
            places = range(ends[i] - starts[i])
            at = lambda p: model.table[rows[starts[i] + p]].sum(axis=0)  # noqa: B023, E731
            hidden += [max(0.0, max(sum(float(at(p + k) @ f[k, :, n]) for k in range(w)) for p in places) + float(bias[n])) for n in range(toxicity.FILTERS)]
        want = 1 / (1 + np.exp(-(np.dot(hidden, model.out) + model.out_bias)))
        assert abs(model.scores(pa.array([t]))[0] - want) < 1e-5 and abs(model.scores(pa.array(texts))[i] - want) < 1e-5
    r = random.Random(1)
    sample = [(" ".join(r.choice("red green blue grey".split()) for _ in range(12)) + (" vile" if i % 2 else ""), i % 2, "en") for i in range(200)]
    fitted = toxicity.fit(sample)
    assert fitted.scores(pa.array(["red vile blue"]))[0] > 0.9 and fitted.scores(pa.array(["red green blue"]))[0] < 0.1 and 0.25 <= fitted.thresholds["en"] <= 0.75


def test_missed_pairs_stay_rare_as_the_table_grows():
    r = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(r.normal(size=(2000, 64)))
    b = r.normal(size=a.shape)
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * unit(b - (b * a).sum(axis=1, keepdims=True) * a)
    for rows in (2_000, 20_000, 1_000_000):
        (i, f), (j, g) = spherical.decode(a, rows), spherical.decode(b, rows)
        met = np.unique(np.intersect1d(i << 40 | f, j << 40 | g) >> 40)
        assert len(a) - len(met) <= 3
    assert spherical.filter_type(1 << 20) == np.int32 and spherical.filter_type(1 << 31) == np.int64


# -- pipeline ----------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    d, columns = spark.read.parquet(f"{sf_dir}/documents.parquet"), list(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf_dir)
        assert name == "packing" or out.columns == columns
        d = out
    assert 0 < d.count() <= 200
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_pipeline_against_brute_force(spark, sf_dir):
    """Every stage on all that the one before it kept, against plain Python."""
    import corpus_pipeline as cp

    rows = lambda df: [tuple(r) for r in df.collect()]
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = rows(d.select(*cp.COLUMNS))
    one = cp.keep_identified(spark, d, sf_dir)
    assert sorted(rows(one), key=str) == sorted([r for r in given if any(c.isalpha() for c in r[1] or "")], key=str)
    two = cp.drop_toxic(spark, one, sf_dir)
    flagged = {r.doc_id for r in toxicity.classify(one, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r.flagged}
    assert sorted(rows(two), key=str) == sorted([r for r in rows(one) if r[0] not in flagged], key=str)
    left = rows(two)
    groups = brute_jaccard([(r[0], r[1]) for r in left])
    three = cp.one_of_each_group(spark, two, sf_dir)
    assert sorted(rows(three), key=str) == sorted([r for r in left if groups[r[0]][1] == r[0]], key=str)
    four = cp.without_repeats(spark, three, sf_dir)
    seen, want = set(), {}
    for i, t, lang, source, _ in sorted(rows(three)):
        b = t.encode()
        gone = bytearray(len(b))
        for q in range(len(b) - 99):
            if b[q : q + 100] in seen:
                gone[q : q + 100] = b"\1" * 100
            else:
                seen.add(b[q : q + 100])
        kept, at = "", 0
        for c in t:
            n = len(c.encode())
            kept, at = kept + (c if not any(gone[at : at + n]) else ""), at + n
        want[i] = (i, kept, lang, source, len(kept))
    assert sorted(rows(four)) == sorted(want.values())
    five = cp.packed(spark, four, sf_dir).collect()
    counts = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows(four)}
    assert {r.doc_id: r.n_tokens for r in five} == counts and all(r.boundary >= r.n_tokens for r in five)
    assert sorted(r.doc_id for r in cp.run(spark, sf_dir).collect()) == sorted(counts)


def test_pipeline_judges_rows_not_ids(spark, monkeypatch):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    made = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).repartition(3)
    found = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    prose, other, third = ("".join(f"{w}{i} of the story " for i in range(40)) for w in ("river", "castle", "winter"))
    letters = [(i, prose + str(i)) for i in range(20)]
    rows = [*letters, (3, "12345"), (None, "777"), (None, other), (None, None)]
    assert found(corpus_pipeline.keep_identified(spark, made(rows), "")) == sorted([*letters, (None, other)], key=str)
    rows = [(1, prose), (1, prose), (None, prose + "end"), (2, prose), (None, other), (None, other), (None, other + "end"), (None, third), (5, third), (5, third), (6, None), (6, None), (None, "")]
    kept = found(corpus_pipeline.one_of_each_group(spark, made(rows), ""))
    alone = [x for x in kept if x[0] is None and x[1] in (other, other + "end")]
    assert len(alone) == 1 and sorted([x for x in kept if x not in alone], key=str) == sorted([(1, prose), (5, third), (6, None), (None, "")], key=str)

    def flags(docs, labels, **kw):
        return docs.withColumn("flagged", F.col("text") == other)

    monkeypatch.setattr(corpus_pipeline.toxicity, "classify", flags)
    assert found(corpus_pipeline.drop_toxic(spark, made([(None, prose), (None, other), (1, other), (1, third)]), "/root/testdata/sf0.001")) == sorted([(None, prose), (1, third)], key=str)


def test_license_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(c.execute(queries.SQL["op1_license_scan"]).fetchall())
    got = queries.op1_license_scan(spark, sf_dir).select("doc_id", "canonical_sha256", "canonical_chars", "license_id")
    assert sorted(map(tuple, got.collect())) == want and got.filter(F.col("canonical_chars") == 0).count() == 0


def test_anchors_in_bounded_memory():
    """The pass over all texts of a task holds numbers for the bytes of a small slice only."""
    texts = [" ".join(f"w{i * j % 9973}" for j in range(3000)) for i in range(1, 500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["doc", "mark", "text"])
    tracemalloc.start()
    for b, _, _ in suffixes._numbered([batch], [], suffixes.NARROW):
        suffixes.anchors(*joined_bytes(b.column("text")), 100, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 6 << 20 and peak < 100 << 20
