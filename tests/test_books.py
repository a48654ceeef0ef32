"""EPUB archives: contents, chapters, blocks, adapters, gaps."""

import io
import zipfile

from pyspark.sql import functions as F

from fabulon.sources import books

OPF = """<package><manifest><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="s" href="s.css" media-type="text/css"/>
<item id="a" href="t/a%20b.html"/><item id="b" href="t/b.html"/><item id="x" href="gone.html"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="x"/></spine></package>"""
NCX = """<ncx><navMap><navPoint playOrder="2"><navLabel><text>Chapter 2: The Gate</text></navLabel><content src="t/b.html#p"/></navPoint>
<navPoint playOrder="1"><navLabel><text>Ch. 1 - Fire &amp; Ice</text></navLabel><content src="t/a%20b.html"/></navPoint>
<navPoint playOrder="3"><navLabel><text>Characters</text></navLabel><content src="t/b.html"/></navPoint>
<navPoint playOrder="4"><navLabel><text>Episode 4</text></navLabel><content src="t/b.html"/></navPoint></navMap></ncx>"""
A = """<html><body><h1>Ch. 1 - Fire</h1><div><p>He  said <i>Where am I?</i> and left.</p><p class="block_6">Ouch&hellip; that hurt.</p></div><hr/>
<p>[Name: Klein<br/>]</p><p>Translator's Note: hello</p><p>more words</p></body></html>"""
B = '<html><body><p>outside</p><div class="chapter-ugc"><p>Chapter 2: The Gate</p><p>Story.</p></div></body></html>'


def epub(path, nav=False):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<rootfile full-path="o/c.opf"/>')
        opf = OPF.replace('<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', '<item id="n" properties="nav" href="nav.html"/>') if nav else OPF
        z.writestr("o/c.opf", opf)
        if nav:
            z.writestr("o/nav.html", '<nav><ol><li><a href="t/a%20b.html"> Chapter  1 </a></li><li><a href="t/b.html">Prologue</a></li></ol></nav>')
        else:
            z.writestr("o/toc.ncx", NCX)
        z.writestr("o/s.css", ".block_6 { font-style: italic } .plain { color: red }")
        z.writestr("o/t/a b.html", A)
        z.writestr("o/t/b.html", B)


def test_contents_and_chapters(spark, tmp_path):
    epub(tmp_path / "one.epub")
    toc = [(r.label, r.href, r.play_order) for r in books.read_toc(spark, str(tmp_path)).orderBy("play_order").collect()]
    assert toc[:2] == [("Ch. 1 - Fire & Ice", "o/t/a b.html", 1), ("Chapter 2: The Gate", "o/t/b.html", 2)] and len(toc) == 4
    rows = {r.number: r for r in books.chapters(books.read_entries(spark, str(tmp_path), "calibre"), "n").collect()}
    assert set(rows) == {1.0, 2.0} and rows[1.0].title == "Fire & Ice"  # episode 4 comes after the appendix
    blocks = rows[1.0].blocks
    assert [b.block_type for b in blocks] == ["PROSE", "PROSE", "NON_DIEGETIC", "SYSTEM_WINDOW", "TRANSLATOR_NOTE", "TRANSLATOR_NOTE"]
    assert blocks[0].text == "He said Where am I? and left." and [(r.start, r.end) for r in blocks[0].italic_ranges] == [(8, 19)]
    assert [(r.start, r.end) for r in blocks[1].italic_ranges] == [(0, len(blocks[1].text))] and blocks[2].text == "* * *"
    assert blocks[3].system_fields == {"Name": "Klein"}
    web = {r.number: [b.text for b in r.blocks] for r in books.chapters(books.read_entries(spark, str(tmp_path), "webexport"), "n", (2, 2)).collect()}
    assert web == {2.0: ["Story."]}
    plain = {r.number: [b.text for b in r.blocks] for r in books.chapters(books.read_entries(spark, str(tmp_path)), "n").collect()}
    assert plain[2.0] == ["outside", "Chapter 2: The Gate", "Story."] and plain[1.0][0] == "Ch. 1 - Fire"


def test_nav_spine_and_empty(spark, tmp_path):
    epub(tmp_path / "two.epub", nav=True)
    assert [(r.label, r.play_order) for r in books.read_toc(spark, str(tmp_path)).orderBy("play_order").collect()] == [("Chapter 1", 0), ("Prologue", 1)]
    data = (tmp_path / "two.epub").read_bytes()
    assert books.Archive(data).spine() == ["o/t/b.html", "o/t/a b.html"]
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("b.html", "x")
    assert books.Archive(box.getvalue()).toc() == [] and books.Archive(box.getvalue()).spine() == ["b.html"]


def test_labels_ranges_and_gaps(spark):
    labels = ["Chapter 45.1: Two", "EP. 7", "Side Story 3", "Prologue", "About", "chapter 12 – A – B"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, l string").select("i", books.chapter_label(F.col("l")).alias("c")).orderBy("i").collect()
    assert [(r.c.number, r.c.title, r.c.side) for r in got] == [(45.1, "Two", False), (7.0, "EP. 7", False), (None, "Side Story 3", True), (None, "Prologue", True), (None, "About", False), (12.0, "A – B", False)]
    assert [books.chapter_range(x) for x in ("1-199", "1", "5-", "-3")] == [(1, 199), (1, 1), (5, float("inf")), (float("-inf"), 3)]
    c = spark.createDataFrame([("n", x) for x in (1.0, 2.0, 2.5, 5.0)], "novel_id string, number double")
    assert sorted(r.number for r in books.gaps(c).collect()) == [3.0, 4.0] and sorted(r.number for r in books.gaps(c, (1, 7)).collect()) == [3.0, 4.0, 6.0, 7.0]


def test_configuration(spark, tmp_path):
    from fabulon.sources.files import read_lexicon

    (tmp_path / "s.toml").write_text('[[novel]]\nid = "a"\npath = "a.epub"\nchapters = "1-9"\n[[novel]]\nid = "b"\npath = "b.epub"\ntitle = "B"\nadapter = "calibre"\n')
    rows = books.read_sources(spark, str(tmp_path / "s.toml")).orderBy("id").collect()
    assert [(r.id, r.title, r.adapter, r.first, r.last) for r in rows] == [("a", "a", "generic", 1.0, 9.0), ("b", "B", "calibre", None, None)]
    (tmp_path / "l.toml").write_text(books.lexicon_toml({"titles": ["Sect \"M\"", "Elder", "Elder"], "ranks": []}, id="x"))
    assert sorted(map(tuple, read_lexicon(spark, str(tmp_path / "l.toml")).collect())) == [("titles", "Elder"), ("titles", 'Sect "M"')]
