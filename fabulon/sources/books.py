"""Books as EPUB archives: table of contents, chapters of typed blocks with emphasis, adapters for three sources, gaps.

Archives are unpacked by tasks (`mapInArrow` over Spark's binary files); what needs a document's tree
(leaf blocks, emphasis ranges) runs there, all else is columns.
"""

from __future__ import annotations

import html as entities
import io
import posixpath
import re
import tomllib
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabulon.functions import rules
from fabulon.functions.text import block_type, system_fields

#: Elements that are blocks, that separate scenes, that emphasise.
BLOCK_TAGS = ("p", "div", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre")
BREAK_TAGS = ("hr",)
EMPHASIS_TAGS = ("i", "em")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Labels of chapters and of what is none.
CHAPTER_LABEL = r"(?i)^\s*(?:chapter|ch\.?|episode|ep\.?)\s*(\d+(?:\.\d+)?)\s*(?:[:\-–—.]\s*(.*))?"
SIDE_LABEL = r"(?i)^\s*(?:side\s*story|extra|interlude|bonus|prologue|epilogue|afterword)\b"
TITLE_ECHO = r"(?i)^\s*chapter\s*\d+(?:\.\d+)?\s*[:\-–—]"


class _Node:
    __slots__ = ("tag", "classes", "children")

    def __init__(self, tag: str, classes: tuple[str, ...] = ()):
        self.tag, self.classes, self.children = tag, classes, []

    def walk(self) -> Iterator[_Node]:
        yield self
        for c in self.children:
            if isinstance(c, _Node):
                yield from c.walk()


class _Tree(HTMLParser):
    """A tolerant tree: end tags close up to their element, an unknown one closes nothing."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.open = [self.root]
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        tag = tag.rpartition(":")[2]
        if tag == "p" and any(n.tag == "p" for n in self.open):
            self.handle_endtag("p")
        node = _Node(tag, tuple((dict(attrs).get("class") or "").split()))
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        tag = tag.rpartition(":")[2]
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _spaced(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def extract_block(node: _Node, italic: frozenset[str] = frozenset()) -> tuple[str, list[tuple[int, int]]]:
    """Text of an element with white space squashed, and the ranges in it that tags or classes emphasise."""
    raw, marked = [], []

    def walk(n: _Node, here: bool) -> None:
        here = here or n.tag in EMPHASIS_TAGS or any(c in italic for c in n.classes)
        for c in n.children:
            if isinstance(c, str):
                raw.append(c)
                if here:
                    marked.append(_spaced(c))
            elif c.tag not in ("script", "style", "head"):
                walk(c, here)

    walk(node, False)
    text = _spaced("".join(raw))
    found = [(text.find(m), text.find(m) + len(m)) for m in marked if m and m in text]
    return text, _merged(found)


def leaf_blocks(root: _Node) -> Iterator[_Node]:
    """Block elements in document order that hold no other block, and breaks."""
    for n in root.walk():
        if n.tag in BREAK_TAGS or n.tag in BLOCK_TAGS and not any(m.tag in BLOCK_TAGS for m in n.walk() if m is not n):
            yield n


def content_root(tree: _Node, adapter: str) -> _Node:
    """Where an adapter finds the chapter's body: "generic" takes the document, "calibre" its body, "webexport" the chapter's container."""
    nodes = list(tree.walk())
    if adapter == "calibre":
        return next((n for n in nodes if n.tag == "body"), tree)
    if adapter == "webexport":
        for part in ("chapter-ugc", "chapter"):
            hit = next((n for n in nodes if n.tag == "div" and part in " ".join(n.classes)), None)
            if hit is not None:
                return hit
    return tree


def skipped(adapter: str, tag: str, text: str, index: int) -> bool:
    """Blocks that repeat the chapter's title: a first heading, or an echo among the first two blocks."""
    if adapter == "calibre":
        return tag in ("h1", "h2") and index == 0
    return adapter == "webexport" and index < 2 and bool(re.match(TITLE_ECHO, text))


def italic_classes(css: str) -> frozenset[str]:
    """Bare classes whose rule sets an italic or oblique font."""
    return frozenset(c for c, body in re.findall(r"\.([\w-]+)\s*\{([^}]*)\}", css) if re.search(r"(?i)font-style\s*:\s*(italic|oblique)\b", body))


class Archive:
    """One EPUB: package file, reading order, table of contents."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        box = self.text("META-INF/container.xml") if "META-INF/container.xml" in self.names else ""
        named = re.search(r'full-path\s*=\s*"([^"]+)"', box)
        self.opf = named[1] if named and named[1] in self.names else next((n for n in sorted(self.names) if n.endswith(".opf")), "")
        package = self.text(self.opf) if self.opf else ""
        self.items = {a.get("id"): a for a in (self._attributes(t) for t in re.findall(r"<(?:\w+:)?item\b[^>]*>", package))}
        self.order = [i for i in re.findall(r'<(?:\w+:)?itemref\b[^>]*\bidref\s*=\s*"([^"]*)"', package)]

    @staticmethod
    def _attributes(tag: str) -> dict[str, str]:
        return {k: entities.unescape(v) for k, v in re.findall(r'([\w:-]+)\s*=\s*"([^"]*)"', tag)}

    def text(self, name: str) -> str:
        return self.zip.read(name).decode("utf-8", "replace")

    def resolve(self, href: str, beside: str) -> str:
        return posixpath.normpath(posixpath.join(posixpath.dirname(beside), unquote(href.partition("#")[0])))

    def spine(self) -> list[str]:
        """Content documents in reading order; those the archive lacks are passed over. Without a package file, by name."""
        if not self.opf:
            return sorted(n for n in self.names if re.search(r"\.x?html?$", n))
        return [p for i in self.order if i in self.items and (p := self.resolve(self.items[i].get("href", ""), self.opf)) in self.names]

    def italics(self) -> frozenset[str]:
        sheets = [self.resolve(a.get("href", ""), self.opf) for a in self.items.values() if a.get("href", "").lower().endswith(".css")]
        return frozenset().union(*(italic_classes(self.text(s)) for s in sheets if s in self.names))

    def toc(self) -> list[tuple[str, str, int]]:
        """(label, path, order): from the NCX, else from the nav document, else none."""
        ncx = next((self.resolve(a.get("href", ""), self.opf) for a in self.items.values() if a.get("media-type") == "application/x-dtbncx+xml"), None)
        ncx = ncx if ncx in self.names else next((n for n in sorted(self.names) if n.endswith(".ncx")), None)
        if ncx:
            return self._ncx(ncx)
        nav = next((self.resolve(a.get("href", ""), self.opf) for a in self.items.values() if "nav" in a.get("properties", "").split()), None)
        return self._nav(nav) if nav in self.names else []

    def _ncx(self, path: str) -> list[tuple[str, str, int]]:
        out = []
        for i, m in enumerate(re.finditer(r"(?s)<(?:\w+:)?navPoint\b([^>]*)>(.*?)(?=<(?:\w+:)?navPoint\b|</(?:\w+:)?navPoint>)", self.text(path))):
            label, src = re.search(r"(?s)<(?:\w+:)?text>(.*?)</", m[2]), re.search(r'<(?:\w+:)?content\b[^>]*\bsrc\s*=\s*"([^"]*)"', m[2])
            if label and src:
                order = self._attributes(m[1]).get("playOrder", "")
                out.append((entities.unescape(label[1]).strip(), self.resolve(entities.unescape(src[1]), path), int(order) if order.isdigit() else i))
        return sorted(out, key=lambda e: e[2])

    def _nav(self, path: str) -> list[tuple[str, str, int]]:
        inside = " ".join(re.findall(r"(?s)<nav\b.*?</nav>", self.text(path)))
        links = re.findall(r'(?s)<a\b[^>]*\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', inside)
        labels = [(_spaced(entities.unescape(re.sub("<[^>]+>", "", x))), entities.unescape(h)) for h, x in links]
        return [(x, self.resolve(h, path), i) for i, (x, h) in enumerate(labels) if x]


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    """book, label, href, play_order of every entry of every EPUB under path."""

    def run(batches):
        for b in batches:
            rows = [(p, *e) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for e in Archive(c).toc()]
            yield pa.RecordBatch.from_pylist([dict(zip(("book", "label", "href", "play_order"), r, strict=True)) for r in rows], schema=pa.schema([("book", pa.string()), ("label", pa.string()), ("href", pa.string()), ("play_order", pa.int32())]))

    return _archives(spark, path).mapInArrow(run, "book string, label string, href string, play_order int")


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")


_RAW = pa.schema([
    ("book", pa.string()), ("href", pa.string()), ("label", pa.string()), ("play_order", pa.int32()),
    ("blocks", pa.list_(pa.struct([("text", pa.string()), ("tag", pa.string()), ("italic_ranges", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))),
])
_RAW_DDL = "book string, href string, label string, play_order int, blocks array<struct<text:string,tag:string,italic_ranges:array<struct<start:int,end:int>>>>"


def read_entries(spark: SparkSession, path: str, adapter: str = "generic") -> DataFrame:
    """One row for each entry of a table of contents whose document is there: its raw blocks, titles that are repeated left out."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                book = Archive(data)
                italic = book.italics()
                for label, href, order in book.toc():
                    if href not in book.names:
                        continue
                    blocks = []
                    for node in leaf_blocks(content_root(_Tree(book.text(href)).root, adapter)):
                        text, ranges = extract_block(node, italic)
                        if node.tag in BREAK_TAGS:
                            blocks.append({"text": "* * *", "tag": node.tag, "italic_ranges": []})
                        elif text and not skipped(adapter, node.tag, text, len(blocks)):
                            blocks.append({"text": text, "tag": node.tag, "italic_ranges": [{"start": a, "end": z} for a, z in ranges]})
                    yield pa.RecordBatch.from_pylist([{"book": name, "href": href, "label": label, "play_order": order, "blocks": blocks}], schema=_RAW)

    return _archives(spark, path).mapInArrow(run, _RAW_DDL)


def chapter_label(label: Column) -> Column:
    """struct(number, title, side) of a label; number null where it names no chapter."""
    number = F.regexp_extract(label, CHAPTER_LABEL, 1)
    title = F.trim(F.regexp_extract(label, CHAPTER_LABEL, 2))
    hit = label.rlike(CHAPTER_LABEL)
    return F.struct(F.when(hit, number.cast("double")).alias("number"), F.when(hit & (title != ""), title).otherwise(F.trim(label)).alias("title"), (~hit & label.rlike(SIDE_LABEL)).alias("side"))


def chapter_range(spec: str) -> tuple[float, float]:
    """ "1-199", "1" or "5-" as bounds, both included."""
    low, dash, high = spec.strip().partition("-")
    if not dash:
        return float(low), float(low)
    return float(low) if low.strip() else float("-inf"), float(high) if high.strip() else float("inf")


def chapter_entries(entries: DataFrame, wanted: tuple[float, float] | None = None) -> DataFrame:
    """Entries that are chapters: with a number, in the range wanted, and before the appendix that begins at an appendix heading after the first chapter."""
    e = entries.withColumn("_l", chapter_label(F.col("label")))
    order = Window.partitionBy("book").orderBy("play_order", "href").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.max(F.col("_l.number").isNotNull()).over(order)
    appendix = F.col("_l.number").isNull() & F.lower(F.trim("label")).isin(*rules.APPENDIX_HEADINGS)
    e = e.withColumn("_seen", seen).withColumn("_out", F.max(appendix & F.col("_seen")).over(order))
    kept = e.filter(F.col("_l.number").isNotNull() & ~F.col("_out"))
    if wanted:
        kept = kept.filter(F.col("_l.number").between(*wanted))
    return kept.select(*entries.columns, F.col("_l.number").alias("number"), F.col("_l.title").alias("title"))


def typed_blocks(blocks: Column) -> Column:
    """Raw blocks with their kinds: a break is not part of the story, and after the first note all blocks are notes."""
    kind = lambda b: F.when(b["tag"].isin(*BREAK_TAGS), "NON_DIEGETIC").otherwise(block_type(b["text"], b["tag"].rlike("^h[1-6]$")))
    own = F.transform(blocks, lambda b: F.struct(b["text"].alias("text"), b["tag"].alias("tag"), b["italic_ranges"].alias("italic_ranges"), kind(b).alias("kind")))
    first = F.array_position(F.transform(own, lambda b: b["kind"].isin("TRANSLATOR_NOTE", "AUTHOR_NOTE")), True)
    note = lambda i: (first > 0) & (i + 1 > first)
    return F.transform(own, lambda b, i: F.struct(
        i.cast("int").alias("index"), F.when(note(i) & ~b["tag"].isin(*BREAK_TAGS), "TRANSLATOR_NOTE").otherwise(b["kind"]).alias("block_type"), b["text"].alias("text"),
        b["italic_ranges"].alias("italic_ranges"), F.when(b["kind"] == "SYSTEM_WINDOW", system_fields(b["text"])).alias("system_fields"),
    ))


def chapters(entries: DataFrame, novel_id: str, wanted: tuple[float, float] | None = None) -> DataFrame:
    """Chapters of read_entries; entries without blocks are none."""
    rows = chapter_entries(entries, wanted).filter(F.size("blocks") > 0)
    return rows.select(F.lit(novel_id).alias("novel_id"), "number", "title", F.col("href").alias("source_href"), typed_blocks(F.col("blocks")).alias("blocks"))


def gaps(chapters_: DataFrame, wanted: tuple[float, float] | None = None) -> DataFrame:
    """Whole numbers that are missing between the first and last chapter of each novel, inside the range wanted."""
    ends = chapters_.groupBy("novel_id").agg(F.ceil(F.min("number")).alias("a"), F.floor(F.max("number")).alias("z"))
    if wanted:
        low, high = (None if abs(w) == float("inf") else int(w) for w in wanted)
        ends = ends.select("novel_id", F.lit(low).alias("a") if low is not None else "a", F.lit(high).alias("z") if high is not None else "z")
    all_ = ends.filter("a <= z").select("novel_id", F.explode(F.sequence(F.col("a").cast("long"), F.col("z").cast("long"))).alias("number")).select("novel_id", F.col("number").cast("double").alias("number"))
    return all_.join(chapters_.select("novel_id", "number"), ["novel_id", "number"], "left_anti")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """id, title, path, adapter, first, last, lexicon of every novel that a TOML file lists."""
    novels = tomllib.loads(spark.read.text(path, wholetext=True).first()[0]).get("novel", [])  # one small file by its nature
    rows = []
    for n in novels:
        first, last = chapter_range(n["chapters"]) if n.get("chapters") else (None, None)
        rows.append((n["id"], n.get("title", n["id"]), n["path"], n.get("adapter", "generic"), first, last, n.get("lexicon")))
    return spark.createDataFrame(rows, "id string, title string, path string, adapter string, first double, last double, lexicon string")


def lexicon_toml(classes: dict[str, list[str]], **head: str) -> str:
    """A lexicon as TOML: sorted lists by class, the head's values first. read_lexicon reads it back."""
    quoted = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = [f"{k} = {quoted(v)}" for k, v in head.items()]
    return "\n".join(lines + [f"{k} = [{', '.join(map(quoted, sorted(set(v))))}]" for k, v in sorted(classes.items())]) + "\n"
