"""Sources and sinks: books as XHTML, gold and correction logs as JSON lines, lexicons, the fact store as Parquet."""

from __future__ import annotations

import io
import re
import tomllib
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulon.functions.text import block_type
from fabulon.schema import SCHEMAS

GOLD = "novel_id string, chapter double, offset int, surface string, identity string, kind string, context string, provenance string, drafted_by string, confirmed boolean, note string"
CORRECTION = "id string, novel_id string, type string, payload string, created_at double, applied boolean"


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """path, href, html for each content document of each EPUB, in spine order. Read through Spark, so any store works."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for i, href in enumerate(_spine(z)):
                        rows.append((name, i, href, z.read(href).decode("utf-8", "replace")))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["path", "number", "href", "html"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")
    return files.mapInArrow(unpack, "path string, number int, href string, html string")


def _spine(z: zipfile.ZipFile) -> list[str]:
    """Content documents in reading order, from the package file; without one, by name."""
    names = set(z.namelist())
    opf = next((n for n in sorted(names) if n.endswith(".opf")), None)
    if opf is None:
        return sorted(n for n in names if re.search(r"\.x?html?$", n))
    text, base = z.read(opf).decode("utf-8", "replace"), opf.rpartition("/")[0]
    items = {}
    for tag in re.findall(r"<(?:\w+:)?item\b[^>]*>", text):
        a = dict(re.findall(r'([\w-]+)\s*=\s*"([^"]*)"', tag))
        items[a.get("id")] = f"{base}/{a.get('href', '')}".lstrip("/")
    order = [items.get(i) for i in re.findall(r'<(?:\w+:)?itemref\b[^>]*\bidref\s*=\s*"([^"]*)"', text)]
    return [h for h in order if h in names]


def html_blocks(html: Column) -> Column:
    """Text of the paragraphs and headings of an XHTML document, tags off, entities read."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>", "")
    parts = F.regexp_extract_all(bare, F.lit(r"(?is)<(?:p|h[1-6]|li|blockquote)\b[^>]*>(.*?)</(?:p|h[1-6]|li|blockquote)>"), F.lit(1))
    plain = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", ""), r"\s+", " "))
    out = F.transform(parts, plain)
    for entity, char in (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.transform(out, _replaced(entity, char))
    return out


def _replaced(old: str, new: str):
    return lambda t: F.replace(t, F.lit(old), F.lit(new))


def chapters(pages: DataFrame, novel_id: str) -> DataFrame:
    """Chapters with typed blocks from (number, href, html)."""
    blocks = F.transform(html_blocks(F.col("html")), lambda t, i: F.struct(i.alias("index"), block_type(t).alias("block_type"), t.alias("text")))
    return pages.select(F.lit(novel_id).alias("novel_id"), F.col("number").cast("double").alias("number"), F.col("href").alias("source_href"), blocks.alias("blocks"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).json(path)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORRECTION).json(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(class, term) of a TOML lexicon: every list of strings is a class."""
    text = spark.read.text(path, wholetext=True).first()[0]  # one small file by its nature

    def walk(name, value):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(k, v)
        elif isinstance(value, list):
            yield from ((name, x) for x in value if isinstance(x, str))

    return spark.createDataFrame(sorted(walk("", tomllib.loads(text))), "class string, term string")


class FactStore:
    """Append-only tables in one folder, a Parquet dataset each, with the schemas of fabulon.schema."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, name: str, rows: DataFrame) -> None:
        kind = self.spark.createDataFrame([], SCHEMAS[name]).schema
        rows.select(*[F.col(f.name).cast(f.dataType) for f in kind]).write.mode("append").parquet(f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def replace_chapters(self, name: str, rows: DataFrame) -> None:
        """Writes rows over the (novel, chapter) partitions they belong to and no others."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("novel_id", "chapter").parquet(f"{self.root}/{name}_by_chapter")
