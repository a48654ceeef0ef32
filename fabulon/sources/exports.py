"""What goes in and out as files: gold and corrections, entities, payloads, manifests, voices, caches, subtitles."""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fabulon.operators.production import ass_events
from fabulon.sources.files import CORRECTION, GOLD


def _missing(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold mentions; a missing file is an empty set."""
    return spark.createDataFrame([], GOLD) if _missing(spark, path) else spark.read.schema(GOLD).json(path)


def write_gold(gold: DataFrame, path: str) -> None:
    """Gold mentions as JSON lines in the order of chapter and offset."""
    gold.orderBy("chapter", "offset", "surface").write.mode("overwrite").json(path)


def append_corrections(rows: DataFrame, path: str) -> None:
    rows.select("id", "novel_id", "type", "payload", "created_at", "applied").write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Corrections by id, each in its last written state: one that was applied stays applied."""
    if _missing(spark, path):
        return spark.createDataFrame([], CORRECTION)
    rows = spark.read.schema(CORRECTION).json(path)
    return rows.groupBy("id").agg(F.max_by(F.struct("novel_id", "type", "payload", "created_at"), "created_at").alias("s"), F.max(F.coalesce("applied", F.lit(False))).alias("applied")).select("id", "s.*", "applied")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def entity_lines(mentions: DataFrame, selves: DataFrame, evidence: int = 5) -> DataFrame:
    """One JSON text for each entity: label, mentions, chapters, aliases by frequency, alias types, first evidence."""
    m = mentions.filter("target_id is not null")
    forms = m.groupBy("target_id", "text").agg(F.count("*").alias("n")).groupBy("target_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "text"))), lambda s: s["text"]).alias("aliases"))
    kinds = m.groupBy("target_id", "alias_type").agg(F.count("*").alias("n")).groupBy("target_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("alias_type", "n")))).alias("alias_types"))
    first = m.withColumn("_r", F.row_number().over(Window.partitionBy("target_id").orderBy("chapter", "block_index", "offset"))).filter(F.col("_r") <= evidence).groupBy("target_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "chapter", "offset", F.col("text").alias("surface")))), lambda s: F.struct(s["chapter"].alias("chapter"), s["offset"].alias("offset"), s["surface"].alias("surface"))).alias("evidence"))
    n = m.groupBy("target_id").agg(F.count("*").alias("mentions"), F.min("chapter").alias("first_chapter"), F.max("chapter").alias("last_chapter"))
    rows = n.join(forms, "target_id").join(kinds, "target_id").join(first, "target_id").join(selves.select(F.col("id").alias("target_id"), F.col("canonical_label").alias("label")), "target_id", "left")
    line = F.to_json(F.struct("target_id", "label", "mentions", "first_chapter", "last_chapter", "aliases", "alias_types", "evidence", F.lit("MACHINE").alias("provenance")))
    return rows.select(line.alias("value"), (-F.col("mentions")).alias("_o"), "target_id").orderBy("_o", "target_id").select("value")


def graph_json(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One JSON text of nodes (id, label, n) and edges (a, b, weight, first) among the top entities of a graph."""
    n = nodes.agg(F.sort_array(F.collect_list(F.struct("id", "label", "n"))).alias("nodes"))
    e = pairs.agg(F.sort_array(F.collect_list(F.struct("a", "b", "weight", "first"))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct("nodes", "edges")).alias("value"))  # one row each: the graph's top nodes


def cache_key(model: str, text: str = "text"):
    """Key of a cached answer: the model and the first 16 digits of the text's SHA-256."""
    return F.concat_ws(":", F.lit(model), F.substring(F.sha2(F.col(text), 256), 1, 16))


def uncached(chapters: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Chapters that a cache (key) has no answer for."""
    return chapters.withColumn("key", cache_key(model, text)).join(cache.select("key"), "key", "left_anti")


def vctk_speakers(spark: SparkSession, path: str) -> DataFrame:
    """speaker_id, age, gender, accent, region of a speaker table in aligned columns."""
    p = r"^\s*p?(\d+|\w\d+)\s+(\d+)\s+([MFmf])\s+(\S+)\s*(.*)$"
    part = lambda i: F.regexp_extract("value", p, i)
    rows = spark.read.text(path).filter(F.col("value").rlike(p) & ~F.upper(F.ltrim("value")).startswith("ID"))
    return rows.select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("speaker_id"), part(2).cast("int").alias("age"), F.when(F.upper(part(3)) == "M", "male").otherwise("female").alias("gender"), part(4).alias("accent"), F.trim(part(5)).alias("region"))


def cremad_voices(files: DataFrame, demographics: DataFrame) -> DataFrame:
    """Clips (path named ACTOR_SENTENCE_EMOTION_LEVEL.wav) as voices: the strongest of each actor and emotion, with the actor's age and gender (ActorID, Age, Sex)."""
    name = F.regexp_extract("path", r"(\d+)_(\w+)_(\w+)_(\w+)\.wav$", 0)
    part = lambda i: F.regexp_extract("path", r"(\d+)_([A-Z]+)_([A-Z]+)_([A-Z]+)\.wav$", i)
    level = F.when(part(4) == "HI", 3).when(part(4) == "MD", 2).when(part(4) == "LO", 1).otherwise(0)
    rows = files.filter(name != "").select(part(1).alias("actor"), part(3).alias("emotion"), level.alias("level"), "path")
    best = rows.groupBy("actor", "emotion").agg(F.max(F.struct("level", "path"))["path"].alias("path"))
    d = demographics.select(F.col("ActorID").cast("string").alias("actor"), F.col("Age").cast("int").alias("age"), F.lower("Sex").alias("gender"))
    return best.join(d, "actor", "left")


@F.pandas_udf(DoubleType())
def _seconds(content: pd.Series) -> pd.Series:
    out = []
    for c in content:
        try:
            with wave.open(io.BytesIO(c)) as w:
                out.append(w.getnframes() / float(w.getframerate()))
        except (wave.Error, EOFError, ZeroDivisionError):
            out.append(None)
    return pd.Series(out, dtype="float64")


def wav_durations(spark: SparkSession, path: str) -> DataFrame:
    """path, seconds of every WAV file under path; null seconds for one that cannot be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", _seconds("content").alias("seconds"))


def write_ass(captions: DataFrame, path: str, width: int = 1920, height: int = 1080, font: str = "Arial") -> None:
    """Captions as the lines of an ASS file: head, then events by start."""
    head = ["[Script Info]", "ScriptType: v4.00+", f"PlayResX: {width}", f"PlayResY: {height}", "", "[V4+ Styles]", "Format: Name, Fontname, Fontsize", f"Style: Default,{font},48", "", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"]
    spark = captions.sparkSession
    top = spark.createDataFrame([(0, float(i), x) for i, x in enumerate(head)], "part int, at double, value string")
    events = ass_events(captions).select(F.lit(1).alias("part"), F.col("start").alias("at"), F.col("line").alias("value"))
    top.unionByName(events).coalesce(1).sortWithinPartitions("part", "at").select("value").write.mode("overwrite").text(path)


def wiki_canon(rows: DataFrame) -> DataFrame:
    """(label, key, value) as one map of traits for each label; of a repeated key the least value."""
    return rows.groupBy("label", "key").agg(F.min("value").alias("value")).groupBy("label").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("traits"))


def plain_wiki(text):
    """Wiki text without references, comments, templates, links' targets, tags and quote marks."""
    for pattern, to in ((r"(?s)<!--.*?-->", ""), (r"(?s)<ref[^>/]*/>|<ref[^>]*>.*?</ref>", ""), (r"(?s)\{\{[^{}]*\}\}", ""), (r"(?s)\{\{[^{}]*\}\}", ""), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), (r"<[^>]+>", ""), (r"'{2,}", ""), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def wiki_section(text, heading: str):
    """What stands under a heading, up to the next of its rank or above; empty without it."""
    return F.trim(F.regexp_extract(text, rf"(?s)(?:^|\n)==\s*{heading}\s*==\s*\n(.*?)(?=\n==[^=]|\z)", 1))
