"""The queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulon.llm import chat, jaccard, language, licenses, media, packing, pieces, spherical, suffixes, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(turns.unionByName(extra)))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_media(media.store_text(_table(spark, sf_dir, "documents")))
    clips = F.concat_ws(";", F.transform("clips", lambda c: F.concat_ws(":", c["first"].cast("string"), c["frames"].cast("string"), c["start_ms"].cast("string"), c["brightness"].cast("string"))))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat(F.col("n_frames").cast("string"), F.lit("|"), clips).alias("feature"), F.size("clips").cast("long").alias("n_clips"))


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    decoded = pieces.decode_pieces(pieces.encode_pieces(_table(spark, sf_dir, "documents"), model), model)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_similar(_table(spark, sf_dir, "documents"))


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_chat_format, op3_media_columns, op4_length_buckets, op5_spherical_caps, op6_suffix_sort, op7_piece_codec, op8_ngram_join, op9_toxicity_cnn, op10_language_id)}
SQL = {"op1_license_scan": licenses.scan_sql()}
