"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, toxicity
from .chat import chat_digests, json_records
from .decontaminate import decontaminate
from .hnsw import nearest
from .neardup import near_duplicates
from .oracle import ORACLE_SQL as ORACLE_SQL
from .packing import pack_documents
from .rans import token_files
from .secrets import scan_secrets
from .staging import read_table
from .substrings import remove_repeats


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = json_records(spark, [{"conv_id": -7, "messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]}])
    return chat_digests(read_table(spark, sf_dir, "conversations"), more)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, by folds; rows without an id are in fold 1."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds, F.lit(1).cast("long"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels, fold("_id", 5) != 0), fold("doc_id", 5) == 0)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs, fold("doc_id", 4) != 2), fold("doc_id", 4) == 2)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: contaminated, kept (the opposite), and the items found, as text."""
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", (~F.col("contaminated")).alias("kept"), "similarity", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("items"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_token_files": op2_token_files,
    "op3_packing": op3_packing,
    "op4_repeats": op4_repeats,
    "op5_chat": op5_chat,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_language": op8_language,
    "op9_nearest": op9_nearest,
    "op10_decontaminate": op10_decontaminate,
}
