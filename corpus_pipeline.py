"""The corpus pipeline: five stages, each over all that the one before kept.

1. language ID: rows that the nearest-centroid model rejects go (no letters, or far from
   every language for their length); a null text goes.
2. MinHash near-dedup: of each group of near-duplicates the least doc_id stays; of rows
   that share an id the first by text. Rows without a doc_id come after all others. So a
   repeated row goes, an unlike one stays.
3. benchmark decontamination: documents with a window like a benchmark item go, each row
   judged on its own text, with an id or without.
4. secret scans: found spans are replaced by their kind; n_chars follows the text.
5. best-fit packing: the placements of all token pieces.

All but the last return the columns of documents. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelog.llm import langid
from mergelog.llm.decontaminate import contaminated_pairs
from mergelog.llm.neardup import near_duplicates
from mergelog.llm.packing import pack_documents
from mergelog.llm.secrets import mask_secrets
from mergelog.llm.skew import row_numbers
from mergelog.llm.staging import Staging, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, number, _ = row_numbers(docs, Staging(spark, "near-dedup"))
    kept = near_duplicates(keyed, number).where("kept").select(F.col("doc_id").alias(number))
    return keyed.join(kept, number, "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, number, _ = row_numbers(docs, Staging(spark, "decontamination"))
    leaked = contaminated_pairs(keyed, read_table(spark, sf_dir, "benchmark"), number).select(F.col("doc_id").alias(number)).distinct()
    return keyed.join(leaked, number, "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: Fitted models, tokens and packing are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs, staging = read_table(spark, sf_dir, "documents"), Staging(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staging.table(docs, f"stage-{k}")
    return docs
