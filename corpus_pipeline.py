"""documents -> quality -> toxicity -> near-duplicates -> mixing -> packed pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in
the shared folder and reads it again for the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import mixing, near_copies, packing, quality, toxicity
from pagelens.llm.storage import written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of poor quality go; the others stay as they are.

    Null and empty texts are scored like texts without features; repeated rows are decided alike; extra
    columns of any names stay; an empty table gives no rows.
    """
    return quality.keep_good(docs, quality.fit(docs, _labels(spark, sf_dir)))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the others stay as they are.

    Null and empty texts count as texts without words; repeated rows are decided alike; extra columns of
    any names stay; an empty table gives no rows.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id: five-word shingles, similarity 0.8 or more.

    Null and blank texts are one group; of rows that share the kept id one stays; rows with a null id stay;
    extra columns of any names stay; an empty table gives no rows.
    """
    return near_copies.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null texts have no words; null sources are one source; rows of equal ids (null included) are taken
    alike; extra columns of any names stay; an empty table gives no rows.
    """
    return mixing.emitted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in windows of 2048 tokens; all tokens of all rows, each once.

    Null and empty texts are their end mark; repeated rows are packed each by itself; a null id stays;
    further columns are left out; an empty table gives no rows.
    """
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Models, fingerprints and token ids can't be expressed in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
