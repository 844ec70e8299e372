"""The corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes each
stage's rows as Parquet to the shared folder and reads them again. All stages but the last return the columns
of documents, whatever others there are.

Defined results: null and blank texts are scored like any other (a bag of one empty passage), are near-duplicates of nothing, hold no
benchmark passage and no personal data, and have one segmentation without pieces. Repeated rows are scored alike and leave one of their kind after
near-dedup. An empty table goes through all stages and leaves no row.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm.common import Scratch
from proofmill.llm.decontam import drop_contaminated
from proofmill.llm.minhash_dedup import minhash_dedup
from proofmill.llm.pii import mask_pii
from proofmill.llm.quality import keep_quality, learn_quality
from proofmill.llm.sp_sampling import sample_segmentations


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.7 or more)."""
    model = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_quality(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates (five-word shingles, similarity 0.8).

    Of rows that repeat a doc_id one stays. Rows without a doc_id stand behind all others, by their text: one of each text stays that is
    near no identified document.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))
    keyed = docs.withColumn("__key", key)
    found = minhash_dedup(keyed.select("__key", "text"), id_col="__key")
    first = keyed.join(found.where("kept").select("__key").distinct(), "__key", "left_semi")
    if found.count() > found.select("__key").distinct().count():
        first = first.dropDuplicates(["__key"])
    return first.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows the text."""
    masked = mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled SentencePiece segmentations of each text: ids of each sample, with scores."""
    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", mask_personal_data),
    ("SentencePiece encoding", segment),
]

#: SQL cannot express the trained and sampled stages; tests/llm hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
