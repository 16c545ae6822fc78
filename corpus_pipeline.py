"""A corpus pipeline: language ID, quality, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in
the shared folder and reads it again as the next stage's documents. Filtering stages
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import exact_dedup, language_id, ngram_join, packing, quality_ranker
from ledgerline.llm.common import DOCUMENT_COLUMNS, fold, table
from ledgerline.storage import scratch_folder

#: Near duplicates: word shingles and Jaccard similarity in percent.
SHINGLE, SIMILARITY = 5, 80
#: Runs that the encoder remembers: half as usual, as the executors' heaps have grown in the stages before.
REMEMBERED = 250_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified: null texts, texts without letters and texts far from every language go."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    model = language_id.train(docs, fold(F.col("doc_id"), 3) != 1)
    return language_id.identify(docs, model).where("not rejected").select(*DOCUMENT_COLUMNS)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the ranker's cut; those that it scores below go.

    Null texts count as empty ones. Rows that repeat go or stay together. Where no label is
    known all stay; no row gives none.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    model = quality_ranker.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return quality_ranker.score(docs, model).where(F.col("score") >= model.cut).select(*DOCUMENT_COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; null counts as empty, a null id as below all, and of rows that repeat one stays."""
    return exact_dedup.drop_duplicates(docs.select(*DOCUMENT_COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; documents without a word or an id stay, and so do all rows of an id that stays."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    groups = ngram_join.similar_groups(docs, shingle=SHINGLE, percent=SIMILARITY)
    gone = groups.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that were kept: a null text is the end token alone, rows that repeat are packed each, a null id stays null, no row gives no piece."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("packing", pack),
]

#: Trained models and token ids have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents of ``sf_dir``."""
    folder = f"{scratch_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
