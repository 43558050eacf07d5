"""A training-data pipeline over the table ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame;
all but the last return the columns of documents.  ``run`` writes each stage's rows as Parquet to the shared
folder and reads them again for the next, so a lost executor costs no more than the stage at work.

Defined cases: null and empty texts pass the filters (they score as clean, have no shingles and no secrets)
and are left out of the mix, which takes words; of rows that share an id the second stage keeps one; other
columns stay as they are up to the last stage; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlens.llm import jaccard, mixing, pieces, secrets, toxicity
from kvlens.llm.common import Scratch, documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels and on these documents, doesn't reject."""
    model, lm = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "pipeline-toxicity"))
    return toxicity.reject(docs, model, lm)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 and more."""
    return jaccard.one_of_each(docs, Scratch(spark, "pipeline-jaccard"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark; n_chars follows the text."""
    ratios = secrets.log_ratios(secrets.train(docs))
    clean = secrets.redact(docs, ratios)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights: each document as often as the mix takes it."""
    return mixing.resample(docs, Scratch(spark, "pipeline-mixing"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids, n_pieces, lossless of every document in the mix; each copy is segmented anew."""
    return pieces.encode(docs, copies=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The models, the sketches and the vocabulary can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
