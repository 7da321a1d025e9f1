"""A corpus pipeline over ``documents``: language, toxicity, exact copies, near copies, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's documents. All but
the last return the columns of their input, in its order and with its values, whatever the columns are called.

Defined results: documents without a letter (null and empty texts among them) are rejected by the first stage as of no language, all
others are kept; documents with a toxicity score of 0.5 or more are rejected by the second. Of equal texts, and of repeated rows, one
row stays; rows with a null id are copies like others but only give way to rows with an id. Of each group of near copies the smallest
id stays; rows with a null id stay. An empty table passes through as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.llm import exact_dedup, language, ngram_join, packing, toxicity
from plantpulse.llm.common import table
from plantpulse.scratch import ensure_shared_folder
from plantpulse.session import stored

#: the stages' decisions depend on fitted models, which SQL cannot express
ORACLE_SQL = None


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, whatever languages were learned, if any."""
    model = language.fit(language.labelled_sample(docs))
    found, score = _unused(docs, "lang_pred"), _unused(docs, "score")
    scored = language.with_predictions(docs, model, found, score, unlearned=None)
    return scored.filter(F.col(found).isNull() | (F.col(score) > 0)).select(*docs.columns)  # a language may itself be called ``und``


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents."""
    model = toxicity.trained(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    score = _unused(docs, "score")
    return toxicity.with_scores(docs, model, score).filter(F.col(score) < 0.5).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text."""
    found = exact_dedup.exact_groups(docs)
    dropped = stored(found.filter("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_hash")).distinct())
    repeated = stored(found.filter("kept AND group_size > 1").groupBy("doc_id", "text_sha256").count().filter("count > 1")
                      .select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_hash")))
    digest = F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256)
    own = _unused(docs, "_digest")
    rows = docs.withColumn(own, digest)

    def among(names: DataFrame):
        return rows["doc_id"].eqNullSafe(names["_id"]) & (rows[own] == names["_hash"])

    staying = rows.join(dropped, among(dropped), "left_anti")
    once = staying.join(repeated, staying["doc_id"].eqNullSafe(repeated["_id"]) & (staying[own] == repeated["_hash"]), "left_anti")
    if repeated.isEmpty():
        return once.drop(own)
    longest = F.max_by(F.struct(*docs.columns), F.struct(F.length(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit(""))))
    several = staying.join(repeated, staying["doc_id"].eqNullSafe(repeated["_id"]) & (staying[own] == repeated["_hash"]), "left_semi")
    first = several.groupBy("doc_id", own).agg(longest.alias("_row")).select("_row.*")
    return once.drop(own).unionByName(first)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that 0.8 similar word shingles connect."""
    dropped = ngram_join.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(stored(dropped), "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the pieces of all documents in sequences of 2048 tokens."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("language_id", with_language),
    ("toxicity", not_toxic),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", without_near_copies),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the pieces of the documents that stay."""
    ensure_shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
