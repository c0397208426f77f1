"""A corpus pipeline: five stages from documents to encoded documents.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before
it kept; all but the last return the columns of documents. A table in the shared
folder separates stages.

Defined results: null, empty and letterless texts go with the first stage; very long texts are whole in
every stage; near duplicates and contaminated documents go by doc_id: rows that repeat an id share its
decision (repeated rows stay together, texts of one id go together), rows without an id stay there; other columns
are carried along, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import bpe, decontaminate, jaccard, language, lines
from keyfold.llm.common import save, small_batches, table

#: A language is rejected below this score; `und` always is.
LEAST_SCORE = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or with no credible language."""
    small_batches(spark)
    found = language.predict(docs, language.fit(docs), keep=docs.columns)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; a document of which nothing is left goes."""
    cut = lines.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.replace("text", F.lit("\n"), F.lit(""))) == "")
    return cut.where(~emptied).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the least doc_id stays."""
    found = jaccard.join(docs, n=5, percent=80)
    # who goes is the smaller side, and only ids are moved
    gone = save(found.where("doc_id <> component_id").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark windows to a twentieth of their words or more."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    gone = save(found.where("contaminated").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, as digests, and the digest of what they decode to."""
    return bpe.digests(docs, bpe.default_path())


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_near),
    ("contamination", drop_contaminated),
    ("encode", encode),
]

#: The language stage learns weights, which SQL does not express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = save(docs)
    return docs
