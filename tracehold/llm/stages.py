"""The stages of the corpus pipeline; each calls one operator and returns what it decides.

All but the last return the columns of ``documents``.  Null and empty texts
have no groups, hits or spans, so only the classifier may reject them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracehold.llm.plans import prepared

#: Words of a shingle where no contract says otherwise.
SHINGLE_WORDS = 5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    from tracehold.llm.quality import score_quality

    prepared(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, labels, keep=docs.columns)
    return scored.where("predicted = 1").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: the smallest id, null ids last, ties by the text's hash."""
    from tracehold.llm.near_duplicates import keep_one_row

    prepared(spark)
    return keep_one_row(docs, words_per_shingle=SHINGLE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    from tracehold.llm.decontaminate import decontaminate

    prepared(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, benchmark, keep=docs.columns)
    return found.where("not contaminated").select(*docs.columns)


def sanitize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and terms that reveal it generalised; ``n_chars`` follows the text."""
    from tracehold.llm.personal_data import sanitize_documents

    prepared(spark)
    clean = sanitize_documents(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces in packed sequences."""
    from tracehold.llm.packing import pack_documents

    prepared(spark)
    return pack_documents(docs, "byte_bpe_50k.json", end_id=2)
