"""From raw documents to packed sequences; each stage reads what its predecessor kept.

``run(spark, sf_dir)`` writes every stage's result as Parquet below
``spark.checkpoint.dir`` and reads it back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracehold.llm import stages
from tracehold.llm.plans import prepared
from tracehold.session import stage

#: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("quality", stages.keep_good),
    ("near_duplicates", stages.keep_one_of_each_group),
    ("decontamination", stages.drop_contaminated),
    ("personal_data", stages.sanitize),
    ("packing", stages.pack),
]

#: The trained classifier and the packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all kept documents."""
    prepared(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
