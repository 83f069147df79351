"""From raw documents to token ids in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import decontaminate, pieces, pii, quality, simhash
from scriptorium.llm._common import scratch, table

#: Rejected documents go; one document of each group of near duplicates stays; documents with a benchmark
#: item go; personal data in texts gives way to its kind; texts become token ids.
STAGES = [
    ("quality", quality.keep_good),
    ("near_duplicates", simhash.keep_one),
    ("decontamination", decontaminate.drop_contaminated),
    ("personal_data", pii.redact),
    ("tokens", pieces.tokenise),
]

#: The stages use fitted models, XXH64 fingerprints and alignments, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, round_trip, ids) of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
