"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import centroids, chunks, decontaminate, language, periods, pieces, pii, quality, secrets, simhash, suffix_tree, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_quality": quality.op3_quality,
    "op4_suffix_tree": suffix_tree.op4_suffix_tree,
    "op5_simhash": simhash.op5_simhash,
    "op6_pieces": pieces.op6_pieces,
    "op7_secrets": secrets.op7_secrets,
    "op8_language": language.op8_language,
    "op9_pii": pii.op9_pii,
    "op10_chunks": chunks.op10_chunks,
    "op11_periods": periods.op11_periods,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_centroids": centroids.op13_centroids,
    "pipeline": corpus_pipeline.run,
}

#: The rest depends on models, on XXH64 or on alignments; tests hold it against brute force.
SQL: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op7_secrets": secrets.SQL,
    "op13_centroids": centroids.SQL,
}
