"""The pN_ queries: each takes (spark, folder of the tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import dyadic_sketch, forest, keep_cutoff, leakage, packing, pii, splitter, truncation
from ledgerloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return keep_cutoff.kept_sessions(table(spark, folder, "sessions"), table(spark, folder, "keep_targets"))


def p1_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    found = keep_cutoff.session_cutoffs(table(spark, folder, "sessions"), table(spark, folder, "keep_targets"))
    return found.select("_as.source", "_as.provenance", "keep_pct", "n", "cutoff", "kept")


def p1_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The same cutoffs from a tree that is kept and added to in batches."""
    found = keep_cutoff.cutoffs_of_batches(table(spark, folder, "sessions"), table(spark, folder, "keep_targets"))
    return found.select("_as.source", "_as.provenance", "keep_pct", "n", "cutoff", "kept")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitter.split_sessions(table(spark, folder, "sessions"))


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitter.session_pieces(table(spark, folder, "sessions"))


def p2_checked(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces' conditions, as they aren't unique."""
    return splitter.session_pieces_checked(table(spark, folder, "sessions"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.session_kinds(table(spark, folder, "sessions"))


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted_sessions(table(spark, folder, "sessions"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return forest.similar_pairs(table(spark, folder, "chunk_vectors"))


def p4_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """All five neighbours, however far: no index separates those, so all vectors are compared with all."""
    near = forest.nearest(table(spark, folder, "chunk_vectors"), exact=True)
    return near.withColumn("cosine", F.round("cosine", 5))


def p5_daily(spark: SparkSession, folder: str) -> DataFrame:
    return dyadic_sketch.daily_percentiles(table(spark, folder, "sessions"))


def p5_span(spark: SparkSession, folder: str) -> DataFrame:
    return dyadic_sketch.span_percentiles(dyadic_sketch.session_sketches(table(spark, folder, "sessions")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return packing.split_documents(table(spark, folder, "documents"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(packing.pack_documents(table(spark, folder, "documents")))


def p6_checked(spark: SparkSession, folder: str) -> DataFrame:
    """The packing's conditions, as it isn't unique."""
    return packing.placed_whole(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(table(spark, folder, "documents"))


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_cutoffs, p1_batches, p2_found, p2_pieces, p2_checked, p3_found, p3_redacted, p4_found, p4_neighbors, p5_daily, p5_span, p6_found, p6_containers, p6_fill, p6_checked, p7_found, p8_found, p8_rates)}
