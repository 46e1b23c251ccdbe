"""Sliding windows of words over prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import words

WINDOW, STRIDE = 400, 320
ENRICH_WINDOW, ENRICH_OVERLAP = 12_000, 400


def chunk_count(n: Column, window: int = WINDOW, stride: int = STRIDE) -> Column:
    """How many windows ``n`` words give: none for none, else as many as it takes to reach the last word."""
    return F.when(n <= 0, 0).when(n <= window, 1).otherwise(1 + F.ceil((n - window) / stride)).cast("int")


def enrich_count(n: Column) -> Column:
    """How many windows a model call takes: one up to the window's size, then a new one every stride to the very end."""
    stride = ENRICH_WINDOW - ENRICH_OVERLAP
    return F.when(n <= 0, 0).when(n <= ENRICH_WINDOW, 1).otherwise(F.ceil(n / stride)).cast("int")


def chunk(texts: DataFrame, keys: list[str], text: str = "text", window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """keys..., ordinal (from 0), body: windows of ``window`` words every ``stride``, joined by single blanks.

    The last window is the first that reaches the end. Null, empty and blank texts give no rows.
    """
    cut = texts.select(*keys, words(text).alias("_w")).withColumn("_n", chunk_count(F.size("_w"), window, stride)).where(F.col("_n") > 0)
    pieces = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.array_join(F.slice(F.col("_w"), i * stride + 1, window), " "))
    return cut.select(*keys, F.posexplode(pieces).alias("ordinal", "body"))


def windows_of(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys..., ordinal, body: the windows of model calls, whose last may lie wholly in the one before it."""
    stride = ENRICH_WINDOW - ENRICH_OVERLAP
    cut = texts.select(*keys, words(text).alias("_w")).withColumn("_n", enrich_count(F.size("_w"))).where(F.col("_n") > 0)
    pieces = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.array_join(F.slice(F.col("_w"), i * stride + 1, ENRICH_WINDOW), " "))
    return cut.select(*keys, F.posexplode(pieces).alias("ordinal", "body"))
