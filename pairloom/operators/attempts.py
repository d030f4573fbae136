"""Choosing among several generated texts per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import values as V
from pairloom.functions.text import clean_brackets, truncate_at_period


def null_passages(df: DataFrame, text: str = "generated_passage") -> DataFrame:
    """Rows that still need a passage."""
    return df.where(F.col(text).isNull())


def _first(attempts: DataFrame, keys: list[str], text: Column, valid: Column, n: int) -> DataFrame:
    """Earliest valid attempt per item among the first ``n``.

    The number of the attempt is found first, by an aggregate that combines on
    the map side; its text joins afterwards. An item numbers each attempt once.
    """
    tries = attempts.where(F.col("attempt") <= n)
    number = F.min(F.when(valid, F.col("attempt"))).alias("_at")
    best = tries.groupBy(*keys).agg(number, F.count(F.lit(1)).alias("_tried"))
    texts = tries.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("attempt").alias("_n"), text.alias("_text"))
    on = F.col("_at") == F.col("_n")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ok = F.when(F.col("_at").isNotNull(), F.struct(F.col("_at").alias("attempt"), F.col("_text").alias("text")))
    return best.join(texts, on, "left").select(*keys, ok.alias("_ok"), "_tried")


def first_valid_attempt(
    attempts: DataFrame,
    keys: list[str],
    text: str = "text",
    max_attempts: int = 10,
    lo: int = 300,
    hi: int = 500,
) -> DataFrame:
    """The first attempt whose length lies in ``lo..hi``, or null.

    ``attempts`` numbers the tries of an item from 1 in ``attempt``. Adds
    generated_passage, passage_length, retries_used, success and error.
    """
    chosen = _first(attempts, keys, F.col(text), F.length(text).between(lo, hi), max_attempts)
    ok = F.col("_ok").isNotNull()
    return chosen.select(
        *keys,
        F.col("_ok.text").alias("generated_passage"),
        F.length("_ok.text").alias("passage_length"),
        F.when(ok, F.col("_ok.attempt") - 1).otherwise(F.col("_tried")).cast("int").alias("retries_used"),
        ok.alias("success"),
        F.when(~ok, F.lit(V.RETRIES_EXCEEDED.format(n=max_attempts))).alias("error"),
    )


def regenerated(
    attempts: DataFrame, keys: list[str], text: str = "text", max_attempts: int = 5, lo: int = 300, hi: int = 500
) -> DataFrame:
    """A replacement passage per item out of new attempts.

    Bracketed notes are removed first. The first attempt of at least ``lo``
    characters is taken, cut at a period when longer than ``hi``; items
    without one get the failure text.
    """
    cleaned = clean_brackets(text)
    chosen = _first(attempts, keys, truncate_at_period(cleaned, hi), F.length(cleaned) >= lo, max_attempts)
    return chosen.select(*keys, F.coalesce("_ok.text", F.lit(V.PASSAGE_FAILED)).alias("generated_passage"))


def fill_nulls(passages: DataFrame, replacements: DataFrame, keys: list[str]) -> DataFrame:
    """Passages with null texts replaced; a null without attempt becomes the failure text."""
    new = replacements.select(*keys, F.col("generated_passage").alias("_new"))
    kept = passages.where(F.col("generated_passage").isNotNull())
    filled = (
        null_passages(passages)
        .join(new, keys, "left")
        .withColumn("generated_passage", F.coalesce("_new", F.lit(V.PASSAGE_FAILED)))
        .select(*passages.columns)
    )
    return kept.unionByName(filled)
