"""Score-gap pairs as a set with addresses: any of 10 ** 15 pairs by its number, without the others.

Passages of a rubric and source stand in the order of their scores. One with
``below`` passages of a sufficiently lower score is the chosen side of that many
pairs, and these passages come first in the same order. So the sizes of score
levels say how many pairs stand before each level, and a pair's number leads to
its level, its chosen passage and its rejected one by division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.numbering import number_within
from pairloom.operators.pairs import score_levels, scored
from pairloom.storage import written

KEYS = ["rubric", "source_key"]
#: Digits of the digest by which sources are put in order: 4,096 buckets, whose totals are added up in one place.
BUCKET = 3


def _lot(rubric: Column, source: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", rubric.cast("string"), source.cast("string"))), 1, BUCKET)


def pair_ranges(scores: DataFrame, min_gap: float = 1) -> DataFrame:
    """Level of the chosen passage, and the numbers of its pairs: from ``first`` on, ``n * below`` of them.

    Numbers run over buckets of sources, sources, and levels from low to high.
    Levels without pairs are left out.
    """
    levels = score_levels(scores, min_gap).where("below > 0")
    levels = levels.select(*KEYS, "score", "n", "before", "below", (F.col("n") * F.col("below")).alias("n_pairs"))
    levels, _ = written(levels.withColumn("_lot", _lot(F.col("rubric"), F.col("source_key"))), "pair-ranges")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = levels.groupBy("_lot").agg(F.sum("n_pairs").alias("_n"))  # at most 16 ** BUCKET rows
    starts = totals.select("_lot", F.coalesce(F.sum("_n").over(earlier.orderBy("_lot")), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("n_pairs").over(earlier.partitionBy("_lot").orderBy(*KEYS, "score")), F.lit(0))
    return levels.withColumn("_in", inside).join(starts, "_lot").select(
        *KEYS, "score", "n", "before", "below", "n_pairs", (F.col("_start") + F.col("_in")).alias("first")
    )


def score_gap_pairs_at(scores: DataFrame, numbers: DataFrame, min_gap: float = 1, ranges: DataFrame | None = None) -> DataFrame:
    """The pairs with the given numbers: ``number``, rubric, source key, ids, scores and margin.

    ``numbers`` has one column ``number`` (from 0, each at most once); numbers
    beyond the last pair give no row. ``scores`` has no passage twice in a
    rubric. Pages are ranges of numbers; all numbers are all pairs. Work grows
    with passages and with the numbers asked for, not with the pairs there are.
    """
    ranges = pair_ranges(scores, min_gap) if ranges is None else ranges
    ranges, seen = written(ranges, "pair-ranges", total=F.sum("n_pairs"))
    numbers, asked = written(numbers.select("number"), "numbers", n=F.count(F.lit(1)))
    width = max(1, (seen["total"] or 0) // max(1, asked["n"]))  # a bin holds about one number
    bins = F.sequence(F.expr(f"first div {width}L"), F.expr(f"(first + n_pairs - 1) div {width}L"))
    spread = ranges.select("*", F.explode(bins).alias("_bin"))  # as many rows as levels and bins
    asked_bins = numbers.withColumn("_bin", F.expr(f"number div {width}L"))
    inside = (F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("n_pairs"))
    found = asked_bins.join(spread, "_bin").where(inside).withColumn("_at", F.col("number") - F.col("first"))
    found = found.select(
        "number", *KEYS, (F.col("before") + F.expr("_at div below") + 1).alias("_high"), (F.expr("_at % below") + 1).alias("_low")
    )
    places = number_within(
        scored(scores).select(*KEYS, "passage_id", "score"), KEYS, [F.col("score"), F.col("passage_id")], "_place"
    )
    places, _ = written(places, "places")
    chosen = places.select(*KEYS, F.col("_place").alias("_high"), F.col("passage_id").alias("chosen_id"), F.col("score").alias("high_score"))
    rejected = places.select(*KEYS, F.col("_place").alias("_low"), F.col("passage_id").alias("rejected_id"), F.col("score").alias("low_score"))
    return found.join(chosen, [*KEYS, "_high"]).join(rejected, [*KEYS, "_low"]).select(
        "number", *KEYS, "chosen_id", "rejected_id", "high_score", "low_score", (F.col("high_score") - F.col("low_score")).alias("margin")
    )


def drawn_numbers(spark, n: int, total: int, seed: int) -> DataFrame:
    """``n`` different numbers below ``total``: one from each of ``n`` stretches of equal length, by a seeded digest."""
    n = min(n, total)
    if n < 1:
        return spark.range(0).select(F.col("id").alias("number"))
    width, rest = divmod(total, n)
    i = F.col("id")
    start = i * F.lit(width).cast("long") + F.least(i, F.lit(rest).cast("long"))
    own = F.lit(width).cast("long") + (i < rest).cast("long")
    lot = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string"))), 1, 15), 16, 10).cast("long")
    return spark.range(n).select((start + lot % own).alias("number"))


def sample_score_gap_pairs(scores: DataFrame, n: int, seed: int = 42, min_gap: float = 1) -> DataFrame:
    """``n`` of all score-gap pairs, or all of them if there are fewer; each pair is as likely as any other.

    The same seed draws the same numbers on every run. The columns are those of
    :func:`score_gap_pairs_at`.
    """
    ranges, seen = written(pair_ranges(scores, min_gap), "pair-ranges", total=F.sum("n_pairs"))
    return score_gap_pairs_at(scores, drawn_numbers(scores.sparkSession, n, seen["total"] or 0, seed), min_gap, ranges)
