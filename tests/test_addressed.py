"""Score-gap pairs by their numbers, against all pairs of small groups."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pairloom.operators import pairs as J
from pairloom.operators.addressed import drawn_numbers, sample_score_gap_pairs, score_gap_pairs_at

SCHEMA = "passage_id int, rubric string, source_key string, score int"


def table(spark, n=60, seed=2):
    rng = random.Random(seed)
    keys = ["hot", "hot", "a", "b", None]
    rows = [(i, r, rng.choice(keys), rng.choice([1, 2, 2, 3, 5, None])) for i in range(n) for r in ("x", "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def plain(rows, gap):
    return {
        (a[1], a[2], a[0], b[0], a[3] - b[3])
        for a in rows
        for b in rows
        if a[1:3] == b[1:3] and None not in (a[2], a[3], b[3]) and a[3] - b[3] >= gap
    }


@pytest.mark.parametrize("gap", [1, 2])
def test_all_numbers_are_all_pairs(spark, gap):
    df, rows = table(spark)
    want = plain(rows, gap)
    numbers = spark.range(len(want) + 50).select(F.col("id").alias("number"))  # those behind the last give nothing
    found = score_gap_pairs_at(df, numbers, gap).collect()
    assert sorted(r.number for r in found) == list(range(len(want)))
    assert {(r.rubric, r.source_key, r.chosen_id, r.rejected_id, r.margin) for r in found} == want
    assert all(r.high_score - r.low_score == r.margin for r in found)


def test_a_sample_has_its_size_and_is_stable(spark):
    df, rows = table(spark)
    want = plain(rows, 1)
    found = [{tuple(r) for r in sample_score_gap_pairs(x, 40, 7).collect()} for x in (df, df.repartition(5))]
    assert found[0] == found[1] and len(found[0]) == 40
    assert {(r[1], r[2], r[3], r[4], r[7]) for r in found[0]} <= want
    assert sample_score_gap_pairs(df, 10**6).count() == len(want)
    assert sample_score_gap_pairs(df.limit(0), 5).count() == 0


@pytest.mark.parametrize("n, total", [(7, 7), (3, 10**15), (1000, 1003)])
def test_drawn_numbers_differ(spark, n, total):
    found = [r[0] for r in drawn_numbers(spark, n, total, 1).collect()]
    assert len(set(found)) == n and min(found) >= 0 and max(found) < total


def test_sums_over_levels(spark):
    df, rows = table(spark)
    for gap in (1, 3):
        counts = J.score_gap_counts(df, gap).groupBy("rubric", "source_key", "high_score").agg(F.sum("n_pairs").alias("n_pairs"))
        totals = J.score_gap_totals(df, gap)
        assert counts.exceptAll(totals.select(counts.columns)).count() == 0 == totals.select(counts.columns).exceptAll(counts).count()
        assert (totals.agg(F.sum("n_pairs")).first()[0] or 0) == len(plain(rows, gap))


def test_any_number_of_levels(spark):
    df = spark.range(10_000).select(
        F.col("id").alias("passage_id"), F.lit("x").alias("rubric"), F.lit("s").alias("source_key"), F.col("id").alias("score")
    )
    assert J.score_gap_totals(df, 10).agg(F.sum("n_pairs")).first()[0] == 9_990 * 9_991 // 2
    drawn = sample_score_gap_pairs(df, 100, min_gap=10).collect()
    assert len(drawn) == 100 and all(r.margin == r.chosen_id - r.rejected_id >= 10 for r in drawn)


def test_decimal_scores(spark):
    rows = [(i, "x", "s", Decimal(i) / 4) for i in range(9)]
    df = spark.createDataFrame(rows, "passage_id int, rubric string, source_key string, score decimal(6,2)")
    want = {(a[0], b[0]) for a in rows for b in rows if a[3] - b[3] >= Decimal("0.75")}
    assert {(r.chosen_id, r.rejected_id) for r in J.pairs_by_score_gap(df, 0.75).collect()} == want
    assert J.score_gap_totals(df, 0.75).agg(F.sum("n_pairs")).first()[0] == len(want)
    assert sample_score_gap_pairs(df, 1000, min_gap=0.75).count() == len(want)
