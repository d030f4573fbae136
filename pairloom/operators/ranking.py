"""Ranking passages and comparing rankings."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.numbering import first_within, number_within

SCORE_COLUMNS = [f"r{i}_score" for i in range(1, 7)]


def combine_scores(columns: list[str] = SCORE_COLUMNS, how: str = "sum") -> Column:
    """One score from several: their sum (missing is 0), mean or minimum.

    Mean and minimum look at the scores that are there.
    """
    cols = [F.col(c).cast("double") for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    if how == "sum":
        return total
    if how == "mean":
        there = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
        return F.when(there > 0, total / there)
    if how == "min":
        return F.array_min(F.array(*cols))
    raise ValueError("how is sum, mean or min")


def rank_passages(
    df: DataFrame,
    id: str,
    columns: list[str] = SCORE_COLUMNS,
    how: str = "sum",
    by: list[str] = [],
    to: str = "rm_ranking",
    spread: bool = True,
) -> DataFrame:
    """Rank 1..n by combined score, best first, ties broken by the unique id.

    Ids and scores are ranked, then joined with the other columns. Large
    groups, or the whole table, are ranked by many tasks (:func:`number_within`).
    """
    total = combine_scores(columns, how).alias("_total")
    narrow = df.select(*by, id, total)
    ranked = number_within(narrow, by, [F.col("_total").desc(), F.col(id)], to, spread)
    return df.join(ranked.select(id, to), id).select(*df.columns, to)


def top_k_select(
    df: DataFrame, id: str, k: int = 25, columns: list[str] = SCORE_COLUMNS, how: str = "sum", by: list[str] = []
) -> DataFrame:
    """The ``k`` best passages (of each group) with their rank; only ids and scores are sorted."""
    narrow = df.select(*by, id, combine_scores(columns, how).alias("_total"))
    order = [F.col("_total").desc(), F.col(id)]
    if by:
        best = first_within(narrow, by, order, k, "rm_ranking")
    else:  # a top-n: k rows are left to be numbered
        best = number_within(narrow.orderBy(*order).limit(k), [], order, "rm_ranking", spread=False)
    return df.join(best.select(id, "rm_ranking"), id).select(*df.columns, "rm_ranking")


def hardest_pairs(scored: DataFrame, k: int = 5, id: str = "pair_id") -> DataFrame:
    """The ``k`` pairs with the smallest score difference, hardest first."""
    return scored.orderBy("score_difference", id).limit(k)


def sample_head(df: DataFrame, order: list[str], k: int = 3) -> DataFrame:
    """The first ``k`` rows in the given order."""
    return df.orderBy(*order).limit(k)


def _both(ranked: DataFrame, gold: DataFrame, by: list[str], id: str) -> DataFrame:
    """Ranks of each item on both sides; null if absent."""
    none = F.lit(None).cast("bigint")
    rank = F.col("rank").cast("bigint")
    left = ranked.select(*by, id, rank.alias("a"), none.alias("b"))
    right = gold.select(*by, id, none.alias("a"), rank.alias("b"))
    return left.unionByName(right).groupBy(*by, id).agg(F.min("a").alias("a"), F.min("b").alias("b"))


def recall_at_k(ranked: DataFrame, gold: DataFrame, k: int = 25, by: list[str] = [], id: str = "id") -> DataFrame:
    """Overlap of the two top-k sets divided by k.

    Both sides have ``id`` and ``rank``; ranks beyond ``k`` are filtered first.
    """
    hits = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    top = [side.where(F.col("rank") <= k) for side in (ranked, gold)]
    return _both(*top, by, id).groupBy(*by).agg(hits.alias("hits"), (hits / k).alias("recall"))


#: Depths whose weights are added up in one row's range; ranges are added up next.
DEPTHS = 4096


def _weights(deepest: DataFrame, p: float) -> DataFrame:
    """For each depth d up to ``deepest`` (one row) the sum of p^(j-1)/j from d on, small ones added first."""
    ranges = deepest.select(F.explode(F.sequence(F.lit(0), F.expr(f"deep div {DEPTHS}"))).alias("range"), "deep")
    inside = F.sequence(F.greatest(F.lit(1), F.col("range") * DEPTHS), F.least("deep", F.col("range") * DEPTHS + DEPTHS - 1))
    depths = ranges.repartition("range").select("range", F.explode(inside).alias("d"))
    each = depths.withColumn("w", F.pow(F.lit(p), F.col("d") - 1) / F.col("d"))
    own = each.withColumn("w", F.sum("w").over(Window.partitionBy("range").orderBy(F.desc("d"))))
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = own.groupBy("range").agg(F.max("w").alias("w"))  # a row for each 4,096 depths
    rest = whole.select("range", F.coalesce(F.sum("w").over(later), F.lit(0.0)).alias("rest"))
    return own.join(rest, "range").select("d", (F.col("w") + F.col("rest")).alias("w"))


def rbo(ranked: DataFrame, gold: DataFrame, p: float = 0.9, by: list[str] = [], id: str = "id") -> DataFrame:
    """Rank-biased overlap, truncated at the length of the longer ranking.

    ``(1-p) * sum over d of p^(d-1) * overlap(d) / d``. An item found on both
    sides counts in overlap(d) from its worse rank on, so the sum over depths
    becomes a sum over items of the weights from that rank to the last. Items
    are counted by worse rank and meet a table of summed weights; every rank
    counts.
    """
    if not 0 < p < 1:
        raise ValueError("p lies between 0 and 1")
    found = F.col("a").isNotNull() & F.col("b").isNotNull()
    met = F.when(found, F.greatest("a", "b"))
    items = _both(ranked, gold, by, id).select(*by, met.alias("met"), F.greatest("a", "b").alias("deep"))
    levels = items.groupBy(*by, "met").agg(F.count(F.lit(1)).alias("n"), F.max("deep").alias("deep"))
    weights = _weights(levels.agg(F.max("deep").alias("deep")).where("deep IS NOT NULL"), p)
    here = F.col("met").isNotNull()
    sums = levels.join(weights.withColumnRenamed("d", "met"), "met", "left").groupBy(*by).agg(
        F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(here, F.col("n") * F.col("w"))), F.lit(0.0)).alias("own"),
        (F.max("deep") + 1).alias("d"),
    )
    overlap = F.col("own") - F.col("n") * F.coalesce("w", F.lit(0.0))  # nothing counts beyond the longer ranking
    return sums.join(weights, "d", "left").select(*by, (overlap * (1 - p)).alias("rbo"))


def rbo_bounds(ranked: DataFrame, gold: DataFrame, p: float = 0.9, by: list[str] = [], id: str = "id") -> DataFrame:
    """Rank-biased overlap of two lists that go on: ``rbo_min``, ``rbo_res`` and ``rbo_ext``.

    Whatever the lists hold behind what is known, their overlap lies between
    ``rbo_min`` and ``rbo_min + rbo_res``; ``rbo_ext`` is the value if the
    agreement stays as it is. Lists may differ in length, and items may share a
    rank (the smallest of their places): agreement at a depth is then twice the
    overlap by the number of items that both sides have up to it.

    Depths whose weight is zero as a double are not looked at, so a group has
    a bounded number of rows, whatever its length: 7,000 for p = 0.9. What lies
    behind both lists is summed in closed form.
    """
    if not 0 < p < 1:
        raise ValueError("p lies between 0 and 1")
    last = int(745 / -math.log(p)) + 1  # p ** last is zero
    items = _both(ranked, gold, by, id)
    sizes = items.groupBy(*by).agg(
        F.count("a").alias("_na"), F.count("b").alias("_nb"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("_all")
    )
    sizes = sizes.select(*by, F.least("_na", "_nb").alias("_s"), F.greatest("_na", "_nb").alias("_l"), "_all")
    sizes = sizes.withColumn("_f", F.col("_l") + F.col("_s") - F.col("_all"))
    places = F.array(
        *[
            F.struct(depth.alias("d"), *[F.lit(int(k == n)).alias(c) for n, c in enumerate(("a", "b", "x"))])
            for k, depth in enumerate([F.col("a"), F.col("b"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.greatest("a", "b"))])
        ]
    )
    steps = items.select(*by, F.explode(places).alias("e")).where(F.col("e.d") <= last)
    steps = steps.groupBy(*by, F.col("e.d").alias("_d")).agg(*[F.sum(f"e.{c}").alias(f"_{c}") for c in ("a", "b", "x")])
    depths = F.sequence(F.lit(1).cast("bigint"), F.least(F.greatest("_l", "_f", F.lit(1)), F.lit(last)))
    grid = sizes.select(*by, "_s", "_l", F.explode(depths).alias("_d"))
    on = [F.col(f"g.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*by, "_d"]]
    grid = grid.alias("g").join(steps.alias("e"), reduce(Column.__and__, on), "left").select(
        *[F.col(f"g.{c}") for c in [*by, "_s", "_l", "_d"]], *[F.coalesce(f"_{c}", F.lit(0)).alias(f"_{c}") for c in ("a", "b", "x")]
    )
    upto = Window.partitionBy(*by).orderBy("_d")  # at most ``last`` rows
    grid = grid.select("*", *[F.sum(f"_{c}").over(upto).alias(c) for c in ("a", "b", "x")])
    d = F.col("_d")
    grid = grid.withColumn("both", F.greatest("a", "_d") + F.greatest("b", "_d")).withColumn("w", F.pow(F.lit(p), d - 1))
    grid = grid.withColumn("agreed", 2 * F.col("x") / F.col("both"))
    kept = grid.groupBy(*by).agg(F.coalesce(F.max(F.when(d == F.col("_s"), F.col("agreed"))), F.lit(0.0)).alias("_kept"))
    if by:  # one number per group
        same = reduce(Column.__and__, [F.col(f"g.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by])
        full = grid.alias("g").join(kept.alias("k"), same).select("g.*", "_kept")
    else:
        full = grid.withColumn("_kept", kept.scalar())
    beyond = F.greatest(d - F.col("_s"), F.lit(0))
    most = 2 * (F.col("x") + beyond + F.greatest(d - F.col("_l"), F.lit(0))) / F.col("both")
    stays = 2 * (F.col("x") + F.col("_kept") * beyond) / F.col("both")
    inside = d <= F.col("_l")
    sums = full.groupBy(*by).agg(
        F.sum(F.col("w") * F.col("agreed")).alias("_min"),
        F.sum(F.col("w") * F.least(most, F.lit(1.0))).alias("_max"),
        F.coalesce(F.sum(F.when(inside, F.col("w") * stays)), F.lit(0.0)).alias("_ext"),
        F.max(F.when(d == F.col("_l"), stays)).alias("_stays"),
        F.sum(F.col("w") / d).alias("_h"),
        F.max("_d").alias("_deep"),
        F.max("x").alias("_x"),
        F.max("_l").alias("_l"),
    )
    rest = F.col("_x") * F.greatest(F.lit(-math.log1p(-p) / p) - F.col("_h"), F.lit(0.0))
    low = (F.col("_min") + rest) * (1 - p)
    high = F.col("_max") * (1 - p) + F.pow(F.lit(p), F.col("_deep"))
    ext = F.col("_ext") * (1 - p) + F.coalesce("_stays", F.lit(0.0)) * F.pow(F.lit(p), F.col("_l"))
    return sums.select(*by, low.alias("rbo_min"), (high - low).alias("rbo_res"), ext.alias("rbo_ext"))
