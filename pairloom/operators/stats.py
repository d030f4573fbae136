"""Statistics of passages, evaluations and pair sets.

Everything here is an aggregate that combines on the map side, so a group
that holds a large share of the rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom import values as V
from pairloom.functions.text import normalize_ws, text_counts, words

MEASURES = ["chars", "words", "sentences", "sentence_words"]


def corpus_stats(df: DataFrame, text: str = "text", by: list[str] = []) -> DataFrame:
    """Count, mean, population deviation, min and max of four text measures.

    One row per group and metric: characters, words, sentences and mean
    sentence length in words.
    """
    measured = df.where(F.col(text).isNotNull()).select(
        *by, *[c.cast("double").alias(n) for n, c in text_counts(text).items()]
    )
    out = [F.count(F.lit(1)).alias("n_passages")]
    for m in MEASURES:
        out += [
            F.avg(m).alias(f"{m}_mean"),
            F.stddev_pop(m).alias(f"{m}_std"),
            F.min(m).alias(f"{m}_min"),
            F.max(m).alias(f"{m}_max"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                *[F.col(f"{m}_{s}").alias(s) for s in ("mean", "std", "min", "max")],
            )
            for m in MEASURES
        ]
    )
    return (
        measured.groupBy(*by)
        .agg(*out)
        .select(*by, "n_passages", F.explode(rows).alias("m"))
        .select(*by, "n_passages", "m.*")
    )


def token_counts(df: DataFrame, text: str = "text", by: list[str] = []) -> DataFrame:
    """How often each distinct word (case kept) occurs: the vocabulary."""
    tokens = df.select(*by, F.explode(words(text)).alias("token"))
    return tokens.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))


def distinct_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """The vocabulary without counts."""
    return df.select(F.explode(words(text)).alias("token")).distinct()


def type_token_ratio(
    df: DataFrame, text: str = "text", by: list[str] = [], rsd: float | None = None
) -> DataFrame:
    """Distinct words per word, 0 for a group without words.

    Words are first counted by (group, word), so a word that makes up much of
    the corpus is folded before it is moved and groups of any vocabulary are
    spread over tasks. With ``rsd`` the distinct words are estimated with that
    relative error instead, from sketches that move no words at all.
    """
    if rsd is None:
        counted = token_counts(df, text, by).groupBy(*by)
        per_group = counted.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"))
    else:
        tokens = df.select(*by, F.explode(words(text)).alias("token")).groupBy(*by)
        types = F.approx_count_distinct("token", rsd)
        per_group = tokens.agg(F.count("token").alias("tokens"), types.alias("types"))
    if by:
        groups = df.select(*by).distinct()
        per_group = groups.join(per_group, by, "left")
    tokens, types = F.coalesce("tokens", F.lit(0)), F.coalesce("types", F.lit(0))
    ratio = F.when(tokens > 0, types / tokens).otherwise(F.lit(0.0))
    return per_group.select(*by, tokens.alias("tokens"), types.alias("types"), ratio.alias("ttr"))


def long_passages(df: DataFrame, text: str = "text", threshold: int = 500) -> DataFrame:
    """Passages longer than ``threshold`` with their length after clean-up."""
    cleaned = F.length(normalize_ws(text))
    return (
        df.where(F.length(text) > threshold)
        .withColumn("original_length", F.length(text))
        .withColumn("cleaned_length", cleaned)
        .withColumn("reduction", F.col("original_length") - F.col("cleaned_length"))
    )


def long_passage_summary(long: DataFrame, by: list[str] = []) -> DataFrame:
    """Mean, min and max of the lengths that :func:`long_passages` adds."""
    out = [F.count(F.lit(1)).alias("n_long")]
    for c in ("original_length", "cleaned_length"):
        out += [F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return long.groupBy(*by).agg(*out, F.avg("reduction").alias("reduction_mean"))


def rubric_mean_rows(scores: DataFrame) -> DataFrame:
    """Mean score of each rubric and model: a row per cell, of any number of models.

    Every model has a row for every rubric that occurs; one it has no score
    for counts 0.0. ``_`` in names of models is shown as ``-``.
    """
    rows = scores.where(F.col("rubric").isin(V.RUBRICS)).withColumn("model", F.replace("model", F.lit("_"), F.lit("-")))
    means = rows.groupBy("rubric", "model").agg(F.avg("score").alias("_mean"))
    rubrics = means.agg(F.collect_set("rubric").alias("rubric")).scalar()  # a handful of names
    grid = means.select("model").distinct().withColumn("rubric", rubrics).select("model", F.explode("rubric").alias("rubric"))
    return grid.join(means, ["rubric", "model"], "left").select("rubric", "model", F.coalesce("_mean", F.lit(0.0)).alias("mean"))


def rubric_means(scores: DataFrame, models: list[str] | None = None) -> DataFrame:
    """:func:`rubric_mean_rows` as a table for people: one row per rubric, a column per model.

    Name the ``models`` wanted; without, all of them become columns.
    """
    return rubric_mean_rows(scores).groupBy("rubric").pivot("model", models).agg(F.first("mean")).fillna(0.0)


def overall_means(scores: DataFrame) -> DataFrame:
    """Per model the plain mean of its six rubric means, and its score count."""
    per_rubric = (
        scores.where(F.col("rubric").isin(V.RUBRICS))
        .groupBy("model", "rubric")
        .agg(F.avg("score").alias("mean"), F.count("score").alias("n"))
    )
    return per_rubric.groupBy("model").agg(
        (F.sum(F.coalesce("mean", F.lit(0.0))) / len(V.RUBRICS)).alias("overall_mean"),
        F.sum("n").alias("n_scores"),
    )


def pair_levels(pairs: DataFrame) -> DataFrame:
    """Pairs per rubric, high and low score; those that share a row in a list ``rejected_ids`` count one by one."""
    n = F.sum(F.size("rejected_ids").cast("long")) if "rejected_ids" in pairs.columns else F.count(F.lit(1))
    return pairs.groupBy("rubric", "high_score", "low_score").agg(n.alias("n_pairs"))


def pair_stats(levels: DataFrame) -> DataFrame:
    """Pairs per rubric by margin, by high score and by low score.

    Takes counted pairs (:func:`pair_levels`, or the counts of
    ``score_gap_counts``), so the grouping sets expand a few rows, not pairs.
    """
    small = (
        levels.groupBy("rubric", "high_score", "low_score")
        .agg(F.sum("n_pairs").alias("n_pairs"))
        .withColumn("margin", F.col("high_score") - F.col("low_score"))
    )
    sets = [["rubric", "margin"], ["rubric", "high_score"], ["rubric", "low_score"]]
    grouped = small.groupingSets(
        [[F.col(c) for c in s] for s in sets],
        F.col("rubric"),
        F.col("margin"),
        F.col("high_score"),
        F.col("low_score"),
    ).agg(F.sum("n_pairs").alias("n_pairs"), F.grouping("margin").alias("_m"), F.grouping("high_score").alias("_h"))
    kind = F.when(F.col("_m") == 0, "margin").when(F.col("_h") == 0, "high_score").otherwise("low_score")
    return grouped.select(
        "rubric",
        kind.alias("kind"),
        F.coalesce("margin", "high_score", "low_score").alias("value"),
        "n_pairs",
    )


def top_sources(counts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` source keys with most pairs in each rubric.

    ``counts`` has rubric, source_key and n_pairs. Spark keeps ``k`` rows per
    task before the shuffle (WindowGroupLimit).
    """
    per_source = counts.groupBy("rubric", "source_key").agg(F.sum("n_pairs").alias("n_pairs"))
    best = Window.partitionBy("rubric").orderBy(F.desc("n_pairs"), "source_key")
    return per_source.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Pairs per rubric and source key."""
    return pairs.groupBy("rubric", "source_key").agg(F.count(F.lit(1)).alias("n_pairs"))


def dataset_stats(pairs: DataFrame, n: str | None = None) -> DataFrame:
    """Pairs per rubric; the row ``total`` adds the sum and mean per rubric.

    With ``n`` the rows are counts already and that column holds them.
    """
    per_rubric = pairs.groupBy("rubric").agg((F.sum(n) if n else F.count(F.lit(1))).alias("n"))
    rolled = per_rubric.rollup("rubric").agg(
        F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_rubrics"), F.grouping("rubric").alias("_all")
    )
    return rolled.select(
        F.when(F.col("_all") == 1, "total").otherwise(F.col("rubric")).alias("rubric"),
        "n_pairs",
        "n_rubrics",
        (F.col("n_pairs") / F.col("n_rubrics")).alias("mean_per_rubric"),
    )
