"""Evaluating reward models and judges, ranking, regenerating passages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import attempts as W
from pairloom.operators import pairs as J
from pairloom.operators import ranking as K
from pairloom.operators import scoring as S
from pairloom.operators.responses import parse_ab_choice
from pairloom.sources.files import write_jsonl
from pairloom.storage import new_path


def judge_prompts(samples: DataFrame, seed: int = 42, order: list[str] = ["pos"]) -> DataFrame:
    """Pairs of labelled samples in the order a judge is shown them."""
    return S.ab_order(J.pairs_by_label(samples, order), seed)


def _judged(
    samples: DataFrame, responses: DataFrame, make_scorer: Callable[[], S.Scorer], seed: int, order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Results of the reward model and of the judge, one row per pair and side, from one pass over the pairs."""
    spark = samples.sparkSession
    shown = judge_prompts(samples, seed, order).withColumn("chosen_name", F.col("metadata.chosen_name"))
    keys = [c for c in ("pair_id", "chosen_name") if c in responses.columns]
    scored = S.compare_with(shown, make_scorer).drop("chosen", "rejected", "text_a", "text_b", "metadata")
    staged = new_path(spark, "scored-pairs")
    answered = scored.join(responses.select(*keys, "response"), keys, "left")
    S.judge_results(parse_ab_choice(answered)).write.parquet(staged)
    results = spark.read.parquet(staged)
    return results, results


def preference_ranking(
    samples: DataFrame,
    responses: DataFrame,
    make_scorer: Callable[[], S.Scorer],
    seed: int = 42,
    order: list[str] = ["pos"],
) -> DataFrame:
    """Agreement of a reward model and a judge on labelled samples.

    ``responses`` holds the judge's answer per pair for the order that
    :func:`judge_prompts` gives; pairs without answer count as wrong. Samples
    of one topic share their pair id: answers then also need ``chosen_name``,
    and the last sample by name stands for the topic in the comparison, while
    the accuracies cover all.
    """
    return S.agreement(*_judged(samples, responses, make_scorer, seed, order), ["chosen_name"])


def preference_details(
    samples: DataFrame,
    responses: DataFrame,
    make_scorer: Callable[[], S.Scorer],
    seed: int = 42,
    order: list[str] = ["pos"],
) -> DataFrame:
    """The comparison of :func:`preference_ranking`, a row per pair id."""
    return S.compare_verdicts(*_judged(samples, responses, make_scorer, seed, order), ["chosen_name"])


def rank_candidates(
    passages: DataFrame,
    scorers: dict[str, Callable[[], S.Scorer]],
    path: str,
    id: str,
    text: str = "passage",
    how: str = "sum",
) -> DataFrame:
    """Score every passage with each model, rank and write line JSON.

    One column per scorer; the models run in one pass over the text. The
    scored rows are written before they are numbered, so a rank never comes
    from a second run of a model.
    """
    spark = passages.sparkSession
    scored = S.score_with_each(passages, text, scorers)
    staged = new_path(spark, "scored")
    scored.write.parquet(staged)
    ranked = K.rank_passages(spark.read.parquet(staged), id, list(scorers), how)
    write_jsonl(ranked, path)
    return ranked


def regenerate_nulls(passages: DataFrame, attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Replace null passages by their first usable new attempt."""
    wanted = W.null_passages(passages).select(*keys)
    tries = attempts.join(wanted, keys, "left_semi")
    return W.fill_nulls(passages, W.regenerated(tries, keys), keys)


def generation_results(items: DataFrame, attempts: DataFrame, keys: list[str], max_attempts: int = 10) -> DataFrame:
    """Every item with its first valid passage, or null when there is none."""
    chosen = W.first_valid_attempt(attempts, keys, max_attempts=max_attempts)
    return items.join(chosen, keys, "left").withColumn("success", F.coalesce("success", F.lit(False)))
