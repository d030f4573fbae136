"""Scores from user models, accuracy and agreement."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom import values as V
from pairloom.operators.numbering import shuffled
from pairloom.operators.records import complete_pairs, with_text

Scorer = Callable[[pd.Series], pd.Series]

#: Characters of a batch after each text is padded to the longest, and texts of a batch.
PADDED, BATCH = 1 << 20, 1024


def padded_batches(lengths: np.ndarray, padded: int = PADDED, rows: int = BATCH) -> Iterator[np.ndarray]:
    """Places of texts of similar length, as many at once as the padded size allows; a longer text is alone."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    for end in range(1, len(order) + 1):
        full = end == len(order) or end - start >= rows or (end - start + 1) * max(1, int(lengths[order[end]])) > padded
        if full:
            yield order[start:end]
            start = end


def _scored(scorer: Scorer, texts: pd.Series, errors: dict[int, str] | None) -> np.ndarray:
    """Scores of a batch. If it fails and ``errors`` is given, its halves are tried, down to the text that fails."""
    try:
        found = np.asarray(scorer(texts).astype("float64"))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} scores for {len(texts)} texts")
        return found
    except Exception as e:
        if errors is None:
            raise
        if len(texts) == 1:
            errors[texts.index[0]] = f"{type(e).__name__}: {e}"
            return np.array([np.nan])
    half = len(texts) // 2
    return np.concatenate([_scored(scorer, texts.iloc[:half], errors), _scored(scorer, texts.iloc[half:], errors)])


def score_all(scorer: Scorer, texts: pd.Series, padded: int, isolate: bool) -> tuple[np.ndarray, list[str | None]]:
    """Scores of texts in their order, made in batches of similar length, and what went wrong with each."""
    texts = texts.reset_index(drop=True)
    out, errors = np.full(len(texts), np.nan), {} if isolate else None
    for places in padded_batches(texts.str.len().fillna(0).to_numpy("int64"), padded):
        out[places] = _scored(scorer, texts.iloc[places], errors)
    return out, [(errors or {}).get(i) for i in range(len(texts))]


def score_each(
    scorers: list[Scorer], texts: pa.Array, padded: int, isolate: bool
) -> list[tuple[np.ndarray, list[str | None]]]:
    """What :func:`score_all` says of each scorer; only one batch of similar length is unpacked at a time, for all of them."""
    out = [(np.full(len(texts), np.nan), {} if isolate else None) for _ in scorers]
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64")
    for places in padded_batches(lengths, padded):
        part = pd.Series(texts.take(pa.array(places)).to_pylist(), index=places, dtype="object")
        for scorer, (found, errors) in zip(scorers, out, strict=True):
            found[places] = _scored(scorer, part, errors)
    return [(found, [(errors or {}).get(i) for i in range(len(texts))]) for found, errors in out]


def _with_scores(df: DataFrame, text: str, makers: list[Callable[[], Scorer]], padded: int, isolate: bool) -> DataFrame:
    """Texts that are not empty with ``_s``: a score and an error by each scorer, all of them run by one worker of a task."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorers = [make() for make in makers]
        for batch in batches:
            columns: dict[str, pa.Array] = {}
            for i, (found, wrong) in enumerate(score_each(scorers, batch, padded, isolate)):
                columns |= {f"score{i}": pa.array(found, from_pandas=True), f"failed{i}": pa.array(wrong, pa.string())}
            del batch
            yield pa.StructArray.from_arrays(list(columns.values()), list(columns))
            pa.default_memory_pool().release_unused()

    kind = ", ".join(f"score{i} double, failed{i} string" for i in range(len(makers)))
    return with_text(df, text).withColumn("_s", F.arrow_udf(score, kind)(F.col(text)))


def score_with(
    df: DataFrame,
    text: str,
    make_scorer: Callable[[], Scorer],
    to: str = "reward_score",
    model: str | None = None,
    errors: str | None = None,
    padded: int = PADDED,
) -> DataFrame:
    """Add a user model's score of every non-empty text; empty ones are left out.

    ``make_scorer`` builds the scorer once per task, so a model is loaded once
    and then fed batches. Texts of an Arrow batch are dealt into batches of
    similar length: padded to the longest, none holds more than ``padded``
    characters, but for a text that alone is longer. A scorer must score each
    text by itself. With ``errors``, a batch that fails is halved until the
    failing text is alone: it gets a null score and its error in that column;
    without, the job fails. ``model`` fills the column evaluation_model.
    """
    out = _with_scores(df, text, [make_scorer], padded, errors is not None)
    value = F.when(F.col("_s.failed0").isNull(), F.col("_s.score0"))
    out = out.withColumn(to, value)
    out = (out if errors is None else out.withColumn(errors, F.col("_s.failed0"))).drop("_s")
    return out if model is None else out.withColumn("evaluation_model", F.lit(model))


def score_with_each(
    df: DataFrame, text: str, scorers: dict[str, Callable[[], Scorer]], padded: int = PADDED
) -> DataFrame:
    """Add the score by each model of every non-empty text, as :func:`score_with` does; texts are sent and unpacked once for all."""
    out = _with_scores(df, text, list(scorers.values()), padded, False)
    return out.withColumns({name: F.col(f"_s.score{i}") for i, name in enumerate(scorers)}).drop("_s")


def compare_with(
    pairs: DataFrame, make_scorer: Callable[[], Scorer], errors: str | None = None, padded: int = PADDED
) -> DataFrame:
    """Score both texts of every complete pair with one loaded model.

    Adds chosen_score, rejected_score, score_difference and
    correct_preference (a tie is not correct). Batches and ``errors`` are those
    of :func:`score_with`; both texts of a batch's pairs are dealt out together.
    """

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for chosen, rejected in batches:
            n = len(chosen)
            found, wrong = score_all(scorer, pd.concat([chosen, rejected], ignore_index=True), padded, errors is not None)
            failed = pd.Series([a or b for a, b in zip(wrong[:n], wrong[n:], strict=True)], dtype="object")
            yield pd.DataFrame({"chosen": found[:n], "rejected": found[n:], "failed": failed})

    both = F.pandas_udf(score, "chosen double, rejected double, failed string")
    scored = complete_pairs(pairs).withColumn("_s", both("chosen", "rejected"))
    for side in ("chosen", "rejected"):
        scored = scored.withColumn(f"{side}_score", F.when(F.col("_s.failed").isNull(), F.col(f"_s.{side}")))
    return with_difference((scored if errors is None else scored.withColumn(errors, F.col("_s.failed"))).drop("_s"))


def with_difference(scored: DataFrame) -> DataFrame:
    """Add the score difference and whether the chosen text won."""
    return scored.withColumn("score_difference", F.col("chosen_score") - F.col("rejected_score")).withColumn(
        "correct_preference", F.col("chosen_score") > F.col("rejected_score")
    )


def pairwise_accuracy(scored: DataFrame, by: list[str] = []) -> DataFrame:
    """Share of pairs whose chosen text scores strictly higher.

    Without ``by`` an empty input gives one row of zeros.
    """
    wins = F.count_if(F.col("chosen_score") > F.col("rejected_score"))
    n = F.count(F.lit(1))
    accuracy = F.when(n > 0, wins / n).otherwise(F.lit(0.0))
    difference = F.avg(F.col("chosen_score") - F.col("rejected_score"))
    return scored.groupBy(*by).agg(
        n.alias("total_pairs"),
        wins.alias("correct_preferences"),
        accuracy.alias("accuracy"),
        (accuracy * 100).alias("accuracy_percent"),
        F.coalesce(difference, F.lit(0.0)).alias("mean_difference"),
    )


def ab_order(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Show half of the pairs in swapped order, chosen by a seeded hash.

    Adds text_a, text_b and correct_choice; the same pair is always shown in
    the same order.
    """
    straight = F.substring(shuffled(seed, F.col("pair_id")), 1, 1) < "8"
    return (
        pairs.withColumn("text_a", F.when(straight, F.col("chosen")).otherwise(F.col("rejected")))
        .withColumn("text_b", F.when(straight, F.col("rejected")).otherwise(F.col("chosen")))
        .withColumn("correct_choice", F.when(straight, "A").otherwise("B"))
    )


def judge_results(choices: DataFrame) -> DataFrame:
    """Add is_correct; an answer that could not be parsed is wrong."""
    hit = F.coalesce(F.col("choice") == F.col("correct_choice"), F.lit(False))
    return choices.withColumn("is_correct", hit)


def judge_accuracy(choices: DataFrame, by: list[str] = []) -> DataFrame:
    """Correct choices over all pairs."""
    n, hits = F.count(F.lit(1)), F.count_if("is_correct")
    return (
        judge_results(choices)
        .groupBy(*by)
        .agg(
            n.alias("total_pairs"),
            hits.alias("correct_predictions"),
            F.when(n > 0, hits / n).otherwise(F.lit(0.0)).alias("accuracy"),
        )
    )


def _last(results: DataFrame, order: list[str], verdict: str, more: list[str]) -> DataFrame:
    """The last result of every pair id in ``order``; without an order a repeated id stops the job."""
    held = [F.coalesce(F.col(verdict), F.lit(False)).alias("prefers"), *more]
    if order:
        last = F.max(F.struct(*order, *held))
        return results.groupBy("pair_id").agg(last.alias("_l")).select("pair_id", "_l.prefers", *[f"_l.{c}" for c in more])
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("pair ids repeat: name the columns that order them")))
    rows = results.select("pair_id", *held)
    best = rows.groupBy("pair_id").agg(once.cast("string").alias("_once"), *[F.max(c).alias(c) for c in ["prefers", *more]])
    return best.where("_once IS NULL").drop("_once")


def compare_verdicts(rm: DataFrame, judge: DataFrame, order: list[str] = []) -> DataFrame:
    """Both verdicts of every pair id that both sides know, with what led to them.

    ``rm`` has pair_id and correct_preference, ``judge`` pair_id and
    is_correct; rm's topic and score_difference and the judge's choice come
    along where they exist. Ids may repeat: the last result in ``order``, which
    both sides have as columns, counts.
    """
    more = [c for c in ("topic", "score_difference") if c in rm.columns]
    left = _last(rm, order, "correct_preference", more).withColumnRenamed("prefers", "rm_prefers_chosen")
    choice = [c for c in ("choice",) if c in judge.columns]
    right = _last(judge, order, "is_correct", choice).withColumnRenamed("prefers", "judge_prefers_chosen")
    agree = F.col("rm_prefers_chosen") == F.col("judge_prefers_chosen")
    return left.join(right, "pair_id").withColumn("agreement", agree)


def agreement(rm: DataFrame, judge: DataFrame, order: list[str] = []) -> DataFrame:
    """How often a reward model and a judge agree on their common pairs.

    Of results with one pair id the last in ``order`` is compared; the
    accuracies cover all results of each side. No common pair gives null rates
    and zero counts.
    """
    both = compare_verdicts(rm, judge, order)
    common, agreed = F.count(F.lit(1)), F.count_if("agreement")

    def accuracy(results: DataFrame, verdict: str, name: str) -> DataFrame:
        return results.agg(F.avg(F.coalesce(F.col(verdict), F.lit(False)).cast("int")).alias(name))

    counts = both.agg(
        common.alias("total_comparisons"),
        agreed.alias("agreements"),
        (common - agreed).alias("disagreements"),
        F.when(common > 0, agreed / common).alias("agreement_rate"),
    )
    rates = [
        accuracy(rm, "correct_preference", "reward_model_accuracy"),
        accuracy(judge, "is_correct", "judge_accuracy"),
    ]
    return counts.select("*", *[r.scalar().alias(r.columns[0]) for r in rates])


def binary_summary(evals: DataFrame, feedback: str | None = None) -> DataFrame:
    """Per evaluation the pass count, overall verdict, failed list and labels.

    ``evals`` has one boolean column per rubric; lists keep rubric order.
    """
    held = [F.coalesce(F.col(r), F.lit(False)) for r in V.RUBRICS]
    passed = sum((h.cast("int") for h in held[1:]), held[0].cast("int"))
    failed = F.array_compact(
        F.array(*[F.when(~h, F.lit(V.RUBRIC_LABELS[r])) for r, h in zip(V.RUBRICS, held)])
    )
    labels = F.struct(
        *[
            F.when(h, F.lit(V.PASSED_LABEL)).otherwise(F.lit(V.FAILED_LABEL)).alias(r)
            for r, h in zip(V.RUBRICS, held)
        ]
    )
    n = len(V.RUBRICS)
    return (
        evals.withColumn("passed_count", passed)
        .withColumn("pass_rate", F.concat(F.col("passed_count").cast("string"), F.lit(f"/{n}")))
        .withColumn("all_passed", F.col("passed_count") == n)
        .withColumn("failed_items", failed)
        .withColumn("labels", labels)
        .withColumn("feedback", F.col(feedback) if feedback else F.lit(""))
    )


def gate_detail(binary: DataFrame, detail: DataFrame) -> DataFrame:
    """Detailed scores only for passages that passed all six rubrics.

    The failed rows are filtered before the join, so an expensive ``detail``
    is not asked for them.
    """
    held = F.lit(True)
    for r in V.RUBRICS:
        held = held & F.coalesce(F.col(r), F.lit(False))
    marked = binary.select("passage_id", held.alias("overall_passed"))
    names = [c for c in detail.columns if c != "passage_id"]
    joined = marked.where("overall_passed").join(detail, "passage_id", "left")
    scored = joined.select(
        "passage_id",
        "overall_passed",
        F.lit(False).alias("skipped"),
        F.lit(None).cast("string").alias("reason"),
        *names,
    )
    types = {f.name: f.dataType for f in detail.schema}
    skipped = marked.where(~F.col("overall_passed")).select(
        "passage_id",
        "overall_passed",
        F.lit(True).alias("skipped"),
        F.lit(V.DETAIL_SKIPPED).alias("reason"),
        *[F.lit(None).cast(types[n]).alias(n) for n in names],
    )
    return scored.unionByName(skipped)
