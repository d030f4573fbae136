"""Turning pairs into reward-model records, checking, merging, splitting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import values as V
from pairloom.functions.prompts import fill_loose, margin_prompt
from pairloom.functions.text import strip
from pairloom.operators.numbering import shuffled

REQUIRED = ["data_id", "reply_id", "reply_type", "model_name", "prompt", "chosen", "rejected"]


def turn_text(text: Column | str) -> Column:
    """What a turn says; a missing text is empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def _turn(who: str, text: Column) -> Column:
    return F.struct(F.lit(who).alias("from"), turn_text(text).alias("value"))


def _record(prompt: Column, chosen: Column, rejected: Column) -> list[Column]:
    return [
        F.array(_turn("human", prompt)).alias("conversations"),
        _turn("gpt", chosen).alias("chosen"),
        _turn("gpt", rejected).alias("rejected"),
    ]


def to_rm_record(pairs: DataFrame, templates: dict[str, str], keep: list[str] = ["pair_id", "rubric"]) -> DataFrame:
    """Pairs as conversations, prompted by their rubric's template.

    Pairs of a rubric without (or with an empty) template are dropped.
    """
    used = {r: t for r, t in templates.items() if t}
    item = pairs.schema["source_item"].dataType
    plain = [f.name for f in item if f.dataType.typeName() not in ("array", "struct", "map")]
    prompt = F.lit(None).cast("string")
    for rubric, template in used.items():
        filled = fill_loose(template, F.col("source_item"), plain)
        prompt = F.when(F.col("rubric") == rubric, filled).otherwise(prompt)
    return pairs.where(F.col("rubric").isin(list(used))).select(
        *keep, *_record(prompt, F.col("chosen"), F.col("rejected"))
    )


def to_rm_record_with_margin(
    pairs: DataFrame, keep: list[str] = [], of: Callable[[Column], Column] = lambda text: text
) -> DataFrame:
    """Score-gap pairs as conversations with their scores as metadata.

    ``pairs`` holds source_key, rubric, high_score, low_score, margin,
    chosen_text, rejected_text and chosen_item (the source item). Where only a
    function ``of`` texts is wanted, such as a digest, passages take theirs
    before they are paired (``of`` their :func:`turn_text`) and the prompts
    theirs once per rubric: no text is moved, and none is read for every pair.
    """

    def known(name: str) -> Column:
        return F.coalesce(F.col("chosen_item")[name], F.lit(V.MISSING)).alias(name)

    guidelines = F.struct(
        F.lit(V.DEFAULT_PROBLEM_TYPES).alias("problem_types"), F.lit(V.DEFAULT_EVAL_GOALS).alias("eval_goals")
    )
    metadata = F.struct(
        "source_key",
        "rubric",
        "high_score",
        "low_score",
        "margin",
        known("korean_topic"),
        known("foreign_topic"),
        known("korean_context"),
        known("foreign_context"),
        guidelines.alias("guidelines"),
    )
    return pairs.select(
        *keep,
        *_record(margin_prompt(F.col("rubric"), of), F.col("chosen_text"), F.col("rejected_text")),
        metadata.alias("metadata"),
    )


def flatten_rm_record(records: DataFrame, keep: list[str] = []) -> DataFrame:
    """(prompt, chosen, rejected) texts of complete records, stripped.

    A record counts as complete before stripping, so a text of white space
    only survives as ``''``.
    """
    texts = records.select(
        *keep,
        F.get("conversations", F.lit(0))["value"].alias("prompt"),
        F.col("chosen.value").alias("chosen"),
        F.col("rejected.value").alias("rejected"),
    )
    names = ["prompt", "chosen", "rejected"]
    full = reduce(Column.__and__, [F.length(n) > 0 for n in names])
    return texts.where(full).select(*keep, *[strip(n).alias(n) for n in names])


def validate_pairs(pairs: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """Pairs that have issues, listed in ``issues``.

    Missing fields (absent or null) are reported alone; only complete pairs
    are checked for blank texts.
    """
    missing = [
        F.when(F.col(c).isNull() if c in pairs.columns else F.lit(True), F.lit(f"missing {c}"))
        for c in required
    ]
    blank = [
        F.when(F.length(strip(c)) == 0, F.lit(f"blank {c}"))
        for c in ("prompt", "chosen", "rejected")
        if c in pairs.columns
    ]
    absent = F.array_compact(F.array(*missing))
    empty = F.array_compact(F.array(*blank)) if blank else F.array().cast("array<string>")
    issues = F.when(F.size(absent) > 0, absent).otherwise(empty)
    return pairs.withColumn("issues", issues).where(F.size("issues") > 0)


def issue_counts(invalid: DataFrame) -> DataFrame:
    """Number of pairs per issue."""
    return invalid.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def complete_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with text on both sides."""
    return pairs.where((F.length("chosen") > 0) & (F.length("rejected") > 0))


def with_text(passages: DataFrame, text: str = "generated_passage") -> DataFrame:
    """Passages that have text."""
    return passages.where(F.length(text) > 0)


def merge_pairs(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, repeated ones included."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def merge_counts(pairs: DataFrame) -> DataFrame:
    """Merged pairs per rubric."""
    return pairs.groupBy("rubric").agg(F.count(F.lit(1)).alias("n_pairs"))


def _lot(key: str, seed: int, ties: list[str]) -> Column:
    drawn = [F.col(c).alias(f"k{i}") for i, c in enumerate([key, *ties])]
    return F.struct(shuffled(seed, F.col(key)).alias("lot"), *drawn)


def _cut_of(df: DataFrame, key: str, n_eval: int, seed: int, ties: list[str]) -> DataFrame:
    return (
        df.select(_lot(key, seed, ties).alias("lot"))
        .orderBy("lot")
        .limit(n_eval)
        .agg(F.max("lot").alias("last"), F.count(F.lit(1)).alias("n"))
        .select(F.when(F.col("n") == n_eval, F.col("last")).alias("last"))
    )


def split_cut(df: DataFrame, key: str, n_eval: int, seed: int, ties: list[str] = []) -> tuple | None:
    """The ``n_eval``-th smallest lot, found now by a top-n over the key columns; null with fewer rows."""
    last = _cut_of(df, key, n_eval, seed, ties).first()["last"]
    return None if last is None else tuple(last)


def split_at(df: DataFrame, cut: tuple | None, key: str, seed: int, ties: list[str] = [], to: str = "split") -> DataFrame:
    """Mark the rows up to a cut of :func:`split_cut` as ``eval``, the rest ``train``."""
    if cut is None:
        return df.withColumn(to, F.lit("train"))
    names = ["lot", *[f"k{i}" for i in range(len(cut) - 1)]]
    last = F.struct(*[F.lit(v).alias(n) for n, v in zip(names, cut)]).cast(df.select(_lot(key, seed, ties).alias("l")).schema["l"].dataType)
    return df.withColumn(to, F.when(_lot(key, seed, ties) <= last, "eval").otherwise("train"))


def train_eval_split(
    df: DataFrame, key: str, n_eval: int = 50, seed: int = 42, to: str = "split", ties: list[str] = []
) -> DataFrame:
    """Mark ``n_eval`` rows drawn at random as ``eval``, the rest ``train``.

    Rows are drawn in the hash order of ``key``; ``key`` and ``ties`` together
    tell all rows apart. With fewer than ``n_eval`` rows all are ``train``.
    The draw only looks for the ``n_eval``-th smallest hash, a top-n over the
    key columns; the wide rows are then compared with that one value, without
    a join, a global sort or a global window. The plan of ``df`` runs for the
    draw and for the rows: store what is costly first.
    """
    cut = _cut_of(df, key, n_eval, seed, ties)
    return df.withColumn(to, F.when(_lot(key, seed, ties) <= cut.scalar(), "eval").otherwise("train"))
