"""Pair data sets from generated passages to training files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairloom import values as V
from pairloom.functions.prompts import source_key
from pairloom.operators import pairs as J
from pairloom.operators import records as R
from pairloom.operators import stats as A
from pairloom.operators.responses import parse_pass_fail, scores_long
from pairloom.schemas import PAIR
from pairloom.sources.files import flatten_entries, read_eval_tree, write_jsonl, write_pairs
from pairloom.sources.outputs import write_outputs
from pairloom.storage import new_path, written

#: Parquet files that repeat long texts: a group of rows ends early enough for its texts to fit their dictionary.
TEXTS_ONCE = {
    "parquet.dictionary.page.size": str(64 << 20),
    "parquet.block.row.count.limit": str(1 << 20),
    "compression": "zstd",
}


#: Parquet files of lists of ids: lists recur, which zstd sees over a whole page, also where ids stand as they are.
ID_LISTS = {"parquet.enable.dictionary#rejected_ids.list.element": "false", "compression": "zstd"}


def _stored(pairs: DataFrame, root: str) -> DataFrame:
    """Write pairs and count them per rubric on the way; nothing runs twice.

    Pairs of other rubrics than the known ones, if any, are counted by line.
    """
    spark, seen = pairs.sparkSession, Observation()
    known = [F.count_if(F.col("rubric") == r).alias(r) for r in V.RUBRICS]
    write_pairs(pairs.observe(seen, F.count(F.lit(1)).alias("_all"), *known), root)
    found = seen.get
    rows = [(r, found[r]) for r in V.RUBRICS if found[r]]
    counts = spark.createDataFrame(rows, "rubric string, n long")
    if sum(n for _, n in rows) < found["_all"]:
        lines = spark.read.text(root).where(~F.col("rubric").isin(V.RUBRICS))
        counts = counts.unionByName(lines.groupBy("rubric").agg(F.count(F.lit(1)).alias("n")))
    return A.dataset_stats(counts, "n")


def build_spf(
    responses: DataFrame,
    passages: DataFrame,
    root: str,
    target: int | None = None,
    seed: int = 42,
    mode: str = "per_rubric",
) -> DataFrame:
    """Filter based pairs: parse PASS/FAIL answers, draw, write, count."""
    return _stored(J.pairs_by_filter(parse_pass_fail(responses), passages, target, seed, mode), root)


def build_imp(
    high: DataFrame,
    low: DataFrame,
    guidelines: DataFrame,
    root: str,
    cap: int | None = None,
    id: str | None = None,
) -> DataFrame:
    """Inter-model pairs: add guidelines, pair, write, count."""
    high, low = J.with_guideline(high, guidelines), J.with_guideline(low, guidelines)
    return _stored(J.pairs_inter_model(high, low, cap=cap, id=id), root)


def build_icp(
    high: DataFrame, low: DataFrame, guidelines: DataFrame, rubric: str, root: str, id: str | None = None
) -> DataFrame:
    """Intra-model contrastive pairs of one rubric."""
    high, low = J.with_guideline(high, guidelines), J.with_guideline(low, guidelines)
    return _stored(J.pairs_intra_model(high, low, rubric, id=id), root)


def build_template_pairs(
    chosen: DataFrame, rejected: DataFrame, model: str, version: str, date: str, root: str
) -> DataFrame:
    """Template pairs: zip, write to the output tree, report issues."""
    spark = chosen.sparkSession
    pairs = J.pairs_by_template(chosen, rejected, model, version)
    staged = new_path(spark, "template-pairs")
    pairs.write.parquet(staged)
    pairs = spark.read.parquet(staged)
    write_outputs(
        pairs.withColumn("date", F.lit(date))
        .withColumn("model", F.lit(f"{model}_reward_pairs"))
        .withColumn("template", F.lit("passage_reward_pairs")),
        root,
    )
    return R.issue_counts(R.validate_pairs(pairs))


def _score_rows(evals: DataFrame, rubrics: list[str]) -> tuple[DataFrame, DataFrame]:
    """(scores by passage, passages with their text and item) of evaluations with a passage_id."""
    rows = evals.where(F.col("source_item").isNotNull()).select(
        "passage_id", source_key(F.col("source_item")).alias("source_key"), "evaluation", "generated_passage", "source_item"
    )
    scores = scores_long(rows, ["passage_id", "source_key"]).where(F.col("rubric").isin(rubrics))
    return scores, rows.select("passage_id", F.col("generated_passage").alias("text"), F.col("source_item").alias("item"))


def score_gap_records(
    evals: DataFrame, min_gap: int = 1, rubrics: list[str] = V.RUBRICS
) -> tuple[DataFrame, DataFrame]:
    """(counted score levels, records) of evaluations with a passage_id.

    Texts go with the scores into the cells of the pairing, a few copies of each,
    and pairs are made where the texts lie: no pair is moved, as pairs grow with the
    square of a source. Evaluations that repeat a passage are paired as often as
    they come, so each needs an id of its own.
    """
    scores, texts = _score_rows(evals, rubrics)
    pairs = J.pairs_by_score_gap(scores.join(texts, "passage_id"), min_gap, ["text", "item"])
    return J.score_gap_counts(scores, min_gap), R.to_rm_record_with_margin(pairs, ["rubric"])


def _staged_evaluations(spark: SparkSession, eval_root: str, pattern: str) -> DataFrame:
    """The evaluation tree parsed once into Parquet, each record with an id of its own."""
    staged = new_path(spark, "evaluations")
    rows = read_eval_tree(spark, eval_root, pattern=pattern)
    rows.withColumn("passage_id", F.monotonically_increasing_id()).write.parquet(staged)  # numbers: pairs repeat them
    return spark.read.parquet(staged)


def build_score_gap_pairs(
    spark: SparkSession,
    eval_root: str,
    root: str,
    min_gap: int = 1,
    pattern: str = V.EVALUATION_FILE,
    rubrics: list[str] = V.RUBRICS,
) -> DataFrame:
    """Score-gap pairs in factored form: ids below ``pairs/rubric=…``, every text once below ``passages``.

    Texts are neither paired nor repeated: their size stays that of the input
    while pairs grow with the square of a source. The ids of every pair are
    written, rejected ones in lists ``rejected_ids``; ``pairs.one_by_one`` gives a
    row per pair. Returns counts as :func:`build_score_gap` does.
    """
    scores, texts = _score_rows(_staged_evaluations(spark, eval_root, pattern), rubrics)
    pairs = J.pairs_by_score_gap(scores, min_gap, together=True)
    pairs.write.mode("overwrite").options(**ID_LISTS).partitionBy("rubric").parquet(f"{root}/pairs")
    texts.write.mode("overwrite").parquet(f"{root}/passages")
    return A.pair_stats(J.score_gap_counts(scores, min_gap))


def build_score_gap(
    spark: SparkSession,
    eval_root: str,
    root: str,
    min_gap: int = 1,
    pattern: str = V.EVALUATION_FILE,
    rubrics: list[str] = V.RUBRICS,
    format: str = "json",
) -> DataFrame:
    """Score-gap pairs of an evaluation tree for all given rubrics in one scan.

    The JSON is parsed once into Parquet, which both sides of the pairing and
    the counts then read with the columns they need. Records go below
    ``rubric=…``, as line JSON or Parquet: every record has both texts, which
    Parquet keeps once for a group of rows, so its files grow with the texts and
    line JSON with the pairs. Returns the counts by margin, high and low score;
    they come from level sizes and do not touch the pairs.
    """
    levels, records = score_gap_records(_staged_evaluations(spark, eval_root, pattern), min_gap, rubrics)
    writer = records.write.mode("overwrite").partitionBy("rubric").format(format)
    (writer.options(**TEXTS_ONCE) if format == "parquet" else writer).save(root)
    return A.pair_stats(levels)


def score_gap_report(
    spark: SparkSession, eval_root: str, min_gap: int = 1, pattern: str = V.EVALUATION_FILE, rubrics: list[str] = V.RUBRICS
) -> DataFrame:
    """What :func:`build_score_gap` would report, without pairs, records or texts: the tree is read once, for its scores."""
    scores, _ = _score_rows(_staged_evaluations(spark, eval_root, pattern), rubrics)
    return A.pair_stats(J.score_gap_counts(scores, min_gap))


def convert_pairs(
    pairs: DataFrame,
    templates: dict[str, str],
    train_path: str,
    eval_path: str,
    n_eval: int = 50,
    seed: int = 42,
    raw: str | None = None,
    rubric: str | None = None,
) -> DataFrame:
    """Pairs to train and eval line JSON; returns the rows per split.

    With ``raw`` the pairs still lie inside JSON texts of that column.
    ``rubric`` overrides the pairs' own, as the name of their file does. Rows
    are drawn by pair id. Merged sets may repeat ids and whole pairs, so the
    records are stored once, and repeats are told apart by content and place.
    """
    if raw is not None:
        pairs = flatten_entries(pairs, raw, PAIR).select("entry.*")
    if rubric is not None:
        pairs = pairs.withColumn("rubric", F.lit(rubric))
    spark = pairs.sparkSession
    texts = ["prompt", "chosen", "rejected"]
    records = R.flatten_rm_record(R.to_rm_record(pairs, templates), ["pair_id"])
    stored, _ = written(records.withColumn("content", F.md5(F.to_json(F.struct(*texts)))), "train-records", "zstd")
    place = ["file_name", "row_index"]
    stored = stored.select("*", *[f"_metadata.{c}" for c in place])
    cut = R.split_cut(stored, "pair_id", n_eval, seed, [*["content"], *place])  # reads ids only
    split = R.split_at(stored, cut, "pair_id", seed, ["content", *place])
    counts = []
    for name, path in (("train", train_path), ("eval", eval_path)):
        seen = Observation()
        write_jsonl(split.where(F.col("split") == name).select(*texts).observe(seen, F.count(F.lit(1)).alias("n")), path)
        counts.append((name, seen.get["n"]))
    return spark.createDataFrame([c for c in counts if c[1]], "split string, n long")


def icp_rubric(template: str) -> str:
    """Rubric a violating template stands for."""
    return V.VIOLATION_TEMPLATES[template]
