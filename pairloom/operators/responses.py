"""Raw judge responses to typed tables.

Every job keeps all rows and says in ``parse_status`` where a value comes
from, because a default looks like a real score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom import values as V
from pairloom.functions import parse as P
from pairloom.functions.prompts import context_page
from pairloom.functions.text import strip
from pairloom.operators.ranking import combine_scores


def parse_scores(responses: DataFrame, default: int = 3, last: bool = False) -> DataFrame:
    """Score 1..5 of each response, ``default`` where none is found."""
    score = P.score_1_5(F.col("response"), last)
    return (
        responses.withColumn("_score", score)
        .withColumn("score", F.coalesce("_score", F.lit(default)))
        .withColumn("parse_status", F.when(F.col("_score").isNotNull(), "parsed").otherwise("default"))
        .drop("_score")
    )


def parse_binary_rubric(responses: DataFrame, n_guidelines: Column | None = None) -> DataFrame:
    """Six verdicts, feedback and status of each response.

    Verdicts may be nested under ``scores`` or lie at the top; either must
    name all six rubrics, otherwise all six are false and the feedback says
    why. ``n_guidelines`` is the smaller number of problem types and goals;
    below three nothing was asked, and all verdicts are false as well.
    """
    top, scores = F.col("_top"), F.col("_top")["scores"]
    enough = F.lit(True) if n_guidelines is None else F.coalesce(n_guidelines >= 3, F.lit(False))
    # One column per step: each JSON text is parsed once and then looked up.
    steps = (
        responses.withColumn("_enough", enough)
        .withColumn("_json", P.json_object(F.col("response")))
        .withColumn("_top", P.json_map(F.col("_json")))
        .withColumn("_nested", P.json_map(F.when(F.startswith(scores, F.lit("{")), scores)))
        .withColumn(
            "parse_status",
            F.when(~F.col("_enough"), "no_guidelines")
            .when(F.col("_json").isNull(), "no_json")
            .when(top.isNull(), "bad_json")
            .when(P.names_all_rubrics(F.col("_nested")), "nested")
            .when(P.names_all_rubrics(top), "flat")
            .otherwise("incomplete"),
        )
    )
    status = F.col("parse_status")
    held = steps.withColumn("_held", F.when(status == "nested", F.col("_nested")).when(status == "flat", top))
    given = F.when(F.map_contains_key(top, "feedback"), top["feedback"]).otherwise(F.lit(""))
    feedback = (
        F.when(status.isin("nested", "flat"), given)
        .when(status == "no_guidelines", F.lit(V.BINARY_NO_METADATA))
        .when(status == "bad_json", F.lit(V.BINARY_BAD_JSON))
        .otherwise(F.lit(V.BINARY_NOT_PARSED))
    )
    return held.select(
        *responses.columns,
        *[P.map_verdict(F.col("_held"), r).alias(r) for r in V.RUBRICS],
        feedback.alias("feedback"),
        "parse_status",
    )


def parse_correction(responses: DataFrame, passage: str = "passage", source: str = "correction") -> DataFrame:
    """Language grade of each response.

    ``correction`` compares the passage with the corrected text. ``auto``
    falls back to a stated score when there is no corrected text; otherwise
    an uncorrected passage is graded 5. Passages may be long: the distance is
    found inside the band that grades depend on.
    """
    if source not in ("correction", "auto"):
        raise ValueError("source is correction or auto")
    graded = P.correction_grade(F.col("_o"), F.col("_c"))
    stated = P.score_1_5(F.col("response")) if source == "auto" else F.lit(None).cast("int")
    return (
        responses.withColumn("_o", strip(passage))
        .withColumn("_c", P.corrected_text(F.col("response"), F.col("_o")))
        .withColumn("_s", stated)
        .withColumn("score", F.when(F.col("_c").isNull() & F.col("_s").isNotNull(), F.col("_s")).otherwise(graded))
        .withColumn(
            "parse_status",
            F.when(F.col("_c").isNotNull(), "correction").when(F.col("_s").isNotNull(), "score").otherwise("default"),
        )
        .drop("_o", "_c", "_s")
    )


def parse_pass_fail(responses: DataFrame) -> DataFrame:
    """Result, score and reason of each PASS/FAIL response."""
    return (
        responses.withColumn("reason", strip("response"))
        .withColumn("result", P.pass_fail(F.col("reason")))
        .withColumn("score", P.pass_score(F.col("result")))
    )


def parse_ab_choice(responses: DataFrame) -> DataFrame:
    """The preferred text, A or B, or null."""
    lines = responses.withColumn("_line", P.first_line(F.col("response")))
    return lines.withColumn("choice", P.ab_choice(F.col("_line"), F.col("response"))).drop("_line")


def parse_topic_pair(responses: DataFrame) -> DataFrame:
    """The two generated topics, null where there are none.

    A JSON list of at least two entries wins; otherwise the text is cut at
    its commas.
    """
    steps = (
        responses.withColumn("_text", strip("response"))
        .withColumn("_listed", P.listed_topics(F.col("_text")))
        .withColumn("_parts", P.plain_topics(F.col("_text")))
    )

    def topic(i: int) -> Column:
        return F.when(F.size("_listed") >= 2, P.listed_topic(F.col("_listed"), i)).otherwise(
            P.plain_topic(F.col("_parts"), i)
        )

    return steps.select(
        *responses.columns, topic(0).alias("korean_topic"), topic(1).alias("foreign_topic")
    )


def extract_explanation(responses: DataFrame) -> DataFrame:
    """Explanation after the score mark; needs response and score."""
    mark = F.concat(F.col("score").cast("string"), F.lit(V.SCORE_MARK))
    return responses.withColumn("explanation", P.explanation(F.col("response"), mark))


def status_counts(parsed: DataFrame, by: list[str] = []) -> DataFrame:
    """Responses per parse status."""
    return parsed.groupBy(*by, "parse_status").agg(F.count(F.lit(1)).alias("n"))


def evaluation_long(evals: DataFrame, keep: list[str], template: str = "template") -> DataFrame:
    """One row per evaluation and rubric.

    Templates named binary give ``passed`` from the rubric columns, others
    ``score`` from the ``…_score`` columns. Rubrics without value are out.
    """
    binary = F.contains(F.col(template), F.lit("binary"))
    rows = F.array(
        *[
            F.struct(
                F.lit(r).alias("rubric"),
                F.when(~binary, F.col(f"{r}_score")).cast("int").alias("score"),
                F.when(binary, F.col(r)).cast("boolean").alias("passed"),
            )
            for r in V.RUBRICS
        ]
    )
    long = evals.select(*keep, F.explode(rows).alias("_e")).select(*keep, "_e.*")
    return long.where(F.col("score").isNotNull() | F.col("passed").isNotNull())


def scores_long(evals: DataFrame, keep: list[str]) -> DataFrame:
    """One row per rubric score of an evaluation struct; missing ones are out."""
    rows = F.array(
        *[
            F.struct(F.lit(r).alias("rubric"), F.col(f"evaluation.{r}_score").cast("int").alias("score"))
            for r in V.RUBRICS
        ]
    )
    long = evals.select(*keep, F.explode(rows).alias("_e")).select(*keep, "_e.*")
    return long.where(F.col("score").isNotNull())


def evaluation_rows(evals: DataFrame, keep: list[str]) -> DataFrame:
    """One row per rubric of evaluation structs, scored or binary.

    ``score`` comes from the ``…_score`` fields, ``passed`` from the map of
    binary verdicts; rubrics with neither are out.
    """
    held = F.col("evaluation.scores")
    rows = F.array(
        *[
            F.struct(
                F.lit(r).alias("rubric"),
                F.col(f"evaluation.{r}_score").cast("int").alias("score"),
                (F.lower(held[r]) == "true").alias("passed"),
            )
            for r in V.RUBRICS
        ]
    )
    long = evals.select(*keep, F.explode(rows).alias("_e")).select(*keep, "_e.*")
    return long.where(F.col("score").isNotNull() | F.col("passed").isNotNull())


def evaluation_summary(evals: DataFrame, keep: list[str]) -> DataFrame:
    """Total, the six scores, time and template as text, missing ones as N/A."""
    scores = [f"{r}_score" for r in V.RUBRICS]

    def shown(name: str) -> Column:
        value = F.col(name).cast("string") if name in evals.columns else F.lit(None)
        return F.coalesce(value, F.lit(V.MISSING)).alias(name)

    return evals.select(
        *keep,
        combine_scores(scores).alias("total"),
        *[shown(n) for n in [*scores, "evaluation_timestamp", "template_used"]],
    )


def context_block(pages: DataFrame, topics: DataFrame, k: int = 5, n: int = 500) -> DataFrame:
    """Reference text of each topic out of its main page and linked pages.

    ``pages`` holds topic, pos (0 is the main page), title and summary. Of the
    first ``k`` pages those with a summary are joined; a topic without main
    page gets ``''``. Spark keeps ``k`` rows per topic before the shuffle, so
    the collected list is short.
    """
    nearest = Window.partitionBy("topic").orderBy("pos")
    near = pages.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= k)
    shown = F.when(F.length("summary") > 0, context_page(F.col("title"), F.col("summary"), n))
    blocks = (
        near.groupBy("topic")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col("pos"), shown.alias("text")))).alias("_p"),
            F.min("pos").alias("_main"),
        )
        .where(F.col("_main") == 0)
        .select("topic", F.array_join(F.transform("_p", lambda p: p["text"]), V.PAGE_SEPARATOR).alias("context"))
    )
    return topics.join(blocks, "topic", "left").withColumn("context", F.coalesce("context", F.lit("")))
