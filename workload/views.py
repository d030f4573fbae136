"""The library's entities read from the driver's tables.

Each view exists twice: as a DataFrame and as the SQL ``WITH`` entry of the
same name. Scores, verdicts and templates are computed from ids and lengths
so that both engines hold the same values for every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.numbering import number_within
from pairloom.operators.pairs import pairs_inter_model, with_guideline
from pairloom.values import RUBRICS

# Multipliers of doc_id and n_chars that give each rubric its own scores.
MIX = dict(zip(RUBRICS, [(3, 1), (7, 2), (11, 3), (13, 4), (17, 1), (19, 3)]))

TEMPLATES = [
    "passage_agent.create_passage",
    "passage_agent.violate_flow_severely",
    "stem_agent.few_shot",
    "options_agent.create_option",
    "passage_eval.eval_rubric_binary",
    "topic_agent.create",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str = "documents", columns: tuple[str, ...] = ()) -> DataFrame:
    """A table whose texts are about to be worked on."""
    df = table(spark, sf, name)
    return df.select(*columns) if columns else df


def models(spark: SparkSession, sf: str) -> list[str]:
    """Names of all models; a handful."""
    return sorted(r[0] for r in table(spark, sf, "documents").select("source").distinct().collect())


def numbered(rows: DataFrame, keys: list[str], order: list[str], id: str, to: str = "pos") -> DataFrame:
    """Rows with their number inside their key; only ids are numbered, the rest joins them."""
    narrow = rows.select(*dict.fromkeys([*keys, *order, id]))
    found = number_within(narrow, keys, [F.col(c) for c in order], to).select(id, to)
    return rows.join(found, id).select(*rows.columns, to)


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """documents as generated passages of benchmark items."""
    number = F.substring("source", 4, 10).cast("int")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("passage_id"),
        F.struct(
            F.col("lang").alias("korean_topic"),
            F.concat(F.lit("about "), "lang").alias("korean_context"),
            F.col("source").alias("foreign_topic"),
            F.concat(F.lit("from "), "source").alias("foreign_context"),
            F.lit(None).cast("array<string>").alias("problem_types"),
            F.lit(None).cast("array<string>").alias("eval_goals"),
        ).alias("source_item"),
        F.col("text").alias("generated_passage"),
        "lang",
        F.col("source").alias("model"),
        number.alias("number"),
        (number % 5 + 1).alias("benchmark_id"),
        F.col("doc_id").alias("pos"),
        "n_chars",
    )


PASSAGES = """passages AS (
  SELECT doc_id AS passage_id, lang AS korean_topic, 'about ' || lang AS korean_context,
         source AS foreign_topic, 'from ' || source AS foreign_context, text AS generated_passage,
         lang, source AS model, CAST(substr(source, 4) AS INTEGER) AS number,
         CAST(substr(source, 4) AS INTEGER) % 5 + 1 AS benchmark_id, doc_id AS pos, n_chars
  FROM documents)"""


def guidelines(spark: SparkSession, sf: str) -> DataFrame:
    """nation as benchmark guidelines: three types and goals per region."""
    names = F.slice(F.array_sort(F.collect_list("n_name")), 1, 3)
    return (
        table(spark, sf, "nation")
        .groupBy((F.col("n_regionkey") + 1).alias("benchmark_id"))
        .agg(names.alias("problem_types"))
        .withColumn("eval_goals", F.transform("problem_types", lambda n: F.concat(F.lit("goal of "), n)))
    )


GUIDELINES = """guidelines AS (
  SELECT n_regionkey + 1 AS benchmark_id, list_sort(list(n_name))[1:3] AS problem_types,
         list_transform(list_sort(list(n_name))[1:3], lambda n: 'goal of ' || n) AS eval_goals
  FROM nation GROUP BY n_regionkey)"""


def score_of(rubric: str) -> Column:
    a, b = MIX[rubric]
    return (F.lit(1) + (F.col("passage_id") * a + F.col("n_chars") * b) % 5).cast("int")


def score_sql(rubric: str) -> str:
    a, b = MIX[rubric]
    return f"CAST(1 + (passage_id * {a} + n_chars * {b}) % 5 AS INTEGER)"


def wide_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Six scores of every passage, one column each."""
    return passages(spark, sf).select(
        "passage_id",
        "lang",
        "model",
        F.concat("lang", F.lit("||"), "model").alias("source_key"),
        "n_chars",
        *[score_of(r).alias(f"{r}_score") for r in RUBRICS],
    )


WIDE = (
    "wide AS (SELECT passage_id, lang, model, lang || '||' || model AS source_key, n_chars, "
    + ", ".join(f"{score_sql(r)} AS {r}_score" for r in RUBRICS)
    + " FROM passages)"
)


def long_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One row per passage and rubric."""
    rows = F.array(*[F.struct(F.lit(r).alias("rubric"), F.col(f"{r}_score").alias("score")) for r in RUBRICS])
    kept = ["passage_id", "lang", "model", "source_key"]
    return wide_scores(spark, sf).select(*kept, F.explode(rows).alias("e")).select(*kept, "e.*")


LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT passage_id, lang, model, source_key, '{r}' AS rubric, {r}_score AS score FROM wide" for r in RUBRICS
) + ")"

SCORES = ", ".join([PASSAGES, WIDE, LONG])


def binary(spark: SparkSession, sf: str) -> DataFrame:
    """Six verdicts of every passage: a score above 1 passes."""
    return wide_scores(spark, sf).select(
        "passage_id", "lang", "model", *[(F.col(f"{r}_score") > 1).alias(r) for r in RUBRICS]
    )


BINARY = (
    "verdict AS (SELECT passage_id, lang, model, "
    + ", ".join(f"{r}_score > 1 AS {r}" for r in RUBRICS)
    + " FROM wide)"
)


def high_low(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All passages split into those of strong (src0-9) and weak models."""
    rows = passages(spark, sf)
    return rows.where(F.col("number") < 10), rows.where(F.col("number") >= 10)


HIGH_LOW = """high AS (
  SELECT *, row_number() OVER (PARTITION BY korean_topic ORDER BY benchmark_id, pos) AS rn
  FROM passages WHERE number < 10),
low AS (
  SELECT *, row_number() OVER (PARTITION BY korean_topic ORDER BY benchmark_id, pos) AS rn
  FROM passages WHERE number >= 10)"""

RUBRIC_LIST = "rubrics AS (SELECT unnest([" + ", ".join(f"'{r}'" for r in RUBRICS) + "]) AS rubric)"

IMP = f"""{PASSAGES}, {GUIDELINES}, {HIGH_LOW}, {RUBRIC_LIST},
imp AS (
  SELECT 'imp_' || rubric || '_' || h.korean_topic || '_' || printf('%04d', rn) AS pair_id, rubric,
         h.korean_topic, h.korean_context, g.problem_types, g.eval_goals,
         CASE WHEN h.foreign_topic = l.foreign_topic THEN h.foreign_topic END AS foreign_topic,
         h.generated_passage AS chosen, l.generated_passage AS rejected, rn
  FROM high h JOIN low l USING (korean_topic, rn) JOIN guidelines g ON g.benchmark_id = h.benchmark_id
  CROSS JOIN rubrics)"""


def imp_pairs(spark: SparkSession, sf: str, rubrics: list[str] = RUBRICS) -> DataFrame:
    """Inter-model pairs of all passages, without a cap."""
    high, low = high_low(spark, sf)
    g = guidelines(spark, sf)
    return pairs_inter_model(with_guideline(high, g), with_guideline(low, g), rubrics, cap=None, id="passage_id")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    c = table(spark, sf, "conversations")
    user = c.where(F.col("role") == "user").select(
        "conv_id", "turn", F.concat_ws("_", "conv_id", "turn").alias("turn_id"), F.col("text").alias("prompt")
    )
    answer = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return user.join(answer, ["conv_id", "turn"])


TURNS = """turns AS (
  SELECT u.conv_id, u.turn, u.conv_id || '_' || u.turn AS turn_id, u.text AS prompt, a.text AS response
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of a language and model as numbered attempts at one item."""
    rows = passages(spark, sf).select("lang", "model", "passage_id", F.col("generated_passage").alias("text"))
    return numbered(rows, ["lang", "model"], ["passage_id"], "passage_id", "attempt")


ATTEMPTS = """attempts AS (
  SELECT lang, model, passage_id, generated_passage AS text,
         row_number() OVER (PARTITION BY lang, model ORDER BY passage_id) AS attempt
  FROM passages)"""


def template_of(id: Column) -> Column:
    """One of the templates, by id."""
    return F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (id % len(TEMPLATES) + 1).cast("int"))


TEMPLATE = (
    "([" + ", ".join(f"'{t}'" for t in TEMPLATES) + f"])[CAST(doc_id % {len(TEMPLATES)} + 1 AS INTEGER)]"
)


def scored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Inter-model pairs of one rubric with length based scores."""
    pairs = imp_pairs(spark, sf, RUBRICS[:1])
    return pairs.withColumn("chosen_score", F.length("chosen") % 97 / 7).withColumn(
        "rejected_score", F.length("rejected") % 97 / 7
    )


SCORED = f"""{IMP}, scored AS (
  SELECT pair_id, chosen, rejected, length(chosen) % 97 / 7 AS chosen_score,
         length(rejected) % 97 / 7 AS rejected_score,
         length(chosen) % 97 / 7 - length(rejected) % 97 / 7 AS score_difference
  FROM imp WHERE rubric = '{RUBRICS[0]}')"""


def length_scorer():
    """Builds a stand-in for a reward model: a score from the text length."""

    def make():
        return lambda s: s.str.len() % 97 / 7

    return make
