"""Whole jobs: from responses or passages to written data sets and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.pairs import generation_grid, one_by_one
from pairloom.plans import datasets as D
from pairloom.plans import evaluation as E
from pairloom.schemas import TRAIN_RECORD
from pairloom.sources.files import read_jsonl
from pairloom.storage import new_path
from pairloom.streaming.responses import one_answer, stream_responses, write_responses
from workload.pairs import _EVALS, SAMPLES, listed, samples
from workload.parsing import _SCORE, _SCORE_RESPONSES, score_responses
from workload.records import _SPLIT, TEMPLATES
from workload.registry import query
from workload.sources import response_files, written_evaluations
from workload.stats import _PAIR_STATS
from workload.views import (
    ATTEMPTS,
    IMP,
    PASSAGES,
    SCORES,
    attempts,
    guidelines,
    high_low,
    imp_pairs,
    length_scorer,
    long_scores,
    models,
    passages,
    table,
)

_TOTALS = """SELECT rubric, n::BIGINT AS n_pairs, 1::BIGINT AS n_rubrics, n::DOUBLE AS mean_per_rubric FROM c UNION ALL
SELECT 'total', sum(n)::BIGINT, count(*), sum(n) / count(*) FROM c"""


@query(
    "build_spf",
    f"""WITH {SCORES}, {_EVALS}, v AS (
  SELECT rubric, count(*) FILTER (result = 'pass') AS p, count(*) FILTER (result = 'fail') AS f FROM evals GROUP BY rubric),
c AS (SELECT rubric, least(p, f) AS n FROM v) {_TOTALS}""",
)
def build_spf(spark, sf):
    answer = F.when(F.col("score") > 2, "PASS").when(F.col("score") == 2, "?").otherwise("Fail: ")
    rows = long_scores(spark, sf).select("passage_id", "rubric", answer.alias("response"))
    return D.build_spf(rows, passages(spark, sf), new_path(spark, "spf"))


@query(
    "build_imp",
    f"WITH {IMP}, c AS (SELECT rubric, count(*) AS n FROM imp GROUP BY rubric) {_TOTALS}",
)
def build_imp(spark, sf):
    high, low = high_low(spark, sf)
    return D.build_imp(high, low, guidelines(spark, sf), new_path(spark, "imp"), id="passage_id")


@query(
    "build_icp",
    f"WITH {IMP}, c AS (SELECT rubric, count(*) AS n FROM imp WHERE rubric = 'korean_quality' GROUP BY rubric) {_TOTALS}",
)
def build_icp(spark, sf):
    high, low = high_low(spark, sf)
    rubric = D.icp_rubric("passage_agent.violate_korean_quality_severely")
    return D.build_icp(high, low, guidelines(spark, sf), rubric, new_path(spark, "icp"), id="passage_id")


@query(
    "build_template_pairs",
    r"""WITH """
    + PASSAGES
    + r""", c AS (
  SELECT *, row_number() OVER (PARTITION BY benchmark_id ORDER BY passage_id) AS at FROM passages WHERE number < 10), r AS (
  SELECT *, row_number() OVER (PARTITION BY benchmark_id ORDER BY passage_id) AS at FROM passages WHERE number >= 10),
pairs AS (SELECT CASE WHEN c.n_chars % 9 = 0 THEN ' ' ELSE c.generated_passage END AS chosen FROM c JOIN r
  ON c.benchmark_id = r.benchmark_id AND c.at = r.at AND c.lang = r.lang)
SELECT 'blank chosen' AS issue, count(*) AS n FROM pairs WHERE trim(chosen, E' \t\n\r') = '' HAVING count(*) > 0""",
)
def build_template_pairs(spark, sf):
    high, low = high_low(spark, sf)
    text = F.when(F.col("n_chars") % 9 == 0, " ").otherwise(F.col("generated_passage"))
    chosen = listed(high).withColumn("generated_passage", text).join(guidelines(spark, sf), "benchmark_id")
    return D.build_template_pairs(chosen, listed(low), "m", "v1.0.0", "2025-08-05", new_path(spark, "templates"))


@query(
    "build_score_gap",
    f"""WITH {SCORES}, lengths AS (SELECT passage_id, length(generated_passage) AS n FROM passages)
SELECT a.rubric, a.score - b.score AS margin, count(*) AS n, sum(p.n)::BIGINT AS chosen_chars, sum(q.n)::BIGINT AS rejected_chars
FROM long a JOIN long b ON a.rubric = b.rubric AND a.source_key = b.source_key AND a.score - b.score >= 2
JOIN lengths p ON p.passage_id = a.passage_id JOIN lengths q ON q.passage_id = b.passage_id GROUP BY ALL""",
)
def build_score_gap(spark, sf):
    """An evaluation tree to record files; the records are read back."""
    root = new_path(spark, "score-gap")
    D.build_score_gap(spark, written_evaluations(spark, sf), root, min_gap=2, pattern="*", format="parquet")
    text = T.StructType([T.StructField("value", T.StringType())])
    schema = T.StructType(
        [
            T.StructField("chosen", text),
            T.StructField("rejected", text),
            T.StructField("metadata", T.StructType([T.StructField("margin", T.IntegerType())])),
            T.StructField("rubric", T.StringType()),
        ]
    )
    return (
        spark.read.schema(schema)
        .parquet(root)
        .groupBy("rubric", "metadata.margin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.length("chosen.value")).alias("chosen_chars"),
            F.sum(F.length("rejected.value")).alias("rejected_chars"),
        )
    )


@query(
    "build_score_gap_pairs",
    f"""WITH {SCORES}, lengths AS (SELECT passage_id, length(generated_passage) AS n FROM passages)
SELECT a.rubric, a.score - b.score AS margin, count(*) AS n, sum(p.n)::BIGINT AS chosen_chars, sum(q.n)::BIGINT AS rejected_chars
FROM long a JOIN long b ON a.rubric = b.rubric AND a.source_key = b.source_key AND a.score - b.score >= 2
JOIN lengths p ON p.passage_id = a.passage_id JOIN lengths q ON q.passage_id = b.passage_id GROUP BY ALL""",
)
def build_score_gap_pairs(spark, sf):
    """The same pairs as ids and a table of texts; lengths are looked up."""
    root = new_path(spark, "score-gap")
    D.build_score_gap_pairs(spark, written_evaluations(spark, sf), root, min_gap=2, pattern="*")
    n = spark.read.parquet(f"{root}/passages").select("passage_id", F.length("text").alias("n"))
    pairs = spark.read.parquet(f"{root}/pairs")
    times = pairs.groupBy("rejected_ids", "rubric", "margin").agg(F.count(F.lit(1)).alias("held"))  # passages of a cell share their list

    def chars(pairs, side, held):
        """Pairs are counted by id where they lie, so lengths meet each passage of a side once, not each pair."""
        counts = pairs.groupBy("rubric", "margin", F.col(f"{side}_id").alias("passage_id")).agg(F.sum(held).alias("held"))
        total = F.sum(F.col("held") * F.col("n")).alias(f"{side}_chars")
        return counts.join(n, "passage_id").groupBy("rubric", "margin").agg(F.sum("held").alias("n"), total)

    chosen = chars(pairs, "chosen", F.size("rejected_ids").cast("long"))
    return chosen.join(chars(one_by_one(times), "rejected", "held").drop("n"), ["rubric", "margin"])


@query("score_gap_report", _PAIR_STATS.replace(">= 1", ">= 2"))
def score_gap_report(spark, sf):
    """The counts the same job reports, without its records."""
    return D.score_gap_report(spark, written_evaluations(spark, sf), min_gap=2, pattern="*")


@query(
    "convert_pairs",
    f"""WITH {_SPLIT}
SELECT split, count(*) AS n, sum(length(trim(chosen, E' \\t\\n\\r')))::BIGINT AS chars FROM split GROUP BY split""",
)
def convert_pairs(spark, sf):
    paths = [new_path(spark, name) for name in ("train", "eval")]
    D.convert_pairs(imp_pairs(spark, sf), TEMPLATES, *paths)
    train, held = (read_jsonl(spark, p, TRAIN_RECORD) for p in paths)
    both = train.withColumn("split", F.lit("train")).unionByName(held.withColumn("split", F.lit("eval")))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("chosen")).alias("chars"))


_VERDICTS = f"""{SAMPLES}, v AS (
  SELECT topic, chosen_name, length(chosen) % 97 / 7 > length(rejected) % 97 / 7 AS rm, length(chosen) > length(rejected) AS judge
  FROM labelled), last AS (SELECT DISTINCT ON (topic) * FROM v ORDER BY topic, chosen_name DESC)"""


def _answers(spark, sf):
    """All labelled samples, and a judge's answer to every pair as it was shown."""
    rows = samples(spark, sf)
    a, b = F.length("text_a"), F.length("text_b")
    answer = F.when(a > b, "A: longer").when(a < b, "선택: B").otherwise("같다")
    shown = E.judge_prompts(rows).select("pair_id", "metadata.chosen_name", answer.alias("response"))
    return rows, shown


@query(
    "preference_ranking",
    f"""WITH {_VERDICTS}
SELECT count(*) AS total_comparisons, count(*) FILTER (rm = judge) AS agreements,
       count(*) FILTER (rm <> judge) AS disagreements, round(avg((rm = judge)::INT), 6) AS agreement_rate,
       (SELECT round(avg(rm::INT), 6) FROM v) AS reward_model_accuracy, (SELECT round(avg(judge::INT), 6) FROM v) AS judge_accuracy
FROM last""",
)
def preference_ranking(spark, sf):
    result = E.preference_ranking(*_answers(spark, sf), length_scorer())
    rates = ["agreement_rate", "reward_model_accuracy", "judge_accuracy"]
    return result.select("total_comparisons", "agreements", "disagreements", *[F.round(c, 6).alias(c) for c in rates])


@query(
    "agreement_details",
    f"""WITH {_VERDICTS}
SELECT 'preference_pair_' || topic AS pair_id, topic, rm AS rm_prefers_chosen, judge AS judge_prefers_chosen, rm = judge AS agreement
FROM last""",
)
def agreement_details(spark, sf):
    rows = E.preference_details(*_answers(spark, sf), length_scorer())
    return rows.select("pair_id", "topic", "rm_prefers_chosen", "judge_prefers_chosen", "agreement")


@query(
    "rank_candidates",
    """
SELECT doc_id, row_number() OVER (ORDER BY length(text) % 97 / 7 + length(text) % 89 / 3 DESC, doc_id) AS rm_ranking
FROM documents WHERE length(text) > 0""",
)
def rank_candidates(spark, sf):
    def other():
        return lambda s: s.str.len() % 89 / 3

    rows = table(spark, sf, "documents").select("doc_id", F.col("text").alias("passage"))
    scorers = {"r1_score": length_scorer(), "r2_score": other}
    return E.rank_candidates(rows, scorers, new_path(spark, "ranked"), "doc_id").select("doc_id", "rm_ranking")


_CLEAN = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\([^)]*\)', '', 'g'), "
    r"'\[[^\]]*\]', '', 'g'), '\{[^}]*\}', '', 'g'), '[ \t\n\r]+', ' ', 'g'))"
)


@query(
    "regenerate_nulls",
    f"""WITH {PASSAGES}, {ATTEMPTS}, clean AS (SELECT lang, model, attempt, {_CLEAN} AS t FROM attempts WHERE attempt <= 5),
ok AS (SELECT lang, model, arg_min(t, attempt) AS t FROM clean WHERE length(t) >= 300 GROUP BY lang, model),
cut AS (SELECT lang, model, CASE WHEN length(t) <= 500 THEN t
    WHEN strpos(reverse(t), '.') > 0 AND length(t) - strpos(reverse(t), '.') < 500 THEN substr(t, 1, length(t) - strpos(reverse(t), '.') + 1)
    ELSE substr(t, 1, 500) END AS t FROM ok)
SELECT passage_id, md5(CASE WHEN p.n_chars % 4 > 0 THEN generated_passage ELSE coalesce(t, '생성 실패') END) AS body
FROM passages p LEFT JOIN cut USING (lang, model)""",
)
def regenerate_nulls(spark, sf):
    text = F.when(F.col("n_chars") % 4 > 0, F.col("generated_passage"))
    rows = passages(spark, sf).select("passage_id", "lang", "model", text.alias("generated_passage"))
    filled = E.regenerate_nulls(rows, attempts(spark, sf), ["lang", "model"])
    return filled.select("passage_id", F.md5("generated_passage").alias("body"))


@query(
    "generation_results",
    f"""WITH {PASSAGES}, {ATTEMPTS}, ok AS (
  SELECT lang, model, arg_min(text, attempt) AS t FROM attempts
  WHERE attempt <= 10 AND length(text) BETWEEN 300 AND 500 GROUP BY lang, model)
SELECT l.lang, m.model, t IS NOT NULL AS success, md5(t) AS body
FROM (SELECT DISTINCT lang FROM passages) l CROSS JOIN (SELECT DISTINCT model FROM passages) m LEFT JOIN ok USING (lang, model)""",
)
def generation_results(spark, sf):
    langs = table(spark, sf, "documents").select("lang").distinct()
    items = generation_grid(langs, models(spark, sf), ["t"])
    rows = E.generation_results(items, attempts(spark, sf), ["lang", "model"])
    return rows.select("lang", "model", "success", F.md5("generated_passage").alias("body"))


@query(
    "stream_responses",
    f"""WITH {_SCORE_RESPONSES}
SELECT 'request_' || doc_id AS custom_id, coalesce({_SCORE}, 3)::INTEGER AS score FROM responses""",
)
def stream_responses_(spark, sf):
    """Every answer arrives twice; the stream ends when all files are read."""
    rows = score_responses(spark, sf)
    folder = response_files(spark, sf, rows.unionByName(rows), "doc_id")
    out = new_path(spark, "parsed")
    write_responses(stream_responses(spark, folder), out, new_path(spark, "stream")).awaitTermination()
    return one_answer(spark.read.parquet(out)).select("custom_id", "score")
