"""Scoring, agreement, ranking and choosing attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import attempts as W
from pairloom.operators import ranking as K
from pairloom.operators import scoring as S
from pairloom.operators.numbering import first_within, number_within, shuffled
from pairloom.operators.responses import evaluation_long, evaluation_summary
from pairloom.values import RUBRIC_LABELS, RUBRICS
from workload.registry import query
from workload.views import (
    ATTEMPTS,
    BINARY,
    PASSAGES,
    SCORED,
    SCORES,
    attempts,
    binary,
    imp_pairs,
    length_scorer,
    scored_pairs,
    table,
    wide_scores,
)

SCORE_COLUMNS = [f"{r}_score" for r in RUBRICS]


@query(
    "score_with",
    "SELECT doc_id, round(length(text) % 97 / 7, 6) AS reward_score, 'length' AS evaluation_model "
    "FROM documents WHERE length(text) > 0",
)
def score_with(spark, sf):
    rows = S.score_with(table(spark, sf, "documents"), "text", length_scorer(), model="length")
    return rows.select("doc_id", F.round("reward_score", 6).alias("reward_score"), "evaluation_model")


@query(
    "score_with_errors",
    "SELECT doc_id, CASE WHEN length(text) <= 3000 THEN round(length(text) % 97 / 7, 6) END AS reward_score, "
    "CASE WHEN length(text) > 3000 THEN 'ValueError: longer than 3000' END AS score_error FROM documents WHERE length(text) > 0",
)
def score_with_errors(spark, sf):
    """A scorer that can't take long texts: each fails alone."""
    def scorer():
        def score(s):
            if (s.str.len() > 3000).any():
                raise ValueError("longer than 3000")
            return s.str.len() % 97 / 7

        return score

    rows = S.score_with(table(spark, sf, "documents"), "text", scorer, errors="score_error")
    return rows.select("doc_id", F.round("reward_score", 6).alias("reward_score"), "score_error")


@query(
    "compare_with",
    f"""WITH {SCORED}
SELECT pair_id, round(chosen_score, 6) AS chosen_score, round(rejected_score, 6) AS rejected_score,
       round(score_difference, 6) AS score_difference, chosen_score > rejected_score AS correct_preference FROM scored""",
)
def compare_with(spark, sf):
    rows = S.compare_with(imp_pairs(spark, sf, RUBRICS[:1]), length_scorer())
    scores = ["chosen_score", "rejected_score", "score_difference"]
    return rows.select("pair_id", *[F.round(c, 6).alias(c) for c in scores], "correct_preference")


@query(
    "pairwise_accuracy",
    f"""WITH {SCORED}
SELECT count(*) AS total_pairs, count(*) FILTER (chosen_score > rejected_score) AS correct_preferences,
       round(avg((chosen_score > rejected_score)::INT), 6) AS accuracy,
       round(100 * avg((chosen_score > rejected_score)::INT), 6) AS accuracy_percent,
       round(avg(score_difference), 6) AS mean_difference FROM scored""",
)
def pairwise_accuracy(spark, sf):
    rows = S.pairwise_accuracy(scored_pairs(spark, sf))
    return rows.select(
        "total_pairs",
        "correct_preferences",
        *[F.round(c, 6).alias(c) for c in ("accuracy", "accuracy_percent", "mean_difference")],
    )


_AB = f"""{SCORED}, ab AS (
  SELECT *, substr(md5('42:' || pair_id), 1, 1) < '8' AS straight FROM scored)"""


@query(
    "ab_order",
    f"""WITH {_AB}
SELECT pair_id, md5(CASE WHEN straight THEN chosen ELSE rejected END) AS text_a,
       md5(CASE WHEN straight THEN rejected ELSE chosen END) AS text_b,
       CASE WHEN straight THEN 'A' ELSE 'B' END AS correct_choice FROM ab""",
)
def ab_order(spark, sf):
    rows = S.ab_order(scored_pairs(spark, sf))
    return rows.select("pair_id", F.md5("text_a").alias("text_a"), F.md5("text_b").alias("text_b"), "correct_choice")


def choices(pairs):
    """A judge that picks by length; no choice when both texts are as long."""
    shown = S.ab_order(pairs)
    a, b = F.length("text_a"), F.length("text_b")
    return shown.withColumn("choice", F.when(a > b, "A").when(a < b, "B"))


_HIT = "length(chosen) > length(rejected)"


@query(
    "judge_accuracy",
    f"""WITH {SCORED}
SELECT count(*) AS total_pairs, count(*) FILTER ({_HIT}) AS correct_predictions,
       round(avg(({_HIT})::INT), 6) AS accuracy FROM scored""",
)
def judge_accuracy(spark, sf):
    rows = S.judge_accuracy(choices(scored_pairs(spark, sf)))
    return rows.select("total_pairs", "correct_predictions", F.round("accuracy", 6).alias("accuracy"))


@query(
    "agreement",
    f"""WITH {SCORED}, v AS (SELECT chosen_score > rejected_score AS rm, {_HIT} AS judge FROM scored)
SELECT count(*) AS total_comparisons, count(*) FILTER (rm = judge) AS agreements,
       count(*) FILTER (rm <> judge) AS disagreements, round(avg((rm = judge)::INT), 6) AS agreement_rate,
       round(avg(rm::INT), 6) AS reward_model_accuracy, round(avg(judge::INT), 6) AS judge_accuracy FROM v""",
)
def agreement(spark, sf):
    scored = scored_pairs(spark, sf)
    rows = S.agreement(S.with_difference(scored), S.judge_results(choices(scored)))
    rates = ["agreement_rate", "reward_model_accuracy", "judge_accuracy"]
    return rows.select(
        "total_comparisons", "agreements", "disagreements", *[F.round(c, 6).alias(c) for c in rates]
    )


_FAILED = ", ".join(f"CASE WHEN NOT {r} THEN '{RUBRIC_LABELS[r]}' END" for r in RUBRICS)
_PASSED = " + ".join(f"{r}::INT" for r in RUBRICS)


@query(
    "binary_summary",
    f"""WITH {SCORES}, {BINARY}
SELECT passage_id, ({_PASSED}) || '/6' AS pass_rate, ({_PASSED}) = 6 AS all_passed,
       array_to_string(list_filter([{_FAILED}], lambda x: x IS NOT NULL), ', ') AS failed_items,
       CASE WHEN korean_quality THEN '✅ 통과' ELSE '❌ 실패' END AS korean_quality_label FROM verdict""",
)
def binary_summary(spark, sf):
    return S.binary_summary(binary(spark, sf)).select(
        "passage_id",
        "pass_rate",
        "all_passed",
        F.array_join("failed_items", ", ").alias("failed_items"),
        F.col("labels.korean_quality").alias("korean_quality_label"),
    )


_ALL = " AND ".join(RUBRICS)


@query(
    "gate_detail",
    f"""WITH {SCORES}, {BINARY}
SELECT passage_id, ({_ALL}) AS overall_passed, NOT ({_ALL}) AS skipped,
       CASE WHEN NOT ({_ALL}) THEN '이진 루브릭 평가에서 실패 항목 존재' END AS reason,
       CASE WHEN {_ALL} THEN logical_flow_score END::VARCHAR AS logical_flow_score
FROM verdict JOIN wide USING (passage_id)""",
)
def gate_detail(spark, sf):
    detail = wide_scores(spark, sf).select("passage_id", "logical_flow_score")
    rows = S.gate_detail(binary(spark, sf), detail)
    return rows.withColumn("logical_flow_score", F.col("logical_flow_score").cast("string"))


@query(
    "combine_scores",
    f"""WITH {SCORES}
SELECT passage_id, ({' + '.join(SCORE_COLUMNS)})::DOUBLE AS total,
       round(({' + '.join(SCORE_COLUMNS)}) / 6, 6) AS ensemble, least({', '.join(SCORE_COLUMNS)})::DOUBLE AS lowest FROM wide""",
)
def combine_scores(spark, sf):
    return wide_scores(spark, sf).select(
        "passage_id",
        K.combine_scores(SCORE_COLUMNS).alias("total"),
        F.round(K.combine_scores(SCORE_COLUMNS, "mean"), 6).alias("ensemble"),
        K.combine_scores(SCORE_COLUMNS, "min").alias("lowest"),
    )


_SUM, _MIN = " + ".join(SCORE_COLUMNS), f"least({', '.join(SCORE_COLUMNS)})"


def _ranks(by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""{SCORES}, ranks AS (
  SELECT passage_id, lang, row_number() OVER ({part}ORDER BY {_SUM} DESC, passage_id) AS a,
         row_number() OVER ({part}ORDER BY {_MIN} DESC, passage_id) AS b FROM wide)"""


@query("rank_passages", f"WITH {_ranks('')} SELECT passage_id, a AS rm_ranking FROM ranks")
def rank_passages(spark, sf):
    rows = K.rank_passages(wide_scores(spark, sf), "passage_id", SCORE_COLUMNS)
    return rows.select("passage_id", "rm_ranking")


@query("rank_passages_by_language", f"WITH {_ranks('lang')} SELECT lang, passage_id, b AS rm_ranking FROM ranks")
def rank_passages_by_language(spark, sf):
    rows = K.rank_passages(wide_scores(spark, sf), "passage_id", SCORE_COLUMNS, how="min", by=["lang"])
    return rows.select("lang", "passage_id", "rm_ranking")


@query("top_k_select", f"WITH {_ranks('lang')} SELECT lang, passage_id, a AS rm_ranking FROM ranks WHERE a <= 25")
def top_k_select(spark, sf):
    rows = K.top_k_select(wide_scores(spark, sf), "passage_id", 25, SCORE_COLUMNS, by=["lang"])
    return rows.select("lang", "passage_id", "rm_ranking")


@query(
    "hardest_pairs",
    f"""WITH {SCORED}
SELECT pair_id, round(score_difference, 6) AS score_difference FROM scored
ORDER BY scored.score_difference, pair_id LIMIT 5""",
)
def hardest_pairs(spark, sf):
    rows = K.hardest_pairs(S.with_difference(scored_pairs(spark, sf)).select("pair_id", "score_difference"))
    return rows.select("pair_id", F.round("score_difference", 6).alias("score_difference"))


@query("sample_head", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 3")
def sample_head(spark, sf):
    return K.sample_head(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])


def rankings(spark, sf, by):
    """Passages ranked by summed and by lowest score."""
    scores = wide_scores(spark, sf)
    sides = []
    for how in ("sum", "min"):
        rows = K.rank_passages(scores, "passage_id", SCORE_COLUMNS, how, by, "rank")
        sides.append(rows.select(*by, F.col("passage_id").alias("id"), "rank"))
    return sides


@query(
    "recall_at_k",
    f"""WITH {_ranks('lang')}
SELECT lang, count(*) FILTER (a <= 25 AND b <= 25) AS hits,
       round(count(*) FILTER (a <= 25 AND b <= 25) / 25, 6) AS recall FROM ranks GROUP BY lang""",
)
def recall_at_k(spark, sf):
    rows = K.recall_at_k(*rankings(spark, sf, ["lang"]), by=["lang"])
    return rows.select("lang", "hits", F.round("recall", 6).alias("recall"))


_RBO = """met AS (SELECT {g} AS g, greatest(a, b) AS d, count(*) AS n FROM ranks GROUP BY ALL),
depths AS (SELECT {g} AS g, a AS d FROM ranks),
overlap AS (
  SELECT g, d, sum(coalesce(n, 0)) OVER (PARTITION BY g ORDER BY d) AS x FROM depths LEFT JOIN met USING (g, d))
SELECT {head}round(0.1 * sum(pow(0.9, d - 1) * x / d), 9) AS rbo FROM overlap {tail}"""


@query("rbo", f"WITH {_ranks('')}, " + _RBO.format(g="1", head="", tail=""))
def rbo(spark, sf):
    return K.rbo(*rankings(spark, sf, [])).select(F.round("rbo", 9).alias("rbo"))


@query("rbo_by_language", f"WITH {_ranks('lang')}, " + _RBO.format(g="lang", head="g AS lang, ", tail="GROUP BY g"))
def rbo_by_language(spark, sf):
    rows = K.rbo(*rankings(spark, sf, ["lang"]), by=["lang"])
    return rows.select("lang", F.round("rbo", 9).alias("rbo"))


@query(
    "rbo_bounds_by_language",
    f"""WITH {_ranks('lang')}, met AS (SELECT lang, greatest(a, b) AS d, count(*) AS n FROM ranks GROUP BY ALL),
depths AS (SELECT lang, a AS d FROM ranks),
known AS (SELECT lang, d, sum(coalesce(n, 0)) OVER (PARTITION BY lang ORDER BY d) AS x FROM depths LEFT JOIN met USING (lang, d)),
sums AS (SELECT lang, max(d) AS l, max(x) AS x, sum(pow(0.9, d - 1) * x / d) AS s, sum(pow(0.9, d - 1) / d) AS h FROM known GROUP BY lang),
low AS (SELECT *, 0.1 * (s + x * greatest(-ln(0.1) / 0.9 - h, 0)) AS low FROM sums)
SELECT lang, round(low, 9) AS rbo_min, round(0.1 * s + pow(0.9, l) - low, 9) AS rbo_res, round(0.1 * s + x / l * pow(0.9, l), 9) AS rbo_ext
FROM low""",
)
def rbo_bounds_by_language(spark, sf):
    """What the overlap of the two rankings is if they go on."""
    rows = K.rbo_bounds(*rankings(spark, sf, ["lang"]), by=["lang"])
    return rows.select("lang", *[F.round(c, 9).alias(c) for c in ("rbo_min", "rbo_res", "rbo_ext")])


@query(
    "first_valid_attempt",
    f"""WITH {PASSAGES}, {ATTEMPTS}, tries AS (SELECT * FROM attempts WHERE attempt <= 10),
ok AS (SELECT lang, model, min(attempt) FILTER (length(text) BETWEEN 300 AND 500) AS first, count(*) AS tried
       FROM tries GROUP BY lang, model)
SELECT ok.lang, ok.model, md5(t.text) AS body, length(t.text)::VARCHAR AS passage_length,
       CASE WHEN first IS NULL THEN tried ELSE first - 1 END::INTEGER AS retries_used, first IS NOT NULL AS success,
       CASE WHEN first IS NULL THEN '최대 재시도 횟수(10)를 초과했습니다.' END AS error
FROM ok LEFT JOIN tries t ON t.lang = ok.lang AND t.model = ok.model AND t.attempt = first""",
)
def first_valid_attempt(spark, sf):
    rows = W.first_valid_attempt(attempts(spark, sf), ["lang", "model"])
    return rows.select(
        "lang",
        "model",
        F.md5("generated_passage").alias("body"),
        F.col("passage_length").cast("string").alias("passage_length"),
        "retries_used",
        "success",
        "error",
    )


@query("null_passages", "SELECT doc_id FROM documents WHERE n_chars % 10 = 0")
def null_passages(spark, sf):
    text = F.when(F.col("n_chars") % 10 > 0, F.col("text"))
    rows = table(spark, sf, "documents").withColumn("generated_passage", text)
    return W.null_passages(rows).select("doc_id")


@query(
    "evaluation_long",
    f"""WITH {SCORES}
SELECT passage_id, rubric, CASE WHEN passage_id % 2 = 0 THEN score END::VARCHAR AS score,
       CASE WHEN passage_id % 2 = 1 THEN score > 1 END::VARCHAR AS passed FROM long""",
)
def evaluation_long_(spark, sf):
    kind = F.when(F.col("passage_id") % 2 == 1, "passage_eval.eval_rubric_binary").otherwise("passage_eval.eval_rubric")
    both = wide_scores(spark, sf).join(binary(spark, sf).select("passage_id", *RUBRICS), "passage_id")
    rows = evaluation_long(both.withColumn("template", kind), ["passage_id"])
    return rows.select(
        "passage_id", "rubric", F.col("score").cast("string").alias("score"), F.col("passed").cast("string").alias("passed")
    )


@query(
    "evaluation_summary",
    f"""WITH {SCORES}
SELECT passage_id, ({_SUM} - CASE WHEN n_chars % 4 = 0 THEN korean_quality_score ELSE 0 END)::DOUBLE AS total,
       CASE WHEN n_chars % 4 = 0 THEN 'N/A' ELSE korean_quality_score::VARCHAR END AS korean_quality_score,
       logical_flow_score::VARCHAR AS logical_flow_score FROM wide""",
)
def evaluation_summary_(spark, sf):
    known = F.when(F.col("n_chars") % 4 > 0, F.col("korean_quality_score"))
    rows = evaluation_summary(wide_scores(spark, sf).withColumn("korean_quality_score", known), ["passage_id"])
    return rows.select("passage_id", "total", "korean_quality_score", "logical_flow_score")


_NEW = f"""{PASSAGES}, {ATTEMPTS}, clean AS (
  SELECT lang, model, attempt, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '\\([^)]*\\)', '', 'g'), '\\[[^\\]]*\\]', '', 'g'), '\\{{[^}}]*\\}}', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS t
  FROM attempts WHERE attempt <= 5),
ok AS (SELECT lang, model, arg_min(t, attempt) FILTER (length(t) >= 300) AS t FROM clean GROUP BY lang, model)"""


@query(
    "regenerated",
    f"""WITH {_NEW}
SELECT lang, model, md5(coalesce(CASE WHEN length(t) <= 500 THEN t
    WHEN strpos(reverse(t), '.') > 0 AND length(t) - strpos(reverse(t), '.') < 500
      THEN substr(t, 1, length(t) - strpos(reverse(t), '.') + 1)
    ELSE substr(t, 1, 500) END, '생성 실패')) AS body FROM ok""",
)
def regenerated(spark, sf):
    rows = W.regenerated(attempts(spark, sf), ["lang", "model"])
    return rows.select("lang", "model", F.md5("generated_passage").alias("body"))


@query(
    "number_within",
    "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS pos FROM documents",
)
def number_within_(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    order = [F.col("n_chars").desc(), F.col("doc_id")]
    return number_within(rows, ["lang"], order).select("doc_id", "lang", "pos")


@query(
    "number_within_spread",
    "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS pos FROM documents",
)
def number_within_spread(spark, sf):
    """The same numbers on the way large groups take."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    order = [F.col("n_chars").desc(), F.col("doc_id")]
    return number_within(rows, ["lang"], order, spread=True).select("doc_id", "lang", "pos")


@query(
    "first_within",
    "SELECT * FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS n "
    "FROM documents) WHERE n <= 30",
)
def first_within_(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").withColumn("lot", shuffled(42, F.col("doc_id")))
    return first_within(rows, ["lang"], [F.col("lot"), F.col("doc_id")], 30, "n").select("doc_id", "lang", "n")
