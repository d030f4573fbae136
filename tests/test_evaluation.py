import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import attempts as W
from pairloom.operators import ranking as K
from pairloom.operators import scoring as S
from pairloom.operators import stats as A
from pairloom.values import RUBRIC_LABELS, RUBRICS

# Six scores per passage chosen to give the known sums and minima.
SUMS = [15.75, 13.25, 12.10, 6.42, 1.98]
MINIMA = [1.0625, 0.9219, -0.0386, -0.3184, -2.4688]
OTHER = [1, 4, 2, 3, 5]


def ranked(spark):
    rows = []
    for i, (total, low) in enumerate(zip(SUMS, MINIMA)):
        rest = (total - low) / 5
        rows.append((f"p{i}", low, rest, rest, rest, rest, rest, OTHER[i]))
    schema = "id string, " + ", ".join(f"r{i}_score double" for i in range(1, 7)) + ", gemini_ranking int"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("how", ["sum", "mean", "min"])
def test_known_ranking(spark, how):
    df = ranked(spark)
    got = {r["id"]: r["rm_ranking"] for r in K.rank_passages(df, "id", how=how).collect()}
    assert got == {f"p{i}": i + 1 for i in range(5)}
    want = {"sum": SUMS, "mean": [s / 6 for s in SUMS], "min": MINIMA}[how]
    totals = [r[0] for r in df.orderBy("id").select(K.combine_scores(how=how)).collect()]
    assert totals == pytest.approx(want)


def test_known_overlap(spark):
    df = K.rank_passages(ranked(spark), "id")
    rm = df.select("id", F.col("rm_ranking").alias("rank"))
    gold = df.select("id", F.col("gemini_ranking").alias("rank"))
    for k, want in ((1, 1.0), (2, 1 / 2), (3, 2 / 3), (5, 1.0)):
        assert K.recall_at_k(rm, gold, k).first()["recall"] == pytest.approx(want)


def naive_rbo(a, b, p):
    n = max(max(a.values()), max(b.values()))
    total = 0.0
    for d in range(1, n + 1):
        x = len({i for i, r in a.items() if r <= d} & {i for i, r in b.items() if r <= d})
        total += p ** (d - 1) * x / d
    return (1 - p) * total


@pytest.mark.parametrize("p", [0.5, 0.9, 0.98])
@pytest.mark.parametrize("n,m", [(5, 5), (40, 25), (300, 300)])
def test_rbo_equals_its_definition(spark, p, n, m):
    rng = random.Random(n)
    ids = [f"i{i}" for i in range(max(n, m) + 5)]
    a = {i: r + 1 for r, i in enumerate(rng.sample(ids, n))}
    b = {i: r + 1 for r, i in enumerate(rng.sample(ids, m))}
    da, db = (spark.createDataFrame(list(x.items()), "id string, rank int") for x in (a, b))
    assert K.rbo(da, db, p).first()["rbo"] == pytest.approx(naive_rbo(a, b, p), abs=1e-12)


def test_rbo_bounds_and_groups(spark):
    rows = [(g, f"{g}{i}", i) for g in "xy" for i in range(1, 11)]
    a = spark.createDataFrame(rows, "g string, id string, rank int")
    b = a.withColumn("rank", F.when(F.col("g") == "x", F.col("rank")).otherwise(11 - F.col("rank")))
    got = {r["g"]: r["rbo"] for r in K.rbo(a, b, by=["g"]).collect()}
    assert got["x"] == pytest.approx(1 - 0.9**10) and got["y"] < got["x"]
    apart = a.withColumn("id", F.concat("id", F.lit("!")))
    assert {r["rbo"] for r in K.rbo(a, apart, by=["g"]).collect()} == {0.0}


def test_ties_nulls_and_top_k(spark):
    df = spark.createDataFrame([("b", 1.0, None), ("a", 1.0, 0.0), ("c", None, None), ("d", 3.0, 1.0)], "id string, x double, y double")
    got = [r["id"] for r in K.rank_passages(df, "id", ["x", "y"]).orderBy("rm_ranking").collect()]
    assert got == ["d", "a", "b", "c"]
    assert [r["id"] for r in K.top_k_select(df, "id", 2, ["x", "y"]).orderBy("rm_ranking").collect()] == ["d", "a"]
    low = df.select("id", K.combine_scores(["x", "y"], "min").alias("m"), K.combine_scores(["x", "y"], "mean").alias("e"))
    assert {r["id"]: (r["m"], r["e"]) for r in low.collect()} == {"b": (1.0, 1.0), "a": (0.0, 0.5), "c": (None, None), "d": (1.0, 2.0)}
    with pytest.raises(ValueError):
        K.combine_scores(["x"], "max")



def test_padded_batches():
    lengths = np.array([5, 900, 3, 4, 100_000, 7, 0, 900])
    batches = [b.tolist() for b in S.padded_batches(lengths, 2000, 3)]
    assert sorted(i for b in batches for i in b) == list(range(8))
    assert [4] in batches
    for b in batches:
        assert len(b) <= 3 and (len(b) == 1 or len(b) * lengths[b].max() <= 2000)
    assert list(S.padded_batches(np.array([], "int64"))) == []


def test_a_failing_text_fails_alone(spark):
    def scorer():
        def score(s):
            if s.str.contains("bad").any():
                raise ValueError("no such text")
            return s.str.len() * 1.0

        return score

    rows = [(i, ("bad" if i in (3, 50) else "x" * (i * 37 % 101 + 1))) for i in range(100)]
    df = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    found = {r.i: (r.reward_score, r.why) for r in S.score_with(df, "t", scorer, errors="why", padded=500).collect()}
    assert found == {i: (None, "ValueError: no such text") if t == "bad" else (float(len(t)), None) for i, t in rows}
    pairs = spark.createDataFrame([("1", "aa", "b"), ("2", "aa", "bad"), ("3", "a", "bbb")], "pair_id string, chosen string, rejected string")
    both = {r.pair_id: (r.score_difference, r.why) for r in S.compare_with(pairs, scorer, errors="why").collect()}
    assert both == {"1": (1.0, None), "2": (None, "ValueError: no such text"), "3": (-2.0, None)}
    with pytest.raises(Exception, match="no such text"):
        S.score_with(df, "t", scorer).collect()


def test_scores_and_accuracy(spark):
    df = spark.createDataFrame([("1", "가나다", "가"), ("2", "가", "가나"), ("3", "가", "가"), ("4", "", "가"), ("5", None, "가")], "pair_id string, chosen string, rejected string")
    scored = S.score_with(df, "chosen", lambda: lambda s: s.str.len() * 0.5, model="m")
    assert {r["pair_id"]: r["reward_score"] for r in scored.collect()} == {"1": 1.5, "2": 0.5, "3": 0.5}
    both = S.compare_with(df, lambda: lambda s: s.str.len() * 0.5)
    rows = {r["pair_id"]: (r["score_difference"], r["correct_preference"]) for r in both.collect()}
    assert rows == {"1": (1.0, True), "2": (-0.5, False), "3": (0.0, False)}
    a = S.pairwise_accuracy(both).first()
    assert (a["total_pairs"], a["correct_preferences"], a["accuracy_percent"]) == (3, 1, pytest.approx(100 / 3))
    assert a["mean_difference"] == pytest.approx(0.5 / 3)
    empty = S.pairwise_accuracy(both.where("false")).first()
    assert (empty["total_pairs"], empty["accuracy"], empty["mean_difference"]) == (0, 0.0, 0.0)
    assert [r["pair_id"] for r in K.hardest_pairs(both, 2).collect()] == ["2", "3"]


def test_ab_order_keeps_texts(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("pair_id"), F.lit("c").alias("chosen"), F.lit("r").alias("rejected"))
    rows = S.ab_order(df).collect()
    assert all({r["text_a"], r["text_b"]} == {"c", "r"} for r in rows)
    assert all((r["text_a"] == "c") == (r["correct_choice"] == "A") for r in rows)
    assert 150 < sum(r["correct_choice"] == "A" for r in rows) < 250


def test_judge_and_agreement(spark):
    choices = spark.createDataFrame([("1", "A", "A"), ("2", None, "B"), ("3", "B", "A"), ("9", "B", "B")], "pair_id string, choice string, correct_choice string")
    j = S.judge_accuracy(choices).first()
    assert (j["total_pairs"], j["correct_predictions"], j["accuracy"]) == (4, 2, 0.5)
    rm = spark.createDataFrame([("1", True), ("2", True), ("3", False), ("7", False)], "pair_id string, correct_preference boolean")
    r = S.agreement(rm, S.judge_results(choices)).first()
    assert (r["total_comparisons"], r["agreements"], r["disagreements"]) == (3, 2, 1)
    assert (r["agreement_rate"], r["reward_model_accuracy"], r["judge_accuracy"]) == (pytest.approx(2 / 3), 0.5, 0.5)
    none = S.agreement(rm.where("pair_id = '7'"), S.judge_results(choices)).first()
    assert (none["total_comparisons"], none["agreement_rate"]) == (0, None)


def test_agreement_with_repeated_ids(spark):
    """The last result of an id is compared, accuracies cover all results; without an order repeats are refused."""
    rm = spark.createDataFrame([("p", True, 1), ("p", False, 2), ("q", True, 3)], "pair_id string, correct_preference boolean, at int")
    judge = spark.createDataFrame([("p", False, 1), ("p", True, 2), ("q", True, 3)], "pair_id string, is_correct boolean, at int")
    r = S.agreement(rm, judge, ["at"]).first()
    assert (r["total_comparisons"], r["agreements"], r["agreement_rate"]) == (2, 1, 0.5)
    assert (r["reward_model_accuracy"], r["judge_accuracy"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    rows = {x["pair_id"]: (x["rm_prefers_chosen"], x["judge_prefers_chosen"], x["agreement"]) for x in S.compare_verdicts(rm, judge, ["at"]).collect()}
    assert rows == {"p": (False, True, False), "q": (True, True, True)}
    with pytest.raises(Exception, match="pair ids repeat"):
        S.agreement(rm, judge).collect()


@pytest.mark.parametrize("p", [0.5, 0.9, 0.999])
def test_rbo_is_its_definition(spark, p):
    """No depth is left out, however close p is to 1."""
    import random

    rng = random.Random(4)
    a, b = rng.sample(range(9000), 5000), rng.sample(range(9000), 4500)
    overlap, seen, total = 0, set(), 0.0
    for d in range(1, 5001):
        for side in (a, b):
            if d <= len(side):
                overlap += side[d - 1] in seen
                seen.add(side[d - 1])
        total += p ** (d - 1) * overlap / d
    tables = [spark.createDataFrame([(str(x), i + 1) for i, x in enumerate(s)], "id string, rank int") for s in (a, b)]
    assert K.rbo(*tables, p=p).first()["rbo"] == pytest.approx((1 - p) * total, rel=1e-9)


def test_binary_summary_and_gate(spark):
    schema = "passage_id int, " + ", ".join(f"{r} boolean" for r in RUBRICS)
    df = spark.createDataFrame([(1, *[True] * 6), (2, True, False, True, True, None, True)], schema)
    rows = {r["passage_id"]: r for r in S.binary_summary(df).collect()}
    assert (rows[1]["pass_rate"], rows[1]["all_passed"], rows[1]["failed_items"]) == ("6/6", True, [])
    assert rows[2]["failed_items"] == [RUBRIC_LABELS["clarity_of_core_theme"], RUBRIC_LABELS["korean_quality"]]
    assert rows[2]["labels"]["korean_quality"] == "❌ 실패"
    detail = spark.createDataFrame([(1, 5), (2, 4)], "passage_id int, score int")
    got = {r["passage_id"]: (r["overall_passed"], r["skipped"], r["score"]) for r in S.gate_detail(df, detail).collect()}
    assert got == {1: (True, False, 5), 2: (False, True, None)}


def test_means(spark):
    rows = [("m_1", "logical_flow", 4), ("m_1", "logical_flow", 2), ("m_1", "korean_quality", 5), ("m2", "logical_flow", 1), ("m2", "other", 5)]
    df = spark.createDataFrame(rows, "model string, rubric string, score int")
    table = {r["rubric"]: r.asDict() for r in A.rubric_means(df).collect()}
    assert table["logical_flow"]["m-1"] == 3.0 and table["korean_quality"]["m2"] == 0.0
    overall = {r["model"]: (r["overall_mean"], r["n_scores"]) for r in A.overall_means(df).collect()}
    assert overall == {"m_1": (pytest.approx(8 / 6), 3), "m2": (pytest.approx(1 / 6), 1)}


def test_dataset_stats_and_top_sources(spark):
    df = spark.createDataFrame([("a", "k1"), ("a", "k2"), ("a", "k2"), ("b", "k1")], "rubric string, source_key string")
    got = {r["rubric"]: (r["n_pairs"], r["mean_per_rubric"]) for r in A.dataset_stats(df).collect()}
    assert got == {"a": (3, 3.0), "b": (1, 1.0), "total": (4, 2.0)}
    top = A.top_sources(A.pair_counts(df), 1)
    assert {(r["rubric"], r["source_key"], r["n_pairs"]) for r in top.collect()} == {("a", "k2", 2), ("b", "k1", 1)}
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_attempts(spark):
    rows = [(1, 1, "가" * 299), (1, 2, "가" * 300), (1, 3, "가" * 400), (2, 1, None), (2, 2, "가" * 501), (3, 11, "가" * 400)]
    df = spark.createDataFrame(rows, "item int, attempt int, text string")
    got = {r["item"]: r for r in W.first_valid_attempt(df, ["item"]).collect()}
    assert (got[1]["passage_length"], got[1]["retries_used"], got[1]["success"], got[1]["error"]) == (300, 1, True, None)
    assert (got[2]["success"], got[2]["retries_used"], got[2]["error"]) == (False, 2, "최대 재시도 횟수(10)를 초과했습니다.")
    assert set(got) == {1, 2}
    again = {r["item"]: r["generated_passage"] for r in W.regenerated(df, ["item"]).collect()}
    assert again == {1: "가" * 300, 2: "가" * 500}


def test_fill_nulls(spark):
    p = spark.createDataFrame([(1, "있음"), (2, None), (3, None)], "item int, generated_passage string")
    new = spark.createDataFrame([(1, "안 씀"), (2, "새 글")], "item int, generated_passage string")
    got = {r["item"]: r["generated_passage"] for r in W.fill_nulls(p, new, ["item"]).collect()}
    assert got == {1: "있음", 2: "새 글", 3: "생성 실패"}
    assert Counter(r["item"] for r in W.null_passages(p).collect()) == {2: 1, 3: 1}
