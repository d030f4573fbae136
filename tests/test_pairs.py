import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.functions import prompts as G
from pairloom.operators import pairs as J
from pairloom.operators import stats as A
from pairloom.values import RUBRICS

ITEM = (
    "struct<korean_topic:string,korean_context:string,foreign_topic:string,foreign_context:string,"
    "problem_types:array<string>,eval_goals:array<string>>"
)


def side(spark, rows):
    """(topic, foreign topic, text, position) as passages with guidelines."""
    data = [((k, "c", f, "d", ["t1", "t2"], ["g"]), text, 1, pos) for k, f, text, pos in rows]
    return spark.createDataFrame(data, f"source_item {ITEM}, generated_passage string, benchmark_id int, pos int")


def test_inter_model(spark):
    high = side(spark, [("봄", "x", "h0", 0), ("봄", "x", "h1", 1), ("봄", "x", "h2", 2), ("여름", "x", "h3", 3), ("", "x", "h4", 4), (None, "x", "h5", 5)])
    low = side(spark, [("봄", "y", "l1", 9), ("봄", "x", "l0", 8), ("겨울", "x", "l2", 1), (None, "x", "l3", 0)])
    rows = J.pairs_inter_model(high, low).collect()
    assert Counter(r["rubric"] for r in rows) == {r: 2 for r in RUBRICS}
    first = sorted((r["pair_id"], r["chosen"], r["rejected"], r["source_item"]["foreign_topic"]) for r in rows if r["rubric"] == "logical_flow")
    assert first == [("imp_logical_flow_봄_0001", "h0", "l0", "x"), ("imp_logical_flow_봄_0002", "h1", "l1", None)]
    assert all(r["source_item"]["problem_types"] == ["t1", "t2"] and r["dataset_type"] == "IMP" for r in rows)
    assert J.pairs_inter_model(high, low, cap=1).count() == 6
    assert J.pairs_inter_model(high, low, ["logical_flow"], cap=1, cap_scope="rubric").count() == 1
    with pytest.raises(ValueError):
        J.pairs_inter_model(high, low, ["nothing"])


def test_intra_model(spark):
    rows = [("봄", "x", f"t{i}", i) for i in range(3)]
    pairs = J.pairs_intra_model(side(spark, rows), side(spark, rows[:2]), "korean_quality", created_at="2025-08-01T00:00:00")
    got = pairs.collect()
    assert sorted(r["pair_id"] for r in got) == ["icp_korean_quality_봄_0001", "icp_korean_quality_봄_0002"]
    assert {r["created_at"].year for r in got} == {2025}
    with pytest.raises(ValueError):
        J.pairs_intra_model(side(spark, rows), side(spark, rows), "x")


def test_group_key_takes_first_usable(spark):
    df = spark.createDataFrame(
        [(("", "t", "i", 3),), (("", "", "i", 3),), (("", None, "", 3),), (("", None, None, 0),), (("0", None, None, 0),)],
        "source_item struct<korean_topic:string,topic:string,item_id:string,benchmark_id:int>",
    )
    assert [r[0] for r in df.select(G.group_key(df)).collect()] == ["t", "i", "3", None, "0"]


def test_source_key(spark):
    df = spark.createDataFrame([(("봄", None),), ((None, "x"),), (("봄", ""),)], "i struct<korean_topic:string,foreign_topic:string>")
    assert [r[0] for r in df.select(G.source_key(F.col("i"))).collect()] == ["봄||N/A", "N/A||x", "봄||"]


def score_rows(n=400, seed=3):
    rng = random.Random(seed)
    keys = ["hot"] * 3 + ["a", "b", "c"]
    return [
        (i, rubric, rng.choice(keys), rng.choice([1, 2, 3, 4, 5, None]))
        for i in range(n)
        for rubric in RUBRICS[:2]
    ]


@pytest.mark.parametrize("gap", [1, 2, 4])
@pytest.mark.parametrize("cell", [4000, 7, 1])
def test_score_gap_equals_brute_force(spark, gap, cell):
    rows = score_rows(60 if cell == 1 else 200)
    df = spark.createDataFrame(rows, "passage_id int, rubric string, source_key string, score int")
    want = Counter(
        (a[1], a[2], a[0], b[0], a[3] - b[3])
        for a, b in itertools.product(rows, rows)
        if a[1:3] == b[1:3] and a[3] is not None and b[3] is not None and a[3] - b[3] >= gap
    )
    pairs = J.pairs_by_score_gap(df, gap, cell_rows=cell)
    got = Counter((r["rubric"], r["source_key"], r["chosen_id"], r["rejected_id"], r["margin"]) for r in pairs.collect())
    assert got == want
    counts = J.score_gap_counts(df, gap)
    assert (counts.agg(F.sum("n_pairs")).first()[0] or 0) == sum(want.values())
    left = A.pair_stats(counts).exceptAll(A.pair_stats(A.pair_levels(pairs)))
    assert left.count() == 0


def test_score_gap_carries_columns_and_checks_gap(spark):
    df = spark.createDataFrame([(1, "logical_flow", "k", 5, "좋은"), (2, "logical_flow", "k", 2, "나쁜"), (3, "logical_flow", "k", 2, "나쁜")],
        "passage_id int, rubric string, source_key string, score int, text string")
    rows = J.pairs_by_score_gap(df, carry=["text"]).collect()
    assert [(r["chosen_text"], r["rejected_text"], r["margin"]) for r in rows] == [("좋은", "나쁜", 3)] * 2
    with pytest.raises(ValueError):
        J.pairs_by_score_gap(df, 0)
    with pytest.raises(TypeError):
        J.score_gap_counts(df.withColumn("score", F.lit(0.5)))


def test_score_gap_join_has_no_cross_product(spark):
    df = spark.createDataFrame(score_rows(), "passage_id int, rubric string, source_key string, score int")
    plan = J.pairs_by_score_gap(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_by_label(spark):
    rows = [
        ("고품질_01_봄_축제", "high", "h1", 0),
        ("고품질_02_명절", "high", "h2", 1),
        ("저품질_01_봄_축제", "low", "l1", 2),
        ("저품질_07_봄_축제", "low", "l2", 3),
        ("다른_01_명절", "low", "l3", 4),
        ("다른_01_봄_축제", "high", "h3", 5),
    ]
    df = spark.createDataFrame(rows, "name string, quality string, text string, pos int")
    got = J.pairs_by_label(df).collect()
    assert [(r["pair_id"], r["chosen"], r["rejected"]) for r in got] == [("preference_pair_봄_축제", "h1", "l1")]
    assert got[0]["metadata"]["rejected_name"] == "저품질_01_봄_축제"
    assert [tuple(r) for r in J.unmatched_by_label(df).collect()] == [("고품질_02_명절", "명절")]


def filter_data(spark):
    rng = random.Random(5)
    passages = [((f"k{i % 3}", "c", "f", "d", None, None), f"text{i}", i) for i in range(60)]
    results = [(i, r, rng.choice(["pass", "pass", "fail", "uncertain", "error"])) for i in range(60) for r in RUBRICS]
    return (
        spark.createDataFrame(results, "passage_id int, rubric string, result string"),
        spark.createDataFrame(passages, f"source_item {ITEM}, generated_passage string, passage_id int"),
        results,
    )


def test_by_filter(spark):
    evals, passages, results = filter_data(spark)
    by = {(i, r): v for i, r, v in results}
    for target in (None, 5):
        rows = J.pairs_by_filter(evals, passages, target).collect()
        for rubric in RUBRICS:
            mine = [r for r in rows if r["rubric"] == rubric]
            p = sum(v == "pass" for (i, q), v in by.items() if q == rubric)
            f = sum(v == "fail" for (i, q), v in by.items() if q == rubric)
            assert len(mine) == min(p, f, target or p)
            chosen = [int(r["chosen"][4:]) for r in mine]
            rejected = [int(r["rejected"][4:]) for r in mine]
            assert len(set(chosen)) == len(chosen) and len(set(rejected)) == len(rejected)
            assert all(by[i, rubric] == "pass" for i in chosen) and all(by[i, rubric] == "fail" for i in rejected)
            assert sorted(r["pair_id"][-4:] for r in mine) == [f"{n + 1:04d}" for n in range(len(mine))]
    again = J.pairs_by_filter(evals, passages, 5).collect()
    assert sorted(again) == sorted(rows)
    assert sorted(J.pairs_by_filter(evals, passages, 5, seed=1).collect()) != sorted(rows)


def test_by_filter_all_six_and_same_source(spark):
    evals, passages, results = filter_data(spark)
    by = {}
    for i, r, v in results:
        by.setdefault(i, []).append(v)
    good = {i for i, v in by.items() if set(v) == {"pass"}}
    bad = {i for i, v in by.items() if "fail" in v or "uncertain" in v}
    rows = J.verdicts(evals, "all_six").collect()
    assert {r["passage_id"] for r in rows if r["passed"]} == good
    assert {r["passage_id"] for r in rows if not r["passed"]} == bad - good
    same = J.pairs_by_filter(evals, passages, same_source=True).collect()
    assert same and all(int(r["chosen"][4:]) % 3 == int(r["rejected"][4:]) % 3 for r in same)
    with pytest.raises(ValueError):
        J.verdicts(evals, "other")


def test_by_template(spark):
    def listed(rows, more=""):
        item = "struct<korean_topic:string,korean_context:string,foreign_topic:string,foreign_context:string>"
        return spark.createDataFrame(rows, f"benchmark_id int, pos int, source_item {item}, generated_passage string{more}")

    a, b = ("봄", "k", "x", None), ("여름", "k", "x", "w")
    guide = (["t1", "t2"], ["g1"])
    chosen = listed([(10, 0, a, "c0", *guide), (2, 0, a, "c1", *guide), (2, 1, b, "c2", *guide), (2, 2, a, "c3", *guide)], ", problem_types array<string>, eval_goals array<string>")
    rejected = listed([(2, 0, a, "r1"), (2, 1, a, "r2"), (2, 2, a, None), (10, 0, a, "r0")])
    rows = J.pairs_by_template(chosen, rejected, "m", "v1.0.0").orderBy("reply_id").collect()
    assert [(r["data_id"], r["reply_id"], r["chosen"], r["rejected"]) for r in rows] == [
        ("benchmark_2.item_0", 1, "c1", "r1"), ("benchmark_2.item_2", 2, "c3", None), ("benchmark_10.item_0", 3, "c0", "r0"),
    ]
    assert "**문제 유형:** t1, t2\n" in rows[0]["prompt"] and "- 외국어 맥락: \n" in rows[0]["prompt"]
    assert rows[0]["metadata"]["rejected_template"] == "passage_agent.create_passage_with_korean_errors"


def test_stems_and_grid(spark):
    df = spark.createDataFrame([(1, "p", ["a", "b", "c"], ["x", "y", "z"])], "passage_id int, source_passage string, problem_types array<string>, eval_goals array<string>")
    tasks = J.stem_tasks(df)
    assert [(r["j"], r["problem_type"], r["eval_goal"]) for r in tasks.orderBy("j").collect()] == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]
    stems = tasks.withColumn("stem", F.when(F.col("j") == 1, "질문").when(F.col("j") == 2, ""))
    row = J.stems_wide(stems, ["passage_id", "source_passage"]).first()
    assert (row["stem_1"], row["stem_2"], row["stem_3"], row["problem_type_2"]) == ("질문", "문항 생성 실패", "문항 생성 실패", "b")
    assert J.generation_grid(df.select("passage_id"), ["m1", "m2"], ["t1", "t2", "t3"]).distinct().count() == 6


def test_common_keys(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("x",), ("z",), (None,)], "k string")
    assert [r["k"] for r in J.common_keys(a, b, "k").collect()] == ["x"]


def test_large_items_pair_alike(spark):
    """Pairs do not depend on how an item's passages are numbered."""
    rows = [("hot" if i % 3 else f"k{i % 5}", "x", f"t{i}", i) for i in range(300)]
    high, low = (side(spark, rows).withColumn("passage_id", F.col("pos")) for _ in range(2))
    pairs = [sorted(J.pairs_inter_model(high, low, RUBRICS[:1], spread=s).collect()) for s in (False, True)]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 300


def test_texts_do_not_move_through_numbering(spark):
    """No window or single task meets a text."""
    rows = [("a", "x", f"t{i}", i) for i in range(9)]
    high, low = (side(spark, rows).withColumn("passage_id", F.col("pos")) for _ in range(2))
    plan = J.pairs_inter_model(high, low)._jdf.queryExecution().optimizedPlan().toString()
    for k, line in enumerate(plan.split("\n")):
        if "Window" in line:
            assert "generated_passage" not in plan.split("\n")[k + 1] and "_text" not in plan.split("\n")[k + 1]
