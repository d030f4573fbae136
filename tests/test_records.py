import pytest
from pyspark.sql import functions as F

from pairloom import values as V
from pairloom.functions import prompts as G
from pairloom.operators import records as R
from pairloom.schemas import RECORD
from pairloom.values import RUBRICS

ITEM = (
    "struct<korean_topic:string,korean_context:string,foreign_topic:string,foreign_context:string,"
    "problem_types:array<string>,eval_goals:array<string>>"
)


def test_strict_prompt(spark):
    df = spark.createDataFrame([("{b}", "x", 3)], "a string, b string, n int")
    assert G.render_prompt(df, "{{가}} {a}-{b}-{n}").first()["prompt"] == "{가} {b}-x-3"
    with pytest.raises(KeyError):
        G.render_prompt(df, "{missing}")
    raw = spark.createDataFrame([("{1}", 7)], "problem_json string, id int")
    assert G.render_prompt(raw, '{"a": {problem_json}} {b}', only="problem_json").first()["prompt"] == '{"a": {1}} {b}'


def test_loose_prompt(spark):
    df = spark.createDataFrame([(("봄", None, "$1 \\1", "d", ["t1"], None),)], f"source_item {ITEM}")
    made = G.render_prompt(df, "{korean_topic}|{korean_context}|{foreign_topic}|{problem_type1}|{problem_type2}|{eval_goal1}|{nope}|{ x }", strict=False)
    assert made.first()["prompt"] == "봄||$1 \\1|t1||||{ x }"


def test_chat_text(spark):
    row = spark.range(1).select(G.chat_text(F.lit("질문"), F.lit("답")).alias("t")).first()
    assert row["t"] == "<|start_header_id|>user<|end_header_id|>\n\n질문<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n답<|eot_id|>"


def pairs(spark, n):
    rows = [(f"p{i:03d}", RUBRICS[i % 2], ("봄", None, "x", None, ["t"], ["g"]), f"c{i}", f"r{i}") for i in range(n)]
    return spark.createDataFrame(rows, f"pair_id string, rubric string, source_item {ITEM}, chosen string, rejected string")


def test_records_drop_rubrics_without_template(spark):
    rows = R.to_rm_record(pairs(spark, 4), {RUBRICS[0]: "{korean_topic}", RUBRICS[1]: ""}).collect()
    assert [r["pair_id"] for r in rows] == ["p000", "p002"]
    assert rows[0]["conversations"][0].asDict() == {"from": "human", "value": "봄"}
    assert rows[0]["chosen"].asDict() == {"from": "gpt", "value": "c0"}


def test_margin_records(spark):
    df = spark.createDataFrame([("봄||x", "logical_flow", 5, 2, 3, "좋은", "나쁜", ("봄", None, "x", None, None, None))],
        f"source_key string, rubric string, high_score int, low_score int, margin int, chosen_text string, rejected_text string, chosen_item {ITEM}")
    r = R.to_rm_record_with_margin(df).first()
    assert V.RUBRIC_DESCRIPTIONS["logical_flow"] in r["conversations"][0]["value"]
    assert r["conversations"][0]["value"].startswith("두 개의 한국어 독해 지문 A와 B가 주어집니다.\n두 지문은")
    assert (r["metadata"]["margin"], r["metadata"]["korean_context"], r["metadata"]["foreign_topic"]) == (3, "N/A", "x")
    assert r["metadata"]["guidelines"]["problem_types"] == V.DEFAULT_PROBLEM_TYPES


def test_flatten(spark):
    def record(p, c, r):
        return ([{"from": "human", "value": p}] if p is not None else [], {"from": "gpt", "value": c}, {"from": "gpt", "value": r})

    rows = [record(" 질문\n", " 답　", "x"), record(None, "a", "b"), record("q", "", "b"), record("q", " \n", "b"), record("q", "a", None)]
    got = [tuple(r) for r in R.flatten_rm_record(spark.createDataFrame(rows, RECORD)).collect()]
    assert got == [("질문", "답", "x"), ("q", "", "b")]


def test_validation(spark):
    rows = [("a", 1, ["c"], "m", "p", "c", "r"), (None, 1, ["c"], "m", " ", "c", "r"), ("b", 2, ["c"], "m", "\n", "　", "r")]
    df = spark.createDataFrame(rows, "data_id string, reply_id int, reply_type array<string>, model_name string, prompt string, chosen string, rejected string")
    bad = R.validate_pairs(df)
    assert [r["issues"] for r in bad.collect()] == [["missing data_id"], ["blank prompt", "blank chosen"]]
    assert {r["issue"]: r["n"] for r in R.issue_counts(bad).collect()} == {"missing data_id": 1, "blank prompt": 1, "blank chosen": 1}
    assert R.validate_pairs(df.drop("model_name")).count() == 3


def test_complete(spark):
    df = spark.createDataFrame([("a", "b"), ("", "b"), (None, "b"), ("a", "")], "chosen string, rejected string")
    assert R.complete_pairs(df).count() == 1


@pytest.mark.parametrize("n,held", [(49, 0), (50, 50), (51, 50)])
def test_split(spark, n, held):
    rows = R.train_eval_split(pairs(spark, n), "pair_id").collect()
    assert len(rows) == n and len({r["pair_id"] for r in rows}) == n
    assert sum(r["split"] == "eval" for r in rows) == held


def test_split_is_seeded(spark):
    def held(seed):
        rows = R.train_eval_split(pairs(spark, 200), "pair_id", 20, seed)
        return {r["pair_id"] for r in rows.where("split = 'eval'").collect()}

    assert held(1) == held(1) != held(2)


def test_merge(spark):
    a, b = pairs(spark, 4).select("pair_id", "rubric"), pairs(spark, 2).select("rubric", "pair_id")
    merged = R.merge_pairs(a, b)
    assert merged.count() == 6
    assert {r["rubric"]: r["n_pairs"] for r in R.merge_counts(merged).collect()} == {RUBRICS[0]: 3, RUBRICS[1]: 3}
