import json

import pytest
from pyspark.sql import functions as F

from pairloom import values as V
from pairloom.functions import parse as P
from pairloom.operators import responses as X
from pairloom.values import RUBRICS


def parsed(spark, job, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    return [r[column] for r in job(df).orderBy("i").collect()]


def test_scores(spark):
    cases = {
        "4점 (자연스러움)": 4,
        "평가: 3점": 3,
        "결과: 2": 2,
        "5 (매우 적합)": 5,
        "좋다 1": 1,
        "좋다 1\n": 1,
        "45점 그래서 결과: 4": 4,
        "9점 (넘침) 그리고 7점 끝": None,
        "3 그리고 나머지\n둘째": 3,
        "숫자 없음": None,
        "99999999999999999999점 그리고 : 2": 2,
        "４점": 4,
        "0점": None,
        "3점 그리고 4점 (이유)": 4,
    }
    assert parsed(spark, lambda d: d.withColumn("s", P.score_1_5(F.col("response"))), list(cases), "s") == list(cases.values())
    assert parsed(spark, lambda d: X.parse_scores(d, last=True), ["1점 다음 2점\n4"], "score") == [2]
    rows = X.parse_scores(spark.createDataFrame([("없음",), (None,), ("2점",)], "response string"))
    assert [(r["score"], r["parse_status"]) for r in rows.collect()] == [(3, "default"), (3, "default"), (2, "parsed")]


def binary(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    return X.parse_binary_rubric(df).orderBy("i").collect()


def test_binary(spark):
    flat = dict.fromkeys(RUBRICS, True)
    alias = {V.RUBRIC_ALIASES[r]: "TRUE" for r in RUBRICS}
    mixed = {**flat, V.RUBRIC_ALIASES["logical_flow"]: False, "korean_quality": 1, "l2_learner_suitability": None}
    texts = [
        "앞 " + json.dumps({"scores": flat, "feedback": "좋다"}, ensure_ascii=False) + " 뒤",
        json.dumps(alias),
        json.dumps(mixed),
        json.dumps({r: True for r in RUBRICS[:5]}),
        json.dumps({**flat, "scores": {"logical_flow": False}}),
        json.dumps({**flat, "scores": 3}),
        "{" + '"a": 1,, }',
        json.dumps(flat) + " 그리고 {",
        json.dumps(flat) + " } 더",
        json.dumps(flat) + ", {}",
        "없음",
        None,
        "{'logical_flow': true}",
    ]
    rows = binary(spark, texts)
    verdicts = [[r[x] for x in RUBRICS] for r in rows]
    assert verdicts[0] == [True] * 6 and rows[0]["feedback"] == "좋다"
    assert verdicts[1] == [True] * 6 and rows[1]["feedback"] == ""
    assert verdicts[2] == [True, True, True, False, False, False]
    assert verdicts[4] == verdicts[5] == verdicts[7] == [True] * 6
    for i in (3, 6, 8, 9, 10, 11, 12):
        assert verdicts[i] == [False] * 6
    status = [r["parse_status"] for r in rows]
    assert status == [
        "nested", "flat", "flat", "incomplete", "flat", "flat", "bad_json", "flat", "bad_json", "bad_json", "no_json", "no_json", "bad_json",
    ]
    assert rows[3]["feedback"] == V.BINARY_NOT_PARSED and rows[6]["feedback"] == V.BINARY_BAD_JSON


def test_binary_needs_guidelines(spark):
    df = spark.createDataFrame([(json.dumps(dict.fromkeys(RUBRICS, True)), 2)], "response string, n int")
    row = X.parse_binary_rubric(df, F.col("n")).first()
    assert not row["logical_flow"] and row["feedback"] == V.BINARY_NO_METADATA


def test_correction(spark):
    rows = spark.createDataFrame(
        [
            ("가나다라마바사아자차", "**교정된 문장:**\n가나다라마바사아자카 (고침)\n**이유:** x"),
            ("같은 글", "**교정된 문장:** 같은 글"),
            ("글", "오류 없음"),
            ("글", "2점"),
            ("글", None),
        ],
        "passage string, response string",
    )
    code = [(r["score"], r["parse_status"]) for r in X.parse_correction(rows).collect()]
    assert code == [(3, "correction"), (5, "default"), (5, "default"), (5, "default"), (5, "default")]
    auto = [(r["score"], r["parse_status"]) for r in X.parse_correction(rows, source="auto").collect()]
    assert auto[3] == (2, "score")
    with pytest.raises(ValueError):
        X.parse_correction(rows, source="other")


def test_pass_fail(spark):
    texts = ["PASS: 좋다", " fail…", "\n패스", None, "Passable"]
    rows = X.parse_pass_fail(spark.createDataFrame([(t,) for t in texts], "response string")).collect()
    assert [(r["result"], r["score"]) for r in rows] == [
        ("pass", 1.0), ("fail", 0.0), ("uncertain", 0.5), ("error", 0.0), ("pass", 1.0),
    ]
    assert rows[1]["reason"] == "fail…"


def test_ab_choice(spark):
    texts = ["A", " B가 낫다", "Answer: B", "둘째\n선택: B", "선택:A", "선택: B 아니 선택: A", "없음", "", None]
    assert parsed(spark, X.parse_ab_choice, texts, "choice") == ["A", "B", "A", "B", "A", "A", None, None, None]


def test_topic_pair(spark):
    cases = {
        '답: ["김치", " 사우어크라우트 "]': ("김치", "사우어크라우트"),
        "[김치, '빵']": ("김치", "빵"),
        '["하나"]': None,
        "김치: 설명, 빵: 설명": ("김치", "빵"),
        "없음": None,
        '["가", "나", "다"], x': ("가", "나"),
        "['가', '나']": ("가", "나"),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, response string")
    rows = X.parse_topic_pair(df).orderBy("i").collect()
    for r, want in zip(rows, cases.values()):
        assert (r["korean_topic"], r["foreign_topic"]) == (want or (None, None))


def test_explanation(spark):
    rows = [("평가 4점: 좋다 4점", 4), ("4점", 4), ("없음 ", 4), (" 점수 없음", None), ("3점 ::  이유", 3)]
    df = spark.createDataFrame(rows, "response string, score int")
    got = [r["explanation"] for r in X.extract_explanation(df).collect()]
    assert got == ["좋다 4점", "", "없음", "점수 없음", "이유"]


def test_context_block(spark):
    pages = spark.createDataFrame(
        [("가", i, f"제목{i}", "요" * 600 if i == 0 else ("" if i == 1 else f"요약{i}")) for i in range(7)]
        + [("나", 1, "링크", "요약")],
        "topic string, pos int, title string, summary string",
    )
    topics = spark.createDataFrame([("가",), ("나",), ("다",)], "topic string")
    got = {r["topic"]: r["context"] for r in X.context_block(pages, topics).collect()}
    parts = [f"문서 제목: 제목0\n내용: {'요' * 500}..."] + [f"문서 제목: 제목{i}\n내용: 요약{i}..." for i in (2, 3, 4)]
    assert got == {"가": "\n\n---\n\n".join(parts), "나": "", "다": ""}


def test_evaluation_long_and_summary(spark):
    scores = {f"{r}_score": 3 for r in RUBRICS}
    base = {**scores, "logical_flow_score": None, **dict.fromkeys(RUBRICS, True)}
    rows = spark.createDataFrame([{"id": 1, "template": "x_binary", **base}, {"id": 2, "template": "x", **base}],
        "id int, template string, " + ", ".join(f"{r}_score int, {r} boolean" for r in RUBRICS))
    long = X.evaluation_long(rows, ["id"]).collect()
    assert len([r for r in long if r["id"] == 1]) == 6 and all(r["score"] is None for r in long if r["id"] == 1)
    assert len([r for r in long if r["id"] == 2]) == 5
    s = X.evaluation_summary(rows, ["id"]).first()
    assert (s["total"], s["logical_flow_score"], s["korean_quality_score"]) == (15.0, "N/A", "3")
    assert (s["evaluation_timestamp"], s["template_used"]) == ("N/A", "N/A")
