import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.operators import stats as A

SAMPLES = [
    "",
    " ",
    "안녕하세요. 반갑습니다! 또 만나요?",
    "One. Two... three!?  four",
    "줄\n바꿈\t그리고 공백　끝 ",
    "a.b!c",
    "...",
    "\x1c가\x1f나\x85다",
    "no terminator at all",
    "\u00a0끝 없는\u00a0공백\u2003",
]


def py_sentences(t):
    return [s.strip() for s in re.split(r"[.!?]+[\s]*", t) if s.strip()]


@pytest.mark.parametrize("t", SAMPLES)
def test_counts_follow_python(one, t):
    sentences = py_sentences(t)
    assert one(T.split_sentences, t) == sentences
    assert one(T.n_words, t) == len(t.split())
    assert one(T.words, t) == t.split()
    assert one(T.n_sentences, t) == len(sentences)
    mean = np.mean([len(s.split()) for s in sentences]) if sentences else 0
    assert one(T.mean_sentence_words, t) == pytest.approx(mean)
    assert one(T.strip, t) == t.strip()
    assert one(T.normalize_ws, t) == re.sub(r"\s+", " ", t).strip()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="가나ab .!?\n　\x1d()[]", max_size=40), min_size=30, max_size=60))
def test_counts_on_generated_texts(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", T.split_sentences("t").alias("s"), T.n_words("t").alias("w"), T.n_sentences("t").alias("n")).collect()
    for r in rows:
        assert r["s"] == py_sentences(texts[r["i"]])
        assert r["w"] == len(texts[r["i"]].split())
        assert r["n"] == len(r["s"])


def test_clean_brackets(one):
    t = "가(나)다[라]마{바}사【아】자『차』카「타」파〈하〉a《b》c  (x(y)z) (열림"
    assert one(T.clean_brackets, t) == "가다마사자카파ac z) (열림"
    assert one(T.clean_brackets, "") == ""
    assert one(T.clean_brackets, None) is None


def test_remove_title(one):
    assert one(T.remove_title, "머리 [지문]: **제목: 봄**\n\n본문이다.\n둘째 줄. [지문]: 뒤") == "본문이다. 둘째 줄."
    assert one(T.remove_title, "제목: 봄\n본문") == "본문"
    assert one(T.remove_title, "# 봄\n# 여름\n본문\n\n끝") == "본문 끝"
    assert one(T.remove_title, "**굵게**\n본문") == "본문"
    assert one(T.remove_title, "Title: x\n본문") == "본문"
    assert one(T.remove_title, "제목: 줄바꿈 없음") == "제목: 줄바꿈 없음"


@pytest.mark.parametrize("n,gate", [(299, "too_short"), (300, "ok"), (500, "ok"), (501, "too_long")])
def test_length_gate(one, n, gate):
    assert one(T.length_gate, "가" * n) == gate


def test_length_gate_null(one):
    assert one(T.length_gate, None) == "missing"


@pytest.mark.parametrize(
    "t,want",
    [
        ("가" * 500, 500),
        ("가" * 399 + "." + "나" * 200, 400),
        ("가" * 399 + "." + "나" * 199 + ".", 500),
        ("가" * 600, 500),
        ("." + "가" * 600, 1),
        ("가" * 499 + "." + "나", 500),
        ("가" * 500 + ".", 500),
    ],
)
def test_truncate_at_period(one, t, want):
    last = t.rfind(".")
    expected = t if len(t) <= 500 else t[: last + 1] if last != -1 and last < 500 else t[:500]
    got = one(T.truncate_at_period, t)
    assert got == expected and len(got) == want


def test_similarity_and_grades(one, spark):
    assert one(T.edit_distance, "고양이", "고래") == 2
    assert one(T.normalized_similarity, "", "") == 1.0
    assert one(T.normalized_similarity, "abcd", "abce") == 0.75
    rows = spark.createDataFrame([(s,) for s in (1.0, 0.99, 0.98, 0.95, 0.9, 0.8, 0.79, 0.0)], "s double")
    assert [r[0] for r in rows.select(T.scale_1_5("s")).collect()] == [5, 5, 4, 4, 3, 2, 1, 1]


def test_preview_and_topic(one):
    assert one(lambda c: T.preview(c, 3), "가나다라") == "가나다..."
    assert one(lambda c: T.preview(c, 9, always=False), "가나다라") == "가나다라"
    assert one(T.topic_from_name, "고품질_01_봄_축제") == "봄_축제"
    assert one(T.topic_from_name, "저품질_02") == ""
    assert one(T.topic_from_name, "기타_02_주제") is None


def test_corpus_stats_and_ratio(spark):
    texts = ["하나 둘 셋. 넷!", "", "하나 하나"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = {r["metric"]: r for r in A.corpus_stats(df).collect()}
    chars = [len(t) for t in texts]
    assert rows["chars"]["mean"] == pytest.approx(np.mean(chars))
    assert rows["chars"]["std"] == pytest.approx(np.std(chars))
    assert (rows["words"]["min"], rows["words"]["max"], rows["words"]["n_passages"]) == (0, 4, 3)
    ttr = A.type_token_ratio(df).first()
    assert (ttr["tokens"], ttr["types"]) == (6, 4)
    empty = A.type_token_ratio(df.where("text = ''")).first()
    assert (empty["tokens"], empty["ttr"]) == (0, 0.0)
    by = A.type_token_ratio(df.withColumn("g", F.length("text") > 0), by=["g"])
    assert {r["g"]: r["ttr"] for r in by.collect()} == {True: pytest.approx(4 / 6), False: 0.0}


def test_estimated_ratio(spark):
    df = spark.range(3000).select(F.concat(F.lit("w"), F.col("id") % 1000, F.lit(" x")).alias("text"))
    r = A.type_token_ratio(df, rsd=0.02).first()
    assert r["tokens"] == 6000 and abs(r["types"] - 1001) < 80
    assert A.type_token_ratio(df).first()["types"] == 1001


def test_long_passages(spark):
    df = spark.createDataFrame([("a" * 500,), ("a  " * 200,)], "text string")
    rows = A.long_passages(df).collect()
    assert [(r["original_length"], r["cleaned_length"], r["reduction"]) for r in rows] == [(600, 399, 201)]
    s = A.long_passage_summary(A.long_passages(df)).first()
    assert (s["n_long"], s["original_length_max"], s["reduction_mean"]) == (1, 600, 201.0)
