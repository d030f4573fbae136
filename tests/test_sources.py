import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.responses import evaluation_rows, parse_binary_rubric, parse_pass_fail
from pairloom.plans import datasets as D
from pairloom.plans import evaluation as E
from pairloom.schemas import BENCHMARK, CHAT_RESPONSE, PAIR, QUALITY_SAMPLE, RANKED, RECORD
from pairloom.sources import files as S
from pairloom.sources import outputs as O
from pairloom.sources import requests as Q
from pairloom.streaming.responses import one_answer, stream_responses, write_responses
from pairloom.values import RUBRICS


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = data if isinstance(data, str) else json.dumps(data, ensure_ascii=False)
    path.write_text(text, encoding="utf-8")


def test_json_array(spark, tmp_path):
    row = {"name": "고품질_01_봄", "quality": "high", "text": "글"}
    put(tmp_path / "a.json", [row, {"name": "b"}])
    put(tmp_path / "b.json", row)
    put(tmp_path / "c.json", '[{"name": "broken"')
    df = S.read_json_array(spark, str(tmp_path), QUALITY_SAMPLE)
    assert df.count() == 3
    rows = df.collect()
    assert sorted(r["name"] for r in rows) == ["b", "고품질_01_봄", "고품질_01_봄"]


def test_jsonl(spark, tmp_path):
    put(tmp_path / "a.jsonl", '{"name": "a"}\n\n{"name": "b", "text": "글"}\n{broken\n')
    assert S.read_jsonl(spark, str(tmp_path), QUALITY_SAMPLE).count() == 2
    assert sorted(r["name"] for r in S.read_jsonl(spark, str(tmp_path), QUALITY_SAMPLE).collect()) == ["a", "b"]


def test_odd_fields_keep_their_records(spark, tmp_path):
    """The rows are the same whatever columns are read; a field of another type is null."""
    good = {"passage": "글", "r1_score": 4.5, "rm_ranking": 1}
    odd = [{**good, "rm_ranking": "2"}, {**good, "r1_score": "x"}, {**good, "rm_ranking": 3.0}, {**good, "rm_ranking": [1]}, {"other": 1}]
    lines = [json.dumps(x, ensure_ascii=False) for x in [good, *odd]]
    put(tmp_path / "l" / "a.jsonl", "\n".join([*lines, "{broken", "[1, 2]", ""]))
    put(tmp_path / "a" / "a.json", [good, *odd])
    put(tmp_path / "a" / "b.json", "[{broken")
    for rows in (S.read_jsonl(spark, str(tmp_path / "l"), RANKED), S.read_json_array(spark, str(tmp_path / "a"), RANKED)):
        assert rows.count() == rows.select("passage").count() == len(rows.collect()) == 6
        assert len(rows.select("rm_ranking").collect()) == 6
        got = [(r["passage"], r["r1_score"], r["rm_ranking"]) for r in rows.collect()]
        want = [("글", 4.5, 1), ("글", 4.5, 2), ("글", None, 1), ("글", 4.5, 3), (None, None, None)]
        assert all(x in got for x in want)
    rows = S.read_jsonl(spark, str(tmp_path / "l"), RANKED, corrupt="bad")
    assert sorted(r["bad"] for r in rows.where("bad IS NOT NULL").select("bad").collect())[-1] == "{broken"
    counts = S.broken_records(rows, "bad").first()
    assert counts["n_records"] == 8 and counts["n_broken"] >= 2
    evals = [evaluation("봄", 5), evaluation("봄", 2)]
    evals[0]["evaluation"][f"{RUBRICS[0]}_score"] = 4.0
    evals[1]["evaluation"][f"{RUBRICS[0]}_score"] = "5"
    put(tmp_path / "e" / "m_evaluation" / "x_eval_rubric.json", evals)
    rows = S.read_eval_tree(spark, str(tmp_path / "e"))
    assert sorted(r["evaluation"][f"{RUBRICS[0]}_score"] for r in rows.collect()) == [4, 5]
    assert rows.count() == rows.select("generated_passage").count() == 2


def evaluation(topic, score):
    return {
        "source_item": {"korean_topic": topic, "foreign_topic": "x"},
        "generated_passage": f"{topic} {score}",
        "evaluation": {f"{r}_score": score for r in RUBRICS},
    }


def eval_tree(tmp_path):
    base = tmp_path / "2025-08-05" / "misc"
    put(base / "m1_evaluation" / "eval_rubric" / "benchmark_1_v1.0.0_eval_rubric.json", [evaluation("봄", 5), evaluation("봄", 2)])
    put(base / "m1_evaluation" / "eval_rubric" / "benchmark_2_v1.0.0_eval_rubric.json", [evaluation("봄", 4), {"generated_passage": "no source"}])
    put(base / "m_2_evaluation" / "x" / "benchmark_1_eval_rubric.json", evaluation("봄", 2))
    put(base / "m1_evaluation" / "x" / "other.json", [evaluation("봄", 1)])
    put(base / "stray" / "eval_rubric.json", [evaluation("여름", 3)])
    put(base / "m1_evaluation" / "x" / "bad_eval_rubric.json", "[{")
    return str(tmp_path)


def test_eval_tree(spark, tmp_path):
    root = eval_tree(tmp_path)
    rows = S.read_eval_tree(spark, root).collect()
    assert sorted((r["model"], r["generated_passage"]) for r in rows) == [
        ("m1", "no source"), ("m1", "봄 2"), ("m1", "봄 4"), ("m1", "봄 5"), ("m_2", "봄 2"), ("unknown", "여름 3"),
    ]
    assert S.read_eval_tree(spark, root, keep_unknown=False).count() == 5


def test_scored_and_binary_evaluations(spark, tmp_path):
    binary = {"source_item": {"korean_topic": "봄"}, "generated_passage": "x", "evaluation": {"scores": {"logical_flow": True, "korean_quality": False}, "feedback": "f"}}
    put(tmp_path / "m_evaluation" / "a_eval_rubric.json", [evaluation("봄", 4)])
    put(tmp_path / "m_evaluation" / "b_eval_rubric_binary.json", [binary, {"generated_passage": "none"}])
    rows = evaluation_rows(S.read_eval_tree(spark, str(tmp_path)), ["generated_passage"]).collect()
    got = {(r["generated_passage"], r["rubric"]): (r["score"], r["passed"]) for r in rows}
    assert len(got) == 8 and got["봄 4", "korean_quality"] == (4, None)
    assert (got["x", "logical_flow"], got["x", "korean_quality"]) == ((None, True), (None, False))


def test_score_gap_job(spark, tmp_path):
    stats = D.build_score_gap(spark, eval_tree(tmp_path / "in"), str(tmp_path / "out"))
    got = {(r["rubric"], r["value"]): r["n_pairs"] for r in stats.where("kind = 'margin'").collect()}
    # 봄 has scores 5, 2, 4, 2: margins 5-4, 4-2 twice, 5-2 twice.
    assert got == {(r, m): n for r in RUBRICS for m, n in ((1, 1), (2, 2), (3, 2))}
    rows = spark.read.json(str(tmp_path / "out"))
    assert rows.count() == 30 and rows.where("metadata.high_score <= metadata.low_score").count() == 0
    assert set(rows.columns) == {"conversations", "chosen", "rejected", "metadata", "rubric"}
    one = D.build_score_gap(spark, str(tmp_path / "in"), str(tmp_path / "one"), min_gap=3, rubrics=["logical_flow"])
    assert [(r["rubric"], r["n_pairs"]) for r in one.where("kind = 'margin'").collect()] == [("logical_flow", 2)]
    assert spark.read.json(str(tmp_path / "one")).count() == 2


def test_path_metadata(spark):
    names = ["/a/benchmark_10_v1.0.0_passage_agent.create.json", "/a/benchmark_2_v1.0.0_stem_x.json", "/a/note.json", "/a/benchmark_x_v_t.json"]
    df = spark.createDataFrame([(n,) for n in names], "file_path string")
    rows = O.with_path_metadata(df).orderBy("benchmark_id").collect()
    assert [(r["benchmark_id"], r["version"], r["template_key"]) for r in rows] == [(2, "v1.0.0", "stem_x"), (10, "v1.0.0", "passage_agent.create")]


def test_kinds(spark):
    names = ["passage_agent.x", "stem_passage", "stem_options", "options", "passage_eval", "misc"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    rows = df.select(O.output_type(F.col("t")).alias("o"), O.infer_output_type(F.col("t")).alias("i")).collect()
    assert [r["o"] for r in rows] == ["passage", "passage", "stem", "option", "passage", "misc"]
    assert [r["i"] for r in rows] == ["passage", "stem", None, None, None, None]


def test_rubric_files(spark):
    names = ["IMP_logical_flow_20250802_1.json", "IMP_logical_flow_20250801_1.json", "IMP_x_20250802.json", "ICP_korean_quality_20250802.json", "IMP_korean_quality.json"]
    df = spark.createDataFrame([("/p/" + n,) for n in names], "file_path string")
    assert [tuple(r) for r in O.select_rubric_files(df, "IMP").collect()] == [("logical_flow", "/p/IMP_logical_flow_20250801_1.json")]


def test_outputs_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("2025-08-05", "m1", "passage_agent.a", "글1", 1), ("2025-08-06", "m1", "stem.a", "글2", 10), ("2025-08-06", "m2", "misc", "글3", 2)],
        "date string, model string, template string, generated_passage string, benchmark_id int",
    )
    O.write_outputs(df, str(tmp_path / "o"))
    schema = "generated_passage string, benchmark_id int, date string, output_type string, model string, template string"
    back = O.read_outputs(spark, str(tmp_path / "o"), schema)
    assert {r["output_type"] for r in back.collect()} == {"passage", "stem", "misc"}
    found = O.load_outputs(back, model="m1", date="2025-08-06")
    assert [r["generated_passage"] for r in found.collect()] == ["글2"]
    assert "PartitionFilters: [isnotnull" in found._jdf.queryExecution().toString()
    files = O.list_outputs(spark, str(tmp_path / "o"))
    assert {(r["model"], r["template"]) for r in files.collect()} == {("m1", "passage_agent.a"), ("m1", "stem.a"), ("m2", "misc")}
    best = O.latest_only(back, ["model"], [F.col("benchmark_id")])
    assert {r["model"]: r["benchmark_id"] for r in best.collect()} == {"m1": 10, "m2": 2}


def test_benchmark_items(spark, tmp_path):
    data = [{"id": 7, "problem_types": ["a"], "eval_goals": ["g"], "items": [{"korean_topic": "봄"}, {"korean_topic": "여름"}]}, {"id": 1, "items": []}]
    put(tmp_path / "b.json", data)
    b = S.read_json_array(spark, str(tmp_path), BENCHMARK)
    assert [(r["benchmark_id"], r["pos"], r["item"]["korean_topic"]) for r in O.benchmark_items(b).collect()] == [(7, 0, "봄"), (7, 1, "여름")]
    assert O.benchmark_items(b, 5).count() == 0


def test_arrays_round_trip(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").cast("string").alias("name"), (F.col("id") % 3).cast("string").alias("g"))
    S.write_json_arrays(rows, str(tmp_path / "a"))
    back = S.read_json_array(spark, str(tmp_path / "a"), T.StructType([T.StructField("name", T.StringType())]))
    assert {r["name"] for r in back.collect()} == {str(i) for i in range(100)}
    S.write_json_arrays(rows.coalesce(1), str(tmp_path / "b"), ["g"], rows_per_file=4)
    assert len(list((tmp_path / "b" / "g=1").glob("part-*"))) > 3
    back = S.read_json_array(spark, str(tmp_path / "b"), T.StructType([T.StructField("name", T.StringType())]))
    assert back.where(F.contains("file_path", F.lit("g=1"))).count() == 33 and back.count() == 100


def answered(text):
    return {"response": {"status_code": 200, "body": {"choices": [{"message": {"content": text}}]}}}


def test_causes_of_failures(spark, tmp_path):
    lines = [
        {"custom_id": "request_1", **answered("fine")},
        {"custom_id": "request_2", "error": {"code": "e7", "message": "too long"}},
        {"custom_id": "request_3", "error": {"code": "e8"}},
        {"custom_id": "request_4", "response": {"status_code": 429}},
    ]
    put(tmp_path / "r.jsonl", "\n".join(map(json.dumps, lines)))
    requests = spark.createDataFrame([(f"request_{i}",) for i in range(1, 6)], "custom_id string")
    found = Q.join_responses(requests, S.read_jsonl(spark, str(tmp_path), CHAT_RESPONSE)).collect()
    assert {r["custom_id"]: r["response"] for r in found} == {
        "request_1": "fine", "request_2": "오류: too long", "request_3": "오류: e8", "request_4": "오류: status 429", "request_5": "오류: no response",
    }


def test_stream_and_batch_take_the_same_answer(spark, tmp_path):
    for name, text in (("a", "점수: 2"), ("b", "점수: 4"), ("c", "점수: 4")):
        put(tmp_path / "in" / f"{name}.json", json.dumps({"custom_id": "request_1", **answered(text)}, ensure_ascii=False))
    stream = stream_responses(spark, str(tmp_path / "in"), files_per_batch=1)
    write_responses(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    rows = one_answer(spark.read.parquet(str(tmp_path / "out"))).collect()
    requests = spark.createDataFrame([("request_1",)], "custom_id string")
    want = Q.join_responses(requests, spark.read.schema(CHAT_RESPONSE).json(str(tmp_path / "in"))).first()["response"]
    assert [r["response"] for r in rows] == [want] == ["점수: 4"]


def test_flatten_entries(spark):
    raws = ['[{"chosen": "a"}, {"chosen": "b"}]', '{"x": {"chosen": "c"}, "y": [{"chosen": "d"}], "z": 3}', "[]", "3"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    rows = S.flatten_entries(df, "raw", T.StructType([T.StructField("chosen", T.StringType())])).collect()
    assert sorted((r["i"], r["entry"]["chosen"]) for r in rows) == [(0, "a"), (0, "b"), (1, "c"), (1, "d")]


def test_merged_tree(spark, tmp_path):
    def record(c):
        return {"conversations": [{"from": "human", "value": "q"}], "chosen": {"from": "gpt", "value": c}, "rejected": {"from": "gpt", "value": "r"}}

    put(tmp_path / "p1" / "logical_flow" / "rm_pairwise.json", [record("a"), record("a")])
    put(tmp_path / "p2" / "logical_flow" / "rm_pairwise.json", [record("b")])
    put(tmp_path / "p2" / "logical_flow" / "else.json", [record("c")])
    rows = S.read_merged(spark, str(tmp_path), RECORD).collect()
    assert sorted((r["model_pair"], r["rubric"], r["chosen"]["value"]) for r in rows) == [
        ("p1", "logical_flow", "a"), ("p1", "logical_flow", "a"), ("p2", "logical_flow", "b"),
    ]


def answer(i, text):
    return json.dumps({"custom_id": f"request_{i}", "response": {"body": {"choices": [{"message": {"content": text}}]}}}, ensure_ascii=False)


def test_requests_and_responses(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"질문{i}") for i in range(4)], "request_key int, prompt string")
    requests = Q.build_requests(prompts, "m", temperature=0.5)
    line = json.loads(Q.request_lines(requests).orderBy("custom_id").first()["line"])
    assert line == {
        "custom_id": "request_0", "method": "POST", "url": "/v1/chat/completions",
        "body": {"model": "m", "messages": [{"role": "user", "content": "질문0"}], "temperature": 0.5, "max_tokens": None},
    }
    talk = spark.createDataFrame([(7, [("system", "s"), ("user", "u")])], "request_key int, messages array<struct<role:string,content:string>>")
    body = json.loads(Q.request_lines(Q.build_requests(talk, "m", top_p=0.9, max_tokens=5)).first()["line"])["body"]
    assert [m["role"] for m in body["messages"]] == ["system", "user"] and (body["top_p"], body["max_tokens"]) == (0.9, 5)
    put(tmp_path / "r.jsonl", "\n".join([answer(2, "둘"), answer(0, "영"), answer(2, "둘"), answer(9, "모름"), '{"custom_id": "request_1"}']))
    responses = S.read_jsonl(spark, str(tmp_path), CHAT_RESPONSE)
    got = {r["custom_id"]: r["response"] for r in Q.join_responses(requests, responses).collect()}
    assert got == {"request_0": "영", "request_1": "오류: no response", "request_2": "둘", "request_3": "오류: no response"}


def test_stream_goes_on_without_repeating(spark, tmp_path):
    put(tmp_path / "in" / "a.json", "\n".join([answer(1, "4점"), answer(1, "4점"), answer(2, "없음")]))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run(**more):
        write_responses(stream_responses(spark, str(tmp_path / "in"), **more), out, check).awaitTermination()
        rows = one_answer(spark.read.parquet(out)).collect()
        return sorted((r["custom_id"], r["score"], r["parse_status"]) for r in rows)

    first = [("request_1", 4, "parsed"), ("request_2", 3, "default")]
    assert run() == first
    put(tmp_path / "in" / "b.json", "\n".join([answer(2, "5점"), answer(3, "1점")]))
    assert run() == first + [("request_3", 1, "parsed")]


def test_stream_with_bounded_state(spark, tmp_path):
    put(tmp_path / "in" / "a.json", "\n".join([answer(1, "4점"), answer(1, "4점")]))
    parsed = stream_responses(spark, str(tmp_path / "in"), within="2 days")
    write_responses(parsed, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_stream_with_other_parsers(spark, tmp_path):
    verdicts = json.dumps({r: True for r in RUBRICS})
    put(tmp_path / "in" / "a.json", "\n".join([answer(1, verdicts), answer(2, "PASS")]))
    for parse in (parse_binary_rubric, parse_pass_fail):
        out = str(tmp_path / parse.__name__)
        parsed = stream_responses(spark, str(tmp_path / "in"), parse=parse)
        write_responses(parsed, out, out + "-check").awaitTermination()
    binary = {r["custom_id"]: r["logical_flow"] for r in spark.read.parquet(str(tmp_path / "parse_binary_rubric")).collect()}
    assert binary == {"request_1": True, "request_2": False}
    result = {r["custom_id"]: r["result"] for r in spark.read.parquet(str(tmp_path / "parse_pass_fail")).collect()}
    assert result == {"request_1": "uncertain", "request_2": "pass"}


def test_convert_job(spark, tmp_path):
    item = {"korean_topic": "봄", "problem_types": ["t"], "eval_goals": ["g"]}
    rows = [{"pair_id": f"p{i}", "rubric": "logical_flow", "source_item": item, "chosen": f" c{i}", "rejected": "r", "dataset_type": "IMP"} for i in range(60)]
    raw = spark.createDataFrame([(json.dumps({"logical_flow": rows[:30], "x": rows[30:]}),)], "raw string")
    train, held = str(tmp_path / "train"), str(tmp_path / "eval")
    counts = D.convert_pairs(raw, {"logical_flow": "{korean_topic} {problem_type1}"}, train, held, raw="raw")
    assert {r["split"]: r["n"] for r in counts.collect()} == {"train": 10, "eval": 50}
    rows = spark.read.json(train).collect()
    assert {(r["prompt"], r["rejected"]) for r in rows} == {("봄 t", "r")} and all(r["chosen"].startswith("c") for r in rows)


def test_convert_job_takes_the_rubric_of_the_file(spark, tmp_path):
    rows = [("p", "logical_flow", {"korean_topic": "봄"}, "c", "r", "IMP", None)]
    paths = [str(tmp_path / name) for name in ("train", "eval")]
    D.convert_pairs(spark.createDataFrame(rows, PAIR), {"korean_quality": "Q"}, *paths, rubric="korean_quality")
    assert [r["prompt"] for r in spark.read.json(paths[0]).collect()] == ["Q"]


def test_convert_job_with_repeated_pairs(spark, tmp_path):
    item = {"korean_topic": "봄"}
    rows = [("same" if i < 90 else f"p{i}", "logical_flow", item, f"c{i % 2}", "r", "IMP", None) for i in range(120)]
    pairs = spark.createDataFrame(rows, PAIR).repartition(6)
    train, held = str(tmp_path / "train"), str(tmp_path / "eval")
    counts = D.convert_pairs(pairs, {"logical_flow": "{korean_topic}"}, train, held)
    assert {r["split"]: r["n"] for r in counts.collect()} == {"train": 70, "eval": 50}
    assert (spark.read.json(train).count(), spark.read.json(held).count()) == (70, 50)


def test_preference_ranking_job(spark):
    rows = [(f"고품질_{i:02d}_주제{i}", "high", "글" * (i + 2), i) for i in range(4)] + [(f"저품질_{i:02d}_주제{i}", "low", "글", 10 + i) for i in range(4)]
    samples = spark.createDataFrame(rows, "name string, quality string, text string, pos int")
    shown = E.judge_prompts(samples)
    answers = shown.where("topic <> '주제0'").select("pair_id", F.col("correct_choice").alias("response"))
    r = E.preference_ranking(samples, answers, lambda: lambda s: s.str.len()).first()
    assert (r["total_comparisons"], r["agreements"], r["reward_model_accuracy"], r["judge_accuracy"]) == (4, 3, 1.0, 0.75)


def test_samples_of_one_topic(spark):
    """They share a pair id: each keeps its own answer, the last by name is compared."""
    rows = [("고품질_01_봄", "high", "글글글", 0), ("고품질_02_봄", "high", "글", 1), ("저품질_01_봄", "low", "글글", 2)]
    samples = spark.createDataFrame(rows, "name string, quality string, text string, pos int")
    shown = E.judge_prompts(samples).select("pair_id", "metadata.chosen_name", F.col("correct_choice").alias("response"))
    r = E.preference_ranking(samples, shown, lambda: lambda s: s.str.len()).first()
    assert (r["total_comparisons"], r["agreements"], r["reward_model_accuracy"], r["judge_accuracy"]) == (1, 0, 0.5, 1.0)
    one = E.preference_details(samples, shown, lambda: lambda s: s.str.len()).collect()
    assert [(x["topic"], x["rm_prefers_chosen"], x["judge_prefers_chosen"], x["score_difference"], x["choice"] in "AB") for x in one] == [("봄", False, True, -1.0, True)]


def test_rewritten_outputs(spark, tmp_path):
    schema = "date string, model string, template string, benchmark_id int, version string, generated_passage string"
    df = spark.createDataFrame([("d", "m", "passage_a", 1, "v1", "x"), ("d", "m", "passage_a", 2, "v1", "y")], schema)
    for _ in range(2):
        O.write_outputs(df, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 2
    O.write_outputs(df.where("benchmark_id = 2").withColumn("generated_passage", F.lit("z")), str(tmp_path / "o"))
    assert sorted(r[0] for r in spark.read.json(str(tmp_path / "o")).select("generated_passage").collect()) == ["x", "z"]


def test_rank_job(spark, tmp_path):
    df = spark.createDataFrame([("a", "가"), ("b", "가나다"), ("c", "가나")], "id string, passage string")
    scorers = {"r1_score": lambda: lambda s: s.str.len(), "r2_score": lambda: lambda s: -s.str.len() * 0.5}
    E.rank_candidates(df, scorers, str(tmp_path / "r"), "id")
    rows = spark.read.json(str(tmp_path / "r")).orderBy("rm_ranking").collect()
    assert [r["id"] for r in rows] == ["b", "c", "a"] and rows[0]["r2_score"] == -1.5
    assert set(rows[0].asDict()) == {"id", "passage", "r1_score", "r2_score", "rm_ranking"}


def test_pairs_round_trip(spark, tmp_path):
    rows = [("p1", "logical_flow", None, "c", "r", "SPF", None), ("p2", "korean_quality", None, "c", "r", "SPF", None)]
    S.write_pairs(spark.createDataFrame(rows, PAIR), str(tmp_path / "p"))
    assert S.read_pairs(spark, str(tmp_path / "p"), PAIR).count() == 2
    more = [("p3", "logical_flow", None, "c", "r", "IMP", None), ("p4", "korean_quality", None, "c", "r", "SPF", None)]
    S.write_pairs(spark.createDataFrame(more, PAIR), str(tmp_path / "p"))
    assert sorted(r["pair_id"] for r in S.read_pairs(spark, str(tmp_path / "p"), PAIR).collect()) == ["p1", "p3", "p4"]
    S.write_pairs(spark.createDataFrame(more, PAIR), str(tmp_path / "q"), "parquet")
    assert S.read_pairs(spark, str(tmp_path / "q"), PAIR, rubric="logical_flow", format="parquet").count() == 1
    one = S.read_pairs(spark, str(tmp_path / "p"), PAIR, "SPF", "logical_flow").collect()
    assert [r["pair_id"] for r in one] == ["p1"]


def test_loaders_pick_one_file(spark):
    rows = [
        ("m", "2025-08-05", "passage", "passage_agent.a", 2, "v1.0.0", "p2"),
        ("m", "2025-08-05", "passage", "passage_agent.a", 10, "v1.0.0", "p10"),
        ("m", "2025-08-05", "passage", "passage_stem", 11, "v1.0.0", "s11"),
        ("m", "2025-08-05", "passage", "passage_eval", 12, "v1.0.0", "e12"),
        ("m", "2025-08-06", "passage", "passage_options", 3, "v1.0.0", "o3"),
        ("n", "2025-08-05", "passage", "passage_agent.a", 20, "v1.0.0", "n20"),
        ("m", "2025-08-05", "passage", "passage_agent.a", 30, "v2.0.0", "v30"),
    ]
    df = spark.createDataFrame(rows, "model string, date string, output_type string, template string, benchmark_id int, version string, t string")

    def texts(found):
        return [r["t"] for r in found.collect()]

    assert texts(O.load_passages(df, "m")) == ["p10"]
    assert texts(O.load_passages(df, "m", template="passage_agent.a")) == ["p2"]
    assert texts(O.load_passages(df, "m", 2)) == ["p2"]
    assert texts(O.load_passages(df, "m", version="v2.0.0", date="2025-08-05")) == ["v30"]
    assert texts(O.load_passages(df, "x")) == []
    assert texts(O.load_stems(df, "m")) == ["s11"]
    assert texts(O.load_options(df, "m")) == ["o3"]


def test_benchmark_lookups(spark, tmp_path):
    put(tmp_path / "v1" / "b.json", [{"id": 2, "problem_types": ["a"], "eval_goals": ["g"], "items": []}, {"id": 1, "items": []}])
    b = S.read_json_array(spark, str(tmp_path), BENCHMARK)
    assert [r["problem_types"] for r in O.benchmark_by_id(b, 2).collect()] == [["a"]]
    assert O.benchmark_by_id(b, 9).count() == 0
    assert {r["benchmark_id"]: r["eval_goals"] for r in O.guidelines(b).collect()} == {2: ["g"], 1: None}
    assert [r["file_path"] for r in O.list_files(spark, str(tmp_path)).collect()] == ["v1/b.json"]
