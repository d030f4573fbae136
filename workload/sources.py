"""Readers and writers: every query writes derived files and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators import pairs as J
from pairloom.operators import records as R
from pairloom.operators.responses import evaluation_rows
from pairloom.schemas import BENCHMARK, CHAT_RESPONSE, PAIR, PASSAGE, RECORD
from pairloom.sources import files as S
from pairloom.sources import outputs as O
from pairloom.sources import requests as Q
from pairloom.storage import new_path
from pairloom.values import RUBRICS
from workload.registry import query
from workload.views import (
    GUIDELINES,
    IMP,
    PASSAGES,
    SCORES,
    TEMPLATE,
    TURNS,
    guidelines,
    imp_pairs,
    passages,
    table,
    template_of,
    turns,
    wide_scores,
)


def written_benchmarks(spark, sf) -> str:
    """A benchmark file: one array, one benchmark per region, a nation per item."""
    nations = table(spark, sf, "nation").select(
        (F.col("n_regionkey") + 1).alias("benchmark_id"),
        F.struct(
            F.col("n_name").alias("korean_topic"),
            F.lit("at home").alias("korean_context"),
            F.concat(F.lit("not "), "n_name").alias("foreign_topic"),
            F.lit("abroad").alias("foreign_context"),
        ).alias("item"),
    )
    items = nations.groupBy("benchmark_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = guidelines(spark, sf).join(items, "benchmark_id").withColumnRenamed("benchmark_id", "id")
    path = new_path(spark, "benchmarks")
    S.write_json_arrays(rows.select(*BENCHMARK.names).coalesce(1), path)
    return path


@query(
    "read_json_array",
    f"""WITH {PASSAGES}, {GUIDELINES}
SELECT g.benchmark_id, array_to_string(g.problem_types, ', ') AS problem_types, count(*) AS n_passages
FROM guidelines g JOIN passages p USING (benchmark_id) GROUP BY ALL""",
)
def read_json_array(spark, sf):
    b = S.read_json_array(spark, written_benchmarks(spark, sf), BENCHMARK)
    rows = passages(spark, sf).join(b.withColumnRenamed("id", "benchmark_id"), "benchmark_id")
    return rows.groupBy("benchmark_id", F.array_join("problem_types", ", ").alias("problem_types")).agg(
        F.count(F.lit(1)).alias("n_passages")
    )


@query(
    "benchmark_items",
    f"""WITH {PASSAGES}, items AS (
  SELECT n_regionkey + 1 AS benchmark_id, n_name,
         CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS INTEGER) AS pos FROM nation)
SELECT i.benchmark_id, i.pos, n_name AS korean_topic, count(*) AS n_passages
FROM items i JOIN passages p ON p.benchmark_id = i.benchmark_id AND p.number // 5 = i.pos GROUP BY ALL""",
)
def benchmark_items(spark, sf):
    b = S.read_json_array(spark, written_benchmarks(spark, sf), BENCHMARK)
    items = O.benchmark_items(b)
    rows = passages(spark, sf).select("benchmark_id", F.floor(F.col("number") / 5).cast("int").alias("pos"))
    return (
        rows.join(items, ["benchmark_id", "pos"])
        .groupBy("benchmark_id", "pos", F.col("item.korean_topic").alias("korean_topic"))
        .agg(F.count(F.lit(1)).alias("n_passages"))
    )


@query(
    "read_jsonl",
    f"WITH {PASSAGES} SELECT korean_topic, foreign_topic, md5(generated_passage) AS body FROM passages",
)
def read_jsonl(spark, sf):
    path = new_path(spark, "jsonl")
    S.write_jsonl(passages(spark, sf).select("source_item", "generated_passage"), path)
    rows = S.read_jsonl(spark, path, PASSAGE)
    return rows.select(
        "source_item.korean_topic", "source_item.foreign_topic", F.md5("generated_passage").alias("body")
    )


def written_evaluations(spark, sf) -> str:
    """An evaluation tree with one folder per evaluated model."""
    p = passages(spark, sf)
    w = wide_scores(spark, sf).select("passage_id", *[f"{r}_score" for r in RUBRICS])
    score = F.struct(
        *[F.col(f"{r}_score") for r in RUBRICS],
        F.map_from_arrays(
            F.array(*[F.lit(r) for r in RUBRICS]),
            F.array(*[(F.col(f"{r}_score") > 1).cast("string") for r in RUBRICS]),
        ).alias("scores"),
        F.lit(None).cast("string").alias("feedback"),
        F.lit("2025-08-05T00:00:00").alias("evaluation_timestamp"),
    )
    rows = p.join(w, "passage_id").select(
        F.concat("model", F.lit("_evaluation")).alias("folder"),
        "source_item",
        "generated_passage",
        score.alias("evaluation"),
    )
    path = new_path(spark, "evaluations")
    S.write_json_arrays(rows, path, ["folder"])
    return path


@query(
    "read_eval_tree",
    f"""WITH {SCORES}
SELECT model, count(*) AS n, sum(logical_flow_score)::BIGINT AS logical_flow FROM wide GROUP BY model""",
)
def read_eval_tree(spark, sf):
    rows = S.read_eval_tree(spark, written_evaluations(spark, sf), keep_unknown=False, pattern="*")
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("evaluation.logical_flow_score").alias("logical_flow")
    )


@query(
    "evaluation_rows",
    f"""WITH {SCORES}
SELECT model, rubric, count(*) AS n, sum(score)::BIGINT AS points, count(*) FILTER (score > 1) AS passed
FROM long GROUP BY ALL""",
)
def evaluation_rows_(spark, sf):
    evals = S.read_eval_tree(spark, written_evaluations(spark, sf), pattern="*")
    rows = evaluation_rows(evals, ["model"])
    return rows.groupBy("model", "rubric").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("points"), F.count_if("passed").alias("passed")
    )


def output_files(spark, sf):
    """A file path per document, as the output tree names them."""
    p = table(spark, sf, "documents").withColumn("template", template_of(F.col("doc_id")))
    number = F.substring("source", 4, 10).cast("int")
    path = O.output_path(F.lit("2025-08-05"), F.col("lang"), number, F.lit("v1.0.0"), F.col("template"))
    return p.select("doc_id", "lang", F.concat(F.lit("/out/"), path).alias("file_path"))


_FILES = f"""files AS (
  SELECT doc_id, lang, CAST(substr(source, 4) AS INTEGER) AS benchmark_id, 'v1.0.0' AS version,
         {TEMPLATE} AS template_key FROM documents)"""


@query("with_path_metadata", f"WITH {_FILES} SELECT doc_id, benchmark_id, version, template_key FROM files")
def with_path_metadata(spark, sf):
    rows = O.with_path_metadata(output_files(spark, sf))
    return rows.select("doc_id", "benchmark_id", "version", "template_key")


@query(
    "infer_output_type",
    f"""WITH {_FILES}
SELECT doc_id, CASE WHEN contains(template_key, 'options') OR contains(template_key, 'eval') THEN NULL
  WHEN contains(template_key, 'stem') THEN 'stem' WHEN contains(template_key, 'passage') THEN 'passage' END AS kind
FROM files""",
)
def infer_output_type(spark, sf):
    rows = O.with_path_metadata(output_files(spark, sf))
    return rows.select("doc_id", O.infer_output_type(F.col("template_key")).alias("kind"))


@query(
    "highest_benchmark",
    f"""WITH {_FILES}
SELECT lang, max(benchmark_id) AS benchmark_id FROM files
WHERE contains(template_key, 'passage') AND NOT contains(template_key, 'eval') GROUP BY lang""",
)
def highest_benchmark(spark, sf):
    rows = O.with_path_metadata(output_files(spark, sf))
    return O.highest_benchmark(rows, "passage", ["lang"]).select("lang", "benchmark_id")


@query(
    "latest_only",
    f"""WITH {_FILES}
SELECT benchmark_id, template_key, max(doc_id) AS doc_id FROM files GROUP BY ALL""",
)
def latest_only(spark, sf):
    rows = O.with_path_metadata(output_files(spark, sf))
    best = O.latest_only(rows, ["benchmark_id", "template_key"], [F.col("doc_id")])
    return best.select("benchmark_id", "template_key", "doc_id")


@query(
    "latest_checkpoint",
    "SELECT source, max(doc_id) AS step FROM documents GROUP BY source",
)
def latest_checkpoint(spark, sf):
    path = F.concat(F.lit("/saves/"), "source", F.lit("/checkpoint-"), "doc_id")
    rows = table(spark, sf, "documents").select("source", path.alias("path"))
    best = O.latest_only(rows, ["source"], [O.checkpoint_number(F.col("path"))])
    return best.select("source", O.checkpoint_number(F.col("path")).alias("step"))


_OUTPUT = T.StructType(
    [*PASSAGE.fields]
    + [T.StructField("benchmark_id", T.IntegerType()), T.StructField("version", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in O.PARTITIONS]
)


def written_outputs(spark, sf) -> str:
    """All passages in the output tree, by date, type, model and template."""
    root = new_path(spark, "outputs")
    rows = passages(spark, sf).select(
        F.lit("2025-08-05").alias("date"),
        "model",
        template_of(F.col("passage_id")).alias("template"),
        "source_item",
        "generated_passage",
        "benchmark_id",
        F.lit("v1.0.0").alias("version"),
    )
    for _ in range(2):  # a rerun changes nothing
        O.write_outputs(rows.repartition("model", "template"), root)
    return root


_OUT = f"""out AS (
  SELECT *, CASE WHEN contains(template, 'passage') THEN 'passage' WHEN contains(template, 'stem') THEN 'stem'
                 WHEN contains(template, 'option') THEN 'option' ELSE 'misc' END AS output_type
  FROM (SELECT *, {TEMPLATE.replace('doc_id', 'passage_id')} AS template FROM passages))"""


@query(
    "write_outputs",
    f"""WITH {PASSAGES}, {_OUT}
SELECT '2025-08-05' AS date, output_type, model, template, count(*) AS n, sum(length(generated_passage))::BIGINT AS chars
FROM out GROUP BY ALL""",
)
def write_outputs(spark, sf):
    rows = O.read_outputs(spark, written_outputs(spark, sf), _OUTPUT)
    return rows.groupBy(*O.PARTITIONS).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("generated_passage")).alias("chars")
    )


@query(
    "load_outputs",
    f"""WITH {PASSAGES}, {_OUT}
SELECT model, benchmark_id, md5(generated_passage) AS body FROM out
WHERE output_type = 'passage' AND template = 'passage_agent.create_passage'""",
)
def load_outputs(spark, sf):
    rows = O.read_outputs(spark, written_outputs(spark, sf), _OUTPUT)
    found = O.load_outputs(
        rows, template="passage_agent.create_passage", version="v1.0.0", output_type="passage", date="2025-08-05"
    )
    return found.select("model", "benchmark_id", F.md5("generated_passage").alias("body"))


@query(
    "list_outputs",
    f"WITH {PASSAGES}, {_OUT} SELECT DISTINCT model, template FROM out",
)
def list_outputs(spark, sf):
    files = O.list_outputs(spark, written_outputs(spark, sf))
    return O.count_outputs(files).where(F.col("n_bytes") > 0).select("model", "template")


@query(
    "write_pairs",
    f"""WITH {IMP}
SELECT rubric, count(*) AS n, sum(length(chosen) + length(rejected))::BIGINT AS chars FROM imp GROUP BY rubric""",
)
def write_pairs(spark, sf):
    root = new_path(spark, "pairs")
    S.write_pairs(imp_pairs(spark, sf), root)
    rows = S.read_pairs(spark, root, PAIR, dataset_type="IMP")
    return rows.groupBy("rubric").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("chosen") + F.length("rejected")).alias("chars")
    )


@query(
    "write_jsonl",
    f"WITH {TURNS} SELECT turn_id, md5(prompt) AS prompt, md5(response) AS response FROM turns",
)
def write_jsonl(spark, sf):
    path = new_path(spark, "turns")
    rows = turns(spark, sf).select("turn_id", "prompt", "response")
    S.write_jsonl(rows, path)
    back = S.read_jsonl(spark, path, rows.schema)
    return back.select("turn_id", F.md5("prompt").alias("prompt"), F.md5("response").alias("response"))


@query(
    "flatten_entries",
    """
SELECT doc_id, source AS chosen, md5(text) AS rejected FROM documents
UNION ALL SELECT doc_id, lang, md5(text) FROM documents WHERE doc_id % 3 > 0
UNION ALL SELECT doc_id, 'third', md5(text) FROM documents WHERE doc_id % 3 = 2""",
)
def flatten_entries(spark, sf):
    d = table(spark, sf, "documents")

    def entry(chosen):
        return F.struct(chosen.alias("chosen"), F.col("text").alias("rejected"))

    first, second, third = entry(F.col("source")), entry(F.col("lang")), entry(F.lit("third"))
    raw = (
        F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array(first)))
        .when(
            F.col("doc_id") % 3 == 1,
            F.to_json(F.struct(first.alias("a"), F.lit("no row").alias("b"), second.alias("c"))),
        )
        .otherwise(F.to_json(F.struct(F.array(first, second).alias("a"), F.array(third).alias("b"))))
    )
    schema = T.StructType([T.StructField("chosen", T.StringType()), T.StructField("rejected", T.StringType())])
    rows = S.flatten_entries(d.select("doc_id", raw.alias("raw")), "raw", schema)
    return rows.select("doc_id", "entry.chosen", F.md5("entry.rejected").alias("rejected"))


_NAMES = "([" + ", ".join(f"'{r}'" for r in [*RUBRICS, "unknown_rubric"]) + "])[CAST(doc_id % 7 + 1 AS INTEGER)]"


@query(
    "select_rubric_files",
    f"""
SELECT rubric, min('/pairs/IMP_' || rubric || '_20250802_' || lpad(doc_id::VARCHAR, 12, '0') || '.json') AS file_path
FROM (SELECT doc_id, {_NAMES} AS rubric FROM documents) WHERE rubric <> 'unknown_rubric' GROUP BY rubric""",
)
def select_rubric_files(spark, sf):
    names = F.array(*[F.lit(r) for r in [*RUBRICS, "unknown_rubric"]])
    rubric = F.element_at(names, (F.col("doc_id") % 7 + 1).cast("int"))
    number = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    path = F.concat(F.lit("/pairs/IMP_"), rubric, F.lit("_20250802_"), number, F.lit(".json"))
    files = table(spark, sf, "documents").select(path.alias("file_path"))
    return O.select_rubric_files(files, "IMP")


@query(
    "build_requests",
    f"""WITH {TURNS}
SELECT 'request_' || turn_id AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url, 'judge' AS model,
       'user' AS role, md5(prompt) AS content, 256 AS max_tokens FROM turns""",
)
def build_requests(spark, sf):
    r = Q.build_requests(turns(spark, sf), "judge", key="turn_id", temperature=0.0, max_tokens=256)
    path = new_path(spark, "requests")
    Q.request_lines(r).select("line").write.text(path)
    back = spark.read.schema(r.schema).json(path)
    first = F.get("body.messages", F.lit(0))
    return back.select(
        "custom_id",
        "method",
        "url",
        "body.model",
        first["role"].alias("role"),
        F.md5(first["content"]).alias("content"),
        "body.max_tokens",
    )


def response_files(spark, sf, rows, key, text="response") -> str:
    """Answers as batch result files, one JSON line each."""
    choice = F.struct(F.struct(F.col(text).alias("content")).alias("message"))
    body = F.struct(F.array(choice).alias("choices"))
    path = new_path(spark, "responses")
    custom_id = F.concat(F.lit("request_"), F.col(key).cast("string"))
    S.write_jsonl(rows.select(custom_id.alias("custom_id"), F.struct(body.alias("body")).alias("response")), path)
    return path


# Every user turn is a request; those no assistant turn follows stay unanswered.
@query(
    "join_responses",
    f"""WITH {TURNS}
SELECT 'request_' || u.conv_id || '_' || u.turn AS custom_id,
       md5(coalesce(t.response, '오류: no response')) AS response
FROM conversations u LEFT JOIN turns t ON t.conv_id = u.conv_id AND t.turn = u.turn WHERE u.role = 'user'""",
)
def join_responses(spark, sf):
    user = table(spark, sf, "conversations").where(F.col("role") == "user")
    prompts = user.select(F.concat_ws("_", "conv_id", "turn").alias("turn_id"), F.col("text").alias("prompt"))
    requests = Q.build_requests(prompts, "judge", key="turn_id")
    responses = S.read_jsonl(spark, response_files(spark, sf, turns(spark, sf), "turn_id"), CHAT_RESPONSE)
    return Q.join_responses(requests, responses).select("custom_id", F.md5("response").alias("response"))


@query(
    "load_passages",
    f"""WITH {PASSAGES}, {_OUT}, f AS (
  SELECT * FROM out WHERE model = 'src3' AND contains(template, 'passage') AND NOT contains(template, 'eval')),
best AS (SELECT benchmark_id, template FROM f ORDER BY benchmark_id DESC, template DESC LIMIT 1)
SELECT benchmark_id, template, md5(generated_passage) AS body FROM f JOIN best USING (benchmark_id, template)""",
)
def load_passages(spark, sf):
    rows = O.read_outputs(spark, written_outputs(spark, sf), _OUTPUT)
    return O.load_passages(rows, "src3").select("benchmark_id", "template", F.md5("generated_passage").alias("body"))


@query(
    "load_stems",
    f"""WITH {PASSAGES}, {_OUT}
SELECT benchmark_id, md5(generated_passage) AS body FROM out
WHERE model = 'src6' AND template = 'stem_agent.few_shot' AND output_type = 'stem'""",
)
def load_stems(spark, sf):
    rows = O.read_outputs(spark, written_outputs(spark, sf), _OUTPUT)
    found = O.load_stems(rows, "src6", date="2025-08-05")
    return found.select("benchmark_id", F.md5("generated_passage").alias("body"))


@query(
    "load_options",
    f"""WITH {PASSAGES}, {_OUT}
SELECT benchmark_id, md5(generated_passage) AS body FROM out
WHERE model = 'src7' AND template = 'options_agent.create_option'""",
)
def load_options(spark, sf):
    rows = O.read_outputs(spark, written_outputs(spark, sf), _OUTPUT)
    found = O.load_options(rows, "src7", template="options_agent.create_option")
    return found.select("benchmark_id", F.md5("generated_passage").alias("body"))


@query(
    "guidelines",
    f"""WITH {PASSAGES}, {GUIDELINES}
SELECT passage_id, array_to_string(eval_goals, ', ') AS eval_goals FROM passages JOIN guidelines USING (benchmark_id)""",
)
def guidelines_(spark, sf):
    b = S.read_json_array(spark, written_benchmarks(spark, sf), BENCHMARK)
    rows = passages(spark, sf).select("passage_id", "benchmark_id").join(O.guidelines(b), "benchmark_id")
    return rows.select("passage_id", F.array_join("eval_goals", ", ").alias("eval_goals"))


@query(
    "read_merged",
    f"""WITH {IMP}
SELECT model_pair, rubric, count(*) AS n, sum(length(chosen))::BIGINT AS chars
FROM imp, (SELECT unnest(['strong-weak', 'strong-weak-2']) AS model_pair) GROUP BY ALL""",
)
def read_merged(spark, sf):
    """Records of two model pairs, written as array files and merged."""
    records = R.to_rm_record(imp_pairs(spark, sf), {r: "{korean_topic}" for r in RUBRICS}, ["rubric"])
    both = J.generation_grid(records, ["strong-weak", "strong-weak-2"], ["-"]).drop("template")
    path = new_path(spark, "merged")
    S.write_json_arrays(both.withColumnRenamed("model", "model_pair"), path, ["model_pair", "rubric"])
    rows = S.read_merged(spark, path, RECORD, pattern="*")
    return rows.groupBy("model_pair", "rubric").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("chosen.value")).alias("chars")
    )


@query(
    "list_files",
    f"""WITH {PASSAGES}, {_OUT}
SELECT DISTINCT 'date=2025-08-05/output_type=' || output_type || '/model=' || model || '/template=' || template
       || '/benchmark_id=' || benchmark_id || '/version=v1.0.0' AS folder FROM out""",
)
def list_files(spark, sf):
    files = O.list_files(spark, written_outputs(spark, sf))
    return files.select(F.regexp_replace("file_path", "/[^/]*$", "").alias("folder")).distinct()
