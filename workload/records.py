"""Prompts, records, checks, merging and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import values as V
from pairloom.functions import prompts as G
from pairloom.operators import pairs as J
from pairloom.operators import records as R
from pairloom.values import RUBRICS
from workload.registry import query
from workload.views import (
    GUIDELINES,
    IMP,
    PASSAGES,
    SCORES,
    TURNS,
    guidelines,
    imp_pairs,
    long_scores,
    passages,
    table,
    turns,
)

# One template per rubric but the last, which therefore has no records.
TEMPLATES = {
    r: f"[{r}] {{korean_topic}} / {{foreign_topic}} / {{problem_type1}} / {{eval_goal3}} / {{unknown}}."
    for r in RUBRICS[:5]
}


@query(
    "render_prompt",
    "SELECT doc_id, md5('Judge {strictly} ' || lang || ': ' || text || ' -- ' || source) AS prompt FROM documents",
)
def render_prompt(spark, sf):
    rows = G.render_prompt(table(spark, sf, "documents"), "Judge {{strictly}} {lang}: {text} -- {source}")
    return rows.select("doc_id", F.md5("prompt").alias("prompt"))


@query(
    "render_prompt_loose",
    f"""WITH {PASSAGES}, {GUIDELINES}
SELECT passage_id, korean_topic || ' vs ' || foreign_topic || ': ' || problem_types[1] || '; ' || eval_goals[3] || ';; end' AS prompt
FROM passages JOIN guidelines USING (benchmark_id)""",
)
def render_prompt_loose(spark, sf):
    rows = J.with_guideline(passages(spark, sf), guidelines(spark, sf))
    template = "{korean_topic} vs {foreign_topic}: {problem_type1}; {eval_goal3};{problem_type9}{nothing}; end"
    return G.render_prompt(rows, template, strict=False).select("passage_id", "prompt")


@query(
    "source_prompt",
    f"""WITH {PASSAGES}, {GUIDELINES}
SELECT passage_id, md5('다음 조건에 맞는 한국어 독해 지문을 생성해주세요.

**주제 정보:**
- 한국어 주제: ' || korean_topic || '
- 외국어 주제: ' || foreign_topic || '

**배경 맥락:**
- 한국어 맥락: ' || korean_context || '
- 외국어 맥락: ' || foreign_context || '

**문제 유형:** ' || array_to_string(problem_types, ', ') || '

**평가 목표:** ' || array_to_string(eval_goals, ', ') || '

위 조건들을 모두 반영하여 적절한 한국어 독해 지문을 작성해주세요. 지문은 주어진 주제와 맥락을 포함하고, 지정된 문제 유형과 평가 목표에 적합해야 합니다.') AS prompt
FROM passages JOIN guidelines USING (benchmark_id)""",
)
def source_prompt(spark, sf):
    rows = J.with_guideline(passages(spark, sf), guidelines(spark, sf))
    item = F.col("source_item")
    made = G.source_prompt(item, item["problem_types"], item["eval_goals"])
    return rows.select("passage_id", F.md5(made).alias("prompt"))


@query(
    "chat_text",
    rf"""WITH {TURNS}
SELECT turn_id, md5('<|start_header_id|>user<|end_header_id|>' || E'\n\n' || prompt || '<|eot_id|>'
  || '<|start_header_id|>assistant<|end_header_id|>' || E'\n\n' || response || '<|eot_id|>') AS chat FROM turns""",
)
def chat_text(spark, sf):
    rows = turns(spark, sf)
    return rows.select("turn_id", F.md5(G.chat_text(F.col("prompt"), F.col("response"))).alias("chat"))


_RECORDS = f"""{IMP}, records AS (
  SELECT pair_id, rubric, '[' || rubric || '] ' || korean_topic || ' / ' || coalesce(foreign_topic, '') || ' / '
         || problem_types[1] || ' / ' || eval_goals[3] || ' / .' AS prompt, chosen, rejected
  FROM imp WHERE rubric <> '{RUBRICS[5]}')"""


@query(
    "to_rm_record",
    f"""WITH {_RECORDS}
SELECT pair_id, rubric, 'human' AS asker, prompt, 'gpt' AS writer, md5(chosen) AS chosen, md5(rejected) AS rejected
FROM records""",
)
def to_rm_record(spark, sf):
    rows = R.to_rm_record(imp_pairs(spark, sf), TEMPLATES)
    first = F.get("conversations", F.lit(0))
    return rows.select(
        "pair_id",
        "rubric",
        first["from"].alias("asker"),
        first["value"].alias("prompt"),
        F.col("chosen.from").alias("writer"),
        F.md5("chosen.value").alias("chosen"),
        F.md5("rejected.value").alias("rejected"),
    )


def _margin_case() -> str:
    cases = []
    for r in RUBRICS:
        text = V.MARGIN_PROMPT.format(
            problem_types=V.DEFAULT_PROBLEM_TYPES,
            eval_goals=V.DEFAULT_EVAL_GOALS,
            description=V.RUBRIC_DESCRIPTIONS[r],
            name=V.RUBRIC_NAMES[r],
        )
        cases.append(f"WHEN '{r}' THEN '{text}'")
    return "CASE a.rubric " + " ".join(cases) + " END"


@query(
    "to_rm_record_with_margin",
    f"""WITH {SCORES}
SELECT md5({_margin_case()}) AS prompt, md5(p.generated_passage) AS chosen, md5(q.generated_passage) AS rejected,
       a.source_key, a.rubric, a.score AS high_score, b.score AS low_score, a.score - b.score AS margin,
       p.korean_topic, p.foreign_context
FROM long a JOIN long b ON a.rubric = b.rubric AND a.source_key = b.source_key AND a.score - b.score >= 3
JOIN passages p ON p.passage_id = a.passage_id JOIN passages q ON q.passage_id = b.passage_id""",
)
def to_rm_record_with_margin(spark, sf):
    """Each passage is digested once, before it is paired: pairs grow with the square of a source."""
    texts = passages(spark, sf).select(
        "passage_id", F.md5(R.turn_text("generated_passage")).alias("text"), F.col("source_item").alias("item")
    )
    pairs = J.pairs_by_score_gap(long_scores(spark, sf).join(texts, "passage_id"), min_gap=3, carry=["text", "item"])
    return R.to_rm_record_with_margin(pairs, of=F.md5).select(
        F.get("conversations", F.lit(0))["value"].alias("prompt"),
        F.col("chosen.value").alias("chosen"),
        F.col("rejected.value").alias("rejected"),
        *[
            f"metadata.{n}"
            for n in ("source_key", "rubric", "high_score", "low_score", "margin", "korean_topic", "foreign_context")
        ],
    )


# Turns as records; some lose a text or keep white space only.
def turn_records(spark, sf):
    def turn(who, text):
        return F.struct(F.lit(who).alias("from"), text.alias("value"))

    kind = F.length("response") % 5
    chosen = F.when(kind == 0, "").when(kind == 1, " \n ").otherwise(F.concat(F.lit("\n "), "response", F.lit(" ")))
    return turns(spark, sf).select(
        "turn_id",
        F.array(turn("human", F.col("prompt"))).alias("conversations"),
        turn("gpt", chosen).alias("chosen"),
        turn("gpt", F.concat("prompt", F.lit(" / "), "response")).alias("rejected"),
    )


_FLAT = rf"""{TURNS}, flat AS (
  SELECT turn_id, trim(prompt, E' \t\n\r') AS prompt,
         CASE WHEN length(response) % 5 = 1 THEN '' ELSE trim(response, E' \t\n\r') END AS chosen,
         trim(prompt || ' / ' || response, E' \t\n\r') AS rejected
  FROM turns WHERE length(response) % 5 <> 0)"""


@query(
    "flatten_rm_record",
    f"WITH {_FLAT} SELECT turn_id, md5(prompt) AS prompt, md5(chosen) AS chosen, length(rejected)::INTEGER AS n FROM flat",
)
def flatten_rm_record(spark, sf):
    rows = R.flatten_rm_record(turn_records(spark, sf), ["turn_id"])
    return rows.select(
        "turn_id", F.md5("prompt").alias("prompt"), F.md5("chosen").alias("chosen"), F.length("rejected").alias("n")
    )


# Documents as template pairs with fields missing or blank, by text length.
def flawed(spark, sf):
    kind = F.col("n_chars") % 7
    return table(spark, sf, "documents").select(
        F.when(kind != 0, F.col("doc_id").cast("string")).alias("data_id"),
        F.col("doc_id").alias("reply_id"),
        F.array(F.lit("chosen"), F.lit("rejected")).alias("reply_type"),
        F.when(kind != 1, F.col("source")).alias("model_name"),
        F.when(kind == 2, " \n").otherwise(F.col("lang")).alias("prompt"),
        F.when(kind == 3, "").when(kind != 0, F.col("text")).alias("chosen"),
        F.when(kind.isin(2, 3), "\t").otherwise(F.col("text")).alias("rejected"),
    )


_ISSUES = """issues AS (
  SELECT doc_id, unnest(CASE n_chars % 7 WHEN 0 THEN ['missing data_id', 'missing chosen']
    WHEN 1 THEN ['missing model_name'] WHEN 2 THEN ['blank prompt', 'blank rejected']
    WHEN 3 THEN ['blank chosen', 'blank rejected'] ELSE [] END) AS issue FROM documents)"""


@query(
    "validate_pairs",
    f"WITH {_ISSUES} SELECT doc_id AS reply_id, string_agg(issue, ', ' ORDER BY issue) AS issues FROM issues GROUP BY doc_id",
)
def validate_pairs(spark, sf):
    rows = R.validate_pairs(flawed(spark, sf))
    return rows.select("reply_id", F.array_join(F.array_sort("issues"), ", ").alias("issues"))


@query("issue_counts", f"WITH {_ISSUES} SELECT issue, count(*) AS n FROM issues GROUP BY issue")
def issue_counts(spark, sf):
    return R.issue_counts(R.validate_pairs(flawed(spark, sf)))


@query("complete_pairs", "SELECT doc_id AS reply_id FROM documents WHERE n_chars % 7 NOT IN (0, 3)")
def complete_pairs(spark, sf):
    return R.complete_pairs(flawed(spark, sf)).select("reply_id")


_MERGED = f"""{IMP}, merged AS (
  SELECT rubric, chosen, rejected FROM imp UNION ALL
  SELECT rubric, generated_passage, generated_passage FROM passages, rubrics)"""


@query(
    "merge_pairs",
    f"WITH {_MERGED} SELECT rubric, md5(chosen) AS chosen, md5(rejected) AS rejected FROM merged",
)
def merge_pairs(spark, sf):
    own = passages(spark, sf).select(
        J.one_row_each(RUBRICS).alias("rubric"),
        F.col("generated_passage").alias("chosen"),
        F.col("generated_passage").alias("rejected"),
    )
    rows = R.merge_pairs(imp_pairs(spark, sf).select("rubric", "chosen", "rejected"), own)
    return rows.select("rubric", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


@query("merge_counts", f"WITH {_MERGED} SELECT rubric, count(*) AS n_pairs FROM merged GROUP BY rubric")
def merge_counts(spark, sf):
    own = passages(spark, sf).select(J.one_row_each(RUBRICS).alias("rubric"))
    return R.merge_counts(R.merge_pairs(imp_pairs(spark, sf).select("rubric"), own))


@query("concat_benchmarks", f"WITH {PASSAGES} SELECT benchmark_id, count(*) AS n FROM passages GROUP BY benchmark_id")
def concat_benchmarks(spark, sf):
    p = passages(spark, sf)
    odd = F.coalesce(F.col("benchmark_id") % 2 == 1, F.lit(False))
    rows = R.merge_pairs(p.where(odd), p.where(~odd))
    return rows.groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("n"))


_SPLIT = f"""{_RECORDS}, split AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42:' || pair_id), pair_id) <= 50 THEN 'eval' ELSE 'train' END AS split
  FROM records)"""


@query("train_eval_split", f"WITH {_SPLIT} SELECT pair_id, split FROM split")
def train_eval_split(spark, sf):
    rows = R.flatten_rm_record(R.to_rm_record(imp_pairs(spark, sf), TEMPLATES), ["pair_id"])
    return R.train_eval_split(rows, "pair_id").select("pair_id", "split")
