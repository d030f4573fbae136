"""Pair building, joins and expansions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import prompts as G
from pairloom.operators import pairs as J
from pairloom.operators.addressed import sample_score_gap_pairs, score_gap_pairs_at
from pairloom.operators.scoring import with_difference
from pairloom.values import VIOLATION_TEMPLATES
from workload.registry import query
from workload.views import (
    numbered,
    GUIDELINES,
    HIGH_LOW,
    IMP,
    PASSAGES,
    RUBRIC_LIST,
    SCORED,
    SCORES,
    guidelines,
    high_low,
    imp_pairs,
    long_scores,
    passages,
    scored_pairs,
    table,
)

def flat(pairs):
    """Pairs with plain columns, texts as digests of the whole text."""
    return pairs.select(
        "pair_id",
        "rubric",
        F.col("source_item.korean_topic").alias("korean_topic"),
        F.col("source_item.foreign_topic").alias("foreign_topic"),
        F.array_join("source_item.problem_types", ", ").alias("problem_types"),
        F.md5("chosen").alias("chosen"),
        F.md5("rejected").alias("rejected"),
    )


@query(
    "pairs_inter_model",
    f"""WITH {IMP}
SELECT pair_id, rubric, korean_topic, foreign_topic, array_to_string(problem_types, ', ') AS problem_types,
       md5(chosen) AS chosen, md5(rejected) AS rejected FROM imp""",
)
def pairs_inter_model(spark, sf):
    return flat(imp_pairs(spark, sf))


_WITH_RUBRIC = "rubric_of AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{r}')" for t, r in VIOLATION_TEMPLATES.items()
) + ") v(template, rubric))"


@query(
    "pairs_intra_model",
    f"""WITH {PASSAGES}, {GUIDELINES}, {HIGH_LOW}
SELECT 'icp_logical_flow_' || h.korean_topic || '_' || printf('%04d', rn) AS pair_id, 'logical_flow' AS rubric,
       h.korean_topic, CASE WHEN h.foreign_topic = l.foreign_topic THEN h.foreign_topic END AS foreign_topic,
       array_to_string(g.problem_types, ', ') AS problem_types,
       md5(h.generated_passage) AS chosen, md5(l.generated_passage) AS rejected
FROM high h JOIN low l USING (korean_topic, rn) JOIN guidelines g ON g.benchmark_id = h.benchmark_id""",
)
def pairs_intra_model(spark, sf):
    high, low = high_low(spark, sf)
    g = guidelines(spark, sf)
    rubric = VIOLATION_TEMPLATES["passage_agent.violate_flow_severely"]
    return flat(J.pairs_intra_model(J.with_guideline(high, g), J.with_guideline(low, g), rubric, id="passage_id"))


@query(
    "rubric_of_template",
    "WITH " + _WITH_RUBRIC + ", d AS (SELECT doc_id, (["
    + ", ".join(f"'{t}'" for t in [*VIOLATION_TEMPLATES, "passage_agent.create_passage"])
    + "])[CAST(doc_id % 7 + 1 AS INTEGER)] AS template FROM documents) "
    "SELECT d.doc_id, r.rubric FROM d LEFT JOIN rubric_of r USING (template)",
)
def rubric_of_template(spark, sf):
    names = F.array(*[F.lit(t) for t in [*VIOLATION_TEMPLATES, "passage_agent.create_passage"]])
    template = F.element_at(names, (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", J.rubric_of_template(template).alias("rubric"))


_LISTS = f"""{PASSAGES}, {GUIDELINES}, c AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY benchmark_id ORDER BY passage_id) - 1 AS BIGINT) AS at
  FROM passages WHERE number < 10), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY benchmark_id ORDER BY passage_id) - 1 AS BIGINT) AS at
  FROM passages WHERE number >= 10)"""


def listed(rows):
    """Passages with their list position in a benchmark and a short source item."""
    places = numbered(rows.drop("pos"), ["benchmark_id"], ["passage_id"], "passage_id")
    item = F.struct(
        F.col("lang").alias("korean_topic"),
        F.lit("k").alias("korean_context"),
        F.lit("w").alias("foreign_topic"),
        F.lit("f").alias("foreign_context"),
    )
    return places.withColumn("pos", F.col("pos") - 1).withColumn("source_item", item)


@query(
    "pairs_by_template",
    f"""WITH {_LISTS}
SELECT 'benchmark_' || c.benchmark_id || '.item_' || c.at AS data_id,
       row_number() OVER (ORDER BY c.benchmark_id, c.at) AS reply_id,
       md5('다음 조건에 맞는 한국어 독해 지문을 생성해주세요.

**주제 정보:**
- 한국어 주제: ' || c.lang || '
- 외국어 주제: w

**배경 맥락:**
- 한국어 맥락: k
- 외국어 맥락: f

**문제 유형:** ' || array_to_string(g.problem_types, ', ') || '

**평가 목표:** ' || array_to_string(g.eval_goals, ', ') || '

위 조건들을 모두 반영하여 적절한 한국어 독해 지문을 작성해주세요. 지문은 주어진 주제와 맥락을 포함하고, 지정된 문제 유형과 평가 목표에 적합해야 합니다.') AS prompt,
       md5(c.generated_passage) AS chosen, md5(r.generated_passage) AS rejected
FROM c JOIN r ON c.benchmark_id = r.benchmark_id AND c.at = r.at AND c.lang = r.lang
JOIN guidelines g ON g.benchmark_id = c.benchmark_id""",
)
def pairs_by_template(spark, sf):
    high, low = high_low(spark, sf)
    chosen = listed(high).join(guidelines(spark, sf), "benchmark_id")
    pairs = J.pairs_by_template(chosen, listed(low), "model", "v1.0.0")
    return pairs.select(
        "data_id",
        "reply_id",
        F.md5("prompt").alias("prompt"),
        F.md5("chosen").alias("chosen"),
        F.md5("rejected").alias("rejected"),
    )


@query(
    "pairs_by_score_gap",
    f"""WITH {SCORES}
SELECT a.rubric, a.source_key, a.passage_id AS chosen_id, b.passage_id AS rejected_id,
       a.score AS high_score, b.score AS low_score, a.score - b.score AS margin
FROM long a JOIN long b ON a.rubric = b.rubric AND a.source_key = b.source_key AND a.score - b.score >= 1""",
)
def pairs_by_score_gap(spark, sf):
    pairs = J.pairs_by_score_gap(long_scores(spark, sf))
    return pairs.select("rubric", "source_key", "chosen_id", "rejected_id", "high_score", "low_score", "margin")


@query(
    "score_gap_counts",
    f"""WITH {SCORES}
SELECT a.rubric, a.source_key, a.score AS high_score, b.score AS low_score, a.score - b.score AS margin,
       count(*) AS n_pairs
FROM long a JOIN long b ON a.rubric = b.rubric AND a.source_key = b.source_key AND a.score - b.score >= 2
GROUP BY ALL""",
)
def score_gap_counts(spark, sf):
    return J.score_gap_counts(long_scores(spark, sf), min_gap=2)


@query(
    "score_gap_totals",
    f"""WITH {SCORES}
SELECT a.rubric, a.source_key, a.score AS high_score, count(*) AS n_pairs
FROM long a JOIN long b ON a.rubric = b.rubric AND a.source_key = b.source_key AND a.score - b.score >= 2
GROUP BY ALL""",
)
def score_gap_totals(spark, sf):
    """Pairs of each level from the sums before it: neither pairs nor pairs of levels are made."""
    return J.score_gap_totals(long_scores(spark, sf), min_gap=2)


_NUMBERED = f"""{SCORES}, numbered AS (
  SELECT row_number() OVER (ORDER BY substr(md5(a.rubric || ':' || a.source_key), 1, 3), a.rubric, a.source_key, a.score,
                                     a.passage_id, b.score, b.passage_id) - 1 AS number,
         a.rubric, a.source_key, a.passage_id AS chosen_id, b.passage_id AS rejected_id, a.score AS high_score,
         b.score AS low_score, a.score - b.score AS margin
  FROM long a JOIN long b ON a.rubric = b.rubric AND a.source_key = b.source_key AND a.score - b.score >= 1)"""


@query(
    "sample_score_gap_pairs",
    f"""WITH {_NUMBERED}, t AS (SELECT count(*) // 1000 AS width, count(*) % 1000 AS rest FROM numbered),
drawn AS (
  SELECT i * width + least(i, rest) + ('0x' || substr(md5('42:' || i), 1, 15))::BIGINT % (width + CASE WHEN i < rest THEN 1 ELSE 0 END) AS number
  FROM range(1000) r(i), t)
SELECT numbered.* FROM numbered JOIN drawn USING (number)""",
)
def sample_score_gap_pairs_(spark, sf):
    """1,000 of all pairs by their numbers; the others are never made."""
    return sample_score_gap_pairs(long_scores(spark, sf), 1000)


@query("score_gap_pairs_at", f"WITH {_NUMBERED} SELECT * FROM numbered WHERE number BETWEEN 500 AND 1499")
def score_gap_page(spark, sf):
    """One page of the pairs."""
    numbers = spark.range(500, 1500).select(F.col("id").alias("number"))
    return score_gap_pairs_at(long_scores(spark, sf), numbers)


@query(
    "score_groups",
    f"WITH {SCORES} SELECT rubric, source_key, score, count(*) AS n FROM long GROUP BY ALL",
)
def score_groups(spark, sf):
    return J.score_groups(long_scores(spark, sf))


def samples(spark, sf):
    """Labelled documents as quality samples named after source and language."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    good = F.col("quality") == 1
    return d.select(
        F.concat_ws("_", F.when(good, "고품질").otherwise("저품질"), "doc_id", "source", "lang", "toxic").alias("name"),
        F.when(good, "high").otherwise("low").alias("quality"),
        "text",
        F.col("doc_id").alias("pos"),
    )


SAMPLES = """samples AS (
  SELECT CASE WHEN quality = 1 THEN '고품질' ELSE '저품질' END || '_' || doc_id || '_' || source || '_' || lang || '_' || toxic AS name,
         quality, source || '_' || lang || '_' || toxic AS topic, text, doc_id
  FROM documents JOIN labels USING (doc_id)),
first_low AS (
  SELECT topic, arg_min(text, doc_id) AS text, arg_min(name, doc_id) AS name FROM samples WHERE quality = 0 GROUP BY topic),
labelled AS (
  SELECT 'preference_pair_' || topic AS pair_id, topic, h.text AS chosen, l.text AS rejected,
         h.name AS chosen_name, l.name AS rejected_name
  FROM samples h JOIN first_low l USING (topic) WHERE h.quality = 1)"""


@query(
    "pairs_by_label",
    f"""WITH {SAMPLES}
SELECT pair_id, topic, md5(chosen) AS chosen, md5(rejected) AS rejected, chosen_name, rejected_name FROM labelled""",
)
def pairs_by_label(spark, sf):
    return J.pairs_by_label(samples(spark, sf)).select(
        "pair_id",
        "topic",
        F.md5("chosen").alias("chosen"),
        F.md5("rejected").alias("rejected"),
        "metadata.chosen_name",
        "metadata.rejected_name",
    )


@query(
    "unmatched_by_label",
    f"""WITH {SAMPLES}
SELECT name, topic FROM samples WHERE quality = 1 AND topic NOT IN (SELECT topic FROM first_low)""",
)
def unmatched_by_label(spark, sf):
    return J.unmatched_by_label(samples(spark, sf))


def evals(spark, sf):
    """PASS/FAIL results of every passage and rubric; score 2 is uncertain."""
    result = F.when(F.col("score") > 2, "pass").when(F.col("score") == 2, "uncertain").otherwise("fail")
    return long_scores(spark, sf).select("passage_id", "rubric", result.alias("result"))


_EVALS = """evals AS (
  SELECT passage_id, rubric, CASE WHEN score > 2 THEN 'pass' WHEN score = 2 THEN 'uncertain' ELSE 'fail' END AS result
  FROM long)"""

_DRAW = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY rubric, passed ORDER BY md5('42:' || rubric || ':' || passage_id), passage_id) AS n
  FROM drawn)
SELECT 'spf_' || g.rubric || '_' || p.korean_topic || '_' || printf('%04d', g.n) AS pair_id, g.rubric,
       md5(p.generated_passage) AS chosen, md5(q.generated_passage) AS rejected
FROM numbered g JOIN numbered b ON g.rubric = b.rubric AND g.n = b.n AND g.passed AND NOT b.passed
JOIN passages p ON p.passage_id = g.passage_id JOIN passages q ON q.passage_id = b.passage_id"""


def _drawn(pairs):
    return pairs.select("pair_id", "rubric", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


def guided(spark, sf):
    """Passages with problem types and goals beside their source item."""
    p = passages(spark, sf)
    return p.join(guidelines(spark, sf), "benchmark_id", "left").select(*p.columns, "problem_types", "eval_goals")


@query(
    "pairs_by_filter",
    f"WITH {SCORES}, {GUIDELINES}, {_EVALS}, drawn AS (SELECT passage_id, rubric, result = 'pass' AS passed FROM evals "
    "WHERE result <> 'uncertain'), "
    + _DRAW.replace("AS rejected\n", "AS rejected, array_to_string(gl.problem_types, ',') AS types, array_to_string(gl.eval_goals, ',') AS goals\n")
    + "\nJOIN guidelines gl ON gl.benchmark_id = p.benchmark_id",
)
def pairs_by_filter(spark, sf):
    pairs = J.pairs_by_filter(evals(spark, sf), guided(spark, sf))
    item = [F.array_join(f"source_item.{a}", ",").alias(b) for a, b in (("problem_types", "types"), ("eval_goals", "goals"))]
    return pairs.select("pair_id", "rubric", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), *item)


@query(
    "pairs_by_filter_all_six",
    f"""WITH {SCORES}, {_EVALS}, {RUBRIC_LIST}, whole AS (
  SELECT passage_id, bool_and(result = 'pass') AS passed FROM evals GROUP BY passage_id),
drawn AS (SELECT passage_id, rubric, passed FROM whole CROSS JOIN rubrics),
{_DRAW}""",
)
def pairs_by_filter_all_six(spark, sf):
    return _drawn(J.pairs_by_filter(evals(spark, sf), passages(spark, sf), mode="all_six"))


@query(
    "pairs_by_filter_same_source",
    f"""WITH {SCORES}, {_EVALS}, drawn AS (
  SELECT passage_id, rubric, result = 'pass' AS passed, lang FROM evals JOIN passages USING (passage_id)
  WHERE result <> 'uncertain'), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY rubric, lang, passed ORDER BY md5('42:' || rubric || ':' || passage_id), passage_id) AS n
  FROM drawn)
SELECT 'spf_' || g.rubric || '_' || p.korean_topic || '_' || printf('%04d', g.n) AS pair_id, g.rubric,
       md5(p.generated_passage) AS chosen, md5(q.generated_passage) AS rejected
FROM numbered g JOIN numbered b ON g.rubric = b.rubric AND g.lang = b.lang AND g.n = b.n AND g.passed AND NOT b.passed
JOIN passages p ON p.passage_id = g.passage_id JOIN passages q ON q.passage_id = b.passage_id""",
)
def pairs_by_filter_same_source(spark, sf):
    return _drawn(J.pairs_by_filter(evals(spark, sf), passages(spark, sf), same_source=True))


@query(
    "with_guideline",
    f"""WITH {PASSAGES}, {GUIDELINES}
SELECT passage_id, korean_topic, array_to_string(problem_types, ', ') AS problem_types,
       array_to_string(eval_goals, ', ') AS eval_goals
FROM passages JOIN guidelines USING (benchmark_id)""",
)
def with_guideline(spark, sf):
    rows = J.with_guideline(passages(spark, sf), guidelines(spark, sf))
    return rows.select(
        "passage_id",
        "source_item.korean_topic",
        F.array_join("source_item.problem_types", ", ").alias("problem_types"),
        F.array_join("source_item.eval_goals", ", ").alias("eval_goals"),
    )


_TASKS = f"""{PASSAGES}, {GUIDELINES}, tasks AS (
  SELECT passage_id, generated_passage, j, problem_types[j] AS problem_type, eval_goals[j] AS eval_goal
  FROM passages JOIN guidelines USING (benchmark_id), (SELECT unnest([1, 2, 3]) AS j))"""


def tasks(spark, sf):
    rows = passages(spark, sf).join(guidelines(spark, sf), "benchmark_id")
    return J.stem_tasks(rows.select("passage_id", "generated_passage", "problem_types", "eval_goals"))


@query(
    "stem_tasks",
    f"WITH {_TASKS} SELECT passage_id, j, problem_type, eval_goal, md5(generated_passage) AS body FROM tasks",
)
def stem_tasks(spark, sf):
    return tasks(spark, sf).select("passage_id", "j", "problem_type", "eval_goal", F.md5("generated_passage").alias("body"))


@query(
    "stems_wide",
    f"""WITH {_TASKS}, s AS (SELECT *, CASE WHEN (passage_id + j) % 4 = 0 THEN '문항 생성 실패'
    ELSE problem_type || ': ' || passage_id END AS stem FROM tasks)
SELECT passage_id, """
    + ", ".join(
        f"max(problem_type) FILTER (j = {j}) AS problem_type_{j}, max(eval_goal) FILTER (j = {j}) AS eval_goal_{j}, "
        f"max(stem) FILTER (j = {j}) AS stem_{j}"
        for j in (1, 2, 3)
    )
    + " FROM s GROUP BY passage_id",
)
def stems_wide(spark, sf):
    stem = F.when((F.col("passage_id") + F.col("j")) % 4 > 0, F.concat("problem_type", F.lit(": "), "passage_id"))
    return J.stems_wide(tasks(spark, sf).withColumn("stem", stem), ["passage_id"])


@query(
    "generation_grid",
    "SELECT doc_id, model, template FROM documents, (SELECT unnest(['m1', 'm2']) AS model), "
    "(SELECT unnest(['t1', 't2', 't3']) AS template)",
)
def generation_grid(spark, sf):
    items = table(spark, sf, "documents").select("doc_id")
    return J.generation_grid(items, ["m1", "m2"], ["t1", "t2", "t3"])


@query(
    "common_keys",
    f"""WITH {PASSAGES}
SELECT n_chars FROM passages WHERE number < 10 INTERSECT SELECT n_chars FROM passages WHERE number >= 10""",
)
def common_keys(spark, sf):
    high, low = high_low(spark, sf)
    return J.common_keys(high, low, "n_chars")


@query(
    "attach_text",
    f"""WITH {SCORED}, top AS (SELECT pair_id, score_difference FROM scored ORDER BY score_difference, pair_id LIMIT 5)
SELECT pair_id, round(top.score_difference, 6) AS score_difference, chosen, rejected
FROM scored JOIN top USING (pair_id)""",
)
def attach_text(spark, sf):
    scored = with_difference(scored_pairs(spark, sf))
    found = J.attach_text(
        scored.select("pair_id", "score_difference"),
        scored.select("pair_id", "chosen", "rejected"),
        5,
        [F.col("score_difference"), F.col("pair_id")],
    )
    return found.select("pair_id", F.round("score_difference", 6).alias("score_difference"), "chosen", "rejected")


@query(
    "source_key",
    "SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN lang ELSE 'N/A' END || '||' || source AS source_key FROM documents",
)
def source_key(spark, sf):
    d = table(spark, sf, "documents")
    item = F.struct(
        F.when(F.col("n_chars") % 2 == 0, F.col("lang")).alias("korean_topic"), F.col("source").alias("foreign_topic")
    )
    return d.select("doc_id", G.source_key(item).alias("source_key"))


@query(
    "group_key",
    """
SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN lang WHEN 1 THEN source WHEN 2 THEN 'item' || doc_id
  ELSE nullif(doc_id % 5, 0)::VARCHAR END AS group_key FROM documents""",
)
def group_key(spark, sf):
    kind = F.col("n_chars") % 4
    item = F.struct(
        F.when(kind == 0, F.col("lang")).otherwise("").alias("korean_topic"),
        F.when(kind == 1, F.col("source")).alias("topic"),
        F.when(kind == 2, F.concat(F.lit("item"), "doc_id")).otherwise("").alias("item_id"),
        (F.col("doc_id") % 5).alias("benchmark_id"),
    )
    rows = table(spark, sf, "documents").withColumn("source_item", item)
    return rows.select("doc_id", G.group_key(rows).alias("group_key"))


@query(
    "common_source_item",
    f"""WITH {PASSAGES}, {HIGH_LOW}
SELECT h.passage_id AS high_id, l.passage_id AS low_id, h.korean_topic,
       CASE WHEN h.foreign_topic = l.foreign_topic THEN h.foreign_topic END AS foreign_topic,
       h.korean_context, CASE WHEN h.foreign_context = l.foreign_context THEN h.foreign_context END AS foreign_context
FROM high h JOIN low l USING (korean_topic, rn)""",
)
def common_source_item(spark, sf):
    high, low = high_low(spark, sf)
    order = ["benchmark_id", "pos"]
    h = numbered(high, ["lang"], order, "passage_id", "rn").alias("h")
    lo = numbered(low, ["lang"], order, "passage_id", "rn").alias("l")
    names = ["korean_topic", "foreign_topic", "korean_context", "foreign_context"]
    item = J.common_source_item(F.col("h.source_item"), F.col("l.source_item"), names)
    return h.join(lo, ["lang", "rn"]).select(
        F.col("h.passage_id").alias("high_id"), F.col("l.passage_id").alias("low_id"), item.alias("i")
    ).select("high_id", "low_id", "i.*")


@query(
    "passage_text",
    "SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN source ELSE '' END) AS body FROM documents",
)
def passage_text(spark, sf):
    kind = F.col("doc_id") % 3
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.when(kind == 0, F.col("text")).alias("text"),
        F.when(kind == 1, F.col("source")).alias("generated_passage"),
    )
    return rows.select("doc_id", F.md5(G.passage_text(rows)).alias("body"))


@query(
    "pair_ids",
    """
SELECT doc_id, 'spf_' || lang || '_' || source || '_' || printf('%04d', doc_id) AS pair_id FROM documents""",
)
def pair_ids(spark, sf):
    made = J.pair_id("spf", F.col("lang"), F.col("source"), F.col("doc_id"))
    return table(spark, sf, "documents").select("doc_id", made.alias("pair_id"))
