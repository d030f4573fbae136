"""Raw responses parsed into typed tables.

The responses are the documents with an answer of some form around their
whole text, so the patterns also meet everything the text itself contains.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions.parse import score_1_5
from pairloom.operators import responses as X
from pairloom.values import RUBRIC_ALIASES, RUBRICS
from workload.registry import query
from workload.text import CORRECTED_SQL, corrected, distance_sql
from workload.views import BINARY, SCORES, binary, passages, texts


def lit(x):
    return F.lit(x)


def score_responses(spark, sf):
    """Answers that state a score in one of six forms, or none."""
    score = (F.col("n_chars") % 7).cast("string")
    kind = F.col("doc_id") % 6
    text = (
        F.when(kind == 0, F.concat(score, lit("점 (적합)\n"), "text"))
        .when(kind == 1, F.concat(lit("점수는 "), score, lit("점\n"), "text"))
        .when(kind == 2, F.concat(lit("Score: "), score, lit("\n"), "text"))
        .when(kind == 3, F.concat("text", lit("\n"), score))
        .when(kind == 4, F.concat(score, lit(" (매우 적합) "), "text"))
        .otherwise(F.col("text"))
    )
    return texts(spark, sf).select("doc_id", "n_chars", text.alias("response"))


_SCORE_RESPONSES = r"""responses AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN (n_chars % 7) || E'점 (적합)\n' || text
    WHEN 1 THEN '점수는 ' || (n_chars % 7) || E'점\n' || text WHEN 2 THEN 'Score: ' || (n_chars % 7) || E'\n' || text
    WHEN 3 THEN text || E'\n' || (n_chars % 7) WHEN 4 THEN (n_chars % 7) || ' (매우 적합) ' || text
    ELSE text END AS response FROM documents)"""


def _try(where: str, pattern: str) -> str:
    n = f"TRY_CAST(regexp_extract({where}, '{pattern}', 1) AS BIGINT)"
    return f"CASE WHEN {n} BETWEEN 1 AND 5 THEN {n} END"


_SCORE = "coalesce(" + ", ".join(
    [
        _try("response", r"([0-9]+)점\s*\([^)]+\)"),
        _try("response", "([0-9]+)점"),
        _try("response", r":\s*([0-9]+)"),
        _try("response", r"([0-9]+)\s*\("),
        _try("response", r"([0-9]+)\n?$"),
        _try(r"string_split(trim(response, E' \t\n\r'), E'\n')[1]", "([0-9]+)"),
    ]
) + ")"


@query(
    "parse_scores",
    f"""WITH {_SCORE_RESPONSES}, parsed AS (SELECT doc_id, {_SCORE} AS s FROM responses)
SELECT doc_id, coalesce(s, 3)::INTEGER AS score, CASE WHEN s IS NULL THEN 'default' ELSE 'parsed' END AS parse_status
FROM parsed""",
)
def parse_scores(spark, sf):
    return X.parse_scores(score_responses(spark, sf)).select("doc_id", "score", "parse_status")


@query(
    "status_counts",
    f"""WITH {_SCORE_RESPONSES}
SELECT CASE WHEN {_SCORE} IS NULL THEN 'default' ELSE 'parsed' END AS parse_status, count(*) AS n
FROM responses GROUP BY ALL""",
)
def status_counts(spark, sf):
    return X.status_counts(X.parse_scores(score_responses(spark, sf)))


@query(
    "extract_explanation",
    rf"""WITH {_SCORE_RESPONSES}, parsed AS (
  SELECT doc_id, response, {_SCORE} AS score FROM responses)
SELECT doc_id, score::VARCHAR AS score, md5(CASE
  WHEN score IS NOT NULL AND strpos(response, score || '점') > 0
    THEN trim(ltrim(trim(substr(response, strpos(response, score || '점') + 2), E' \t\n\r'), ':'), E' \t\n\r')
  ELSE trim(response, E' \t\n\r') END) AS explanation FROM parsed""",
)
def extract_explanation(spark, sf):
    rows = score_responses(spark, sf).withColumn("score", score_1_5(F.col("response")))
    found = X.extract_explanation(rows)
    return found.select("doc_id", F.col("score").cast("string").alias("score"), F.md5("explanation").alias("explanation"))


def binary_responses(spark, sf):
    """Answers with the six verdicts as JSON of several kinds after the text."""
    rows = binary(spark, sf).join(passages(spark, sf).select("passage_id", "generated_passage", "n_chars"), "passage_id")

    def held(names, quoted=False):
        out = [F.initcap(F.col(r).cast("string")) if quoted else F.col(r) for r in RUBRICS]
        return [c.alias(n) for c, n in zip(out, names)]

    def json_of(*fields):
        return F.to_json(F.struct(*fields))

    aliases, feedback = [RUBRIC_ALIASES[r] for r in RUBRICS], F.col("model").alias("feedback")
    nested = json_of(F.struct(*held(aliases)).alias("scores"), feedback)
    flat = json_of(*held(RUBRICS), feedback)
    quoted = json_of(*held(aliases, quoted=True))
    five = json_of(*held(RUBRICS[:5]))
    broken = F.concat(F.rtrim(json_of(*held(RUBRICS)), F.lit("}")), lit(",, }"))
    kind = F.col("passage_id") % 6
    json = (
        F.when(kind == 0, nested)
        .when(kind == 1, flat)
        .when(kind == 2, quoted)
        .when(kind == 3, five)
        .when(kind == 4, broken)
        .otherwise(lit("판단할 수 없음"))
    )
    return rows.select("passage_id", F.concat("generated_passage", lit("\n"), json, lit("\n끝")).alias("response"))


def _json_parts(names, value) -> str:
    return " || ', ' || ".join(f"""'"{n}": ' || {value(r)}""" for r, n in zip(RUBRICS, names))


_ALIASES = [RUBRIC_ALIASES[r] for r in RUBRICS]


def _plain(r):
    return f"{r}::VARCHAR"


def _quoted(r):
    return f"""'"' || CASE WHEN {r} THEN 'True' ELSE 'False' END || '"'"""


_BINARY_RESPONSES = f"""responses AS (
  SELECT v.passage_id, p.generated_passage || E'\\n' || CASE v.passage_id % 6
    WHEN 0 THEN '{{"scores": {{' || {_json_parts(_ALIASES, _plain)} || '}}, "feedback": "' || v.model || '"}}'
    WHEN 1 THEN '{{' || {_json_parts(RUBRICS, _plain)} || ', "feedback": "' || v.model || '"}}'
    WHEN 2 THEN '{{' || {_json_parts(_ALIASES, _quoted)} || '}}'
    WHEN 3 THEN '{{' || {_json_parts(RUBRICS[:5], _plain)} || '}}'
    WHEN 4 THEN '{{' || {_json_parts(RUBRICS, _plain)} || ',, }}'
    ELSE '판단할 수 없음' END || E'\\n끝' AS response
  FROM verdict v JOIN passages p USING (passage_id)),
found AS (SELECT passage_id, nullif(regexp_extract(response, '\\{{.*\\}}', 0, 's'), '') AS t FROM responses),
parsed AS (SELECT passage_id, t, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM found),
picked AS (SELECT passage_id, t, j, CASE WHEN json_type(j, '$.scores') = 'OBJECT' THEN json_extract(j, '$.scores') ELSE j END AS s FROM parsed)"""


def _value(r):
    return f"coalesce(json_extract_string(s, '$.{RUBRIC_ALIASES[r]}'), json_extract_string(s, '$.{r}'))"


_COMPLETE = " AND ".join(f"{_value(r)} IS NOT NULL" for r in RUBRICS)


@query(
    "parse_binary_rubric",
    f"""WITH {SCORES}, {BINARY}, {_BINARY_RESPONSES}
SELECT passage_id, """
    + ", ".join(f"coalesce({_COMPLETE} AND lower({_value(r)}) = 'true', false) AS {r}" for r in RUBRICS)
    + f""",
  CASE WHEN {_COMPLETE} THEN coalesce(json_extract_string(j, '$.feedback'), '')
       WHEN t IS NOT NULL AND j IS NULL THEN 'JSON 형식 오류' ELSE 'JSON 파싱 실패' END AS feedback,
  CASE WHEN t IS NULL THEN 'no_json' WHEN j IS NULL THEN 'bad_json' WHEN NOT ({_COMPLETE}) THEN 'incomplete'
       WHEN json_type(j, '$.scores') = 'OBJECT' THEN 'nested' ELSE 'flat' END AS parse_status FROM picked""",
)
def parse_binary_rubric(spark, sf):
    rows = X.parse_binary_rubric(binary_responses(spark, sf))
    return rows.select("passage_id", *RUBRICS, "feedback", "parse_status")


@query(
    "parse_correction",
    f"""WITH r AS (SELECT doc_id, doc_id % 3 AS kind, trim(text, E' \\t\\n\\r') AS o,
  trim(string_split({CORRECTED_SQL} || ' (주소)', E'\\n**')[1], E' \\t\\n\\r') AS body FROM documents),
c AS (SELECT *, trim(regexp_replace(body, '\\(.*?\\)', '', 'g'), E' \\t\\n\\r') AS b FROM r),
s AS (SELECT doc_id, kind, CASE WHEN kind = 0 AND b <> '' AND b <> o
  THEN 1.0::DOUBLE - {distance_sql("o", "b")}::DOUBLE / greatest(length(o), length(b)) END AS sim FROM c)
SELECT doc_id, CASE WHEN sim IS NULL THEN CASE WHEN kind = 2 THEN 2 ELSE 5 END WHEN sim >= 0.99 THEN 5 WHEN sim >= 0.95 THEN 4
    WHEN sim >= 0.90 THEN 3 WHEN sim >= 0.80 THEN 2 ELSE 1 END::INTEGER AS score,
  CASE WHEN sim IS NOT NULL THEN 'correction' WHEN kind = 2 THEN 'score' ELSE 'default' END AS parse_status FROM s""",
)
def parse_correction(spark, sf):
    """Whole texts graded against corrected ones of about their length."""
    kind = F.col("doc_id") % 3
    response = (
        F.when(kind == 0, F.concat(lit("검토\n**교정된 문장:** \n"), corrected(), lit(" (주소)\n**이유:** 통일")))
        .when(kind == 1, lit("오류 없음"))
        .otherwise(lit("2점"))
    )
    rows = texts(spark, sf).select("doc_id", F.col("text").alias("passage"), response.alias("response"))
    return X.parse_correction(rows, source="auto").select("doc_id", "score", "parse_status")


@query(
    "parse_pass_fail",
    r"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'uncertain' END AS result,
  CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS score,
  md5(trim(CASE doc_id % 3 WHEN 0 THEN 'Pass: ' WHEN 1 THEN 'FAIL ' ELSE '판단: ' END || text, E' \t\n\r')) AS reason
FROM documents""",
)
def parse_pass_fail(spark, sf):
    kind = F.col("doc_id") % 3
    head = F.when(kind == 0, "\n Pass: ").when(kind == 1, "FAIL ").otherwise("판단: ")
    rows = texts(spark, sf).select("doc_id", F.concat(head, "text").alias("response"))
    return X.parse_pass_fail(rows).select("doc_id", "result", "score", F.md5("reason").alias("reason"))


@query(
    "parse_ab_choice",
    r"""WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'B가 낫다. ' || text
    WHEN 2 THEN '- 선택: B' || E'\n' || text ELSE '1. ' || text || ' 선택:A' END AS response FROM documents),
l AS (SELECT *, trim(string_split(trim(response, E' \t\n\r'), E'\n')[1], E' \t\n\r') AS line FROM r)
SELECT doc_id, CASE WHEN line LIKE 'A%' THEN 'A' WHEN line LIKE 'B%' THEN 'B'
  WHEN contains(response, '선택: A') OR contains(response, '선택:A') THEN 'A'
  WHEN contains(response, '선택: B') OR contains(response, '선택:B') THEN 'B' END AS choice FROM l""",
)
def parse_ab_choice(spark, sf):
    kind = F.col("doc_id") % 4
    response = (
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, F.concat(lit("B가 낫다. "), "text"))
        .when(kind == 2, F.concat(lit("- 선택: B\n"), "text"))
        .otherwise(F.concat(lit("1. "), "text", lit(" 선택:A")))
    )
    return X.parse_ab_choice(texts(spark, sf).select("doc_id", response.alias("response"))).select(
        "doc_id", "choice"
    )


@query(
    "parse_topic_pair",
    r"""WITH r AS (SELECT doc_id, source, lang, trim(text, E' \t\n\r') AS t, doc_id % 3 AS kind FROM documents),
p AS (SELECT *, string_split(translate(t, '[]"''', ''), ',') AS parts FROM r)
SELECT doc_id, CASE WHEN kind = 0 THEN source WHEN kind = 1 THEN lang || ' topic'
    WHEN contains(t, ',') THEN trim(string_split(trim(parts[1], E' \t\n\r'), ':')[1], E' \t\n\r') END AS korean_topic,
  CASE WHEN kind = 0 THEN lang WHEN kind = 1 THEN source
    WHEN contains(t, ',') THEN trim(string_split(trim(parts[2], E' \t\n\r'), ':')[1], E' \t\n\r') END AS foreign_topic
FROM p""",
)
def parse_topic_pair(spark, sf):
    kind = F.col("doc_id") % 3
    listed = F.concat(lit('답: ["'), "source", lit(' ", "'), "lang", lit("\"] \n"), "text")
    plain = F.concat("lang", lit(" topic: why, '"), "source", lit("': because\n"), F.translate("text", "[]", "()"))
    response = F.when(kind == 0, listed).when(kind == 1, plain).otherwise(F.translate("text", "[]", ""))
    rows = texts(spark, sf).select("doc_id", response.alias("response"))
    return X.parse_topic_pair(rows).select("doc_id", "korean_topic", "foreign_topic")
