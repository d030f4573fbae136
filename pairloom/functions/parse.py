"""Typed values out of raw judge responses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom import values as V
from pairloom.functions.edits import edit_distance_within, similarity_within
from pairloom.functions.text import scale_1_5, strip

_STRICT_JSON = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false"}
_FULL_WIDTH, _ASCII = "０１２３４５６７８９", "0123456789"


def score_1_5(response: Column, last: bool = False) -> Column:
    """The score a judge gave, or null.

    The patterns are tried in order; each offers its first match only (with
    ``last`` its last one), and a value outside 1..5 passes on to the next.
    At the end the first number of the first (last) line is tried. The
    candidates sit in one array, so each pattern runs once per response.
    """

    def found(pattern: str) -> Column:
        if last:
            return F.try_element_at(F.regexp_extract_all(response, F.lit(pattern), F.lit(1)), F.lit(-1))
        return F.regexp_extract(response, pattern, 1)

    line = F.substring_index(strip(response), "\n", -1 if last else 1)
    digits = F.array(
        *[found(f"(?Ud){p}") for p in V.SCORES], F.regexp_extract(line, r"(?U)(\d+)", 1)
    )
    numbers = F.transform(digits, lambda d: F.translate(d, _FULL_WIDTH, _ASCII).try_cast("bigint"))
    return F.get(F.filter(numbers, lambda n: n.between(1, 5)), F.lit(0)).cast("int")


def json_object(response: Column) -> Column:
    """The text from the first to the last brace, or null."""
    return F.nullif(F.regexp_extract(response, r"(?s)\{.*\}", 0), F.lit(""))


def json_map(text: Column) -> Column:
    """A JSON object as a map of texts, null for bad JSON.

    The object is parsed as the only entry of an array, which makes the
    parser reject anything that follows it.
    """
    boxed = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", _STRICT_JSON
    )
    return F.when(F.size(boxed) == 1, F.get(boxed, F.lit(0)))


def names_all_rubrics(m: Column) -> Column:
    """Whether a map has an entry for each rubric under either of its keys."""
    out = m.isNotNull()
    for rubric in V.RUBRICS:
        out = out & (F.map_contains_key(m, V.RUBRIC_ALIASES[rubric]) | F.map_contains_key(m, rubric))
    return F.coalesce(out, F.lit(False))


def map_verdict(m: Column, rubric: str) -> Column:
    """A rubric's verdict in a map; only true or the text "true" passes."""
    alias = V.RUBRIC_ALIASES[rubric]
    value = F.when(F.map_contains_key(m, alias), m[alias]).otherwise(m[rubric])
    return F.coalesce(F.lower(value) == "true", F.lit(False))


def corrected_text(response: Column, original: Column) -> Column:
    """The corrected text a judge wrote, or null if there is none that differs."""
    body = F.regexp_extract(response, f"(?Usd){V.CORRECTION}", 1)
    body = strip(F.regexp_replace(strip(body), r"(?d)\(.*?\)", ""))
    return F.when((F.length(body) > 0) & (body != original), body)


def correction_grade(original: Column, corrected: Column) -> Column:
    """1..5 by how little a correction changed the passage; 5 if there is none.

    The distance is found as far as a grade depends on it: beyond, the grade is 1.
    """
    near = edit_distance_within(F.when(corrected.isNotNull(), original), corrected, 1 - V.GRADES[-1][0])
    similarity = similarity_within(original, corrected, near)
    return F.when(corrected.isNull(), F.lit(5)).otherwise(F.coalesce(scale_1_5(similarity), F.lit(1)))


def pass_fail(reason: Column) -> Column:
    """``pass``, ``fail``, ``uncertain`` or ``error`` from a stripped answer."""
    head = F.upper(F.substring(reason, 1, 4))
    return (
        F.when(reason.isNull(), "error")
        .when(head == "PASS", "pass")
        .when(head == "FAIL", "fail")
        .otherwise("uncertain")
    )


def pass_score(result: Column) -> Column:
    """1 for pass, 0.5 for uncertain, else 0."""
    return F.when(result == "pass", 1.0).when(result == "uncertain", 0.5).otherwise(0.0)


def ab_choice(line: Column, response: Column) -> Column:
    """``A``, ``B`` or null from the stripped first line and the whole answer.

    The first letter decides, so "Answer: B" is A.
    """

    def says(texts: list[str]) -> Column:
        return F.contains(response, F.lit(texts[0])) | F.contains(response, F.lit(texts[1]))

    return (
        F.when(F.startswith(line, F.lit("A")), "A")
        .when(F.startswith(line, F.lit("B")), "B")
        .when(says(V.CHOICE_A), "A")
        .when(says(V.CHOICE_B), "B")
    )


def first_line(response: Column) -> Column:
    """The first line, stripped."""
    return strip(F.substring_index(strip(response), "\n", 1))


def listed_topics(text: Column) -> Column:
    """The first bracketed list that is JSON, as texts, or null."""
    found = F.nullif(F.regexp_extract(text, r"\[[^\]]+\]", 0), F.lit(""))
    return F.from_json(found, "array<string>", _STRICT_JSON)


def listed_topic(listed: Column, i: int) -> Column:
    """An entry of the list without quotes around it."""
    out = strip(F.coalesce(F.get(listed, F.lit(i)), F.lit("None")))
    return F.btrim(F.btrim(out, F.lit('"')), F.lit("'"))


def plain_topics(text: Column) -> Column:
    """Comma separated parts without brackets and quotes; null without comma."""
    parts = F.split(F.translate(text, "[]\"'", ""), ",", -1)
    return F.when(F.contains(text, F.lit(",")), parts)


def plain_topic(parts: Column, i: int) -> Column:
    """A part up to its colon."""
    return strip(F.substring_index(strip(F.get(parts, F.lit(i))), ":", 1))


def explanation(response: Column, mark: Column) -> Column:
    """Text after the first ``mark``; the whole answer if there is none."""
    rest = F.get(F.split(response, F.concat(F.lit("\\Q"), mark, F.lit("\\E")), 2), F.lit(1))
    return F.coalesce(strip(F.regexp_replace(strip(rest), "^:+", "")), strip(response))
