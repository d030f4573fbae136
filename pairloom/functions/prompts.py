"""Prompt texts as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import values as V

_LOOSE_FIELD = re.compile(r"\{([a-zA-Z0-9_]+)\}")


def fill(template: str, fields: dict[str, Column], only: str | None = None) -> Column:
    """Render a ``str.format`` template; unknown placeholders raise KeyError.

    The template is split once, on the driver, into literals and columns, so
    inserted text is never expanded a second time. With ``only`` that one
    placeholder is filled and all other braces stay as they are. A field that
    is null makes the prompt null.
    """
    if only is not None:
        first, *rest = template.split("{" + only + "}")
        out = [F.lit(first)]
        for part in rest:
            out += [fields[only].cast("string"), F.lit(part)]
        return F.concat(*out)
    out = [F.lit("")]
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            out.append(F.lit(literal))
        if name is not None:
            if name not in fields:
                raise KeyError(f"missing placeholder {name!r}")
            out.append(fields[name].cast("string"))
    return F.concat(*out)


def fill_loose(template: str, source_item: Column, known: list[str]) -> Column:
    """Render from a source item; unknown or missing values become ``''``.

    ``{problem_typeN}`` and ``{eval_goalN}`` pick the N-th list entry.
    ``known`` names the text fields the struct has.
    """
    out = [F.lit("")]
    for i, part in enumerate(_LOOSE_FIELD.split(template)):
        if i % 2 == 0:
            if part:
                out.append(F.lit(part))
            continue
        listed = re.fullmatch(r"(problem_type|eval_goal)(\d+)", part)
        if listed:
            value = F.get(source_item[listed[1] + "s"], F.lit(int(listed[2]) - 1))
        elif part in known:
            value = source_item[part].cast("string")
        else:
            continue
        out.append(F.coalesce(value, F.lit("")))
    return F.concat(*out)


def render_prompt(
    df: DataFrame,
    template: str,
    strict: bool = True,
    to: str = "prompt",
    item: str = "source_item",
    only: str | None = None,
) -> DataFrame:
    """Add a rendered prompt column.

    ``strict`` takes placeholders from the columns of ``df`` and fails at plan
    time if one is missing; a prompt is null where one of its columns is.
    Otherwise placeholders come from the ``item`` struct. ``only`` names the
    one column to fill in templates whose other braces are text.
    """
    if strict:
        return df.withColumn(to, fill(template, {c: F.col(c) for c in df.columns}, only))
    fields = df.schema[item].dataType
    plain = [f.name for f in fields if f.dataType.typeName() not in ("array", "struct", "map")]
    return df.withColumn(to, fill_loose(template, F.col(item), plain))


def source_prompt(item: Column, problem_types: Column, eval_goals: Column) -> Column:
    """Prompt asking for a passage about one source item."""
    names = ["korean_topic", "foreign_topic", "korean_context", "foreign_context"]
    fields = {n: F.coalesce(item[n], F.lit("")) for n in names}
    fields["problem_types"] = F.array_join(problem_types, ", ")
    fields["eval_goals"] = F.array_join(eval_goals, ", ")
    return fill(V.SOURCE_PROMPT, {k: F.coalesce(v, F.lit("")) for k, v in fields.items()})


def margin_prompt(rubric: Column, of: Callable[[Column], Column] = lambda text: text) -> Column:
    """Prompt of a score-gap pair: fixed guidelines and the rubric's text; or a function of it, taken once per rubric."""
    out = None
    for name in V.RUBRICS:
        text = V.MARGIN_PROMPT.format(
            problem_types=V.DEFAULT_PROBLEM_TYPES,
            eval_goals=V.DEFAULT_EVAL_GOALS,
            description=V.RUBRIC_DESCRIPTIONS[name],
            name=V.RUBRIC_NAMES[name],
        )
        out = (F if out is None else out).when(rubric == name, of(F.lit(text)))
    return out


def chat_text(prompt: Column, response: Column) -> Column:
    """A user turn and an assistant turn with their header tokens."""
    return fill(V.CHAT_TEXT, {"prompt": prompt, "response": response})


def context_page(title: Column, summary: Column, n: int = 500) -> Column:
    """One page of a context block."""
    return fill(V.PAGE_TEXT, {"title": title, "summary": F.substring(summary, 1, n)})


def source_key(item: Column) -> Column:
    """``korean_topic||foreign_topic``, missing parts as N/A."""
    return F.concat_ws(
        "||",
        F.coalesce(item["korean_topic"], F.lit(V.MISSING)),
        F.coalesce(item["foreign_topic"], F.lit(V.MISSING)),
    )


def group_key(df: DataFrame, item: str = "source_item") -> Column:
    """First usable value of the fields that can name a benchmark item.

    Empty text and the number zero do not count; null if nothing does.
    """
    out = []
    types = {f.name: f.dataType for f in df.schema[item].dataType}
    for name in ("korean_topic", "topic", "item_id", "benchmark_id"):
        if name in types:
            c = F.col(item)[name]
            empty = F.lit("") if types[name].typeName() == "string" else F.lit(0)
            out.append(F.nullif(c, empty).cast("string"))
    return F.coalesce(*out)


def passage_text(df: DataFrame) -> Column:
    """``text``, else ``generated_passage``, else ``''``."""
    found = [F.col(c) for c in ("text", "generated_passage") if c in df.columns]
    return F.coalesce(*found, F.lit(""))
