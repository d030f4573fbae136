"""Request and response tables of an external batch chat service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import values as V


def build_requests(
    prompts: DataFrame,
    model: str,
    key: str = "request_key",
    temperature: float | None = None,
    max_tokens: int | None = None,
    **more,
) -> DataFrame:
    """One chat request per row.

    Rows hold ``messages`` (an array of role and content) or one user
    ``prompt``. ``key`` is a stable id of the row; the custom id is made from
    it, so a rerun gives the same ids however rows are spread. ``more`` adds
    to or replaces fields of the body.
    """
    if "messages" in prompts.columns:
        messages = F.col("messages")
    else:
        messages = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    fields = {
        "model": F.lit(model),
        "messages": messages,
        "temperature": F.lit(temperature).cast("double"),
        "max_tokens": F.lit(max_tokens).cast("int"),
        **{name: F.lit(value) for name, value in more.items()},
    }
    return prompts.select(
        F.concat(F.lit("request_"), F.col(key).cast("string")).alias("custom_id"),
        F.lit(V.CHAT_METHOD).alias("method"),
        F.lit(V.CHAT_URL).alias("url"),
        F.struct(*[c.alias(n) for n, c in fields.items()]).alias("body"),
    )


def request_lines(requests: DataFrame) -> DataFrame:
    """The requests as JSON lines, nulls written out."""
    line = F.to_json(F.struct(*requests.columns), {"ignoreNullFields": "false"})
    return requests.select("custom_id", line.alias("line"))


def response_content(response: str | Column = "response") -> Column:
    """Text of the first choice, or null."""
    r = F.col(response) if isinstance(response, str) else response
    return F.get(r["body"]["choices"], F.lit(0))["message"]["content"]


def failure(responses: DataFrame) -> Column:
    """Why a response has no text: its error message or code, else its status, else null."""
    error = F.lit(None).cast("string")
    if "error" in responses.columns:
        error = F.coalesce(F.nullif(F.col("error.message"), F.lit("")), F.col("error.code"))
    if "status_code" in responses.schema["response"].dataType.names:
        error = F.coalesce(error, F.concat(F.lit("status "), F.col("response.status_code")))
    return F.when(response_content().isNull(), error)


def join_responses(requests: DataFrame, responses: DataFrame, reason: str = "no response") -> DataFrame:
    """Add the answer to every request, matched by custom id.

    A request without answer gets an error text with the cause that its
    response gives, or ``reason``. Of several answers to one request the
    greatest text is taken, whatever order files arrive in.
    """
    answers = responses.select("custom_id", response_content().alias("response"), failure(responses).alias("_why"))
    answers = answers.groupBy("custom_id").agg(F.max("response").alias("response"), F.max("_why").alias("_why"))
    before, after = V.REQUEST_ERROR.split("{reason}")
    error = F.concat(F.lit(before), F.coalesce("_why", F.lit(reason)), F.lit(after))
    joined = requests.join(answers, "custom_id", "left")
    return joined.withColumn("response", F.coalesce("response", error)).drop("_why")
