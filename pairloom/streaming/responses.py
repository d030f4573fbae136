"""Judge responses parsed as their files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.responses import parse_scores
from pairloom.schemas import CHAT_RESPONSE
from pairloom.sources.requests import response_content


def stream_responses(
    spark: SparkSession,
    folder: str,
    within: str | None = None,
    files_per_batch: int = 1000,
    parse: Callable[[DataFrame], DataFrame] = parse_scores,
) -> DataFrame:
    """Parsed answers out of response files in ``folder``, equal ones of a custom id once.

    ``parse`` is any of the response parsers; they work row by row. Different
    answers to one request all come through, whichever file is read first:
    :func:`one_answer` then takes the greatest, as ``join_responses`` does.
    Without ``within`` the ids of
    the whole run are kept as state: fine for one batch of requests, on disk
    with the RocksDB state store. With it (for example ``"2 days"``) only ids
    seen that long before the newest file are kept, and state stays bounded.
    """
    rows = (
        spark.readStream.schema(CHAT_RESPONSE)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
        .select("custom_id", response_content().alias("response"), F.col("_metadata.file_modification_time").alias("arrived"))
        .where(F.col("custom_id").isNotNull())
    )
    if within is None:
        once = rows.dropDuplicates(["custom_id", "response"])
    else:
        once = rows.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["custom_id", "response"])
    return parse(once.drop("arrived"))


def one_answer(parsed: DataFrame) -> DataFrame:
    """Of the answers to one request that with the greatest text."""
    best = parsed.groupBy("custom_id").agg(F.max("response").alias("_best"))
    on = (F.col("custom_id") == F.col("_id")) & F.col("response").eqNullSafe(F.col("_best"))
    return parsed.join(best.withColumnRenamed("custom_id", "_id"), on).drop("_id", "_best")


def write_responses(parsed: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append parsed responses to Parquet.

    ``once`` takes what has arrived and ends; otherwise the query goes on.
    The checkpoint makes a restarted query continue without repeating rows.
    """
    writer = parsed.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
