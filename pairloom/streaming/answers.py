"""One answer for each request out of a running stream, without a batch step afterwards."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pairloom.operators.responses import parse_scores
from pairloom.schemas import CHAT_RESPONSE
from pairloom.sources.requests import response_content

#: What ``transformWithState`` keeps its state in.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "custom_id string, response string, late boolean"


class Held(StatefulProcessor):
    """The greatest answer of an id, held until its time has passed; then a mark that it is out, for as long again."""

    def __init__(self, within: int):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "response string")
        self.told = handle.getValueState("told", "since long")

    def rows(self, key: Any, responses: list[str | None], late: bool) -> pd.DataFrame:
        texts = {"custom_id": [key[0]] * len(responses), "response": responses}
        return pd.DataFrame(texts, dtype="object").assign(late=pd.Series([late] * len(responses), dtype="bool"))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        told, known = self.told.exists(), self.best.exists()
        best, late = self.best.get()[0] if known else None, []
        for frame in rows:
            for response, arrived in zip(frame["response"], frame["arrived"], strict=True):
                response = None if pd.isna(response) else response
                if told:
                    late.append(response)
                    continue
                if not known:
                    self.handle.registerTimer(int(pd.Timestamp(arrived).value // 1_000_000) + self.within)
                if not known or best is None or response is not None and response > best:
                    best = response
                known = True
        if known and not told:
            self.best.update((best,))
        yield self.rows(key, late, True)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.best.exists():
            self.told.clear()
            return
        yield self.rows(key, [self.best.get()[0]], False)
        self.best.clear()
        now = expiredTimerInfo.getExpiryTimeInMs()
        self.told.update((now,))
        self.handle.registerTimer(now + self.within)


def stream_answers(spark: SparkSession, folder: str, within_seconds: int, files_per_batch: int = 1000) -> DataFrame:
    """One row per custom id out of response files in ``folder``: ``custom_id``, ``response`` and ``late``.

    The first answer to a request starts its time; the greatest one that
    arrives within it comes out when files show that it has passed, once. An
    answer that comes after that is a row of its own, marked ``late``. State is
    a row for each request whose time runs, and a mark for as long again, so it
    shrinks as requests are done. What is still held when the stream stops
    comes out when it goes on. Times are those of the files.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = (
        spark.readStream.schema(CHAT_RESPONSE)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
        .select("custom_id", response_content().alias("response"), F.col("_metadata.file_modification_time").alias("arrived"))
        .where(F.col("custom_id").isNotNull())
        .withWatermark("arrived", "0 seconds")
    )
    return rows.groupBy("custom_id").transformWithStateInPandas(
        Held(within_seconds * 1000), outputStructType=SCHEMA, outputMode="append", timeMode="eventTime"
    )


def write_answers(
    answers: DataFrame,
    path: str,
    late_path: str,
    checkpoint: str,
    parse: Callable[[DataFrame], DataFrame] = parse_scores,
    once: bool = True,
) -> StreamingQuery:
    """Parsed answers below ``path``, late ones as they came below ``late_path``, a folder for each batch.

    A batch that runs again replaces its folders, so a restart neither repeats
    nor loses an id.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        parse(batch.where("not late").drop("late")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.where("late").drop("late").write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        batch.unpersist()

    writer = answers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
