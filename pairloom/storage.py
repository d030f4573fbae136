"""Shared folder for intermediate tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    that names none gets a temporary folder; a cluster session is refused,
    because a machine-local folder dies with its machine.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        found = tempfile.mkdtemp(prefix="pairloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once and go on from the written rows.

    Needed where a value depends on how rows happened to be partitioned: a
    lost executor must not lead to a second, different answer.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, compression: str | None = None, **measures: Column) -> tuple[DataFrame, dict[str, Any]]:
    """``df`` as a table in the shared folder, and aggregates taken while its rows are written."""
    path, seen = new_path(df.sparkSession, name), Observation()
    rows = df.observe(seen, *[c.alias(k) for k, c in measures.items()]) if measures else df
    rows.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get if measures else {}
