"""Sharding by a keyed permutation of row numbers, in DataFrame functions only.

Rows are numbered from 0 without gaps. A Feistel network over pairs of residues
permutes these numbers; where it leaves their range, it is applied again until it
is back (cycle walking). The place found that way gives shard and slot by plain
arithmetic: counts differ by one at most, and a reader that knows the number of
rows, the key and a row's number can compute where the row is.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.common import staged_with

#: Rounds of the network, and the prime its round function reckons with (its square fits into a long).
ROUNDS, PRIME = 6, 2_147_483_647
#: Buckets in which rows are numbered; each is sorted by one task.
BUCKETS = 16_384


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Two numbers below ``PRIME`` for each round, from a multiplicative generator."""
    out, x = [], seed % (PRIME - 1) + 1
    for _ in range(rounds):
        a = x = x * 48_271 % PRIME
        b = x = x * 48_271 % PRIME
        out.append((a, b))
    return out


def sides(n: int) -> tuple[int, int]:
    """A rectangle close to a square that holds n numbers, and fewer than its longer side besides."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """One pass of the network over ``column``: a permutation of the numbers in the rectangle of ``n``.

    A number is read as two residues. Each round adds a function of one to the
    other, in turn, so every round can be undone. The steps are columns of their
    own: written into each other they would double with every round.
    """
    a, b = sides(n)
    df = df.withColumns({"_l": F.expr(f"`{column}` div {b}"), "_r": F.expr(f"`{column}` % {b}")})
    for i, (add, times) in enumerate(round_keys(seed)):
        (into, side), of = (("_l", a), "_r") if i % 2 == 0 else (("_r", b), "_l")
        df = df.withColumn("_s", F.expr(f"({of} + {add}L) % {PRIME}L"))
        df = df.withColumn(into, F.expr(f"({into} + _s * _s % {PRIME}L * {times}L % {PRIME}L) % {side}L"))
    return df.withColumn(column, F.expr(f"_l * {b}L + _r")).drop("_l", "_r", "_s")


def walks(spark: SparkSession, n: int, seed: int) -> int:
    """How often the network must be applied again until every number below ``n`` is back.

    Walks lead through the numbers outside the range, which are fewer than the
    root of ``n``: the longest one among them is the longest of all.
    """
    a, b = sides(n)
    outside, steps = spark.range(n, a * b).select(F.col("id").alias("x")), 0
    while n and outside.limit(1).count():
        outside = permuted(outside, "x", n, seed).filter(F.col("x") >= n)
        steps += 1
    return steps


def places(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """Replace row numbers 0 to n - 1 by their places in the shuffled order."""
    out = permuted(df, column, n, seed)
    for _ in range(walks(df.sparkSession, n, seed)):
        out = permuted(out.withColumn("_was", F.col(column)), column, n, seed)
        out = out.withColumn(column, F.when(F.col("_was") < n, F.col("_was")).otherwise(F.col(column))).drop("_was")
    return out


def shard(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """A row per document: id, ``size``, ``text_crc32``, ``row_number``, ``law`` ('rows'), ``shard``, ``slot``, ``grown_shard`` (null).

    Row numbers follow buckets of a digest and, inside them, the id. Rows that
    are alike in id, size and checksum are interchangeable, so the result does
    not hang on how they were read. ``size`` is the number of UTF-8 bytes (null
    text: none) and 8. Null ids are spread by size and checksum.
    """
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"),
    )
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "id", "size", "crc")), 1, 8), 16, 10).cast("long")
    base = base.withColumn("bucket", drawn % buckets)
    base, seen = staged_with(base, "rows", n=F.count("*"))
    n = seen["n"]
    counts = base.groupBy("bucket").agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.orderBy("bucket")) - F.col("n")  # as many rows as there are buckets
    offsets = counts.select("bucket", running.alias("before"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("id", "size", "crc")) - 1
    numbered = base.withColumn("inside", inside).join(offsets, "bucket")
    numbered = numbered.select("id", "size", "crc", (F.col("before") + F.col("inside")).alias("row_number"))
    placed = places(numbered.withColumn("place", F.col("row_number")), "place", n, seed)
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "row_number",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
