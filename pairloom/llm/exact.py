"""Exact deduplication by naming blocks and pairs of names.

A text is cut into blocks of fixed size. Blocks are sorted, and equal ones get
one integer name. Adjacent names are then paired, equal pairs get one name, and
so on until every document has a single name. Names stand for equality of bytes,
not for hashes: two documents have the same name exactly if their texts are the
same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import one_row_each, staged, staged_with

#: Bytes of a block, and bytes of blocks in which a task looks for equal ones before they are shuffled.
BLOCK, TOGETHER = 16_384, 32 << 20


def cut(block: int, together: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, text) to a row for each block, all of which have a number of their own.

    ``first`` is the number of an equal block that the task has read shortly
    before; only the first one carries its bytes. They are compressed, always
    in the same way, so equal and unequal blocks stay so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        number, row = TaskContext.get().partitionId() << 33, TaskContext.get().partitionId() << 33
        seen: dict[bytes, int] = {}
        held = 0
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                at: list[int] = []
                rows: list[tuple] = []
                for k, text in enumerate(part["text"].to_pylist()):
                    data = (text or "").encode()
                    n = max(1, -(-len(data) // block))
                    for pos in range(n):
                        own = squeeze(data[pos * block : (pos + 1) * block])
                        if (first := seen.get(own)) is None:
                            if held + len(own) > together:
                                seen, held = {}, 0
                            seen[own] = first = number
                            held += len(own)
                        sha = hashlib.sha256(data).hexdigest() if pos == 0 else None
                        at.append(k if pos == 0 else None)
                        rows.append((row, n, pos, number, first, sha, own if first == number else None))
                        number += 1
                    row += 1
                names = ("row", "n", "pos", "number", "first", "sha", "block")
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                columns = zip(*rows, strict=True) if rows else ((),) * len(names)
                yield pa.RecordBatch.from_pydict(
                    {"id": part["id"].take(pa.array(at, pa.int64()))}
                    | {c: pa.array(list(v), kind) for c, v, kind in zip(names, columns, kinds, strict=True)}
                )

    return run


def name_pairs(level: DataFrame) -> DataFrame:
    """Names one level up: two neighbours of a document become one name.

    The name of a pair is the smallest number of those that are equal. Pairs
    are counted together before they are shuffled, and the join that hands out
    names can be split where one pair is very frequent.
    """
    even = F.col("pos") % 2 == 0
    pairs = (
        level.groupBy("row", F.expr("pos div 2").alias("pos"))
        .agg(
            F.max("id").alias("id"),
            F.max("sha").alias("sha"),
            F.first("n").alias("n"),
            F.max(F.when(even, F.col("number"))).alias("number"),
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
        )
        .withColumn("n", F.expr("(n + 1) div 2"))
    )
    names = pairs.groupBy("a", "b").agg(F.min("number").alias("name"))
    return pairs.join(names, ["a", "b"]).drop("a", "b")


def identities(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, together: int = TOGETHER
) -> DataFrame:
    """Every document's row number, id, ``sha`` and its name, which is a pair of ``level`` and ``name``."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    schema = f"id {kind}, row bigint, n bigint, pos bigint, number bigint, first bigint, sha string, block binary"
    blocks = staged(base.mapInArrow(cut(block, together), schema), "blocks")

    # bytes give the names, and are put together before they move; a digest only leads from a block to its name
    sent = blocks.filter("block is not null")
    names = sent.groupBy("block").agg(F.min("number").alias("name")).select(F.sha2("block", 256).alias("key"), "name")
    names = names.groupBy("key").agg(F.min("name").alias("name"), F.max("name").alias("other"))
    clash = F.raise_error(F.lit("two blocks have one SHA-256"))
    names = names.select("key", F.when(F.col("name") == F.col("other"), F.col("name")).otherwise(clash).cast("long").alias("name"))
    named = sent.select("first", F.sha2("block", 256).alias("key")).join(names, "key").drop("key")
    level, depth = blocks.drop("block").join(named, "first").drop("first"), 0
    columns = ["id", "sha", "row", "n", "pos", "number", "name"]
    level, seen = staged_with(level.select(columns), "names", longest=F.max("n"))
    out = []
    while True:
        out.append(level.filter("n = 1").select("row", "id", "sha", F.lit(depth).alias("level"), "name"))
        if (seen["longest"] or 0) < 2:
            break
        depth += 1
        level, seen = staged_with(name_pairs(level.filter("n > 1")).select(columns), "names", longest=F.max("n"))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, together: int = TOGETHER
) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest id stays; of rows that repeat this
    id, one. Null counts as the empty text, a null id as smaller than any. An
    empty table gives an empty one.
    """
    found = identities(docs, id_col, text_col, block, together)
    groups = found.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("keep"))
    return found.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, together: int = TOGETHER
) -> DataFrame:
    """Of equal texts the document with the largest id, with all its columns; of rows that repeat it, one."""
    found = exact_duplicates(docs, id_col, text_col, block, together)
    rows = found.groupBy(id_col, "text_sha256").agg(F.count("*").alias("rows"), F.max("kept").alias("kept"))
    keep = rows.filter("kept").select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"), "rows")
    key = {"id": F.col(id_col), "sha": F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)}
    return one_row_each(docs, keep, key)
