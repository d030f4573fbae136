"""Packing documents into sequences by linear grouping.

The lengths of pieces lie between 1 and the sequence length, so all that
planning needs is how many there are of each: a histogram of bounded size, which
comes to the driver. Large lengths are sorted, cut into groups of equal
cardinality and rounded up to the largest of their group; for these few sizes
configurations of a sequence are optimised by a linear program with column
generation. Then each group's actual pieces take the places of their group, and
small ones go where they fit best. The plan consists of runs: so many pieces of
a length into consecutive sequences. Documents find their run by their length
and their number among pieces of that length; they never leave their tasks.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import staged
from pairloom.llm.tokens import tokenizer

#: Tokens of a sequence; groups of large lengths; lengths above this share of a sequence are large.
LENGTH, GROUPS, LARGE = 4096, 48, 1 / 8
#: Words that a worker remembers the ids of.
REMEMBERED = 700_000


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Ids(dict):
    """Ids of words as little-endian 32-bit numbers, for tokenizers that drop white space and cross no word.

    A word met for the first time is encoded and remembered.
    """

    #: White space to Python but not to Unicode (fixed values).
    ODD = re.compile("[\x1c-\x1f]")
    #: Words that are a stretch of letters, a stretch of marks or one after the other: the letters are in normal
    #: form, each has one small letter wherever it stands, and neither stretch is ever cut (fixed values).
    SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!#$%&*+,./:;=?@^_~|-]*)")

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.stems: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        letters = "".join(map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = {ord(c): "".join(part for part, _ in split(c)) for c in letters}

    def encode(self, text: str) -> bytes:
        return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def stem(self, letters: str) -> bytes:
        """Ids of small letters, straight from the tokenizer's model: they need no other step."""
        ids = self.stems.get(letters)
        if ids is None:
            if len(self.stems) >= REMEMBERED:
                self.stems.clear()
            found = self.tokenizer.model.tokenize(letters if letters.isascii() else letters.translate(self.letters))
            ids = self.stems[letters] = pack_ids([t.id for t in found])
        return ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if m := self.SIMPLE.fullmatch(word):
            letters, marks = m.groups()
            end = self.marks.get(marks)
            if end is None:
                end = self.encode(marks)
                if len(self.marks) < REMEMBERED:
                    self.marks[marks] = end
            ids = self.stem(letters.lower()) + end if letters else end
        else:
            ids = self.encode(word)
        self[word] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.ODD.search(text):
            return b"".join([self[w] for w in re.split("[ \t-\r]+", text) if w])
        return b"".join(map(self.__getitem__, text.split()))


def cut(path: str, end: int, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, text) to pieces, numbered among those of their length in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, numbers = Ids(path), TaskContext.get().partitionId(), Counter()
        last = pack_ids([end])
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = []
                for k, text in enumerate(part["text"].to_pylist()):
                    raw = ids.of(text) + last
                    for piece, a in enumerate(range(0, len(raw), 4 * length)):
                        some = raw[a : a + 4 * length]
                        n = len(some) // 4
                        rows.append((k, piece, a // 4, n, zlib.crc32(some), task, numbers[n]))
                        numbers[n] += 1
                at, *rest = zip(*rows, strict=True) if rows else ((),) * 7
                kinds = dict.fromkeys(("piece", "start", "length", "ids_crc32", "task", "number"), pa.int64())
                kinds |= {"piece": pa.int32(), "task": pa.int32()}
                yield pa.RecordBatch.from_pydict(
                    {"id": part["id"].take(pa.array(at, pa.int64()))}
                    | {c: pa.array(v, kind) for (c, kind), v in zip(kinds.items(), rest, strict=True)}
                )

    return run


class Run(NamedTuple):
    """Pieces ``first`` to ``first + count`` of a length: ``each`` into every sequence from ``sequence`` on, at ``offset``."""

    length: int
    first: int
    count: int
    each: int
    sequence: int
    offset: int


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths, largest first, in groups of equal cardinality: the rounded length, and how many there are of which."""
    total = sum(counts.values())
    size = -(-total // groups)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append((length, []))
                room = size
            some = min(n, room)
            out[-1][1].append((length, some))
            n -= some
            room -= some
    merged: dict[int, list[tuple[int, int]]] = {}
    for rounded, members in out:  # groups of one length are one size
        merged.setdefault(rounded, []).extend(members)
    return list(merged.items())


def best_pattern(sizes: list[int], price: np.ndarray, length: int) -> tuple[float, np.ndarray]:
    """The configuration worth most at these prices (unbounded knapsack by dynamic programming)."""
    worth, took = np.zeros(length + 1), np.full(length + 1, -1)
    order = np.array(sizes)
    for room in range(min(sizes), length + 1):
        fit = order <= room
        value = np.where(fit, worth[np.maximum(room - order, 0)] + price, -1.0)
        k = int(value.argmax())
        if value[k] > worth[room - 1]:
            worth[room], took[room] = value[k], k
        else:
            worth[room] = worth[room - 1]
    pattern, room = np.zeros(len(sizes), np.int64), length
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= sizes[took[room]]
    return float(worth[length]), pattern


def configurations(sizes: list[int], need: list[int], length: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Configurations and how many sequences have each, enough for all that is needed.

    Column generation from configurations of one size; the basis inverse is kept
    and updated. What rounding the solution down leaves open is filled greedily.
    """
    m = len(sizes)
    patterns = np.diag([length // s for s in sizes]).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(patterns))
    x = inverse @ np.array(need, float)
    for _ in range(rounds):
        price = np.maximum(inverse.sum(0), 0)
        worth, new = best_pattern(sizes, price, length)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ new
        up = step > 1e-9
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        patterns[:, out] = new
    left = np.array(need, np.int64)
    chosen = []
    for k in range(m):
        n = int(x[k] + 1e-9)
        hit = patterns[:, k] > 0
        if n > 0 and hit.any():
            chosen.append((patterns[:, k].copy(), n))
            left -= n * patterns[:, k]
    left = np.maximum(left, 0)
    while left.any():  # fewer than a sequence for each size is left: first fit, largest first
        pattern, room = np.zeros(m, np.int64), length
        for k in np.argsort(sizes)[::-1]:
            pattern[k] = min(left[k], room // sizes[k])
            room -= pattern[k] * sizes[k]
        n = int(min(left[pattern > 0] // pattern[pattern > 0]))
        chosen.append((pattern, n))
        left -= n * pattern
    return chosen


def plan(counts: dict[int, int], length: int = LENGTH, groups: int = GROUPS, large: float = LARGE) -> list[Run]:
    """Runs that place every piece of the histogram ``counts`` (length to number)."""
    runs: list[Run] = []
    used: Counter[int] = Counter()  # pieces of each length that have a place
    segments: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: stretches (first sequence, number)
    sequences = 0

    def place(size: int, n: int, each: int, at: int, offset: int) -> None:
        runs.append(Run(size, used[size], n, each, at, offset))
        used[size] += n

    big = {s: n for s, n in counts.items() if s > length * large}
    classes = grouped(big, groups)
    if classes:
        queues = [list(members) for _, members in classes]
        for pattern, number in configurations([c for c, _ in classes], [sum(n for _, n in q) for q in queues], length):
            stretches = [(sequences, number, 0)]  # first sequence, number, tokens used
            sequences += number
            for k in np.flatnonzero(pattern).tolist():
                for _ in range(pattern[k]):
                    cut_up = []
                    for first, n, used_up in stretches:
                        while n and queues[k]:
                            size, there = queues[k][0]
                            some = min(n, there)
                            place(size, some, 1, first, used_up)
                            cut_up.append((first, some, used_up + size))
                            first, n = first + some, n - some
                            queues[k][0] = (size, there - some)
                            if there == some:
                                queues[k].pop(0)
                        if n:
                            cut_up.append((first, n, used_up))
                    stretches = cut_up
            for first, n, used_up in stretches:
                segments[length - used_up].append((first, n))

    for size in sorted((s for s in counts if s not in big), reverse=True):
        left = counts[size]
        for room in sorted(r for r in segments if r >= size):  # the tightest room first
            while left and segments.get(room):
                first, n = segments[room].pop()
                each = min(room // size, left)
                some = min(n, left // each)
                place(size, some * each, each, first, length - room)
                left -= some * each
                segments[room - each * size].append((first, some))
                if some < n:
                    segments[room].append((first + some, n - some))
            if not segments.get(room):
                segments.pop(room, None)
            if not left:
                break
        if left:
            each = min(length // size, left)
            some, rest = divmod(left, each)
            place(size, some * each, each, sequences, 0)
            segments[length - each * size].append((sequences, some))
            sequences += some
            if rest:
                place(size, rest, rest, sequences, 0)
                segments[length - rest * size].append((sequences, 1))
                sequences += 1
    return runs


#: Runs that are handed to every task; their number hangs on the lengths, not on the documents.
MOST_RUNS = 200_000


def pack(
    docs: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, groups: int = GROUPS
) -> DataFrame:
    """A row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A document's ids are those of its text and ``end``; only documents above
    ``length`` are cut. A null or empty text is the one id ``end``, a null id
    stays null, repeated rows are packed each, an empty table gives an empty
    one. Tokens of a sequence follow each other from 0 without gaps.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, number bigint"
    pieces = staged(base.mapInArrow(cut(path, end, length), schema), "pieces")

    by_task = pieces.groupBy("task", "length").agg((F.max("number") + 1).alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(histogram, length, groups)
    table = spark.createDataFrame(runs, "length long, first long, count long, each long, sequence long, offset long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    offsets = by_task.select("task", "length", before.alias("before"))
    ranked = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("before") + F.col("number"))

    table = table.select(F.col("length").alias("size"), "first", "count", "each", "sequence", F.col("offset").alias("at"))
    if len(runs) <= MOST_RUNS:
        table = F.broadcast(table)
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count"))
    k = F.col("rank") - F.col("first")
    return ranked.join(table, (F.col("length") == F.col("size")) & inside).select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.expr("(rank - first) div each")).alias("sequence_id"),
        (F.col("at") + k % F.col("each") * F.col("length")).alias("offset"),
    )
