"""Token counts: overlapping chunks spliced at stable boundaries."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import Texts, per_text, staged, staged_with

#: White space as Unicode defines it (fixed values); Python's own ``\s`` has four more characters.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Stretches no token crosses: a word with the blank before it, or white space.
STRETCH = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A place between a word and white space: a token ends there whatever stands around it.
STABLE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")

#: Chunk length and first overlap, in characters; stretches remembered by a worker.
CHUNK, OVERLAP, REMEMBERED = 65_536, 512, 400_000


@functools.cache
def tokenizer(path: str) -> Any:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Counts(dict):
    """Tokens of stretches; one met for the first time is counted and remembered."""

    #: Stretches of letters, of marks, or of letters and then marks: the tokenizer cuts them there and nowhere else
    #: (fixed values).
    LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[!#$%&*+,./:;=?@^_~|-]"
    SIMPLE = re.compile(f"( ?{LETTERS}+)({MARKS}*)|( ?{MARKS}+)")

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.parts: dict[str, int] = {}
        letters = [chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha()]
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.bytes = {ord(c): "".join(part for part, _ in split(c)) for c in [" ", *letters]}
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None

    def part(self, text: str) -> int:
        """Tokens of letters or marks, straight from the tokenizer's model: they need no other step."""
        n = self.parts.get(text)
        if n is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            n = self.parts[text] = len(self.tokenizer.model.tokenize(text.translate(self.bytes)))
        return n

    def __missing__(self, stretch: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        if m := self.SIMPLE.fullmatch(stretch):
            n = sum(self.part(x) for x in m.groups() if x)
        else:
            n = len(self.tokenizer.encode(stretch, add_special_tokens=False).ids)
        self[stretch] = n
        return n

    def one(self, text: str) -> int:
        """Tokens of a text; one with an added token is encoded whole: white space before it ends its section."""
        if self.added and self.added.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, STRETCH.findall(text)))

    def of(self, texts: Texts) -> dict[str, Any]:
        return {"n_tokens": [self.one(t) if t else 0 for t in texts]}


def seams(text: str, chunk: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Chunks as (from, to, first seam, last seam), overlapping their neighbours.

    A seam is the first stable boundary past a multiple of ``chunk``. Both
    neighbours must hold it and the next one, by which they are compared; the
    overlap is doubled until they do. Where the text has none left, the chunk
    runs to its end.
    """
    out, start, seam, at = [], 0, 0, chunk
    while at < len(text):
        wide, found = overlap, []
        while True:
            found = [m.start() for _, m in zip(range(2), STABLE.finditer(text, at, min(len(text), at + wide)), strict=False)]
            if len(found) == 2 or at + wide >= len(text):
                break
            wide *= 2
        if len(found) < 2:
            break
        out.append((start, min(len(text), found[1] + overlap), seam, found[0]))
        start, seam = max(0, found[0] - overlap), found[0]
        at = max(at + chunk, found[1] + 1)
    return [*out, (start, len(text), seam, len(text))]


def cut(chunk: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, n_bytes, row, text) to rows (id, n_bytes, row, seq, n, part, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                text = batch["text"][r].as_py()
                found = seams(text, chunk, overlap)
                for i in range(0, len(found), 64):
                    some = found[i : i + 64]
                    columns = {c: batch[c].take(pa.array([r] * len(some))) for c in ("id", "n_bytes", "row")} | {
                        "seq": pa.array(range(i, i + len(some)), pa.int32()),
                        "n": pa.array([len(found)] * len(some), pa.int32()),
                        "part": pa.array([text[a:b] for a, b, _, _ in some]),
                        "low": pa.array([p - a for a, _, p, _ in some], pa.int64()),
                        "high": pa.array([q - a for a, _, _, q in some], pa.int64()),
                    }
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def encode_chunks(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``cut`` to the tokens that each chunk owns, and those behind its seams."""

    def behind(part: str, seam: int, tokens: list[tuple[int, int]]) -> str:
        """Tokens from a seam to the next stable boundary; places are counted from the seam."""
        end = next(m.start() for m in STABLE.finditer(part, seam + 1))
        return ",".join(f"{at - seam}:{i}" for at, i in tokens if seam <= at < end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for batch in batches:
            own, left, right = [], [], []
            for x in batch.select(["seq", "n", "part", "low", "high"]).to_pylist():
                found = encode(x["part"], add_special_tokens=False)
                tokens = [(a, i) for (a, _), i in zip(found.offsets, found.ids, strict=True)]
                first, last = x["seq"] == 0, x["seq"] == x["n"] - 1
                own.append(sum((first or a >= x["low"]) and (last or a < x["high"]) for a, _ in tokens))
                left.append(None if first else behind(x["part"], x["low"], tokens))
                right.append(None if last else behind(x["part"], x["high"], tokens))
            yield pa.RecordBatch.from_pydict(
                {c: batch[c] for c in ("id", "n_bytes", "row", "seq", "n")}
                | {"tokens": pa.array(own, pa.int64()), "left": pa.array(left, pa.string()), "right": pa.array(right, pa.string())}
            )

    return run


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """Tokens of every whole text: id, ``n_bytes``, ``n_tokens``.

    Texts up to ``chunk`` characters are counted where they are read. Longer
    ones are cut into overlapping chunks that spread over all tasks; each is
    encoded with offsets, and neighbours are spliced at a boundary that holds
    in any context. Neighbours must give the same tokens behind their seam;
    texts where they don't are cut anew with twice the overlap, up to the whole
    text, and so is an overlap without a usable boundary beforehand.

    For tokenizers whose tokens cross no end of a word. A null text has no
    tokens and no bytes, a null id stays null, repeated rows stay apart, an
    empty table gives an empty one.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    base = docs.select(F.col(id_col).alias("id"), size.alias("n_bytes"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    count = per_text(lambda: Counts(path).of, {"n_tokens": "bigint"})
    short = base.filter(~long).select("id", "n_bytes", count("text").alias("c")).select("id", "n_bytes", "c.n_tokens")

    huge = staged(base.filter(long), "long-texts")  # rows get their number from files: a task that runs again numbers alike
    parts, todo, wide = [short], huge.withColumn("row", F.monotonically_increasing_id()), overlap
    todo = staged(todo, "long-texts")
    while True:
        found, seen = staged_with(spliced(todo, path, chunk, wide), "spliced", apart=F.count_if(~F.col("fits")))
        parts.append(found.filter("fits").select("id", "n_bytes", "n_tokens"))
        if not seen["apart"]:
            break
        todo, wide = todo.join(found.filter("not fits").select("row"), "row").select(todo.columns), 2 * wide
    counted = functools.reduce(DataFrame.unionByName, parts)
    return counted.withColumnRenamed("id", id_col)


def spliced(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Rows (row, id, n_bytes, n_tokens, fits) of long texts; ``fits`` if all neighbours agree behind their seams."""
    kept = f"id {huge.schema['id'].dataType.simpleString()}, n_bytes bigint, row bigint, seq int, n int"
    chunks = huge.mapInArrow(cut(chunk, overlap), f"{kept}, part string, low bigint, high bigint")
    counted = chunks.repartition("row", "seq").mapInArrow(
        encode_chunks(path), f"{kept}, tokens bigint, left string, right string"
    )
    sides = F.array_sort(F.collect_list(F.struct("seq", "left", "right")))  # as many as the text has chunks
    whole = counted.groupBy("row").agg(
        *[F.first(c).alias(c) for c in ("id", "n_bytes", "n")], F.sum("tokens").alias("n_tokens"), sides.alias("s")
    )
    agree = F.forall(F.sequence(F.lit(0), F.col("n") - 2), lambda i: F.col("s")[i]["right"] == F.col("s")[i + 1]["left"])
    fits = F.when(F.col("n") == 1, True).otherwise(agree)
    return whole.select("row", "id", "n_bytes", "n_tokens", fits.alias("fits"))
