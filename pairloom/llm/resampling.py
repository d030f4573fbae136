"""Importance resampling towards a target corpus by hashed n-grams.

Texts are brought to words with single spaces between them. One pattern then
runs over the text with overlapping matches: at every word, as its lookbehind
demands, a match begins, and its groups are the n-grams from that word on, each
up to a boundary. Their bytes go into CRC-32 as they stand, and the CRC modulo
the number of buckets is the feature. Bucket counts of the raw and the target
corpus give each bucket a gain; a document's weight is the mean gain of its
features, and Gumbel noise from its id turns weights into a draw without
replacement.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import staged, staged_with
from pairloom.operators.numbering import number_within

#: Words of the longest n-gram; buckets; documents of fewer words are not drawn; percent that is drawn; seed.
WORDS, BUCKETS, LEAST, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: Rows that one task ranks in any case.
STRETCH = 1024

#: Bytes of words as they count: digits, small letters and all bytes of non-ASCII characters stay, capitals become
#: small, all others separate (fixed values).
SMALL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain_words(text: str | None) -> bytes:
    """A text's words with single spaces between them, as UTF-8."""
    return b" ".join((text or "").encode().translate(SMALL).split())


def pattern(words: int):
    """Matches that begin at every word; group i holds what the i-th further word adds."""
    import regex

    more = b""
    for _ in range(words - 1):
        more = rb"(?:( [^ ]++)%b)?+" % more
    return regex.compile(rb"(?<![^ ])([^ ]++)%b(?![^ ])" % more)


def features(line: bytes, find: Callable) -> list[int]:
    """The CRC-32 of each n-gram of a line; that of a longer one goes on from the shorter one's."""
    out: list[int] = []
    for m in find(line, overlapped=True):
        crc = 0
        for more in m.groups():
            if more is None:
                break
            crc = crc32(more, crc)
            out.append(crc)
    return out


def kind(buckets: int) -> type:
    return np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")


def scan(words: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, text) to (id, n_words, n_features, features), the last one as packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, dtype = pattern(words).finditer, kind(buckets)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                lines = [plain_words(t) for t in part["text"].to_pylist()]
                found = [(np.array(features(w, find), np.uint32) % buckets).astype(dtype) for w in lines]
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": part["id"],
                        "n_words": pa.array([w.count(b" ") + (w != b"") for w in lines], pa.int64()),
                        "n_features": pa.array([len(f) for f in found], pa.int64()),
                        "features": pa.array([f.tobytes() for f in found], pa.binary()),
                    }
                )

    return run


def counted(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with ``features`` to how often a task met each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch["features"]:
                total += np.bincount(np.frombuffer(raw.as_buffer(), kind(buckets)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return run


def weighed(gains: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with ``features`` to (id, n_words, n_features, weight): the floored mean of their gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for raw in batch["features"]:
                own = np.frombuffer(raw.as_buffer(), kind(len(gains)))
                weights.append(int(gains[own].sum()) // len(own) if len(own) else 0)
            kept = {c: batch[c] for c in ("id", "n_words", "n_features")}
            yield pa.RecordBatch.from_pydict(kept | {"weight": pa.array(weights, pa.int64())})

    return run


def featured(docs: DataFrame, id_col: str, text_col: str, words: int, buckets: int) -> DataFrame:
    """Features of every document, written once: two bytes each, as one binary value."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind_ = base.schema["id"].dataType.simpleString()
    return staged(base.mapInArrow(scan(words, buckets), f"id {kind_}, n_words bigint, n_features bigint, features binary"), "features")


def bucket_counts(rows: DataFrame, buckets: int) -> DataFrame:
    each = rows.select("features").mapInArrow(counted(buckets), "bucket bigint, n bigint")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """What each bucket adds to a document's weight, in thousandths; buckets that neither corpus holds add that of none."""
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    seen = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # a row per bucket
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in seen:
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    ratio = (t + 1.0) * float(s.sum() + buckets) / ((s + 1.0) * float(t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, by the digest of seed and id."""
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((drawn.cast("double") + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_id: str = "item_id",
    target_text: str = "text",
    words: int = WORDS,
    buckets: int = BUCKETS,
    least: int = LEAST,
    percent: int = PERCENT,
    seed: int = SEED,
    stretch: int = STRETCH,
) -> DataFrame:
    """One row per document: id, ``n_features``, ``weight``, ``score`` and ``rank``, which is null for those not drawn.

    Of the documents with ``least`` words or more, ``percent`` in a hundred
    (rounded down) with the highest scores are drawn; ties go to the smaller
    id, then to fewer features; a null id comes first and has the noise of an
    empty one. Null and empty texts have no features and weight 0; repeated
    rows are drawn one by one; an empty table gives an empty one, and an empty
    target counts as one that holds no bucket.
    """
    rows = featured(docs, id_col, text_col, words, buckets)
    aim = featured(target, target_id, target_text, words, buckets)
    gains = docs.sparkSession.sparkContext.broadcast(gains_of(bucket_counts(rows, buckets), bucket_counts(aim, buckets), buckets))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "features") + ", weight bigint"
    scored = rows.mapInArrow(lambda b: weighed(gains.value)(b), schema).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    may = F.col("n_words") >= least
    scored, seen = staged_with(scored, "scores", n=F.count_if(may))
    order = [F.col("score").desc(), F.col("id"), F.col("n_features")]
    drawn = number_within(scored.filter(may), [], order, "rank", stretch=stretch)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= percent * seen["n"] // 100, F.col("rank")))
    out = drawn.unionByName(scored.filter(~may).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The drawn documents with all their columns, and their ``rank``; ids must not repeat."""
    drawn = resample(docs, target, id_col, **settings).filter("rank is not null").select(F.col(id_col).alias("_id"), "rank")
    return docs.join(drawn, docs[id_col] == F.col("_id")).drop("_id")
