"""SimHash near-duplicates through Gray-order hierarchical indexes.

Fingerprints that differ in at most ``bits`` of 64 are linked; linked ones,
directly or over others, form a component.

*Dealing out.* Of six blocks of the 64 bits, two linked fingerprints share at
least two, so every fingerprint goes to fifteen buckets, one for each pair of
blocks. A bucket that grows too large for one task is dealt out anew by the
bits its members don't share yet, in five parts of which linked ones share one.

*Searching.* Inside a bucket fingerprints are sorted by Gray rank, so neighbours
share most bits. Leaves of sixteen keep the bits all their members share; upper
nodes take over what their children share, and a child keeps the rest only. A
search goes down from the root, adds up the differences of each level and drops
a whole group once they exceed the threshold.

*Linking.* A bucket gives every fingerprint at most one link, to the root of its
part of the bucket; links make components by passing on the smallest number and
jumping pointers. No pairs within groups are ever listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import Texts, one_row_each, per_text, staged, staged_with

WORDS, BITS, SEED = 4, 4, 42
#: Blocks of the 64 bits of which linked fingerprints share two: with 4 bits to differ, 6.
BLOCKS = 6
#: Fingerprints of a bucket that one task takes; more are dealt out anew.
BUCKET = 4096
#: Children of a node.
WIDTH = 16
#: Pairs of query and node looked at in one step of a search.
FRONTIER = 1 << 20

ONE = np.uint64(1)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64 bits that more than half of the shingles' hashes have set; 0 without words."""
    import xxhash

    raw = (text or "").encode().lower().split()
    if not raw:
        return 0
    line = b" ".join(raw)
    n = max(1, len(raw) - words + 1)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    last = ends[min(words, len(raw)) - 1 :].tolist()
    hash64, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        some = [hash64(line[a:b], SEED) for a, b in zip(starts[k : k + 65_536], last[k : k + 65_536], strict=False)]
        each = np.array(some, np.uint64).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(each, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Any, words: int = WORDS) -> Column:
    """Fingerprint of a text column as a long with the same 64 bits."""

    def make():
        def work(texts: Texts) -> dict[str, Any]:
            return {"f": np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)}

        return work

    return per_text(make, {"f": "bigint"})(text)["f"]


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Place of each bit pattern in the reflected Gray code."""
    rank = f.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


class Index:
    """Hierarchy over fingerprints in Gray order; level 0 are the fingerprints."""

    def __init__(self, fingerprints: np.ndarray):
        self.order = np.argsort(gray_rank(fingerprints), kind="stable")
        self.items = fingerprints[self.order]
        both, either = [self.items], [self.items]  # bits set in all and in any member
        while len(both[-1]) > 1:
            cuts = np.arange(0, len(both[-1]), WIDTH)
            both.append(np.bitwise_and.reduceat(both[-1], cuts))
            either.append(np.bitwise_or.reduceat(either[-1], cuts))
        mask = [~(a ^ b) for a, b in zip(both, either, strict=True)]
        self.pattern = both
        # what the parent's mask covers is counted there and left out here
        self.mask = [m & ~np.repeat(up, WIDTH)[: len(m)] for m, up in zip(mask, mask[1:], strict=False)] + [mask[-1]]

    def pairs(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of all pairs (a before b) at most ``bits`` apart, some at a time."""
        top = len(self.mask) - 1
        for q in range(0, len(self.items), FRONTIER // BUCKET):
            a = np.arange(q, min(q + FRONTIER // BUCKET, len(self.items)))
            yield from self.down(top, a, np.zeros(len(a), np.int64), np.zeros(len(a), np.uint8), bits)

    def down(
        self, level: int, a: np.ndarray, node: np.ndarray, apart: np.ndarray, bits: int
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """From nodes of a level, each with a query and what they differ by above it, to the leaves."""
        while True:
            apart = apart + np.bitwise_count((self.items[a] ^ self.pattern[level][node]) & self.mask[level][node])
            near = (apart <= bits) & ((node + 1) * WIDTH**level > a + 1)  # nodes that end before the query have had their turn
            a, node, apart = a[near], node[near], apart[near]
            if level == 0:
                yield a, node
                return
            level -= 1
            if len(a) * WIDTH > FRONTIER and len(a) > 1:
                for part in np.array_split(np.arange(len(a)), -(-len(a) * WIDTH // FRONTIER)):
                    yield from self.down(level, *self.children(level, a[part], node[part], apart[part]), bits)
                return
            a, node, apart = self.children(level, a, node, apart)

    def children(self, level: int, a: np.ndarray, node: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        below = (node[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        real = below < len(self.mask[level])
        return np.repeat(a, WIDTH)[real], below[real], np.repeat(apart, WIDTH)[real]


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a and b: the smallest place of each connected part."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def bucket_links(items: np.ndarray, bits: int) -> np.ndarray:
    """For each fingerprint of a bucket the place of the root of its connected part."""
    index = Index(items)
    label = np.arange(len(items))
    for a, b in index.pairs(bits):
        label = merge_labels(label, a, b)
    root = np.empty(len(items), np.int64)
    root[index.order] = index.order[label]
    return root


def linked(bits: int):
    """Rows (mask, part, f), sorted by bucket, to links (a, b)."""

    def found(bucket: np.ndarray, f: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links of whole buckets; ``bucket`` numbers them in order."""
        out = []
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        sizes = np.diff(starts, append=len(f))
        small = np.repeat(sizes, sizes) <= WIDTH  # not more than a leaf: compare neighbours at each distance
        for d in range(1, WIDTH):
            a = np.flatnonzero((bucket[d:] == bucket[:-d]) & small[d:])
            if not len(a):
                break
            a = a[np.bitwise_count(f[a] ^ f[a + d]) <= bits]
            out.append((f[a + d], f[a]))
        for at, n in zip(starts[sizes > WIDTH].tolist(), sizes[sizes > WIDTH].tolist(), strict=True):
            items = f[at : at + n]
            root = bucket_links(items, bits)
            other = root != np.arange(n)
            out.append((items[other], items[root[other]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            if batch is not None:
                now = [batch[c].to_numpy().view(np.uint64) for c in ("mask", "part", "f")]
                rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            mask, part, f = rest
            change = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
            until = len(f) if batch is None else (change[-1] if len(change) else 0)  # the last bucket may go on
            bucket = np.zeros(len(f), np.int64)
            bucket[change] = 1
            pairs = found(np.cumsum(bucket[:until]), f[:until]) if until else []
            rest = [x[until:] for x in rest]
            for a, b in pairs:
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def first_masks(bits: int) -> list[int]:
    """Masks of which linked fingerprints agree on at least one: pairs out of ``bits + 2`` blocks of bits."""
    cuts = [64 * k // (bits + 2) for k in range(bits + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [signed(a | b) for a, b in combinations(blocks, 2)]


def finer(mask: int, varying: int, bits: int) -> list[int]:
    """The mask with one of ``bits + 1`` parts of the bits in which the members of a bucket differ."""
    free = [k for k in range(64) if varying >> k & 1]
    parts = [free[k :: bits + 1] for k in range(bits + 1)]
    return [signed((mask & (1 << 64) - 1) | sum(1 << k for k in p)) for p in parts]


def finer_masks(bits: int) -> Any:
    def make():
        return lambda rows: {"m": [finer(r["mask"], r["varying"], bits) for r in rows]}

    return per_text(make, {"m": "array<bigint>"})(F.struct("mask", "varying"))["m"]


def links(distinct: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect what is at most ``bits`` apart among distinct fingerprints ``f``.

    Buckets above ``bucket`` members are dealt out anew until none is left:
    with every step their members differ in fewer bits, and a bucket whose
    members differ in v bits has 2**v of them at most.
    """
    bucket = max(bucket, 2**bits)
    todo = distinct.select("f", F.explode(F.array(*[F.lit(m) for m in first_masks(bits)])).alias("mask"))
    ready = []
    while True:
        keyed = todo.withColumn("part", F.col("f").bitwiseAND(F.col("mask")))
        members = keyed.groupBy("mask", "part").agg(F.count("*").alias("n"), F.bit_or("f").alias("any"), F.bit_and("f").alias("all"))
        large = members.filter(F.col("n") > bucket).select("mask", "part", F.col("any").bitwiseXOR(F.col("all")).alias("varying"))
        large = staged(large.select("mask", "part", finer_masks(bits).alias("masks")), "large-buckets")
        if large.isEmpty():
            ready.append(keyed)
            break
        ready.append(keyed.join(large, ["mask", "part"], "left_anti"))
        split = keyed.join(large, ["mask", "part"]).select("f", F.explode("masks").alias("mask"))
        todo = staged(split.distinct(), "split-buckets")
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    dealt = rows.select("mask", "part", "f").repartition("mask", "part").sortWithinPartitions("mask", "part")
    return dealt.mapInArrow(linked(bits), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """Columns ``f`` and ``root`` of all that is linked: the smallest fingerprint reachable."""
    edges = staged(edges.distinct(), "links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "f"), "roots")
    while True:
        # the smallest root among the neighbours, then the root of that root
        root = label.select(F.col("f").alias("b"), "root")
        near = both.join(root, "b").groupBy("a").agg(F.min("root").alias("near"))
        next_ = label.join(near, label.f == near.a).select("f", "root", F.least("root", "near").alias("new"))
        jump = label.select(F.col("f").alias("new"), F.col("root").alias("far"))
        moved = next_.join(jump, "new").select("f", F.least("new", "far").alias("root"), (F.least("new", "far") != F.col("root")).alias("moved"))
        moved, seen = staged_with(moved, "roots", moved=F.max("moved"))
        label = moved.drop("moved")
        if not seen["moved"]:
            return label


def grouped(found: DataFrame, bits: int, bucket: int) -> DataFrame:
    """Add ``root``, the smallest fingerprint of the component, to rows with fingerprint ``f``."""
    distinct = staged(found.select("f").distinct(), "distinct-fingerprints")
    roots = components(links(distinct, bits, bucket))
    of = distinct.join(roots, "f", "left").select("f", F.coalesce("root", "f").alias("root"))
    return found.join(of, "f")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS, bucket: int = BUCKET
) -> DataFrame:
    """One row per document: id, ``f`` (fingerprint as a long), ``component_id``.

    ``component_id`` is the smallest id that links reach. Texts without words
    have fingerprint zero and are linked like any other; a null id counts only
    where its component has no other. Repeated rows stay apart; an empty table
    gives an empty one.
    """
    found = staged(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), words).alias("f")), "fingerprints")
    by_text = grouped(found.groupBy("f").agg(F.min("id").alias("least")), bits, bucket)
    least = by_text.groupBy("root").agg(F.min("least").alias("component_id"))
    of = by_text.join(least, "root").select("f", "component_id")
    return found.join(of, "f").select(F.col("id").alias(id_col), "f", "component_id")


def hexadecimal(f: Column) -> Column:
    """A fingerprint as 16 digits."""
    return F.lower(F.lpad(F.hex(f), 16, "0"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS, bucket: int = BUCKET
) -> DataFrame:
    """Of each component the document with the smallest id, with all its columns; of rows that repeat it, one."""
    key = {"id": F.col(id_col), "h": F.xxhash64(text_col)}  # the hash tells apart texts that have one id
    found = docs.select(*[c.alias(k) for k, c in key.items()], fingerprints(F.col(text_col), words).alias("f"))
    found = grouped(staged(found, "fingerprints"), bits, bucket)
    rows = found.groupBy("root", "id", "h").agg(F.count("*").alias("rows"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h", "rows")).alias("k"))
    return one_row_each(docs, best.select("k.id", "k.h", "k.rows"), key)
