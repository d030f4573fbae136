"""A Merkle manifest of a table: a digest for every row, for every group and for the whole, and proofs of membership.

Rows are leaves, in order inside their group. Aligned blocks of nodes keep each of
their levels as one string of hexadecimal digests: substrings of fixed width are
what a parent hashes, and what flanks a node in its run are its siblings. What is
left of a block is a node of the next round; the roots of groups make a tree of
the same kind. Proofs are put together on the way back, block by block: rows
never meet more than the other nodes of their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import same, staged_with
from pairloom.operators.numbering import number_within

#: Nodes that make a parent; levels of a block, which so has FAN ** DEPTH nodes; digits of a digest.
FAN, DEPTH, WIDTH = 2, 6, 64
#: Rows that one task numbers in any case.
STRETCH = 1024


def field(c: Column) -> Column:
    """A value with its length in front, so that no two rows read the same; ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def parents(level: Column, fan: int) -> Column:
    """The level above: every run of ``fan`` digests, the last one as long as it is, as its own digest."""
    step = WIDTH * fan
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / step).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * step + 1, F.lit(step)), 256)), "")


def levels(level: Column, first: Column, fan: int, depth: int) -> Column:
    """A block's levels from the lowest up; the first block of a group ends where one node is left.

    A first block that is not full is its group's only one, and a full one ends
    with the last level anyway; others go on, however few nodes they have.
    """

    def add(done: Column, _: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when(first & (F.length(last) == WIDTH), done).otherwise(F.concat(done, F.array(parents(last, fan))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(level), add)


def siblings(levels_: Column, place: Column, fan: int) -> Column:
    """For every level but the last what stands left and right of a node in its run."""

    def one(level: Column, up: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(fan), up)).cast("int")
        start = own - own % fan
        left = F.substring(level, start * WIDTH + 1, (own - start) * WIDTH)
        right = F.substring(level, (own + 1) * WIDTH + 1, (start + fan - own - 1) * WIDTH)
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice(levels_, F.lit(1), F.size(levels_) - 1), one)


def climb(nodes: DataFrame, fan: int, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round, and what is left of each group as ``g`` and ``node``.

    ``nodes`` has the group ``g``, ``at`` (from 0 in its group), ``node`` and
    ``row``, a struct that comes back with the proofs.
    """
    rounds: list[DataFrame] = []
    block = fan**depth
    while True:
        place = (F.col("at") % block).cast("int").alias("place")
        held = [F.col("row")] if "row" in nodes.columns else []
        cut = nodes.select("g", F.floor(F.col("at") / block).alias("block"), F.struct(place, "node", *held).alias("own"))
        rows = cut.groupBy("g", "block").agg(F.array_sort(F.collect_list("own"), by_place).alias("rows"))  # a block
        low = F.array_join(F.transform("rows", lambda r: r["node"]), "")
        known = rows.withColumn("levels", levels(low, F.col("block") == 0, fan, depth))
        known, seen = staged_with(known, "merkle-blocks", last=F.max("block"))
        rounds.append(known)
        nodes = known.select("g", F.col("block").alias("at"), F.element_at("levels", -1).alias("node"))
        if not seen["last"]:
            return rounds, nodes.select("g", "node")


def by_place(a: Column, b: Column) -> Column:
    return a["place"] - b["place"]


def descend(rounds: list[DataFrame], tops: DataFrame, fan: int, depth: int) -> DataFrame:
    """The ``row`` of every leaf with its ``node``, its ``path`` of siblings and all further columns of ``tops``.

    ``tops`` has ``g`` and the ``path`` from the group's root on.
    """
    block = fan**depth
    more = [c for c in tops.columns if c not in ("g", "path")]
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(rounds) - 1, -1, -1):
        up = above.select(F.col("g").alias("_g"), F.col("block").alias("_block"), F.col("path").alias("_path"), *more)
        joined = rounds[k].join(up, same(F.col("g"), F.col("_g")) & (F.col("block") == F.col("_block")))
        each = joined.select("g", "block", "levels", "_path", *more, F.explode("rows").alias("own"))
        path = F.concat(siblings(F.col("levels"), F.col("own.place"), fan), F.col("_path")).alias("path")
        if k:
            above = each.select("g", (F.col("block") * block + F.col("own.place")).alias("block"), path, *more)
        else:
            above = each.select("own.row", "own.node", path, *more)
    return above


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, node, lambda own, s: digest(s["left"], own, s["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(
    docs: DataFrame,
    columns: list[str] = ["doc_id", "source", "lang", "n_chars", "text"],
    id_col: str = "doc_id",
    by: str = "lang",
    carry: dict[str, Column] = {},
    fan: int = FAN,
    depth: int = DEPTH,
    stretch: int = STRETCH,
) -> DataFrame:
    """One row per document: id, ``carry``, ``leaf``, ``path`` (array of left and right siblings), ``subroot``, ``root``.

    A leaf is the digest of ``columns``. Leaves ascend by id inside their value
    of ``by``; while several nodes remain, every ``fan`` of them become their
    digest, a shorter last run too. What remains is the value's subroot;
    subroots, nulls first and else bytewise, make the root in the same way.
    Null ids come first, rows of one id are ordered by their leaf, repeated
    rows are leaves of their own, null texts differ from empty ones. An empty
    table gives an empty one. Texts are read once, by the task that hashes
    them; what moves are digests and ids.
    """
    row = F.struct(F.col(id_col).alias("id"), *[c.alias(k) for k, c in carry.items()])
    base = docs.select(F.col(by).alias("g"), row.alias("row"), digest(*[field(F.col(c)) for c in columns]).alias("node"))
    base = base.withColumn("id", F.col("row.id"))
    leaves = number_within(base, ["g"], [F.col("id"), F.col("node")], "at", stretch=stretch)
    rounds, subroots = climb(leaves.select("g", (F.col("at") - 1).alias("at"), "node", "row"), fan, depth)

    named = subroots.select(F.col("g").alias("value"), F.col("node").alias("subroot"))
    named = number_within(named, [], [F.col("value")], "at", stretch=stretch)
    tops = named.select(F.lit(0).alias("g"), (F.col("at") - 1).alias("at"), F.col("subroot").alias("node"), F.struct("value").alias("row"))
    upper, root = climb(tops, fan, depth)
    none = F.array().cast("array<struct<left:string,right:string>>").alias("path")
    found = descend(upper, root.select("g", none, F.col("node").alias("root")), fan, depth)
    found = found.select(F.col("row.value").alias("g"), "path", F.col("node").alias("subroot"), "root")
    out = descend(rounds, found, fan, depth)
    return out.select(F.col("row.id").alias(id_col), *[f"row.{k}" for k in carry], F.col("node").alias("leaf"), "path", "subroot", "root")
