"""Consecutive numbers inside groups of any size.

A group is numbered by sorting it, and a group that holds half of all rows must
not be sorted by one task. Its order is therefore cut into stretches first: the
rows are counted by bins of their order key, bins that are still too full are
counted by finer ones, and so on until no stretch is large. The number of a row
is then the number of rows in the stretches before its own, and its place there.
Nothing is sampled: bins are counted, so stretches are exact.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from pairloom.storage import written

#: Parts a hot key is cut into before its first rows are picked.
SALTS = 64
#: Rows that one task sorts in any case; above, a stretch holds a quarter of an even partition at most.
STRETCH = 8_192
#: Bins of one count; bytes of a string that one digit holds, and digits of a key that are looked at together.
BINS, CHUNK, DIGITS = 4_096, 6, 3
#: Digits of a draw's digest that tell its stretches apart: 16 ** 4 of them in every group.
PREFIX = 4


class Sorted(NamedTuple):
    """One column of an order."""

    value: Column
    down: bool
    nulls_first: bool


def _parsed(order: list[Column], df: DataFrame) -> list[Sorted]:
    """Columns of an order with their directions; a descending one is a column's name or an SQL expression."""
    out = []
    for c in order:
        found = re.fullmatch(r"Column<'(.+) (ASC|DESC) NULLS (FIRST|LAST)'>", str(c), re.DOTALL)
        if not found:
            out.append(Sorted(c, False, True))
            continue
        name, way, nulls = found.groups()
        value = F.col(f"`{name}`") if name in df.columns else F.expr(name)
        out.append(Sorted(value, way == "DESC", nulls == "FIRST"))
    return out


def _sort(c: Column, by: Sorted) -> Column:
    if by.down:
        return c.desc_nulls_first() if by.nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if by.nulls_first else c.asc_nulls_last()


def _digits(c: Column, kind: DataType, by: Sorted, skip: Column) -> tuple[list[Column], Column, Column, bool]:
    """How a column orders rows: by digits from the left, but for special values, which stand before or behind all others.

    The digits of a value, the place of a special one (0: none), the bytes of a
    string, and whether all that is told apart by these is told apart at all.
    """
    name, size, whole = kind.typeName(), F.lit(0), True
    far = F.lit(0)
    if name in ("byte", "short", "integer", "long", "boolean", "date", "timestamp"):
        x = F.unix_date(c) if name == "date" else F.unix_micros(c) if name == "timestamp" else c
        x = x.cast("long")
        parts = [x, x - x.cast("double").cast("long")]  # the second one counts beyond 2 ** 53
    elif name in ("float", "double", "decimal"):
        x, whole = c.cast("double"), name != "decimal"
        far = F.when(F.isnan(x), 2).when(x == float("inf"), 1).when(x == float("-inf"), -1).otherwise(0)
        parts = [F.when(far == 0, x)]
    elif name in ("string", "binary"):
        raw = c.cast("binary")
        size = F.coalesce(F.octet_length(raw), F.lit(0))
        pieces = [F.substring(raw, skip + (1 + CHUNK * i), F.lit(CHUNK)) for i in range(DIGITS)]
        parts = [F.conv(F.rpad(F.hex(p), 2 * CHUNK, "0"), 16, 10) for p in pieces]
    else:
        parts, whole = [], False
    sign = -1 if by.down else 1
    out = [F.coalesce(p.cast("double"), F.lit(0.0)) * float(sign) for p in parts]
    special = F.when(c.isNull(), -3 if by.nulls_first else 3).otherwise(far * sign).cast("int")
    return (out + [F.lit(0.0)] * DIGITS)[:DIGITS], special, size, whole


def _same(names: list[str], a: str, b: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")) for c in names])


def _choose(column: Column, cases: dict[int, Column]) -> Column:
    """The case whose number ``column`` is."""
    out = F
    for i, case in cases.items():
        out = out.when(column == i, case)
    return out


def number_within(
    df: DataFrame, keys: list[str], order: list[Column], to: str = "pos", spread: bool = True, stretch: int = STRETCH
) -> DataFrame:
    """Number the rows of every key group 1..n in the given order.

    Pass ids and join wide columns afterwards: the rows are written once and
    all columns of ``df`` move. Groups of up to ``stretch`` rows, or up to a
    quarter of an even partition, are sorted by one task. Larger ones are cut
    by exact counts into stretches of that size, which are dealt out evenly
    over all tasks; the cuts are a table of a few rows per partition, whatever
    the data. ``spread=False`` sorts every group in one task: for groups of
    known size. Both ways give the same numbers. Nulls stand where the order
    puts them, rows alike in ``order`` are numbered in any order, an empty
    table stays empty. Of an order by a collection only groups that differ in
    the columns before it are cut.
    """
    if not spread:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(to, number.cast("bigint"))
    columns, by = df.columns, _parsed(order, df)
    values = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(f"`{c}`") for c in columns], *[b.value.alias(v) for b, v in zip(by, values, strict=True)])
    rows, seen = written(rows.withColumn("__k", F.monotonically_increasing_id()), "numbering", n=F.count(F.lit(1)))
    by, values = [*by, Sorted(F.col("__k"), False, True)], [*values, "__k"]  # rows alike are cut by their place
    sort = [_sort(F.col(v), b) for v, b in zip(values, by, strict=True)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(stretch, -(-seen["n"] // (4 * parts)))

    cut, leaves = _stretches(rows, keys, values, by, most)
    if leaves is None:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*sort))
        return rows.select(*[F.col(f"`{c}`") for c in columns], number.cast("bigint").alias(to))
    inside = Window.partitionBy(*keys).orderBy("__path").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.orderBy(*keys, "__path").rowsBetween(Window.unboundedPreceding, 0)  # a few rows per partition
    total = Window.partitionBy(F.lit(0))
    middle = F.sum("n").over(through) - F.col("n") / 2
    places = leaves.select(
        *keys,
        "__path",
        F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("__before"),
        F.floor(middle * parts / F.sum("n").over(total)).cast("int").alias("__to"),
    )
    names = [*keys, "__path"]
    found = cut.alias("r").join(F.broadcast(places).alias("p"), _same(names, "r", "p"), "left")
    home = F.pmod(F.hash(*[F.col(f"r.`{k}`") for k in keys], F.lit(0)), F.lit(parts))
    found = found.select("r.*", F.coalesce("__before", F.lit(0)).alias("__before"), F.coalesce("__to", home).cast("int").alias("__to"))
    dealt = found.repartitionById(parts, "__to")
    number = F.col("__before") + F.row_number().over(Window.partitionBy("__to", *keys, "__path").orderBy(*sort))
    return dealt.select(*[F.col(f"`{c}`") for c in columns], number.cast("bigint").alias(to))


def _stretches(
    rows: DataFrame, keys: list[str], values: list[str], by: list[Sorted], most: int
) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with ``__path``, which orders the stretches of a group, and the sizes of stretches of groups above ``most``.

    A node is a stretch that may be cut further; it knows the column it is cut
    by and how many bytes of a string its rows share. Nodes above ``most`` rows
    are fewer than rows / ``most``, and so are their bins but for a factor.
    """
    node = [*keys, "__path"]
    now = rows.select(
        "*",
        F.array().cast("array<int>").alias("__path"),
        F.lit(0).alias("__at"),
        F.lit(0).alias("__skip"),
        F.lit(True).alias("__open"),
    )
    leaves: list[DataFrame] = []
    used = [0]  # columns that nodes are cut by now
    while True:
        each = {i: _digits(F.col(values[i]), rows.schema[values[i]].dataType, by[i], F.col("__skip")) for i in used}
        digits = [_choose(F.col("__at"), {i: d[0][j] for i, d in each.items()}) for j in range(DIGITS)]
        special, size, whole = (_choose(F.col("__at"), {i: F.lit(d[k]) for i, d in each.items()}) for k in (1, 2, 3))
        plain = F.when(special == 0, F.lit(True))
        counts = (
            now.where("__open")
            .groupBy(*node, "__at", "__skip")
            .agg(
                F.count(F.lit(1)).alias("n"),
                *[F.min(F.when(plain, d)).alias(f"__lo{j}") for j, d in enumerate(digits)],
                *[F.max(F.when(plain, d)).alias(f"__hi{j}") for j, d in enumerate(digits)],
                F.min(special).alias("__low"),
                F.max(special).alias("__high"),
                F.min(size).alias("__short"),
                F.max(size).alias("__long"),
            )
        )
        digit = F.coalesce(*[F.when(F.col(f"__lo{j}") < F.col(f"__hi{j}"), F.lit(j)) for j in range(DIGITS)], F.lit(-1))
        splits = (F.col("__digit") >= 0) | (F.col("__low") < F.col("__high"))
        seen = F.col("__skip") + CHUNK * DIGITS
        more = (F.col("__high") == 0) & (F.col("__long") > seen)  # a string goes on
        next_ = (F.col("__low") != 0) | whole & (F.col("__short") == F.col("__long"))  # nothing of this column is left
        counts = counts.withColumn("__digit", digit).withColumn("__splits", splits)
        counts = counts.select(
            *node,
            "n",
            ((F.col("n") > most) & (F.col("__splits") | more | next_)).alias("__large"),
            "__splits",
            "__digit",
            _choose(F.col("__digit"), {j: F.col(f"__lo{j}") for j in range(DIGITS)}).alias("__lo"),
            _choose(F.col("__digit"), {j: F.col(f"__hi{j}") for j in range(DIGITS)}).alias("__hi"),
            F.least(F.lit(BINS), F.greatest(F.lit(16), F.ceil(F.col("n") / most) * 4)).alias("__bins"),
            F.when(F.col("__splits") | more, F.col("__at")).otherwise(F.col("__at") + 1).alias("__next_at"),
            F.when(F.col("__splits"), F.col("__skip")).when(more, seen).otherwise(0).alias("__next_skip"),
        )
        if not leaves:  # groups that one task can sort need no row here
            counts = counts.where("__large")
        counts, found = written(counts, "stretches", at=F.collect_set(F.when(F.col("__large"), F.col("__next_at"))))
        if not leaves and not found["at"]:
            return now, None
        leaves.append(counts)
        if not found["at"]:
            ends = [c.where("not __large").select(*node, "n") for c in leaves]
            return now, reduce(DataFrame.unionByName, ends)
        used = sorted(found["at"])
        steps = F.broadcast(counts.where("__large").drop("n", "__large")).alias("c")
        joined = now.alias("r").join(steps, F.col("r.__open") & _same(node, "r", "c"), "left")
        value = _choose(F.col("__digit"), dict(enumerate(digits)))
        bin_ = F.floor((value - F.col("__lo")) * F.col("__bins") / (F.col("__hi") - F.col("__lo")))
        bin_ = F.coalesce(F.least(bin_, F.col("__bins") - 1), F.lit(0))
        place = F.when(special < 0, special).when(special > 0, special + BINS).otherwise(bin_).cast("int")
        path = F.when(F.col("__splits"), F.concat("r.__path", F.array(place))).otherwise(F.col("r.__path"))
        now = joined.select(
            *[F.col(f"r.`{c}`") for c in rows.columns],
            path.alias("__path"),
            F.coalesce("__next_at", "__at").alias("__at"),
            F.coalesce("__next_skip", "__skip").alias("__skip"),
            F.col("__digit").isNotNull().alias("__open"),
        )


def first_within(
    df: DataFrame, keys: list[str], order: list[Column], n: int | None, to: str = "pos", spread: bool = True
) -> DataFrame:
    """The first ``n`` rows of every group, numbered; all rows for ``None``.

    Rows are picked in two steps, from parts of a group and then from what
    these give, so that a hot group never gathers in one task. Up to 1,000 rows
    Spark also drops later ones before each shuffle (WindowGroupLimit). All
    columns of ``df`` move: pass ids.
    """
    if n is None:
        return number_within(df, keys, order, to, spread)
    part = df.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = number_within(part, [*keys, "__salt"], order, to, spread=False).where(F.col(to) <= n).drop(to, "__salt")
    return number_within(some, keys, order, to, spread=n > STRETCH).where(F.col(to) <= n)


def shuffled(seed: int, *parts: Column) -> Column:
    """Sort key that looks random, is the same on every run and engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def draw_within(df: DataFrame, keys: list[str], lot: str, order: list[Column], n: int | None = None, to: str = "pos") -> DataFrame:
    """Number the rows of every group in the order of a digest, or draw its first ``n``.

    ``lot`` names a column of :func:`shuffled`; ``order`` tells rows of one lot
    apart. Digests are even, so the rows of a group that share the first four
    digits are one of 65,536 stretches of known evenness: counting them gives
    the number before each, and only the rows inside one are sorted. Of a draw,
    stretches that start behind the ``n``-th row are dropped by their counts,
    before any row is sorted. The numbers are those of :func:`number_within`.
    """
    cut = df.withColumn("__stretch", F.substring(lot, 1, PREFIX))
    counts = cut.groupBy(*keys, "__stretch").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__stretch", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    if n is not None:
        starts = starts.where(F.col("__before") < n)
    names = [*keys, "__stretch"]
    found = cut.alias("r").join(starts.alias("s"), _same(names, "r", "s")).select("r.*", "__before")
    inside = F.row_number().over(Window.partitionBy(*names).orderBy(F.col(lot), *order))
    found = found.withColumn(to, (F.col("__before") + inside).cast("bigint")).drop("__stretch", "__before")
    return found if n is None else found.where(F.col(to) <= n)
