import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators.numbering import draw_within, first_within, number_within, shuffled


def hot_rows(n=3000):
    """A third of all rows lies in one key; some keys are null."""
    rng = random.Random(7)
    return [(("hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])), rng.randint(0, 50), i) for i in range(n)]


def expected(rows):
    out = {}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], -r[2]))
        out.update({r[2]: i + 1 for i, r in enumerate(group)})
    return out


def test_spread_numbers_equal_window_numbers(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, o int, id int").repartition(5)
    order = [F.col("o"), F.col("id").desc()]
    for spread in (False, True):
        got = number_within(df, ["k"], order, "n", spread)
        assert got.columns == ["k", "o", "id", "n"]
        assert {r["id"]: r["n"] for r in got.collect()} == expected(rows)


def test_spread_numbers_without_key(spark):
    rows = [(i % 7, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "o int, id int").repartition(4)
    want = {r[1]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    got = number_within(df, [], [F.col("o").desc(), F.col("id")], "n", spread=True)
    assert {r["id"]: r["n"] for r in got.collect()} == want


def test_spread_uses_many_tasks(spark):
    df = spark.range(2000).select(F.lit("hot").alias("k"), F.col("id"))
    got = number_within(df, ["k"], [F.col("id")], "n", spread=True)
    assert got.select(F.count_if(F.col("n") == F.col("id") + 1)).first()[0] == 2000


def test_both_ways_keep_null_and_repeated_rows(spark):
    rows = [("a", None), ("a", 1), ("a", 1), (None, 2), (None, None)]
    df = spark.createDataFrame(rows, "k string, id int")
    got = [sorted(number_within(df, ["k"], [F.col("id")], spread=s).collect(), key=repr) for s in (False, True)]
    assert got[0] == got[1] and len(got[0]) == 5


VALUES = {
    "string": lambda r: r.choice(["", "a", "a\0", "http://a.example/a/very/long/way/to/" + str(r.randint(0, 9)), "é" * r.randint(0, 9), None]),
    "double": lambda r: r.choice([float("nan"), float("inf"), float("-inf"), 0.0, -0.0, r.random(), -r.random(), None]),
    "bigint": lambda r: r.choice([r.randint(-(2**62), 2**62), 2**60 + r.randint(0, 99), None]),
}


@pytest.mark.parametrize("kind, order, keys", [
    ("string", [lambda: F.col("v").desc(), "id"], ["k"]),
    ("double", ["v", "id"], []),
    ("bigint", [lambda: F.col("w").desc(), "v", "id"], ["k"]),
])
def test_stretches_give_window_numbers(spark, kind, order, keys):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "b", None]), VALUES[kind](rng), rng.randint(0, 2), i) for i in range(1500)]
    df = spark.createDataFrame(rows, f"k string, v {kind}, w int, id int").repartition(4)
    by = [c() if callable(c) else F.col(c) for c in order]
    found = [number_within(df, keys, by, "n", spread=s, stretch=100) for s in (True, False)]
    assert len({frozenset((r.id, r.n) for r in f.collect()) for f in found}) == 1


def test_a_key_with_half_the_rows_is_dealt_out_evenly(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    found = number_within(df, ["k"], [F.md5(F.col("id").cast("string"))], "n", stretch=100)
    tasks = sorted(r[1] for r in found.groupBy(F.spark_partition_id()).count().collect())
    assert len(tasks) == 8 and tasks[-1] < 2 * tasks[4]
    assert found.where("k = 'hot'").agg(F.max("n"), F.countDistinct("n")).first()[:] == (10_000, 10_000)


@pytest.mark.parametrize("n", [None, 1, 40])
def test_draws_give_window_numbers(spark, n):
    rows = [(i, ("hot" if i % 3 == 0 else f"k{i % 5}" if i % 7 else None)) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, k string").withColumn("lot", shuffled(42, F.col("id")))
    want = number_within(df, ["k"], [F.col("lot"), F.col("id")], "n", spread=False)
    want = want if n is None else want.where(F.col("n") <= n)
    found = draw_within(df, ["k"], "lot", [F.col("id")], n, "n")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.collect()}


def test_empty(spark):
    df = spark.createDataFrame([], "k string, id int")
    assert number_within(df, ["k"], [F.col("id")]).count() == 0


def test_first_within_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(hot_rows(), "k string, o int, id int")
    order = [F.col("o"), F.col("id").desc()]
    for n in (3, 1000):
        plan = first_within(df, ["k"], order, n)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan
    got = {r["id"]: r["pos"] for r in first_within(df, ["k"], order, 3).collect()}
    assert got == {i: n for i, n in expected(hot_rows()).items() if n <= 3}
    got = {r["id"]: r["pos"] for r in first_within(df.repartition(5), ["k"], order, 40).collect()}
    assert got == {i: n for i, n in expected(hot_rows()).items() if n <= 40}


def test_shuffled_is_stable(spark):
    import hashlib

    row = spark.range(1).select(shuffled(42, F.lit("r"), F.col("id")).alias("h")).first()
    assert row["h"] == hashlib.md5(b"42:r:0").hexdigest()
