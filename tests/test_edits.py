"""Banded distances against the plain matrix."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.functions import edits
from pairloom.functions.edits import banded, distance, edit_distance_within, edits_tried, letters_apart, similarity_within, sparse


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(rng, text, n, letters):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        how = rng.randrange(3)
        if how == 0 or not out or at == len(out):
            out.insert(at, rng.choice(letters))
        elif how == 1:
            out[at] = rng.choice(letters)
        else:
            del out[at]
    return "".join(out)


def test_thousand_pairs_equal_the_matrix():
    rng = random.Random(1)
    letters = "가나다éß中😀ab "
    for k in range(1000):
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 70)))
        b = edited(rng, a, rng.randint(0, 12), letters) if k % 3 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 70)))
        want = plain(a, b)
        for most in (0, 1, 5, 20, 200):
            assert distance(a, b, most) == (want if want <= most else None)
        for bound in (1, 3, 9, 64, 100):
            assert banded(a, b, bound) == (want if want <= bound else None)
            assert sparse(a, b, bound) == (want if want <= bound else None)
        assert letters_apart(a, b) <= want <= edits_tried(a, b, 200)


def test_long_texts():
    rng = random.Random(2)
    a = "".join(rng.choice("가나다라 ab") for _ in range(3000))
    b = edited(rng, a, 90, "xyz")
    assert distance(a, b, 600) == plain(a, b)


def test_no_table_where_letters_or_few_edits_decide(monkeypatch):
    def table(*_):
        raise AssertionError("a table was filled")

    monkeypatch.setattr(edits, "banded", table)
    rng = random.Random(4)
    a = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    assert distance(a, a.translate({ord("a"): "x", ord("b"): "y", ord("c"): "z"}), 4_001) is None
    assert distance(a, a.replace("a", "x"), 4_001) == a.count("a")
    b = edited(rng, a, 60, "xyz")
    assert distance(a, b, 4_001) == sparse(a, b, 60) <= 60


def test_letters_of_long_texts_are_counted_in_an_array(monkeypatch):
    rng = random.Random(6)
    pairs = []
    for letters in ("ab ", "가나다 ab", "a😀b"):
        for n in (0, 1, 40, 30_000):
            a = "".join(rng.choice(letters) for _ in range(n))
            pairs += [(a, edited(rng, a, 30, "xé😀")), (a, a.translate({ord("a"): "é"})), (a, a[::-1])]
    want = []
    for a, b in pairs:
        more = sum((Counter(a) - Counter(b)).values())
        want.append(max(more, more + len(b) - len(a)))
    assert [letters_apart(a, b) for a, b in pairs] == want

    def one_by_one(*_):
        raise AssertionError("letters of a long text were counted one by one")

    monkeypatch.setattr(edits, "Counter", one_by_one)
    assert [letters_apart(a, b) for a, b in pairs if len(a) == 30_000] == [n for n, (a, _) in zip(want, pairs) if len(a) == 30_000]


def test_time_grows_with_the_length():
    rng = random.Random(3)

    def took(n):
        a = "".join(rng.choice("abcdefgh") for _ in range(n))
        b = "x" + a[: n // 2] + "y" + a[n // 2 :] + "z"
        start = time.perf_counter()
        assert distance(a, b, n // 5) == 3
        return time.perf_counter() - start

    took(1000)
    assert took(160_000) < 40 * took(16_000) + 0.5


def test_column(spark):
    rows = [("abcd", "abce"), ("", ""), (None, "a"), ("a", None), ("고양이가 잔다", "고양이가 잤다"), ("abc", "xyz"), ("", "a")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("d", edit_distance_within("a", "b", 0.2))
    found = df.select("d", similarity_within(F.col("a"), F.col("b"), F.col("d")).alias("s")).collect()
    assert [r.d for r in found] == [1, 0, None, None, 1, None, 1]
    assert found[1].s == 1.0 and found[0].s == 0.75 and found[5].s is None
    assert df.limit(0).count() == 0


@pytest.mark.parametrize("share", [0.05, 1.0])
def test_bound_is_a_share(spark, share):
    df = spark.createDataFrame([("a" * 100, "a" * 90 + "b" * 10)], "a string, b string")
    assert df.select(edit_distance_within("a", "b", share).alias("d")).first().d == (10 if share == 1.0 else None)
