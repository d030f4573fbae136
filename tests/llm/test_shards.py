import zlib

import pytest

from pairloom.llm import shards
from tests.llm.conftest import ODD


def network(x, n, seed):
    """One pass of the network over a plain number."""
    a, b = shards.sides(n)
    left, right = divmod(x, b)
    p = shards.PRIME
    for i, (add, times) in enumerate(shards.round_keys(seed)):
        if i % 2 == 0:
            s = (right + add) % p
            left = (left + s * s % p * times % p) % a
        else:
            s = (left + add) % p
            right = (right + s * s % p * times % p) % b
    return left * b + right


def place(x, n, seed):
    x = network(x, n, seed)
    while x >= n:
        x = network(x, n, seed)
    return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 23, 24, 25, 100, 997, 5000])
@pytest.mark.parametrize("seed", [0, 9])
def test_permutation(n, seed):
    assert sorted(place(x, n, seed) for x in range(n)) == list(range(n))


@pytest.mark.parametrize("n", [1, 3, 23, 997])
def test_places_are_those_of_plain_numbers(spark, n):
    found = shards.places(spark.range(n).selectExpr("id", "id AS p"), "p", n, 4).collect()
    assert {r.id: r.p for r in found} == {x: place(x, n, 4) for x in range(n)}


def test_large_numbers_do_not_overflow(spark):
    n = 10**14
    found = shards.permuted(spark.createDataFrame([(0,), (n - 1,), (12345678901234,)], "p long").selectExpr("p", "p AS x"), "x", n, 1)
    assert {r.p: r.x for r in found.collect()} == {p: network(p, n, 1) for p in (0, n - 1, 12345678901234)}


def check(found, rows, k):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=repr) == sorted(
        ((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=repr
    )
    n = len(rows)
    assert sorted(r.row_number for r in found) == list(range(n))
    for r in found:
        assert divmod(place(r.row_number, n, 0), k) == (r.slot, r.shard)
        assert (r.law, r.grown_shard) == ("rows", None)
    sizes = [sorted(r.slot for r in found if r.shard == s) for s in range(k)]
    assert all(s == list(range(len(s))) for s in sizes)
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1


@pytest.mark.parametrize("buckets", [shards.BUCKETS, 1, 5])
def test_odd(odd, buckets):
    check(shards.shard(odd, 4, buckets=buckets).collect(), ODD, 4)


def test_all_documents(documents, rows):
    found = shards.shard(documents, 24)
    check(found.collect(), rows, 24)
    assert sorted(found.collect()) == sorted(shards.shard(documents.repartition(5), 24).collect())


def test_empty(empty):
    assert shards.shard(empty, 24).count() == 0


def test_no_python(documents):
    plan = shards.shard(documents, 24)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
