"""Bounds and extrapolation of rank-biased overlap, against sums over many depths."""

import random

import pytest

from pairloom.operators.ranking import rbo_bounds

DEEP = 4000


def counts(ranks, d):
    return sum(r <= d for r in ranks.values())


def plain(a, b, p):
    """(min, residual, extrapolated), depth by depth."""
    na, nb = len(a), len(b)
    s, l = min(na, nb), max(na, nb)

    def at(d):
        x = sum(a[i] <= d and b[i] <= d for i in a.keys() & b.keys())
        return x, max(counts(a, d), d) + max(counts(b, d), d)

    known = [at(d) for d in range(1, l + 1)]
    x_l = known[-1][0] if known else 0
    kept = 2 * known[s - 1][0] / known[s - 1][1] if s else 0.0
    low = high = ext = 0.0
    for d in range(1, DEEP):
        x, both = known[d - 1] if d <= l else (x_l, 2 * d)
        w = (1 - p) * p ** (d - 1)
        low += w * 2 * x / both
        high += w * min(1, 2 * (x + max(0, d - s) + max(0, d - l)) / both)
        if d <= l:
            stays = 2 * (x + kept * max(0, d - s)) / both
        ext += w * (stays if l else 0.0)
    return low, high - low, ext


def overlap(a, b, p):
    """Of two full lists without ties."""
    total, x, left, right = 0.0, 0, set(), set()
    for d, (i, j) in enumerate(zip(a, b, strict=True), 1):
        left.add(i)
        right.add(j)
        x = len(left & right)
        total += (1 - p) * p ** (d - 1) * x / d
    return total


def tied(rng, items):
    out, place = {}, 1
    rest = list(items)
    while rest:
        n = min(len(rest), rng.choice([1, 1, 2, 3]))
        out.update(dict.fromkeys(rest[:n], place))
        rest, place = rest[n:], place + n
    return out


@pytest.mark.parametrize("p", [0.5, 0.9, 0.98])
def test_groups_equal_plain_sums(spark, p):
    rng = random.Random(int(100 * p))
    left, right, want = [], [], {}
    for g in range(12):
        items = rng.sample(range(40), 30)
        n, m = rng.choice([(5, 5), (3, 9), (9, 3), (1, 20), (0, 4), (12, 12)])
        a, b = items[:n], rng.sample(items, m)
        a, b = (tied(rng, a), tied(rng, b)) if g % 2 else ({x: i for i, x in enumerate(a, 1)}, {x: i for i, x in enumerate(b, 1)})
        left += [(g, x, r) for x, r in a.items()]
        right += [(g, x, r) for x, r in b.items()]
        want[g] = plain(a, b, p)
    schema = "g int, id int, rank int"
    found = rbo_bounds(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), p, ["g"]).collect()
    assert {r.g for r in found} == set(want)
    for r in found:
        assert (r.rbo_min, r.rbo_res, r.rbo_ext) == pytest.approx(want[r.g], abs=1e-9)


def test_no_continuation_leaves_the_bounds(spark):
    rng, p = random.Random(4), 0.9
    items = list(range(60))
    a, b = rng.sample(items, 10), rng.sample(items, 6)
    frames = [spark.createDataFrame([(x, i) for i, x in enumerate(y, 1)], "id int, rank int") for y in (a, b)]
    found = rbo_bounds(*frames, p).first()
    values = []
    for _ in range(300):
        unseen = [*items, *range(100, 100 + rng.choice([0, 300]))]
        more = [y + rng.sample([x for x in unseen if x not in y], len(unseen) - len(y)) for y in (a, b)]
        values.append(overlap(*[y + [(k, i) for i in range(300)] for k, y in enumerate(more)], p))
    best = [a + [x for x in b if x not in a], b + [x for x in a if x not in b]]
    tail = list(range(1000, 1400))
    values.append(overlap(best[0] + tail, best[1] + tail, p))
    assert all(found.rbo_min - 1e-9 <= v <= found.rbo_min + found.rbo_res + 1e-9 for v in values)
    assert found.rbo_min <= found.rbo_ext <= found.rbo_min + found.rbo_res


def test_equal_lists_and_empty_ones(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(50)], "id int, rank int")
    r = rbo_bounds(df, df).first()
    assert r.rbo_ext == pytest.approx(1) and r.rbo_min + r.rbo_res == pytest.approx(1)
    with pytest.raises(ValueError):
        rbo_bounds(df, df, 1.0)
