import random

import numpy as np
import pytest
import xxhash

from pairloom.llm import simhash
from tests.llm.conftest import ODD


def plain_fingerprint(text, k=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, bits=4):
    """Smallest member reachable, by comparing all with all."""
    root = {f: f for f in items}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    items = sorted(items)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in items}


def compare(docs, rows, **settings):
    found = simhash.near_duplicates(docs, **settings).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    assert sorted(((r.doc_id, r.f & (1 << 64) - 1) for r in found), key=repr) == sorted(prints, key=repr)
    parts = plain_components({f for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[parts[f]] = min(i, least.get(parts[f], i))
    want = sorted(((i, least.get(parts[f])) for i, f in prints), key=repr)
    assert sorted(((r.doc_id, r.component_id) for r in found), key=repr) == want


def test_odd(odd):
    compare(odd, ODD)


def test_all_documents(documents, rows):
    compare(documents, rows)


def near(n, seed):
    """Fingerprints in families that differ by a few bits, and others."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        f = rng.getrandbits(64)
        out.add(f)
        for _ in range(rng.choice([0, 0, 1, 5, 30])):
            for _ in range(rng.randint(1, 5)):
                f ^= 1 << rng.randrange(64)
            out.add(f)
    return sorted(out)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 40, 16])
def test_links_connect_what_is_near(spark, bucket):
    items = near(600, 3)
    items += [x for x in range(300)]  # many that share most bits: their buckets are dealt out anew
    df = spark.createDataFrame([(simhash.signed(f),) for f in items], "f long").repartition(3)
    roots = {r.f & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.components(simhash.links(df, 4, bucket)).collect()}
    want = plain_components(set(items))
    groups = {}
    for f in items:
        groups.setdefault(want[f], set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("n", [17, 300, 4096])
def test_index_finds_all_pairs(n):
    items = np.array(near(n, n)[:n], np.uint64)
    index = simhash.Index(items)
    assert np.array_equal(np.sort(simhash.gray_rank(index.items)), simhash.gray_rank(index.items))
    found = {(a, b) for x, y in index.pairs(4) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    apart = np.bitwise_count(index.items[:, None] ^ index.items[None, :])
    assert found == {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(apart <= 4)), strict=True) if a < b}


def test_gray_neighbours_differ_by_one_bit():
    codes = np.array([i ^ i >> 1 for i in range(256)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(256))


def test_masks_cover_four_differences():
    masks = simhash.first_masks(4)
    rng = random.Random(1)
    for _ in range(500):
        differ = sum({1 << rng.randrange(64) for _ in range(4)})
        assert any(m & differ == 0 for m in masks)
        assert any(m & differ == 0 for m in simhash.finer(0, (1 << 64) - 1, 4))


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_keep_one(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    prints = {t: plain_fingerprint(t) for _, t in ODD}
    parts = plain_components(set(prints.values()))
    best = {}
    for i, t in ODD:
        part = parts[prints[t]]
        best[part] = min(best.get(part, (True, 0)), (i is None, i or 0))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((None if none else i for none, i in best.values()), key=repr)
