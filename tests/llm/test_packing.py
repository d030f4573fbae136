import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pairloom.llm import packing
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(rows, length):
    encode = Tokenizer.from_file(PATH).encode
    out = []
    for i, t in rows:
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, a in enumerate(range(0, len(ids), length)):
            out.append((i, piece, a, len(ids[a : a + length]), zlib.crc32(ids[a : a + length].tobytes())))
    return sorted(out, key=repr)


def whole(found, length):
    """Sequences without gaps or overlaps, none too long."""
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


@pytest.mark.parametrize("length", [packing.LENGTH, 64])
def test_odd(odd, length):
    found = packing.pack(odd, PATH, 1, length=length).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == plain(ODD, length)
    whole(found, length)


def test_all_documents(documents, rows):
    found = packing.pack(documents, PATH, 1).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == plain(rows, packing.LENGTH)
    n = whole(found, packing.LENGTH)
    least = -(-sum(r.length for r in found) // packing.LENGTH)
    assert n <= 1.05 * least + 2


def test_empty(empty):
    assert packing.pack(empty, PATH, 1).count() == 0


def covered(runs, counts, length):
    """Every piece of the histogram has one place, and sequences have no gaps; gives their number."""
    numbers, by = defaultdict(list), defaultdict(list)
    for r in runs:
        for k in range(r.count):
            numbers[r.length].append(r.first + k)
            by[r.sequence + k // r.each].append((r.offset + k % r.each * r.length, r.length))
    assert {s: sorted(x) for s, x in numbers.items()} == {s: list(range(n)) for s, n in counts.items() if n}
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


@pytest.mark.parametrize("seed", range(12))
def test_plans(seed):
    rng = random.Random(seed)
    length = rng.choice([10, 64, 4096])
    counts = Counter(min(length, int(rng.lognormvariate(rng.choice([2, 5, 7]), 1)) + 1) for _ in range(rng.choice([1, 30, 3000])))
    covered(packing.plan(counts, length, groups=rng.choice([1, 4, 48])), counts, length)


def test_few_sizes_are_packed_at_best():
    assert covered(packing.plan({6: 30, 4: 30}, 10), {6: 30, 4: 30}, 10) == 30
    assert covered(packing.plan({5: 7, 3: 14, 2: 14}, 10), {5: 7, 3: 14, 2: 14}, 10) == 11


def test_runs_do_not_grow_with_documents():
    counts = {s: 1 + 4096 // s for s in range(1, 4097)}
    few, many = packing.plan(counts), packing.plan({s: 100_000 * n for s, n in counts.items()})
    assert len(many) < 2 * len(few) + 10_000


def test_groups_have_equal_cardinality():
    groups = packing.grouped({10: 5, 9: 5, 8: 10}, 4)
    assert groups == [(10, [(10, 5)]), (9, [(9, 5)]), (8, [(8, 5), (8, 5)])]
