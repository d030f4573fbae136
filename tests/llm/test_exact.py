import hashlib
from collections import defaultdict

import pytest

from pairloom.llm import exact
from tests.llm.conftest import ODD


def plain(rows):
    """(id, keep_id, size, sha) of every row, by comparing whole texts; and the ids that stay."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: max(ids, key=lambda i: -1 if i is None else i) for t, ids in groups.items()}
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in groups}
    return sorted(((i, best[t or ""], len(groups[t or ""]), sha[t or ""]) for i, t in rows), key=repr), sorted(best.values(), key=repr)


def compare(found, rows):
    found = found.collect()
    want, stay = plain(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == want
    assert sorted((r.doc_id for r in found if r.kept), key=repr) == stay


@pytest.mark.parametrize(("block", "together"), [(exact.BLOCK, exact.TOGETHER), (7, 64), (1000, 1)])
def test_odd(odd, block, together):
    if block == 7:
        odd = odd.filter("text is null or length(text) < 100")
    rows = [(i, t) for i, t in ODD if block != 7 or not t or len(t) < 100]
    compare(exact.exact_duplicates(odd, block=block, together=together), rows)


def test_all_documents(documents, rows):
    compare(exact.exact_duplicates(documents, block=512), rows)


def test_blocks_that_only_differ_in_order(make):
    texts = ["ab" * 4 + "cd" * 4, "cd" * 4 + "ab" * 4, "ab" * 4 + "cd" * 4 + "e", "ab" * 8, "ab" * 4, "ab" * 4 + "cd" * 4]
    compare(exact.exact_duplicates(make(texts), block=4), list(enumerate(texts)))


def test_empty(empty):
    assert exact.exact_duplicates(empty).count() == 0
    assert exact.keep_one(empty).columns == empty.columns


def test_keep_one(odd):
    kept = exact.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == plain(ODD)[1]
