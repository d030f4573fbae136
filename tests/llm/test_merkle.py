import hashlib

import pytest
from pyspark.sql import functions as F

from pairloom.llm import merkle, queries
from tests.llm.conftest import COLUMNS, ODD

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fan):
    """The root, and for each node its siblings, left and right, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            start = place // fan * fan
            paths[k].append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + fan])))
            at[k] = place // fan
        nodes = [sha(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def plain(rows, fan=2):
    """(id, leaf, path, subroot, root) of each row, as a sorted list."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"], sha(*[field(r[c]) for c in FIELDS])))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    tops = {g: climb([n for _, n in groups[g]], fan) for g in langs}
    root, upper = climb([tops[g][0] for g in langs], fan)
    out = []
    for k, g in enumerate(langs):
        for (i, leaf), path in zip(groups[g], tops[g][1], strict=True):
            out.append((i, leaf, tuple(path + upper[k]), tops[g][0], root))
    return sorted(out, key=repr)


def found(docs, **settings):
    rows = merkle.manifest(docs, **settings).collect()
    return sorted(((r.doc_id, r.leaf, tuple((s.left, s.right) for s in r.path), r.subroot, r.root) for r in rows), key=repr)


def compare(docs, fan=2, **settings):
    got = found(docs, fan=fan, **settings)
    assert got == plain([r.asDict() for r in docs.collect()], fan)
    return got


def test_odd(odd, empty, make):
    compare(odd)
    assert merkle.manifest(empty).count() == 0
    compare(make([(i, t) for i, t in ODD], [None, "", "de", "é", "z", "Z", *["en"] * (len(ODD) - 6)]), depth=1)


@pytest.mark.parametrize("fan, depth", [(2, 6), (2, 1), (3, 2), (16, 1)])
def test_documents(documents, fan, depth):
    compare(documents, fan, depth=depth, stretch=20)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 63, 64, 65, 129])
def test_sizes_around_blocks(make, n):
    compare(make([f"text {i}" for i in range(n)]))


def test_one_value_with_most_rows_and_repeated_rows(make):
    rows = [(i // 3, "same") for i in range(300)] + [(None, "same")] * 40
    compare(make(rows, ["en" if k % 5 else None for k in range(340)]), stretch=30, depth=3)


def test_proofs_fold_to_the_root_and_show_changes(documents):
    rows = merkle.manifest(documents, carry={"other": F.sha2("text", 256)})
    same = F.col("root") == merkle.folded(F.col("leaf"), F.col("path"))
    changed = F.col("root") == merkle.folded(F.col("other"), F.col("path"))
    assert rows.select(F.count_if(~same), F.count_if(changed)).first()[:] == (0, 0)


def test_query_marks_what_was_changed(spark, sf, documents):
    import zlib

    rows = {r.doc_id: r for r in queries.QUERIES["op13_merkle_manifest"](spark, sf).collect()}
    n_chars = {r.doc_id: r.n_chars for r in documents.collect()}
    assert rows.keys() == n_chars.keys()
    for i, r in rows.items():
        assert r.verified == (zlib.crc32(str(i).encode()) % 7 != 0 or n_chars[i] is None)
    paths = {i: "".join(a + b for a, b in path) for i, _, path, _, _ in plain([r.asDict() for r in documents.collect()])}
    assert {i: r.proof_sha256 for i, r in rows.items()} == {i: sha(p) for i, p in paths.items()}


def test_fields_with_the_same_letters_differ(spark):
    rows = [(1, "a", "b", "s", 1, True, 1, "", "", "", 1), (1, "", "ab", "s", 1, True, 1, "", "", "", 1), (1, None, "ab", "s", 1, True, 1, "", "", "", 1)]
    assert len({r[1] for r in found(spark.createDataFrame(rows, COLUMNS))}) == 3
