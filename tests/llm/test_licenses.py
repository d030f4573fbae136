import re

import pytest

from pairloom.llm import licenses
from tests.llm.conftest import ODD

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
MIT = licenses.TEMPLATES[0][1]
BSD = next(t for label, t in licenses.TEMPLATES if label == "bsd")


def plain(text):
    """Words and places of phrases, by comparing at every word."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    found = [(i, label) for i in range(len(words)) for p, label in licenses.PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def compare(docs, rows):
    found = licenses.scan(docs).collect()
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found]
    assert sorted(got, key=repr) == sorted(((i, *plain(t)) for i, t in rows), key=repr)
    for r in found:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    return found


PHRASED = [
    "MIT License. mit LICENSE, the Apache-License! GNU General Public\nLicense",
    "license mit license license general public apache license",
    "mitlicense mit é license",
    "Mit License",
]


def test_base(odd, documents, rows, make):
    compare(odd, ODD)
    compare(documents, rows)
    compare(make(PHRASED), list(enumerate(PHRASED)))


def test_templates(make):
    filler = " ".join(f"w{i}" for i in range(200))
    words = BSD.split()
    changed = " ".join(w for i, w in enumerate(words) if i % 17)  # words left out: several diagonals
    added = " ".join(w + (" extra" if i % 15 == 0 else "") for i, w in enumerate(words))
    texts = [
        filler,
        f"{filler} {MIT} {filler}",
        f"{MIT.upper()} and {BSD}",
        f"{filler} {changed}",
        f"{added} {filler}",
        " ".join(MIT.split()[:20]) + " " + filler,
        "Licensed under CC BY-NC 4.0.\n" + filler,
        " ".join(sorted(MIT.split())),
        f"{MIT} {MIT} {MIT}",
    ]
    found = {r.doc_id: r for r in compare(make(texts), list(enumerate(texts)))}
    labels = {i: r.labels for i, r in found.items()}
    assert labels == {0: "", 1: "mit", 2: "bsd,mit", 3: "bsd", 4: "bsd", 5: "", 6: "cc-by-nc", 7: "", 8: "mit"}
    assert found[1].score == 1.0 and found[0].score == 0.0
    assert 0.75 <= found[3].score < 1


def test_hashes_are_those_of_the_windows():
    hashes = licenses.Windows()
    a, b = hashes(licenses.words_of("x a b c d e")), hashes(licenses.words_of("a b c d"))
    assert a[1] == b[0] and len(set(a.tolist())) == 3
    assert len(hashes([b"a"])) == 0


def test_empty(empty):
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize("n", [5, 2000])
def test_repeated_notice(make, n):
    text = "Released under the MIT License. " * n
    found = compare(make([text]), [(0, text)])
    assert found[0].labels == "mit"


@pytest.mark.parametrize("n", [9, 20, 50])
def test_notices_with_words_put_in(make, n):
    put = " ".join(f"inserted{i}" for i in range(n))
    notices = {label: text for label, text in licenses.TEMPLATES if len(text.split()) >= 25}
    texts = []
    for text in notices.values():
        words = text.split()
        middle = len(words) // 2
        texts.append(f"before it {' '.join(words[:middle])} {put} {' '.join(words[middle:])} after it")
    found = compare(make(texts), list(enumerate(texts)))
    assert {r.doc_id: label in r.labels.split(",") for r in found for i, label in enumerate(notices) if i == r.doc_id} == dict.fromkeys(range(len(texts)), True)
    turned = []
    for text in notices.values():  # halves in the wrong order are no notice
        words = text.split()
        middle = len(words) // 2
        turned.append(" ".join(words[middle:] + put.split() + words[:middle]))
    for r in compare(make(turned), list(enumerate(turned))):
        assert r.labels == r.base_labels
