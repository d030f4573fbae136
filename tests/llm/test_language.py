import zlib

import numpy as np
from pyspark.sql import functions as F

from pairloom.llm import language
from tests.llm.conftest import ODD


def plain_vector(text, dimensions=256, seed=1):
    """Bundle of a text's trigrams, one after the other."""
    symbols = [0]
    for c in text.lower():
        code = ord(c) if c.isalpha() else 0
        if code or symbols[-1]:
            symbols.append(code)
    if symbols[-1]:
        symbols.append(0)
    total = np.zeros(dimensions, np.int64)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        v = [language.letter_vector(x, seed, dimensions) for x in (a, b, c)]
        total += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    return total


TRAIN = [
    (0, "the cat and the dog", "en"),
    (1, "der Hund und die Katze", "de"),
    (3, "the end of the day", "en"),
    (4, "das Ende des Tages ist nah", "de"),
    (5, None, "fr"),
    (6, "no language here", None),
    (7, "El perro y el gato", "es"),
]


def test_prototypes_and_cosines(spark, make):
    docs = make([(i, t) for i, t, _ in TRAIN], [x for *_, x in TRAIN])
    found = language.learn(docs, seed=1, dimensions=256)
    want = {}
    for _, t, lang in TRAIN:
        if t and lang:
            want[lang] = want.get(lang, 0) + plain_vector(t)
    assert list(found) == sorted(want)
    assert all(np.array_equal(found[k], want[k]) for k in want)
    texts = ["the dog of the day", "die Katze", "gato", "Ünïcode текст 漢字", "x"]
    docs = make(texts)
    got = docs.select("text", language.predict(found, docs.text, seed=1, dimensions=256).alias("p")).collect()
    for r in got:
        v = plain_vector(r.text)
        cosine = {k: v @ w / np.linalg.norm(v) / np.linalg.norm(w) for k, w in want.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert r.p.lang_pred == best
        assert abs(r.p.score - min(1, max(0, cosine[best]))) < 1e-4


def test_held_out_accuracy(documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    found = language.identify(documents).collect()
    assert len(found) == len(truth)
    out = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.9 * len(out)
    assert all(0 <= r.score <= 1 for r in found)


def test_odd(odd, documents, empty):
    found = language.identify(odd).collect()
    assert len(found) == len(ODD)
    plain = {r.doc_id: r for r in found}
    assert (plain[1].lang_pred, plain[1].score) == ("und", 0.0)
    assert (plain[2].lang_pred, plain[7].lang_pred) == ("und", "und")
    assert plain[9].lang_pred == "en"
    assert language.identify(empty).count() == 0
    nothing = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(nothing).collect()} == {"und"}
