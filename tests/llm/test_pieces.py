import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from pairloom.llm import pieces
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def random_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice("ab  \n\t'sé😀1▁.\x00thein") for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_codec(library):
    codec = pieces.codec(PATH)
    for text in [t or "" for _, t in ODD if len(t or "") < 5000] + random_texts(2000):
        assert codec.encode(text) == library.encode(text)
        assert codec.decode(library.encode(text)) == library.decode(library.encode(text))


def test_backtracking_gives_what_merging_gives():
    codec = pieces.codec(PATH)
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice("theinorandsl ") for _ in range(rng.randint(1, 30)))
        assert [codec.text[i] for i in codec.run(text)] == codec.merge(text)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("remembered", [pieces.REMEMBERED, 3])
def test_digests(odd, documents, rows, library, remembered, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", remembered)
    for docs, pairs in ((odd, ODD), (documents, rows)):
        d = pieces.digests(PATH, docs.text).alias("d")
        found = docs.select("doc_id", d).select("doc_id", "d.*").collect()
        want = []
        for i, t in pairs:
            ids = library.encode(t or "")
            want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
        assert sorted((tuple(r) for r in found), key=repr) == sorted(want, key=repr)


def test_columns(odd, library):
    got = odd.select("text", pieces.encoded(PATH, odd.text).alias("ids"))
    got = got.select("text", "ids", pieces.decoded(PATH, got.ids).alias("back")).collect()
    for r in got:
        assert r.ids == library.encode(r.text or "")
        assert r.back == library.decode(r.ids)


def test_empty(empty):
    assert empty.select(pieces.digests(PATH, empty.text)).count() == 0
