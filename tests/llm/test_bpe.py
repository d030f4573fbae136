import hashlib
import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pairloom.llm import bpe
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(text):
    """Ids and decoded text as the library has them."""
    tokenizer = bpe.encoder(PATH).tokenizer
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def digests(text):
    ids, back = library(text)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def compare(docs, rows):
    found = docs.select("doc_id", bpe.digests(PATH, F.col("text")).alias("d")).select("doc_id", "d.*")
    want = [(i, *digests(t)) for i, t in rows]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_odd_and_all_documents(odd, empty, documents, rows):
    compare(odd, ODD)
    compare(empty, [])
    compare(documents, rows)


def test_strange_texts_equal_the_library():
    rng, own = random.Random(3), bpe.encoder(PATH)
    signs = [*"abcdestrmvl'ÉéßİıΣςσ́ͅﬁǅ  \t\n\x0b\x1c\x1f\x85\xa0 　﻿​\x00\x7f٣²½Ⅷ中文한😀!?.,-_\"0123456789<|>"]
    signs += ["<|endoftext|>", "<|startoftext|>", "'ll", "'re", "don't", "the", "İ", "ẞ", "\U0001d400", "͸"]
    for _ in range(6000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))
        ids = own.encode(text)
        assert (ids, own.decode(ids)) == library(text), repr(text)


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 30_000 + "'s" * 50, "é" * 20_000, "1" * 5_000, "word " * 40_000])
def test_long_words(text):
    assert bpe.encoder(PATH).encode(text) == library(text)[0]


def test_cuts_are_certain():
    """No merge ever crosses a cut: fragments merged alone give what the whole word gives."""
    own, rng = bpe.encoder(PATH), random.Random(5)
    letters = [c for c in own.ids if len(c) == 1]
    cut = 0
    for _ in range(3000):
        symbols = own.symbols("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))))
        fragments = list(own.cut(symbols))
        cut += len(fragments) > 1
        assert [x for f in fragments for x in f] == symbols
        assert [i for f in fragments for i in own.merged(list(f))] == own.merged(list(symbols)) == own.merged_long(symbols)
    assert cut > 1000


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own = bpe.Encoder(PATH)
    text = " ".join(f"w{i}x" for i in range(200))
    assert own.encode(text) == library(text)[0]
    assert len(own.words) <= 6 and len(own.known) <= 6


def test_ids_and_round_trip(make):
    texts = ["Hello, World!", "<|endoftext|>", None, ""]
    docs = make(texts).withColumn("ids", bpe.encoded(PATH, F.col("text")))
    found = docs.select("doc_id", "ids", bpe.decoded(PATH, F.col("ids")).alias("back")).collect()
    assert {r.doc_id: (r.ids, r.back) for r in found} == {i: library(t) for i, t in enumerate(texts)}


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))  # has a decoder and a post-processor
