import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pairloom.llm import tokens
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(rows):
    encode = Tokenizer.from_file(PATH).encode
    return sorted(((i, len((t or "").encode()), len(encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)


def compare(docs, rows, **settings):
    found = tokens.count_tokens(docs, PATH, **settings).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found), key=repr) == plain(rows)


@pytest.mark.parametrize(("chunk", "overlap"), [(tokens.CHUNK, tokens.OVERLAP), (50, 1), (1000, 16)])
def test_odd(odd, chunk, overlap):
    compare(odd, ODD, chunk=chunk, overlap=overlap)


def test_all_documents(documents, rows):
    compare(documents, rows, chunk=300, overlap=4)


def test_empty(empty):
    assert tokens.count_tokens(empty, PATH).count() == 0


def test_overlaps_are_widened():
    text = "ab " * 10 + "x" * 500 + " c d" * 50
    for a, b, low, high in tokens.seams(text, 20, 2)[1:]:
        assert a < low or low == 0
        assert text[low - 1] != " " and text[low] == " "
        assert b >= high
    assert tokens.seams("x" * 100, 20, 2) == [(0, 100, 0, 100)]


SPECIAL = ["foo\n\n<|endoftext|>", "  <|endoftext|>", "a\n\n\n<|endoftext|>\n\nb <|endoftext|>x\n\n<|endoftext|>", "\n\n<|endoftext|", "x \t\r\n <|endoftext|>"]


@pytest.mark.parametrize("chunk", [tokens.CHUNK, 40])
def test_white_space_before_a_special_string(make, chunk):
    texts = SPECIAL + [f"{s} some words follow " * n for s in SPECIAL for n in (1, 7)]
    texts.append(("word " * 30 + "\n\n<|endoftext|>") * 500)
    texts.append(("word " * 30 + "\n\n<|endoftext|>") * 390)
    assert len(texts[-1]) < tokens.CHUNK < len(texts[-2])
    compare(make(texts), list(enumerate(texts)), chunk=chunk, overlap=8)


def test_texts_whose_chunks_differ_are_cut_anew(make, monkeypatch):
    wide = []

    def bad(chunk, overlap):
        wide.append(overlap)
        return cut(chunk, overlap) if overlap >= 32 else cut_inside(chunk)

    def cut_inside(chunk):
        def run(batches):
            import pyarrow as pa

            for batch in batches:  # seams inside words, where neighbours can't agree
                for r in range(batch.num_rows):
                    text = batch["text"][r].as_py()
                    half = len(text) // 2 + 7
                    parts = [text[: half + 50], text[half:]]
                    columns = {c: batch[c].take(pa.array([r, r])) for c in ("id", "n_bytes", "row")} | {
                        "seq": pa.array([0, 1], pa.int32()), "n": pa.array([2, 2], pa.int32()), "part": pa.array(parts),
                        "low": pa.array([0, 0]), "high": pa.array([half, len(parts[1])]),
                    }
                    yield pa.RecordBatch.from_pydict(columns)

        return run

    cut = tokens.cut
    monkeypatch.setattr(tokens, "cut", bad)
    texts = ["internationalization " * 20 + " x" * k for k in range(5)]
    compare(make(texts), list(enumerate(texts)), chunk=100, overlap=8)
    assert wide[:3] == [8, 16, 32] and len(wide) == 3
