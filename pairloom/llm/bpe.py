"""Byte-pair encoding by forced boundaries, and decoding.

A merge can only make a token that the vocabulary holds. Two symbols that stand
side by side inside no token are therefore never merged across, whatever stands
around them: there is a certain cut. A table of the pairs that do occur inside
tokens splits each word into fragments; every fragment is merged on its own, and
the results are put together. Nothing occurs behind a symbol that ends a word, so
ends of words are certain cuts as well. Words met before are remembered.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column

from pairloom.llm.common import Texts, per_text

#: Words that a worker remembers, and the longest that it does; longer fragments are merged with a heap.
REMEMBERED, LONGEST = 300_000, 64
#: White space to Python but not to Unicode, and what both call white space (fixed values).
ODD = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Words of plain ASCII, as the pattern below cuts them (fixed values).
ASCII = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Steps of tokenizer files that drop white space and let no token cross it (fixed values).
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids of texts for a tokenizer file with a byte-level BPE model.

    The file's own normalizer and pre-tokenizer give the words; merging is done
    here. Refuses models with dropout, byte fallback, prefixes or whole-word
    lookups, and files with a post-processor or decoder.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        known = json.loads(self.tokenizer.to_str())
        model = known["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk") if model.get(k)]
        odd += [k for k in ("post_processor", "decoder") if known.get(k)]
        odd += [t["content"] for t in known["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"not a plain BPE model: {odd or model['type']}")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): k for k, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        self.tokens = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in known["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in known["added_tokens"]}
        listed = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(listed)})") if listed else None
        self.inside = {pair for token in self.ids for pair in self.neighbours(token)}
        split, *rest = (known["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        #: Whether words may be looked at one by one, and plain ones be cut here.
        self.by_word = (
            (known["normalizer"] or {}).get("normalizers") == NORMALIZER
            and split == {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
            and [r["type"] for r in rest] == ["ByteLevel"]
            and not rest[0]["add_prefix_space"]
            and not rest[0]["use_regex"]
        )
        self.known: dict[str, list[int]] = {}
        self.words: dict[str, list[int]] = {}

    def symbols(self, word: str) -> list[int]:
        """Ids of a word's characters, each of them a byte; the last one ends the word."""
        own = self.ids
        return [*[own[c] for c in word[:-1]], own[word[-1] + self.suffix]]

    def neighbours(self, token: str) -> Iterator[tuple[int, int]]:
        """Pairs of symbols that stand side by side inside a token."""
        ends = self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix)
        own = self.symbols(token.removesuffix(self.suffix)) if ends else [self.ids[c] for c in token]
        return zip(own, own[1:], strict=False)

    def cut(self, symbols: list[int]) -> Iterator[list[int]]:
        """Fragments between certain cuts."""
        start = 0
        for k, pair in enumerate(zip(symbols, symbols[1:], strict=False), 1):
            if pair not in self.inside:
                yield symbols[start:k]
                start = k
        yield symbols[start:]

    def merged(self, own: list[int]) -> list[int]:
        """Ids of a fragment: the merge of the lowest rank first, of equal ones the leftmost."""
        if len(own) > LONGEST:
            return self.merged_long(own)
        rank, made, none = self.rank.get, self.made, len(self.made)
        ranks = [rank(pair, none) for pair in zip(own, own[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            own[k : k + 2] = [made[best]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank((own[k], own[k + 1]), none)
            if k:
                ranks[k - 1] = rank((own[k - 1], own[k]), none)
        return own

    def merged_long(self, fragment: list[int]) -> list[int]:
        """``merged`` with a heap, for fragments too long to be looked through for every merge."""
        own: list[int | None] = [*fragment]
        n, rank = len(own), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank((own[k], own[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, k = heapq.heappop(heap)
            right = after[k] if own[k] is not None else n
            if right >= n or rank((own[k], own[right])) != best:
                continue  # one of the two has been merged otherwise
            own[k], own[right] = self.made[best], None
            after[k] = end = after[right]
            if end < n:
                before[end] = k
                if (r := rank((own[k], own[end]))) is not None:
                    heapq.heappush(heap, (r, k))
            if (start := before[k]) >= 0 and (r := rank((own[start], own[k]))) is not None:
                heapq.heappush(heap, (r, start))
        return [i for i in own if i is not None]

    def piece(self, piece: str) -> list[int]:
        """Ids of a word that the pre-tokenizer gives."""
        ids = self.known.get(piece)
        if ids is None:
            ids = [i for fragment in self.cut(self.symbols(piece)) for i in self.merged(fragment)]
            if len(piece) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        """Words of a section as byte characters, after the file's normalizer and pre-tokenizer."""
        if self.by_word and text.isascii() and text.isprintable():
            return [p for w in text.lower().split(" ") for p in ASCII.findall(w)]
        steps = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = steps[0].normalize_str(text) if steps[0] else text
        return [w for w, _ in steps[1].pre_tokenize_str(text)] if steps[1] else [text]

    def mapped(self, text: str) -> list[int]:
        """Ids of a section without added tokens."""
        return [i for piece in self.pieces(text) if piece for i in self.piece(piece)]

    def word(self, word: str) -> list[int]:
        ids = self.words.get(word)
        if ids is None:
            ids = self.mapped(word)
            if len(word) <= LONGEST:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def section(self, text: str) -> list[int]:
        if not self.by_word:
            return self.mapped(text)
        words = SPACES.split(text) if ODD.search(text) else text.split()
        out: list[int] = []
        known, encode, add = self.words.get, self.word, out.extend
        for w in words:
            ids = known(w)
            add(encode(w) if ids is None else ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; strings of added tokens are those tokens."""
        if not text:
            return []
        if not self.special or not self.special.search(text):
            return self.section(text)
        out: list[int] = []
        for k, part in enumerate(self.special.split(text)):
            out += [self.added[part]] if k % 2 else self.section(part)
        return out

    def decode(self, ids: Any) -> str:
        """The text of ids: their tokens with blanks between them, as a file without decoder has it."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(path: str, text: Any) -> Column:
    """Ids of a text column as an array; null and empty texts have none."""

    def make():
        encode = encoder(path).encode
        return lambda texts: {"ids": [encode(t) for t in texts]}

    return per_text(make, {"ids": "array<bigint>"})(text)["ids"]


def decoded(path: str, ids: Any) -> Column:
    """Texts of a column of id arrays; a null array gives the empty text."""

    def make():
        decode = encoder(path).decode
        return lambda rows: {"text": [decode(r or ()) for r in rows]}

    return per_text(make, {"text": "string"})(ids)["text"]


def digests(path: str, text: Any) -> Column:
    """Struct of ``n_tokens``, ``ids_sha256`` (of little-endian 32-bit ids) and ``decoded_sha256`` of a text column.

    Null and empty texts have no tokens. Each row stands for itself, so
    repeated rows, null ids and empty tables need no rule.
    """

    def make():
        own = encoder(path)

        def work(texts: Texts) -> dict[str, Any]:
            out = []
            for t in texts:
                ids = own.encode(t)
                raw, back = np.array(ids, "<u4").tobytes(), own.decode(ids).encode()
                out.append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()))
            return dict(zip(DIGESTS, map(list, zip(*out, strict=True)), strict=True))

        return work

    return per_text(make, DIGESTS)(text)


DIGESTS = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
