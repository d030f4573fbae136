"""SentencePiece encoding and decoding: exact merges by backtracking.

A merge-type vocabulary joins the adjacent pair of best rank until none is
left. A sequence of pieces is what that gives exactly if every two adjacent
pieces are: merging their joined text anew must give these two again. So a text
is cut from the left into longest pieces; where two don't fit together, a
shorter piece is tried, and a place from which no piece fits is marked and never
entered again.
"""

from __future__ import annotations

import functools
import hashlib
import re
from typing import Any

import ahocorasick
from pyspark.sql import Column

from pairloom.llm.common import Texts, per_text

#: The sign for a blank inside pieces (fixed value).
BLANK = "▁"
#: Words and pairs a worker remembers; longer words are not remembered.
REMEMBERED, LONGEST = 600_000, 64


def named(part: str) -> str:
    """The text that a name of ``Codec.parts`` stands for."""
    return part[1:] if part[:1] == "\x00" else " " + part


class Codec:
    """Ids of texts and texts of ids, for a merge-type model with byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        named = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(named[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.text = {i: named[i].replace(BLANK, " ") for i in plain}
        self.id = {t: i for i, t in self.text.items()}
        self.rank = {t: -model.get_score(i) for t, i in self.id.items()}
        self.raw = {i: t.encode() for i, t in self.text.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.chars = {c for t in self.id for c in t}
        if len(self.bytes) < 256 or not self.chars <= self.id.keys() or any(t.lstrip(" ").find(" ") > 0 for t in self.id):
            raise ValueError("the model lacks bytes or single characters, or has pieces that cross words")
        self.find = ahocorasick.Automaton()
        own = [t for t in self.id if self.merge(t) == [t]]  # other pieces never come out of merging
        for t in own:
            self.find.add_word(t, self.id[t])
        self.find.make_automaton()
        self.own, self.most = set(own), max(map(len, own))
        self.shorter = {self.id[t]: next((self.id[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.own), -1) for t in own}
        self.size, self.length = size, [len(self.text.get(i, "")) for i in range(size)]
        self.fitting: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Merge by the definition: best rank first, of equal ones the leftmost. For short texts."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = min((rank.get(parts[k] + parts[k + 1], float("inf")), k) for k in range(len(parts) - 1))
            if best == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: int, b: int) -> bool:
        """Whether two pieces stay as they are when their joined text is merged anew; remembered by both ids."""
        if len(self.fitting) > REMEMBERED:
            self.fitting.clear()
        known = self.merge(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        self.fitting[a * self.size + b] = known
        return known

    def longest(self, text: str, at: int) -> int:
        """Id of the longest piece that starts at a place."""
        n = self.find.longest_prefix(text[at : at + self.most])
        while text[at : at + n] not in self.own:
            n -= 1
        return self.id[text[at : at + n]]

    def run(self, text: str) -> list[int]:
        """Ids of a text whose characters all are pieces: longest pieces, and shorter ones wherever two don't fit."""
        greedy = [i for _, i in self.find.iter_long(text)]
        fitting, length, size = self.fitting, self.length, self.size
        last = greedy[0]
        out, at = [last], length[last]
        for piece in greedy[1:]:
            fits = fitting.get(last * size + piece)
            if not (self.fit(last, piece) if fits is None else fits):
                break
            out.append(piece)
            at += length[piece]
            last = piece
        else:
            return out
        failed = bytearray(len(text) // 8 + 1)  # a bit for each place from which nothing fits
        while at < len(text):
            end = at + length[piece]
            fits = not failed[end >> 3] >> (end & 7) & 1
            if fits and out:
                fits = fitting.get(out[-1] * size + piece)
                if fits is None:
                    fits = self.fit(out[-1], piece)
            if fits:
                out.append(piece)
                at = end
                if at < len(text):
                    piece = self.longest(text, at)
            elif (shorter := self.shorter[piece]) >= 0:
                piece = shorter
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= length[piece]
        return out

    def encode_part(self, text: str) -> list[int]:
        """Ids of a stretch; characters that are no piece become bytes, and nothing merges across them."""
        if self.chars.issuperset(text):
            return self.run(text) if text else []
        out: list[int] = []
        for known, part in ((m[1] is not None, m[0]) for m in re.finditer(self.split, text)):
            out += self.run(part) if known else [self.bytes[b] for b in part.encode()]
        return out

    @functools.cached_property
    def split(self) -> re.Pattern[str]:
        inside = "".join(map(re.escape, sorted(self.chars)))
        return re.compile(f"([{inside}]+)|[^{inside}]+")

    def parts(self, text: str) -> list[str]:
        """A text cut where no piece crosses: before the blank of each word.

        A word behind one blank is named without it, any other part as it is;
        so line ends, which are no piece, are parted too.
        """
        text = text.replace(BLANK, " ")
        plain = text[:1] != " " and text[-1:] != " " and not any(x in text for x in ("  ", "\x00", " \n"))
        if plain and "\n" not in self.chars:
            return text.replace("\n", " \x00\n \x00").split(" ")
        return ["\x00" + p for p in re.findall(" *[^ ]+| +", " " + text)]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, with the blank put before it and no begin or end."""
        return [i for p in self.parts(text) for i in self.encode_part(named(p))] if text else []

    def decode_raw(self, ids: list[int]) -> bytes:
        return b"".join([self.raw.get(i, b"") for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: blanks for their sign, the first one dropped, bytes read as UTF-8."""
        return self.decode_raw(ids).removeprefix(b" ").decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


class Parts(dict):
    """Ids, as text, and decoded bytes of parts; one met for the first time is encoded and, unless long, remembered."""

    def __init__(self, path: str):
        self.codec = codec(path)
        self.number = [str(i).encode() for i in range(self.codec.size)]

    def __missing__(self, part: str) -> tuple[bytes, bytes]:
        ids = self.codec.encode_part(named(part))
        out = b",".join([self.number[i] for i in ids]), self.codec.decode_raw(ids)
        if len(part) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = out
        return out

    def digests(self, texts: Texts) -> dict[str, Any]:
        out: dict[str, Any] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        get = self.__getitem__
        for text in texts:
            found = list(map(get, self.codec.parts(text))) if text else []
            ids = b",".join([f[0] for f in found if f[0]])
            raw = b"".join([f[1] for f in found]).removeprefix(b" ")
            out["n_tokens"].append(ids.count(b",") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
        return out


def digests(path: str, text: Any) -> Column:
    """Struct of ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of a text column; null counts as empty."""
    return per_text(lambda: Parts(path).digests, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})(text)


def encoded(path: str, text: Any) -> Column:
    """Ids of a text column as an array; null counts as empty."""

    def make():
        one = codec(path)
        return lambda texts: {"ids": [one.encode(t or "") for t in texts]}

    return per_text(make, {"ids": "array<bigint>"})(text)["ids"]


def decoded(path: str, ids: Any) -> Column:
    """Text of a column of id arrays; null counts as none. Ids without a text are skipped."""

    def make():
        one = codec(path)
        return lambda rows: {"text": [one.decode(r or []) for r in rows]}

    return per_text(make, {"text": "string"})(ids)["text"]
