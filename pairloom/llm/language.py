"""Language identification with hyperdimensional profiles.

Every letter has a random vector of 1 and -1. A trigram's vector binds those of
its letters, permuted by their place, by multiplying them; a text's vector bundles
its trigrams by adding them up. A language's prototype bundles the texts known to
be in it. A text is taken for the language whose prototype has the largest cosine
with it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import Texts, per_text

#: Dimensions of the vectors, and the seed of the letters'.
DIMENSIONS, SEED = 1024, 7
#: Prototypes go to every task; more languages than this are taken for a mistake in the choice of the column.
MAX_LANGUAGES = 500
#: No language found.
UNKNOWN = "und"
#: Bits of a code point.
WIDE = 21
#: Trigrams turned into vectors at once.
STEP = 8192


@functools.cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=4096)
def letter_vector(code: int, seed: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([seed, code]).integers(0, 2, dimensions, np.int8) * 2 - 1


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of a text, packed into longs, and how often each occurs; words are framed by code 0."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.int64)
    codes = np.concatenate(([0], np.where(letters()[codes], codes, 0), [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique(codes[:-2] << 2 * WIDE | codes[1:-1] << WIDE | codes[2:], return_counts=True)


def vectors(grams: np.ndarray, seed: int, dimensions: int) -> np.ndarray:
    """A vector for each trigram."""
    low = (1 << WIDE) - 1
    out = np.ones((len(grams), dimensions), np.int8)
    for place in range(3):
        codes, back = np.unique(grams >> WIDE * place & low, return_inverse=True)
        table = np.stack([np.roll(letter_vector(c, seed, dimensions), place) for c in codes.tolist()])
        out *= table[back]
    return out


def bundle(grams: np.ndarray, counts: np.ndarray, seed: int, dimensions: int) -> np.ndarray:
    """Sum of the trigrams' vectors, each as often as it occurs; exact, so the order does not matter."""
    total = np.zeros(dimensions, np.int64)
    for k in range(0, len(grams), STEP):
        total += counts[k : k + STEP] @ vectors(grams[k : k + STEP], seed, dimensions).astype(np.int64)
    return total


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to rows (lang, gram, n), added up for some hundred texts."""
    for batch in batches:
        for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
            by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist(), strict=True):
                by.setdefault(lang, []).append(trigrams(text))
            for lang, found in by.items():
                grams, back = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                n = np.bincount(back, np.concatenate([c for _, c in found]), len(grams)).astype(np.int64)
                if len(grams):
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams, "n": n})


def partial_sums(seed: int, dimensions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            grams, n = batch["gram"].to_numpy(), batch["n"].to_numpy()
            for lang in set(langs):
                own = langs == lang
                total[lang] = total.get(lang, 0) + bundle(grams[own], n[own], seed, dimensions)
        for lang, vector in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dimensions, "i": pa.array(range(dimensions), pa.int32()), "v": vector})

    return run


def learn(
    known: DataFrame, lang_col: str = "lang", text_col: str = "text", seed: int = SEED, dimensions: int = DIMENSIONS
) -> dict[str, np.ndarray]:
    """Prototypes from all rows that have a language.

    Trigrams are counted per language in Spark; one vector per language comes
    to the driver.
    """
    rows = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter("lang is not null and text is not null")
    counted = rows.mapInArrow(count_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = counted.mapInArrow(partial_sums(seed, dimensions), "lang string, i int, v bigint")
    sums = sums.groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found = sums.limit(MAX_LANGUAGES * dimensions + 1).collect()
    if len(found) > MAX_LANGUAGES * dimensions:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out: dict[str, np.ndarray] = {}
    for r in found:
        out.setdefault(r["lang"], np.zeros(dimensions, np.int64))[r["i"]] = r["v"]
    return dict(sorted(out.items()))


def predict(prototypes: dict[str, np.ndarray], text: Any, seed: int = SEED, dimensions: int = DIMENSIONS) -> Column:
    """Struct of ``lang_pred`` and ``score`` (the cosine, 0 to 1) of a text column.

    A text that is null or has no letter gets 'und' and 0, as does every text if
    no language was learnt. Of equal cosines the first language by name wins.
    """

    def make():
        names = list(prototypes)
        table = np.stack([prototypes[n] / max(1.0, np.linalg.norm(prototypes[n])) for n in names]) if names else np.zeros((0, dimensions))
        table = table.astype(np.float32)

        def work(texts: Texts) -> dict[str, Any]:
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for k in range(0, len(texts), 64):
                found = [trigrams(t) for t in texts[k : k + 64]]
                grams, back = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                if not names or not len(grams):
                    continue
                owner = np.repeat(np.arange(len(found)), [len(g) for g, _ in found])
                counts = np.concatenate([c for _, c in found])
                total = np.zeros((len(found), dimensions), np.float32)
                for a in range(0, len(grams), STEP):
                    here = (back >= a) & (back < a + STEP)
                    wide = np.zeros((len(found), min(STEP, len(grams) - a)), np.float32)
                    wide[owner[here], back[here] - a] = counts[here]
                    total += wide @ vectors(grams[a : a + STEP], seed, dimensions).astype(np.float32)
                size = np.linalg.norm(total, axis=1)
                cosine = total @ table.T / np.maximum(size, 1)[:, None]
                best = cosine.argmax(1)
                for i, (g, _) in enumerate(found):
                    if len(g):
                        langs[k + i] = names[best[i]]
                        scores[k + i] = float(min(1.0, max(0.0, cosine[i, best[i]])))
            return {"lang_pred": langs, "score": scores}

        return work

    return per_text(make, {"lang_pred": "string", "score": "double"})(text)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether a row is kept from learning, by the checksum of its id; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    seed: int = SEED,
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """A row per document: id, ``held_out``, ``lang_pred``, ``score``.

    Learns from rows that are not held out and have a language; predicts from
    the text alone. Repeated rows count as often as they come; an empty table
    gives an empty one.
    """
    prototypes = learn(docs.filter(~held_out(id_col)), lang_col, text_col, seed, dimensions)
    found = predict(prototypes, F.col(text_col), seed, dimensions)
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), found.alias("p")).select(id_col, "held_out", "p.*")
