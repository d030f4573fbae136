"""License scans by diagonal voting.

Every window of four words of every text is hashed and joined with the places of
such windows in the license templates. Hits of one template whose places differ
by the same offset lie on one diagonal and vote for it; diagonals next to each
other, as words put in or left out make them, are merged. What is left are
spans that may hold a template; the words of each are aligned with those of the
template, and the share of it found decides.
"""

from __future__ import annotations

import difflib
import re
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.common import Texts, per_text, same, staged

#: Words of a text after A-Z are lowered: digits, small letters and all that is not ASCII (fixed values).
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases that are looked for as they stand, and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Texts of notices, as their licenses give them (fixed values).
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
    ),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
]

#: Words of a window, and the factor of its rolling hash.
K, FACTOR = 4, np.uint64(0x9E3779B97F4A7C15)
#: Offsets between diagonals that are merged; a template's own length bounds them further.
APART = 8
#: Share of a template's windows on merged diagonals that makes a span worth a check, and of its words that proves it.
CANDIDATE, PROOF = 0.3, 0.75
#: Share of a template's windows that makes a span a part of a broken notice, and the words that may stand between parts
#: of a short one; between those of others, as many as the template has.
PART, BREAK = 0.1, 64
#: Words a worker remembers the hash of.
REMEMBERED = 400_000


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


class Windows:
    """Hashes of all windows of ``K`` words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        if len(words) < K:
            return np.empty(0, np.int64)
        here = set(words)
        if len(self.known) + len(here) > REMEMBERED:
            self.known = {}
        for w in here.difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w, 42)
        each = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        total = each[: len(each) - K + 1].copy()
        for j in range(1, K):
            total = total * FACTOR + each[j : len(each) - K + 1 + j]
        return total.view(np.int64)


def phrases_in(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase stands."""
    out = []
    for phrase, label in phrases.items():
        parts = phrase.encode().split()
        last = parts[-1]
        at = -1
        while True:
            try:
                at = words.index(last, at + 1)
            except ValueError:
                break
            start = at - len(parts) + 1
            if start >= 0 and words[start : at + 1] == parts:
                out.append((start, label))
    return sorted(out)


FIELDS = {"n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string"}


def base(text: Any) -> Column:
    """Struct of ``FIELDS`` of a text column; null counts as empty."""

    def one(text: str | None) -> tuple[Any, ...]:
        words = words_of(text)
        found = phrases_in(words)
        starts = [s for s, _ in found] or [None]
        return len(words), len(found), starts[0], starts[-1], ",".join(sorted({x for _, x in found}))

    def make():
        def work(texts: Texts) -> dict[str, Any]:
            return dict(zip(FIELDS, map(list, zip(*map(one, texts), strict=True)), strict=True))

        return work

    return per_text(make, FIELDS)(text)


def windows(text: Any) -> Column:
    """Array of the hashes of all windows of a text column."""

    def make():
        hashes = Windows()

        def work(texts: Texts) -> dict[str, Any]:
            return {"w": [hashes(words_of(t)) for t in texts]}

        return work

    return per_text(make, {"w": "array<bigint>"})(text)["w"]


def template_places(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Rows (hash, template, place, n): windows of the templates; as many as the templates have words."""
    hashes = Windows()
    rows = []
    for t, (_, text) in enumerate(templates):
        found = hashes(words_of(text)).tolist()
        rows += [(h, t, place, len(found)) for place, h in enumerate(found)]
    return spark.createDataFrame(rows, "hash long, template int, place long, n long")


def aligned(span: list[bytes], template: list[bytes]) -> float:
    """Share of the template's words that the span has in the same order."""
    blocks = difflib.SequenceMatcher(None, span, template, autojunk=False).get_matching_blocks()
    return sum(b.size for b in blocks) / len(template)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """A row per document: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    ``labels`` joins base labels with those of templates found; ``score`` is the
    largest share of a template found, 1 where a phrase stands as it is, 0
    where nothing is. Null and empty texts have
    no words and no labels, a null id stays null, rows that repeat id and text
    have the same result, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    places = F.broadcast(template_places(spark, templates))  # some hundred rows, fixed by the templates
    hits = keyed.select("id", "h", F.posexplode(windows(F.col("text"))).alias("at", "hash")).join(places, "hash")
    hits = hits.select("id", "h", "template", "n", "place", "at", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    votes = hits.groupBy("id", "h", "template", "diagonal").agg(
        F.first("n").alias("n"),
        F.count("*").alias("votes"),
        F.min("at").alias("low"),
        F.max("at").alias("high"),
    )
    by = Window.partitionBy("id", "h", "template").orderBy("diagonal")  # diagonals of one text
    step = F.col("diagonal") - F.lag("diagonal").over(by)
    apart = F.least(F.lit(APART), F.expr("(n + 2) div 2"))
    votes = votes.withColumn("new", F.when(step <= apart, 0).otherwise(1)).withColumn("group", F.sum("new").over(by))
    spans = votes.groupBy("id", "h", "template", "group").agg(
        F.first("n").alias("n"),
        F.sum("votes").alias("votes"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    # what is left of a broken notice belongs together whatever has been put in between; the check minds the order
    broken = spans.filter((F.col("votes") < F.lit(PROOF) * F.col("n")) & (F.col("votes") >= F.lit(PART) * F.col("n")))
    order = Window.partitionBy("id", "h", "template").orderBy("low", "high")  # spans of one text
    follows = F.col("low") - F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.greatest("n", F.lit(BREAK)) + K
    broken = broken.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("chain", F.sum("new").over(order))
    chained = broken.groupBy("id", "h", "template", "chain").agg(
        F.first("n").alias("n"), F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    spans = spans.drop("group").unionByName(chained.drop("chain"))
    spans = spans.filter(F.col("votes") >= F.lit(CANDIDATE) * F.col("n"))
    listed = spans.groupBy("id", "h").agg(F.collect_list(F.struct("template", "low", "high")).alias("spans"))  # those of one text
    listed = staged(listed.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "spans"), "spans")

    named, texts = [label for label, _ in templates], [words_of(t) for _, t in templates]

    def make():
        def one(text: str, spans: list[dict]) -> tuple[list[str], float]:
            words = words_of(text)
            scores = [(aligned(words[s["low"] : s["high"] + K], texts[s["template"]]), named[s["template"]]) for s in spans]
            found = [x for x in scores if x[0] >= PROOF]
            return sorted({x for _, x in found}), max((x for x, _ in found), default=0.0)

        def work(rows: list[dict]) -> dict[str, Any]:
            labels, scores = zip(*[one(r["text"], r["spans"]) for r in rows], strict=True)
            return {"more": list(labels), "score": list(scores)}

        return work

    on = same(F.col("id"), F.col("_id")) & same(F.col("h"), F.col("_h"))
    proof = per_text(make, {"more": "array<string>", "score": "double"})
    suspects = keyed.join(listed, on).dropDuplicates(["id", "h"]).select("_id", "_h", proof(F.struct("text", "spans")).alias("p"))
    proven = suspects.select("_id", "_h", "p.more", "p.score").filter(F.size("more") > 0)

    plain = keyed.select("id", "h", base(F.col("text")).alias("b")).select("id", "h", "b.*")
    own = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_distinct(F.concat(own, F.coalesce("more", F.array().cast("array<string>"))))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    return plain.join(proven, on, "left").select(
        F.col("id").alias(id_col), *FIELDS, labels.alias("labels"), score.alias("score")
    )
