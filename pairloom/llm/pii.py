"""Personal data: patterns, and the terms that give protected entities away.

Patterns find e-mail and IP addresses, card and phone numbers. Each distinct
value is a protected entity. A term near it discloses it as far as knowing the
term lowers the information of the entity: their pointwise mutual information,
estimated from the documents of the whole corpus, as a share of the entity's own
information content. It is 1 for a term that occurs with the entity only, and near
0 for a word that occurs everywhere. Terms above a first threshold are
generalised to their kind, above a second one removed. ``everywhere``, all terms
of a document count with its entities, and are replaced at every place in
documents that hold the entity; those to be removed, in all documents. What is
removed must be proven: with ``error``, the lower confidence bound of the term's
conditional probability has to reach the threshold, and copies of a text count
as one.

Entities of the same documents have the same ties, and so have terms. They are
put into classes by a digest of their documents, and classes are paired: a list of
addresses that is posted three times is one class, not as many pairs as it has
addresses and words.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import Texts, per_text, staged, staged_with
from pairloom.llm.quality import upper_bound

#: Kinds of base spans in their order (fixed values).
KINDS = ("email", "ip", "card", "phone")
#: Characters of the part before the @, and the pattern from the @ on (fixed values).
LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The other patterns; possessive, so that long runs of digits are read once (fixed values).
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Words on either side of an entity that count as its context, and how far they may lie, in characters.
NEAR, REACH = 8, 240
#: Documents in which term and entity must occur together before their tie is trusted.
SUPPORT = 3
#: Disclosed share of an entity's information from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.75, 0.95
#: Chance that a term is removed which discloses less than its documents say.
ERROR = 0.05
#: Bits of the sieve that spares counting terms which stand near no entity.
SIEVE = 1 << 24
#: Words and counts held by a task.
HELD = 400_000

WORD = re.compile(r"\S+")
EDGES = string.punctuation


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def emails(text: str) -> Iterator[Span]:
    """The run of characters before each @ is looked at once, from the @ back to the last match."""
    done = 0
    at = text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield Span("email", start, found.end())
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(twice[v] for v in values[1::2])) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small(part: str) -> bool:
    """Whether a run of digits is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str | None) -> list[Span]:
    """Base spans by kind and place: leftmost matches that don't overlap; those that fail their test are dropped."""
    if not text:
        return []
    out = list(emails(text))
    if re.search("[0-9]", text):
        out += [Span("ip", *m.span()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in CARD.finditer(text):
            if 16 <= len(m[0]) and 16 <= len(digits := only_digits(m[0])) <= 19 and luhn(digits):
                out.append(Span("card", *m.span()))
        if "+" in text:
            out += [Span("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    """One name for the spellings of an entity."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else only_digits(value)}"


def term(word: str) -> str:
    """A word as it is counted: lower case, no punctuation around it, '' if under three characters."""
    word = word.strip(EDGES).lower()
    return word if len(word) > 2 else ""


def context(text: str, span: Span) -> Iterator[tuple[str, int, int]]:
    """Terms of the nearest words before and after a span, with their places; words that the reach cuts are left out."""
    low, high = max(0, span.start - REACH), min(len(text), span.end + REACH)
    before = [m for m in WORD.finditer(text, low, span.start) if m.start() > low or low == 0 or text[low - 1].isspace()]
    after = [m for m in WORD.finditer(text, span.end, high) if m.end() < high or high == len(text) or text[high].isspace()]
    for m in before[-NEAR:] + after[:NEAR]:
        if t := term(m[0]):
            lead = len(m[0]) - len(m[0].lstrip(EDGES))
            yield t, m.start() + lead, m.end() - (len(m[0]) - len(m[0].rstrip(EDGES)))


def named(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FIELDS = {f"n_{k}": "bigint" for k in KINDS} | {
    "base_spans": "string",
    "base_sha256": "string",
    "entities": "array<string>",
    "terms": "array<string>",
    "starts": "array<bigint>",
    "ends": "array<bigint>",
}
#: Distinct entities and distinct terms of a text that has base spans.
WHOLE = {"who": "array<string>", "words": "array<string>"}


def blanked(text: str, spans: list[Span]) -> str:
    """A text with blanks for its base spans, so that words next to them end there."""
    for s in spans:
        text = f"{text[: s.start]}{' ' * (s.end - s.start)}{text[s.end :]}"
    return text


def find_whole(text: str | None) -> tuple[Any, ...]:
    """``FIELDS`` and ``WHOLE`` of one text, without terms near spans: ``words`` holds them all."""
    spans = base_spans(text)
    counts, base = Counter(s.kind for s in spans), named(spans)
    who = {entity(s.kind, text[s.start : s.end]) for s in spans}
    words = {term(w) for w in blanked(text, spans).split()} - {""} if spans else ()
    return (*[counts[k] for k in KINDS], base, hashlib.sha256(base.encode()).hexdigest(), [], [], [], [], sorted(who), sorted(words))


def find(text: str | None) -> tuple[Any, ...]:
    """``FIELDS`` of one text."""
    spans = base_spans(text)
    counts = Counter(s.kind for s in spans)
    near = []
    taken = sorted((s.start, s.end) for s in spans)
    for span in spans:
        who = entity(span.kind, text[span.start : span.end])
        near += [(who, *c) for c in context(text, span) if not any(a < c[2] and c[1] < b for a, b in taken)]
    base = named(spans)
    columns = [list(c) for c in zip(*near, strict=True)] if near else [[], [], [], []]
    return (*[counts[k] for k in KINDS], base, hashlib.sha256(base.encode()).hexdigest(), *columns)


def found(text: Any, everywhere: bool = False) -> Column:
    """Struct of base spans and the terms around them, or all terms, of a text column; null counts as empty."""
    fields, each = (FIELDS | WHOLE, find_whole) if everywhere else (FIELDS, find)

    def make():
        def work(texts: Texts) -> dict[str, Any]:
            return dict(zip(fields, map(list, zip(*map(each, texts), strict=True)), strict=True))

        return work

    return per_text(make, fields)(text)


def place_in_sieve(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode(), 42) % SIEVE


def counts_of(
    sieve: np.ndarray, everywhere: bool = False, apart: np.ndarray | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to documents per term, for terms whose bit is set; a task adds up before it hands on.

    Texts whose hash ``h`` is set in the field ``apart`` are left to others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[str, str] = {}  # word to the term to count, or ''
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            columns = {"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())}
            batch = pa.RecordBatch.from_pydict(columns)
            counts.clear()
            return batch

        def wanted(word: str) -> str:
            t = term(word)
            place = place_in_sieve(t) if t else 0
            asked[word] = t = t if t and sieve[place >> 3] >> (place & 7) & 1 else ""
            return t

        for batch in batches:
            texts = batch["text"] if apart is None else batch["text"].filter(pa.array(~is_set(apart, batch["h"])))
            for text in texts:
                if len(asked) > HELD:
                    asked.clear()
                own = text.as_py() or ""
                words = set((blanked(own, base_spans(own)) if everywhere else own).split())
                here = {asked[w] if w in asked else wanted(w) for w in words}
                here.discard("")
                counts.update(here)
                if len(counts) > HELD:
                    yield out()
        yield out()

    return run


def is_set(field: np.ndarray, h: pa.Array) -> np.ndarray:
    """Whether the bits of these hashes are set."""
    place = h.to_numpy().view(np.uint64) % np.uint64(SIEVE)
    return (field[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def once_a_task(field: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (h, text) those whose hash is set in ``field``, each text once as long as a task remembers it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            some = batch.filter(pa.array(is_set(field, batch["h"])))
            if len(done) > HELD:
                done.clear()
            fresh = []
            for h in some["h"].to_pylist():
                fresh.append(h not in done)
                done.add(h)
            yield some.filter(pa.array(fresh, pa.bool_()))

    return run


def hits_of(sieve: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (h, text) to places outside base spans of terms whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[str, str] = {}  # word to the term, or ''

        def wanted(word: str) -> str:
            t = term(word)
            place = place_in_sieve(t) if t else 0
            asked[word] = t = t if t and sieve[place >> 3] >> (place & 7) & 1 else ""
            return t

        for batch in batches:
            rows: list[tuple[int, str, int, int]] = []
            for h, text in zip(batch["h"].to_pylist(), batch["text"], strict=True):
                if len(asked) > HELD:
                    asked.clear()
                own = text.as_py() or ""
                for m in WORD.finditer(blanked(own, base_spans(own))):
                    if t := asked[m[0]] if m[0] in asked else wanted(m[0]):
                        lead, trail = (len(m[0]) - len(x) for x in (m[0].lstrip(EDGES), m[0].rstrip(EDGES)))
                        rows.append((h, t, m.start() + lead, m.end() - trail))
            kinds = {"h": pa.int64(), "term": pa.string(), "start": pa.int64(), "end": pa.int64()}
            columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
            yield pa.RecordBatch.from_pydict({c: pa.array(list(v), k) for (c, k), v in zip(kinds.items(), columns, strict=True)})

    return run


def sieve_of(terms: DataFrame, column: str = "term") -> np.ndarray:
    """A bit for each ``term`` (or hash ``h``), in a field of fixed size; false hits only cost time."""
    hashed = F.xxhash64("term") if column == "term" else F.col(column)
    bits = terms.select(F.pmod(hashed, F.lit(SIEVE)).alias("p"))  # of the unsigned hash too: 2**64 is a multiple
    words = bits.groupBy(F.expr("p div 32").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("b"))
    rows = words.collect()  # at most SIEVE / 32 rows, whatever the corpus
    field = np.zeros(SIEVE // 32, "<u4")
    field[[r["w"] for r in rows]] = [r["b"] for r in rows]
    return field.view(np.uint8)


def disclosures(mentions: DataFrame, docs: DataFrame, n: int, support: int = SUPPORT, text_col: str = "text") -> DataFrame:
    """Entity, term and ``share`` of the entity's information that the term discloses.

    ``mentions`` has a row per document with ``pairs``, its distinct (entity,
    term), and ``who``, its distinct entities. Terms are counted over the whole
    texts of ``docs``, of which there are ``n``.
    """
    joint = mentions.select(F.explode("pairs").alias("p")).groupBy("p.entity", "p.term").agg(F.count("*").alias("together"))
    joint = staged(joint.filter(F.col("together") >= support), "joint-counts")
    entities = mentions.select(F.explode("who").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    sieve = docs.sparkSession.sparkContext.broadcast(sieve_of(joint.select("term").distinct()))
    of_task = docs.select(F.col(text_col).alias("text")).mapInArrow(lambda b: counts_of(sieve.value)(b), "term string, n bigint")
    terms = of_task.groupBy("term").agg(F.sum("n").alias("n_term"))
    own = F.log2(F.lit(float(n)) / F.col("n_entity"))
    tie = F.log2(F.lit(float(n)) * F.col("together") / (F.col("n_term") * F.col("n_entity")))
    both = joint.join(entities, "entity").join(terms, "term")
    return both.select("entity", "term", F.when(own > 0, tie / own).alias("share"))


def documents_of(row: str = "row") -> Column:
    """A name of the set of rows of a group: their number, first, last, and two sums of 64 bits."""
    sums = [F.bit_xor(F.xxhash64(F.lit(k), F.col(row))) for k in (1, 2)]
    return F.concat_ws(":", F.count("*"), F.min(row), F.max(row), *sums)


def lower_bounds(pairs: DataFrame, error: float) -> DataFrame:
    """``together``, ``n_term`` and the smallest rate that is no surprise (Clopper and Pearson), for each pair of counts once."""

    def make():
        return lambda rows: {"rate": [1 - upper_bound(r["n_term"] - r["together"], r["n_term"], error) for r in rows]}

    once = pairs.select("together", "n_term").distinct()
    return once.withColumn("low", per_text(make, {"rate": "double"})(F.struct("together", "n_term"))["rate"])


def told_everywhere(
    rows: DataFrame, docs: DataFrame, n: int, support: int, generalise: float, remove: float, error: float | None, text_col: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of terms that disclose classes of entities, and the members of both.

    ``rows`` has ``row``, ``h``, ``who`` and ``words`` of the documents that
    hold an entity, of copies one if ``error`` is given. The first table has
    ``class``, ``terms`` and ``gone``; the others ``entity`` and ``class``, and
    ``term`` and ``terms``. Terms in too many documents to reach the share with
    the most frequent entity are left out before they meet one.
    """
    held = rows.select("row", F.explode("who").alias("entity"))
    entities = held.groupBy("entity").agg(F.count("*").alias("n_entity"), documents_of().alias("class"))
    entities, seen = staged_with(entities.filter(F.col("n_entity") >= support), "entities", most=F.max("n_entity"))

    def reach(n_entity: Column) -> Column:
        """With at most n_entity documents together: n / n_term >= (n / n_entity) ** generalise."""
        return F.lit(float(n)) * F.pow(n_entity / F.lit(float(max(n, 1))), F.lit(generalise)) * 1.000001

    held = staged(held.join(entities, "entity").select("row", "class", "n_entity").distinct(), "held")
    words = rows.join(held.select("row").distinct(), "row").select("row", F.explode("words").alias("term"))
    often = words.groupBy("term").agg(F.count("*").alias("here")).filter(F.col("here") >= support).select("term")
    context = docs.sparkSession.sparkContext
    sieve, counted = context.broadcast(sieve_of(often)), "term string, n bigint"
    texts = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    if error is None:
        of_task = texts.mapInArrow(lambda b: counts_of(sieve.value, True)(b), counted)
    else:  # a text that stands again counts once
        again = context.broadcast(sieve_of(texts.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "h"))
        of_task = texts.mapInArrow(lambda b: counts_of(sieve.value, True, again.value)(b), counted)
        copies = texts.mapInArrow(lambda b: once_a_task(again.value)(b), "h bigint, text string")
        copies = copies.groupBy("h").agg(F.first("text").alias("text"))
        of_task = of_task.unionByName(copies.mapInArrow(lambda b: counts_of(sieve.value, True)(b), counted))
    terms = of_task.groupBy("term").agg(F.sum("n").alias("n_term"))
    terms = terms.filter((F.col("n_term") >= support) & (F.col("n_term") <= reach(F.lit(seen["most"] or 0))))
    told = words.join(terms, "term").groupBy("term").agg(
        F.first("n_term").alias("n_term"), F.count("*").alias("here"), documents_of().alias("terms")
    )
    told = told.filter(F.col("here") >= support).select("term", "n_term", F.concat_ws(":", "n_term", "terms").alias("terms"))
    told = staged(told, "term-classes")
    classes = words.join(told, "term").select("row", "terms", "n_term").distinct()
    pairs = held.join(classes, "row").filter(F.col("n_term") <= reach(F.col("n_entity")))
    joint = pairs.groupBy("class", "terms").agg(
        F.count("*").alias("together"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term")
    )
    own = F.log2(F.lit(float(n)) / F.col("n_entity"))

    def share(rate: Column) -> Column:
        """Of the entity's information what knowing the term discloses, at this conditional probability."""
        return F.when(own > 0, F.log2(F.lit(float(n)) * rate / F.col("n_entity")) / own)

    tie = F.log2(F.lit(float(n)) * F.col("together") / (F.col("n_term") * F.col("n_entity")))
    joint = joint.filter(F.col("together") >= support).withColumn("share", F.when(own > 0, tie / own))
    joint = staged(joint.filter(F.col("share") >= generalise), "joint-counts")
    if error is None:
        gone = joint.withColumn("gone", F.col("share") >= remove)
    else:
        gone = joint.join(lower_bounds(joint, error), ["together", "n_term"]).withColumn("gone", share(F.col("low")) >= remove)
    return staged(gone.select("class", "terms", "gone"), "disclosures"), entities.select("entity", "class"), told.select("term", "terms")


def places_everywhere(
    rows: DataFrame, told: DataFrame, entities: DataFrame, terms: DataFrame, docs: DataFrame, text_col: str
) -> DataFrame:
    """Rows (h, start, end, gone) of told terms: with their entity, and of those to be removed in all documents."""
    terms = terms.join(told.select("terms").distinct(), "terms")
    sieve = docs.sparkSession.sparkContext.broadcast(sieve_of(terms.select("term")))
    texts = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    hits = texts.mapInArrow(lambda b: hits_of(sieve.value)(b), "h bigint, term string, start bigint, end bigint")
    hits = staged(hits.distinct().join(terms, "term").drop("term"), "hits")
    gone = hits.join(told.filter("gone").select("terms", "gone").distinct(), "terms").select("h", "start", "end", "gone")
    who = rows.select("h", F.explode("who").alias("entity")).distinct().join(entities, "entity").select("h", "class").distinct()
    ties = told.join(who, "class").groupBy("h", "terms").agg(F.max("gone").alias("gone"))  # classes that a text holds
    own = hits.join(ties, ["h", "terms"]).select("h", "start", "end", "gone")
    return gone.unionByName(own).groupBy("h", "start", "end").agg(F.max("gone").alias("gone"))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    everywhere: bool = False,
    error: float | None = None,
) -> DataFrame:
    """One row per document: id, ``h`` (hash of the text), ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``.

    ``spans`` holds base spans, then terms to generalise and terms to remove,
    each by place, as kind:start:end in code points. Terms near an entity count,
    and a document without base span has none; ``everywhere``, all terms of a
    document count, and places in all documents; with ``error``, copies of a text
    count as one, and terms are removed by the lower bound of what they
    disclose. Null and empty texts have none, a null id stays null,
    repeated rows stay apart, an empty table gives an empty one.
    """
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), found(F.col(text_col), everywhere).alias("f"))
    rows = base.select(F.monotonically_increasing_id().alias("row"), "id", "h", "f.*")
    rows, seen = staged_with(rows, "mentions", n=F.count("*"))
    if everywhere:
        key, some, n = "h", rows.filter(F.size("who") > 0), seen["n"]
        if error is not None:
            some, n = some.dropDuplicates(["h"]), rows.select("h").distinct().count()
        told, entities, terms = told_everywhere(some, docs, n, support, generalise, remove, error, text_col)
        hit = places_everywhere(some, told, entities, terms, docs, text_col)
    else:
        key = "row"
        parts = {"entities": "entity", "terms": "term", "starts": "start", "ends": "end"}
        zipped = F.arrays_zip(*[F.col(many).alias(one) for many, one in parts.items()])
        near = rows.filter(F.size("terms") > 0)
        pairs = F.array_distinct(F.transform(zipped, lambda z: F.struct(z["entity"].alias("entity"), z["term"].alias("term"))))
        mentions = near.select(pairs.alias("pairs"), F.array_distinct("entities").alias("who"))
        told = disclosures(mentions, docs, seen["n"], support, text_col).filter(F.col("share") >= generalise)
        told = staged(told.select("entity", "term", (F.col("share") >= remove).alias("gone")), "disclosures")
        places = near.select("row", F.explode(zipped).alias("z")).select("row", "z.*")
        hit = places.join(told, ["entity", "term"]).groupBy("row", "start", "end").agg(F.max("gone").alias("gone"))
    kind = F.when(F.col("gone"), "removed").otherwise("generalised")
    listed = F.array_sort(F.collect_list(F.struct(kind.alias("kind"), "start", "end")))  # those of one text
    text = F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    more = hit.groupBy(key).agg(text.alias("more"))
    spans = F.concat_ws(",", F.when(F.col("base_spans") != "", F.col("base_spans")), "more")
    return rows.join(more, key, "left").select(
        F.col("id").alias(id_col), "h", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans")
    )


def replacement(kind: str, word: str) -> str:
    """What stands for a span: its kind; for a generalised term the kind of word that it is."""
    if kind == "removed":
        return ""
    if kind != "generalised":
        return f"<{kind.upper()}>"
    return "<CODE>" if any(c.isdigit() for c in word) else "<NAME>" if word[:1].isupper() else "<WORD>"


def sanitised(text: str | None, spans: str) -> str | None:
    """A text with its spans replaced; spans that overlap are replaced together, by the kind of the first."""
    if not text or not spans:
        return text
    parts, done, until = [], 0, 0
    listed = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",")))
    for k, (start, end, kind) in enumerate(listed):
        if start >= until or not k:
            parts += [text[done:start], replacement(kind, text[start:-end])]
        done = until = max(until, -end)
    return "".join([*parts, text[done:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: Any) -> DataFrame:
    """The documents with spans replaced in their texts, terms ``everywhere`` and removed by proof only; all rows and columns stay."""
    settings = {"everywhere": True, "error": ERROR} | settings
    spans = scan(docs, id_col, text_col, **settings).filter("spans <> ''").groupBy("h").agg(F.first("spans").alias("spans"))
    spans = spans.select(F.col("h").alias("_h"), F.col("spans").alias("_spans"))
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rest = docs.select(held, F.xxhash64(text_col).alias("_own"))
    joined = rest.join(spans, F.col("_own") == F.col("_h"), "left")

    def make():
        return lambda rows: {"text": [sanitised(r["text"], r["spans"] or "") for r in rows]}

    text = per_text(make, {"text": "string"})(F.struct(F.col(f"_row.`{text_col}`").alias("text"), F.col("_spans").alias("spans")))
    done = joined.select("_row", text.alias("_new"))
    columns = [F.col("_new.text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return done.select(columns)
