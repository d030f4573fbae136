import math
import re

import pytest
from pyspark.sql import functions as F

from pairloom.llm import queries, quality
from tests.llm.conftest import ODD

SPACE = "[ \t\n\v\f\r]"


def plain(text):
    """Counts of one text, by the definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = set()
    found = {}
    for i, w in enumerate(windows):
        found.setdefault(w, []).append(i)
    for places in found.values():
        if len(places) > 1:
            repeated |= {i + j for i in places for j in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated)


def counts(docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return sorted((tuple(r[c] for c in ("doc_id", *names)) for r in quality.measure(docs).collect()), key=repr)


def test_counts(odd, documents, rows, make):
    more = ["a b c a b c", "x\nx\n \n \nx y\n", "a a a a", "#*$ %&|<>", "\x1c \x85 b", "one"]
    for docs, pairs in ((odd, ODD), (documents, rows), (make(more), list(enumerate(more)))):
        assert counts(docs) == sorted(((i, *plain(t)) for i, t in pairs), key=repr)


def test_binomial():
    def exact(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for k, n, p in [(0, 10, 0.1), (3, 50, 0.05), (12, 40, 0.3), (5, 5, 0.2)]:
        assert quality.at_most(k, n, p) == pytest.approx(exact(k, n, p))
        bound = quality.upper_bound(k, n, 0.05)
        assert k == n and bound == 1 or exact(k, n, bound) == pytest.approx(0.05)


def table(spark, rows):
    """(stratum, symbol share in hundredths, how many)."""
    wide = [(s, 100, 100, share, 1, 0, 0, 0) for s, share, n in rows for _ in range(n)]
    return spark.createDataFrame(wide, "stratum string, " + ", ".join(f"{c} long" for c in quality.COUNTS))


def test_cutoffs_are_proven(spark):
    good = table(spark, [("a", 0, 900), ("a", 20, 3), ("a", 50, 90), ("b", 0, 20), ("c", 12, 2000)])
    found = {(c.stratum, c.rule): c for c in quality.fit(good, {"symbol_share": quality.SHARES}, 0.05, 0.05)}
    assert found["a", "symbol_share"].cutoff == 0.5  # a stricter one would reject 90 of 993
    assert ("b", "symbol_share") not in found  # 20 documents prove nothing
    assert found["c", "symbol_share"].cutoff == 0.15
    for c in found.values():
        assert c.bound <= 0.05


def test_false_rejections_stay_rare_on_new_rows(spark):
    """Rates of the population at the chosen cutoffs, over many draws: too high in at most 5 % of them."""
    import random

    rng = random.Random(3)
    bad = 0
    for _ in range(200):
        shares = [rng.betavariate(1, 9) for _ in range(400)]
        cutoff = None
        for c in quality.SHARES:
            if quality.at_most(sum(s > c for s in shares), len(shares), 0.05) > 0.05:
                break
            cutoff = c
        bad += cutoff is not None and (1 - cutoff) ** 9 > 0.05
    assert bad <= 20


def test_strata_and_labels(spark, make):
    words = " ".join(f"w{i}" for i in range(60))
    noisy = words + " ####" * 40
    texts = [words] * 700 + [noisy] * 5
    docs = make([(i, t) for i, t in enumerate(texts)], ["en"] * 700 + ["en", "en", "en", "xx", None])
    labels = spark.createDataFrame([(i, 1, "x") for i in range(700)] + [(1, 0, "x"), (None, 1, "x"), (9999, 1, "x")], "doc_id long, quality int, text string")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(700), 703, 704]  # nothing is proven for other languages
    assert quality.keep_good(docs, labels.limit(0)).count() == 705


def test_base_rules(odd, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.keep_good(odd, labels).collect()}
    want = {i for i, t in ODD if not (plain(t)[0] < 50 or 100 * plain(t)[4] > 50 * plain(t)[0])}
    assert kept == want


def test_query(spark, sf, rows):
    found = {r.doc_id: r for r in queries.QUERIES["op2_quality_rules"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    cutoffs = quality.learn(quality.measure(spark.read.parquet(f"{sf}/documents.parquet")), labels)
    for i, t in rows:
        n, chars, symbols, dup, repeat = plain(t)
        failed = n < 50 or 100 * repeat > 50 * n
        assert found[i].base_failed == failed
        assert not (failed and found[i].kept)
    assert len(found) == len(rows)
    assert all(c.bound <= quality.MAX_FALSE_REJECTION / len(quality.RULES) for c in cutoffs)


def test_empty(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(empty, labels).count() == 0
    assert quality.learn(quality.measure(empty), labels) == []
    assert quality.measure(empty.withColumn("lang", F.lit(None).cast("string"))).count() == 0
