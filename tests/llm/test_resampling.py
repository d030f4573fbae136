import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import resampling
from tests.llm.conftest import ODD


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_buckets(text, longest=2, buckets=10_000):
    w = plain_words(text)
    return [crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, percent=25, least=20, seed=7, buckets=10_000):
    """(id, n_features, weight, score, rank) of each row."""
    own = [plain_buckets(t) for _, t in rows]
    s, t = Counter(b for f in own for b in f), Counter(b for x in target for b in plain_buckets(x))
    ns, nt = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out, may = [], []
    for k, ((i, text), f) in enumerate(zip(rows, own, strict=True)):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(plain_words(text)) >= least:
            may.append(k)
    order = sorted(may, key=lambda k: (-out[k][3], out[k][0] is not None, out[k][0] or 0, out[k][1]))
    for rank, k in enumerate(order[: percent * len(may) // 100], 1):
        out[k][4] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.fixture
def target(spark):
    texts = ["the quick brown fox", "same text here for everyone to read", None, "", "word1 word2 word3", "the quick brown fox"]
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "item_id string, text string")


def compare(docs, rows, target, **settings):
    found = resampling.resample(docs, target, **settings).collect()
    texts = [r.text for r in target.collect()]
    known = {"percent": 25} | {k: v for k, v in settings.items() if k in ("percent", "least", "seed")}
    assert sorted(map(tuple, found), key=repr) == plain(rows, texts, **known)
    return found


def test_odd(odd, empty, target):
    compare(odd, ODD, target, percent=100, least=1)
    compare(odd, ODD, target)
    compare(empty, [], target)
    compare(odd, ODD, target.limit(0), percent=60, least=3)


def test_all_documents(spark, sf, documents, rows):
    found = compare(documents, rows, spark.read.parquet(f"{sf}/benchmark.parquet"))
    drawn = [r["rank"] for r in found if r["rank"]]
    assert sorted(drawn) == list(range(1, len(drawn) + 1)) and len(drawn) > 10


def test_hot_copies_are_ranked_over_many_stretches(make, target):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(i % 7, text) for i in range(600)]
    compare(make(rows), rows, target, percent=50, stretch=50)


@pytest.mark.parametrize("longest", [1, 2, 3, 4])
def test_overlapping_matches_are_the_n_grams(rows, longest):
    find = resampling.pattern(longest).finditer
    for _, text in [*rows[:60], *ODD]:
        line = resampling.plain_words(text)
        assert line.decode().split(" ") == (plain_words(text) or [""])
        got = np.array(resampling.features(line, find), np.uint32) % 10_000
        assert sorted(got.tolist()) == sorted(plain_buckets(text, longest))


def test_documents_like_the_target_weigh_more(make, spark):
    like = [f"alpha beta gamma delta number{i} " * 6 for i in range(30)]
    other = [f"some plain words of no kind {i} " * 6 for i in range(90)]
    aim = spark.createDataFrame([(i, "alpha beta gamma delta") for i in range(50)], "item_id int, text string")
    found = resampling.resampled(make(like + other), aim).collect()
    assert len(found) == 30 and sum(r.doc_id < 30 for r in found) >= 25
    assert {"text", "lang", "kept", "rank"} <= set(found[0].asDict())


def test_every_document_has_its_features(documents, rows):
    found = resampling.featured(documents, "doc_id", "text", 2, 10_000).select(F.count("*"), F.sum("n_features"), F.sum(F.length("features"))).first()
    n = sum(len(plain_buckets(t)) for _, t in rows)
    assert found[:] == (len(rows), n, 2 * n)
