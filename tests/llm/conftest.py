import pytest

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row long, h string, id string, spans string, f int"
)


def table(spark, texts, langs=None):
    """Documents with columns whose names operators use themselves. ``texts``: (id, text) pairs or texts."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    langs = langs or ["en"] * len(rows)
    rows = [(i, t, lang, "s", len(t or ""), True, -1, "x", "y", "z", 3) for (i, t), lang in zip(rows, langs, strict=True)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture
def make(spark):
    return lambda texts, langs=None: table(spark, texts, langs)


LONG = " ".join(f"word{i % 977}" for i in range(30_000))

#: Null and empty texts, null and repeated ids, repeated rows, ties, long texts, odd characters.
ODD = [
    (1, None),
    (2, ""),
    (None, "some text without an id"),
    (None, "some text without an id"),
    (None, None),
    (5, "same text here for everyone to read"),
    (6, "same text here for everyone to read"),
    (6, "same text here for everyone to read"),
    (7, "  \n\t "),
    (8, "x"),
    (8, "another text under the same id"),
    (9, LONG),
    (10, LONG + " end"),
    (11, LONG),
    (12, "a" * 40_000),
    (13, "Zoë ÉTÉ ﬁ \x00 \x1c 😀 ١٢ a　b\x85c\n\n  d"),
    (14, "it's  don't <|endoftext|> x<s>y</s>"),
]


@pytest.fixture
def odd(make):
    return make(ODD)


@pytest.fixture
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
