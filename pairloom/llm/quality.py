"""Quality rules whose cutoffs keep the rate of false rejections under control.

Every rule rejects texts whose measure lies above a cutoff. In each stratum the
cutoffs are tried from the mildest on. One holds if the labelled good documents
prove that it rejects few of them: with k of n rejected, the exact binomial
probability of so few at the permitted rate must lie below the error permitted,
divided by the number of rules and strata. The first that fails ends the rule's
series; a series in fixed order needs no further correction.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import Texts, per_text, staged

#: Signs counted as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SPACES = b" \t\n\v\f\r"

#: Rules: a measure and its cutoffs, mildest first. A share lies between 0 and 1.
SHARES = (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04)
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": SHARES,
    "upper_share": SHARES,
    "dup_line_share": SHARES,
    "repeat_share": SHARES,
    "mean_word_chars": (100.0, 50.0, 30.0, 20.0, 15.0),
}
#: False rejections permitted per stratum over all rules, and the chance that this is exceeded anywhere.
MAX_FALSE_REJECTION, ERROR = 0.05, 0.05
#: More strata than this are taken for a mistake in the choice of the column.
MAX_STRATA = 10_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found, inside = Counter(windows), bytearray(len(words))
    for i, w in enumerate(windows):
        if found[w] > 1:
            inside[i : i + 3] = b"\1\1\1"
    return sum(inside)


def text_stats(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of one text; null has no words."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    upper = len(raw) - len(raw.translate(None, UPPER))
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words), upper


def stats(text: Any) -> Column:
    """Struct of ``COUNTS`` of a text column."""

    def make():
        def work(texts: Texts) -> dict[str, Any]:
            return dict(zip(COUNTS, zip(*map(text_stats, texts), strict=True), strict=True))

        return work

    return per_text(make, dict.fromkeys(COUNTS, "bigint"))(text)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """The measure of each rule, from ``COUNTS``; 0 where it has no base."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "mean_word_chars": share("word_chars", "n_words"),
    }


def at_most(k: int, n: int, p: float) -> float:
    """Probability of k or fewer of n at rate p, exactly summed."""
    if k >= n:
        return 1.0
    log = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def upper_bound(k: int, n: int, error: float) -> float:
    """Largest rate at which k or fewer of n still have probability ``error`` (Clopper and Pearson)."""
    low, high = k / n if n else 0.0, 1.0
    if k >= n:
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at_most(k, n, mid) > error else (low, mid)
    return high


class Cutoff(NamedTuple):
    """A rule that holds in a stratum, and what proves it."""

    stratum: str
    rule: str
    cutoff: float
    n_good: int
    n_rejected: int
    bound: float


def fit(
    labelled: DataFrame,
    rules: dict[str, tuple[float, ...]] = RULES,
    rate: float = MAX_FALSE_REJECTION,
    error: float = ERROR,
) -> list[Cutoff]:
    """The strictest cutoff proven for each stratum and rule; none where the labels prove none.

    ``labelled`` has ``COUNTS`` and ``stratum`` of documents labelled good that
    pass the base rules. One row per stratum comes to the driver.
    """
    values = measures()
    over = [F.sum((values[r] > c).cast("long")).alias(f"{r}_{i}") for r, cs in rules.items() for i, c in enumerate(cs)]
    rows = labelled.groupBy("stratum").agg(F.count("*").alias("n"), *over).limit(MAX_STRATA + 1).collect()
    if len(rows) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    each, share = error / max(1, len(rows) * len(rules)), rate / len(rules)
    out = []
    for row in sorted(rows, key=lambda r: r["stratum"]):
        for rule, cutoffs in rules.items():
            best = None
            for i, cutoff in enumerate(cutoffs):
                k = row[f"{rule}_{i}"]
                if at_most(k, row["n"], share) > each:
                    break
                best = Cutoff(row["stratum"], rule, cutoff, row["n"], k, upper_bound(k, row["n"], each))
            if best:
                out.append(best)
    return out


def rejected(cutoffs: list[Cutoff], stratum: Column) -> Column:
    """Whether any cutoff of the row's stratum is exceeded. ``COUNTS`` must be columns."""
    out = F.lit(False)
    for rule, value in measures().items():
        own = {c.stratum: c.cutoff for c in cutoffs if c.rule == rule}
        if own:
            table = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
            out = out | F.coalesce(value > F.try_element_at(table, stratum), F.lit(False))
    return out


def stratum_of(column: str | None) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")) if column else F.lit("")


def learn(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> list[Cutoff]:
    """Cutoffs from the documents that ``labels`` (id, ``quality`` 1 or 0) calls good.

    ``measured`` has the id, ``stratum`` and ``COUNTS``. An id labelled twice is
    good if one label says so; documents without label or id teach nothing.
    """
    good = labels.groupBy(id_col).agg(F.max("quality").alias("_q")).filter("_q = 1").select(id_col)
    return fit(measured.filter(~base_failed()).join(good, id_col))


def judge(measured: DataFrame, cutoffs: list[Cutoff]) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to rows that have ``stratum`` and ``COUNTS``."""
    failed = base_failed()
    return measured.withColumns({"base_failed": failed, "kept": ~failed & ~rejected(cutoffs, F.col("stratum"))})


def measure(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang"
) -> DataFrame:
    """Id, ``stratum`` and ``COUNTS`` of every whole text. A null text has no words; a null stratum is ''."""
    found = docs.select(F.col(id_col), stratum_of(stratum_col).alias("stratum"), stats(F.col(text_col)).alias("s"))
    return found.select(id_col, "stratum", "s.*")


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang"
) -> DataFrame:
    """The documents that the rules keep, as they came, repeated rows included.

    Null, empty and short texts (under 50 words) go by the base rules. Without
    labels, or with too few to prove a cutoff, only the base rules work.
    """
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    found = docs.select(held, F.col(id_col).alias("_id"), stratum_of(stratum_col).alias("stratum"), stats(F.col(text_col)).alias("_s"))
    found = staged(found.select("_row", "_id", "stratum", "_s.*"), "measures")  # texts are measured once
    cutoffs = learn(found.withColumnRenamed("_id", id_col), labels, id_col)
    return judge(found, cutoffs).filter("kept").select("_row.*")
