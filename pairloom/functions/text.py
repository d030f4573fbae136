"""Column functions over passage text.

Every function takes and returns a Column built from Spark's own expressions,
so text never leaves the JVM. White space means Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom import values as V


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space at both ends."""
    return F.btrim(_col(c), F.lit(V.WHITE_SPACE))


def squeeze(c: Column | str) -> Column:
    """Turn every run of white space into one space and strip."""
    return strip(F.regexp_replace(_col(c), f"(?U){V.WS}+", " "))


def clean_brackets(c: Column | str) -> Column:
    """Drop bracketed notes of all eight kinds, then squeeze white space.

    Kinds are removed one after another and nesting is not followed, so text
    between an inner and an outer closing bracket stays.
    """
    out = _col(c)
    for pattern in V.BRACKETS:
        out = F.regexp_replace(out, pattern, "")
    return squeeze(out)


def remove_title(c: Column | str) -> Column:
    """Keep what follows the passage mark, drop title lines, join lines."""
    c = _col(c)
    marked = F.split(c, f"\\Q{V.PASSAGE_MARK}\\E", -1)
    out = F.when(F.contains(c, F.lit(V.PASSAGE_MARK)), strip(F.get(marked, F.lit(1)))).otherwise(c)
    for pattern in V.TITLES:
        out = F.regexp_replace(out, f"(?mdU){pattern}", "")
    return F.regexp_replace(strip(out), "\n+", " ")


def normalize_ws(c: Column | str) -> Column:
    """One line with single spaces."""
    return squeeze(c)


def split_sentences(c: Column | str) -> Column:
    """Sentences between runs of ``.``, ``!`` and ``?``, stripped, no empties."""
    parts = F.split(_col(c), "[.!?]+", -1)
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 0)


def words(c: Column | str) -> Column:
    """The white-space separated words."""
    return F.regexp_extract_all(_col(c), F.lit(f"(?U){V.NOT_WS}+"), F.lit(0))


def n_words(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit(f"(?U){V.NOT_WS}+"))


def n_sentences(c: Column | str) -> Column:
    """Number of sentences, counted without building them.

    A sentence is a stretch without terminators that holds a visible
    character; the pattern matches each such stretch once.
    """
    return F.regexp_count(_col(c), F.lit(r"(?U)[^.!?\s\x1c-\x1f][^.!?]*"))


def mean_sentence_words(c: Column | str) -> Column:
    """Mean number of words per sentence, 0 for a text without sentence."""
    in_sentences = F.regexp_count(_col(c), F.lit(r"(?U)[^.!?\s\x1c-\x1f]+"))
    return F.coalesce(F.try_divide(in_sentences, n_sentences(c)), F.lit(0.0))


def text_counts(c: Column | str) -> dict[str, Column]:
    """The four per-text measures by name."""
    return {
        "chars": F.length(_col(c)),
        "words": n_words(c),
        "sentences": n_sentences(c),
        "sentence_words": mean_sentence_words(c),
    }


def length_gate(c: Column | str, lo: int = 300, hi: int = 500) -> Column:
    """``too_short``, ``ok`` or ``too_long``; a null text is ``missing``."""
    n = F.length(_col(c))
    return (
        F.when(n.isNull(), "missing").when(n < lo, "too_short").when(n > hi, "too_long").otherwise("ok")
    )


def truncate_at_period(c: Column | str, n: int = 500) -> Column:
    """Shorten a text longer than ``n``.

    If the last period of the whole text lies before position ``n`` the text
    ends there, otherwise it is cut hard at ``n``.
    """
    c = _col(c)
    from_end = F.locate(".", F.reverse(c))
    last = F.length(c) - from_end
    return (
        F.when(F.length(c) <= n, c)
        .when((from_end > 0) & (last < n), F.substring(c, F.lit(1), last + 1))
        .otherwise(F.substring(c, 1, n))
    )


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance in code points."""
    return F.levenshtein(_col(a), _col(b))


def normalized_similarity(a: Column | str, b: Column | str) -> Column:
    """``1 - distance / longer length``; 1 for two empty texts."""
    longest = F.greatest(F.length(_col(a)), F.length(_col(b)))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - edit_distance(a, b) / longest)


def scale_1_5(similarity: Column | str) -> Column:
    """Grade a similarity from 1 to 5."""
    s = _col(similarity)
    (limit, grade), *rest = V.GRADES
    out = F.when(s >= limit, grade)
    for limit, grade in rest:
        out = out.when(s >= limit, grade)
    return F.when(s.isNotNull(), out.otherwise(1))


def preview(c: Column | str, n: int, always: bool = True) -> Column:
    """The first ``n`` characters and dots; ``always=False`` spares short texts."""
    c = _col(c)
    short = F.concat(F.substring(c, 1, n), F.lit("..."))
    return short if always else F.when(F.length(c) > n, short).otherwise(c)


def topic_from_name(c: Column | str) -> Column:
    """Topic part of ``<label>_<nn>_<topic>``; null for an unknown label."""
    c = _col(c)
    known = F.startswith(c, F.lit(V.HIGH_PREFIX)) | F.startswith(c, F.lit(V.LOW_PREFIX))
    parts = F.split(c, "_", -1)
    return F.when(known, F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "_"))
