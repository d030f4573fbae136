"""Edit distance of whole texts, as far as a grade depends on it.

A column of the table of distances is kept as two long integers, one bit per row:
where the distance rises and where it falls from one row to the next. Only the
rows around the diagonal that a distance up to the bound can touch are kept; the
window moves down by one row with each column. The bound starts small and is
doubled, and a pass ends as soon as the bound can't be met any more, so the work
for a text grows with its length and with the distance, not with the square.

No two texts are closer than their letters: each edit takes away one letter that
one text has more often, or adds one that it has less often. So the bound starts
there, and texts whose letters alone are too far apart need no table. Texts of one
length are no farther apart than the places where they differ, and no texts than
the edits that lead from one to the other by trial; if both counts are the same,
they are the distance, else it lies between. Where few edits are left to be found, long common
parts are jumped over instead (:func:`sparse`), at a cost that does not grow with
the length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: First bound.
FIRST = 32
#: Edits are looked for one by one while their square is below so many times the length.
SPARSE = 4
#: Characters behind an edit on trial that are looked at.
AHEAD = 32
#: Letters are counted in an array if it needs no more than so many places for each letter there is.
PLACES = 8
#: Texts handled at once inside a task.
SLICE = 64


def common_prefix(a: str, b: str) -> int:
    """Length of what both texts begin with."""
    low, high = 0, min(len(a), len(b))
    if a[:1] != b[:1]:
        return 0
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def _codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def places_apart(a: str, b: str) -> int:
    """At how many places two texts of one length differ."""
    return int(np.count_nonzero(_codes(a) != _codes(b)))


def letters_apart(a: str, b: str) -> int:
    """How many edits the letters of two texts need at least, wherever they stand."""
    x, y = _codes(a), _codes(b)
    if len(x) == len(y):  # letters at the same place take each other away
        differ = x != y
        x, y = x[differ], y[differ]
    if not len(x) or not len(y):
        return max(len(x), len(y))
    top = int(max(x.max(), y.max())) + 1
    if top <= PLACES * (len(x) + len(y)):
        left = np.bincount(x, minlength=top) - np.bincount(y, minlength=top)
        more = int(left[left > 0].sum())
    else:
        theirs = Counter(y.tolist())
        more = sum(max(0, n - theirs[c]) for c, n in Counter(x.tolist()).items())
    return max(more, more + len(b) - len(a))


def agreed(a: str, b: str, i: int, j: int) -> int:
    """For how many characters ``a`` from i on and ``b`` from j on agree."""
    start, step = i, 16
    while (part := a[i : i + step]) == b[j : j + step] and len(part) == step:
        i, j, step = i + step, j + step, 2 * step
    return i - start + common_prefix(part, b[j : j + step])


def edits_tried(a: str, b: str, most: int) -> int:
    """Some number of edits that suffices, often the least: always the edit behind which the texts agree longest. More than ``most`` if these don't."""
    i = j = agreed(a, b, 0, 0)
    n = 0
    while n <= most:
        if i == len(a) or j == len(b):
            return n + len(a) - i + len(b) - j
        n += 1
        ways = (i + 1, j + 1), (i + 1, j), (i, j + 1)
        for i, j in ways:
            part = a[i : i + AHEAD]
            if len(part) == AHEAD and part == b[j : j + AHEAD]:  # none agrees longer, of those alike the first counts
                same = AHEAD + agreed(a, b, i + AHEAD, j + AHEAD)
                break
        else:
            same, i, j = max((common_prefix(a[x : x + AHEAD], b[y : y + AHEAD]), x, y) for x, y in ways)
        i, j = i + same, j + same
    return n


def sparse(a: str, b: str, k: int) -> int | None:
    """The distance of two texts if it is at most ``k``, at a cost of its square.

    For each number of edits and each diagonal, how far into ``a`` they lead: one
    edit on from where one edit less leads to, then on while both texts agree.
    """
    m, n = len(a), len(b)
    if abs(m - n) > k:
        return None
    above, below = (k - m + n) // 2, (k + m - n) // 2  # diagonals that k edits can come back from
    far = [-2] * (above + below + 3)  # place of diagonal d: below + 1 + d
    goal = below + 1 + n - m
    for e in range(k + 1):
        before = far[:]
        for at in range(max(1, below + 1 - e), min(above + below + 1, below + 1 + e) + 1):
            off = at - below - 1
            i = max(before[at] + 1, before[at - 1], before[at + 1] + 1) if e else 0
            if i > m:
                i = m
            if i + off > n:
                i = n - off
            if i < m and i + off < n and a[i] == b[i + off]:
                i += agreed(a, b, i, i + off)
            far[at] = i
        if far[goal] == m:
            return e
    return None


def banded(a: str, b: str, k: int) -> int | None:
    """The distance of two texts if it is at most ``k``.

    A way of ``k`` edits leaves the diagonal by so many rows only as it can come
    back from, so the window reaches ``above`` rows above the column's number and
    ``below`` rows below. Bit p of a word stands for row j - above + p of column j. A
    row enters with the window's last bit, so where its character stands is
    shifted once for every column since, when the character is asked for next.
    """
    m, n = len(a), len(b)
    if abs(m - n) > k:
        return None
    above, below = (k - m + n) // 2, (k + m - n) // 2
    full, last = (1 << (above + below + 1)) - 1, 1 << (above + below)
    where: dict[str, tuple[int, int]] = {}
    for row in range(1, min(below, m) + 1):
        bits, at = where.get(a[row - 1], (0, 0))
        where[a[row - 1]] = (bits >> (row - below - at) | last, row - below) if bits else (last, row - below)
    rises, falls = full >> above << above, 0  # in column 0 the distance rises from row 1 on
    found = min(below, m)  # in the window's last row, or in the last row of all
    turn = max(0, m - below)  # from this column on the last row of all is in the window
    most = k + n - turn
    for j in range(1, n + 1):
        row = j + below
        if row <= m:
            bits, at = where.get(a[row - 1], (0, j))
            where[a[row - 1]] = (bits >> (j - at) | last, j)
        bits, at = where.get(b[j - 1], (0, j))
        same = bits >> (j - at)
        level = (((same & rises) + rises) ^ rises) | same | falls  # no rise along the diagonal
        level &= full
        up = falls | (full & ~(level | rises))
        down = level & rises
        if j <= turn:
            found += not level & last
            if found > most:
                return None
        else:
            place = m - j + above
            found += (up >> place & 1) - (down >> place & 1)
        level >>= 1
        rises = down | (full & ~(level | up))
        falls = level & up
    return found if found <= k else None


def distance(a: str, b: str, most: int) -> int | None:
    """Levenshtein distance in code points if it is at most ``most``."""
    if a == b:
        return 0
    start = common_prefix(a, b)
    a, b = a[start:], b[start:]
    end = common_prefix(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return len(a) + len(b) if len(a) + len(b) <= most else None
    least = letters_apart(a, b)
    if least > most:
        return None
    enough = places_apart(a, b) if len(a) == len(b) else most + 1
    if enough > least:
        enough = min(enough, edits_tried(a, b, min(enough, most)))
    if enough == least:
        return least
    most = min(most, enough)
    few = min(most, isqrt(SPARSE * min(len(a), len(b))))
    if least <= few:
        found = sparse(a, b, few)
        if found is not None or few == most:
            return found
        least = few + 1
    k = min(most, max(FIRST, least + least // 4))
    while True:
        found = banded(a, b, k)
        if found is not None or k >= most:
            return found
        k = min(most, 2 * k)


def edit_distance_within(a: Column | str, b: Column | str, share: float = 0.2) -> Column:
    """Levenshtein distance of two texts if it is at most ``share`` of the longer one (rounded up); null beyond, or if one is null."""

    @arrow_udf("int")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out: list[int | None] = []
            for i in range(0, len(left), SLICE):
                both = zip(left.slice(i, SLICE).to_pylist(), right.slice(i, SLICE).to_pylist(), strict=True)
                out += [None if x is None or y is None else distance(x, y, int(share * max(len(x), len(y))) + 1) for x, y in both]
            yield pa.array(out, pa.int32())

    return run(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def similarity_within(a: Column, b: Column, distance: Column) -> Column:
    """``1 - distance / longer length``; 1 for two empty texts, null where the distance is."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - distance / longest)
