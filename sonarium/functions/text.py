"""String expressions: tokens, cleaning, edit distances."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from sonarium.functions.fixed import PUNCTUATION

# every character that counts as white space in Python's str.split()
SPACES = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def words(text: Column) -> Column:
    """White-space separated tokens, without empty ones."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of tokens of a raw text; 0 for null or blank."""
    return F.coalesce(F.size(words(text)), F.lit(0))


def clean_text(text: Column) -> Column:
    """Lower case, no ASCII punctuation, single spaces, trimmed."""
    kept = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(kept, SPACES, " "))


# pairs with more cells than this in their edit matrix go to the bit-parallel helper unless they are nearly equal
SHORT_CELLS = 250_000
NEAR = 64


def near_char_distance(a: Column, b: Column) -> Column:
    """Edit distance in characters on the JVM for short or nearly equal texts, null for the others."""

    def settle(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        small = F.length(x).cast("long") * F.length(y) <= SHORT_CELLS
        return (
            F.when(x == y, 0)
            .when(small, F.levenshtein(x, y))
            .when(F.abs(F.length(x) - F.length(y)) > NEAR, F.lit(None).cast("int"))
            .otherwise(F.nullif(F.levenshtein(x, y, NEAR), F.lit(-1)))
        )

    # the one-element transform computes both operands once
    return F.transform(F.array(F.struct(a.alias("x"), b.alias("y"))), settle)[0]


# word lists with more words than this together go to the helper: looking each word up among the pair's words is quadratic
SHORT_WORDS = 128
# code points from here on stand for the distinct words of one short pair
_FIRST_CODE = 0x10000


def near_word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two short word lists on the JVM, null for long ones.

    Every distinct word of the pair becomes one character, so the built-in edit distance counts words.
    """

    def encode(ws: Column, vocab: Column) -> Column:
        code = F.transform(
            ws, lambda w: F.lpad(F.hex(F.array_position(vocab, w) + (_FIRST_CODE - 1)), 8, "0")
        )
        return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")

    # the one-element transform computes the vocabulary once per pair, not once per word
    short = F.transform(
        F.array(F.array_distinct(F.concat(a, b))), lambda vocab: F.levenshtein(encode(a, vocab), encode(b, vocab))
    )[0]
    return F.when(a == b, 0).when((F.size(a) + F.size(b)) <= SHORT_WORDS, short)


# alignments this many symbols behind the furthest one are given up
_BEHIND = 14


def least_edits(a: Sequence, b: Sequence) -> int:
    """A lower bound of the edit distance: symbols of the longer sequence that no symbol of the other can stand for."""
    return max(len(a), len(b)) - (Counter(a) & Counter(b)).total()


def walked_edits(a: Sequence, b: Sequence, limit: int) -> int | None:
    """Edits of one alignment, or null if it takes more than ``limit``; linear in the length times the edits between neighbouring diagonals.

    With each edit every diagonal goes as far as equal symbols let it (Ukkonen 1985); those far behind are given up, so the least number may be missed.
    """
    short, rest = (a, iter(b)) if len(a) <= len(b) else (b, iter(a))
    if limit == abs(len(a) - len(b)) and all(symbol in rest for symbol in short):
        return limit
    n, m = len(a), len(b)
    reached = {0: 0}  # diagonal j - i: the furthest j
    for edits in range(limit + 1):
        far = 0
        for d, j in reached.items():
            i = j - d
            while i < n and j < m and a[i] == b[j]:
                i, j = i + 1, j + 1
            reached[d] = j
            far = max(far, i + j)
        if reached.get(m - n) == m:
            return edits
        moved: dict[int, int] = {}
        for d, j in reached.items():
            # a diagonal too far from the last one for the edits that are left cannot end in time
            if 2 * j - d < far - _BEHIND or abs(m - n - d) > limit - edits:
                continue
            if j < m and moved.get(d + 1, -1) < j + 1:
                moved[d + 1] = j + 1
            if j < m and j - d < n and moved.get(d, -1) < j + 1:
                moved[d] = j + 1
            if j - d < n and moved.get(d - 1, -1) < j:
                moved[d - 1] = j
        reached = moved
    return None


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences.

    An alignment with as few edits as the symbols alone ask for settles the pair in time linear in its length. For the others a column of
    the edit matrix is a step, as bits of one integer (Myers 1999, Hyyrö 2003).
    """
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    settled = walked_edits(a, b, least_edits(a, b))
    return matrix_distance(a, b) if settled is None else settled


def matrix_distance(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences that are not empty, from all columns of the edit matrix."""
    shared, where = set(b), {}
    for i, symbol in enumerate(a):
        if symbol in shared:
            where[symbol] = where.get(symbol, 0) | 1 << i
    full, top = (1 << len(a)) - 1, len(a) - 1
    up, down, total = full, 0, len(a)
    for symbol in b:
        match = where.get(symbol, 0)
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right_up = down | (full ^ (diagonal | up))
        right_down = diagonal & up
        total += (right_up >> top) - (right_down >> top)
        right_up = (right_up << 1 | 1) & full
        up = (right_down << 1 | (full ^ (diagonal | right_up))) & full
        down = right_up & diagonal
    return total


@F.pandas_udf(LongType())
def far_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of the long, differing pairs; pairs settled on the JVM arrive as nulls."""
    out = [
        None if x is None or y is None else edit_distance(x if isinstance(x, str) else list(x), y if isinstance(y, str) else list(y))
        for x, y in zip(a, b)
    ]
    return pd.Series(out, dtype="Int64")


def error_rate(distance: Column, truth_length: Column, predicted_length: Column) -> Column:
    """distance / truth length, at most 1; an empty truth scores 1 if anything was predicted, otherwise 0."""
    return F.when(truth_length == 0, (predicted_length > 0).cast("double")).otherwise(
        F.least(distance / truth_length, F.lit(1.0))
    )


def ratios(a: pa.Array, b: pa.Array, parts: Callable[[str], Sequence]) -> pa.Array:
    """Ratcliff-Obershelp ratio of each pair. One pair's strings are Python objects at a time, whatever the size of the batch."""

    def ratio(x: str | None, y: str | None) -> float | None:
        return None if x is None or y is None else difflib.SequenceMatcher(None, parts(x), parts(y)).ratio()

    return pa.array((ratio(a[i].as_py(), b[i].as_py()) for i in range(len(a))), pa.float64())


@F.arrow_udf(DoubleType())
def text_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Similarity of two texts in characters; no Catalyst form exists."""
    return ratios(a, b, str)


@F.arrow_udf(DoubleType())
def word_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Similarity of two cleaned texts in words; the words are split here, so that no word lists travel."""
    return ratios(a, b, lambda text: [w for w in text.split(" ") if w])
