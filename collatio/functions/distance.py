"""Edit distances and error rates as Column expressions on Spark's own levenshtein."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

#: Distinct words of a pair stand for code points from here on: so many below the surrogates, then those of the planes beyond.
FIRST, LOW, ROOM = 0x4E00, 0xD800 - 0x4E00, 0xD800 - 0x4E00 + 0x100000


def char_edits(ref: Column, hyp: Column) -> Column:
    """Insertions, deletions and substitutions of code points. For long lines see `align.char_edits`."""
    return F.levenshtein(ref, hyp).cast("long")


def _as_symbols(words: Column, known: Column) -> Column:
    point = lambda w: F.array_position(known, w) + F.when(F.array_position(known, w) > LOW, 0x10000 - LOW - 1).otherwise(FIRST - 1)
    return F.decode(F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(point(w)), 8, "0")), "")), "UTF-32")


def word_edits(ref: Column, hyp: Column) -> Column:
    """Edits between arrays of words: each distinct word of the pair is given a code point of its own.

    There are over a million of them; a pair with more distinct words raises an error, not a wrong count.
    """
    known = F.array_union(ref, hyp)
    fits = F.size(known) <= ROOM
    edits = F.levenshtein(_as_symbols(ref, known), _as_symbols(hyp, known)).cast("long")
    return F.when(fits, edits).otherwise(F.raise_error(F.lit("too many distinct words in a pair")).cast("long"))


def rate(edits: Column, n_ref: Column, hyp_empty: Column) -> Column:
    """Edits over reference length; for an empty reference 0 if the hypothesis is empty too, else 1."""
    return F.when(n_ref == 0, F.when(hyp_empty, 0.0).otherwise(1.0)).otherwise(edits / F.nullif(n_ref, F.lit(0)))


def cer(ref: Column, hyp: Column) -> Column:
    return rate(char_edits(ref, hyp), F.length(ref), F.length(hyp) == 0)


def wer(ref: Column, hyp: Column) -> Column:
    r, h = tokens(ref), tokens(hyp)
    return rate(word_edits(r, h), F.size(r), F.size(h) == 0)


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.nullif(longer, F.lit(0)))
