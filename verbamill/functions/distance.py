"""Edit distances. Word distances of short texts use the built-in levenshtein over one character for each distinct word
of a pair; those of long texts are functions.python_text.long_word_edits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, words

#: Words are code points from here on, which leave out the surrogates.
FIRST_CODE, SURROGATES, MOST_WORDS = 0x4E00, 0xD800, 0x10FFFF - 0x4E00 - 0x800


def _coded(of: Column, known: Column) -> Column:
    point = lambda w: F.array_position(known, w) + FIRST_CODE
    code = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.when(point(w) < SURROGATES, point(w)).otherwise(point(w) + 0x800)), 8, "0")), "UTF-32")
    return F.array_join(F.transform(of, code), "")


def word_edits(ref: Column, hyp: Column) -> Column:
    """Word-level edit distance of two arrays of words. Its time grows with the product of their lengths; more than
    MOST_WORDS distinct words are an error."""
    pair = F.struct(ref.alias("r"), hyp.alias("h"), F.array_distinct(F.concat(ref, hyp)).alias("known"))
    distance = lambda p: F.levenshtein(_coded(p["r"], p["known"]), _coded(p["h"], p["known"]))
    return let(pair, lambda p: F.when(F.size(p["known"]) <= MOST_WORDS, distance(p)).otherwise(F.raise_error(F.lit("too many distinct words in a pair")).cast("int")))


def wer(ref: Column | str, hyp: Column | str) -> Column:
    """Edits over reference words; of an empty reference 0 or 1."""
    r, h = words(ref), words(hyp)
    return F.when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).otherwise(word_edits(r, h) / F.size(r))


def cer(ref: Column | str, hyp: Column | str, spaces: bool = False) -> Column:
    """Character edits over reference characters; without spaces unless asked for."""
    r, h = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (ref, hyp))
    if not spaces:
        r, h = F.replace(r, F.lit(" "), F.lit("")), F.replace(h, F.lit(" "), F.lit(""))
    return F.when(F.length(r) == 0, F.when(F.length(h) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(r, h) / F.length(r))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 of two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def lengths_close(a: Column, b: Column, least: float = 0.5, least_short: float = 0.65, short: int = 6) -> Column:
    """The ratio of lengths is at least `least`, or `least_short` where either is short; false of an empty string."""
    n, m = F.length(a), F.length(b)
    bar = F.when((n <= short) | (m <= short), max(least, least_short)).otherwise(least)
    return (n > 0) & (m > 0) & (F.least(n, m) / F.greatest(n, m) >= bar)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def common_prefix(a: Column, b: Column) -> Column:
    both = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(both, lambda n: F.left(a, n) == F.left(b, n)))


def longest_common_substring(a: Column, b: Column) -> Column:
    """Length of the longest stretch that both share; for short strings such as names."""
    n = F.length(a)
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(n - i + 1, F.lit(1))), lambda k: F.substr(a, i, k))))
    return F.coalesce(F.array_max(F.transform(F.filter(cuts, lambda s: F.contains(b, s)), lambda s: F.length(s))), F.lit(0))
