"""Functions that Spark lacks, as Arrow-batched functions: Unicode forms, entities, and string similarities with
weights. Each makes a new function from the session at call time, so the package is on the executors."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(f, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run


def _pairs(f, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)])

    return run


def nfkc(c: Column) -> Column:
    return _each(lambda x: x if x.isascii() else unicodedata.normalize("NFKC", x), "string")(c)


def nfkd(c: Column) -> Column:
    return _each(lambda x: x if x.isascii() else unicodedata.normalize("NFKD", x), "string")(c)


def unescaped(c: Column) -> Column:
    return _each(html.unescape, "string")(c)


def jaro_of(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    theirs = [y for y, t in zip(b, taken) if t]
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(mine, theirs)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_of(a: str, b: str, weight: float = 0.1, most: int = 4) -> float:
    """The prefix counts at any Jaro score."""
    base, prefix = jaro_of(a, b), 0
    for x, y in zip(a[:most], b[:most]):
        if x != y:
            break
        prefix += 1
    return base + prefix * weight * (1 - base)


def weighted_edits(a, b, cost, gap: float = 1.0, swap: float | None = None) -> float:
    """Edit distance with cost(x, y) of a substitution, `gap` of an insertion or deletion, and `swap` of two
    neighbours in the wrong order where it is given."""
    two, one = None, [gap * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [gap * i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + gap, row[j - 1] + gap, one[j - 1] + (0 if x == y else cost(x, y)))
            if swap is not None and two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + swap)
            row.append(best)
        two, one = one, row
    return one[-1]


def indel_ratio_of(a: str, b: str) -> float:
    """2 * longest common subsequence / total length."""
    total = len(a) + len(b)
    return 1.0 if not total else 1 - weighted_edits(a, b, lambda x, y: 2.0) / total


def partial_ratio_of(a: str, b: str) -> float:
    """The best indel ratio of the shorter string with a stretch of the longer, of its length or cut at either end."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    return max((indel_ratio_of(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b))), default=0.0) if a else 0.0


def edits_of(a: list, b: list) -> int:
    """Edit distance of two sequences, a whole column of the table at a time as the bits of whole numbers."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = every, 0, len(a)  # rows where the column rises by one, and where it falls
    for x in b:
        here = places.get(x, 0)
        zero = ((((here & up) + up) ^ up) | here | down) & every
        rises, falls = down | (every & ~(zero | up)), up & zero
        score += bool(rises & last) - bool(falls & last)
        rises, falls = (rises << 1 | 1) & every, (falls << 1) & every
        up, down = falls | (every & ~(zero | rises)), rises & zero
    return score


def long_word_edits(ref: Column, hyp: Column) -> Column:
    """Word-level edit distance of two texts of any length, words cut at white space."""
    return _pairs(lambda x, y: edits_of(x.split(), y.split()), "long")(ref, hyp)


def word_operations_of(ref: str, hyp: str) -> dict:
    """Substitutions, deletions and insertions of one best alignment; ties prefer them in this order."""
    r, h = ref.split(), hyp.split()
    d = [[max(i, j) if not i or not j else 0 for j in range(len(h) + 1)] for i in range(len(r) + 1)]
    for i in range(1, len(r) + 1):
        for j in range(1, len(h) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (r[i - 1] != h[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    i, j, out = len(r), len(h), {"substitutions": 0, "deletions": 0, "insertions": 0}
    while i or j:
        if i and j and r[i - 1] == h[j - 1] and d[i][j] == d[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            out["substitutions"] += 1
            i, j = i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            out["deletions"] += 1
            i -= 1
        else:
            out["insertions"] += 1
            j -= 1
    return out


def diff_blocks_of(a: str, b: str) -> list[dict]:
    """Blocks of words that differ, with their places in the first text."""
    x, y = a.split(), b.split()
    return [{"start": i, "end": j, "old": " ".join(x[i:j]), "new": " ".join(y[k:m])} for tag, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if tag != "equal"]


def timed_of(words: list[dict], said: list[str]) -> list[dict]:
    """Times for the words of a text from a recogniser's words (text, start, end): an equal word has its own, and those
    of a block that differs share the block's stretch evenly; a block that replaces nothing has the time between its
    neighbours."""
    out: list[dict] = []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, [w["text"] for w in words], said, autojunk=False).get_opcodes():
        if tag == "equal":
            out += [{"text": said[k + n], "start": words[i + n]["start"], "end": words[i + n]["end"]} for n in range(m - k)]
            continue
        since = words[i]["start"] if i < j else words[i - 1]["end"] if i else 0.0
        until = words[j - 1]["end"] if i < j else words[i]["start"] if i < len(words) else since
        step = (until - since) / max(m - k, 1)
        out += [{"text": said[k + n], "start": since + n * step, "end": since + (n + 1) * step} for n in range(m - k)]
    return out


def timed(words: Column, said: Column) -> Column:
    """words: array of (text, start, end); said: array of words."""

    @F.pandas_udf("array<struct<text:string,start:double,end:double>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else timed_of([dict(w) for w in x], list(y)) for x, y in zip(a, b)])

    return run(words, said)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _pairs(jaro_winkler_of, "double")(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    return _pairs(indel_ratio_of, "double")(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    return _pairs(partial_ratio_of, "double")(a, b)


def word_operations(ref: Column, hyp: Column) -> Column:
    @F.pandas_udf("substitutions int, deletions int, insertions int")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([word_operations_of(x or "", y or "") for x, y in zip(a, b)], columns=["substitutions", "deletions", "insertions"])

    return run(ref, hyp)


def diff_blocks(a: Column, b: Column) -> Column:
    return _pairs(diff_blocks_of, "array<struct<start:int,end:int,old:string,new:string>>")(a, b)


# Number words of English.
SMALL_NUMBERS = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}


def number_of(spoken: list[str]) -> int | None:
    """The value of up to five number words, or None."""
    total, part, seen = 0, 0, False
    for w in spoken:
        if w in SMALL_NUMBERS:
            if part % 10 or (part % 100 and SMALL_NUMBERS[w] > 9):
                return None
            part += SMALL_NUMBERS[w]
        elif w in TENS:
            if part % 100:
                return None
            part += TENS[w]
        elif w == "hundred" and 0 < part < 10:
            part *= 100
        elif w == "thousand" and 0 < part < 1000:
            total, part = total + part * 1000, 0
        elif not (w == "and" and seen):
            return None
        seen = True
    return total + part if seen and spoken[-1] != "and" else None


# Number words of Arabic, letters folded as normalisers fold them or not.
ARABIC_NUMBERS = {
    "صفر": 0, "واحد": 1, "اثنين": 2, "اثنان": 2, "ثلاثه": 3, "ثلاثة": 3, "اربعه": 4, "اربعة": 4, "خمسه": 5, "خمسة": 5, "سته": 6, "ستة": 6, "سبعه": 7, "سبعة": 7, "ثمانيه": 8, "ثمانية": 8,
    "تسعه": 9, "تسعة": 9, "عشره": 10, "عشرة": 10, "احد": 11, "احدعشر": 11, "اثناعشر": 12, "ثلاثهعشر": 13, "اربعهعشر": 14, "خمسهعشر": 15, "ستهعشر": 16, "سبعهعشر": 17, "ثمانيهعشر": 18,
    "تسعهعشر": 19, "عشرون": 20, "عشرين": 20, "ثلاثون": 30, "ثلاثين": 30, "اربعون": 40, "اربعين": 40, "خمسون": 50, "خمسين": 50, "ستون": 60, "ستين": 60, "سبعون": 70, "سبعين": 70,
    "ثمانون": 80, "ثمانين": 80, "تسعون": 90, "تسعين": 90, "مايه": 100, "مائه": 100, "مئه": 100, "مائة": 100, "الف": 1000, "الفين": 2000, "مليون": 1000000,
}
AND_IN_ARABIC, THOUSANDS_IN_ARABIC = "و", ("الف", "الفين")


def arabic_number_of(spoken: list[str]) -> int | None:
    """The value of digits that stand together, of one number word, of two with 'and' between them, or of a thousand or
    two with digits behind."""
    if all(w.isdecimal() for w in spoken):
        return int("".join(spoken))
    known = [ARABIC_NUMBERS.get(w) for w in spoken]
    match spoken:
        case [_]:
            return known[0]
        case [_, w, _] if w == AND_IN_ARABIC and known[0] is not None and known[2] is not None:
            return known[0] + known[2]
        case [w, n] if w in THOUSANDS_IN_ARABIC and n.isdecimal():
            return known[0] + int(n)
    return None


def folded_numbers_of(text: str, value_of=number_of) -> str:
    """Spelled numbers as digits, the longest of up to five words first, from left to right."""
    w, out, i = text.split(), [], 0
    while i < len(w):
        for n in range(min(5, len(w) - i), 0, -1):
            if (value := value_of(w[i : i + n])) is not None:
                out.append(str(value))
                i += n
                break
        else:
            out.append(w[i])
            i += 1
    return " ".join(out)


def folded_arabic_numbers(c: Column) -> Column:
    return _each(lambda x: folded_numbers_of(x, arabic_number_of), "string")(c)


def folded_numbers(c: Column) -> Column:
    return _each(folded_numbers_of, "string")(c)


def joined_compounds_of(a: str, b: str) -> dict:
    """Both texts with words joined wherever they differ only in where words are split."""
    x, y = a.split(), b.split()
    left, right = [], []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        same = tag == "replace" and "".join(x[i:j]) == "".join(y[k:m])
        left.append("".join(x[i:j]) if same else " ".join(x[i:j]))
        right.append("".join(y[k:m]) if same else " ".join(y[k:m]))
    return {"ref": " ".join(filter(None, left)), "hyp": " ".join(filter(None, right))}


def joined_compounds(ref: Column, hyp: Column) -> Column:
    @F.pandas_udf("ref string, hyp string")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([joined_compounds_of(x or "", y or "") for x, y in zip(a, b)], columns=["ref", "hyp"])

    return run(ref, hyp)


def number_words_of(n: int) -> str:
    """English words of a whole number below a million."""
    small, tens = list(SMALL_NUMBERS), {v: k for k, v in TENS.items()}
    if n < 20:
        return small[n]
    if n < 100:
        return tens[n // 10 * 10] + (f" {small[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{small[n // 100]} hundred" + (f" {number_words_of(n % 100)}" if n % 100 else "")
    return f"{number_words_of(n // 1000)} thousand" + (f" {number_words_of(n % 1000)}" if n % 1000 else "")


# Arabic names of numbers and units.
ARABIC_ONES = "صفر واحد اثنان ثلاثه اربعه خمسه سته سبعه ثمانيه تسعه عشره".split() + ["احد عشر", "اثنا عشر", "ثلاثه عشر", "اربعه عشر", "خمسه عشر", "سته عشر", "سبعه عشر", "ثمانيه عشر", "تسعه عشر"]
ARABIC_TENS = "عشرون ثلاثون اربعون خمسون ستون سبعون ثمانون تسعون".split()
ARABIC_HUNDREDS = "مائه مئتان ثلاثمائه اربعمائه خمسمائه ستمائه سبعمائه ثمانمائه تسعمائه".split()
ARABIC_UNITS = {
    "mg": "مليغرام", "milligram": "مليغرام", "milligrams": "مليغرام", "mcg": "ميكروغرام", "ug": "ميكروغرام", "microgram": "ميكروغرام", "micrograms": "ميكروغرام", "g": "غرام", "gram": "غرام", "grams": "غرام",
    "kg": "كيلوغرام", "kilogram": "كيلوغرام", "kilograms": "كيلوغرام", "ml": "مليلتر", "milliliter": "مليلتر", "milliliters": "مليلتر", "l": "لتر", "liter": "لتر", "liters": "لتر",
    "mmhg": "مليمتر زئبق", "bpm": "نبضه في الدقيقه", "iu": "وحده دوليه", "%": "بالمئه",
}


def arabic_words_of(n: int) -> str:
    """Arabic words of a whole number below ten thousand, from the greatest part down, joined by 'and'."""
    parts = []
    if n >= 1000:
        parts.append("الف" if n < 2000 else f"{ARABIC_ONES[n // 1000]} الاف")
    if n % 1000 >= 100:
        parts.append(ARABIC_HUNDREDS[n % 1000 // 100 - 1])
    rest = n % 100
    if rest >= 20:
        parts += [ARABIC_ONES[rest % 10]] * (rest % 10 > 0) + [ARABIC_TENS[rest // 10 - 2]]
    elif rest or not parts:
        parts.append(ARABIC_ONES[rest])
    return " و ".join(parts)


def said_in_arabic_of(text: str, units: dict[str, str] = ARABIC_UNITS) -> str:
    """Whole numbers below ten thousand as Arabic words, a unit right after one by its name; other numbers stay."""

    def say(m: re.Match) -> str:
        number = arabic_words_of(int(m[1])) if m[1].isdecimal() and int(m[1]) < 10_000 else m[1].replace(",", ".")
        unit = (m[2] or "").lower()
        return f" {number} {units.get(unit, unit)} " if unit else f" {number} "

    return re.sub(r"(?<!\w)(\d+(?:[.,]\d+)?)(?:\s*([A-Za-z%]+))?", say, text)


def said_in_arabic(c: Column) -> Column:
    return _each(said_in_arabic_of, "string")(c)


def verbalised_of(text: str, units: dict[str, str]) -> str:
    """Numbers, with a unit that stands right after, as words; decimals digit by digit after the point."""

    def say(m: re.Match) -> str:
        whole, _, part = m[1].replace(",", ".").partition(".")
        if len(whole) > 6:
            return m[0]
        said = number_words_of(int(whole)) + (" point " + " ".join(number_words_of(int(d)) for d in part) if part else "")
        unit = (m[2] or "").lower()
        return said + (f" {units.get(unit, unit)}" if unit else "")

    return re.sub(r"(?<!\w)(\d+(?:[.,]\d+)?)(?:\s*([A-Za-z%]+))?", say, text)


def verbalised(c: Column, units: dict[str, str]) -> Column:
    return _each(lambda x: verbalised_of(x, units), "string")(c)


def ctc_log_probability(frames: np.ndarray, labels: list[int], blank: int = 0) -> float:
    """Log-probability of a label sequence under log-posteriors of (frames, symbols), summed over all alignments, for
    each label; -1e9 without labels or frames, or with fewer frames than labels."""
    if not labels or len(frames) < len(labels):
        return -1e9
    path = [blank, *[s for x in labels for s in (x, blank)]]
    a = np.full(len(path), -np.inf)
    a[:2] = frames[0, path[:2]]
    skip = np.array([k > 1 and path[k] != blank and path[k] != path[k - 2] for k in range(len(path))])
    for f in frames[1:]:
        one = np.append(-np.inf, a[:-1])
        two = np.where(skip, np.append([-np.inf, -np.inf], a[:-2])[: len(a)], -np.inf)
        a = np.logaddexp(np.logaddexp(a, one), two) + f[path]
    return float(np.logaddexp(a[-1], a[-2])) / len(labels)
