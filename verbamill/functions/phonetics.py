"""How words sound, within a script and across Arabic and Latin: skeletons, class strings, weighted edits, blends and
the predicates of a span matcher. What Spark can say is a Column expression; sequence scans are Arrow functions, for
which the package must be on the executors (verbamill.session.ship). Similarities run from 0 to 1 unless a name ends
in `score`, which runs from 0 to 100."""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from .python_text import _pairs, indel_ratio_of, jaro_winkler_of, nfkd, partial_ratio_of, weighted_edits
from .text import ARABIC, _text, replaced

# Arabic letters by the Latin letter that their skeleton has.
ARABIC_SOUNDS = {
    "a": "اأإآىع", "b": "بپ", "t": "تطة", "s": "ثسصش", "j": "جچ", "h": "حه", "k": "خقكگ", "d": "دض", "z": "ذزظ", "r": "ر",
    "g": "غ", "f": "فڤ", "l": "ل", "m": "م", "n": "ن", "w": "وؤ", "y": "يئ",
}
# Skeleton letters of one sound class, and neighbouring classes, between which a change costs a half.
SOUND_CLASS = {"B": "bp", "F": "fv", "T": "td", "S": "sz", "K": "kg", "J": "j", "R": "r", "L": "l", "M": "m", "N": "n", "H": "h", "W": "w", "Y": "y", "A": "a"}
NEAR_CLASSES = ("BF", "TS", "SJ", "KJ", "KH", "WA", "YA", "NM", "RL")
# What it costs to read one Arabic letter for another; any other change costs 3, as do a letter too
# many, one too few, and two in the wrong order.
MERGERS = {
    "س": {"ص": 1, "ث": 1}, "ص": {"س": 1, "ض": 2}, "ث": {"س": 1, "ت": 2, "ذ": 2}, "ط": {"ت": 1, "ظ": 2}, "ت": {"ط": 1, "ث": 2, "د": 2},
    "د": {"ض": 1, "ذ": 2, "ظ": 2, "ت": 2}, "ض": {"د": 1, "ظ": 2, "ز": 2}, "ذ": {"ز": 1, "ظ": 2, "د": 2}, "ظ": {"ز": 2, "ذ": 2, "ض": 1}, "ز": {"ذ": 1, "ض": 2, "ظ": 2},
    "ع": {"ا": 2, "أ": 2, "إ": 2, "ء": 2}, "ا": {"ع": 2, "أ": 1, "إ": 1, "ى": 2}, "أ": {"ا": 1, "إ": 1, "ع": 2, "ء": 2}, "إ": {"ا": 1, "أ": 1, "ع": 2}, "ء": {"ا": 2, "ع": 2, "أ": 2},
    "غ": {"ق": 1, "ع": 2}, "ق": {"غ": 1, "ك": 2}, "ك": {"ق": 2}, "ى": {"ا": 2, "ي": 1}, "ي": {"ى": 1}, "ة": {"ه": 1}, "ه": {"ة": 1}, "ؤ": {"و": 2, "ء": 3}, "ئ": {"ي": 2, "ء": 3},
}
OTHER_COST = 3
# Misspellings that no single change of a letter explains.
MISSPELLINGS = {"مرد": "مريض", "هسري": "هستوري", "تهب": "تهاب"}
# Words too short or too common to be a name; the first list at either end of a span, the second anywhere.
GLUE = frozenset(
    "a an and are as at be by for from had has have her him his i if in into is it its me my no not now of on or our she so than that the their them then there these they this those to was we "
    "were what when where which who why will with you your yours twice once daily day days week weeks month months year years patient takes take taking every today tomorrow yesterday next last "
    "morning evening night bp hr rr temp o2 o2sat spo2 bpm ecg ekg cbc bmp cmp inr ptt a1c iv im sc po prn bid tid qid".split()
)
TINY_GLUE = frozenset("a an the to of i is it at in on or and e uh um eh ah oh ya ye".split())
SHORTEST_SPAN = 4
# Long vowels, the ending that is written on a T, and letters that begin a verb.
LONG_VOWELS, VERB_PREFIXES = "اوي", "يتنأا"
PLAUSIBLE_CLITICS = ("وال", "بال", "كال", "فال", "لل", "ال", "و", "ب", "ل", "ك", "ف", "س")


def squashed(c: Column) -> Column:
    """Runs of a character as one."""
    return F.regexp_replace(c, r"(.)\1+", "$1")


def arabic_skeleton(c: Column | str) -> Column:
    """An Arabic word by its sounds in Latin letters: marks and a leading 'and' (of words of six letters and more)
    dropped, letters without a sound dropped, repeats squashed."""
    x = F.regexp_replace(nfkd(_text(c)), r"\p{M}", "")
    x = F.when(x.startswith("و") & (F.length(x) >= 6), F.substring(x, 2, 1 << 30)).otherwise(x)
    x = F.regexp_replace(x, "[^" + "".join(ARABIC_SOUNDS.values()) + "]", "")
    return squashed(F.translate(x, "".join(ARABIC_SOUNDS.values()), "".join(k * len(v) for k, v in ARABIC_SOUNDS.items())))


def latin_skeleton(c: Column | str) -> Column:
    return squashed(F.translate(replaced(F.lower(_text(c)), [("ph", "f"), ("ou", "w")]), "cqvpgx", "kkfbjk"))


def sound_classes(skeleton: Column) -> Column:
    """A skeleton's classes; a letter of none stands for itself in upper case."""
    pairs = [(x, k) for k, letters in SOUND_CLASS.items() for x in letters]
    return F.upper(F.translate(skeleton, "".join(x for x, _ in pairs), "".join(k for _, k in pairs)))


def class_cost(x: str, y: str) -> float:
    return 0.5 if x + y in NEAR_CLASSES or y + x in NEAR_CLASSES else 1.0


def class_similarity_of(a: str, b: str) -> float:
    """Of two class strings: 0.6 of weighted edits over the longer length, 0.4 of Jaro-Winkler; 0 if either is empty."""
    if not a or not b:
        return 0.0
    return 0.6 * (1 - weighted_edits(a, b, class_cost) / max(len(a), len(b))) + 0.4 * jaro_winkler_of(a, b)


def class_similarity(a: Column, b: Column) -> Column:
    return _pairs(class_similarity_of, "double")(a, b)


def merger_cost(x: str, y: str) -> int:
    return MERGERS.get(x, {}).get(y, OTHER_COST)


def merger_similarity_of(a: str, b: str) -> float:
    """1 - weighted edits with swaps / the most they can be."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return max(0.0, 1 - weighted_edits(a, b, merger_cost, OTHER_COST, OTHER_COST) / (OTHER_COST * max(len(a), len(b))))


def merger_similarity(a: Column, b: Column) -> Column:
    return _pairs(merger_similarity_of, "double")(a, b)


# How a word's consonants are merged for the vowel-aware score: Fixed values.
_MERGED = str.maketrans("pvcgqzd", "bfkkkst", "aeiouy") | {ord("x"): "ks"}


def skeleton_score_of(a: str, b: str) -> float:
    """The indel ratio of merged consonants; from 80 to below 100, vowel patterns that agree by 75 and more add a fifth
    of what they agree above that. 0 where either has no consonants."""
    x, y = (w.lower().translate(_MERGED) for w in (a, b))
    if not x or not y:
        return 0.0
    score = 100 * indel_ratio_of(x, y)
    if 80 <= score < 100:
        p, q = (vowel_pattern_of(w) for w in (a, b))
        if p and q and (agree := 100 * indel_ratio_of(p, q)) >= 75:
            score = min(100.0, score + (agree - 75) * 0.2)
    return score


def vowel_pattern_of(word: str) -> str:
    return "".join("s" if x in "aiou" else "l" for x in word.lower() if x in "aiouāīūēō")


def skeleton_score(a: Column, b: Column) -> Column:
    return _pairs(skeleton_score_of, "double")(a, b)


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def compact_of(text: str) -> str:
    return re.sub(r"[\s\-_/.,]+", "", re.sub(r"\band\b", "", text.lower()))


def without_glue(text: str) -> str:
    return "".join(w for w in words_of(text) if w not in TINY_GLUE)


def sorted_ratio_of(a: str, b: str) -> float:
    """The indel ratio of words in order."""
    return indel_ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio_of(a: str, b: str) -> float:
    """The best indel ratio among the words in common and those with the rest of either side; 1 if one holds the other,
    0 where either has no words."""
    x, y = set(a.split()), set(b.split())
    both, left, right = x & y, x - y, y - x
    if not x or not y:
        return 0.0
    if both and not (left and right):
        return 1.0
    common = " ".join(sorted(both))
    one, two = (" ".join(filter(None, [common, *sorted(r)])) for r in (left, right))
    return max(indel_ratio_of(one, two), *([indel_ratio_of(common, one), indel_ratio_of(common, two)] if common else [0.0]))


_METAPHONE = (
    (r"(?<=m)b$", ""), (r"^(?:kn|gn|pn|wr|ae)", lambda m: m[0][1]), (r"^x", "s"), (r"^wh", "w"), (r"sch", "sk"), (r"tch", "X"), (r"(?:ch|sh)", "X"), (r"(?<=s)ci|(?<=s)ce", lambda m: m[0][1]), (r"cia", "Xa"), (r"[st]i(?=[ao])", "X"), (r"c(?=[iey])", "s"),
    (r"dg(?=[eiy])", "j"), (r"gh(?![aeiou]|$)", ""), (r"gh$", ""), (r"gn$|gned$", lambda m: m[0][1:]), (r"g(?=[iey])", "j"), (r"th", "0"), (r"ph", "f"), (r"ck", "k"), (r"q", "k"), (r"x", "ks"), (r"z", "s"), (r"v", "f"), (r"c", "k"), (r"d", "t"), (r"g", "k"),
    (r"[wy](?![aeiou])", ""), (r"(?<=[aeiou])h(?![aeiou])", ""), (r"(?<=[cgpst])h", ""), (r"([a-zX0])\1+", r"\1"),
)


def metaphone_of(word: str) -> str:
    """Metaphone, by its textbook rules in order: silent letters, digraphs, soft consonants, then vowels but the first."""
    w = re.sub(r"[^a-z]", "", word.lower())
    w = re.sub(r"([abd-z])\1", r"\1", w)
    for old, new in _METAPHONE:
        w = re.sub(old, new, w)
    return (w[:1] + re.sub("[aeiou]", "", w[1:])).upper()


def metaphones_of(text: str) -> str:
    return " ".join(filter(None, (metaphone_of(w) for w in words_of(text) if w != "and")))


def composite_score_of(a: str, b: str) -> float:
    """How well a span `a` matches a variant `b`: the best of a blend of words, compact spelling and sound, and of the
    latter two with a discount. Words are compared as sets if both sides have as many, else in order. The compact form
    may match within a longer span, or without tiny glue words. A span that covers less than 0.85 of the variant loses
    200 times the square of what it lacks."""
    x, y, p, q = compact_of(a), compact_of(b), without_glue(a), without_glue(b)
    s, t = " ".join(a.lower().split()), " ".join(b.lower().split())
    spelled = 100 * (set_ratio_of if len(words_of(a)) == len(words_of(b)) else sorted_ratio_of)(s, t)
    tight = 100 * indel_ratio_of(x, y) if x and y else 0.0
    i, j = metaphones_of(a), metaphones_of(b)
    sound = 100 * indel_ratio_of(i, j) if i and j else 0.0
    if len(x) >= len(y) >= 5 and (share := len(y) / len(x)) >= 0.55 and (part := 100 * partial_ratio_of(x, y)) >= 90:
        tight = max(tight, part * (0.7 + 0.3 * share))
    if p and q:
        if (p, q) != (x, y):
            tight = max(tight, 100 * indel_ratio_of(p, q))
        if (i := metaphone_of(p)) and (j := metaphone_of(q)):
            sound = max(sound, 100 * indel_ratio_of(i, j))
    best = max(0.5 * spelled + 0.2 * tight + 0.3 * sound, 0.92 * tight, 0.85 * sound)
    lack = max(0.0, 0.85 - len(x) / len(y)) if x and y else 0.0
    return max(0.0, best - 200 * lack * lack)


def composite_score(a: Column, b: Column) -> Column:
    return _pairs(composite_score_of, "double")(a, b)


def cross_script_score_of(spelled: str, variant: str) -> float:
    """How well an Arabic word, spelled in Latin letters, matches a Latin variant: 0.6 of the consonants' indel ratio and
    0.4 of the words'. Skeletons under four letters, and those of four that are not all but equal, are capped by the
    words' ratio; lengths that are far apart cost by the square, and very far ones everything."""
    x = "".join(c for c in spelled.lower() if c not in "aeiouwh")
    y = "".join({"p": "b", "v": "f", "c": "k", "g": "k", "q": "k", "x": "ks"}.get(c, c) for c in variant.lower() if c not in "aeiouy")
    s, t = " ".join(spelled.lower().split()), " ".join(variant.lower().split())
    alike = 100 * indel_ratio_of(x, y) if x and y else 0.0
    words = 100 * sorted_ratio_of(s, t) if s and t else 0.0
    score = 0.6 * alike + 0.4 * words
    if x and y:
        shortest, ratio = min(len(x), len(y)), len(x) / len(y)
        if shortest < 4:
            score = min(score, 50.0, 0.4 * words)
        elif shortest < 5 and alike < 90:
            score = min(score, 60.0, *([0.5 * words] if words < 75 else []))
        score -= 500 * max(0.0, 0.65 - ratio) ** 2 + 100 * max(0.0, ratio - 1.5) ** 2
        score = 0.0 if ratio < 0.4 else max(0.0, score)
    if s and t:
        ratio = len(s) / len(t)
        score = 0.0 if ratio < 0.35 else max(0.0, score - 400 * max(0.0, 0.5 - ratio) ** 2)
    return score


def cross_script_score(spelled: Column, variant: Column) -> Column:
    return _pairs(cross_script_score_of, "double")(spelled, variant)


def plausibility(c: Column | str) -> Column:
    """How likely an Arabic word is native: by its consonants once a clitic is off, 0.9 up to four, 0.6 up to six, else
    0.2, and 0.2 more where four letters and more begin like a verb. A word of one letter is 1, of another script 0."""
    x = F.trim(_text(c))
    core = x
    for p in reversed(PLAUSIBLE_CLITICS):
        core = F.when(x.startswith(p) & (F.length(x) - len(p) >= 3), F.substring(x, len(p) + 1, 1 << 30)).otherwise(core)
    n = F.length(F.regexp_replace(core, f"[{LONG_VOWELS}ة]", ""))
    score = F.when(n <= 4, 0.9).when(n <= 6, 0.6).otherwise(0.2)
    score = F.when(F.left(core, F.lit(1)).isin(*VERB_PREFIXES) & (F.length(core) >= 4), F.least(F.lit(1.0), score + 0.2)).otherwise(score)
    return F.when(~core.rlike(r"^[\x{0600}-\x{06ff}]+$"), 0.0).when(F.length(core) < 2, 1.0).otherwise(score)


def is_filler(c: Column | str, particles: Collection[str], known: Collection[str]) -> Column:
    """Arabic words that are never names: empty ones, particles, and known words of four letters and more, also behind
    an article. Marks and punctuation at the ends do not count. Morphological analysis is not at hand."""
    x = F.regexp_replace(_text(c), r"[\x{064b}-\x{0652}\x{0670}\x{0640}]", "")
    x = F.regexp_replace(x, r"^[\p{P}\s]+|[\p{P}\s]+$", "")
    bare = F.regexp_replace(x, "^(?:وال|بال|كال|فال|ال|لل)(?=.)", "")
    return (x == "") | x.isin(*particles) | ((F.length(x) > 3) & (x.isin(*known) | bare.isin(*known)))


def bad_span(text: Column, filler_words: Column, known: Collection[str] = ()) -> Column:
    """Spans that cannot be a name: those that run over the end of a sentence; Arabic ones whose words are all filler
    (`filler_words` counts those), or of four tokens and more of which two and more are not Arabic; Latin ones without
    words, of one word that is glue or shorter than SHORTEST_SPAN, or that glue begins or ends. A compact form that is
    known makes good a short word and glue at the ends, but not a word that is glue alone."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    tokens = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    arabic = F.size(F.regexp_extract_all(text, F.lit(f"{ARABIC}+"), 0))
    compact = F.regexp_replace(F.regexp_replace(F.lower(text), r"\band\b", ""), r"[\s\-_/.,]+", "")
    bare = F.array_join(F.filter(words, lambda w: ~w.isin(*TINY_GLUE)), "")
    is_known = (compact.isin(*known) | bare.isin(*known)) if known else F.lit(False)
    first, last = F.get(words, 0), F.element_at(words, -1)
    glue = lambda w: w.isin(*GLUE)
    single = glue(first) | ((F.length(first) < SHORTEST_SPAN) & ~is_known)
    several = (glue(first) | glue(last)) & ~is_known
    latin = F.when(F.size(words) == 0, True).when(tokens == 1, single).otherwise(several)
    wide = (tokens >= 4) & (tokens >= arabic + 2)
    return F.when(text.rlike(r"[.!?;:]\s+\S"), True).when(text.rlike(ARABIC), (filler_words >= arabic) | wide).otherwise(latin)
