"""Text normalisers, predicates and splitters as Column expressions.

Java's \\s and \\w are ASCII, so patterns that must follow Unicode say (?U). What Spark has no function for (NFKC, NFKD,
HTML entities beyond the common ones, number words) is one Arrow function each, in functions.python_text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and marks of the Arabic script and what they fold to.
DIACRITICS = "[\u064b-\u065f\u0670\u0640]"
MARKS = "[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u0640]"
SHORT_VOWELS = "[\u064b-\u0652]"
TATWEEL = "\u0640"
ALEFS, BARE_ALEF = "أإآٱ", "ا"
EASTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
DIGITS = "0123456789"
HAMZA, HAMZA_ON_WAW, HAMZA_ON_YA, WAW, YA = "ء", "ؤ", "ئ", "و", "ي"
ALEF_MAKSURA, TEH_MARBUTA, HEH = "ى", "ة", "ه"
ARTICLE = "ال"
ARABIC = "[\u0600-\u06ff]"
LATIN = "[A-Za-z]"
# Latin consonants that Arabic spelling cannot tell apart.
CONSONANT_CLASSES = {"p": "b", "v": "f", "c": "k", "g": "k", "q": "k"}
# Prefixes written onto the next word, in the order in which they are tried.
CLITICS = ("ال", "وال", "بال", "كال", "فال", "لل", "و", "ف", "ب", "ل", "ك", "س")
# Latin spelling of Arabic letters, digraphs included.
LATIN_OF = {
    "ا": "a", "أ": "a", "إ": "a", "آ": "a", "ٱ": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d",
    "ط": "t", "ظ": "z", "ع": "a", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y", "ى": "a", "ة": "h", "ء": "", "ؤ": "w", "ئ": "y",
}
# Phrases that are written in several ways, as patterns and what they become, in order.
PHRASES = (
    (r"(?U)\bان\s*شاء\s*الله\b", "ان شاء الله"), (r"(?U)\bانشالله\b", "ان شاء الله"), (r"(?U)\bما\s*شاء\s*الله\b", "ما شاء الله"),
    (r"(?U)\bماشاءالله\b", "ما شاء الله"), (r"(?U)\bاهلل\b", "الله"), (r"(?U)\bاللو\b", "الله"), ("اهلل", "الله"), ("اللو", "الله"),
)
# The separators of Unicode's class Zs, which SQL's trim cuts off.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# The entities that pages use most.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def composed(c: Column | str) -> Column:
    """The text in compatibility composition (NFKC). Spark has no expression for it; the Arrow function leaves ASCII
    texts as they are."""
    from . import python_text

    return python_text.nfkc(_text(c))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once; inside a lambda an expression would be computed again for each element."""
    return F.get(F.transform(F.array(value), f), 0)


def squeezed(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_text(c), r"[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]+", " "))


def trimmed(c: Column) -> Column:
    """No separators (Zs) at the ends, as SQL's trim has it. It has one parameter, so that F.transform can be given it: F.trim
    has a second one, the characters to cut, and would be handed the element's position there."""
    return F.trim(c, F.lit(SPACES))


def words(c: Column | str) -> Column:
    """Words between ASCII white space, none of them empty."""
    return F.filter(F.split(_text(c), r"[ \t\n\r]+"), lambda w: w != "")


def replaced(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def fold_letters(c: Column) -> Column:
    """Alef forms to bare alef, maksura to ya, teh marbuta to heh, hamza carriers to their letter, digits to ASCII."""
    return F.translate(c, ALEFS + ALEF_MAKSURA + TEH_MARBUTA + HAMZA_ON_WAW + HAMZA_ON_YA + EASTERN_DIGITS + HAMZA, BARE_ALEF * 4 + YA + HEH + WAW + YA + DIGITS)


def _plain(c: Column) -> Column:
    x = F.lower(F.regexp_replace(c, DIACRITICS, ""))
    return squeezed(F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", " "))


def basic(c: Column | str) -> Column:
    """NFKC, marks dropped, lower case, everything but letters, digits and underscores a space."""
    return _plain(composed(c))


def script_aware(c: Column | str) -> Column:
    return _plain(fold_letters(F.regexp_replace(composed(c), DIACRITICS, "")))


def aggressive(c: Column | str) -> Column:
    """script_aware, and the article off words of more than three letters."""
    cut = lambda w: F.when(w.startswith(ARTICLE) & (F.length(w) > 3), F.substring(w, 3, 1 << 30)).otherwise(w)
    return F.array_join(F.transform(words(script_aware(c)), cut), " ")


def leaderboard(c: Column | str) -> Column:
    """Punctuation deleted without a space, short vowels dropped, two Persian letters and hamza forms folded, teh
    marbuta kept."""
    x = F.regexp_replace(_text(c), r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~،؛؟]""", "")
    x = F.regexp_replace(x, SHORT_VOWELS, "")
    x = F.translate(x, "پڤ" + "آأإ" + HAMZA_ON_WAW + HAMZA_ON_YA + EASTERN_DIGITS + HAMZA, "بف" + BARE_ALEF * 3 + WAW + YA + DIGITS)
    return squeezed(x)


def whisper_like(c: Column | str) -> Column:
    """Bracketed stretches dropped; marks dropped; symbols and punctuation a space. Give it NFKD text (python_text.nfkd)
    where letters may carry marks."""
    x = F.regexp_replace(F.lower(_text(c)), r"[<\[][^>\]]*[>\]]", "")
    x = F.regexp_replace(x, r"\(([^)]+?)\)", "")
    x = replaced(x, [("\u0153", "oe"), ("\u00f8", "o"), ("\u00e6", "ae"), ("\u00df", "ss"), ("\u0111", "d"), ("\u00f0", "d"), ("\u00fe", "th"), ("\u0142", "l")])
    return squeezed(F.regexp_replace(F.regexp_replace(x, r"\p{Mn}", ""), r"[\p{M}\p{S}\p{P}]", " "))


def dedup_key(c: Column | str) -> Column:
    return F.lower(squeezed(F.regexp_replace(composed(c), DIACRITICS, "")))


def alias_key(c: Column | str) -> Column:
    """Like a dedup key, without any white space."""
    return F.lower(F.regexp_replace(F.regexp_replace(composed(c), DIACRITICS, ""), r"(?U)\s+", ""))


def compact(c: Column | str) -> Column:
    """Lower case, separators and the word 'and' dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(_text(c)), r"\band\b", ""), r"[\s\-_/.,]+", "")


def split_scripts(c: Column | str) -> Column:
    """A space between Arabic and Latin letters that touch."""
    x = F.regexp_replace(_text(c), r"(?<=[\x{0600}-\x{06ff}])(?=[A-Za-z])", " ")
    return F.regexp_replace(x, r"(?<=[A-Za-z])(?=[\x{0600}-\x{06ff}])", " ")


def strip_html(c: Column | str) -> Column:
    """Scripts, styles, comments and tags become spaces, entities their characters."""
    x = F.regexp_replace(_text(c), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return squeezed(replaced(F.regexp_replace(x, r"<[^>]+>", " "), ENTITIES))


def strip_urls(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), r"(?i)https?://\S+|www\.\S+", " ")


def strip_controls(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), r"[\x{00}-\x{1f}\x{7f}-\x{9f}]", " ")


def set_phrases(c: Column | str) -> Column:
    """Phrases that are written in several ways in one."""
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), PHRASES, _text(c))


def clean_transcript(c: Column | str, keep_teh_marbuta: bool = True, lower_latin: bool = True, say_numbers: bool = False, keep_punctuation: bool = False) -> Column:
    """The ingestion cleaner: entities, NFKC, URLs, tags, controls, marks, letters and digits, script boundaries, case,
    numbers with their units in Arabic words where asked for, letters again, set phrases, punctuation, white space, in
    this order."""
    from . import python_text

    letters = lambda x: F.translate(x, ALEFS + ALEF_MAKSURA + HAMZA_ON_WAW + HAMZA_ON_YA + EASTERN_DIGITS + PERSIAN_DIGITS + HAMZA, BARE_ALEF * 4 + YA + WAW + YA + DIGITS + DIGITS)
    folded = lambda x: letters(x) if keep_teh_marbuta else F.translate(letters(x), TEH_MARBUTA, HEH)
    x = composed(python_text.unescaped(_text(c)))
    x = F.regexp_replace(strip_urls(x), r"<[^>]+>", " ")
    x = folded(F.regexp_replace(strip_controls(x), MARKS, ""))
    x = split_scripts(x)
    x = F.lower(x) if lower_latin else x
    x = folded(python_text.said_in_arabic(x)) if say_numbers else x
    x = set_phrases(x)
    return squeezed(x if keep_punctuation else F.regexp_replace(x, r"[^0-9A-Za-z\s\x{0600}-\x{06ff}]|[،؛؟«»ـ]", " "))


def term_form(c: Column | str) -> Column:
    """A lexicon's key: lower case, no zero-width or direction marks, white space squeezed."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_text(c))), r"[\x{200b}-\x{200f}\x{202a}-\x{202e}]", ""), r"(?U)\s+", " ")


def is_term(c: Column | str, least: int = 2, most: int = 60) -> Column:
    """A key of ASCII letters, digits and the marks of names, within the bounds of length."""
    x = _text(c)
    return F.length(x).between(least, most) & x.rlike(r"^[a-z0-9 \-'/().+]+$")


def has_arabic(c: Column | str) -> Column:
    return _text(c).rlike(ARABIC)


def is_code_switched(c: Column | str) -> Column:
    return _text(c).rlike(ARABIC) & _text(c).rlike(LATIN)


def latin_tokens(c: Column | str, least: int = 2, ignored: Sequence[str] = ()) -> Column:
    found = F.regexp_extract_all(_text(c), F.lit("[A-Za-z]+"), 0)
    return F.size(F.filter(found, lambda w: (F.length(w) >= least) & ~F.lower(w).isin(list(ignored)) if ignored else F.length(w) >= least))


def chars_per_second(text: Column | str, seconds: Column | str) -> Column:
    """Non-space characters a second; infinite where the duration is not positive."""
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.when(seconds > 0, F.length(F.regexp_replace(_text(text), r"\s+", "")) / seconds).otherwise(float("inf"))


def strip_clitic(w: Column, least: int = 4) -> Column:
    """The first clitic that leaves at least `least` letters is cut off."""
    out = w
    for p in reversed(CLITICS):
        out = F.when(w.startswith(p) & (F.length(w) - len(p) >= least), F.substring(w, len(p) + 1, 1 << 30)).otherwise(out)
    return out


def latin_of(c: Column | str, clitics: bool = True) -> Column:
    """An Arabic word in Latin letters: marks dropped, a clitic off unless told not to; Latin letters and digits stay, in
    lower case, and anything else goes."""
    x = F.regexp_replace(composed(c), r"[\x{064b}-\x{0652}\x{0670}\x{0640}]", "")
    x = F.regexp_replace(strip_clitic(x) if clitics else x, "[^A-Za-z0-9" + "".join(LATIN_OF) + "]", "")
    return F.lower(replaced(x, list(LATIN_OF.items())))


def consonants(c: Column | str, merged: bool = False) -> Column:
    """Latin consonants by class, vowels dropped; merged: z as s and d as t as well."""
    x = F.replace(F.lower(_text(c)), F.lit("x"), F.lit("ks"))
    classes = CONSONANT_CLASSES | ({"z": "s", "d": "t"} if merged else {})
    return F.translate(x, "".join(classes) + "aeiouy", "".join(classes.values()))


def arabic_consonants(c: Column | str) -> Column:
    """The consonants of an Arabic word in Latin letters: vowels, and w and h, which may stand for one, dropped."""
    return F.translate(F.lower(_text(c)), "aeiouwh", "")


def skeleton(c: Column | str) -> Column:
    """A Latin word by its coarse sounds: p b, v f and c k alike, h dropped, repeats collapsed, then vowels, y and w
    dropped, so that letters which a vowel parts stay two."""
    x = F.translate(F.lower(_text(c)), "pvcaeiouywh", "bfk@@@@@@@")
    return F.replace(F.regexp_replace(x, r"(.)\1+", "$1"), F.lit("@"), F.lit(""))


def vowels(c: Column | str) -> Column:
    """The vowel pattern: s for each of a i o u, l for each long vowel, the rest dropped."""
    x = F.regexp_replace(F.lower(_text(c)), "[^aiouāīūēō]", "")
    return F.translate(x, "aiouāīūēō", "sssslllll")


def sentences(c: Column | str, least: int = 10, at: str = r"(?<=[.!?])[ \t\n\f\r]+") -> Column:
    """Pieces of at least `least` characters between the ends of sentences (`at`), without separators at their ends."""
    return F.filter(F.transform(F.split(_text(c), at), trimmed), lambda s: F.length(s) >= least)


def paragraphs(c: Column | str, least: int = 6, most: int = 220) -> Column:
    """Lines without bracketed references whose number of words is within bounds."""
    lines = F.transform(F.split(_text(c), "\n"), lambda s: squeezed(F.regexp_replace(s, r"\[\d+(?:,\s*\d+)*\]", " ")))
    return F.filter(lines, lambda s: F.size(words(s)).between(least, most))


def tokens(c: Column | str) -> Column:
    """Latin words, Arabic runs and numbers; punctuation dropped."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(r"[a-z]+(?:'[a-z]+)?|[\x{0600}-\x{06ff}]+|\d+(?:\.\d+)?"), 0)


def offset_tokens(c: Column | str, pattern: str = r"[^\s]+") -> Column:
    """(text, start, end) of each match: the lengths of the matches and of what lies between them, summed."""
    x = _text(c)
    parts = F.struct(F.regexp_extract_all(x, F.lit(pattern), 0).alias("found"), F.split(x, pattern).alias("between"))
    kind = "struct<at:int,out:array<struct<text:string,start:int,end:int>>>"

    def step(s, t):
        start = s["at"] + t["gap"]
        return F.struct((start + F.length(t["w"])).alias("at"), F.concat(s["out"], F.array(F.struct(t["w"].alias("text"), start.alias("start"), (start + F.length(t["w"])).alias("end")))).alias("out"))

    with_gaps = lambda p: F.transform(p["found"], lambda w, i: F.struct(w.alias("w"), F.length(F.get(p["between"], i)).alias("gap")))
    return F.aggregate(let(parts, with_gaps), F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind), step, lambda s: s["out"])


def broken_reference(c: Column | str) -> Column:
    """A lone article, or two and more Arabic tokens of one letter."""
    w = words(c)
    return F.array_contains(w, ARTICLE) | (F.size(F.filter(w, lambda t: (F.length(t) == 1) & t.rlike(ARABIC))) >= 2)


def length_outlier(hyp_words: Column, ref_words: Column, most: float = 1.5) -> Column:
    return F.when(ref_words == 0, hyp_words > 5).otherwise(F.abs(hyp_words - ref_words) / ref_words > most)


def source_name(c: Column | str) -> Column:
    """The last folder or file name of a path, without its extension."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(_text(c), "/+$", ""), "/"), -1), r"\.[A-Za-z0-9]+$", "")


def pretty_seconds(c: Column) -> Column:
    return F.format_string("%dh %02dm %02ds", F.floor(c / 3600).cast("int"), F.floor(c % 3600 / 60).cast("int"), F.floor(c % 60).cast("int"))


def json_body(c: Column | str) -> Column:
    """What stands from the first { to the last }, code fences or not."""
    return F.nullif(F.regexp_extract(_text(c), r"(?s)\{.*\}", 0), F.lit(""))


def choice_letter(c: Column | str, choices: int) -> Column:
    """The position (from 0) of the first lone capital letter among the choices; null if there is none."""
    letter = F.regexp_extract(_text(c), r"(?:^|[^A-Za-z])([A-%s])(?:[^A-Za-z]|$)" % chr(64 + choices), 1)
    return F.when(letter != "", F.ascii(letter) - 65)


def resolve(columns: Sequence[str], aliases: Sequence[str]) -> Column:
    """The first of the aliases, in their order, that is present and not blank."""
    found = [F.nullif(F.trim(F.col(a).cast("string")), F.lit("")) for a in aliases if a in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def timestamp_seconds(c: Column | str) -> Column:
    """mm:ss or hh:mm:ss, in ASCII or Eastern digits, as seconds; null if it is neither."""
    x = F.translate(_text(c), EASTERN_DIGITS, DIGITS)
    p = F.split(x, ":")
    n = lambda i: F.get(p, i).cast("int")
    return F.when(x.rlike(r"^\d+:\d\d$"), n(0) * 60 + n(1)).when(x.rlike(r"^\d+:\d\d:\d\d$"), n(0) * 3600 + n(1) * 60 + n(2))


def spelled_codes(c: Column | str, tokens: int = 3, letters: int = 2) -> Column:
    """Codes that are spelled out: runs of at least `tokens` single letters or digits, `letters` of them letters."""
    runs = F.regexp_extract_all(F.lower(_text(c)), F.lit(r"\b[a-z0-9](?:[\s.\-]+[a-z0-9]\b){%d,}" % (tokens - 1)), 0)
    joined = F.transform(runs, lambda r: F.regexp_replace(r, r"[\s.\-]+", ""))
    return F.filter(joined, lambda r: F.length(F.regexp_replace(r, "[0-9]", "")) >= letters)
