"""Trigrams, full-text terms and stems."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English stop words of the text search.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only
own same so than too very s t can will just don should now
""".split()


# Trigrams ---------------------------------------------------------------------------------------------------

def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words, each word padded with two blanks before and one after.

    Words are set three blanks apart, so one regular expression with a look-ahead yields every window; windows
    that would span two words are the ones ending in two blanks, and they are not matched.
    """
    padded = F.concat(F.lit("  "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "   "), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit("(?=(..[^ ]|.[^ ] ))"), F.lit(1)))


def trigram_code(gram: Column) -> Column:
    """A trigram as one number, 21 bits per character: set operations on numbers are several times faster."""
    code = lambda i: F.ascii(F.substr(gram, F.lit(i), F.lit(1))).cast("long")
    return code(1) * F.lit(1 << 42) + code(2) * F.lit(1 << 21) + code(3)


def trigram_codes(c: Column) -> Column:
    return F.transform(trigrams(c), trigram_code)


def overlap_similarity(overlap: Column, left_size: Column, right_size: Column) -> Column:
    """Shared over united set size, rounded to single precision as the text search's similarity is."""
    union = (left_size + right_size - overlap).cast("double")
    return F.when(union > 0, (overlap.cast("double") / union)).otherwise(0.0).cast("float").cast("double")


def similarity(a: Column, b: Column) -> Column:
    ta, tb = trigrams(a), trigrams(b)
    return overlap_similarity(F.size(F.array_intersect(ta, tb)), F.size(ta), F.size(tb))


# Full-text terms --------------------------------------------------------------------------------------------

_COMPOUND = r"\p{L}[\p{L}\p{N}]*(?:-\p{N}*\p{L}[\p{L}\p{N}]*)+"
_NUMBER = r"[+-]?\p{N}+(?:\.\p{N}+)?(?![\p{L}\p{N}])"
_WORD = r"[\p{L}\p{N}]+"


def words(c: Column) -> Column:
    """Lower-case text-search words: hyphenated compounds with their parts, signed numbers, plain words.

    'US-1' gives 'us' and '-1'. Stop words are dropped; nothing is stemmed yet.
    """
    raw = F.regexp_extract_all(F.lower(c), F.lit(f"({_COMPOUND}|{_NUMBER}|{_WORD})"), F.lit(1))
    is_compound = lambda w: w.rlike(r"\p{L}.*-")
    parts = F.flatten(F.transform(F.filter(raw, is_compound), lambda w: F.split(w, "-")))
    return F.array_except(F.array_distinct(F.concat(raw, parts)), F.split(F.lit(" ".join(STOP_WORDS)), " "))


def is_stemmed(word: Column) -> Column:
    """Words without digits are stemmed; numbers and mixed words are kept as they are."""
    return ~word.rlike(r"\p{N}")


@F.pandas_udf(T.StringType())
def english_stem(words: pd.Series) -> pd.Series:
    """Snowball English stem; applied to distinct vocabulary words only."""
    return words.map(stem_word, na_action="ignore")


# Kept where it is written: the planner may otherwise repeat it in filters made from a join on its result.
english_stem = english_stem.asNondeterministic()


_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI_ENDINGS = "cdeghkmnrt"

# Fixed values of the Snowball English ("Porter 2") definition.
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky",
    "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "",
}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti",
          "ous", "ive", "ize"]


def _regions(w: str) -> tuple[int, int]:
    def after_pair(start):
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
                return i + 1
        return len(w)

    for prefix in ("gener", "commun", "arsen"):
        if w.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        r1 = after_pair(0)
    return r1, after_pair(r1)


def _ends_in_short_syllable(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return (len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS)


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


def _has_vowel(s: str) -> bool:
    return any(ch in _VOWELS for ch in s)


@functools.lru_cache(maxsize=65_536)
def stem_word(word: str) -> str:
    """Snowball English stem of one lower-case word."""
    if len(word) <= 2:
        return word
    w = word.lstrip("'")
    if w in _EXCEPTIONS:
        return _EXCEPTIONS[w]
    # A 'y' at the start or after a vowel counts as a consonant and is written 'Y' until the end.
    w = "".join("Y" if ch == "y" and (i == 0 or w[i - 1] in _VOWELS) else ch for i, ch in enumerate(w))
    r1, r2 = _regions(w)

    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in _KEPT_AFTER_1A:
        return w.lower()

    # Past and progressive forms, adverbs of them.
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and _has_vowel(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _ends_in_short_syllable(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"

    # Derivational endings.
    end = _longest(w, list(_STEP2) + ["ogi", "li"])
    if end and len(w) - len(end) >= r1:
        if end == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif end == "li":
            w = w[:-2] if len(w) > 2 and w[-3] in _LI_ENDINGS else w
        else:
            w = w[: -len(end)] + _STEP2[end]
    end = _longest(w, list(_STEP3) + ["ative"])
    if end and len(w) - len(end) >= r1:
        if end == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(end)] + _STEP3[end]
    end = _longest(w, _STEP4 + ["ion"])
    if end and len(w) - len(end) >= r2:
        if end != "ion" or w[-4:-3] in ("s", "t"):
            w = w[: -len(end)]

    # Final e and double l.
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_in_short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
