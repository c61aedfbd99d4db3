"""Stems of Spanish and English words by the published Snowball algorithms, on words without accents."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings by which a word without accents counts as Spanish; verb forms need a stem of four letters.
SPANISH_ENDS = (
    "cion", "ando", "iendo", "ados", "idas", "mente", "idad", "idades", "ista", "istas", "ismo", "ismos", "ador", "adora",
    "eces", "izar", "ificar", "ecer", "acer",
)
VERB_FORMS = ("ar", "er", "ir", "ado", "ada", "ido", "ida")

# Fixed values of the published Spanish algorithm, without accents.
PRONOUNS = ("selas", "selos", "sela", "selo", "las", "les", "los", "nos", "me", "se", "la", "le", "lo")
NOUNS = (
    "anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa",
    "osos", "osas", "amiento", "amientos", "imiento", "imientos",
)
AGENTS = ("adora", "ador", "acion", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias")
Y_VERBS = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yas", "yes", "yais", "yamos")
VERBS = (
    "arian", "arias", "aran", "aras", "ariais", "aria", "areis", "ariamos", "aremos", "ara", "are",
    "erian", "erias", "eran", "eras", "eriais", "eria", "ereis", "eriamos", "eremos", "era", "ere",
    "irian", "irias", "iran", "iras", "iriais", "iria", "ireis", "iriamos", "iremos", "ira", "ire",
    "aba", "ada", "ida", "ia", "iera", "ad", "ed", "id", "ase", "iese", "aste", "iste", "an", "aban", "ian", "ieran", "asen",
    "iesen", "aron", "ieron", "ado", "ido", "ando", "iendo", "io", "ar", "er", "ir", "as", "abas", "adas", "idas", "ias", "ieras",
    "ases", "ieses", "is", "ais", "abais", "iais", "arais", "ierais", "aseis", "ieseis", "asteis", "isteis", "ados", "idos",
    "amos", "abamos", "iamos", "imos", "aramos", "ieramos", "iesemos", "asemos",
)

# Fixed values of the published English algorithm.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
WHOLE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble",
    "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _ending(word: str, begin: int, endings) -> str:
    """The longest of the endings that lies in the word from a place on."""
    return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= begin), key=len, default="")


def _region(word: str, begin: int, vowels: str) -> int:
    """Where the region behind the first consonant after a vowel begins."""
    found = re.compile(f"[{vowels}][^{vowels}]").search(word, begin)
    return found.end() if found else len(word)


def spanish(word: str) -> str:
    vowel = "aeiou"
    if len(word) < 3:
        return word
    if word[1] not in vowel:
        at = next((k + 1 for k in range(2, len(word)) if word[k] in vowel), len(word))
    elif word[0] in vowel:
        at = next((k + 1 for k in range(2, len(word)) if word[k] not in vowel), len(word))
    else:
        at = 3
    one = _region(word, 0, vowel)
    two = _region(word, one, vowel)

    pronoun = _ending(word, at, PRONOUNS)
    base = word[: len(word) - len(pronoun)]
    if pronoun and (_ending(base, at, ("ando", "iendo", "ar", "er", "ir")) or (_ending(base, at, ("yendo",)) and base.endswith("uyendo"))):
        word = base

    def without(part: str, *before: str) -> str:
        e = _ending(part, two, before)
        return part[: len(part) - len(e)] if e else part

    stemmed = word
    found = _ending(word, 0, (*NOUNS, *AGENTS, "logia", "logias", "ucion", "uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"))
    base = word[: len(word) - len(found)]
    if found == "amente":
        if len(base) >= one:
            stemmed = without(base, "iv", "os", "ic", "ad")
            if base.endswith("iv") and stemmed != base:
                stemmed = without(stemmed, "at")
    elif found and len(base) >= two:
        if found in AGENTS:
            stemmed = without(base, "ic")
        elif found.startswith("logia"):
            stemmed = base + "log"
        elif found.startswith("ucion"):
            stemmed = base + "u"
        elif found.startswith("encia"):
            stemmed = base + "ente"
        elif found == "mente":
            stemmed = without(base, "ante", "able", "ible")
        elif found.startswith("idad"):
            stemmed = without(base, "abil", "ic", "iv")
        elif found.startswith("iv"):
            stemmed = without(base, "at")
        else:
            stemmed = base
    if stemmed == word:
        y = _ending(word, at, Y_VERBS)
        if y and word[: len(word) - len(y)].endswith("u"):
            stemmed = word[: len(word) - len(y)]
    if stemmed == word:
        verb = _ending(word, at, (*VERBS, "en", "es", "eis", "emos"))
        if verb:
            stemmed = word[: len(word) - len(verb)]
            if verb in ("en", "es", "eis", "emos") and stemmed.endswith("gu"):
                stemmed = stemmed[:-1]
    last = _ending(stemmed, at, ("os", "a", "o", "i", "e"))
    if last:
        stemmed = stemmed[: len(stemmed) - len(last)]
        if last == "e" and stemmed.endswith("gu") and len(stemmed) > at:
            stemmed = stemmed[:-1]
    return stemmed


_V = "aeiouy"
_SHORT = re.compile(rf"(?:^[{_V}][^{_V}]|[^{_V}][{_V}][^{_V}wxY])$").search


def english(word: str) -> str:
    if word in SPECIAL:
        return SPECIAL[word]
    if len(word) < 3:
        return word
    word = re.sub(rf"(^|[{_V}])y", r"\1Y", word)
    head = re.match("gener|commun|arsen", word)
    one = head.end() if head else _region(word, 0, _V)
    two = _region(word, one, _V)
    has_vowel = re.compile(f"[{_V}]").search

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and has_vowel(word[:-2]):
        word = word[:-1]
    if word in WHOLE:
        return word
    e = _ending(word, 0, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    base = word[: len(word) - len(e)]
    if e.startswith("eed"):
        word = base + "ee" if len(base) >= one else word
    elif e and has_vowel(base):
        word = base
        if base.endswith(("at", "bl", "iz")):
            word = base + "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", base):
            word = base[:-1]
        elif len(base) <= one and _SHORT(base):
            word = base + "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _V:
        word = word[:-1] + "i"

    e = _ending(word, 0, (*STEP_2, "ogi", "li"))
    base = word[: len(word) - len(e)]
    if e and len(base) >= one:
        if e == "ogi":
            word = word[:-1] if base.endswith("l") else word
        elif e == "li":
            word = base if base[-1:] in tuple("cdeghkmnrt") else word
        else:
            word = base + STEP_2[e]
    e = _ending(word, 0, (*STEP_3, "ative"))
    base = word[: len(word) - len(e)]
    if e and len(base) >= one:
        word = base + STEP_3[e] if e in STEP_3 else base if len(base) >= two else word
    e = _ending(word, 0, (*STEP_4, "ion"))
    base = word[: len(word) - len(e)]
    if e and len(base) >= two and (e != "ion" or base.endswith(("s", "t"))):
        word = base
    if word.endswith("e"):
        base = word[:-1]
        word = base if len(base) >= two or (len(base) >= one and not _SHORT(base)) else word
    elif word.endswith("ll") and len(word) - 1 >= two:
        word = word[:-1]
    return word.lower()


def stem_word(word: str) -> str:
    """The Spanish stem of a word that has an accent or a Spanish ending, otherwise the English one. Words of fewer
    than three letters, and stems of fewer, stand as they are; accents and case go."""
    low = word.lower()
    plain = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    if len(plain) < 3:
        return low
    found = spanish(plain) if plain != low or plain.endswith(SPANISH_ENDS) or _ending(plain, 4, VERB_FORMS) else english(plain)
    return found if len(found) > 2 else plain


def stem(column: str | Column) -> Column:
    """The stem of each word; null gives null. Words come in Arrow batches."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else stem_word(w))

    return run(column)


def with_stems(rows: DataFrame, word: str, out: str) -> DataFrame:
    """rows with the stem of the column `word`: stems are made once per distinct word and joined back."""
    stems = rows.select(F.col(word).alias("_w")).where("_w is not null").distinct().select("_w", stem("_w").alias(out))
    return rows.join(stems, F.col(word) == F.col("_w"), "left").drop("_w")
