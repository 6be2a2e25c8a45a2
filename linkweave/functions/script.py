"""Other scripts to Latin by a table made from Unicode names; full Unicode normalization. Arrow UDFs, one call a batch."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = {"AA": "a", "II": "i", "UU": "u", "EE": "e", "OO": "o"}


@cache
def latin_of(ch: str) -> tuple[str, str]:
    """What a character reads as and its kind: consonant (with its own a), sign (takes the a's place), or letter."""
    name = unicodedata.name(ch, "")
    block = 0x0900 <= ord(ch) <= 0x0D7F
    last = name.rsplit(" ", 1)[-1]
    if block and " VOWEL SIGN " in name:
        return VOWELS.get(last, last.lower()), "sign"
    if block and ("VIRAMA" in name or "PULLI" in name):
        return "", "sign"
    if block and ("ANUSVARA" in name or "CANDRABINDU" in name):
        return "n", "letter"
    if block and " LETTER " in name:
        if not last.strip("AEIOU"):
            return VOWELS.get(last, last.lower()), "letter"
        body = last.removesuffix("A").lower()
        half = len(body) // 2
        body = body[half:] if body[:half] == body[half:] else body
        return {"c": "ch", "ss": "sh"}.get(body, body), "consonant"
    if " DIGIT " in name:
        return str(unicodedata.digit(ch, "")), "letter"
    if " LETTER " in name and name.split(" ")[0] in ("CYRILLIC", "GREEK", "ARMENIAN", "GEORGIAN"):
        return last.lower(), "letter"
    return "", "other"


#: In Malayalam a doubled rra is read tt.
DOUBLE_RRA, DOUBLE_TTA = "\u0d31\u0d4d\u0d31", "\u0d1f\u0d4d\u0d1f"
LABIALS = ("PA", "PHA", "BA", "BHA", "MA")


def is_nasal(ch: str) -> bool:
    return 0x0900 <= ord(ch) <= 0x0D7F and "ANUSVARA" in unicodedata.name(ch, "")


def is_labial(ch: str) -> bool:
    name = unicodedata.name(ch, "")
    return 0x0900 <= ord(ch) <= 0x0D7F and " LETTER " in name and name.rsplit(" ", 1)[-1] in LABIALS


def transliterate(text: str) -> str:
    """Lower-case Latin of a text: Indic by syllables, other named alphabets by letter names, Latin without accents.

    An anusvara is n, before a labial m.
    """
    out: list[str] = []
    hold = False  # a consonant waits for its vowel
    text = "".join(ch for ch in unicodedata.normalize("NFC", text).replace(DOUBLE_RRA, DOUBLE_TTA) if ch not in "‌‍")
    for i, ch in enumerate(text):
        if i + 1 < len(text) and is_nasal(ch) and is_labial(text[i + 1]):
            out.append(("a" if hold else "") + "m")
            hold = False
            continue
        latin, kind = latin_of(ch) if ord(ch) > 0x24F else ("", "other")
        if kind == "sign" and hold:
            out.append(latin)
            hold = False
            continue
        if hold:
            # The final vowel of a word is silent.
            out.append("a" if kind in ("consonant", "letter") else "")
            hold = False
        if kind == "other":
            out.append("".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)))
        else:
            out.append(latin)
            hold = kind == "consonant"
    return "".join(out).lower()


def normalize(text: str) -> str:
    """Compatibility composition, then decomposition without marks, lower case."""
    flat = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text))
    return "".join(c for c in flat if not unicodedata.combining(c)).lower()


# Short forms of legal words in Indian scripts, as people write them, and what they stand for.
LEGAL_SHORT = {"प्रा": "pvt", "लि": "ltd"}
#: Words of so few characters go by the table: a trained model does not read them better.
SHORT = 4


def transliterate_word(word: str, model=None) -> str:
    """A word in Latin: legal short forms by their list, short words by the table, others by ``model`` (word, script) where there is one."""
    bare = word.strip(".,")
    if bare in LEGAL_SHORT:
        return LEGAL_SHORT[bare]
    if model is None or len(bare) <= SHORT:
        return transliterate(word)
    return model(bare, script_of(bare)) or transliterate(word)


def script_of(word: str) -> str:
    """Script of the first letter by its Unicode name, in lower case; empty where there is no letter."""
    return next((unicodedata.name(ch, "").split(" ")[0].lower() for ch in word if ch.isalpha()), "")


def transliterate_words(df, id_col: str, column: str, model=None):
    """``(id, latin)``: texts in Latin word by word; each distinct word is read once, however many records hold it.

    ``model``: a function of (word, script) that Arrow workers can load, in place of the table for longer words. Null
    texts have no row; words are parted by blanks.
    """

    @F.pandas_udf(T.StringType())
    def read(words: pd.Series) -> pd.Series:
        return words.map(lambda w: transliterate_word(w, model), na_action="ignore")

    words = df.filter(F.col(column).isNotNull()).select(id_col, F.posexplode(F.split(F.trim(column), r"\s+")).alias("i", "w"))
    known = words.select("w").distinct().withColumn("latin", read("w"))
    done = words.join(known, "w").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("i", "latin"))).alias("x"))
    return done.select(id_col, F.array_join(F.transform("x", lambda e: e["latin"]), " ").alias("latin"))


def _udf(f):
    @F.pandas_udf(T.StringType())
    def udf(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return udf


transliterate_col, normalize_col = _udf(transliterate), _udf(normalize)
