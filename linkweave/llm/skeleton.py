"""One consistent form for text that looks alike but differs in its characters (confusables skeleton)."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and the Latin letters they look like.
_CYRILLIC = ("аеорсухіјѕԁԛԝһӏкАВЕКМНОРСТУХІЈЅԌҮ", "aeopcyxijsdqwhlkABEKMHOPCTYXIJSGY")
_GREEK = ("οανρυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavpuikABEZHIKMNOPTYX")
_ARMENIAN = ("օսոհզցՕՏԼ", "ounhqgOSL")
_LATIN = ("ɑɡıȷʋᴏᴄᴠᴢ", "agijvocvz")
# Signs and the ASCII signs they look like.
_SIGNS = {
    "-": "‐‑‒–—―−⁃﹘",
    "'": "‘’‛′ʹʼˈ`´",
    '"': "“”‟″ʺ",
    "/": "⁄∕",
    ",": "‚",
    ".": "․",
    ":": "꞉∶ː",
    "*": "⁎∗",
}
#: Both tables serve where no session is at hand; ``confusables`` adds to them.
LETTERS = {a: b for left, right in (_CYRILLIC, _GREEK, _ARMENIAN, _LATIN) for a, b in zip(left, right, strict=True)}
SIGNS = {a: sign for sign, group in _SIGNS.items() for a in group if ord(a) > 126}
_INDIC = "ऀ-෿"
_JOINER = re.compile(f"(?<=[{_INDIC}])[‌‍]+(?=[{_INDIC}])")
_RUN = re.compile(f"[{_INDIC}]+(?:[‌‍]+[{_INDIC}]+)*|[^{_INDIC}]+")
_WORD = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[\x20-\x7e]*\Z")
#: rlike pattern of the values that can hold anything but plain characters; the rest never leave the JVM.
ODD = r"[^\x20-\x7e]"


def _invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= ch <= "️"


@cache
def confusables(spark: SparkSession) -> dict[str, str]:
    """Prototype of every character that has one, by the public table of look-alikes in the ICU library that Spark ships.

    One call to the driver's JVM gives the skeleton of every code point but the unassigned and private planes. Its size is
    that of the Unicode tables, some ten thousand entries, whatever the data's. Without that library or its answer there
    is an error, as a smaller table would leave values out unnoticed.
    """
    points = "\n".join(chr(i) for i in range(0x80, 0x30000) if not 0xD800 <= i < 0xE000)
    plain = "\n".join(map(chr, range(0x21, 0x7F)))
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        pairs = [x for text in (plain, points) for x in zip(text.split("\n"), checker.getSkeleton(text).split("\n"), strict=True)]
    except (TypeError, Py4JError, ValueError) as e:
        raise RuntimeError("no table of look-alikes: the ICU library (icu4j) that Spark ships is missing or did not answer for every character") from e
    return {c: p for c, p in pairs if p and p != unicodedata.normalize("NFD", c)}


class Lookalikes:
    """The tables of one consistent form: letters that look Latin, signs that look like ASCII ones, prototypes.

    A character is read as the ASCII character with the same prototype and of the same kind: capital, small letter or
    sign. Letters that look like digits or signs only, and signs that look like letters, are left as they are.
    """

    def __init__(self, prototypes: dict[str, str]):
        self.prototypes = prototypes
        like: dict[tuple[str, str], str] = {}
        for a in map(chr, range(0x7E, 0x20, -1)):
            like[prototypes.get(a, a), _kind(a)] = a
        self.letters, self.signs = dict(LETTERS), dict(SIGNS)
        for c, p in prototypes.items():
            kind = _kind(c)
            if c > "\x7e" and kind and not _indic(c) and not unicodedata.normalize("NFKC", c).isascii():
                plain = like.get((p, kind)) or kind == "Lo" and (like.get((p, "Lu")) or like.get((p, "Ll")))
                if plain and plain.isalpha() == (kind[0] == "L"):
                    (self.letters if kind[0] == "L" else self.signs).setdefault(c, plain)


def _kind(ch: str) -> str:
    """Lu, Ll or Lo of a letter, P of a sign, else nothing: digits are themselves, marks join their letters."""
    kind = unicodedata.category(ch)
    return "Lu" if kind == "Lt" else kind if kind in ("Lu", "Ll", "Lo") else "P" if kind[0] in "PS" else ""


def _indic(ch: str) -> bool:
    return "\u0900" <= ch <= "\u0dff"


@lru_cache(maxsize=65536)
def _is_latin(ch: str) -> bool:
    return ch.isascii() or not ch.isalpha() or unicodedata.name(ch, "").startswith("LATIN ")


BUILT_IN = Lookalikes({})


def _plain(ch: str, look: Lookalikes) -> str:
    if ch < "\x7f" and ch >= " ":
        return ch
    if ch.isspace() or unicodedata.category(ch) in ("Zs", "Zl", "Zp"):
        return " "
    if _invisible(ch) or unicodedata.category(ch) == "Cc":
        return ""
    if ch in look.letters:
        return ch
    return "".join(look.signs.get(c, c) for c in unicodedata.normalize("NFKC", look.signs.get(ch, ch)))


def consistent(text: str | None, look: Lookalikes = BUILT_IN) -> str | None:
    """The one consistent form of ``text``: its skeleton with each prototype written as the ordinary character it stands for.

    Compatibility forms become plain, separate accents join their letters, invisible characters go, every space becomes
    an ASCII space, look-alike letters and signs become the ones they look like; a word becomes Latin only if its every
    letter is or looks Latin. Case, spelling, runs of ASCII spaces, composed letters, words of another script and joiners
    between Indic letters stay. Null stays null, empty stays empty.
    """
    if text is None or _PLAIN.match(text):
        return text

    def word(m: re.Match) -> str:
        if not any(c in look.letters for c in m.group()):
            return m.group()
        latin = "".join(look.letters.get(c, c) for c in m.group())
        if all(map(_is_latin, unicodedata.normalize("NFD", latin))):
            return latin
        return unicodedata.normalize("NFKC", m.group())

    out = []
    for m in _RUN.finditer(text):
        run = m.group()
        if "\u0900" <= run[0] <= "\u0dff":
            out.append(run)
            continue
        run = unicodedata.normalize("NFC", "".join(_plain(c, look) for c in run))
        out.append(unicodedata.normalize("NFC", _WORD.sub(word, run)))
    return "".join(out)


def skeleton(text: str | None, look: Lookalikes = BUILT_IN) -> str | None:
    """Decompose, replace each character by its prototype, decompose again. Equal skeletons look the same."""
    if text is None:
        return None
    flat = unicodedata.normalize("NFKD", _JOINER.sub("", consistent(text, look)))
    one = lambda c: look.prototypes.get(c) or look.letters.get(c, c)
    return unicodedata.normalize("NFKD", "".join(map(one, flat)))


def _udf(f, look: Lookalikes):
    @F.pandas_udf(T.StringType())
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(x, look), na_action="ignore")

    return udf


def _plain_skeleton(value: Column, prototypes: dict[str, str]) -> Column:
    """The skeleton of a value of plain characters, as an expression."""
    one = {c: unicodedata.normalize("NFKD", p) for c, p in prototypes.items() if c.isascii()}
    value = F.translate(value, "".join(c for c, p in one.items() if len(p) == 1), "".join(p for p in one.values() if len(p) == 1))
    for c, p in one.items():
        if len(p) > 1:
            value = F.replace(value, F.lit(c), F.lit(p))
    return value


def values(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Long form ``(id, field, value)`` of the named text fields, nulls left out."""
    arms = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return df.select(F.col(id_col), F.explode(arms).alias("v")).select(id_col, "v.field", "v.value").filter(F.col("value").isNotNull())


def odd_values(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``(id, field, value, form)`` of the values that their consistent form changes.

    Plain ASCII values are dropped in the JVM before Arrow; repeated rows give one row, null and empty values none.
    Other columns of ``df`` are ignored, whatever their names.
    """
    look = Lookalikes(confusables(df.sparkSession))
    odd = values(df, id_col, fields).filter(F.col("value").rlike(ODD)).distinct()
    return odd.withColumn("form", _udf(consistent, look)("value")).filter(F.col("form") != F.col("value"))


def groups(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Originals by equal skeleton: ``(field, skeleton, n_forms, n_rows)`` of the skeletons written in more than one way.

    Counted by value before the skeleton is made, so a value that holds a third of all rows is one row of the shuffle.
    """
    look = Lookalikes(confusables(df.sparkSession))
    counts = values(df, id_col, fields).groupBy("field", "value").agg(F.count("*").alias("n"))
    odd = F.col("value").rlike(ODD)
    plain = counts.filter(~odd).withColumn("skeleton", _plain_skeleton(F.col("value"), look.prototypes))
    sk = counts.filter(odd).withColumn("skeleton", _udf(skeleton, look)("value")).unionByName(plain)
    return sk.groupBy("field", "skeleton").agg(F.count("*").alias("n_forms"), F.sum("n").alias("n_rows")).filter("n_forms > 1")
