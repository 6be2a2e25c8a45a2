"""Business records taken apart: one reading of a name and of an address that the linkage operators share."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.skeleton import consistent
from linkweave.sources.tables import table

# Words of names and addresses.
HONORIFICS = frozenset("sri shri smt mr mrs ms messrs miss dr the".split())
LEGAL = frozenset("llc llp ltd limited inc incorporated corp corporation pvt private sarl sas sasu eurl sci sa".split())
DROPPED = frozenset("and et p new dup".split())
FILLERS = frozenset("co company".split())
STREET_TYPES = {
    "street": "street st str", "road": "road rd", "lane": "lane ln la", "highway": "highway hwy hw", "drive": "drive dr drv",
    "avenue": "avenue ave av", "court": "court ct crt", "boulevard": "boulevard blvd boul bd bvd", "parkway": "parkway pkwy pky",
    "colony": "colony col coly cly", "bazar": "bazar bazaar bzr", "marg": "marg mrg mg", "cross": "cross crs x",
    "nagar": "nagar nagr ngr", "rue": "rue r", "chemin": "chemin ch che", "place": "place pl", "allee": "allee all",
}
TYPE_OF = {w: k for k, ws in STREET_TYPES.items() for w in ws.split()}
DIRECTIONS = {"north": "n", "south": "s", "east": "e", "west": "w", "so": "s", "no": "n", "n": "n", "s": "s", "e": "e", "w": "w"}
STREET_FILLERS = frozenset("de du des la le les d l us usa india france".split())
NICKNAMES = {
    "robert": "bob rob", "william": "bill will", "susan": "sue", "deborah": "debbie deb", "rosalind": "roz", "valerie": "val", "victoria": "vicky",
    "penelope": "penny", "zachary": "zach", "richard": "dick rick", "edward": "ted ed", "lawrence": "larry", "madeline": "maddie", "jennifer": "jen",
    "jonathan": "jon", "patricia": "patty pat", "theresa": "terry", "solomon": "sol", "margaret": "peggy maggie", "thomas": "tom", "matthew": "matt",
    "andrew": "drew andy", "charles": "chuck charlie", "leonard": "len", "ronald": "ron", "rebecca": "becky", "stephen": "steve", "winifred": "winnie",
    "cynthia": "cindy", "beatrice": "bea", "dorothy": "dot dottie", "joseph": "joe", "raymond": "ray", "benjamin": "ben", "pamela": "pam", "eleanor": "nell",
    "barbara": "barb", "abigail": "abby", "gregory": "greg", "samantha": "sam", "vincent": "vince", "kenneth": "ken", "kimberly": "kim",
    "nicholas": "nick", "florence": "flo", "michael": "mike", "timothy": "tim", "daniel": "dan", "christopher": "chris", "christine": "chrissy chris",
    "anthony": "tony", "alexander": "alex", "nathaniel": "nate", "josephine": "josie", "elizabeth": "liz beth", "katherine": "kate kathy",
    "priscilla": "cilla", "jacqueline": "jackie", "frederick": "fred", "gabrielle": "gabby",
}
HINDI = {
    "ट्रेडर्स": "traders", "टेक्सटाइल्स": "textiles", "एंटरप्राइजेज": "enterprises", "स्वीट्स": "sweets", "इलेक्ट्रिकल्स": "electricals", "इंडस्ट्रीज": "industries",
    "इंजीनियरिंग": "engineering", "वर्क्स": "works", "मेडिकल": "medical", "हॉल": "hall", "गारमेंट्स": "garments", "ट्रेवल्स": "travels", "हार्डवेयर": "hardware",
    "स्टोर्स": "stores", "टेक्नोलॉजीज": "technologies", "फूड्स": "foods", "स्टील": "steel", "एंड": "and", "पाइप्स": "pipes", "ज्वेलर्स": "jewellers", "इन्फोटेक": "infotech",
    "सर्विसेज": "services", "बिल्डर्स": "builders", "पब्लिक": "public", "स्कूल": "school", "केमिकल्स": "chemicals", "मोटर्स": "motors", "एक्सपोर्ट्स": "exports",
    "हॉस्पिटल": "hospital", "एजेंसीज": "agencies", "इंटरनेशनल": "international",
}
NICK_OF = {n: k for k, v in NICKNAMES.items() for n in v.split()}
EMPTY = frozenset(["", "-", "--", ".", "n/a", "na", "none", "null", "nil", "unknown", "not available", "tbd", "?", "x", "xx", "xxx"])

_TAIL = re.compile(r"\(?\bid\s*:\s*\d+\)?|-\s*#\s*\d+|\(dup\)|/\s*new\b|\((?:new|closed|moved|old)\??\)")
_SITE = re.compile(r"(?:www\.)?([a-z0-9-]+)\.(?:test|example|invalid|com|in|fr|co\.in|net|org|biz|info)/?\Z")
_DOTTED = re.compile(r"\b(?:[a-z]\.\s?){2,}(?:[a-z]\b\.?)?|\b[a-z](?:\.[a-z])+\b\.?")
_INNER = re.compile(r"(?<=[a-z])[-'](?=[a-z])")
_WORD = re.compile(r"[a-z0-9]+")
_LANDMARK = re.compile(
    r"\b(?:near|nr|opp|opposite|behind|beside|next to|above)\b\.?\s*(?:(?:[a-z]+\s+){1,2}?(?:temple|bank atm|bank|atm|cinema|petrol pump|market|tailors|school|college|hospital|station|mall|park|church|mosque)\b|[^,;]*)"
)
_UNIT = re.compile(r"\b(?:ground|first|second|third|\d+(?:st|nd|rd|th))\s+floor\b|\b(?:flat|shop|office|unit|apt|apartment|suite|ste|fl|floor|room|bldg)\b\.?\s*(?:no\b\.?)?\s*#?\s*\d{1,3}[a-z]?\b")
_HOUSE_MARK = re.compile(r"(?:\b(?:h\.?\s?no|d\.?\s?no|house no|plot no|door no|plot|house|door|no)\b\.?\s*:?\s*|#\s*)(?=\d)")
_PIN = {"India": re.compile(r"(?<!\d)(\d{3})\s?(\d{3})(?!\d)")}
_ZIP = re.compile(r"(?<!\d)(\d{5})()(?:-\d{4})?(?!\d)")
_HOUSE = re.compile(r"(?<!\d)(\d{1,4})(?:(?:\s*[-/]\s*)?([a-h])\b|\s+([a-df-h]|e(?=\s*[,;])|bis|ter)\b)?(?!\d)(?![a-z]{2})")


@lru_cache(maxsize=4096)
def _indic(ch: str) -> str:
    """Latin for one Indic character, from its Unicode name: consonants end in ``a``, vowel signs start with ``+``."""
    name = unicodedata.name(ch, "")
    if " LETTER " in name:
        base = name.split(" LETTER ")[1].split(" ")[-1].lower()
        base = {"vocalic": "ri", "r": "ri", "l": "li"}.get(base, base)
        if base.strip("aeiou") == "":
            return {"aa": "a", "ii": "i", "uu": "u", "ai": "ai", "au": "au"}.get(base, base)
        body = base[:-1] if base.endswith("a") else base
        body = {"c": "ch", "ch": "chh", "tt": "t", "tth": "th", "dd": "d", "ddh": "dh", "nn": "n", "ss": "sh", "ng": "n", "ny": "n", "ll": "l", "rr": "r"}.get(body, body)
        return body + "a"
    if " VOWEL SIGN " in name:
        v = name.split(" VOWEL SIGN ")[1].split(" ")[-1].lower()
        return "+" + {"aa": "a", "ii": "i", "uu": "u", "r": "ri"}.get(v, v)
    if "VIRAMA" in name:
        return "+"
    if "ANUSVARA" in name or "CANDRABINDU" in name:
        return "n"
    if " DIGIT " in name:
        return str(unicodedata.digit(ch))
    return ""


def transliterate(word: str) -> str:
    word = word.replace("\u200c", "").replace("\u200d", "")
    if word in HINDI or not word:
        return HINDI.get(word, "")
    out: list[str] = []
    for ch in word:
        t = _indic(ch)
        if t.startswith("+"):
            if out and out[-1].endswith("a"):
                out[-1] = out[-1][:-1]
            out.append(t[1:])
        else:
            out.append(t)
    latin = "".join(out)
    return latin[:-1] if len(latin) > 3 and latin.endswith("a") and not _indic(word[-1]).startswith("+") else latin


def latin(text: str) -> str:
    """Lower-case Latin of a text in its consistent form: accents off, Indic words transliterated, other letters kept."""
    text = consistent(text)
    if text.isascii():
        return text.lower()
    text = re.sub(r"[ऀ-෿‌‍]+", lambda m: transliterate(m.group()), text)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


_FOLDS = re.compile(r"ee|oo|aa|[ptkdbgj]h|[zwq]|(.)\1")


@lru_cache(maxsize=100_000)
def fold(word: str) -> str:
    """A word with the spellings of one sound brought together (ee/i, oo/u, z/j, w/v, th/t, doubled letters)."""
    if not _FOLDS.search(word):
        return word
    for a, b in (("ee", "i"), ("oo", "u"), ("aa", "a"), ("ph", "f"), ("th", "t"), ("kh", "k"), ("dh", "d"), ("bh", "b"), ("gh", "g"), ("jh", "j"), ("z", "j"), ("w", "v"), ("q", "k")):
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


def read_name(name: str | None) -> tuple[list[str], str, bool]:
    """Words of a name without honorifics, legal form and tails; its web stem if it is one; whether it is initials."""
    if name is None:
        return [], "", False
    text = latin(name).strip(" .,*\"'<>[]()+")
    if m := _SITE.match(text):
        return [], m[1].replace("-", ""), False
    text = _TAIL.sub(" ", text)
    text = re.sub(r"\bm\s?/\s?s\b\.?", " ", text)
    text = re.sub(r"\(p\)|\bp\b\.?(?=\s*ltd)", " ", text)
    text = _DOTTED.sub(lambda m: re.sub(r"[.\s]", "", m.group()) + " ", text)
    text = _INNER.sub("", text)
    words = [w for w in _WORD.findall(text) if w not in LEGAL and w not in HONORIFICS and w not in DROPPED]
    if not words and not text.isascii():
        words = [w for w in re.findall(r"[^\W\d_]+", text)]
    one = words[0] if len(words) == 1 else ""
    initials = 2 <= len(one) <= 4 or len(one) == 5 and (not re.search(r"[aeiou]", one[1:]) or one.upper() in consistent(name))
    return words, "", initials and one.isalpha()


class Gazetteer:
    """Towns, regions and postcodes of the reference table: one row a postcode, 1,090 in all whatever the data's size."""

    def __init__(self, rows: list[tuple]):
        self.town_of_pin: dict[tuple[str, str], int] = {}
        self.town: dict[str, dict[str, int]] = {}
        self.near: dict[str, dict[str, set[str]]] = {}
        self.region: dict[str, dict[str, str]] = {}
        ids: dict[tuple[str, str], int] = {}
        for country, town, region, code, pin in sorted(rows):
            key = "".join(_WORD.findall(latin(town)))
            t = ids.setdefault((country, key), len(ids))
            self.town_of_pin[country, pin] = t
            self.town.setdefault(country, {})[key] = t
            for r in (region, code):
                self.region.setdefault(country, {})[" ".join(_WORD.findall(latin(r)))] = latin(code)
        self.region_firsts = {country: {r.split(" ")[0] for r in regions} for country, regions in self.region.items()}
        self.ends: dict[str, set[str]] = {}
        for country, towns in self.town.items():
            near = self.near.setdefault(country, {})
            for key in towns:
                for v in variants(key):
                    near.setdefault(v, set()).add(key)
            self.ends[country] = {v[:2] + v[-2:] for v in near}

    def find(self, country: str, words: list[str]) -> tuple[int | None, int, int, int]:
        """Town, the span of its words and its edits: exact first (later and longer spans before), then within two edits."""
        towns, near, ends = self.town.get(country, {}), self.near.get(country, {}), self.ends.get(country, ())
        spans = [(i, i + n, "".join(words[i : i + n])) for n in (3, 2, 1, 4) for i in range(len(words) - n, -1, -1)]
        for i, j, key in spans:
            if (t := towns.get(key)) is not None:
                return t, i, j, 0
        best = (9, None, 0, 0)
        for i, j, key in spans:
            if len(key) < 5 or key.isdigit() or words[j - 1] in TYPE_OF or words[i] in DIRECTIONS:
                continue
            # With one letter missing, wherever that is, the word begins and ends in one of these ways.
            head, tail = key[:2], key[-2:]
            if not (head + tail in ends or key[1:3] + tail in ends or key[0] + key[2] + tail in ends or head + key[-3:-1] in ends or head + key[-3] + key[-1] in ends):
                continue
            forms = variants(key)
            if near.keys().isdisjoint(forms):
                continue
            for v in forms:
                for town in near.get(v, ()):
                    d = distance(key, town, 2)
                    if d <= 2 - (len(town) < 6) and (d, -i) < (best[0], -best[2]):
                        best = (d, towns[town], i, j)
        return best[1], best[2], best[3], best[0]


@lru_cache(maxsize=200_000)
def variants(word: str) -> tuple[str, ...]:
    """The word and what is left of it with one letter missing: two words within one edit of another share one."""
    return (word, *{word[:i] + word[i + 1 :] for i in range(len(word))} - {word}) if len(word) > 3 else (word,)


def distance(a: str, b: str, most: int = 9) -> int:
    """Edits (with swaps of neighbours) between two words; ``most + 1`` where they are more than ``most``.

    Bit-parallel: a column of the table of edits is two integers of one bit a letter of ``a``.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # What both begin and end with takes no edit.
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j, n = 0, n - i
    while j < n and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) < 2 and len(b) < 2:
        return min(1, most + 1)
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, diagonal, before, d = full, 0, 0, 0, len(a)
    for ch in b:
        here = masks.get(ch, 0)
        swap = ((~diagonal & here) << 1) & before
        diagonal = ((((here & up) + up) ^ up) | here | down | swap) & full
        more = (down | ~(diagonal | up)) & full
        less = diagonal & up
        d += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down, before = (less | ~(diagonal | more)) & full, more & diagonal, here
    return min(d, most + 1)


@lru_cache(maxsize=300_000)
def _letters(word: str) -> int:
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


@lru_cache(maxsize=300_000)
def similarity(a: str, b: str) -> float:
    """1 less the share of letters to edit, of folded words; 0 from two fifths on."""
    a, b = fold(a), fold(b)
    n = max(len(a), len(b))
    if not n:
        return 0.0
    if a == b:
        return 1.0
    most, x, y = int(n * 0.4), _letters(a), _letters(b)
    # Every letter that one word lacks takes an edit.
    if (x & ~y).bit_count() > most or (y & ~x).bit_count() > most:
        return 0.0
    d = distance(a, b, most)
    return 1 - d / n if d <= most else 0.0


def read_address(address: str | None, country: str, places: Gazetteer) -> dict:
    """House number with its letter, street (folded core, type, direction), town and postcode of an address, '' or None where it has none."""
    out = {"house": "", "suffix": "", "street": "", "kind": "", "way": "", "town": None, "pin": "", "region": ""}
    text = latin(address or "").strip()
    if text.strip(" .,") in EMPTY:
        return out
    text = _LANDMARK.sub(" , ", text)
    text = _UNIT.sub(" , ", text)
    pins = list(_PIN.get(country, _ZIP).finditer(text))
    if pins:
        out["pin"] = pins[-1][1] + pins[-1][2]
        text = text[: pins[-1].start()] + " , " + text[pins[-1].end() :]
    marked = _HOUSE_MARK.search(text)
    house = _HOUSE.search(text, marked.end() if marked else 0)
    if house:
        out["house"], out["suffix"] = house[1].lstrip("0") or "0", house[2] or house[3] or ""
        text = text[: marked.start() if marked and marked.end() == house.start() else house.start()] + " , " + text[house.end() :]
    text = _INNER.sub("", text)
    words = _WORD.findall(text)
    t, i, j, edits = places.find(country, words)
    of_pin = places.town_of_pin.get((country, out["pin"]))
    if t is not None and (not edits or of_pin in (None, t)):
        out["town"] = t
        del words[i:j]
    elif of_pin is not None:
        out["town"] = of_pin
    regions, firsts = places.region.get(country, {}), places.region_firsts.get(country, ())
    begins = [i for i in range(len(words) - 1, -1, -1) if words[i] in firsts]
    for n in (3, 2, 1) if begins else ():
        for i in begins:
            if i + n <= len(words) and (code := regions.get(" ".join(words[i : i + n]))) and not (n == 1 and len(words[i]) == 2 and words[i] in TYPE_OF and not any(w in TYPE_OF for k, w in enumerate(words) if k != i)):
                out["region"] = code
                del words[i : i + n]
                break
        if out["region"]:
            break
    at = next((k for k in range(len(words) - 1, -1, -1) if words[k] in TYPE_OF and (k or country == "France")), None)
    if country == "France":
        at = next((k for k in range(len(words)) if words[k] in TYPE_OF), None)
    if at is not None:
        out["kind"] = TYPE_OF[words.pop(at)]
    core = []
    for k, w in enumerate(words):
        if w in DIRECTIONS and len(words) > 1 and not out["way"] and (len(w) > 1 or k == 0):
            out["way"] = DIRECTIONS[w]
        elif w not in STREET_FILLERS and not w.isdigit() and len(w) > 1:
            core.append(w)
    out["street"] = fold("".join(core)) if core else ""
    return out


class Vocabulary:
    """Common words of the clean names: more than one name in SHARE holds each, so there are at most words-a-name times SHARE.

    Tells a name's own word (``core``) from the common ones, which come out in one spelling whatever abbreviation, typo or
    nickname they had, also where they were run together with the core.
    """

    SHARE, LEAST = 2000, 3

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.near: dict[str, set[str]] = {}
        self.first: dict[str, list[str]] = {}
        for w in sorted(counts, key=lambda w: (-counts[w], w)):
            if len(w) > 4:
                for v in variants(w):
                    self.near.setdefault(v, set()).add(w)
            self.first.setdefault(w[0], []).append(w)
        self.canon = lru_cache(maxsize=200_000)(self._canon)

    def _canon(self, w: str) -> str | None:
        if w in self.counts:
            return w
        if (n := NICK_OF.get(w)) in self.counts:
            return n
        if len(w) > 4:
            close = [(distance(w, v, 2), -self.counts[v], v) for k in variants(w) for v in self.near.get(k, ())]
            if close and (best := min(close))[0] <= (1 if len(w) < 8 else 2):
                return best[2]
        if 2 <= len(w) <= 7 and not w.isdigit():
            longer = [v for v in self.first.get(w[0], ()) if len(v) > len(w)]
            begun = next((v for v in longer if v.startswith(w)), None)
            return begun or next((v for v in longer if len(w) <= 0.8 * len(v) and _within(w, v)), None)
        return None

    def read(self, words: list[str]) -> tuple[str, list[str]]:
        own, common = [], []
        for w in words:
            if w in FILLERS:
                continue
            c = self.canon(w) if len(w) > 1 else None
            if c in FILLERS:
                continue
            if c is None:
                own.append(w)
            else:
                common.append(c)
        core = "".join(w for w in own if len(w) > 1 or len(own) == 1)
        for k in range(len(core) - 4, 3, -1):  # a common word run together with the core, behind or before it
            if core[k:] in self.counts or core[:k] in self.counts:
                (core, extra) = (core[:k], core[k:]) if core[k:] in self.counts else (core[k:], core[:k])
                common.append(extra)
                break
        return fold(core), common


def _within(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def vocabulary(names: DataFrame, column: str = "business_name") -> dict[str, int]:
    """Words that over one in SHARE clean names hold, with counts; counted in full on the cluster, the bounded list comes here."""
    words = F.array_distinct(F.split(F.lower(column), r"[^\p{L}\p{M}\p{N}'-]+"))
    n = names.count()
    least = max(Vocabulary.LEAST, n // Vocabulary.SHARE)
    counts = names.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & (F.char_length("w") > 1))
    out: dict[str, int] = {}
    for w, k in counts.collect():
        for x in read_name(w)[0]:
            if len(x) > 2 or x == "om":
                out[x] = out.get(x, 0) + k
    return out


FIELDS = "house string, suffix string, street string, kind string, way string, town int, pin string, region string"


def gazetteer(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """The reference table of towns as rows; it does not grow with the data."""
    p = table(spark, sf_dir, "place_ref").select("country", "town", "region", "region_code", "postcode")
    return [tuple(r) for r in p.collect()]


def parse(df: DataFrame, places: list[tuple], words_known: dict[str, int]) -> DataFrame:
    """``(entity_id, country, name, address, core, common, letters, whole, site, initials, house, ..., region)`` of distinct records.

    A record delivered twice is read once. Null names and addresses have no words and no parts. Country null: ''.
    """
    rows = df.select("entity_id", F.coalesce("business_name", F.lit("")).alias("name"), F.coalesce("business_address", F.lit("")).alias("address"), F.coalesce("country", F.lit("")).alias("country")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gaz, known = Gazetteer(places), Vocabulary(words_known)
        for b in batches:
            if not len(b):
                continue
            names = [read_name(n) for n in b.name]
            read = [known.read(n[0]) if not n[2] else ("", []) for n in names]
            b = b.assign(
                core=[r[0] for r in read],
                common=[r[1] for r in read],
                letters=["".join(w[0] for w in n[0]) if not n[2] else "".join(n[0]) for n in names],
                whole=[fold("".join(w for w in n[0] if w not in FILLERS)) for n in names],
                site=[fold(n[1]) for n in names],
                initials=[n[2] for n in names],
            )
            parts = pd.DataFrame([read_address(a, c, gaz) for a, c in zip(b.address, b.country, strict=True)], index=b.index)
            parts["town"] = parts["town"].astype("Int32")
            yield pd.concat([b, parts], axis=1)

    return rows.mapInPandas(run, f"entity_id string, name string, address string, country string, core string, common array<string>, letters string, whole string, site string, initials boolean, {FIELDS}")
