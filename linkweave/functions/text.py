"""Cleaning and parsing of names and addresses as native Column expressions (no Python in the hot path)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Legal words, abbreviations, street types and stop words, regions.
LEGAL = ["pvt", "private", "ltd", "limited", "corp", "corporation", "inc", "llc", "llp", "co", "enterprises", "sarl", "sas", "sa", "eurl", "sci", "groupe", "s.a.s", "sasu", "ei", "cie"]
ABBREVIATIONS = {"rd": "road", "st": "street", "cir": "circle", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard", "r": "rue"}
STREET_TYPES = "rue avenue av ave boulevard bd blvd boul chemin che place pl route rte allee impasse imp quai cours crs square faubourg fbg road rd street st lane ln drive dr way court ct circle cir highway hwy parkway pkwy terrace marg".split()
STREET_STOPS = "r ch all sq bis ter de du des la le les l d of the and et en sur suite ste unit apt apartment building bldg floor fl po box door no nr n number h hno flat shop plot near opp".split()
US_CODES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
US_NAMES = {"alabama": "AL", "alaska": "AK", "arizona": "AZ", "california": "CA", "texas": "TX", "florida": "FL", "new york": "NY", "ohio": "OH", "oklahoma": "OK", "maryland": "MD", "iowa": "IA", "north carolina": "NC"}
IN_CODES = {"MH": "maharashtra", "RJ": "rajasthan", "TN": "tamil nadu", "KA": "karnataka", "DL": "delhi", "WB": "west bengal", "UP": "uttar pradesh", "GJ": "gujarat"}
IN_NAMES = ["maharashtra", "rajasthan", "tamil nadu", "karnataka", "delhi", "west bengal", "uttar pradesh", "gujarat", "kolkata", "howrah"]
FR_REGIONS = ["auvergne-rhone-alpes", "bourgogne-franche-comte", "bretagne", "centre-val de loire", "corse", "grand est", "hauts-de-france", "ile-de-france", "normandie", "nouvelle-aquitaine", "occitanie", "pays de la loire", "provence-alpes-cote d'azur", "guadeloupe", "martinique", "guyane", "la reunion", "mayotte"]
NATIVE_STATES = {"தமிழ்நாடு": "tamil nadu", "महाराष्ट्र": "maharashtra", "दिल्ली": "delhi", "पश्चिम बंगाल": "west bengal", "कर्नाटक": "karnataka"}
# Patterns of junk marks, honorifics, web names, house numbers, boxes and landmarks.
JUNK = r"\*+|>>|--|<<|##|\[services\]|\(id:\s*\d+\)|<null>"
HONORIFIC = r"^\s*(smt|shri|mr|mrs|miss|dr)\.?\s+"
DOMAIN = r"^([\w-]+)\.(?:com|in|fr|co\.in|net|org)(?:\.\w+)?$"
HOUSE = r"\b(?:h\.?\s*no\.?|house|plot|door)\s*\.?\s*#?\s*(\d+[a-z]?)|#\s*(\d+)"
PO_BOX = r"\b(?:p\.?o\.?\s*box|unit\s*\d+|hn\b|door\s*no)\b[^,]*,?"
LANDMARK = r"\b(near|opp|opposite|behind|atm|temple|mosque|church|bank|hospital|station|mall|banque|hopital|gare|eglise|mosquee|centre commercial)\b"

#: Latin letters with marks, U+00C0 to U+024F, and their plain letters: every code point whose decomposition starts with one.
_MARKED = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in range(0xC0, 0x250)]
FOLD_FROM = "".join(a for a, b in _MARKED if b.isascii() and b != a)
FOLD_TO = "".join(b for a, b in _MARKED if b.isascii() and b != a)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    """The value, empty for null."""
    return F.coalesce(_c(x), F.lit(""))


def size(x: Column | str) -> Column:
    """``40k`` is 40,000, ``1.5m`` 1,500,000, a plain number itself; null for anything else."""
    said = F.lower(F.regexp_replace(_c(x), r"[\s,_]", ""))
    number = F.regexp_extract(said, r"^([0-9]+(?:\.[0-9]+)?)[km]?$", 1)
    unit = F.when(said.endswith("k"), 1_000).when(said.endswith("m"), 1_000_000).otherwise(1)
    return F.when(number != "", F.round(number.cast("decimal(24,6)") * unit).cast("long"))


def clean_lex(x: Column | str) -> Column:
    """Lower case; all but letters, marks, digits and spaces become spaces; spaces collapse."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(x)), r"[^\p{L}\p{M}\p{N} ]", " "), r"\s+", " "))


def fold(x: Column | str) -> Column:
    """Lower case with Latin accents off; other scripts stay."""
    return F.translate(F.lower(text(x)), FOLD_FROM, FOLD_TO)


def base_clean(x: Column | str) -> Column:
    """Folded text without junk marks, spaces collapsed, cut of ``,.-`` and spaces at both ends. Latin accents only; see ``normalize`` for all scripts."""
    return F.btrim(F.regexp_replace(F.regexp_replace(fold(x), JUNK, " "), r"\s+", " "), F.lit(" ,.-"))


def words(x: Column | str) -> Column:
    """Word tokens of the folded text; numbers lose leading zeros."""
    return F.transform(F.regexp_extract_all(fold(x), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.when(w.rlike("^[0-9]+$"), F.regexp_replace(w, "^0+(?=[0-9])", "")).otherwise(w))


def tokens(x: Column | str) -> Column:
    """Words of a cleaned text between spaces, dots at their ends off."""
    return F.filter(F.transform(F.split(_c(x), " "), lambda t: F.btrim(t, F.lit("."))), lambda t: t != "")


def has_honorific(x: Column | str) -> Column:
    return base_clean(x).rlike(HONORIFIC).cast("int")


def name_norm(x: Column | str) -> Column:
    return F.regexp_replace(base_clean(x), HONORIFIC, "")


def _is_legal(t: Column) -> Column:
    return t.isin(LEGAL)


def legal_form(x: Column | str) -> Column:
    return F.array_join(F.filter(tokens(name_norm(x)), _is_legal), " ")


def core_name(x: Column | str) -> Column:
    """Words that are no legal form; all words where nothing else is left."""
    all_words = tokens(name_norm(x))
    own = F.filter(all_words, lambda t: ~_is_legal(t))
    return F.array_join(F.when(F.size(own) == 0, all_words).otherwise(own), " ")


def domain_stem(x: Column | str) -> Column:
    return F.regexp_extract(F.replace(name_norm(x), F.lit(" "), F.lit("")), DOMAIN, 1)


def phonetic(x: Column | str) -> Column:
    """Soundex of the first core word; empty where it has no a-z."""
    letters = F.regexp_replace(F.split(core_name(x), " ")[0], "[^a-z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


def block_key(x: Column | str, country: str = "country") -> Column:
    """``country|phonetic code|first four letters of the core name``."""
    return F.concat_ws("|", country, phonetic(x), F.substring(core_name(x), 1, 4))


def house_marked(x: Column | str) -> Column:
    s = base_clean(x)
    return F.coalesce(F.nullif(F.regexp_extract(s, HOUSE, 1), F.lit("")), F.nullif(F.regexp_extract(s, HOUSE, 2), F.lit("")), F.lit(""))


def house_bare(x: Column | str) -> Column:
    """The first 1 to 4 digits that stand alone in the first comma part that has any."""
    numbers = F.filter(F.transform(F.split(F.replace(base_clean(x), F.lit(","), F.lit(" ")), r"\s+"), lambda t: F.btrim(t, F.lit("."))), lambda t: t.rlike("^[0-9]{1,4}$"))
    return F.coalesce(F.get(numbers, F.lit(0)), F.lit(""))


def house_no(x: Column | str) -> Column:
    return F.coalesce(F.nullif(house_marked(x), F.lit("")), house_bare(x))


def pin(x: Column | str) -> Column:
    """The first six digits that stand alone, else the first five."""
    s = base_clean(x)
    six, five = (F.regexp_extract(s, rf"(?<![0-9])([0-9]{{{n}}})(?![0-9])", 1) for n in (6, 5))
    return F.coalesce(F.nullif(six, F.lit("")), five)


def postcode_last(x: Column | str) -> Column:
    """The last five or six digits that stand alone, empty if none."""
    found = F.regexp_extract_all(text(x), F.lit(r"(?<![0-9])([0-9]{5,6})(?![0-9])"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def without_box(x: Column | str) -> Column:
    return F.regexp_replace(base_clean(x), PO_BOX, " ")


def expand(t: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in ABBREVIATIONS.items() for v in pair])
    return F.coalesce(table[t], t)


def addr_norm(x: Column | str) -> Column:
    return F.array_join(F.transform(tokens(F.regexp_replace(F.replace(without_box(x), F.lit(","), F.lit(" ")), r"\s+", " ")), expand), " ")


def street_tokens(x: Column | str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.split(addr_norm(x), " "))), " ")


def landmark(x: Column | str) -> Column:
    return base_clean(x).rlike(LANDMARK).cast("int")


def _parts(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(base_clean(x), ","), lambda p: F.trim(p)), lambda p: p != "")


def _region(part: Column) -> Column:
    """The French region a part ends in, of up to four words; the longest first."""
    w = F.split(part, r"\s+")
    tails = [F.array_join(F.slice(w, -n, n), " ") for n in (4, 3, 2, 1)]
    return F.coalesce(*[F.when((F.size(w) >= n) & t.isin(FR_REGIONS), t) for n, t in zip((4, 3, 2, 1), tails, strict=True)])


def state_of_last(x: Column | str) -> Column:
    """State or region named by the end of the last comma part, null if none."""
    last = F.try_element_at(_parts(x), F.lit(-1))
    w = F.split(last, r"\s+")
    one = F.upper(F.btrim(F.element_at(w, -1), F.lit(".")))
    two = F.when(F.size(w) >= 2, F.concat_ws(" ", F.try_element_at(w, F.lit(-2)), F.element_at(w, -1))).otherwise("")
    us = F.create_map(*[F.lit(v) for pair in US_NAMES.items() for v in pair])
    india = F.create_map(*[F.lit(v) for pair in IN_CODES.items() for v in pair])
    native = F.create_map(*[F.lit(v) for pair in NATIVE_STATES.items() for v in pair])
    local = F.get(F.filter(F.transform(w, lambda t: native[t]), lambda t: t.isNotNull()), F.lit(0))
    return (
        F.when(one.isin(US_CODES), one)
        .when(two.isin(list(US_NAMES)), us[two])
        .when(two.isin(IN_NAMES), two)
        .when(F.upper(F.element_at(w, -1)).isin(list(IN_CODES)), india[F.upper(F.element_at(w, -1))])
        .otherwise(F.coalesce(_region(last), local))
    )


def state_code(x: Column | str) -> Column:
    """State of the last part, else a region that any part ends in, else empty."""
    anywhere = F.get(F.filter(F.transform(_parts(x), _region), lambda r: r.isNotNull()), F.lit(0))
    return F.coalesce(state_of_last(x), F.when(F.size(_parts(x)) >= 2, anywhere), F.lit(""))


def city(x: Column | str) -> Column:
    """The part before the state, without digits; where the region stands elsewhere, the first other part that is no number."""
    parts = _parts(x)
    before = F.trim(F.regexp_replace(F.try_element_at(parts, F.lit(-2)), "[0-9]+", ""))
    others = F.filter(parts, lambda p: _region(p).isNull() & ~p.rlike("^[0-9]") & (F.length(p) > 2))
    return F.when(F.size(parts) < 2, "").when(state_of_last(x).isNotNull(), before).when(state_code(x) != "", F.coalesce(F.get(others, F.lit(0)), F.lit(""))).otherwise("")


def compact(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(text(x)), "[^0-9a-z]", "")


def compact_of(domain: Column | str, latin: Column | str, norm: Column | str) -> Column:
    """Letters and digits of the web name, else of the name in Latin, else of the cleaned name."""
    return compact(F.coalesce(F.nullif(_c(domain), F.lit("")), F.nullif(_c(latin), F.lit("")), _c(norm)))


def is_native(x: Column | str) -> Column:
    """Holds a character outside Latin, general punctuation and currency signs."""
    return text(x).rlike(r"[^\x{0000}-\x{024F}\x{1E00}-\x{1EFF}\x{2000}-\x{206F}\x{20A0}-\x{20CF}]")


def is_handle(x: Column | str) -> Column:
    return F.trim(text(x)).rlike(r"^[@#]\S+$")


def case_tag(x: Column | str) -> Column:
    return F.when(is_native(x), "native").when(domain_stem(x) != "", "domain").when(has_honorific(x) == 1, "honorific").otherwise("plain")


def consonants(x: Column | str) -> Column:
    """Cleaned text without vowels and spaces, eight characters; empty stays empty."""
    return F.substring(F.regexp_replace(clean_lex(x), "[aeiou ]", ""), 1, 8)


def with_keys(df: DataFrame, name: str = "business_name", address: str = "business_address") -> DataFrame:
    """Lexical keys: pin (of the name), hnum, first_tok, nprefix, phon; a key that says nothing is null, but phon stays empty."""
    x = df.withColumns({"name_clean": clean_lex(name), "addr_clean": clean_lex(address)})
    prefix = F.substring(F.replace(F.col("name_clean"), F.lit(" "), F.lit("")), 1, 4)
    first = F.split("name_clean", " ")[0]
    return x.withColumns({
        "pin": F.nullif(F.regexp_extract("name_clean", r"(\b[0-9]{5,6}\b)", 1), F.lit("")),
        "hnum": F.nullif(F.regexp_extract("addr_clean", "([0-9]{1,6})", 1), F.lit("")),
        "first_tok": F.when(F.length(first) >= 3, first),
        "nprefix": F.when(F.length(prefix) == 4, prefix),
        "phon": F.substring(F.regexp_replace(F.col("name_clean"), "[aeiou ]", ""), 1, 8),
    })


def street_of(x: Column | str) -> Column:
    """``street``: words of the first comma part with a number or street word, but those; ``house``: the first number up to there."""
    parts = F.transform(F.split(text(x), ","), words)
    is_number = lambda w: w.rlike("^[0-9]+$")
    own = lambda p: F.filter(p, lambda w: ~is_number(w) & ~w.isin(STREET_TYPES + STREET_STOPS) & (F.length(w) > 1))
    told = lambda p: F.exists(p, lambda w: is_number(w) | w.isin(STREET_TYPES)) & (F.size(own(p)) > 0)
    at = F.array_position(F.transform(parts, lambda p: F.when(told(p), 1).otherwise(0)), F.lit(1))
    seen = F.flatten(F.slice(parts, F.lit(1), F.greatest(at, F.lit(1)).cast("int")))
    street = F.when(at > 0, F.array_join(own(F.try_element_at(parts, at.cast("int"))), " ")).otherwise("")
    house = F.when(at > 0, F.coalesce(F.get(F.filter(seen, is_number), F.lit(0)), F.lit(""))).otherwise("")
    return F.struct(street.alias("street"), house.alias("house"))


def number_keys(x: Column | str) -> Column:
    """Distinct ``number|word`` combinations of an address: numbers with their letters, words of three letters or more."""
    s = fold(x)
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit("[0-9a-z]*[0-9][0-9a-z]*"), F.lit(0)), lambda n: F.regexp_replace(n, "^0+(?=[0-9a-z])", "")))
    stops = STREET_TYPES + STREET_STOPS + ["null", "nan", "none"]
    names = F.array_distinct(F.filter(F.regexp_extract_all(s, F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(stops)))
    return F.flatten(F.transform(numbers, lambda n: F.transform(names, lambda w: F.concat(n, F.lit("|"), w))))


def processed(df: DataFrame) -> DataFrame:
    """The record with its 17 derived columns; none is null, flags are 0 or 1."""
    n, a = "business_name", "business_address"
    x = df.withColumns({
        "name_norm": name_norm(n), "core_name": core_name(n), "legal_form": legal_form(n), "domain_stem": domain_stem(n), "name_lat": core_name(n),
        "phonetic_code": phonetic(n), "has_honorific": has_honorific(n), "addr_norm": addr_norm(a), "street_tokens": street_tokens(a), "house_no": house_no(a),
        "zip_pin_cp": pin(a), "city": city(a), "state_code": state_code(a), "landmark_flag": landmark(a),
    })
    empty = lambda c: (F.col(c) == "").cast("int")
    return x.withColumns({"empty_addr": empty("addr_norm"), "missing_pin": empty("zip_pin_cp"), "missing_city": empty("city")})
