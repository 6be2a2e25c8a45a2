from pyspark.sql import functions as F

from linkweave.functions import script
from linkweave.functions import text as T


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(*columns).first()


def test_name_parts(spark):
    cases = [
        ("*** Prívate *** [Services] (ID: 1072)", T.core_name("x"), "private"),
        ("GURU INFOTECH PVT. LTD.", T.core_name("x"), "guru infotech"),
        ("SARL Dupont", T.legal_form("x"), "sarl"),
        ("Thermal & Fils SASU", T.legal_form("x"), "sasu"),
        ("projectsmanipalindia.com", T.domain_stem("x"), "projectsmanipalindia"),
        ("Shri Ram Traders", T.has_honorific("x"), 1),
        (None, T.core_name("x"), ""),
        ("", T.phonetic("x"), ""),
        ("École Ltd", T.phonetic("x"), "E240"),
    ]
    for value, column, expected in cases:
        assert one(spark, value, column.alias("v")).v == expected, value


def test_address_parts(spark):
    cases = [
        ("H.no 780, R. Voltaire, 75011 Paris", T.house_no("x"), "780"),
        ("H.no 780, R. Voltaire, 75011 Paris", T.pin("x"), "75011"),
        ("175 Boulevard Bd Saint-Germain, Paris", T.house_no("x"), "175"),
        ("#12, Lake Town, Kolkata", T.house_no("x"), "12"),
        ("Shop 5, Near SBI ATM, Pune", T.landmark("x"), 1),
        ("12 Rue de la Gare, Lille, Hauts-de-France", T.landmark("x"), 1),
        ("20 Rue Parmentier, Dunkerque, Hauts-de-France", T.state_code("x"), "hauts-de-france"),
        ("20 Rue Parmentier, Dunkerque, Hauts-de-France", T.city("x"), "dunkerque"),
        ("30 Rue Louis Thenard, Saint-Nazaire, Pays de la Loire", T.state_code("x"), "pays de la loire"),
        ("15 bis Rue de Barbieux, Roubaix", T.street_of("x")["street"], "barbieux"),
        ("15 bis Rue de Barbieux, Roubaix", T.street_of("x")["house"], "15"),
        ("0058", F.array_join(T.words("x"), " "), "58"),
        (None, T.addr_norm("x"), ""),
        ("", T.city("x"), ""),
    ]
    for value, column, expected in cases:
        assert one(spark, value, column.alias("v")).v == expected, value
    assert "boulevard" in one(spark, "175 Boulevard Bd Saint-Germain, Paris", T.addr_norm("x").alias("v")).v


def test_scripts(spark):
    r = spark.createDataFrame([("smart",), ("café",), ("दिल्ली",), ("తెలుగు",)], "x string").select(T.is_native("x").alias("v")).collect()
    assert [x.v for x in r] == [False, False, True, True]
    assert script.transliterate("दिल्ली") == "dilli"
    assert script.normalize("Ｃａｆé") == "cafe"


def test_keys_of_odd_values(spark):
    rows = [("1", None, None), ("2", "", ""), ("3", "!!!", "---"), ("4", "Aeiou", "12 x")]
    r = {x.entity_id: x for x in T.with_keys(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string")).collect()}
    assert r["1"].first_tok is None and r["2"].nprefix is None and r["3"].phon == "" and r["4"].phon == "" and r["4"].hnum == "12"
