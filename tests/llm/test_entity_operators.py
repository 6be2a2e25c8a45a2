
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkweave.llm import addresses, cosine_join, linkage, neighbors, pairs, records, variants
from linkweave.sources.tables import cut_packed

PLACES = [("US", "Dongol Falls", "Texas", "TX", "19991"), ("US", "Dongol Falls", "Texas", "TX", "19992"), ("US", "Tranjin", "Colorado", "CO", "31049"), ("India", "Jilsagarh", "Gujarat", "GJ", "111171")]
GAZ = records.Gazetteer(PLACES)
WORDS = {w: 9 for w in "silver brothers roofing plumbing services traders medical hall kamal robert inc".split()}
SCHEMA = "entity_id string, business_name string, business_address string, country string, core int"


@pytest.fixture(scope="module")
def parsed(spark):
    def make(rows):
        return records.parse(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), PLACES, WORDS)

    return make


LEFT = [
    ("S1-1", "Zazinshon Silver Roofing LLC", "292 Sirzon Lane, Dongol Falls, TX 19991", "US"),
    ("S1-2", "Hochalche Kamal Traders Limited", "3270B, Malser Nagar, Jilsagarh, Gujarat 111171", "India"),
    ("S1-3", "Zazinshon Silver Roofing LLC", "7 Oak Street, Tranjin, CO 31049", "US"),
]
RIGHT = [
    ("S2-1", "zazinshn silver roofing", "Unit 4, #292 Sirzon Ln; Dongol Fals", "US"),
    ("S2-2", "Hochalche Traders", "House No 3270 b, Malser Ngr, 111 171", "India"),
    ("S2-3", "ZSR", "7 Oak St, Tranjin", "US"),
    ("S2-4", "Zazinshon Silver Roofing", None, "US"),
    ("S2-5", "", "", None),
    ("S2-6", None, "-", "US"),
    ("S2-7", "Merthrertru Medical Hall", "292 Sirzon Lane, Dongol Falls, TX 19991", "US"),
    ("S2-1", "zazinshn silver roofing", "Unit 4, #292 Sirzon Ln; Dongol Fals", "US"),
]


def test_address_reading():
    a = records.read_address("Fl 3, 8683/C Mill Rd., Near Tulsi Bank ATM, Dongol Fals, TX 19991-1234", "US", GAZ)
    assert (a["house"], a["suffix"], a["street"], a["kind"], a["pin"]) == ("8683", "c", "mil", "road", "19991") and a["town"] is not None
    for odd in (None, "", " ", "-", "N/A", ",,,", "1" * 5000):
        assert records.read_address(odd, "US", GAZ)["street"] == ""


def test_name_reading():
    assert records.read_name("M/s. Gulinstan Hema Textiles (ID: 5380) Pvt. Ltd.")[0] == ["gulinstan", "hema", "textiles"]
    assert records.read_name("zontri.example")[1] == "zontri" and records.read_name("K.S.I. (P) Ltd.")[2]
    assert records.transliterate("लिल्सुर्रा") == "lilsurra"
    assert records.read_name(None) == ([], "", False)


def test_link(parsed):
    got = {(r.a_id, r.b_id) for r in linkage.link(parsed(LEFT), parsed(RIGHT)).collect()}
    assert {("S1-1", "S2-1"), ("S1-2", "S2-2")} <= got
    assert not any(b in ("S2-4", "S2-5", "S2-6", "S2-7") for _, b in got)  # two namesakes, no name, another firm
    assert linkage.link(parsed([]), parsed(RIGHT)).count() == 0


def test_label_model_learns_planted_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.3
    names = linkage.LABELERS
    votes = {v: np.where(rng.random(len(truth)) < 0.15, 0, np.where(rng.random(len(truth)) < 0.9, 1, -1) * np.where(truth, 1, -1)) for v in names}
    counts = pd.DataFrame(votes).value_counts().reset_index(name="n")
    model = linkage.LabelModel(linkage.GROUPS).fit(counts, counts["n"].to_numpy(float))
    assert abs(model.prior - 0.3) < 0.03
    assert all(abs(a - 0.9) < 0.04 for a in model.accuracies(counts, counts["n"].to_numpy(float)).values())
    assert ((model.posterior(pd.DataFrame(votes)) > 0.5) == truth).mean() > 0.99


def test_hot_key_is_divided(parsed):
    left = [(f"S1-{i}", f"Core{chr(97 + i % 26)}{chr(97 + i // 26)}xyz Roofing", "9 Oak Street, Tranjin, CO 31049", "US") for i in range(100)]
    right = [(f"S2-{i}", f"core{chr(97 + i % 26)}{chr(97 + i // 26)}xyz roofing", "9 Oak St, Tranjin", "US") for i in range(100)]
    got = {(r.a_id, r.b_id) for r in linkage.candidates(parsed(left), parsed(right)).collect()}
    assert {(f"S1-{i}", f"S2-{i}") for i in range(100)} <= got


def test_same_building(parsed):
    a = [("S2-1", "x", "8683/C Mill Road, Dongol Falls, TX", "US"), ("S2-2", "x", "12 Sirzon Lane, Tranjin", "US"), ("S2-3", "x", "Sirzon Lane, Tranjin", "US"), ("S2-4", "x", None, "US"), ("S2-5", "x", "12 Sirzon Lane, Tranjin", "US")]
    b = [("S3-1", "y", "Ste 4, 8683 c Mill Rd, 19991", "US"), ("S3-2", "y", "8683D Mill Road, Dongol Falls", "US"), ("S3-3", "y", "12 Sirzon Lane, Tranjin", "US"), ("S3-4", "y", "#12 Sirzn Ln, Tranjin, CO", "US"), ("S3-5", "y", "12 Sirzon Street, Tranjin", "US")]
    got = {(r.a_id, r.b_id) for r in addresses.same_building(parsed(a), parsed(b)).collect()}
    assert got == {("S2-1", "S3-1"), ("S2-2", "S3-4"), ("S2-5", "S3-4")}
    assert addresses.same_building(parsed([]), parsed(b)).count() == 0


def test_forms_of_an_address_meet(parsed):
    """One letter off, cut off, run together with the type, initial alone, and by postcode where the town is not said."""
    said = ["8683 Mulgendor Road, Dongol Falls, TX 19991", "8683 Mulgndor Rd, Dongol Falls", "8683 Mulge Road, Dongol Falls", "8683 Mulgendorroad, Dongol Falls", "8683 M. Road, Dongol Falls", "8683 Mulgendor Road, 19991"]
    rows = parsed([(f"S2-{i}", "x", a, "US") for i, a in enumerate([*said, "8683 Sirzon Lane, Dongol Falls", "12 Mulgendor Road, Dongol Falls"])])
    places = addresses.buildings(rows)
    of: dict = {}
    for r in addresses.forms(places.dropDuplicates(["place"])).join(places.select("place", "entity_id"), "place").collect():
        of.setdefault(r.entity_id, set()).add(r.h)
    assert all(of["S2-0"] & of[f"S2-{i}"] for i in range(1, 4)) and of["S2-0"] & of["S2-5"]
    assert not of["S2-0"] & of["S2-6"] and not of["S2-0"] & of["S2-7"]


def test_variants(parsed):
    rows = [("S2-1", "Zazinshon Silver Roofing", "292 Sirzon Lane, Dongol Falls", "US"), ("S3-1", "Zaznishon Roofing LLC", "292 Sirzon Ln, Dongol Falls", "US"), ("S3-2", "Z.S.R.", "292 Sirzon Lane, Dongol Falls", "US"), ("S3-3", "Zazinshon Silver Roofing", "292 Sirzon Lane, Dongol Falls", "US"), ("S3-4", "Zazinshon Silver Roofing", "1 Oak Street, Tranjin", "US"), ("S2-2", None, None, None), ("S3-5", "", "", "US")]
    groups = variants.variant_groups(parsed(rows))
    assert groups.count() == len(rows)
    assert {(r.a_id, r.b_id) for r in variants.across(groups, "S2-", "S3-").collect()} == {("S2-1", "S3-1"), ("S2-1", "S3-2")}


def test_every_link_has_a_reading_that_verifies_it(parsed):
    """Initials, web names, cut and run-together own words reach the threshold as they are read; namesakes in common words don't."""
    rows = {n: (f"S2-{i}", n, "292 Sirzon Lane, Dongol Falls", "US") for i, n in enumerate(["Zazinshon Silver Roofing", "Z.S.R.", "zazinshonsilver.example", "Zazinshn Roofing", "Hochalche Silver Roofing", "H.S.R."])}
    read = {r.name: r for r in parsed(list(rows.values())).collect()}
    me = lambda a, b: variants._likeness(read[a], read[b])
    first, *same, other, letters = rows
    assert all(me(first, n) >= variants.SAME and me(n, first) == me(first, n) for n in same)
    assert me(first, letters) < variants.VARIANT and pairs.name_votes(read[first], read[other])[0] == -1


def test_collision_curve_is_met():
    for similar, rows in variants.CURVES.values():
        bands, r = variants.tune(similar, rows)
        assert r == rows and 1 - variants.collision(similar, bands, rows) <= variants.LOST < 1 - variants.collision(similar, bands - 1, rows)


def test_stars_cover_every_node(spark):
    links = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (4, 5), (6, 7)], "a_node long, b_node long")
    got = {r.node: r.star for r in variants.stars(links, spark.range(1, 10).withColumnRenamed("id", "node")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9}


def test_cosine_join_against_brute_force(parsed):
    left, right = parsed(LEFT), parsed(RIGHT)
    got = {(r.a_id, r.b_id): r.cosine for r in cosine_join.cosine_join(left, right, 0.2).collect()}
    ta, tb = ({} for _ in range(2))
    for side, out in ((left, ta), (right, tb)):
        for r in cosine_join.terms(side).collect():
            out.setdefault(r.entity_id, set()).add(r.term)
    df: dict = {}
    for terms in (*ta.values(), *tb.values()):
        for t in terms:
            df[t] = df.get(t, 0) + 1
    n = left.count() + right.count()
    idf = {t: np.log(1 + n / k) for t, k in df.items()}
    norm = lambda s: np.sqrt(sum(idf[t] ** 2 for t in s))
    true = {(a, b): sum(idf[t] ** 2 for t in x & y) / norm(x) / norm(y) for a, x in ta.items() for b, y in tb.items()}
    true = {k: v for k, v in true.items() if v >= 0.2}
    assert set(got) == set(true) and all(abs(got[k] - true[k]) < 1e-9 for k in true)


def test_cosine_join_of_many_records(spark, parsed):
    """Pairs are the brute-force ones, also of an id that has two rows, which was an error."""
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("bdfglmnprstvaeiou"), n))
    names = [word(int(rng.integers(4, 9))).capitalize() for _ in range(120)]
    make = lambda s, n: [(f"{s}-{i}", f"{rng.choice(names)} {rng.choice(['Silver Roofing', 'Plumbing Services', 'Medical Hall'])}", f"{rng.integers(1, 60)} {rng.choice(['Oak', 'Elm', 'Sirzon'])} Street, {rng.choice(['Tranjin, CO 31049', 'Dongol Falls, TX 19991'])}", "US") for i in range(n)]
    left, right = parsed([*make("S1", 150), ("S1-0", "Zork Silver Roofing", "9 Oak Street, Tranjin, CO 31049", "US")]), parsed(make("S2", 400))
    ta, tb = ({} for _ in range(2))
    for side, out in ((left, ta), (right, tb)):
        for r in cosine_join.terms(side).collect():
            out.setdefault(r.entity_id, set()).add(r.term)
    df: dict = {}
    for t in (t for terms in (*ta.values(), *tb.values()) for t in terms):
        df[t] = df.get(t, 0) + 1
    idf = {t: np.log(1 + 551 / k) for t, k in df.items()}
    norm = lambda s: np.sqrt(sum(idf[t] ** 2 for t in s))
    near = {(a, b): sum(idf[t] ** 2 for t in x & y) / norm(x) / norm(y) for a, x in ta.items() for b, y in tb.items()}
    for least in (0.3, 0.6):
        found = cosine_join.cosine_join(left, right, least)
        got = {(r.a_id, r.b_id): r.cosine for r in found.collect()}
        true = {k: v for k, v in near.items() if v >= least}
        assert true and set(got) == set(true) and all(abs(got[k] - true[k]) < 1e-9 for k in true)


def test_copies_of_parsed_records_are_compressed(spark, parsed):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("bdfglmnprstvaeiou"), 7)).capitalize()
    rows = [(f"S1-{i}", f"{word()} Silver Roofing LLC", f"{rng.integers(1, 999)} {word()} Lane, Dongol Falls, TX 19991", "US") for i in range(3000)]
    written = lambda: sum(p.stat().st_size for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("part-*"))
    source, sizes = parsed(rows).coalesce(1), [written()]
    kept = cut_packed(source)
    sizes.append(written())
    plain = source.checkpoint()
    sizes.append(written())
    assert sizes[1] - sizes[0] < 0.95 * (sizes[2] - sizes[1])
    assert kept.schema == plain.schema and kept.exceptAll(plain).isEmpty() and plain.exceptAll(kept).isEmpty()


def test_places_ruled_out_before_comparing_are_conflicts(parsed):
    """``may_be_one_place`` says no exactly where the votes of number, town and postcode do."""
    address = ["292 Sirzon Lane, Dongol Falls, TX 19991", "292A Sirzon Lane, Dongol Falls", "7 Oak Street, Tranjin, CO 31049", "Oak Street, Tranjin", "7 Oak Street, 31049", "7 Oak Street, 31050", "-", None]
    rows = parsed([(f"S1-{i}", "Silver", x, "US") for i, x in enumerate(address)]).select(pairs.side().alias("s"))
    both = rows.select(F.col("s").alias("a")).crossJoin(rows.select(F.col("s").alias("b"))).withColumn("may", pairs.may_be_one_place())
    got = pairs.compare(both, ["may"], parts=("place",)).collect()
    assert {r.may for r in got} == {True, False}
    assert all(r.may == (r.v_house >= 0 and r.v_town >= 0 and not (r.v_town == 0 and r.v_pin < 0)) for r in got)


def test_overlap_without_a_place_needs_the_own_word(parsed):
    test = [("S1-9", "Robert Brunstendo Plumbing Services Inc", "292 Sirzon Lane, Dongol Falls, TX 19991", "US")]
    train = [("S2-8", "Robert Brulgelkil Plumbing Services LLC", None, "US"), ("S2-9", "Bob Brunstendo Plumbing Services Inc", "-", "US"), ("S3-9", "brunstendo.example", "292 Sirzon Ln, Dongol Falls", "US")]
    assert {r.b_id for r in cosine_join.overlaps(parsed(test), parsed(train), parsed(test)).collect()} == {"S2-9", "S3-9"}


def test_overlaps_and_counts(parsed):
    found = cosine_join.overlaps(parsed(LEFT), parsed(RIGHT), parsed(LEFT))
    assert {("S1-1", "S2-1"), ("S1-2", "S2-2")} <= {(r.a_id, r.b_id) for r in found.collect()}
    assert "S2-4" not in {r.b_id for r in found.collect()}
    assert cosine_join.counts(found).first().source == "S2"


def brute(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    return {i: [ids[j] for j in sorted((j for j in range(len(ids)) if j != n), key=lambda j: (-s[n, j], ids[j]))[:k]] for n, i in enumerate(ids)}


def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(10)
    centre = rng.standard_normal((60, 16))
    x = np.repeat(centre, 15, 0) + 0.1 * rng.standard_normal((900, 16))
    x[100:140] = x[100]
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [1.0] * 3), (9003, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>")
    got: dict = {}
    for r in neighbors.most_similar(df, "vec_id", "v", 5, width=16, reach=32).collect():
        got.setdefault(r.vec_id, []).append(r.neighbour_id)
    true = brute(list(range(900)), x.astype(np.float32).astype(float), 5)
    assert set(got) == set(range(900)) and all(len(v) == 5 and len(set(v)) == 5 for v in got.values())
    assert sum(len(set(got[i]) & set(true[i])) for i in true) / (5 * 900) >= 0.9
    assert all(sorted(got[i]) == true[i] for i in range(100, 140))
    assert neighbors.most_similar(df.filter("vec_id >= 9000"), "vec_id", "v", 5, width=16).count() == 0


def test_windows_go_on_over_partition_borders(spark):
    """However many partitions hold the curves, no vector does worse than by the whole window on either side of it."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((700, 8)).astype(np.float32)
    x[:350] = x[:350].astype(np.float16)  # kept in half precision, the others in single
    reach, k, unit = 40, 5, x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    mean = unit.mean(0)
    rows = pd.DataFrame({"rep": range(700), "vec": [v.tobytes() for v in x]})
    keyed = pd.concat(list(neighbors._keys(8, mean, float(np.sqrt((1 - mean @ mean) / 8)), 2, 4, 6)(iter([rows])))).sort_values(["curve", "key", "rep"])
    near: dict = {i: set() for i in range(700)}
    for _, path in keyed.groupby("curve").rep:
        order = path.tolist()
        for n, i in enumerate(order):
            near[i] |= set(order[max(0, n - reach) : n + reach + 1]) - {i}
    least = {i: sorted((unit[i] @ unit[list(js)].T).tolist())[-k] for i, js in near.items()}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<float>")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            worst: dict = {}
            for r in neighbors.most_similar(df, "vec_id", "v", k, width=8, count=2, dims=4, reach=reach).collect():
                worst[r.vec_id] = min(worst.get(r.vec_id, 1.0), r.cosine)
            assert len(worst) == 700 and all(worst[i] >= least[i] - 1e-9 for i in worst), parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_hilbert_curve_steps():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    path = cells[np.argsort(neighbors.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_blank_columns_do_not_clash(parsed):
    assert parsed(RIGHT).filter(F.col("entity_id") == "S2-1").count() == 1


def test_crowded_building_keeps_its_links(parsed):
    rng = np.random.default_rng(12)
    names = ["".join(rng.choice(list("bdfglmnprstv")) + rng.choice(list("aeiou")) for _ in range(5)) for _ in range(90)]
    rows = [(f"S2-{i}", f"{n} Silver Roofing", "9 Oak Street, Tranjin, CO 31049", "US") for i, n in enumerate(names)]
    rows += [(f"S3-{i}", f"{n[:5]}{n[6:]} roofing llc", "#9 Oak St, Tranjin", "US") for i, n in enumerate(names)]
    found = {(r.a_id[3:], r.b_id[3:]) for r in variants.across(variants.variant_groups(parsed(rows)), "S2-", "S3-").collect()}
    right = {p for p in found if p[0] == p[1]}
    assert len(right) >= 85 and len(found - right) <= 5


def test_crowded_building_meets_like_any_other(parsed):
    filler = [f"{a}{b}{c}{d}zorvantel" for a in "bdfg" for b in "aeio" for c in "lmn" for d in "aou"][:100]
    pairs = [(f"{a}r{b}nk", f"{a}r{c}nk") for a in "bdfgkptv" for b, c in (("a", "o"), ("i", "u"))]
    place = "9 Oak Street, Tranjin, CO 31049"
    rows = [(f"S2-f{i}", n, place, "US") for i, n in enumerate(filler)]
    rows += [(f"S{2 + k}-{i}", p[k], place, "US") for i, p in enumerate(pairs) for k in (0, 1)]
    n = variants.nodes(parsed(rows))
    ids = {r.node: r.entity_id for r in n.collect()}
    built, others = variants.candidates(n.dropDuplicates(["node"]))
    got = {frozenset((ids[r.a_node], ids[r.b_node])) for r in built.collect()}
    assert others.count() == 0
    assert len(ids) > 100 and {frozenset((f"S2-{i}", f"S3-{i}")) for i in range(len(pairs))} <= got


def test_hot_name_keeps_all_its_candidates(parsed):
    left = [(f"S1-{i}", "Zazinshon Silver Roofing", f"{i + 1} Mulgen{chr(97 + i % 26)}{chr(97 + i // 26)} Road, Dongol Falls, TX 19992", "US") for i in range(70)]
    left.append(("S1-x", "Zazinshon Silver Roofing", "292 Sirzon Lane, Dongol Falls, TX 19991", "US"))
    right = [("S2-1", "Zazinshon Silver Roofing", "Sirzon Lane, Dongol Falls, TX 19991", "US"), ("S2-2", "zazinshon.example", None, "US"), ("S2-3", "Zazinshon", "Dongol Falls, TX 19991", "US")]
    got = {(r.a_id, r.b_id) for r in linkage.candidates(parsed(left), parsed(right)).collect()}
    assert got == {(a[0], b[0]) for a in left for b in right}


def test_only_pairs_that_may_be_linked_are_compared(parsed):
    """Without a town names meet by a common word or a house number that they share, not by their own word alone."""
    rows = [
        ("S2-1", "Zorvantel Roofing", "9 Oak Street, Tranjin, CO 31049", "US"),
        ("S3-1", "Zorvantl Roofing", None, "US"),
        ("S3-2", "Zorvantl Medical", None, "US"),
        ("S3-3", "Zorvantl", "9 Oak Street", "US"),
        ("S3-4", "Zorvantl Traders", "12 Oak Street", "US"),
        ("S2-5", "Zorvantl Medical Hall", "Tranjin", "US"),
    ]
    n = variants.nodes(parsed(rows))
    ids = {r.node: r.entity_id for r in n.collect()}
    built, others = variants.candidates(n)
    assert built.count() == 0
    assert {frozenset((ids[r.a_node], ids[r.b_node])) for r in others.collect()} == {frozenset(p) for p in (("S2-1", "S3-1"), ("S2-1", "S3-3"), ("S3-2", "S2-5"))}


def test_crowded_buildings_give_the_same_groups(parsed, monkeypatch):
    rows = parsed([*RIGHT, *LEFT, ("S3-1", "Z.S.R.", "7 Oak Street, Tranjin, CO", "US"), ("S3-2", "Merthertru Hall", "292 Sirzon Ln, Dongol Falls", "US"), ("S3-3", "zazinshonsilver.example", "292 Sirzon Road, Dongol Falls", "US")])
    stars = lambda: {(r.entity_id, r.star) for r in variants.variant_groups(rows).collect()}
    usual = stars()
    monkeypatch.setattr(variants, "CROWD", 1)
    assert stars() == usual and len({s for _, s in usual}) < len(usual)


def test_linked_says_what_all_votes_and_measures_say(parsed):
    said = [*LEFT, *RIGHT, ("S3-1", "Z.S.R.", "7 Oak Street, Tranjin, CO", "US"), ("S3-2", "Silver Roofing", "292 Sirzon Lane, Dongol Falls", "US"), ("S3-3", "zazinshonsilver.example", "292 Sirzon Road, Dongol Falls", "US"), ("S3-4", "Zazinshon Plumbing", "Dongol Falls", "US")]
    rows = [r for r in parsed(said).collect()]

    def all_of_it(a, b):
        house, street, town, pin = pairs.place_votes(a, b)
        core, words, _, initials = pairs.name_votes(a, b)
        me, all_words, own = (f(a, b) for f in variants.MEASURES.values())
        place = house >= 0 and street >= 0 and town >= 0 and not (town == 0 and pin < 0)
        in_building = house == 1 and me >= variants.SAME and (core == 1 or initials == 1 or core == 0 and initials == 0 and me >= variants.VARIANT)
        elsewhere = core == 1 and words >= 0 and (town == 1 or words == 1) and me >= variants.SAME and (all_words >= variants.VARIANT or all_words == 0)
        return (own < variants.OWN and initials < 1) if place and (in_building or elsewhere) else None

    got = [(variants.linked(a, b), all_of_it(a, b)) for a in rows for b in rows]
    assert all(x == y for x, y in got) and {x for x, _ in got} == {True, False, None}


def test_exploded_sides_are_not_broadcast(spark, parsed):
    """Spark sizes a side by its rows before an explode; the driver must not gather what comes out."""
    rows = [(f"S2-{i}", f"{a}or{b}insh Silver Roofing", f"{5 if i % 2 else ''} Oak Street, Tranjin, CO 31049", "US") for i, (a, b) in enumerate((a, b) for a in "bdfg" for b in "klmnrt")]
    columns = ["node", "country", *pairs.SIDE]
    n = variants.nodes(parsed(rows)).select(*columns, F.col("core").alias("own"), F.array(F.substring("core", 1, 1)).alias("firsts"), F.array(F.lit("silv"), F.lit("roof")).alias("words"))
    met = variants._meet(n.filter("house = ''"), n, "town", ["country", "town"])
    by_word = variants._meet(*(n.withColumn("w", F.explode("words")) for _ in "ab"), "country", ["country", "w"])
    spot = n.select(F.lit(1).alias("spot"), "node", "firsts", variants._bands(*variants.tune(*variants.CURVES["house"]))("own").alias("bands"), pairs.side().alias("side"))
    near = variants._near(spot.withColumn("called", F.col("node")))
    for df in (met, by_word, near):
        assert df.count() > 0
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_overlaps_compare_pairs_once(parsed):
    """Pairs with and without a place are compared in one pass over them."""
    test, train = cut_packed(parsed(LEFT)), cut_packed(parsed(RIGHT))
    found = cosine_join.overlaps(test, train, test)
    assert str(found._jdf.queryExecution().optimizedPlan().toString()).count("MapInPandas") == 1
    assert {("S1-1", "S2-1"), ("S1-2", "S2-2")} <= {(r.a_id, r.b_id) for r in found.collect()}
