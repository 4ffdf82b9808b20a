import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shaleview.llm import address_parts, addresses, catalog, individuals, names, survivors
from shaleview.llm.common import pairs_within

ADDRESS = "struct<street:string,city:string,state:string,zip:string,country:string>"


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def swaps(a, b):
    return len(a) == len(b) and any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1))


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_near(a, b):
    assert names.near(a, b) == (distance(a, b) <= 1 or swaps(a, b))


@pytest.mark.parametrize("k", [1, 2])
def test_segment_pairs_equal_brute_force(spark, k):
    rng = random.Random(k)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(k + 2, 9))) for _ in range(250)}
    d = spark.createDataFrame([(w, "x", 1) for w in words], "s string, g string, y int")
    got = {(r.x, r.y) for r in names.segment_pairs(d.select("g", "s"), ["g"], k).collect()}
    want = {(a, b) for a in words for b in words if a != b and distance(a, b) <= k}
    assert want <= got and all(distance(a, b) <= k or k == 1 and swaps(a, b) or distance(a, b) == 2 and sorted(a) == sorted(b) for a, b in got)
    assert {(a, b) for a in words for b in words if a != b and k == 1 and swaps(a, b)} <= got


def test_turned_names(spark):
    family = ["Paskwold", "Gormcombe", "Vostrigg", "Kessholt", "Uxbmere", "Falwick"]
    first = ["Oliver", "Petra", "Tariq", "Yara"]
    rows = [f"{g} {f}" for f in family for g in first] + [f"{f}, {g}" for f in family[:3] for g in first] + ["Paskwold Oliver", "Paskwodl Tariq", "Vostrigg Yara Petra", "Kessholt, Petra", "O. Uxbmere", "Solo", "", None]
    got = {r.name: r.turned for r in names.turned_names(spark.createDataFrame([(r,) for r in rows], "name string")).collect()}
    assert {k for k, v in got.items() if v} == {"Paskwold Oliver", "Paskwodl Tariq", "Vostrigg Yara Petra"} and None not in got
    assert names.turned_names(spark.createDataFrame([], "name string")).count() == 0


@pytest.mark.parametrize("times", [1, 9])
def test_leads_are_the_same_at_any_size(spark, times):
    counts = [("g", "marlcombe", 40), ("g", "marlcomb", 2), ("g", "marxcombs", 2), ("g", "gormcote", 10), ("g", "gormcombe", 60), ("g", "fern", 20), ("g", "ferns", 10), ("g", "elm", 10), ("h", "marlcomb", 1), ("g", "gormwicke", 1), ("g", "gormwick", 1)]
    d = spark.createDataFrame([(g, s, n * times, "x") for g, s, n in counts], "g string, s string, n int, y string")
    assert {(r.g, r.s, r.t) for r in names.leads(d, ["g"]).collect()} == {("g", "marlcomb", "marlcombe"), ("g", "marxcombs", "marlcombe"), ("g", "gormwicke", "gormwick")}


def test_entities(spark):
    rows = [("r1", "PERSON", "Oliver J. Paskwold", None), ("r2", "PERSON", "Paskwold,Ollie", None), ("r3", "PERSON", "O. PASKWOLD", ""), ("r4", "PERSON", "Petra Paskwold", None), ("r5", "PERSON", "oliver paskwodl", None),
            ("r6", "PERSON", "Unknown", None), ("r7", "PERSON", None, None), ("r8", "PERSON", "Paskwold", None), ("r9", "PERSON", None, "Oliver Paskwold"), ("r1", "PERSON", "Oliver J. Paskwold", None),
            ("o1", "ORGANIZATION", "Aldcroft Marine Svcs Corp.", None), ("o2", "ORGANIZATION", "The Aldcroft Marine Services LLC", None), ("o3", "ORGANIZATION", "Aldcroft Foods", None), ("o4", "ORGANIZATION", "Marine Services of Aldcrft", None), ("e1", "EMAIL", "Oliver Paskwold", None)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "record_id string, entity_type string, raw_name string, normalized_value string, entity int")
    e = {r[0]: r[1] for r in names.entities(d).collect()}
    assert e["r1"] == e["r2"] == e["r3"] == e["r5"] == e["r9"] != e["r4"] and e["o1"] == e["o2"] == e["o4"] != e["o3"]
    assert not {"r6", "r7", "r8", "e1"} & set(e)
    assert names.entities(d.where("false")).count() == 0
    pairs = {tuple(r) for r in pairs_within(names.entities(d), "record_id", "entity", "a", "b").collect()}
    assert ("r1", "r2") in pairs and all(a < b for a, b in pairs)


@pytest.mark.parametrize(("given", "want"), [
    (("7157 Elderfield Parkway W, Apartment 21", "Oppingwood", "OR", "86134", "US"), ("7157", "21", "elderfield", "parkway", "w", "oppingwood", "86134")),
    (("7157 West Elderfield Pkwy No. 21", "Oppingwood", "OR", "86134", None), ("7157", "21", "elderfield", "parkway", "w", "oppingwood", "86134")),
    (("Cranebrook-Str. 8430", "Cromalton", None, "12451", "DE"), ("8430", "", "cranebrook", "street", "", "cromalton", "12451")),
    (("Cranebrookstr. 8430, 12451 Cromalton", None, None, None, "DE"), ("8430", "", "cranebrook", "street", "", "cromalton", "12451")),
    (("3967 Spruceridge Ln., Kirrenville, NY 03198", None, None, None, "US"), ("3967", "", "spruceridge", "lane", "", "kirrenville", "03198")),
    (("Flat No. 4B, 4248 Willowside Pl", "Rundwood", None, "QW17 3LE", "UK"), ("4248", "4b", "willowside", "place", "", "rundwood", "qw173le")),
    (("5616 No. Fern Ave., Apt 37", "Welbenmouth", "Washington", "3992", "US"), ("5616", "37", "fern", "avenue", "n", "welbenmouth", "03992")),
    ((None, None, None, None, None), None), (("", "x", None, None, None), None), (("12", "x", None, None, None), None)])
def test_address_parts(given, want):
    p = address_parts.parse(*given)
    assert (None if p is None else tuple(p[k] for k in ("number", "unit", "name", "kind", "direction", "town", "code"))) == want


def test_locations(spark):
    a = lambda s, c="Oppingwood", z="86134": (s, c, "OR", z, "US")
    rows = [("a1", a("7157 Elderfield Parkway W")), ("a2", a("7157 W. Elderfield Pkwy", "oppingwod")), ("a3", a("7157 Elderfeild Pky West", None)), ("a4", a("7157 West Elderfield")), ("b1", a("7157 Elderfield Lane W")),
            ("c1", a("7157 Elderfield Pkwy W", "Elsewhere", "11111")), ("d1", a("7157 Elderfield Pkwy W Apt 2")), ("n", None), ("m", (None,) * 5), ("a1", a("7157 Elderfield Parkway W")), (None, a("7157 Elderfield Parkway W"))]
    d = spark.createDataFrame([(*r, "x") for r in rows], f"key string, address {ADDRESS}, location string")
    loc = {r[0]: r[1] for r in addresses.locations(d).collect()}
    assert loc["a1"] == loc["a2"] == loc["a3"] and len({loc["a1"], loc["b1"], loc["c1"], loc["d1"]}) == 4
    assert loc["a4"] != loc["a1"]  # parkway or lane: it could be either
    assert not {"n", "m", None} & set(loc)
    assert addresses.locations(d.where("false")).count() == 0


@pytest.mark.parametrize(("given", "want"), [("mailto:Ann.B+hr@X.org", "ann.b@x.org"), ("<a@b.test>", "a@b.test"), ("ann(at)x.org", "ann@x.org"), ("ann at x dot org", "ann@x.org"), ("ann@x", ""), (None, "")])
def test_mailbox(given, want):
    assert individuals.mailbox(given) == want


@pytest.mark.parametrize(("given", "want"), [("tel 910/555-6276", "9105556276"), ("+1 910 555 6276", "9105556276"), ("910-555-6276 x80", "9105556276"), ("+44 (0)600 652-7431", "6006527431"), ("0600/6527431", "6006527431"), ("12", ""), (None, "")])
def test_line(given, want):
    assert individuals.line(given, None) == want


def contact(n, doc, name, email, dob, phone):
    return (n, doc, "EMAIL", name, email, dob, phone, None, "US", datetime(2024, 1, 1))


CONTACT = f"record_id string, source_document_id string, entity_type string, raw_name string, raw_email string, raw_dob string, raw_phone string, raw_address {ADDRESS}, country string, ingested_at timestamp"


def test_matches(spark):
    rng = random.Random(4)
    rows, who = [], {}
    family = [f"{a}{b}" for a in ("Marl", "Gorm", "Vost", "Kess", "Uxb", "Fal") for b in ("combe", "wick", "rigg", "holt", "mere")]
    first = ["Wanda", "Ivan", "Leila", "Peter", "Karim", "Nora", "Hugo", "Gita"]
    for p in range(90):
        f, g = family[p % 30], first[(p * 3 + p // 30) % 8]
        mail, dob, phone = f"{g}.{f}{p}@box.test".lower(), f"{1940 + p % 60}-0{p % 9 + 1}-1{p % 10}", f"206555{1000 + p // 2}"
        for k in range(4):
            rows.append(contact(f"r{p:02}{k}", f"d{rng.randrange(50)}", [f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{g} {f}"][k], [mail, mail.upper(), None, mail][k], [dob, dob, dob, None][k], [phone, None, phone, f"+1 {phone}"][k]))
            who[rows[-1][0]] = p
    rows += [contact("z1", "d1", None, None, None, None), contact("z2", "d2", None, None, None, None), (None, *contact("x", "d", "a", None, None, None)[1:]), rows[0]]
    m, links, sure = individuals.matches(spark.createDataFrame(rows, CONTACT))
    got = {r[0]: r[2] for r in m.collect()}
    pairs = lambda g: {(a, b) for a in g for b in g if a < b and g[a] == g[b]}
    want, have = pairs(who), pairs({k: v for k, v in got.items() if k in who})
    assert len(want & have) / len(want) > 0.9 and len(want & have) / len(have) > 0.95 and got["z1"] != got["z2"]
    assert all(0.5 <= r.confidence <= 1 for r in links.collect())
    # every pair of profiles of one individual has a confidence, linked or not
    pids = {}
    for r in m.collect():
        pids.setdefault(r.individual, set()).add(r.pid)
    known = {(r.a, r.b): r.confidence for r in sure.collect()}
    assert set(known) == {(a, b) for ps in pids.values() for a in ps for b in ps if a <= b} and all(0 <= c <= 1 for c in known.values())
    assert individuals.matches(spark.createDataFrame([], CONTACT))[0].count() == 0


def test_skyline_and_layers_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(f"g{rng.randrange(3)}", rng.randrange(1, 4), rng.randrange(2), float(rng.randrange(20)), float(rng.randrange(5))) for _ in range(300)]
    d = spark.createDataFrame(rows, "g string, a int, e int, b double, c double").repartition(5)
    got = [tuple(r) for r in survivors.skyline(d, "g", ["a", "e"], ["b", "c"]).collect()]
    beats = lambda x, y: x[0] == y[0] and all(p >= q for p, q in zip(x[1:], y[1:])) and x != y
    want = [r for r in rows if not any(beats(o, r) for o in rows)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_dominance_layers(spark):
    t = lambda day: datetime(2024, 1, day)
    rows = [("g", "top", "Ann Lee", "a@x.org", None, t(5), 0.9), ("g", "old", "Ann Lee", "a@x.org", None, t(4), 0.8), ("g", "older", "Ann Lee", None, None, t(3), 0.7), ("g", "own", None, None, "+12065553618", t(1), 0.1), ("g", "none", None, None, None, None, None)]
    d = spark.createDataFrame(rows, "group_id string, subject_id string, canonical_name string, canonical_email string, canonical_phone string, updated_at timestamp, merge_confidence double")
    assert {r.subject_id: r.layer for r in survivors.dominance_layers(d, 2).collect()} == {"top": 1, "own": 1, "old": 2, "none": 3, "older": 3}
    assert survivors.dominance_layers(d.where("false"), 2).count() == 0


def test_survivors(spark):
    t = lambda day: datetime(2024, 1, day)
    rows = [("g1", "s1", "Ann Marie Lee", "ann@x", "+12065553618", t(1), 0.1), ("g1", "s2", "Ann Lee", "a@x.org", "+1206555", t(2), 0.2), ("g1", "s3", "Unknown", "b@x.org", "0000000000", t(3), None), ("g1", "s3", "Unknown", "b@x.org", "0000000000", t(3), None),
            ("g2", "s4", "Bo", None, None, None, None), ("g2", "s5", "B. Xi", "", "n/a", t(1), 0.5), ("g3", "s6", None, None, None, t(1), 0.5), ("g3", "s7", "n/a", "@x.org", "***-***-1", t(1), 0.5), (None, "s8", "Al Bo", None, None, t(1), 0.5)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "group_id string, subject_id string, canonical_name string, canonical_email string, canonical_phone string, updated_at timestamp, merge_confidence double, value string")
    got = {(r.group_id, r.field_name): r.subject_id for r in survivors.field_survivors(d).collect()}
    assert got == {("g1", "canonical_name"): "s1", ("g1", "canonical_email"): "s3", ("g1", "canonical_phone"): "s1", ("g2", "canonical_name"): "s5"}
    assert survivors.field_survivors(d.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, name):
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    d = catalog.QUERIES[name](spark, sf)
    columns = sorted(d.columns)
    rows = c.sql(catalog.SQL[name]).select(*[f'"{x}"' for x in columns]).fetchall()
    assert sorted(map(repr, (tuple(r) for r in d.select(*columns).collect()))) == sorted(map(repr, rows))
