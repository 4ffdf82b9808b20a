import itertools

import pytest
from pyspark.sql import functions as F

from shaleview.cluster import components
from shaleview.functions.similarity import jaro_winkler_score
from shaleview.operators import detection as D
from shaleview.operators import resolution as R
from shaleview.operators import structure as S
from shaleview.plans import pipeline

RECORD = "record_id string, entity_type string, normalized_value string, raw_name string, raw_email string, raw_phone string, raw_dob string, raw_address struct<street:string,city:string,state:string,zip:string,country:string>, country string, entity_role string"


def test_detect_places(spark):
    text = "é a@b.org and 123-45-6789, 😀 c.d@e.io"
    rows = D.detect(spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z")], "doc_id int, text string, value2 string"), types=["EMAIL", "SSN"]).collect()
    assert sorted(text[r.start : r.end] for r in rows) == ["123-45-6789", "a@b.org", "c.d@e.io"]
    assert all(text[r.start : r.end] == r.value for r in rows)


def test_detect_empty_and_regions(spark):
    assert D.detect(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    assert {p[0] for p in D.chosen(["UK"])} >= {"EMAIL", "NHS_NUMBER"} and "SSN" not in {p[0] for p in D.chosen(["UK"])}


def test_best_keeps_first_on_tie(spark):
    d = spark.createDataFrame([(1, "A", "v", 0.5, 2), (1, "A", "v", 0.9, 3), (1, "A", "v", 0.9, 1)], "doc int, entity_type string, value string, score double, seq int")
    assert D.best_per_value(d, ["doc"], ["seq"]).first().seq == 1


@pytest.mark.parametrize(("kind", "value", "context", "want"), [
    ("STUDENT_ID", "statement", "", "common_word"), ("STUDENT_ID", "SABCDE", "", "no_digit"), ("DATE_OF_BIRTH_ISO", "1990-01-01", "born 1990-01-01", None),
    ("DATE_OF_BIRTH_ISO", "1990-01-01", "invoice of 1990-01-01", "transaction_date"), ("DATE_OF_BIRTH_ISO", "1990-01-01", "x", "no_birth_word"),
    ("PHONE_NUMBER", "1,153.84", "", "currency"), ("EMAIL", "x", "invoice", None), ("DRIVER_LICENSE_US", "A1234567", "driver A1234567", None), ("VAT_EU", "DEABCDEFGH", "", "letters_only")])
def test_false_positive(spark, kind, value, context, want):
    d = spark.createDataFrame([(kind, value, context)], "k string, v string, c string")
    assert d.select(D.false_positive(F.col("k"), F.col("v"), F.col("c")).alias("x")).first().x == want


def test_header_longest_word_wins(spark):
    d = spark.createDataFrame([("[REVIEW] Date of Birth",), ("Zip Code",), ("Other",), (None,)], "h string")
    got = [r.x for r in d.select(D.header_type(F.col("h"))["entity_type"].alias("x")).collect()]
    assert got == ["DATE_TIME", "LOCATION", None, None]


def test_confidence_label(spark):
    d = spark.createDataFrame([("a", 0.9)] * 5 + [("b", 0.4), ("b", 0.9), ("c", None)], "g string, score double")
    assert {r.g: r.confidence for r in D.confidence_label(d, ["g"]).collect()} == {"a": "high", "b": "low", "c": "partial"}


def test_sections_and_stitching(spark):
    b = spark.createDataFrame([(1, 1, "Patient Information", None), (1, 2, "x", None), (1, 3, "Employer details", None), (2, 4, "y", None)], "doc_id int, block_id int, text string, col_header string")
    assert {r.block_id: r.role for r in S.sections(b).collect()} == {1: "primary_subject", 2: "primary_subject", 3: "institutional", 4: "unknown"}
    p = spark.createDataFrame([(1, 1, "\n".join("abcdefg")), (1, 2, "z")], "doc_id int, page int, text string")
    r = {x.page: x for x in S.stitched(p).collect()}
    assert r[2].stitched == "c\nd\ne\nf\ng\nz" and r[2].tail_len == 9 and r[1].tail_len == 0


def test_onset_and_verified(spark):
    p = spark.createDataFrame([(1, 0, "hello", 1), (1, 4, "SSN here", 2), (1, 5, "x", 3), (2, 0, "none", 4)], "doc_id int, page int, text string, block_id int")
    assert {r.doc_id: r.onset for r in S.onset(p).collect()} == {1: 3, 2: 0}
    found = spark.createDataFrame([(1, 5, 0.9)], "doc_id int, page int, score double")
    assert {r.doc_id: r.onset for r in S.verified_onset(p, found).collect()} == {1: 5, 2: 0}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5), (None, 3)], "a int, b int")
    got = {r.node: r.component for r in components(e).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_shared_folder(spark, monkeypatch):
    from shaleview import cluster

    class Conf:
        def get(self, *a):
            return None

        def set(self, *a):
            pass

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        cluster.checkpoint_dir(Session())
    Session.sparkContext.master = "local[2]"
    assert cluster.checkpoint_dir(Session()).startswith("file://")
    keep = len(cluster._TABLES)
    d = cluster.written(spark.range(3), "t")
    assert d.count() == 3 and cluster.clear(spark, keep) == 1
    with pytest.raises(Exception):
        d.count()


def brute(rows, least=0.30):
    def dob(v):
        return v

    out = {}
    for x, y in itertools.combinations(rows, 2):
        roles = {x["entity_role"], y["entity_role"]}
        if "primary_subject" in roles and roles & {"institutional", "provider"}:
            if least <= 0:
                out[tuple(sorted((x["record_id"], y["record_id"])))] = 0.0
            continue
        s = 0.0
        near = x["normalized_value"] == y["normalized_value"] or sum(a != b for a, b in zip(x["normalized_value"] or "", y["normalized_value"] or "")) == 1 and len(x["normalized_value"]) == len(y["normalized_value"])
        if x["entity_type"] == y["entity_type"] == "SSN" and near:
            s += 0.5
        if x["raw_email"] and x["raw_email"] == y["raw_email"]:
            s += 0.4
        if x["raw_phone"] and x["raw_phone"] == y["raw_phone"]:
            s += 0.35
        if x["raw_name"] and y["raw_name"] and (x["raw_name"].lower() == y["raw_name"].lower() or jaro_winkler_score(x["raw_name"], y["raw_name"]) >= 0.92):
            if x["raw_dob"] and dob(x["raw_dob"]) == dob(y["raw_dob"]):
                s += 0.35
            s += 0.10
        if min(s, 1.0) >= least:
            out[tuple(sorted((x["record_id"], y["record_id"])))] = round(min(s, 1.0), 6)
    return out


def test_blocked_edges_equal_all_pairs(spark):
    names = ["Ann Lee", "Ann Leee", "Bo Xi", None]
    rows = [dict(record_id=f"r{i}", entity_type=["SSN", "EMAIL"][i % 2], normalized_value=f"12345678{i % 4}" if i % 2 == 0 else "v", raw_name=names[i % 4], raw_email=[None, "a@b.c", "d@e.f"][i % 3],
                 raw_phone=[None, "1", "2", "3", None][i % 5], raw_dob=["1990-01-01", None][i % 2], raw_address=None, country="US", entity_role=[None, "primary_subject", "provider"][i % 3 if i % 7 == 0 else 0]) for i in range(24)]
    d = spark.createDataFrame([tuple(r.values()) for r in rows], RECORD)
    assert {(r.a, r.b): round(r.confidence, 6) for r in R.edges(d).collect()} == brute(rows)
    with pytest.raises(ValueError):
        R.edges(d, threshold=0.1)
    with pytest.raises(ValueError):
        R.edges(d, ["nonsense"])
    # the confidence of a group is the least over all its pairs, linked or not
    of = {r.record_id: r.group_id for r in R.groups(d).collect()}
    c = {r.group_id: r for r in R.group_confidence(d).collect()}
    every = brute(rows, 0.0)
    want = {g: min([every[tuple(sorted(x))] for x in itertools.combinations([k for k in of if of[k] == g], 2)], default=1.0) for g in set(of.values())}
    assert {g: round(r.merge_confidence, 6) for g, r in c.items()} == want and all(r.needs_review == (r.merge_confidence < 0.8) for r in c.values())


def test_transitive_group_and_copies(spark):
    row = lambda k, mail, phone, name=None: (k, "EMAIL", "x", name, mail, phone, None, None, "US", None)
    rows = [row("a", "m@x.org", None), row("b", "m@x.org", "1"), row("c", None, "1"), row("d", "n@x.org", None), row("d2", "n@x.org", None), row("e", None, None, "Ann Lee"), row("e2", None, None, "Ann Lee"),
            row("f", "q@x.org", "7", "Ann Lee"), row("g", "q@x.org", "8", "Anne Lee"), row("h", None, "8", "Ann Leee")]
    got = {r.group_id: (r["size"], round(r.merge_confidence, 2)) for r in R.group_confidence(spark.createDataFrame(rows, RECORD)).collect()}
    # a and c agree in nothing; names alone don't link; f and h share no more than an alike name
    assert got == {"a": (3, 0.0), "d": (2, 0.4), "e": (1, 1.0), "e2": (1, 1.0), "f": (3, 0.1)}


def test_best_value_and_upsert(spark):
    d = spark.createDataFrame([(1, "Bo"), (1, "Bob"), (1, "Bob"), (1, "Rob"), (1, "Rob"), (2, None), (2, "")], "g int, v string")
    assert [(r.g, r.v) for r in R.best_value(d, "g", "v").collect()] == [(1, "Bob")]
    cols = "subject_id string, canonical_email string, canonical_phone string, pii_types_found array<string>, source_records array<string>, merge_confidence double"
    old = spark.createDataFrame([("s1", "a@b.c", "1", ["X"], ["r1"], 0.9)], cols)
    new = spark.createDataFrame([("n1", "A@B.C", None, ["A"], ["r2"], 0.5), ("n2", None, "1", None, ["r3"], 0.7), ("n3", None, None, ["Q"], None, 1.0)], cols)
    r = {x.subject_id: x for x in R.upserted(old, new).collect()}
    assert set(r) == {"s1", "n3"} and r["s1"].pii_types_found == ["A", "X"] and set(r["s1"].source_records) == {"r1", "r2", "r3"} and r["s1"].merge_confidence == 0.5


def test_name_keys_meet_alike_names(spark):
    rng = __import__("random").Random(7)
    base = ["john smith", "petra quayle", "o'brien", "wanda marlcombe", "yara gormwick", "al bo"]
    names = set(base)
    for b in base * 40:
        w = list(b)
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [rng.choice("aeioxt")], [w[i], rng.choice("lrsn")]])
        names.add("".join(w).strip() or "x")
    names = sorted(names)
    d = spark.createDataFrame([(n,) for n in names], "n string")
    keys = {r.n: set(r.k) for r in d.select("n", R.name_keys(F.col("n")).alias("k")).collect()}
    pairs = d.withColumnRenamed("n", "x").crossJoin(d.withColumnRenamed("n", "y")).where("x < y")  # a small test table
    from shaleview.functions.similarity import same_name

    alike = pairs.where(same_name("x", "y")).collect()
    assert len(alike) > 300 and all(keys[r.x] & keys[r.y] for r in alike)


def test_upsert_equals_one_by_one(spark):
    rng = __import__("random").Random(3)
    cols = "subject_id string, canonical_email string, canonical_phone string, pii_types_found array<string>, source_records array<string>, merge_confidence double"
    pick = lambda kind, n: rng.choice([None, "", *[f"{kind}{i}" for i in range(n)]])
    row = lambda k: (k, pick("M", 9), pick("p", 9), rng.choice([None, ["X"], ["Y", "X"]]), [f"r{k}"], rng.choice([None, 0.4, 0.9]))
    old, new = [row(f"a{i:02}") for i in range(5)], [row(f"n{i:02}") for i in range(40)]
    kept = {}
    for r in old:
        kept[r[0]] = [r[1], r[2], set(r[3] or []), set(r[4]), r[5]]
    for r in new:
        same = lambda i: next((k for k, v in kept.items() if r[i + 1] and v[i] and v[i].lower() == r[i + 1].lower()), None)  # noqa: B023, E731
        at = same(0) or same(1)
        if at:
            k = kept[at]
            k[2] |= set(r[3] or [])
            k[3] |= set(r[4])
            k[4] = min(1.0 if k[4] is None else k[4], 1.0 if r[5] is None else r[5])
        else:
            kept[r[0]] = [r[1], r[2], set(r[3] or []), set(r[4]), r[5]]
    got = {x.subject_id: [x.canonical_email, x.canonical_phone, set(x.pii_types_found), set(x.source_records), x.merge_confidence] for x in R.upserted(spark.createDataFrame(old, cols), spark.createDataFrame(new, cols)).collect()}
    assert got == kept
    assert R.upserted(spark.createDataFrame(old, cols), spark.createDataFrame([], cols)).count() == 5


def test_places_of_many_matches(spark):
    text = " ".join(f"a{i}@b.org" for i in range(700))
    rows = D.detect(spark.createDataFrame([(text,)], "text string"), types=["EMAIL"]).collect()
    assert len(rows) == 700 and all(text[r.start : r.end] == r.value for r in rows)


def test_counts_and_places_agree_beside_other_scripts(spark):
    d = spark.createDataFrame([("é123-45-6789",), ("ж123-45-6789ж",), ("x 123-45-6789",), ("№123-45-6789",)], "text string")
    n = {r.entity_type: r.n_matches for r in D.counts(d, types=["SSN"]).collect()}
    assert n["SSN"] == D.detect(d, types=["SSN"]).count() == 2


def filtered(spark, text, value, kind, **given):
    start = text.index(value)
    found = spark.createDataFrame([(1, kind, value, start, start + len(value), text, given.get("confidence", 0.9))], "doc_id bigint, entity_type string, value string, start int, end int, text string, schema_confidence double")
    found = found.withColumn("near", D.around("text", "start", "end", 200))
    empty = lambda ddl: spark.createDataFrame([], ddl)
    table = lambda name, ddl: spark.createDataFrame(given[name], ddl) if name in given else empty(ddl)
    return D.schema_filter(found, table("fields", "doc_id bigint, value string, is_pii boolean, suppress_types array<string>, override string, seq int"), table("dates", "doc_id bigint, value string, is_pii boolean"),
                           table("people", "doc_id bigint, name string"), table("hints", "doc_id bigint, hint string"), table("tables", D.TABLES))


@pytest.mark.parametrize(("text", "value", "kind", "given", "want"), [
    ("Account 12345", "12345", "SSN", {"fields": [(1, "12345", False, [], None, 0)]}, ("suppress", "field_map", None)),
    ("ID 9876", "9876", "PHONE_US", {"fields": [(1, "9876", True, [], "STUDENT_ID", 0)]}, ("reclassify", "field_map", "STUDENT_ID")),
    ("Debit Credit Balance 55-1", "55-1", "PHONE_US", {"tables": [(1, 0, False, ["Balance"], [])]}, ("suppress", "table", None)),
    ("Amount 55-1", "55-1", "PHONE_US", {"tables": [(1, 0, True, ["Amount"], ["Holder"])]}, ("suppress", "table", None)),
    ("Holder Amount 55-1", "55-1", "PHONE_US", {"tables": [(1, 0, True, ["Amount"], ["Holder"])]}, ("keep", None, None)),
    ("far away 55-1", "55-1", "PHONE_US", {"tables": [(1, 0, False, ["Balance"], [])]}, ("keep", None, None)),
    ("on 01/02/2024", "01/02/2024", "DATE_OF_BIRTH_MDY", {"dates": [(1, "01/02/2024", False)]}, ("suppress", "date", None)),
    ("Ann Lee", "Ann Lee", "ORGANIZATION", {"people": [(1, "ann lee")]}, ("reclassify", "person", "PERSON")),
    ("code XY-1 here", "XY-1", "SSN", {"hints": [(1, "all xy-1 codes")]}, ("suppress", "hint", None)),
    ("code XY-1 here", "XY-1", "SSN", {"hints": [(1, "all xy-1 codes")], "confidence": 0.4}, ("keep", None, None))])
def test_schema_filter(spark, text, value, kind, given, want):
    f = filtered(spark, text, value, kind, **given)
    r = f.first()
    assert (r.action, r.rule, r.new_type) == want
    log = D.suppression_log(f).collect()
    assert len(log) == (want[1] is not None) and all(x.detected_text == "*" * max(len(value) - 4, 0) + value[-4:] if len(value) > 4 else "*" * len(value) for x in log)


def test_document_type_by_words_and_seams(spark):
    filler = " ".join(["word"] * 242)
    rows = [(1, 1, "1", "patient " + filler), (2, 1, "1", "the medical"), (2, 2, "1", "record of the patient"), (3, 1, "1", "nothing known"), (4, 1, "9", "patient"), (5, 1, "1", None)]
    got = {r.doc_id: (r.document_type, r.confidence) for r in S.document_type(spark.createDataFrame(rows, "doc_id int, block_id int, page_or_sheet string, text string")).collect()}
    assert got[1] == ("medical_record", round(50 / 243 + 0.5, 6)) and got[2] == ("medical_record", 0.95) and got[3] == ("unknown", 0.0) and 4 not in got


def test_roles_and_merges(spark):
    b = spark.createDataFrame([(1, 1, "Patient Information", None), (1, 2, "a@b.org", None), (2, 3, "x", None)], "doc_id int, block_id int, text string, col_header string")
    roles = S.block_roles(b)
    found = S.with_roles(D.detect(b, types=["EMAIL"]), roles).first()
    assert found.entity_role == "primary_subject" and found.entity_role_confidence == pytest.approx(0.765)
    model = spark.createDataFrame([(1, 2, "provider", 0.9), (2, 3, "provider", 0.4), (2, 4, "institutional", 0.4)], "doc_id int, block_id int, role string, role_confidence double")
    assert {(r.block_id, r.role) for r in S.merged_roles(roles, model).collect()} == {(1, "primary_subject"), (2, "primary_subject"), (3, "provider"), (4, "institutional")}
    own = spark.createDataFrame([(1, "patient_information", [1, 2], 0)], "doc_id int, section string, blocks array<bigint>, seq int")
    more = spark.createDataFrame([(1, "header_footer", [2, 3], 0), (1, "legal_boilerplate", [4], 1), (1, "unknown", [4, 5], 2), (9, "unknown", [1], 0)], "doc_id int, section string, blocks array<bigint>, seq int")
    assert {(r.doc_id, r.section) for r in S.merged_sections(own, more).collect()} == {(1, "patient_information"), (1, "legal_boilerplate"), (9, "unknown")}
    kinds = lambda *rows: spark.createDataFrame(rows, "doc_id int, document_type string, confidence double")
    assert {tuple(r) for r in S.merged_types(kinds((1, "unknown", 0.0), (2, "legal_document", 0.4), (3, "unknown", 0.0)), kinds((1, "student_file", 0.9), (2, "student_file", 0.9))).collect()} == {(1, "student_file", 0.9), (2, "legal_document", 0.4), (3, "unknown", 0.0)}


def test_replies_are_read_element_by_element(spark):
    reply = '```json\n{"document_type": "poem", "confidence": 7, "sections": [{"section_type": "patient_information", "block_indices": [0]}, "oops", {"section_type": "nonsense"}], "entity_roles": [{"block_index": 1, "entity_role": "provider"}, {"block_index": -1, "entity_role": "provider"}, {"entity_role": "chef"}]}\n```'
    d = spark.createDataFrame([(reply,), ("no json",), ("{broken",), (None,)], "r string")
    got = [r.x for r in d.select(S.structure_reply(F.col("r")).alias("x")).collect()]
    assert got[0].document_type == "unknown" and got[0].confidence == 1.0 and [x.section_type for x in got[0].sections] == ["patient_information"] and [x.block_index for x in got[0].entity_roles] == [1]
    assert got[1] is None and got[2] is None and got[3] is None
    reply = '{"field_map": [{"label": "Acct", "value_example": "12", "is_pii": false}, 5], "people": [{"name": "Ann"}], "tables": [{"columns": [{"header": "Balance", "contains_pii": false}], "has_pii_columns": false}], "schema_confidence": -3, "suppression_hints": ["x"]}'
    x = spark.createDataFrame([(reply,)], "r string").select(S.schema_reply(F.col("r")).alias("x")).first().x
    assert x.confidence == 0.0 and [f.value for f in x.fields] == ["12"] and x.people[0].role == "unknown" and x.tables[0]["columns"][0].header == "Balance" and x.hints == ["x"] and x.dates == []


def test_onset_and_samples_by_kind(spark):
    rows = [(1, i, "pdf", str(i // 2), "SSN here" if i == 5 else "x") for i in range(8)] + [(2, 100 + i, "csv", "0", "name") for i in range(60)] + [(3, 200 + i, "docx", str(i), "account" if i == 2 else "y") for i in range(30)]
    b = spark.createDataFrame(rows, "doc_id int, block_id int, file_type string, page_or_sheet string, text string")
    on = S.block_onset(b)
    assert {r.doc_id: r.onset for r in on.collect()} == {1: "2", 2: "0", 3: "2"}
    n = {r.doc_id: (r["count"], r.lo) for r in S.sample_blocks(b, on).groupBy("doc_id").agg(F.count("*").alias("count"), F.min("block_id").alias("lo")).collect()}
    assert n == {1: (2, 4), 2: (50, 100), 3: (20, 202)}


def test_page_report(spark):
    b = spark.createDataFrame([(1, "1", "pdf", "a@b.org 123-45-6789"), (1, "1", "pdf", "x"), (1, "2", "csv", "y")], "doc_id int, page_or_sheet string, file_type string, text string")
    r = {x.page_or_sheet: x for x in D.page_report(b, D.detect(b, types=["EMAIL", "SSN"])).collect()}
    assert (r["1"].blocks_extracted, r["1"].pii_hits, r["1"].by_type) == (2, 2, {"EMAIL": 1, "SSN": 1}) and (r["2"].page_type, r["2"].pii_hits) == ("sheet", 0)


def test_sample_sizes_and_stages(spark):
    d = spark.createDataFrame([(0,), (1,), (20,), (1000,)], "n bigint")
    assert [r.x for r in d.select(S.sample_size(F.col("n"), 0.05, 2, 30).alias("x")).collect()] == [0, 1, 2, 30]
    with pytest.raises(ValueError):
        S.sample_size(F.col("n"), 0)
    runs = spark.createDataFrame([("a", "failed", None), ("b", "running", {"Discovery": "completed"}), ("c", "completed", {})], "run_id string, status string, m map<string,string>")
    got = {(r.run_id, r.stage): r.status for r in S.stage_status(runs, "m").collect()}
    assert got[("a", "Discovery")] == "failed" and got[("b", "Discovery")] == "completed" and got[("b", "Notification")] == "pending" and got[("c", "Notification")] == "completed" and len(got) == 24


def test_target_types():
    known = {"p": ["SSN"], "q": ["EMAIL"]}
    assert D.target_types({"target_entity_types": ["PAN"], "base_protocol_id": "p"}, "q", known) == ["PAN"]
    assert D.target_types({"base_protocol_id": "p"}, "q", known) == ["SSN"] and D.target_types({"base_protocol_id": "z"}, "q", known) == ["EMAIL"] and D.target_types(None, None, known) is None


def test_every_detection_is_a_record(spark):
    cols = "doc_id int, page_or_sheet string, block_id int, table_id string, row_index int, entity_type string, value string, start int, end int, score double"
    prose = [(1, "1", 10, None, None, "EMAIL", "a@x.org", 0, 7, 0.9), (1, "1", 10, None, None, "EMAIL", "b@x.org", 9, 16, 0.9), (1, "1", 10, None, None, "PHONE_US", "555-1", 20, 25, 0.6)]
    one = [(1, "2", 20, "t", 0, "EMAIL", "c@x.org", 0, 7, 0.9), (1, "2", 21, "t", 0, "SSN", "123-45-6789", 0, 11, 0.9)]
    two = [(1, "2", 30, "t", 1, "EMAIL", "d@x.org", 0, 7, 0.9), (1, "2", 31, "t", 1, "EMAIL", "e@x.org", 0, 7, 0.9), (1, "2", 32, "t", 1, "PHONE_US", "555-2", 0, 5, 0.6)]
    loose = [(2, "1", 40, "u", None, "EMAIL", "f@x.org", 0, 7, 0.9), (2, "1", 41, "u", None, "SSN", "223-45-6789", 0, 11, 0.9)]
    rows = pipeline.assembled(spark.createDataFrame(prose + one + two + loose, cols)).collect()
    assert len({r.record_id for r in rows}) == len(rows) == 10
    assert {(r.normalized_value, r.raw_email, r.raw_phone) for r in rows} == {
        ("a@x.org", "a@x.org", None), ("b@x.org", "b@x.org", None), ("555-1", None, "555-1"), ("c@x.org", "c@x.org", None), ("123-45-6789", "c@x.org", None),
        ("d@x.org", "d@x.org", "555-2"), ("e@x.org", "e@x.org", "555-2"), ("555-2", None, "555-2"), ("f@x.org", "f@x.org", None), ("223-45-6789", None, None)}
