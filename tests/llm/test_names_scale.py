from shaleview.llm import names


def test_leads_are_followed_to_their_end(spark):
    """Spellings of one chain came to different ends beyond three steps."""
    chain = ["kelmarstow", "zelmarstow", "zalmarstow", "zabmarstow", "zabparstow", "zabperstow"]
    d = spark.createDataFrame([("g", s, i + 2) for i, s in enumerate(chain)], "g string, s string, n int")
    assert {(r.s, r.t) for r in names.leads(d, ["g"]).collect()} == {(s, chain[-1]) for s in chain[:-1]}


def test_initials_of_several_bearers(spark):
    """The larger the table, the more surnames have two bearers of one initial."""
    rows = [(f"a{i}", "Esther Keldismond") for i in range(4)] + [("b", "Elif Keldismond"), ("c", "E. Keldismond"), ("d", "E. Keldismond")]
    rows += [("h1", "Harriet R. Oppingtun"), ("h2", "Hugo Oppingtun"), ("h3", "H. C. Oppingtun"), ("h4", "H. Oppingtun")]
    d = spark.createDataFrame([(k, "PERSON", n, None) for k, n in rows], "record_id string, entity_type string, raw_name string, normalized_value string")
    e = {r[0]: r[1] for r in names.entities(d).collect()}
    assert e["a0"] == e["a3"] == e["c"] == e["d"] != e["b"]
    assert e["h3"] == e["h2"] != e["h1"] and e["h4"] not in (e["h1"], e["h2"])  # either could be meant
