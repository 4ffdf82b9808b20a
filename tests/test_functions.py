import pytest
from pyspark.sql import functions as F

from shaleview.functions import normalise as N
from shaleview.functions import text as X
from shaleview.functions.similarity import jaro_winkler_score, same_address, same_name, soundex


def one(spark, expr, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("value", "first", "last", "want"), [("abcdefgh", 2, 2, "ab****gh"), ("abcd", 2, 2, "****"), ("", 2, 2, ""), (None, 2, 2, None), ("123456789", 0, 4, "*****6789")])
def test_mask_ends(spark, value, first, last, want):
    assert one(spark, X.mask_ends("c0", first, last), value) == want


def test_masks(spark):
    assert one(spark, X.mask_phone("c0"), "(206) 555-3618") == "***-***-3618"
    assert one(spark, X.mask_phone("c0"), "12") == "***"
    assert one(spark, X.mask_email("c0"), None) == ""
    assert one(spark, X.mask_outbound("c0"), "ssn 123-45-6789 mail a.b@c.org") == "ssn [SSN] mail [EMAIL]"
    assert "[REDACTED]" in one(spark, X.scrub_log("c0"), "raw_value=abc, x")
    assert one(spark, X.luhn("c0"), "4111 1111 1111 1111") is True
    assert one(spark, X.luhn("c0"), "") is False


def test_encryption_round_trip(spark):
    key = "0123456789abcdef"
    assert one(spark, X.decrypted(X.encrypted("c0", key), key), "Zoë 123") == "Zoë 123"


@pytest.mark.parametrize(("value", "want"), [("o'BRIEN", "O'Brien"), ("smith-jones", "Smith-Jones"), ("", ""), ("mcdonald 3rd", "Mcdonald 3Rd")])
def test_python_title(spark, value, want):
    assert one(spark, X.python_title("c0"), value) == want == value.title()


@pytest.mark.parametrize(("value", "want"), [(" J.Doe@Gmail.com ", "jdoe@gmail.com"), ("a.b@x.org", "a.b@x.org"), ("none", "none"), (None, None)])
def test_email(spark, value, want):
    assert one(spark, N.email("c0"), value) == want


@pytest.mark.parametrize(("value", "want"), [("Dr. SMITH, john", "John Smith"), ("Mumbai, India", "Mumbai, India"), ("mrs  anne   lee", "Anne Lee"), ("", ""), ("王 小明", "王 小明")])
def test_name(spark, value, want):
    assert one(spark, N.name("c0"), value) == want


@pytest.mark.parametrize(("value", "country", "want"), [
    ("01/15/1990", "US", "1990-01-15"), ("15/01/1990", "GB", "1990-01-15"), ("15 Jan 1990", "US", "1990-01-15"), ("January 15, 1990", "US", "1990-01-15"), ("1990-01-15", "DE", "1990-01-15"),
    ("1/2/29", "US", "2029-01-02"), ("1/2/30", "US", "1930-01-02"), ("13/13/1990", "US", None), ("31/01/1990", "US", None), ("", "US", None), (None, "US", None)])
def test_dob(spark, value, country, want):
    assert one(spark, N.dob("c0", "c1"), value, country) == want


@pytest.mark.parametrize(("value", "want"), [("(206) 555-3618", "+12065553618"), ("+44 20 7946 0958", "+442079460958"), ("0044 20 7946 0958", "+442079460958"), ("12", None), (None, None)])
def test_phone(spark, value, want):
    assert one(spark, N.phone("c0"), value) == want


def test_address(spark):
    a = one(spark, N.address("c0"), "12 High St, Leeds, LS1 4AP, England")
    assert (a.street, a.city, a.zip, a.country) == ("12 high st", "leeds", "LS14AP", "GB")
    assert one(spark, N.address("c0"), "no number here") is None
    assert one(spark, N.country_of("c0"), "Austin, Texas") == "US"


@pytest.mark.parametrize(("value", "want"), [("Robert", "R163"), ("Rupert", "R163"), ("Ashcraft", "A226"), ("123", "0000"), ("Lee", "L000")])
def test_soundex(spark, value, want):
    assert one(spark, soundex("c0"), value) == want


def test_similarity(spark):
    assert jaro_winkler_score("MARTHA", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler_score("", "x") == 0.0
    assert one(spark, same_name("c0", "c1"), "Jon Smith", "John Smith") is True
    assert one(spark, same_name("c0", "c1"), "Jon Smith", "Mary Jones") is False
    a = F.struct(F.lit("1 Main St").alias("street"), F.lit("12345").alias("zip"), F.lit("US").alias("country"))
    b = F.struct(F.lit("1 Main Street").alias("street"), F.lit("12345").alias("zip"), F.lit("GB").alias("country"))
    assert one(spark, same_address(a, a), "x") is True
    assert one(spark, same_address(a, b), "x") is False


def test_substitute(spark):
    assert one(spark, X.safe_substitute("Dear $name, ${who} $$5", {"name": F.col("c0")}), "Ann") == "Dear Ann, ${who} $5"


@pytest.mark.parametrize(("given", "want"), [
    ("123 Main St, Springfield, Illinois 62704", ("123 main st", "springfield", "IL", "62704", "US")), ("123 Main St Springfield il 62704", ("123 main st springfield", None, "IL", "62704", "US")),
    ("62704", (None, None, None, "62704", "US")), ("5 Elm Rd, Austin, New York 10001-1234", ("5 elm rd", "austin", "NY", "10001", "US")), ("10 Downing Street, London, SW1A 2AA", ("10 downing street", "london", None, "SW1A2AA", "GB")),
    ("no address here", None), ("12 Hill Road", ("12 hill road", None, None, None, "US")), ("", None)])
def test_addresses_are_cut_at_the_code(spark, given, want):
    got = one(spark, N.address("c0"), given)
    assert (None if got is None else tuple(got)) == want


@pytest.mark.parametrize(("a", "b", "want"), [
    (("1 Elm St", "1", "US"), ("1 ELM ST", "1", "US"), 0.9), (("1 Elm Street", "1", None), ("1 Elm Streat", "1", "US"), 0.75), ((None, "1 2", "US"), ("1 Elm St", "12", "US"), 0.6),
    (("1 Elm St", "1", "US"), ("9 Oak Ave", "1", "US"), 0.0), (("1 Elm St", "1", "US"), ("1 Elm St", "1", "GB"), 0.0), (("1 Elm St", None, "US"), ("1 Elm St", None, "US"), 0.0)])
def test_graded_addresses(spark, a, b, want):
    from shaleview.functions.similarity import address_match

    d = spark.createDataFrame([(a, b)], "a struct<street:string,zip:string,country:string>, b struct<street:string,zip:string,country:string>")
    assert d.select(address_match("a", "b").alias("x")).first().x == want


def test_graded_ids_dates_and_names(spark):
    from shaleview.functions.similarity import birthday_match, government_match, likely_same_person

    gov = lambda *v: one(spark, government_match("c0", "c1", "c2", "c3"), *v)
    assert gov("SSN", "123", "ssn", " 123 ") == 0.95 and gov("SSN", "123", "SSN", "124") == 0.75 and gov("SSN", "123", "SSN", "1233") == 0.75 and gov("SSN", "123", "SSN", "145") == 0.0 and gov("SSN", "123", "PAN", "123") == 0.0
    born = lambda *v: one(spark, birthday_match("c0", "c1", "c2", "c3"), *v)
    assert born("03/04/1990", "US", "1990-03-04", "GB") == 0.95 and born("03/04/1990", "US", "03/04/1990", "GB") == 0.0 and born("x", "US", "x", "US") == 0.0
    assert one(spark, likely_same_person("c0", "c1"), "Ann Lee", "Anne Lee") and not one(spark, likely_same_person("c0", "c1"), "Ann Lee", "Bo Xi")
