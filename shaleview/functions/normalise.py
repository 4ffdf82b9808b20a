"""Normal forms of mailboxes, names, phone numbers, dates of birth and addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .text import C, col, python_title, strip

# fixed values: names and abbreviations of the states
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL",
    "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME",
    "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE",
    "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH",
    "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX",
    "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}
POSTAL = {"US": r"\b(\d{5})(?:-\d{4})?\b", "GB": r"(?i)\b([A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2})\b", "IN": r"\b([1-9]\d{5})\b", "CA": r"(?i)\b([A-Z]\d[A-Z]\s*\d[A-Z]\d)\b", "AU": r"\b(\d{4})\b"}  # fixed values


def email(c: C) -> Column:
    """Trimmed, lower-case; dots of the local part don't count at gmail and googlemail."""
    v = F.lower(strip(c))
    at = F.instr(v, "@")
    local, domain = F.substring(v, F.lit(1), at - 1), F.substring(v, at + 1, F.length(v))
    return F.when(at == 0, v).when(domain.isin("gmail.com", "googlemail.com"), F.concat(F.replace(local, F.lit("."), F.lit("")), F.lit("@"), domain)).otherwise(v)


def western_reversed(c: C) -> Column:
    """Whether it is "Last, First": one comma, two Latin parts without digits that are no places."""
    v = col(c)
    parts = F.transform(F.split(v, ","), lambda x: strip(x))
    good = F.forall(parts, lambda x: (x != "") & ~x.rlike(r"(?U)\d") & ~x.rlike(V.NON_LATIN) & ~F.lower(x).isin(V.PLACES))
    return (F.size(F.split(v, ",")) == 2) & good


def name(c: C, reverse: bool = True) -> Column:
    v = F.regexp_replace(strip(c), r"(?U)\s+", " ")
    bare = F.regexp_replace(v, V.HONORIFICS, "")
    first, last = strip(F.split(bare, ",").getItem(1)), strip(F.split(bare, ",").getItem(0))
    turned = F.concat(F.regexp_replace(F.concat(first, F.lit(" ")), V.HONORIFICS, ""), last) if reverse else bare
    turned = F.when(western_reversed(bare), turned).otherwise(bare)
    return F.when(v.rlike(V.NON_LATIN), v).otherwise(python_title(F.regexp_replace(strip(turned), r"(?U)\s+", " ")))


def dob(c: C, country: C) -> Column:
    """ISO date, or null if it is none; month first in the US and the Philippines, two-digit years below 30 are of this century."""
    v = strip(c)
    d = lambda text, form: F.date_format(F.try_to_timestamp(text, F.lit(form)), "yyyy-MM-dd")
    p = F.split(F.regexp_replace(v, r"[-./]", "/"), "/")
    a, b, y = (strip(p.getItem(i)) for i in range(3))
    numeric = (F.size(p) == 3) & a.rlike(r"^\d{1,4}$") & b.rlike(r"^\d{1,2}$") & y.rlike(r"^\d{1,4}$")
    month, day = (F.when(F.upper(col(country)).isin("US", "PH"), x).otherwise(z) for x, z in ((a, b), (b, a)))
    number = y.cast("int")
    year = F.when(F.length(y) == 2, F.when(number < 30, number + 2000).otherwise(number + 1900)).otherwise(number)
    iso = lambda yy, mm, dd: d(F.concat_ws("-", F.lpad(yy.cast("string"), 4, "0"), F.lpad(mm, 2, "0"), F.lpad(dd, 2, "0")), "yyyy-MM-dd")
    return F.coalesce(
        F.when(v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), d(v, "yyyy-M-d")),
        F.when(v.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), d(F.initcap(F.lower(v)), "d MMM yyyy")), F.when(v.rlike(r"^\d{1,2} [A-Za-z]{4,} \d{4}$"), d(F.initcap(F.lower(v)), "d MMMM yyyy")),
        F.when(v.rlike(r"^[A-Za-z]{3} \d{1,2}, \d{4}$"), d(F.initcap(F.lower(v)), "MMM d, yyyy")), F.when(v.rlike(r"^[A-Za-z]{4,} \d{1,2}, \d{4}$"), d(F.initcap(F.lower(v)), "MMMM d, yyyy")),
        F.when(numeric & (F.length(a) == 4), iso(a, b, y)), F.when(numeric & (F.length(a) <= 2), iso(year, month, day)))


def phone(c: C, region: str = "US") -> Column:
    """E.164 of North American, Indian, British and +international numbers; null if it can't be one."""
    v = F.regexp_replace(col(c), r"(?i)\s*(?:x|ext\.?)\s*\d+\s*$", "")
    plus = strip(v).rlike(r"^(\+|00)")
    d = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\(0\)", ""), r"^\s*00", "+"), r"\D", "")
    home = {"US": ("1", r"^1?([2-9]\d{2}[2-9]\d{6})$"), "CA": ("1", r"^1?([2-9]\d{2}[2-9]\d{6})$"), "IN": ("91", r"^(?:91|0)?([6-9]\d{9})$"), "GB": ("44", r"^0?([1-9]\d{8,9})$"), "DE": ("49", r"^0?([1-9]\d{6,11})$")}  # fixed values
    code, form = home.get(region, home["US"])
    own = F.regexp_extract(d, form, 1)
    nanp = ~d.startswith("1") | d.rlike(r"^1[2-9]\d{2}[2-9]\d{6}$")
    return F.when(plus & d.rlike(r"^[1-9]\d{6,14}$") & nanp, F.concat(F.lit("+"), d)).when(~plus & (own != ""), F.concat(F.lit("+" + code), own))


def country_of(c: C) -> Column:
    """ISO code told by country words, postal codes, US state names and abbreviations, in this order; null if by none."""
    v = col(c)
    out = None
    for pattern, code in V.COUNTRY_WORDS:
        out = F.when(v.rlike(pattern), code) if out is None else out.when(v.rlike(pattern), code)
    names = "|".join(sorted(STATES, key=len, reverse=True))
    return out.when(v.rlike(POSTAL["GB"]), "GB").when(v.rlike(POSTAL["IN"]), "IN").when(v.rlike(POSTAL["CA"]), "CA").when(v.rlike(rf"(?i)\b(?:{names})\b"), "US").when(
        v.rlike(rf"\b(?:{'|'.join(sorted(set(STATES.values())))})\b"), "US").when(v.rlike(POSTAL["US"]), "US")


def address(c: C) -> Column:
    """struct<street, city, state, zip, country>, or null without a street number and a postal code.

    What stands before the postal code is cut into state (at its end, a name or two letters in any case, in the US only), street and city.
    """
    v = strip(c)
    country = F.coalesce(country_of(v), F.lit("US"))
    kinds = {k: p for k, p in POSTAL.items() if k != "US"}
    pick = lambda of: F.coalesce(*[F.when(country == k, of(p)) for k, p in kinds.items()], of(POSTAL["US"]))
    code = pick(lambda p: F.regexp_extract(v, p, 1))
    # the text before the first code: the pattern is anchored behind the shortest beginning
    flags = lambda p: (p.removeprefix("(?i)"), "(?i)" if p.startswith("(?i)") else "")
    before = pick(lambda p: F.regexp_extract(v, f"(?s){flags(p)[1]}^(.*?){flags(p)[0]}", 1))
    has = code != ""
    text = F.when(has, F.regexp_replace(before, r"[, ]+$", "")).otherwise(v)
    names = "|".join(sorted(STATES, key=len, reverse=True))
    end = rf"(?i)(?:^|[,\s]+)({names})\s*$"
    short = rf"(?i)(?:^|[,\s]+)({'|'.join(sorted(set(STATES.values())))})\s*$"
    by_name, by_letters = F.lower(F.regexp_extract(text, end, 1)), F.upper(F.regexp_extract(text, short, 1))
    table = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    us = country == "US"
    state = F.when(us & (by_name != ""), table[by_name]).when(us & (by_letters != ""), by_letters)
    rest = F.when(us & (by_name != ""), F.regexp_replace(text, end, "")).when(us & (by_letters != ""), F.regexp_replace(text, short, "")).otherwise(text)
    parts = F.filter(F.transform(F.split(rest, ","), lambda x: F.lower(strip(x))), lambda x: x != "")
    zip_ = F.when(country.isin("GB", "CA", "US"), F.upper(F.replace(code, F.lit(" "), F.lit("")))).otherwise(code)
    return F.when(v.rlike(r"\b\d+\s+\w") | has, F.struct(F.get(parts, F.lit(0)).alias("street"), F.get(parts, F.lit(1)).alias("city"), state.alias("state"), F.nullif(zip_, F.lit("")).alias("zip"), country.alias("country")))
