"""Problem 2: variant spellings of the names of persons and organisations.

A name is parsed into a family part (the surname, or an organisation's own word) and a given part (the given name, or
the line of business). Family parts that differ by a slip are found by a pigeonhole segment join: of a string
cut into k + 1 = 2 segments one survives k = 1 edits, so it is looked up in an inverted index of segments at
the shifted positions that a string one letter shorter or longer puts it; a banded edit distance verifies. Nicknames,
initials, order, titles and legal forms are resolved by lookups and counts over all names; a slip leads to the
spelling that more records bear.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import edit_within, pairs_within, read, written

# What stands where a name is missing, titles, legal forms, nicknames and business abbreviations.
PLACEHOLDERS = {
    "", "unknown", "n a", "na", "none", "null", "nil", "test", "test user", "resident", "current resident", "account holder", "to whom it may concern",
    "occupant", "customer", "name", "anonymous", "john doe", "jane doe", "sir or madam", "not given", "not known", "policy holder", "policyholder",
}
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "madam", "dame", "rev", "herr", "frau", "mx", "jr", "sr", "phd", "md", "esq"}
LEGAL = {"inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "gmbh", "lp", "llp", "the", "and"}
NICKNAMES = {
    "abby": ["abigail"], "alex": ["alexander"], "andy": ["andrew"], "becca": ["rebecca"], "becky": ["rebecca"], "ben": ["benjamin"], "benny": ["benjamin"],
    "beth": ["elizabeth"], "betty": ["elizabeth"], "bill": ["william"], "billy": ["william"], "bob": ["robert"], "bobby": ["robert"], "cathy": ["katherine"],
    "charlie": ["charles"], "chris": ["christopher"], "chuck": ["charles"], "cindy": ["cynthia"], "dan": ["daniel"], "danny": ["daniel"], "dave": ["david"],
    "davey": ["david"], "deb": ["deborah"], "debbie": ["deborah"], "des": ["desmond"], "dick": ["richard"], "dot": ["dorothy"], "dottie": ["dorothy"], "ed": ["edward"],
    "eddie": ["edward"], "ella": ["eleanor"], "fran": ["frances"], "frannie": ["frances"], "fred": ["frederick"], "freddie": ["frederick"], "freddy": ["frederick"],
    "fritz": ["frederick"], "ginny": ["virginia"], "greg": ["gregory"], "gus": ["gustavo"], "gwen": ["gwendolyn"], "hal": ["harold"], "hank": ["henry"],
    "harry": ["harold", "henry"], "izzy": ["isabella"], "jack": ["john"], "jake": ["jacob"], "jen": ["jennifer"], "jenny": ["jennifer"], "jerry": ["gerald"],
    "jim": ["james"], "jimmy": ["james"], "joe": ["joseph"], "joey": ["joseph"], "josie": ["josephine"], "kat": ["katherine"], "kate": ["katherine"],
    "kathy": ["katherine"], "katie": ["katherine"], "ken": ["kenneth"], "kenny": ["kenneth"], "kit": ["christopher"], "larry": ["lawrence"], "len": ["leonard"],
    "lenny": ["leonard"], "lil": ["lillian"], "lily": ["lillian"], "liz": ["elizabeth"], "lizzie": ["elizabeth"], "maggie": ["margaret"], "mandy": ["amanda"],
    "matt": ["matthew"], "meg": ["margaret"], "mick": ["michael"], "mickey": ["michael"], "mike": ["michael"], "nat": ["nathaniel"], "nate": ["nathaniel"],
    "nick": ["nicholas"], "nicky": ["nicholas"], "ollie": ["oliver"], "pat": ["patricia"], "patty": ["patricia"], "peggy": ["margaret"], "penny": ["penelope"],
    "pete": ["peter"], "ray": ["raymond"], "rich": ["richard"], "richie": ["richard"], "rick": ["richard"], "ricky": ["richard"], "rob": ["robert"], "robbie": ["robert"],
    "ron": ["ronald"], "sam": ["samuel"], "sammy": ["samuel"], "steph": ["stephanie"], "steve": ["stephen"], "sue": ["susan"], "susie": ["susan"], "ted": ["theodore"],
    "teddy": ["theodore"], "theo": ["theodore"], "tilda": ["matilda"], "tilly": ["matilda"], "tim": ["timothy"], "timmy": ["timothy"], "tom": ["thomas"],
    "tommy": ["thomas"], "tony": ["anthony"], "trish": ["patricia"], "trisha": ["patricia"], "val": ["valerie"], "vic": ["victor"], "vicky": ["victoria"],
    "wally": ["walter"], "walt": ["walter"], "will": ["william"], "willy": ["william"], "zach": ["zachary"], "zack": ["zachary"], "larri": ["lawrence"],
    "laurie": ["lawrence"], "meggie": ["margaret"], "mina": ["wilhelmina"],
}
BUSINESS = {
    "airways": ["airways"], "airwys": ["airways"], "associates": ["associates"], "assoc": ["associates"], "bank": ["bank"], "bk": ["bank"], "center": ["center"],
    "centre": ["center"], "ctr": ["center"], "credit": ["credit"], "cr": ["credit"], "union": ["union"], "cu": ["credit", "union"], "dental": ["dental"],
    "dentl": ["dental"], "engineering": ["engineering"], "eng": ["engineering"], "engrg": ["engineering"], "food": ["foods"], "foods": ["foods"], "freight": ["freight"],
    "frt": ["freight"], "hospital": ["hospital"], "hosp": ["hospital"], "insurance": ["insurance"], "ins": ["insurance"], "laboratories": ["laboratories"],
    "lab": ["laboratories"], "labs": ["laboratories"], "laboratory": ["laboratories"], "manufacturing": ["manufacturing"], "mfg": ["manufacturing"], "marine": ["marine"],
    "medical": ["medical"], "med": ["medical"], "pharmacy": ["pharmacy"], "pharm": ["pharmacy"], "rx": ["pharmacy"], "properties": ["properties"],
    "props": ["properties"], "prop": ["properties"], "property": ["properties"], "public": ["public"], "pub": ["public"], "savings": ["savings"], "svgs": ["savings"],
    "schools": ["schools"], "schls": ["schools"], "school": ["schools"], "services": ["services"], "svcs": ["services"], "svc": ["services"], "service": ["services"],
    "telecommunications": ["telecommunications"], "telecom": ["telecommunications"], "telco": ["telecommunications"], "textiles": ["textiles"], "textile": ["textiles"],
    "university": ["university"], "univ": ["university"],
}


TURN = 0.1  # by how much more the last word must be a given name than the first for a name to be turned
FAR = 8  # spellings of so many letters may be two slips apart, shorter ones one
MOST = 2 / 3  # an initial stands for the bearer of so large a share of the records that it could stand for
RATIO = 5  # a spelling leads another if it is so many times as well attested


def lexicon() -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    return NICKNAMES, BUSINESS


def near(a: str, b: str) -> bool:
    """Whether a and b differ by one inserted, dropped or changed letter, or by two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    j = next((j for j, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    x, y = len(a) - j - i, len(b) - j - i
    return max(x, y) <= 1 or x == y == 2 and a[i] == b[i + 1] and a[i + 1] == b[i]


@lru_cache(maxsize=200_000)
def business_word(w: str) -> tuple[str, ...]:
    words = lexicon()[1]
    if w in words:
        return tuple(words[w])
    if len(w) >= 4:
        for known, plain in words.items():
            if len(known) >= 5 and near(w, known):
                return tuple(plain)
    return ()


def parse_organisation(name: str) -> tuple[str, str] | None:
    """(own word, line of business), or None for a placeholder or a name without an own word."""
    s = re.sub(r"\b(\w)\.(?=\w\b)", r"\1", name.lower())  # l.l.c.
    words = re.findall(r"[^\W_]+", s)
    if " ".join(words) in PLACEHOLDERS:
        return None
    words = [w for w in words if w not in LEGAL]
    if "of" in words[1:]:
        at = words.index("of", 1)
        words = words[at + 1 :] + words[:at]
    own, line = [], set()
    for i, w in enumerate(words):
        b = business_word(w) if i else ()
        line.update(b)
        if not b:
            own.append(w)
    return ("".join(own), " ".join(sorted(line))) if own and max(map(len, own)) > 2 else None


def parse_person(name: str, turned: bool = False) -> tuple[str, str, str] | None:
    """(surname, given name or initial, initial of the middle name or ""), or None if it names nobody.

    A comma puts the surname first, an initial at the end too. Otherwise the surname is last, or first if `turned`.
    """
    s = name.lower()
    if " ".join(re.findall(r"[^\W_]+", s)) in PLACEHOLDERS:
        return None
    parts = [[w for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", p) if w not in TITLES] for p in s.split(",")]
    parts = [p for p in parts if p]
    if len(parts) >= 2:
        family, rest = "".join(parts[0]), parts[1]
    elif parts and len(parts[0]) >= 2:
        w = parts[0]
        first = len(w[-1]) == 1 or len(w[0]) > 1 and turned
        family, rest = (w[0], w[1:]) if first else (w[-1], w[:-1])
    else:
        return None
    if not rest or len(family) < 2:
        return None
    return family, rest[0], rest[1][0] if len(rest) > 1 else ""


def turned_names(names: DataFrame, rounds: int = 2) -> DataFrame:
    """Rows (name, turned) of distinct names: whether the surname stands first although no comma says so.

    Each word is a given name to the degree that it stands where given names do (after a comma, first, in the middle)
    against where surnames do (before a comma, last, beside an initial), over all names; a slip has the degree of the word it is
    a slip of. A name is turned if its last word is so to a higher degree than its first; what that tells
    of the words is counted again in the next round. Degrees are shares, so they don't depend on the number of names.
    Names with a comma aren't turned; null names are left out.
    """
    word = r"\p{L}+(?:['’]\p{L}+)*"
    parts = F.filter(F.transform(F.split(F.lower("name"), ","), lambda p: F.filter(F.regexp_extract_all(p, F.lit(word), F.lit(0)), lambda w: ~w.isin(*sorted(TITLES)))), lambda p: F.size(p) > 0)
    n = names.where("name is not null").select("name").distinct().withColumn("p", parts)
    n = written(n.select("name", F.size("p").alias("parts"), F.get("p", F.lit(0)).alias("w"), F.coalesce(F.get("p", F.lit(1)), F.array().cast("array<string>")).alias("after")).where("parts > 0"), "name-words")
    first, last = F.get("w", F.lit(0)), F.element_at("w", -1)
    one = (F.col("parts") == 1) & (F.size("w") > 1)
    free = one & (F.length(first) > 1) & (F.length(last) > 1)
    seen = lambda x, g, f: F.struct(x.alias("x"), F.lit(g).alias("g"), F.lit(f).alias("f"))
    inner = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))), lambda x: seen(x, 1, 0))
    comma = F.concat(F.transform("after", lambda x: seen(x, 2, 0)), F.array(seen(first, 0, 2)))
    beside = F.when(F.length(first) == 1, F.array(seen(last, 0, 2))).otherwise(F.array(seen(first, 0, 2)))

    def counted(turned: Column) -> DataFrame:
        order = F.when(turned, F.concat(F.array(seen(first, 0, 1), seen(last, 1, 0)), inner)).otherwise(F.concat(F.array(seen(first, 1, 0), seen(last, 0, 1)), inner))
        told = F.when(F.col("parts") > 1, comma).when(free, order).when(one, F.concat(beside, inner))
        return n.select("*", F.explode(told).alias("s")).select("s.*").where("length(x) > 1").groupBy("x").agg(F.sum("g").alias("g"), F.sum("f").alias("f"))

    nick = lexicon()[0]
    prior = F.when(F.col("x").isin(*sorted(nick.keys() | {x for v in nick.values() for x in v})), 8).otherwise(0)  # fixed values: common given names
    slip = None
    for _ in range(rounds):
        counts = written(counted(F.coalesce(F.col("turned"), F.lit(False)) if "turned" in n.columns else F.lit(False)), "name-counts")
        if slip is None:
            near_ = near_spellings(counts.select(F.col("x").alias("s"), (F.col("g") + F.col("f")).alias("n")), [], None).where((F.col("d") == 1) & (F.col("ny") >= RATIO * F.col("nx")))
            slip = written(near_.groupBy("x").agg(F.max_by("y", F.struct("ny", "y")).alias("t")), "name-slips")
        own = counts.select("x", ((F.col("g") + prior + 0.5) / (F.col("g") + F.col("f") + prior + 1.5)).alias("d"))
        degree = own.join(slip, "x", "left").join(own.select(F.col("x").alias("t"), F.col("d").alias("dt")), "t", "left").select("x", F.coalesce("dt", "d").alias("d"))
        both = n.where(free).select("name", first.alias("x"), last.alias("y")).join(degree.withColumnRenamed("d", "dx"), "x").join(degree.select(F.col("x").alias("y"), F.col("d").alias("dy")), "y")
        yes = both.where(F.col("dy") > F.col("dx") + TURN).select("name", F.lit(True).alias("turned"))
        n = written(n.drop("turned").join(yes, "name", "left"), "name-order")
    return n.select("name", F.coalesce("turned", F.lit(False)).alias("turned"))


PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "name", "family", "given", "middle")])


def parsed(names: DataFrame) -> DataFrame:
    """names: distinct (kind, name, turned), kind PERSON or ORGANIZATION."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for kind, name, turned in zip(f["kind"], f["name"], f["turned"]):
                p = parse_person(name, bool(turned)) if kind == "PERSON" else parse_organisation(name)
                if p:
                    out.append((kind, name, p[0], p[1], p[2] if len(p) > 2 else ""))
            yield pd.DataFrame(out, columns=PARSED.names)

    return names.select("kind", "name", "turned").mapInPandas(run, PARSED)


def segments(n: int, k: int) -> list[tuple[int, int]]:
    return [(j * n // (k + 1), (j + 1) * n // (k + 1)) for j in range(k + 1)]


@lru_cache(maxsize=4096)
def probes(n: int, k: int) -> list[tuple[int, int, int, int]]:
    """(length m of the other string, segment number, start in the own string, size): where a segment of the other may lie."""
    out = []
    for m in range(max(1, n - k), n + k + 1):
        for j, (a, b) in enumerate(segments(m, k)):
            for shift in range(max(-j, n - m - (k - j)), min(j, n - m + (k - j)) + 1):
                if 0 <= a + shift and b + shift <= n:
                    out.append((m, j, a + shift, b - a))
    return out


def swapped(x: str, k: int) -> list[str]:
    """x, and for k = 1 x with the letters at the cut swapped, since a swap there hurts both segments."""
    cut = len(x) // 2
    return [x, x[: cut - 1] + x[cut] + x[cut - 1] + x[cut + 1 :]] if k == 1 else [x]


def segment_pairs(strings: DataFrame, by: list[str], k: int = 1, others: DataFrame | None = None) -> DataFrame:
    """Pairs (x, y) of different strings `s` of one `by` group at an edit distance of at most k (two swapped letters count as one edit if k is 1).

    others: the strings y, if not the same table. The index holds the k + 1 segments of every y with its length and
    the segment's number j; the probe looks up, for every length from n - k to n + k, the substrings of x at those
    shifts that leave at most j edits before the segment and k - j after it.
    """
    s = strings.select(*by, "s").where(f"length(s) > {k + 1}").distinct()
    o = s if others is None else others.select(*by, "s").where(f"length(s) > {k + 1}").distinct()

    @F.pandas_udf("array<string>")
    def own_keys(strings: pd.Series) -> pd.Series:
        return strings.map(lambda x: [f"{j}|{len(x)}|{x[a:b]}" for j, (a, b) in enumerate(segments(len(x), k))])

    @F.pandas_udf("array<string>")
    def probe_keys(strings: pd.Series) -> pd.Series:
        return strings.map(lambda x: list({f"{j}|{m}|{x[i : i + n]}" for x in swapped(x, k) for m, j, i, n in probes(len(x), k)}))

    index = o.select(*by, F.col("s").alias("y"), F.explode(own_keys("s")).alias("key"))
    probe = s.select(*by, F.col("s").alias("x"), F.explode(probe_keys("s")).alias("key"))
    letters = lambda c: F.array_sort(F.split(c, ""))
    ok = edit_within(F.col("x"), F.col("y"), k)
    if k == 1:
        ok = ok | (F.length("x") == F.length("y")) & edit_within(F.col("x"), F.col("y"), 2) & (letters("x") == letters("y"))
    # exploded keys are far larger than the engine's estimate of them: never broadcast
    return probe.hint("merge").join(index, [*by, "key"]).where("x <> y").select(*by, "x", "y").distinct().where(ok)


def near_spellings(counts: DataFrame, by: list[str], far: int | None = FAR) -> DataFrame:
    """Rows (by, x, y, nx, ny, d): spellings s of one `by` group that are d slips apart, with their counts n.

    d is 1 for one edit or two swapped letters, 2 for two edits of strings of `far` letters or more (None: never). One segment
    join serves both: strings up to `far` letters are cut into two segments, those from `far` on into three.
    """
    far = far or 1 << 20
    s = counts.select(*by, "s", "n").where("length(s) > 2")
    ks = lambda n: [k for k, ok in ((1, n <= far), (2, n >= far)) if ok]

    @F.pandas_udf("array<string>")
    def own_keys(strings: pd.Series) -> pd.Series:
        return strings.map(lambda x: [f"{k}|{j}|{len(x)}|{x[a:b]}" for k in ks(len(x)) for j, (a, b) in enumerate(segments(len(x), k))])

    @F.pandas_udf("array<string>")
    def probe_keys(strings: pd.Series) -> pd.Series:
        return strings.map(lambda x: list({f"{k}|{j}|{m}|{z[i : i + n]}" for k in ks(len(x)) for z in swapped(x, k) for m, j, i, n in probes(len(x), k) if k in ks(m)}))

    index = s.select(*by, F.col("s").alias("y"), F.col("n").alias("ny"), F.explode(own_keys("s")).alias("key"))
    probe = s.select(*by, F.col("s").alias("x"), F.col("n").alias("nx"), F.explode(probe_keys("s")).alias("key"))
    letters = lambda c: F.array_sort(F.split(c, ""))
    edits = F.levenshtein("x", "y", 2)
    turned = (F.length("x") == F.length("y")) & (letters("x") == letters("y"))
    d = F.when((edits == 1) | (edits == 2) & turned, 1).when((edits == 2) & (F.least(F.length("x"), F.length("y")) >= far), 2)
    # exploded keys are far larger than the engine's estimate of them: never broadcast
    return probe.hint("merge").join(index, [*by, "key"]).where("x <> y").select(*by, "x", "y", "nx", "ny").distinct().withColumn("d", d).where("d is not null")


def leads(counts: DataFrame, by: list[str], ratio: int = RATIO, far: int = FAR) -> DataFrame:
    """Rows (by, s, t): s is a slip of t, its best attested neighbour, followed on to what leads t.

    A neighbour one slip apart leads if it is `ratio` times as well attested; among spellings of six letters or more, whose
    neighbours are rarely other words, any better attested one leads, and of equals the first in order. Two slips
    are made far more rarely and lie between more words, so they need four times the ratio, or a spelling that stands
    alone beside one that doesn't; with a ratio of 1, for groups in which all spellings mean one thing, any better one leads.
    Counts are compared with each other only, so the rule means the same at any size.
    """
    long = F.least(F.length("x"), F.length("y")) >= 6
    better = (F.col("ny") > F.col("nx")) | (F.col("ny") == F.col("nx")) & (F.col("x") > F.col("y"))
    one_slip = (F.col("d") == 1) & (long | (F.col("ny") >= ratio * F.col("nx")))
    two_slips = (F.col("d") == 2) & (F.lit(ratio == 1) | (F.col("ny") >= 4 * ratio * F.col("nx")) | (F.col("nx") == 1) & (F.col("ny") > 1))
    ok = better & (one_slip | two_slips)
    one = written(near_spellings(counts, by, far).where(ok).groupBy(*by, "x").agg(F.max_by("y", F.struct((-F.col("d")).alias("d"), F.col("ny").alias("n"), F.col("y"))).alias("t")).withColumnRenamed("x", "s"), "leads")
    # each round doubles the steps followed, until none is left: a lead is better attested, so that none leads back
    while True:
        on = one.select(*by, F.col("s").alias("t"), F.col("t").alias("u"))
        two = one.join(on, [*by, "t"], "left")
        if two.where("u is not null").isEmpty():
            return one.select(*by, "s", "t")
        one = written(two.select(*by, "s", F.coalesce("u", "t").alias("t")), "leads")


def entities(records: DataFrame, key: str = "record_id", kind: str = "entity_type", names: tuple[str, ...] = ("raw_name", "normalized_value")) -> DataFrame:
    """Rows (key, entity): every record of type PERSON or ORGANIZATION that names someone, with the id of whom it names.

    Null, blank and placeholder names and single words name nobody and are left out. A repeated record counts once, its
    columns `names` are spellings of one name. An initial joins the only given name of that surname which begins with it; of several,
    the only one whose middle initials allow the record's own, or the one that MOST of their records bear.
    """
    variants = [F.struct(F.lit(i).alias("i"), F.trim(F.regexp_replace(F.col(c), r"(?U)\s+", " ")).alias("name")) for i, c in enumerate(names)]
    rows = records.where(F.col(kind).isin("PERSON", "ORGANIZATION") & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(kind).alias("kind"), F.explode(F.array(*variants)).alias("v")).select("key", "kind", "v.*").where("name <> ''").distinct()
    rows = written(rows, "p2-rows")
    order = turned_names(rows.where("kind = 'PERSON'").select("name"))
    distinct = rows.select("kind", "name").distinct().join(order, "name", "left")
    parts = written(rows.join(parsed(distinct), ["kind", "name"]), "p2-parts")
    person = F.col("kind") == "PERSON"
    # given names: nicknames first, then slips of better attested ones
    nick = lexicon()[0]
    plain = F.create_map(*[F.lit(x) for k, v in nick.items() for x in (k, v[0])])
    protected = sorted(set(nick) | {x for v in nick.values() for x in v})
    full = F.length("given") > 1
    g = parts.where(full & person).groupBy(F.col("given").alias("s")).agg(F.countDistinct("key").alias("n"))
    ratio = near_spellings(g, [], None).where((F.col("d") == 1) & (F.col("ny") >= RATIO * F.col("nx")) & ~F.col("x").isin(protected))
    slips = ratio.groupBy(F.col("x").alias("given")).agg(F.max_by("y", F.struct("ny", "y")).alias("t"))
    parts = parts.join(slips, "given", "left")
    giv = F.when(person & full, F.coalesce(plain[F.coalesce("t", "given")], "t", "given")).otherwise(F.col("given"))
    parts = parts.withColumn("g", giv).drop("t").withColumn("initial", F.when(person, F.substring("g", 1, 1)).otherwise(F.col("g")))
    parts = written(parts.select("key", "kind", "i", "family", "g", "initial", "middle", (full | ~person).alias("full")), "p2-given")
    # family parts: a slip gives way to the better attested spelling of the same given part
    nodes = parts.where("full").groupBy("kind", "g", F.col("family").alias("s")).agg(F.countDistinct("key").alias("n"))
    better = leads(nodes, ["kind", "g"]).select("kind", "g", F.col("s").alias("family"), F.col("t").alias("better"))
    whole = written(parts.where("full").join(better, ["kind", "g", "family"], "left").withColumn("home", F.coalesce("better", "family")).drop("better"), "p2-whole")
    who = lambda: F.concat_ws("|", "kind", "home", "g")
    # initials: the only bearer of the surname (or, without one, of a neighbouring spelling) whose name begins so
    lone = parts.where("not full")
    bearers = whole.where("kind = 'PERSON'").groupBy(F.col("home").alias("family"), "initial", who().alias("entity")).agg(F.collect_set(F.nullif("middle", F.lit(""))).alias("middles"), F.countDistinct("key").alias("records"))
    lone_keys = lone.select("family", "initial", "middle").distinct()

    def only(cand: DataFrame, most: bool) -> DataFrame:
        may = (F.col("middle") == "") | (F.size("middles") == 0) | F.array_contains("middles", F.col("middle"))
        c = cand.groupBy("family", "initial", "middle").agg(
            F.count_distinct(F.when(may, F.col("entity"))).alias("np"), F.max_by(F.when(may, F.col("entity")), F.when(may, F.struct("records", "entity"))).alias("top"),
            F.max(F.when(may, F.col("records"))).alias("most"), F.sum(F.when(may, F.col("records"))).alias("all"),
            F.count_distinct("entity").alias("n"), F.min("entity").alias("one"),
            F.count_distinct(F.when(F.array_contains("middles", F.col("middle")), F.col("entity"))).alias("nm"), F.min(F.when(F.array_contains("middles", F.col("middle")), F.col("entity"))).alias("onem"))
        return c.select("family", "initial", "middle", F.lit(True).alias("met"), F.when(F.col("n") == 1, F.col("one")).when(F.col("nm") == 1, F.col("onem")).when((F.col("np") == 1) | F.lit(most) & (F.col("most") >= MOST * F.col("all")), F.col("top")).alias("entity"))

    exact = only(lone_keys.join(bearers, ["family", "initial"]), True)
    rest = lone_keys.join(exact, ["family", "initial", "middle"], "left_anti")
    strings = bearers.select("initial", F.col("family").alias("s")).union(rest.select("initial", F.col("family").alias("s")))
    shifted = segment_pairs(strings, ["initial"]).select("initial", F.col("x").alias("family"), F.col("y").alias("home"))
    close = only(rest.join(shifted, ["family", "initial"]).join(bearers.select(F.col("family").alias("home"), "initial", "entity", "middles", "records"), ["home", "initial"]), False)
    resolved = written(exact.union(close), "p2-initials")
    lone = lone.join(resolved, ["family", "initial", "middle"], "left").withColumn(
        "entity", F.when(F.col("met"), F.coalesce("entity", F.concat_ws("|", F.lit("?"), "key"))).otherwise(F.concat_ws("|", "kind", "family", "initial")))
    every = whole.select("key", "i", who().alias("entity")).union(lone.select("key", "i", "entity"))
    size = every.groupBy("entity").agg(F.countDistinct("key").alias("size"))
    return every.join(size, "entity").groupBy("key").agg(F.max_by("entity", F.struct("size", -F.col("i"), "entity")).alias("entity")).withColumnRenamed("key", key)


def p2_found(spark, sf_dir) -> DataFrame:
    found = written(entities(read(spark, sf_dir, "pii_records")), "p2-entities")
    return pairs_within(found, "record_id", "entity", "record_id_a", "record_id_b")


def p2_spellings(spark, sf_dir) -> DataFrame:
    """How many records name each entity that two or more records name."""
    return entities(read(spark, sf_dir, "pii_records")).groupBy("entity").agg(F.count("*").alias("n_records")).where("n_records > 1")


QUERIES = {"p2_found": p2_found, "p2_spellings": p2_spellings}
SQL: dict = {}
