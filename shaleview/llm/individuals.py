"""Problem 3: matching contact records of individuals across sources without a key.

Attributes are normalised, blocked by exact tokens and by MinHash bands over the letter pairs of each attribute (combined
with a second attribute where a value is shared by many), compared pair by pair into agreement levels, and scored
by a logistic classifier that is fitted on weak labels: pairs of two independent strong agreements or contradictions,
of which attributes are hidden at random so that the weights also hold for sparse records; half of the pairs are neighbours
by mailbox in a sample of fixed size, so that what is learnt doesn't depend on the size of the table. The scores
are calibrated on labelled pairs kept apart. Individuals are the components of the confident links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .address_parts import parse as parse_address
from .common import components, done, edit_within, read, tables, written
from .names import lexicon, parse_person, turned_names

CONTACT = ["EMAIL", "PHONE_US", "PHONE_INTL", "DATE_OF_BIRTH_MDY", "DATE_OF_BIRTH_DMY"]
TRAINING_PAIRS = 20_000  # the classifier is fitted on at most so many weakly labelled pairs, chosen by hash
SHARED = 0.15  # a mailbox or line of which no person has more than this share of the named records is shared by people
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
LEVELS = {"email": 4, "dob": 4, "phone": 4, "given": 4, "family": 4, "address": 4}  # 0 missing, 1 differs, 2 near, 3 same


def mailbox(s: str | None) -> str:
    """The mailbox of an address in any notation, without tag and letter case; "" if incomplete."""
    s = re.sub(r"^\s*<?\s*(mailto:)?|[>\s]+$", "", (s or "").lower())
    s = re.sub(r"\s*[\[({]?\s*\bat\b\s*[\])}]?\s*|\(at\)|\[at\]", "@", s) if "@" not in s else s
    s = re.sub(r"\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+", ".", s).replace(" ", "")
    m = re.fullmatch(r"([^@+]+)(\+[^@]*)?@([^@]+\.[^@.]+)", s)
    return f"{m[1]}@{m[3]}" if m else ""


def line(s: str | None, country: str | None) -> str:
    """National digits of a phone number without extension, trunk zero and country code; "" if there are too few."""
    s = re.split(r"(?i)\s*(?:x|ext\.?)\s*\d+\s*$", s or "")[0].replace("(0)", "")
    d = re.sub(r"\D", "", s)
    if re.match(r"\s*(\+|00)", re.sub(r"^[^\d+]*", "", s)):
        d = re.sub(r"^(00)?(44|49|1)", "", d)
    elif len(d) == 11 and d[0] == "1":
        d = d[1:]
    d = d.lstrip("0")
    return d if len(d) >= 7 else ""


def birthday(s: str | None, month_first: bool) -> str:
    """YYYYMMDD, or "" if it is no date; two-digit years up to 25 are of this century."""
    s = (s or "").strip().lower()
    if m := re.fullmatch(r"(\d{4})[-/.]?(\d{1,2})[-/.]?(\d{1,2})", s):
        y, a, b = map(int, m.groups())
    elif m := re.fullmatch(r"([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})", s):
        y, a, b = int(m[3]), MONTHS.get(m[1], 0), int(m[2])
    elif m := re.fullmatch(r"(\d{1,2})\.? ([a-z]{3})[a-z]*\.? (\d{4})", s):
        y, a, b = int(m[3]), MONTHS.get(m[2], 0), int(m[1])
    elif m := re.fullmatch(r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})", s):
        x, z, y = int(m[1]), int(m[2]), int(m[3])
        y = y if len(m[3]) == 4 else 2000 + y if y <= 25 else 1900 + y
        a, b = (x, z) if month_first and x <= 12 or z > 12 else (z, x)
    else:
        return ""
    try:
        return date(y, a, b).strftime("%Y%m%d")
    except ValueError:
        return ""


def letter_pairs(c: str) -> Column:
    """Hashes of the letter pairs of a column, with marks for its ends."""
    text = F.concat(F.lit("^"), F.col(c), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.xxhash64(F.substring(text, i, F.lit(2))))


def bands(pairs: str, n: int, rows: int) -> list[Column]:
    """MinHash bands of an array of hashes, each the `rows` least under different masks; null where there are at most the two ends."""
    masks = np.random.default_rng(11).integers(-(2**62), 2**62, n * rows).tolist()
    least = lambda m: F.array_min(F.transform(F.col(pairs), lambda h: h.bitwiseXOR(F.lit(m))))
    return [F.when(F.size(pairs) > 1, F.xxhash64(*[least(m) for m in masks[i * rows : (i + 1) * rows]])) for i in range(n)]


NORMAL = "record_id string, doc string, email string, dob string, phone string, given string, family string, house string, street string, zip string"


def normalised(records: DataFrame, key: str) -> DataFrame:
    """records: with a column `turned` (see turned_names)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nick = lexicon()[0]
        for f in frames:
            f = f.astype(object).where(f.notna(), None)
            out = []
            for k, doc, kind, name, email, dob, phone, country, turned, *address in f.itertuples(index=False):
                p = parse_person(name, bool(turned)) if name else None
                a = parse_address(*address) if address[0] else None
                us = (country or "").upper() in ("US", "PH") if country else kind != "DATE_OF_BIRTH_DMY"
                out.append((k, (doc or "").strip(), mailbox(email), birthday(dob, us), line(phone, country), nick.get(p[1], [p[1]])[0] if p else "", p[0] if p else "",
                            f"{a['number']}/{a['unit']}" if a else "", a["name"] if a else "", a["code"] if a else ""))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in NORMAL.split(", ")])

    cols = [F.col(key).cast("string"), "source_document_id", "entity_type", "raw_name", "raw_email", "raw_dob", "raw_phone", "country", "turned"]
    return records.select(*cols, *[F.col(f"raw_address.{c}") for c in ("street", "city", "state", "zip")], F.col("raw_address.country").alias("address_country")).mapInPandas(run, NORMAL)


def letters_odd(c: str) -> Column:
    """Which of 31 classes of letters occur an odd number of times: one edit or swap changes at most two of these bits."""
    bits = F.transform(F.split(c, ""), lambda x: F.call_function("shiftleft", F.lit(1), (F.ascii(x) % 31).cast("int")))
    return F.aggregate(bits, F.lit(0), lambda a, b: a.bitwiseXOR(b))


def block_keys(profiles: DataFrame) -> DataFrame:
    """Rows (pid, key, f, g): exact tokens and MinHash bands, values shared by many only with a second attribute.

    f and g: letters of surname and given name at keys by birthday or house, which more and more strangers share by chance as
    the data grow; null where they can't tell (an initial, no name) and at other keys. Mailboxes with a slip: see near_mailboxes.

    Every key of an attribute that grows with the data (surnames, birthdays, streets) holds a second and third one, so
    that the profiles of one key are, but for chance, one individual's. A birthday with a slip keeps two of year, month
    and day, or has month and day exchanged; a surname with a slip keeps a band.
    """
    p = profiles.withColumn("g0", F.substring("given", 1, 1))
    p = p.select("*", *[letter_pairs(c).alias(f"_{c}") for c in ("family", "street")])
    has = lambda c: F.col(c) != ""
    key = lambda tag, ok, *c: F.when(ok, F.xxhash64(F.lit(tag), *c))
    fb, sb = bands("_family", 2, 2), bands("_street", 2, 2)
    year, month, day = F.substring("dob", 1, 4), F.substring("dob", 5, 2), F.substring("dob", 7, 2)
    keys = [key("e", has("email") & ~F.col("hot_email"), "email")]
    for c in ("email", "phone"):
        if c == "phone":
            keys.append(key("p", has(c) & ~F.col("hot_phone"), c))
        keys += [key(f"{c}f{i}", has(c) & F.col(f"hot_{c}") & has("family"), c, b, "g0") for i, b in enumerate(fb)] + [key(f"{c}d", has(c) & F.col(f"hot_{c}") & has("dob"), c, "dob")]
    chance = [key(f"d{i}", has("dob") & has("family"), "dob", b) for i, b in enumerate(fb)]
    keys += [key("dg", has("dob") & (F.length("given") > 1), "dob", "given")]
    chance += [key(f"h{i}", (has("house") & has("street")), "house", b, "g0") for i, b in enumerate(sb)]
    named = has("family") & has("given") & has("dob")
    keys += [key("n1", named, "family", "g0", year, month), key("n2", named, "family", "g0", year, day), key("n3", named, "family", "g0", month, day),
             key("n4", named, "family", "g0", year, F.least(month, day), F.greatest(month, day))]
    told = F.length("given") > 1
    rows = lambda ks, f, g: F.transform(F.array_distinct(F.filter(F.array(*ks), lambda k: k.isNotNull())), lambda k: F.struct(k.alias("key"), f.alias("f"), g.alias("g")))
    none = F.lit(None).cast("int")
    return p.select("pid", F.explode(F.concat(rows(keys, none, none), rows(chance, F.when(told, letters_odd("family")), F.when(told, letters_odd("given"))))).alias("k")).select("pid", "k.*")


def near_mailboxes(profiles: DataFrame) -> DataFrame:
    """Pairs (x, y), x < y, of mailboxes of one host that are not shared by people and whose names differ by a slip: one
    letter inserted, dropped or changed, or two neighbours swapped.

    A slip leaves whole the first two thirds of the longer name, the last two thirds, or what stands around the middle third,
    so every pair (of four letters or more) meets under one of these keys, made for its own length and for one more letter;
    what meets is compared at once, so that strangers who share a key never become candidates.
    """
    m = profiles.where((F.col("email") != "") & ~F.col("hot_email")).select("email", F.split("email", "@")[0].alias("local"), F.split("email", "@")[1].alias("host")).distinct()
    keys = []
    for more in (0, 1):
        n = F.length("local") + more
        p = F.floor(n * 2 / 3).cast("int")
        q = n - p - 1
        keys += [F.when(q > 0, F.xxhash64(F.lit(tag), "host", n, *parts)) for tag, parts in (("l", [F.left("local", p)]), ("r", [F.right("local", p)]), ("m", [F.left("local", q), F.right("local", q)]))]
    k = m.select("email", F.explode(F.filter(F.array(*keys), lambda x: x.isNotNull())).alias("key"))
    local = lambda c: F.split(c, "@")[0]
    both = k.alias("l").hint("merge").join(k.alias("r"), F.expr("l.key = r.key and l.email < r.email")).select(F.col("l.email").alias("x"), F.col("r.email").alias("y"))
    return both.where(F.split("x", "@")[1] == F.split("y", "@")[1]).where(near(local("x"), local("y"))).distinct()


def near(a: Column, b: Column) -> Column:
    """One inserted, dropped or changed letter, or two swapped."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    edits = F.levenshtein(a, b, 2)
    return (edits >= 0) & (edits <= 1) | (edits == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b))


def agreement(pairs: DataFrame) -> DataFrame:
    """pairs with a level 0..3 of each attribute (columns a, b, l_* and r_* in, columns of LEVELS out)."""
    side = lambda c: (F.col(f"l_{c}"), F.col(f"r_{c}"))

    def level(c: str, close) -> Column:
        a, b = side(c)
        return F.when((a == "") | (b == ""), 0).when(a == b, 3).when(close(a, b), 2).otherwise(1)

    def dates(a: Column, b: Column) -> Column:
        return (F.levenshtein(a, b, 1) == 1) | (F.substring(a, 1, 4) == F.substring(b, 1, 4)) & (F.substring(a, 5, 2) == F.substring(b, 7, 2)) & (F.substring(a, 7, 2) == F.substring(b, 5, 2))

    def givens(a: Column, b: Column) -> Column:
        short = F.least(F.length(a), F.length(b))
        return F.when(short == 1, F.substring(a, 1, 1) == F.substring(b, 1, 1)).otherwise((short > 3) & near(a, b))

    local, tail = (lambda c: F.split(c, "@")[0]), (lambda c: F.right(c, F.lit(4)))
    shared = lambda c, v: F.when(F.col(f"l_hot_{c}") | F.col(f"r_hot_{c}"), 0).otherwise(v)
    h, s = level("house", lambda a, b: F.lit(False)), level("street", near)
    (lh, rh), part = side("house"), lambda c, i: F.split(c, "/")[i]
    half = (part(lh, 0) == part(rh, 0)) & ((part(lh, 1) == "") | (part(rh, 1) == ""))
    address = F.when((h == 0) | (s == 0), 0).when((h == 3) & (s >= 2), 3).when((s >= 2) & half, 2).otherwise(1)
    out = {"email": shared("email", level("email", lambda a, b: (tail(a) == tail(b)) & near(local(a), local(b)))), "dob": level("dob", dates), "phone": shared("phone", level("phone", near)),
           "given": level("given", givens), "family": level("family", near), "address": address}
    return pairs.select("a", "b", *[out[c].alias(c) for c in LEVELS])


def strangers(profiles: DataFrame) -> DataFrame:
    """Pairs (a, b) of neighbours in the order of their mailboxes, within a sample of profiles by hash.

    They stand for the pairs that agree by chance: as many of them at any size, so that the classifier learns the same from a
    table and from one many times larger.
    """
    some = profiles.where((F.col("email") != "") & ~F.col("hot_email")).orderBy(F.xxhash64(F.lit("s"), "pid")).limit(2 * TRAINING_PAIRS).select("pid", "email")
    after = F.lead("pid").over(Window.orderBy(F.split("email", "@")[1], "email", "pid"))  # of the sample only
    return some.select("pid", after.alias("next")).where("next is not null").select(F.least("pid", "next").alias("a"), F.greatest("pid", "next").alias("b"))


def weak_label() -> Column:
    """1 for two independent strong agreements, 0 for two contradictions, else null."""
    e, d, p, g, f, a = (F.col(c) for c in LEVELS)
    yes = (e == 3) & (d >= 2) & (g != 1) | (e == 3) & (g >= 2) & (f >= 2) & ((d != 1) | (p == 3)) | (d == 3) & (g == 3) & (f >= 2) & ((p == 3) | (a == 3) | (e == 3))
    no = (g == 1) & ((d == 1) | (e != 3) & (d != 3)) | (d == 1) & (e == 1) | (g == 1) & (e == 1) | (f == 1) & (e != 3) & (d != 3)
    return F.when(yes & ~no, 1).when(no & ~yes, 0)


def design(levels: np.ndarray) -> np.ndarray:
    """One-hot levels and a constant."""
    x = [np.ones((len(levels), 1))]
    for i, n in enumerate(LEVELS.values()):
        x.append(np.eye(n)[levels[:, i]][:, 1:])
    name = (levels[:, 3] >= 2) & (levels[:, 4] >= 2)
    # agreement of a whole name tells more than that of its parts, and a contradicted birthday or given name more beside it
    x.append(np.stack([name & (levels[:, 1] == 1) & (levels[:, 0] != 3), (levels[:, 3] == 1) & (levels[:, 4] >= 2), (levels[:, 3] == 3) & (levels[:, 4] == 3), (levels == 0).sum(1) >= 4], 1).astype(float))
    return np.concatenate(x, 1)


def fit(levels: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.5, seed: int = 5) -> tuple[np.ndarray, float, float]:
    """(weights, calibration slope and shift) of a logistic classifier, fitted by Newton steps."""
    rng = np.random.default_rng(seed)
    hold = rng.random(len(y)) < 0.2

    def hidden(m: np.ndarray) -> np.ndarray:
        copies = [m]
        for share in (0.3, 0.5):
            c = m.copy()
            c[rng.random(c.shape) < share * np.array([1, 1, 1, 0.3, 0.3, 1])] = 0
            copies.append(c)
        return np.concatenate(copies)

    def newton(x: np.ndarray, t: np.ndarray, r: float) -> np.ndarray:
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + r * np.eye(len(w)), x.T @ (p - t) + r * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return w

    w = newton(design(hidden(levels[~hold])), np.tile(y[~hold], 3), ridge)
    if not hold.any() or len(set(y[hold].tolist())) < 2:
        return w, 1.0, 0.0
    z = design(hidden(levels[hold])) @ w
    slope = newton(np.stack([z, np.ones_like(z)], 1), np.tile(y[hold], 3), 1e-3)
    return w, float(slope[0]), float(slope[1])


def probability(w: np.ndarray, slope: float, shift: float) -> Column:
    """The calibrated probability of a pair with columns of LEVELS, as an expression; the terms are those of design()."""
    z, at = F.lit(float(w[0])), 1
    for c, n in LEVELS.items():
        steps = F.array(F.lit(0.0), *[F.lit(float(x)) for x in w[at : at + n - 1]])
        z, at = z + F.get(steps, F.col(c)), at + n - 1
    e, d, _, g, f, _ = (F.col(c) for c in LEVELS)
    missing = sum(((F.col(c) == 0).cast("int") for c in LEVELS), F.lit(0))
    extra = [(g >= 2) & (f >= 2) & (d == 1) & (e != 3), (g == 1) & (f >= 2), (g == 3) & (f == 3), missing >= 4]
    for x, v in zip(extra, w[at:]):
        z = z + F.when(x, float(v)).otherwise(0.0)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z * float(slope) + float(shift)))))


def settled(links: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows (node, component): individuals from confident links.

    Links by mailbox or birthday come first. Those by name, line and address alone then join what they
    connect only if the birthdays that most profiles of either side bear agree, and not where a side without a
    birthday is linked to several of different ones: of namesakes at one address it could be either.
    """
    direct = (F.col("email") == 3) | (F.col("dob") >= 2)
    core = written(components(links.where(direct), "a", "b"), "p3-core")
    nodes = profiles.select(F.col("pid").alias("node"), "dob").join(core, "node", "left").withColumn("component", F.coalesce("component", "node"))
    votes = nodes.where("dob <> ''").groupBy("component", "dob").count().groupBy("component").agg(F.max_by("dob", F.struct("count", "dob")).alias("born"))
    comp = written(nodes.join(votes, "component", "left").select("node", "component", F.coalesce("born", F.lit("")).alias("born")), "p3-born")
    end = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"), F.col("born").alias(f"b{c}"))
    rest = links.where(~direct).join(end("a"), "a").join(end("b"), "b").where("ca <> cb").select("ca", "cb", "ba", "bb").distinct()
    agree = (F.col("ba") == "") | (F.col("bb") == "") | edit_within(F.col("ba"), F.col("bb"), 1) | (F.concat(F.substring("ba", 1, 4), F.substring("ba", 7, 2), F.substring("ba", 5, 2)) == F.col("bb"))
    rest = written(rest.where(agree), "p3-rest")
    both = rest.union(rest.select(F.col("cb"), F.col("ca"), F.col("bb"), F.col("ba")))
    torn = both.where("ba = '' and bb <> ''").groupBy("ca").agg(F.min("bb").alias("lo"), F.max("bb").alias("hi")).where(~edit_within(F.col("lo"), F.col("hi"), 1)).select(F.col("ca").alias("x"))
    kept = rest.join(torn, F.col("ca") == F.col("x"), "left_anti").join(torn, F.col("cb") == F.col("x"), "left_anti")
    more = components(kept, "ca", "cb")
    return comp.join(more.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))


def matches(records: DataFrame, key: str = "record_id", threshold: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, profiles): (key, doc, individual, pid) of every contact record, (a, b, confidence) between profiles, and all
    pairs (a, b, confidence) of profiles of one individual, a = b included, whether they were linked or are connected through others.

    Records with none of the attributes are individuals of their own; null keys are left out; a record delivered again counts
    once (the last delivery). Profiles, that is equal normalised records, are compared once.
    """
    spark, since = records.sparkSession, tables()
    r = records.where(F.col("entity_type").isin(CONTACT) & F.col(key).isNotNull())
    kept = [c for c in ("source_document_id", "entity_type", "raw_name", "raw_email", "raw_dob", "raw_phone", "country", "raw_address")]
    r = r.groupBy(key).agg(F.max_by(F.struct(*kept), F.struct("ingested_at", F.xxhash64(*[F.col(c) for c in kept]))).alias("v")).select(key, "v.*")
    r = r.join(turned_names(r.select(F.col("raw_name").alias("name"))).withColumnRenamed("name", "raw_name"), "raw_name", "left")
    n = written(normalised(r, key), "p3-records")
    done(spark, since, "p3-records")
    attributes = ["email", "dob", "phone", "given", "family", "house", "street"]
    n = n.withColumn("pid", F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in attributes]))
    p = n.groupBy("pid").agg(*[F.first(c).alias(c) for c in attributes], F.count("*").alias("records"))
    person = F.concat_ws(" ", F.substring("given", 1, 1), F.soundex("family"))

    def hot(c: str) -> DataFrame:
        """Values shared by people: of their named records no person has a large share. Slips of one name sound alike."""
        each = p.where((F.col(c) != "") & (F.col("family") != "")).groupBy(c, person.alias("who")).agg(F.sum("records").alias("m"))
        return each.groupBy(c).agg(F.max("m").alias("top"), F.sum("m").alias("all")).where(F.col("top") < SHARED * F.col("all")).select(c, F.lit(True).alias(f"hot_{c}"))

    p = p.join(hot("email"), "email", "left").join(hot("phone"), "phone", "left").fillna(False, ["hot_email", "hot_phone"]).drop("records")
    p = written(p, "p3-profiles")
    done(spark, since, "p3-records", "p3-profiles")
    slips = written(near_mailboxes(p), "p3-mailboxes")
    k = written(block_keys(p), "p3-keys")
    # under a key that strangers share, surname or given name must be alike as far as their letters tell
    alike = lambda c: F.coalesce(F.bit_count(F.col(f"l.{c}").bitwiseXOR(F.col(f"r.{c}"))) <= 2, F.lit(True))
    met = k.alias("l").join(k.alias("r"), F.expr("l.key = r.key and l.pid < r.pid")).where(alike("f") | alike("g")).select(F.col("l.pid").alias("a"), F.col("r.pid").alias("b"))
    box = lambda c, m: p.where("not hot_email").select(F.col("email").alias(c), F.col("pid").alias(m))
    slipped = slips.join(box("x", "i"), "x").join(box("y", "j"), "y").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    pairs = written(met.union(slipped).distinct(), "p3-candidates")
    done(spark, since, "p3-records", "p3-profiles", "p3-candidates")
    side = lambda s, c: p.select(F.col("pid").alias(c), *[F.col(x).alias(f"{s}_{x}") for x in p.columns if x != "pid"])
    levels = written(agreement(pairs.join(side("l", "a"), "a").join(side("r", "b"), "b")), "p3-levels")
    done(spark, since, "p3-records", "p3-profiles", "p3-levels")
    half = lambda df: df.withColumn("y", weak_label()).where("y is not null").orderBy(F.xxhash64("a", "b")).limit(TRAINING_PAIRS // 2)
    labelled = half(levels).union(half(agreement(strangers(p).join(side("l", "a"), "a").join(side("r", "b"), "b")).where("email = 1"))).toPandas()
    if labelled["y"].nunique() > 1:
        w, slope, shift = fit(labelled[list(LEVELS)].to_numpy(), labelled["y"].to_numpy(float))
    else:  # nothing to learn from: two agreements more than contradictions
        w, slope, shift = design(np.zeros((1, len(LEVELS)), int))[0] * 0, 1.0, 0.0
        w[0] = -2.5
        w[1 : 1 + 3 * len(LEVELS)] = np.tile([-1.5, 1.0, 2.0], len(LEVELS))
    scored = lambda df: df.withColumn("confidence", probability(w, slope, shift))
    links = written(scored(levels).where(F.col("confidence") >= threshold), "p3-links")
    done(spark, since, "p3-records", "p3-profiles", "p3-links")
    who = written(settled(links, p), "p3-individuals")
    done(spark, since, "p3-records", "p3-profiles", "p3-links", "p3-individuals")
    # equal profiles are one individual only if what they share tells people apart
    has = lambda c: (F.col(c) != "").cast("int")
    telling = p.where((F.col("email") != "") & ~F.col("hot_email") | (has("family") * F.when(F.length("given") > 1, 1).otherwise(0) + has("dob") + F.when(F.col("hot_phone"), 0).otherwise(has("phone")) + has("house") * has("street") >= 2)).select("pid", F.lit(True).alias("telling"))
    members = n.join(telling, "pid", "left").join(who.withColumnRenamed("node", "pid"), "pid", "left").select(
        F.col("record_id").alias(key), "doc", F.when((F.col("component") == F.col("pid")) & F.col("telling").isNull(), F.col("record_id")).otherwise(F.coalesce("component", "pid").cast("string")).alias("individual"), "pid")
    ours = members.select("individual", "pid").distinct()
    within = ours.alias("l").join(ours.alias("r"), F.expr("l.individual = r.individual and l.pid <= r.pid")).select(F.col("l.pid").alias("a"), F.col("r.pid").alias("b"))
    sure = scored(agreement(within.join(side("l", "a"), "a").join(side("r", "b"), "b"))).select("a", "b", "confidence")
    return members, links, sure


def pairs(members: DataFrame) -> DataFrame:
    m = members.alias("l").join(members.alias("r"), F.expr("l.individual = r.individual and l.record_id < r.record_id and l.doc <> r.doc"))
    return m.select(F.col("l.record_id").alias("record_id_a"), F.col("r.record_id").alias("record_id_b"), F.least("l.pid", "r.pid").alias("a"), F.greatest("l.pid", "r.pid").alias("b"))


def p3_found(spark, sf_dir) -> DataFrame:
    m = written(matches(read(spark, sf_dir, "pii_records"))[0], "p3-members")
    return pairs(m).select("record_id_a", "record_id_b")


def p3_matches(spark, sf_dir) -> DataFrame:
    """Every matched pair of records with its confidence."""
    members, _, sure = matches(read(spark, sf_dir, "pii_records"))
    m = written(members, "p3-members")
    return pairs(m).join(written(sure, "p3-sure"), ["a", "b"]).select("record_id_a", "record_id_b", F.round("confidence", 6).alias("confidence"))


def p3_confidence(spark, sf_dir) -> DataFrame:
    """Links between profiles by confidence, to a tenth."""
    links = matches(read(spark, sf_dir, "pii_records"))[1]
    return links.groupBy(F.round("confidence", 1).alias("confidence")).agg(F.count("*").alias("n_links"))


QUERIES = {"p3_found": p3_found, "p3_matches": p3_matches, "p3_confidence": p3_confidence}
SQL: dict = {}
