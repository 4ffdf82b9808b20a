"""Problem 4: personal values in free text, found and replaced with typed placeholders.

Terms are weighed by what they disclose. One pass over the corpus counts how often each word, word ending and cue occurs beside
protected entities (a name after a salutation, a role, an initial or a known given name; a number of a form that only
government numbers have) and how often elsewhere; the pointwise mutual information with the protected class is
the term's disclosure. Terms above the threshold are generalised to a placeholder: surnames of up to five letters by their own
disclosure, longer ones by that of their ending, numbers of an ambiguous form by that of the word before them. Values whose form
alone tells them (mailboxes, phone numbers, street addresses) need no statistics.

Counts are aggregated to one row a term in a table, and no count is dropped for being rare. The terms above the
threshold are broadcast up to MODEL_TERMS of them; beyond that each text is joined with those of them that stand in it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .address_parts import KINDS, UNITS
from .common import read, spread, written
from .names import lexicon

MODEL_TERMS = 1_000_000  # at most so many terms, of about a hundred bytes each, are broadcast
DISCLOSURE = 1.0  # bits of pointwise mutual information with the protected class from which a term is taken to disclose
MIN_GIVEN = 3  # protected contexts that a word needs to be taken for a given name
# Words before a name, words after a firm's own name, words before a number that is no personal one.
CUES = ["patient", "claimant", "member", "student", "tenant", "signed,", "dear", "hi", "hello", "cc:", "attn", "chair:", "present:", "apologies:", "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "dr", "dr.", "prof", "prof.", "regards,", "name:", "spouse", "solicitor", "carer"]
TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Madam|Herr|Frau)"
TITLED = re.compile(TITLE + r"\.?[ \t]+$")
FIRM = r"(?:Foods?|Manufacturing|Insurance|Hospital|Savings|Medical|Marine|University|Lab\w*|Pharm\w*|Airw\w*|Textiles?|Freight|Dental|Eng\w*|Assoc\w*|Propert\w*|Public|Credit|Telecom\w*|Bank|Services|Schools|Ltd|LLC|Inc|Corp|Company|Group|Center|Centre|Union)"
PLAIN_NUMBERS = re.compile(r"(?i)\b(?:invoice|order|ticket|ref|reference|batch|version|serial|tracking|lot|po|rechnung|facture|factura|case|code|shipment)\b[^\w]{0,3}(?:(?:no|nr|number|id)\b\.?)?[^\w]{0,3}$")
MONTHS = set("january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec monday tuesday wednesday thursday friday saturday sunday".split())

EMAIL = re.compile(r"(?<![\w.+-])[\w][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
SPELT_EMAIL = re.compile(
    r"(?<![\w.+-])[\w][\w.+-]*\s?[(\[]\s?at\s?[)\]]\s?[A-Za-z0-9-]+(?:\s?[(\[]\s?dot\s?[)\]]\s?[A-Za-z0-9-]+|\sdot\s[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+"
    r"|(?<![\w.+-])[\w][\w.+-]*\sat\s[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:\s?[(\[]?\s?\bdot\b\s?[)\]]?\s?[A-Za-z0-9-]+)+", re.I)  # fmt: skip
SPELT = re.compile(r"[(\[]\s?at\s?[)\]]|\sat\s(?=[^\n]{0,80}dot)", re.I)  # what a spelt mailbox has, found far faster
PHONE = re.compile(
    r"(?<![\w.,/#+$€£-])(?:"
    r"(?:\+|00)\d{2,3}[ .-]?(?:\(0\)[ .-]?)?\d{2,4}(?:[ ./-]?\d{2,7}){1,4}"
    r"|(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ ./-]?)\d{3}[ .-]?\d{4}"
    r"|0\d{2,4}[ /.-]?\d{3,4}[ .-]?\d{3,4}|0\d{2,4}[ /-]\d{5,8}"
    r")(?![\w]|[./-]\d)")  # fmt: skip
ID = re.compile(
    r"(?<![\w./#+$€£-])(?:\d{3}([-. ])\d{2}\1\d{4}|\d{4}([-. ])\d{4}\2\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{5}\d{4}[A-Z]|[A-Z]\d{7}[A-Z]?|\d{9}|\d{12})(?![\w]|[./-]\d)")
ID_CUE = re.compile(r"(?i)(?:number|id|identity|passport|ssn|nino|aadhaar|\bpan\b|tax|card|licen[cs]e|national|government|social)\b[^\n]{0,24}$")
NUMBER_CUE_NEEDED = re.compile(r"^(?:\d{9}|\d{12}|[A-Z]\d{7}[A-Z]?)$")
_KIND = "|".join(sorted((k for k in KINDS if k != "st" and len(k) > 1), key=len, reverse=True)) + "|st"
_DIR = r"(?:(?:north|south|east|west|no|so|ea|we|n|s|e|w|ne|nw|se|sw)\b\.?\s+)"
_UNIT = r"(?:(?:apt|apartment|unit|ste|suite|flat|whg|wohnung|we|no|nr)\b\.?\s*(?:no\.?|nr\.?)?\s*#?\s*\d*\s?[a-z]?\d*|#\s?\d+[a-z]?)"
ADDRESS = re.compile(
    rf"(?<![\w.,/#-])(?:(?:apt|apartment|unit|ste|suite|flat)\b\.?\s+(?:no\.?\s*)?\d*[a-z]?\b,?\s+|#\s?\d+[a-z]?,?\s+)?\d{{1,5}}[a-z]?,?\s+{_DIR}?(?:[^\W\d_][\w'’-]*\s+){{1,2}}?(?:{_KIND})\b(?!\s+(?:of|for|from)\b)", re.I)
JOINED_STREET = re.compile(r"(?<![\w-])[^\W\d_][^\W\d_]{2,}-?(?:stra(?:ss|ß)e|str\.)\s+(?:nr\.?\s*)?\d{1,5}\b", re.I)
JOINED = re.compile(r"stra(?:ss|ß)e|str\.", re.I)  # what the above has, found far faster
DIGIT = re.compile(r"\d")
ADDRESS_NO_KIND = re.compile(
    rf"(?<![\w.,/#-])(?:(?:apt|apartment|unit|ste|suite|flat)\b\.?\s+(?:no\.?\s*)?\d*[a-z]?\b,?\s+|#\s?\d+[a-z]?,?\s+)?\d{{1,5}}\s+{_DIR}?[A-Z][a-z]{{3,}}(?:,?\s+{_UNIT})?,\s+[A-Z][a-z]+,?\s+(?:[A-Z]{{2}}\s+\d{{4,5}}\b|[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s?\d[A-Z]{{2}}\b)")
NUMBER = re.compile(r"(?<![\w./#+$€£-])[A-Z]{0,5} ?\d[\d .-]{4,17}[A-Z]?(?![\w])")
TOKEN = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]{2,})*")
WIDE = {i: i - 0xFEE0 for i in range(0xFF01, 0xFF5F)} | {0xA0: 32, 0x2007: 32, 0x202F: 32}


def ending(word: str) -> str:
    """What stands for a surname: its last four letters, or the whole word if it has no more than five."""
    return word[-4:].lower() if len(word) > 5 else "=" + word.lower()


def cue_before(text: str, at: int) -> str:
    """The last word within 24 characters before a place, in lower case."""
    words = TOKEN.findall(text[max(0, at - 24) : at].split("\n")[-1])
    return words[-1].lower() if words else ""


def contexts(text: str) -> Counter:
    """Counts by (kind, key): N occurrences of a capitalised word, S of them after a cue, B a word before one of an ending, T an ending after a word of place, C a word beside another capitalised one, J a cue before a number, I one before a number that only governments give."""
    out: Counter = Counter()
    text = text if text.isascii() else text.translate(WIDE)
    tokens = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text)]
    for i, (w, a, b) in enumerate(tokens):
        if not w[0].isupper() or len(w) < 2:
            continue
        key = w.lower()
        out["N", key] += 1
        before = text[max(0, a - 14) : a]
        last = before.rstrip(" \t").rsplit(None, 1)[-1:] if before[-1:] in (" ", "\n", "") else []
        cue = last[0].lower() if last else ""
        after = tokens[i + 1] if i + 1 < len(tokens) else None
        comma = after is not None and text[b : after[1]] == ", " and after[0][0].isupper()
        if cue in CUES and not comma:
            out["S", key] += 1
        ahead = tokens[i - 1] if i else None
        if comma or ahead and ahead[0][0].isupper() and re.fullmatch(r"\.?[ \t]", text[ahead[2] : a]):
            out["C", key] += 1
        firm = after is not None and re.match(FIRM + r"\b", after[0]) is not None and text[b : after[1]].strip() == ""
        if not firm:
            prev = tokens[i - 1] if i else None
            if prev and len(prev[0]) == 1 and i > 1 and text[prev[2] : a] in (" ", ". ", "."):
                prev = tokens[i - 2] if text[tokens[i - 2][2] : prev[1]] == " " else prev
            if prev and prev[0][0].isupper() and len(prev[0]) > 1 and re.fullmatch(r" |\s[A-Z]\.? ", text[prev[2] : a]):
                out["B", f"{prev[0].lower()}|{ending(w)}"] += 1
            if cue in ("in", "at", "from", "nach", "à", "en", "of", "near"):
                out["T", ending(w)] += 1
    for m in NUMBER.finditer(text) if DIGIT.search(text) else ():
        if cue := cue_before(text, m.start()):
            out["J", cue] += 1
            own = ID.match(text, m.start())
            if own and not NUMBER_CUE_NEEDED.match(own[0]) and not PLAIN_NUMBERS.search(text[max(0, m.start() - 40) : m.start()]):
                out["I", cue] += 1
    return out


class Model:
    """Terms that disclose: given names, endings of surnames (sure and loose), common words, cues of numbers."""

    def __init__(self, terms: list[tuple[str, str]]):
        by: dict[str, set[str]] = {}
        for kind, key in terms:
            by.setdefault(kind, set()).add(key)
        self.given, self.sure, self.loose, self.common, self.cues = (by.get(k, set()) for k in ("given", "sure", "loose", "common", "cue"))

    def surname(self, word: str, sure: bool = True) -> bool:
        return len(word) > 1 and word.lower() not in self.common and (ending(word) in self.sure or not sure and ending(word) in self.loose)

    def open(self, word: str) -> bool:
        """Whether nothing speaks against a capitalised word's being a surname where the words before it call for one."""
        w = word.lower()
        return len(word) > 1 and word[0].isupper() and w not in self.common and w not in MONTHS and w not in self.given and w not in CUES and w + "." not in CUES and w not in UNITS and w not in KINDS and not re.match(FIRM + "$", word)


def names(text: str, model: Model) -> Iterator[tuple[int, int]]:
    """Spans of persons' names; surname-first forms are one span, titles don't belong to it."""
    tokens = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text)]
    gap = lambda i: text[tokens[i][2] : tokens[i + 1][1]] if i + 1 < len(tokens) else "\0"
    n = len(tokens)
    word = lambda i: tokens[i][0] if i < n else ""
    low = [w.lower() for w, _, _ in tokens]
    low = [w[:-2] if w[-2:] in ("'s", "’s") else w for w in low] if "'" in text or "’" in text else low
    named = [w in model.given for w in low]
    given = lambda i: i < n and named[i]
    initial = lambda i: i < n and len(word(i)) == 1 and word(i).isupper()
    firm = lambda i: i + 1 < n and gap(i).strip() == "" and gap(i) != "" and re.match(FIRM + r"\b", word(i + 1), re.I) is not None and word(i + 1)[0].isupper()
    cued = lambda i: text[max(0, tokens[i][1] - 14) : tokens[i][1]].rstrip(" \t").rsplit(None, 1)[-1:] and text[max(0, tokens[i][1] - 14) : tokens[i][1]].rstrip(" \t").rsplit(None, 1)[-1].lower() in CUES
    near = lambda i: re.fullmatch(r"\.?[ \t]+|[ \t]*\n?[ \t]*", gap(i)) is not None and gap(i) != ""
    i = 0
    while i < n:
        w, a, b = tokens[i]
        lower = w.islower()
        if lower and not named[i]:
            i += 1
            continue
        if a and text[a - 1] in "@.+_-" and not text[a - 1 :].startswith("- ") and (text[a - 1] != "." or a > 1 and text[a - 2].isalnum()) or b < len(text) and (text[b] in "@_+" or text[b] == "." and b + 1 < len(text) and text[b + 1].isalnum() and len(w) > 1):
            i += 1
            continue
        # given (initial or middle) surname
        if given(i) or initial(i):
            j, seen = i, 0
            while j + 1 < n and seen < 2 and near(j) and (initial(j + 1) or seen == 0 and word(j + 1)[:1].isupper() == (not lower) and not model.surname(word(j + 1), False) and j + 2 < n and len(word(j + 1)) > 2 and model.surname(word(j + 2), False) and re.fullmatch(r" ", gap(j + 1)) and given(i)):
                j, seen = j + 1, seen + 1
            k = j + 1
            if k < n and near(j) and "\n\n" not in gap(j) and model.surname(word(k), False) and not firm(k) and word(k).islower() == lower and (given(i) or text[b : b + 1] in (".", " ") and (i == 0 or not given(i - 1))):
                if not (initial(i) and gap(j) == " " and j == i and w in ("A", "I") and not model.surname(word(k), True)):
                    yield a, tokens[k][2]
                    i = k + 1
                    continue
            # a given name or initial calls for a surname, also for one never seen before
            if k < n and k == i + 1 and not lower and gap(i) in (" ", ". ") and model.open(word(k)) and not firm(k) and not firm(i) and (given(i) and w.lower() not in MONTHS and gap(i) == " " and cued(i)):
                yield a, tokens[k][2] - (2 if word(k)[-2:] in ("'s", "’s") else 0)
                i = k + 1
                continue
            if given(i) and not lower and not firm(i) and w.lower() not in MONTHS:
                end = b - 2 if w[-2:] in ("'s", "’s") else b
                while j > i and not initial(j):
                    j -= 1
                yield a, max(end, tokens[j][2] if j > i else end)
                i = j + 1
                continue
        # surname, given; surname given; surname alone
        titled = not lower and a > 2 and text[a - 1] in " \t" and TITLED.search(text[max(0, a - 8) : a])
        if not lower and not firm(i) and (model.surname(w, False) or titled and model.open(w)):
            if i + 1 < n and re.fullmatch(r"\s?,\s?|[ \t]+", gap(i)) and (given(i + 1) or initial(i + 1) and "," in gap(i)) and not (model.surname(word(i + 2), False) and re.fullmatch(r"\.? ", gap(i + 1)) and "," in gap(i) and not firm(i + 2)):
                end = tokens[i + 1][2]
                j = i + 1
                if initial(j + 1) and gap(j) == " ":
                    j, end = j + 1, tokens[j + 1][2]
                yield a, end
                i = j + 1
                continue
            place = re.search(r"(?:\b(?:in|at|from|near|nach|von|de|à|en|of|the|der|die|das|le|la|el|auf|au|aus|system|système|sistema|archive|archiv)|,)\s+(?:the\s+)?$", text[max(0, a - 14) : a], re.I)
            if titled or model.surname(w, True) and not place and not re.match(r"[ \t]+[A-Z]|\s*[|/-]", text[b : b + 3]) and not re.match(r"\s*(?:,\s*[A-Z]{2}\b|\s[A-Z]{1,2}\d)", text[b : b + 8]):
                yield a, b - 2 if w[-2:] in ("'s", "’s") else b
        i += 1


def values(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every personal value, in order and without overlaps."""
    text = text if text.isascii() else text.translate(WIDE)
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))

    def take(a: int, b: int, kind: str) -> None:
        if b > a and not any(taken[a:b]):
            found.append((a, b, kind))
            taken[a:b] = b"\1" * (b - a)

    if "@" in text:
        for m in EMAIL.finditer(text):
            take(m.start(), m.end(), "email")
    if SPELT.search(text):
        for m in SPELT_EMAIL.finditer(text):
            take(m.start(), m.end(), "email")
    if DIGIT.search(text):
        for m in ID.finditer(text):
            before = text[max(0, m.start() - 40) : m.start()]
            if not PLAIN_NUMBERS.search(before) and (not NUMBER_CUE_NEEDED.match(m[0]) or ID_CUE.search(before) or cue_before(text, m.start()) in model.cues):
                take(m.start(), m.end(), "id_number")
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15 and not PLAIN_NUMBERS.search(text[max(0, m.start() - 40) : m.start()]):
                take(m.start(), m.end(), "phone")
        for pattern in (ADDRESS, JOINED_STREET, ADDRESS_NO_KIND):
            for m in pattern.finditer(text) if pattern is not JOINED_STREET or JOINED.search(text) else ():
                take(m.start(), m.end(), "street_address")
    for a, b in names(text, model):
        take(a, b, "person_name")
    return sorted(found)


def disclosures(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows (kind, key): the terms of a corpus whose disclosure passes the threshold.

    Given names are words that stand after a cue, or before surnames, far oftener than words do; endings are a surname's if they
    follow given names far oftener than words of place. Common words hardly ever stand beside another
    capitalised word. Cues stand before government numbers far oftener than before others.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            total: Counter = Counter()
            for t in f.iloc[:, 0]:
                total.update(contexts(t))
            yield pd.DataFrame([(k, w, c) for (k, w), c in total.items()], columns=["kind", "key", "n"])

    counts = texts.select(text).where(F.col(text).isNotNull()).mapInPandas(run, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = written(counts, "p4-counts")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    # B has pairs of word and ending, all other kinds one term a row
    terms = counts.where("kind <> 'B'").groupBy("key").agg(*[of(k).alias(k.lower()) for k in "NSTCIJ"])
    terms = written(terms, "p4-terms")
    sums = terms.agg(*[F.sum(k).alias(k) for k in "nstij"]).first()
    total, protected, places, ids, numbers = ((v or 0) for v in sums)
    prior = max(protected, 1) / max(total, 1)
    no = sorted(MONTHS | set(CUES) | {c.removesuffix(".") for c in CUES})
    formal = sorted({x for v in lexicon()[0].values() for x in v})
    first = terms.where(((F.col("s") >= MIN_GIVEN) & (F.log2(F.col("s") / F.greatest("n", F.lit(1)) / prior) >= DISCLOSURE) & ~F.col("key").isin(no)) | F.col("key").isin(formal) & (F.col("n") > 0)).select("key")
    both = counts.where("kind = 'B'").select(F.substring_index("key", "|", 1).alias("w"), F.substring_index("key", "|", -1).alias("e"), "n")
    ends = both.join(first.withColumnRenamed("key", "w"), "w", "left_semi").groupBy("e").agg(F.sum("n").alias("p")).join(terms.select(F.col("key").alias("e"), "t"), "e", "left").fillna(0, ["t"])
    ends = written(ends, "p4-endings")
    led = both.join(ends.where("p >= 3 and p >= 3 * t").select("e"), "e", "left_semi").groupBy(F.col("w").alias("key")).agg(F.sum("n").alias("c")).join(terms.select("key", "n"), "key")
    names_of_months = F.col("key").isin("jun", "may", "april", "june", "august")
    more = led.where((F.col("c") >= 5) & ~F.col("key").isin(sorted({*CUES, *(c.removesuffix(".") for c in CUES), "dr", "prof"})) & (F.length("key") > 2) & ((F.col("c") >= 0.25 * F.col("n")) | names_of_months) & ~F.initcap("key").rlike("^" + FIRM + "$"))
    # words that stand before surnames as often as given names do are given names too
    given = written(first.union(more.select("key")).distinct(), "p4-given")
    people = ends.agg(F.sum("p")).first()[0] or 0
    base = (people + 1) / (people + places + 2)
    top = math.log2(1 / base)
    bits = ends.where("p >= 2").select("e", F.log2((F.col("p") + 0.5) / (F.col("p") + F.col("t") + 1) / base).alias("v"))
    # a word tells its own disclosure: names of systems hardly ever stand beside another capitalised word
    common = terms.where((F.col("n") > 0) & ((F.col("c") + 3) / (F.col("n") + 10) < 0.15)).select("key").join(given, "key", "left_anti")
    cues = terms.where((F.length("key") > 3) & (F.col("i") >= MIN_GIVEN) & (F.log2(F.col("i") / F.greatest("j", F.lit(1)) / (max(ids, 1) / max(numbers, 1))) >= DISCLOSURE) & (F.col("i") >= 0.5 * F.col("j")))
    kind = lambda d, k, c="key": d.select(F.lit(k).alias("kind"), F.col(c).alias("key"))
    out = kind(given, "given").union(kind(bits.where(F.col("v") >= top - 0.35), "sure", "e")).union(kind(bits.where(F.col("v") >= top - DISCLOSURE - 1.5), "loose", "e")).union(kind(common, "common")).union(kind(cues, "cue"))
    return written(out, "p4-model")


def corpus_model(texts: DataFrame, text: str = "text") -> Model:
    """The whole model, for corpora of which it is known to be small."""
    return Model([tuple(r) for r in disclosures(texts, text).collect()])


def lookups(text: str) -> list[str]:
    """All keys by which a text's words are looked up in the model."""
    text = text if text.isascii() else text.translate(WIDE)
    out = set()
    for w in TOKEN.findall(text):
        out.update((w.lower(), w.lower().removesuffix("'s").removesuffix("’s"), ending(w)))
    return sorted(out)


def with_terms(texts: DataFrame, key: list[str], text: str, terms: DataFrame) -> DataFrame:
    """texts (key, text) with a column `terms`: the terms of the model that stand in the text."""
    own = F.udf(lookups, "array<string>", useArrow=True)
    rows = written(texts.select(*key, text).distinct().withColumn("_id", F.xxhash64(*key, text)), "p4-texts")
    words = rows.select("_id", F.explode(own(F.coalesce(text, F.lit("")))).alias("key")).distinct()
    found = words.join(terms, "key").groupBy("_id").agg(F.collect_list(F.struct("kind", "key")).alias("terms"))  # at most a text's own words
    return rows.join(found, "_id", "left").drop("_id")


def applied(texts: DataFrame, key: list[str], text: str, model: Model | DataFrame | None, one, schema: str, column: str, most: int = MODEL_TERMS) -> DataFrame:
    """key columns and `column`, one(text, model) of every row: by a broadcast model, or by each text's own terms where there are more than `most`."""
    terms = disclosures(texts, text) if model is None else model
    if isinstance(terms, DataFrame) and terms.count() > most:

        @F.pandas_udf(schema)
        def each(t: pd.Series, own: pd.Series) -> pd.Series:
            return pd.Series([one(x, Model([] if o is None else [(r["kind"], r["key"]) for r in o])) if x is not None else None for x, o in zip(t, own)], dtype=object)

        return with_terms(texts, key, text, terms).select(*key, each(text, "terms").alias(column))
    m = terms if isinstance(terms, Model) else Model([tuple(r) for r in terms.collect()])  # at most `most` rows
    shared = texts.sparkSession.sparkContext.broadcast(m)

    @F.pandas_udf(schema)
    def every(t: pd.Series) -> pd.Series:
        return pd.Series([one(x, shared.value) if x is not None else None for x in t], dtype=object)

    return texts.select(*key, every(text).alias(column))


VALUES = "array<struct<start_pos:int,end_pos:int,pii_kind:string>>"


def find(texts: DataFrame, key: str | list[str], text: str = "text", model: Model | DataFrame | None = None, most: int = MODEL_TERMS) -> DataFrame:
    """Rows (key, pii_kind, start_pos, end_pos) of every personal value; positions count code points from 0.

    Null and empty texts have none; equal rows of one key count once; other columns are ignored.
    """
    keys = [key] if isinstance(key, str) else key
    rows = lambda t, m: [{"start_pos": a, "end_pos": b, "pii_kind": k} for a, b, k in values(t, m)]
    found = applied(texts.where(F.col(text).isNotNull()), keys, text, model, rows, VALUES, "_v", most)
    return found.select(*keys, F.explode("_v").alias("_v")).select(*keys, "_v.pii_kind", "_v.start_pos", "_v.end_pos").distinct()


def safe_text(text: str, model: Model) -> str:
    out, at = [], 0
    for a, b, kind in values(text, model):
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def sanitised(texts: DataFrame, key: str | list[str], text: str = "text", model: Model | DataFrame | None = None, most: int = MODEL_TERMS) -> DataFrame:
    """Rows (key, safe_text): every value replaced by a placeholder of its kind; null stays null."""
    keys = [key] if isinstance(key, str) else key
    return applied(texts, keys, text, model, safe_text, "string", "safe_text", most)


def both_tables(spark, sf_dir) -> DataFrame:
    """Both tables as (text_table, text_key, text), nulls and repeated rows included: texts are scanned, never shuffled."""
    b = spread(read(spark, sf_dir, "extracted_blocks").select("block_id", "text")).select(F.lit("extracted_blocks").alias("text_table"), F.col("block_id").cast("string").alias("text_key"), "text")
    p = read(spark, sf_dir, "llm_call_logs").select(F.lit("llm_call_logs").alias("text_table"), F.col("log_id").alias("text_key"), F.col("prompt_text").alias("text"))
    return b.union(p)


def p4_found(spark, sf_dir) -> DataFrame:
    t = both_tables(spark, sf_dir).where("text is not null and text_key is not null")
    return find(t, ["text_table", "text_key"]).drop("end_pos").distinct()


def p4_sanitised(spark, sf_dir) -> DataFrame:
    """The texts of both tables with placeholders instead of personal values; repeated rows count once."""
    return sanitised(both_tables(spark, sf_dir), ["text_table", "text_key"]).distinct()


def p4_terms(spark, sf_dir) -> DataFrame:
    """How many terms of each kind disclose."""
    return disclosures(both_tables(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n_terms"))


QUERIES = {"p4_found": p4_found, "p4_sanitised": p4_sanitised, "p4_terms": p4_terms}
SQL: dict = {}
