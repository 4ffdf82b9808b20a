"""Detection by patterns: all matches with their places in one projection and one explode, then scoring, suppression and counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import around, luhn, mask_ends, strip

HIT = "struct<entity_type:string,start:int,end:int,score:double,value:string,geography:string,framework:string>"


def chosen(geographies: list[str] | None = None, types: list[str] | None = None) -> list[tuple]:
    """Patterns of the given regions (those that hold everywhere always belong) and types; None is all."""
    return [p for p in V.PATTERNS if (geographies is None or p[3] == "GLOBAL" or p[3] in geographies) and (types is None or p[0] in types)]


def regions() -> list[str]:
    """All regions that patterns are for, in order."""
    return sorted({p[3] for p in V.PATTERNS})


def target_types(settings: dict | None, default: str | None, defaults: dict[str, list[str]]) -> list[str] | None:
    """The types to look for: those that the settings name, else those of the base they name, else of the default; None is all."""
    settings = settings or {}
    if settings.get("target_entity_types"):
        return list(settings["target_entity_types"])
    return next((list(defaults[k]) for k in (settings.get("base_protocol_id"), default) if k and k in defaults), None)


ODD = r"[^\x00-\x7F]"


def expression(pattern: str, ignore_case: bool = False, plain: bool = False) -> str:
    """A pattern as all scans use it: classes and word limits are those of all scripts; in plain (ASCII) text both mean the same and the second is faster."""
    return ("" if plain else "(?U)") + ("(?i)" if ignore_case else "") + pattern


def occurrences(text: Column, pattern: str, odd: Column | None = None) -> Column:
    """How often a pattern occurs, by the rules of expression()."""
    odd = text.rlike(ODD) if odd is None else odd
    return F.when(odd, F.regexp_count(text, F.lit(expression(pattern)))).otherwise(F.regexp_count(text, F.lit(expression(pattern, plain=True))))


CHUNK = 256


def running(lengths: Column) -> Column:
    """array<int> of what comes before each element: sums within chunks, then over chunks, so that a text of very many matches isn't quadratic."""
    n = F.size(lengths)
    sums = lambda xs: F.aggregate(xs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda k: F.slice(lengths, k * CHUNK + 1, CHUNK))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x))
    return F.flatten(F.zip_with(chunks, sums(totals), lambda c, before: F.transform(sums(c), lambda x: x + before)))


def hits(text: Column, found: Column, odd: Column, pattern: tuple, ignore_case: bool = False) -> Column:
    """array<HIT> of one pattern, all of whose matches are in the array `found`: the pieces between them give the places. Only texts with a match are split."""
    kind, expr, score, geography, framework = pattern
    between = F.when(odd, F.split(text, expression(expr, ignore_case), -1)).otherwise(F.split(text, expression(expr, ignore_case, True), -1))
    lengths = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, f: F.length(b) + F.length(f))
    starts = F.zip_with(running(lengths), F.slice(between, 1, F.size(found)), lambda at, b: at + F.length(b))
    out = F.zip_with(starts, found, lambda at, f: F.struct(
        F.lit(kind).alias("entity_type"), at.alias("start"), (at + F.length(f)).alias("end"), F.lit(float(score)).alias("score"), f.alias("value"), F.lit(geography).alias("geography"), F.lit(framework).alias("framework")))
    return F.when(F.size(found) > 0, out).otherwise(F.array().cast(f"array<{HIT}>"))


def detect(blocks: DataFrame, text: str = "text", geographies: list[str] | None = None, types: list[str] | None = None, min_score: float = 0.10, ignore_case: bool = False, check_luhn: bool = False) -> DataFrame:
    """blocks exploded to one row a match, with needs_layer2 where the score is below 0.75; the text stays."""
    patterns = [p for p in chosen(geographies, types) if p[2] >= min_score]
    # matches are columns of their own, so each pattern scans a text once
    matches = lambda p, plain: F.regexp_extract_all(F.col(text), F.lit(expression(p[1], ignore_case, plain)), F.lit(0))
    found = [F.when(F.col("_odd"), matches(p, False)).otherwise(matches(p, True)).alias(f"_f{i}") for i, p in enumerate(patterns)]
    every = F.flatten(F.array(*[hits(F.col(text), F.col(f"_f{i}"), F.col("_odd"), p, ignore_case) for i, p in enumerate(patterns)]))
    out = blocks.where(F.col(text).isNotNull()).withColumn("_odd", F.col(text).rlike(ODD)).select("*", *found).withColumn("hit", F.explode(every)).select(*blocks.columns, "hit.*").withColumn("needs_layer2", F.col("score") < 0.75)
    return out.where((F.col("entity_type") != "CREDIT_CARD") | luhn("value")) if check_luhn else out


def counts(blocks: DataFrame, text: str = "text", types: list[str] | None = None) -> DataFrame:
    """Matches of each type over all texts: counted in the scan, so only one row a type and task is shuffled."""
    b = blocks.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(text).rlike(ODD).alias("odd"))
    pairs = [F.struct(F.lit(p[0]).alias("entity_type"), occurrences(F.col("t"), p[1], F.col("odd")).cast("bigint").alias("n")) for p in chosen(None, types)]
    return b.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("n > 0").groupBy("entity_type").agg(F.sum("n").alias("n_matches"), F.count("*").alias("n_texts"))


def best_per_value(found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of the highest score, the first on a tie, for each value, type and place; only the row's keys travel twice."""
    first = F.struct((-F.col("score")).alias("s"), *[F.col(c) for c in order])
    return found.groupBy(*keys, "entity_type", "value").agg(F.min_by(F.struct(*[c for c in found.columns if c not in [*keys, "entity_type", "value"]]), first).alias("r")).select(*keys, "entity_type", "value", "r.*")


def signal_boost(found: DataFrame, text: str = "text", role: str | None = None) -> DataFrame:
    """Layer 2: 0.20 more where a word of the type stands within 100 characters; roles move it once more."""
    near = F.lower(around(text, "start", "end", 100))
    known = F.lit(False)
    for kind, words in V.SIGNALS.items():
        known = known | (F.col("entity_type") == kind) & near.rlike("|".join(map(re.escape, words)))
    score = F.when(known, F.least(F.lit(1.0), F.col("score") + 0.20)).otherwise(F.col("score"))
    if role:
        score = F.when(F.col(role) == "institutional", F.greatest(F.lit(0.0), score - 0.15)).when(F.col(role) == "primary_subject", F.least(F.lit(1.0), score + 0.05)).otherwise(score)
    return found.withColumn("signal", known).withColumn("score", score).withColumn("needs_layer2", F.col("score") < 0.75)


def header_type(header: Column) -> Column:
    """struct<keyword, entity_type> of the longest known word in a column header; null without one."""
    h = F.regexp_replace(F.lower(strip(header)), r"^\[review\] ", "")
    known = F.array(*map(F.lit, sorted(V.HEADERS, key=len, reverse=True)))
    word = F.get(F.filter(known, lambda k: F.contains(h, k)), F.lit(0))
    kinds = F.create_map(*[F.lit(x) for kv in V.HEADERS.items() for x in kv])
    return F.when(word.isNotNull(), F.struct(word.alias("keyword"), kinds[word].alias("entity_type")))


def header_inference(found: DataFrame, header: str = "col_header") -> DataFrame:
    """Layer 3: the header's type replaces the pattern's and adds 0.15; rows without a known header stay."""
    h = header_type(F.col(header))
    return found.withColumn("_h", h).withColumn("score", F.when(F.col("_h").isNull(), F.col("score")).otherwise(F.least(F.lit(1.0), F.col("score") + 0.15))).withColumn(
        "pattern_used", F.when(F.col("_h").isNotNull(), F.concat(F.lit("header:"), F.col("_h.keyword")))).withColumn("entity_type", F.coalesce("_h.entity_type", "entity_type")).drop("_h")


def false_positive(kind: Column, value: Column, context: Column) -> Column:
    """The reason for which a match is no personal value, or null. The first rule that holds gives it."""
    v = strip(value)
    labels = "|".join(re.escape(x) for x in sorted(V.REFERENCE_LABELS, key=len, reverse=True))
    before = F.substring(context, F.lit(1), (F.floor(F.length(context) / 2) + 20).cast("int"))
    birth, other = context.rlike(V.BIRTH_WORDS), context.rlike(V.DATE_WORDS)
    dates = kind.isin("DATE_OF_BIRTH_DMY", "DATE_OF_BIRTH_MDY", "DATE_OF_BIRTH_ISO")
    return (F.when(kind.isin("STUDENT_ID", "VAT_EU") & F.lower(v).isin(V.COMMON_WORDS), "common_word")
            .when((kind == "STUDENT_ID") & ~value.rlike(r"(?U)\d"), "no_digit")
            .when(kind.isin("COMPANY_NUMBER_UK", "DRIVER_LICENSE_US") & before.rlike(rf"(?i)\b(?:{labels})[\s:]*$"), "reference_label")
            .when((kind == "COMPANY_NUMBER_UK") & v.rlike(r"^\d{0,7}$") & ~context.rlike(V.COMPANY_WORDS), "short_number")
            .when((kind == "DRIVER_LICENSE_US") & ~context.rlike(V.LICENCE_WORDS), "no_licence_word")
            .when((kind == "VAT_EU") & v.rlike(r"(?U)^\p{L}+$"), "letters_only")
            .when(dates & other & ~birth, "transaction_date").when(dates & ~birth, "no_birth_word")
            .when((kind == "PHONE_NUMBER") & v.rlike(V.CURRENCY), "currency"))


def suppressed(found: DataFrame, text: str = "text") -> DataFrame:
    """found with the reason of suppression (null if kept), from 120 characters on either side."""
    return found.withColumn("fp_reason", false_positive(F.col("entity_type"), F.col("value"), around(text, "start", "end", 120)))


def with_categories(found: DataFrame) -> DataFrame:
    """One row for each category of a row's entity type; a missing type is UNKNOWN."""
    kind = F.coalesce(F.nullif(F.col("entity_type"), F.lit("")), F.lit("UNKNOWN"))
    table = F.create_map(*[x for k, v in V.CATEGORIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return found.withColumn("entity_type", kind).withColumn("category", F.explode(F.coalesce(table[F.upper(kind)], F.array(F.lit("PII")))))


def density(found: DataFrame, document: str = "doc_id") -> DataFrame:
    """Counts by category for each document and (document null) for all, in one pass over grouping sets."""
    return with_categories(found).groupingSets([[F.col(document), F.col("category")], [F.col("category")]], F.col(document), F.col("category")).agg(F.count("*").alias("n"))


def confidence_label(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """high if more than 80 % of the scores are 0.75 or more, low if more than 30 % are below 0.50, else partial; nulls don't count."""
    a = df.groupBy(*by).agg(F.count("*").alias("total"), F.count(score).alias("valid"), F.count_if(F.col(score) >= 0.75).alias("high"), F.count_if(F.col(score) < 0.50).alias("low"))
    label = F.when(F.col("valid") == 0, "partial").when(F.col("high") / F.col("valid") > 0.80, "high").when(F.col("low") / F.col("valid") > 0.30, "low").otherwise("partial")
    return a.withColumn("confidence", label).withColumn("missing", F.col("total") - F.col("valid"))


SCHEMA_RULES = ["field_map", "table", "date", "person", "hint"]
TABLES = "doc_id bigint, table_no int, has_pii boolean, plain array<string>, personal array<string>"


def _table_region(near: Column, tables: Column) -> Column:
    """Whether a text around a match is in the region of a table without personal data.

    tables: array<struct<has_pii, plain, personal>>, the headers of columns without and with personal data. A table with both
    is left if one of the first and none of the second stand in the text; one without is left if any plain header of the document does.
    """
    quoted = lambda h: F.concat(F.lit(r"\Q"), F.replace(F.trim(h), F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    ends = lambda h: F.regexp_like(near, F.concat(F.lit("(?i)"), quoted(h), F.lit(r"\b")))
    whole = lambda h: F.regexp_like(near, F.concat(F.lit(r"(?i)\b"), quoted(h), F.lit(r"\b")))
    mixed = lambda t: t["has_pii"] & F.exists(t["plain"], ends) & ~F.exists(t["personal"], ends)
    any_ = F.exists(tables, lambda t: F.exists(t["plain"], whole))
    return F.exists(tables, lambda t: mixed(t) | ~t["has_pii"] & any_) & F.exists(tables, lambda t: F.size(t["plain"]) > 0)


def schema_filter(found: DataFrame, fields: DataFrame, dates: DataFrame, people: DataFrame, hints: DataFrame, tables: DataFrame | None = None, min_confidence: float = 0.50, confidence: str = "schema_confidence") -> DataFrame:
    """found with action (keep, suppress, reclassify), rule and new_type by what is known of the document.

    fields (doc_id, value, is_pii, suppress_types, override, seq), dates (doc_id, value, is_pii), people (doc_id, name),
    hints (doc_id, hint), tables (TABLES; found must then have `near`, 200 characters on either side). The first rule that acts decides; below
    the confidence nothing is touched. Values of fields and people are compared without case, dates as they are.
    """
    v = F.lower(strip("value"))
    f = found.withColumn("_k", v).withColumn("_v", strip("value"))
    f = f.withColumn("_id", F.monotonically_increasing_id()) if "_id" not in f.columns else f
    e = fields.select(F.col("doc_id"), F.lower(strip("value")).alias("_k"), "is_pii", "suppress_types", "override", "seq")
    acting = f.select("_id", "doc_id", "_k", "entity_type").join(e, ["doc_id", "_k"]).select(
        "_id", F.when(~F.col("is_pii"), F.struct(F.lit("suppress").alias("action"), F.lit(None).cast("string").alias("new_type"), F.col("seq").alias("seq")))
        .when(F.array_contains("suppress_types", F.col("entity_type")), F.struct(F.lit("suppress").alias("action"), F.lit(None).cast("string").alias("new_type"), F.col("seq").alias("seq")))
        .when(F.col("override") != F.col("entity_type"), F.struct(F.lit("reclassify").alias("action"), F.col("override").alias("new_type"), F.col("seq").alias("seq"))).alias("_a"))
    one = acting.where("_a is not null").groupBy("_id").agg(F.min_by("_a", "_a.seq").alias("_r1"))
    d = dates.where(~F.col("is_pii")).select("doc_id", strip("value").alias("_v"), F.lit(True).alias("_r3")).distinct()
    p = people.select("doc_id", F.lower(strip("name")).alias("_k"), F.lit(True).alias("_r4")).distinct()
    h = hints.groupBy("doc_id").agg(F.collect_set(F.lower("hint")).alias("_hints"))  # those of one document
    j = f.join(one, "_id", "left").join(d, ["doc_id", "_v"], "left").join(p, ["doc_id", "_k"], "left").join(h, "doc_id", "left")
    if tables is not None:
        t = tables.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("table_no", "has_pii", "plain", "personal"))).alias("_tables"))  # those of one document
        j = j.join(t, "doc_id", "left").withColumn("_r2", F.coalesce(_table_region(F.col("near"), F.col("_tables")), F.lit(False))).drop("_tables")
    else:
        j = j.withColumn("_r2", F.lit(False))
    hit = F.exists(F.coalesce("_hints", F.array().cast("array<string>")), lambda x: F.contains(x, F.col("_k")) | F.contains(F.col("_k"), x))
    rule = (F.when(F.coalesce(F.col(confidence), F.lit(1.0)) < min_confidence, F.lit(None)).when(F.col("_r1").isNotNull(), "field_map").when(F.col("_r2"), "table")
            .when(F.col("_r3") & F.contains(F.upper("entity_type"), F.lit("DATE")), "date").when(F.col("_r4") & (F.col("entity_type") == "ORGANIZATION"), "person").when(hit, "hint"))
    j = j.withColumn("rule", rule)
    action = F.when(F.col("rule").isNull(), "keep").when(F.col("rule") == "field_map", F.col("_r1.action")).when(F.col("rule") == "person", "reclassify").otherwise("suppress")
    new = F.when(F.col("rule") == "field_map", F.col("_r1.new_type")).when(F.col("rule") == "person", "PERSON")
    return j.withColumn("action", action).withColumn("new_type", new).drop("_k", "_v", "_id", "_r1", "_r2", "_r3", "_r4", "_hints")


def suppression_log(filtered: DataFrame) -> DataFrame:
    """Rows (doc_id, entity_type, detected_text, action, reason, new_type) of what schema_filter() acted on, the value masked but for its last four."""
    return filtered.where("rule is not null").select("doc_id", "entity_type", mask_ends("value", 0, 4).alias("detected_text"), "action", F.col("rule").alias("reason"), "new_type")


def page_report(blocks: DataFrame, found: DataFrame, doc: str = "doc_id", page: str = "page_or_sheet") -> DataFrame:
    """Rows (doc, page, page_type, blocks_extracted, pii_hits, low_confidence, by_type) of every page with blocks or matches."""
    tabular = F.lower("file_type").isin("csv", "xlsx", "xls", "parquet", "avro")
    b = blocks.groupBy(doc, page).agg(F.count("*").alias("blocks_extracted"), F.when(F.max(tabular), "sheet").otherwise("digital").alias("page_type"))
    kinds = found.groupBy(doc, page, "entity_type").agg(F.count("*").alias("n"), F.count_if(F.col("score") < 0.75).alias("low"))
    h = kinds.groupBy(doc, page).agg(F.sum("n").alias("pii_hits"), F.sum("low").alias("low_confidence"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", "n")))).alias("by_type"))  # a row a type
    return b.join(h, [doc, page], "full").fillna(0, ["blocks_extracted", "pii_hits", "low_confidence"]).fillna("digital", ["page_type"])


def latest(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The newest row of each group."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(order))).where("_n = 1").drop("_n")
