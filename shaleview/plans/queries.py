"""Queries of the general operators over the test tables, each with the SQL it is checked against."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..cluster import checkpoint_dir, read, spread
from ..functions import normalise as N
from ..functions import text as X
from ..functions import values as V
from ..functions.similarity import address_match, government_match, jaro_winkler, likely_same_person, name_match, soundex
from ..operators import detection as D
from ..operators import resolution as R
from ..operators import structure as S
from ..sources import files, sinks
from ..streaming import detect as stream
from . import pipeline

QUERIES: dict = {}
SQL: dict[str, str] = {}
LOOKAROUND = ["SSN_NODASH", "PHONE_US", "NATIONAL_INSURANCE_UK", "STUDENT_ID"]
CORE = ["EMAIL", "PHONE_INTL", "CREDIT_CARD", "IPV4", "SSN", "PAN", "AADHAAR", "DATE_OF_BIRTH_MDY", "DATE_OF_BIRTH_ISO"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pattern(kind: str) -> str:
    return next(p[1] for p in V.PATTERNS if p[0] == kind)


def words(ws: list[str]) -> str:
    return "[" + ", ".join(map(q, ws)) + "]"


PLACES = "list_sum([length(x) FOR x IN ps[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i-1]]), 0)"


def spans_sql(table: str, kinds: list[str], keys: str) -> str:
    """SQL for all matches of RE2 patterns with their places."""
    parts = []
    for k in kinds:
        p = q(pattern(k))
        parts.append(f"SELECT {keys}, text, '{k}' AS entity_type, unnest(ms) AS value, unnest([{PLACES} FOR i IN range(1, len(ms) + 1)]) AS start FROM (SELECT {keys}, text, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS ps FROM {table} WHERE text IS NOT NULL)")
    return " UNION ALL ".join(parts)


def categories_sql(kind: str) -> str:
    return "CASE " + " ".join(f"WHEN {kind} = {q(k)} THEN {words(v)}" for k, v in V.CATEGORIES.items()) + " ELSE ['PII'] END"


# ---- detection


@query("SELECT source, category, count(*) AS n FROM (SELECT source, unnest(" + categories_sql("entity_type") + ") AS category FROM (" + spans_sql("documents", CORE, "doc_id, source") + ")) GROUP BY 1, 2")
def detect_category_counts(spark, sf_dir) -> DataFrame:
    """Detections of the most common types by source and category."""
    pairs = [F.struct(F.lit(k).alias("entity_type"), D.occurrences(F.col("text"), pattern(k), F.col("odd")).cast("bigint").alias("n")) for k in CORE]
    d = spread(read(spark, sf_dir, "documents").where("text is not null").select("source", "text", F.col("text").rlike(D.ODD).alias("odd"))).select("source", F.explode(F.array(*pairs)).alias("p")).select("source", "p.*").where("n > 0")
    return D.with_categories(d.groupBy("source", "entity_type").agg(F.sum("n").alias("n"))).groupBy("source", "category").agg(F.sum("n").alias("n"))


_RE2 = [p[0] for p in V.PATTERNS if p[0] not in LOOKAROUND]


@query(" UNION ALL ".join(f"SELECT '{k}' AS entity_type, sum(len(regexp_extract_all(text, {q(pattern(k))})))::BIGINT AS n_matches, count(*) AS n_texts FROM extracted_blocks WHERE regexp_matches(text, {q(pattern(k))}) HAVING count(*) > 0" for k in _RE2))
def detect_all_counts(spark, sf_dir) -> DataFrame:
    return D.counts(spread(read(spark, sf_dir, "extracted_blocks").select("text")), types=_RE2)


@query(f"""SELECT 'SSN_NODASH' AS entity_type, sum(len(ms))::BIGINT AS n_matches, count(*) AS n_texts FROM (SELECT list_filter(regexp_extract_all(text, '\\b\\d{{9}}\\b'), lambda x: NOT (x[1:3] IN ('000', '666') OR x[1] = '9' OR x[4:5] = '00' OR x[6:9] = '0000')) AS ms FROM extracted_blocks WHERE text IS NOT NULL) WHERE len(ms) > 0""")
def detect_ssn_nodash(spark, sf_dir) -> DataFrame:
    return D.counts(spread(read(spark, sf_dir, "extracted_blocks").select("text")), types=["SSN_NODASH"])


# RE2 has no looking around: limits of words say the same of a number, and prefixes and digits are asked for afterwards
_US = r"(?:\b(?:1[\s\-.])?\d{3}|\b1[\s\-.]\(\d{3}\)|\B\(\d{3}\))[\s\-.]?\d{3}[\s\-.]?\d{4}\b"
_AROUND = {
    "SSN_NODASH": r"list_filter(regexp_extract_all(text, '\b\d{9}\b'), lambda x: NOT (x[1:3] IN ('000', '666') OR x[1] = '9' OR x[4:5] = '00' OR x[6:9] = '0000'))",
    "PHONE_US": f"regexp_extract_all(text, {q(_US)})",
    "NATIONAL_INSURANCE_UK": r"list_filter(regexp_extract_all(text, '\b[A-CEGHJ-PR-TW-Z]{2}\d{6}[ABCD]\b'), lambda x: x[1:2] NOT IN ('BG', 'GB', 'NK', 'KN', 'TN', 'NT', 'ZZ'))",
    "STUDENT_ID": r"list_filter(regexp_extract_all(text, '\b(?:STU|SID|S)[A-Z0-9\-]{4,12}\b'), lambda x: regexp_matches(x, '\d'))",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS entity_type, sum(len(ms))::BIGINT AS n_matches, count(*) AS n_texts FROM (SELECT {v} AS ms FROM documents WHERE text IS NOT NULL) WHERE len(ms) > 0 HAVING count(*) > 0" for k, v in _AROUND.items()))
def detect_lookaround_counts(spark, sf_dir) -> DataFrame:
    return D.counts(spread(read(spark, sf_dir, "documents").select("text")), types=LOOKAROUND)


_SPANS = spans_sql("extracted_blocks", _RE2, "block_id, doc_id")


@query(f"SELECT block_id, entity_type, value, start::INT AS start, (start + length(value))::INT AS \"end\" FROM ({_SPANS})")
def detect_spans(spark, sf_dir) -> DataFrame:
    d = spread(read(spark, sf_dir, "extracted_blocks").select("block_id", "text"))
    return D.detect(d, types=_RE2).select("block_id", "entity_type", "value", "start", "end")


@query(f"SELECT doc_id, entity_type, value, block_id, start::INT AS start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type, value ORDER BY block_id, start) AS n FROM ({_SPANS})) WHERE n = 1")
def detection_best(spark, sf_dir) -> DataFrame:
    d = D.detect(spread(read(spark, sf_dir, "extracted_blocks").select("doc_id", "block_id", "text")), types=_RE2).drop("text")
    return D.best_per_value(d, ["doc_id"], ["block_id", "start"]).select("doc_id", "entity_type", "value", "block_id", "start")


@query(f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, {q(pattern("CREDIT_CARD"))})) AS value FROM documents), d AS (SELECT doc_id, value, regexp_replace(value, '[^0-9]', '', 'g') AS s FROM c)
SELECT doc_id, value, list_sum([CASE WHEN (length(s) - i) % 2 = 0 THEN s[i]::INT ELSE CASE WHEN s[i]::INT * 2 > 9 THEN s[i]::INT * 2 - 9 ELSE s[i]::INT * 2 END END FOR i IN range(1, length(s) + 1)]) % 10 = 0 AS passes FROM d""")
def luhn_cards(spark, sf_dir) -> DataFrame:
    d = D.detect(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), types=["CREDIT_CARD"])
    return d.select("doc_id", "value", X.luhn("value").alias("passes"))


@query(f"SELECT doc_id, category, count(*) AS n FROM (SELECT doc_id, unnest({categories_sql('entity_type')}) AS category FROM ({spans_sql('documents', CORE[:6], 'doc_id')})) GROUP BY GROUPING SETS ((doc_id, category), (category))")
def density_documents(spark, sf_dir) -> DataFrame:
    return D.density(D.detect(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), types=CORE[:6]).drop("text"))


@query("""SELECT project_id, count(*) AS total, count(merge_confidence) AS valid, count(*) FILTER (merge_confidence >= 0.75) AS high, count(*) FILTER (merge_confidence < 0.50) AS low, count(*) - count(merge_confidence) AS missing,
CASE WHEN count(merge_confidence) = 0 THEN 'partial' WHEN count(*) FILTER (merge_confidence >= 0.75) / count(merge_confidence) > 0.80 THEN 'high' WHEN count(*) FILTER (merge_confidence < 0.50) / count(merge_confidence) > 0.30 THEN 'low' ELSE 'partial' END AS confidence FROM notification_subjects GROUP BY 1""")
def confidence_labels(spark, sf_dir) -> DataFrame:
    return D.confidence_label(read(spark, sf_dir, "notification_subjects"), ["project_id"], "merge_confidence")


_SIGNALS = [k for k in V.SIGNALS if k in _RE2]
_NEAR = "lower(substr(text, greatest(start - 100, 0)::BIGINT + 1, (least(start + length(value) + 100, length(text)) - greatest(start - 100, 0))::BIGINT))"
_BOOST = " ".join(f"WHEN entity_type = '{k}' THEN regexp_matches({_NEAR}, {q('|'.join(map(re.escape, V.SIGNALS[k])))})" for k in _SIGNALS)


@query(f"SELECT entity_type, boosted, count(*) AS n FROM (SELECT entity_type, CASE {_BOOST} END AS boosted FROM ({spans_sql('extracted_blocks', _SIGNALS, 'block_id')})) GROUP BY 1, 2")
def signal_boosts(spark, sf_dir) -> DataFrame:
    """Matches with and without a word of their type nearby."""
    d = D.signal_boost(D.detect(spread(read(spark, sf_dir, "extracted_blocks").select("block_id", "text")), types=_SIGNALS))
    return d.groupBy("entity_type", F.col("signal").alias("boosted")).agg(F.count("*").alias("n"))


_HEADER = "CASE " + " ".join(f"WHEN contains(h, {q(k)}) THEN {q(V.HEADERS[k])}" for k in sorted(V.HEADERS, key=len, reverse=True)) + " END"


@query(f"SELECT col_header, {_HEADER} AS entity_type, count(*) AS n FROM (SELECT col_header, lower(trim(col_header)) AS h FROM extracted_blocks WHERE col_header IS NOT NULL) GROUP BY 1, 2")
def header_types(spark, sf_dir) -> DataFrame:
    b = read(spark, sf_dir, "extracted_blocks").where("col_header is not null").groupBy("col_header").agg(F.count("*").alias("n"))
    return b.select("col_header", D.header_type(F.col("col_header"))["entity_type"].alias("entity_type"), "n")


_DENY = ["DATE_OF_BIRTH_DMY", "DATE_OF_BIRTH_MDY", "DATE_OF_BIRTH_ISO", "DRIVER_LICENSE_US", "COMPANY_NUMBER_UK", "VAT_EU"]
_LABELS = "|".join(x.replace(".", "\\.") for x in sorted(V.REFERENCE_LABELS, key=len, reverse=True))


@query(f"""WITH s AS (SELECT entity_type, trim(value) AS v, value, substr(text, greatest(start - 120, 0)::BIGINT + 1, (least(start + length(value) + 120, length(text)) - greatest(start - 120, 0))::BIGINT) AS c FROM ({spans_sql('documents', _DENY, 'doc_id')}))
SELECT entity_type, fp_reason, count(*) AS n FROM (SELECT entity_type, CASE WHEN entity_type = 'VAT_EU' AND lower(v) IN {tuple(V.COMMON_WORDS)} THEN 'common_word'
WHEN entity_type IN ('COMPANY_NUMBER_UK', 'DRIVER_LICENSE_US') AND regexp_matches(substr(c, 1, length(c) // 2 + 20), {q(f"(?i)\\b(?:{_LABELS})[\\s:]*$")}) THEN 'reference_label'
WHEN entity_type = 'COMPANY_NUMBER_UK' AND regexp_matches(v, '^\\d{{0,7}}$') AND NOT regexp_matches(c, {q(V.COMPANY_WORDS)}) THEN 'short_number'
WHEN entity_type = 'DRIVER_LICENSE_US' AND NOT regexp_matches(c, {q(V.LICENCE_WORDS)}) THEN 'no_licence_word' WHEN entity_type = 'VAT_EU' AND regexp_matches(v, '^\\pL+$') THEN 'letters_only'
WHEN entity_type LIKE 'DATE%' AND regexp_matches(c, {q(V.DATE_WORDS)}) AND NOT regexp_matches(c, {q(V.BIRTH_WORDS)}) THEN 'transaction_date' WHEN entity_type LIKE 'DATE%' AND NOT regexp_matches(c, {q(V.BIRTH_WORDS)}) THEN 'no_birth_word' END AS fp_reason FROM s) GROUP BY 1, 2""")
def suppression_reasons(spark, sf_dir) -> DataFrame:
    d = D.suppressed(D.detect(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), types=_DENY))
    return d.groupBy("entity_type", "fp_reason").agg(F.count("*").alias("n"))


_FILTER_KINDS = ["EMAIL", "IPV4", "DATE_OF_BIRTH_ISO", "DATE_OF_BIRTH_MDY", "EIN", "GST_NUMBER", "VAT_EU"]


def _filter_inputs(spark, sf_dir) -> DataFrame:
    """Detections in blocks and names in cells, filtered by what the tables and cells of their document tell."""
    b = read(spark, sf_dir, "extracted_blocks").select("doc_id", "block_id", "text", "block_type", "col_header", "table_id").distinct()
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("is_scanned"), 0.4).otherwise(0.9).alias("schema_confidence"))
    found = D.detect(b.select("doc_id", "block_id", "text"), types=_FILTER_KINDS).withColumn("near", X.around("text", "start", "end", 200)).select("doc_id", "block_id", "entity_type", "value", "near")
    cells = b.where("block_type = 'table_cell' and text is not null and col_header is not null")
    named = cells.where("col_header in ('Employee', 'Member name', 'Contact', 'Department')").select("doc_id", "block_id", F.lit("ORGANIZATION").alias("entity_type"), F.col("text").alias("value"), F.lit("").alias("near"))
    every = found.unionByName(named).join(docs, "doc_id")
    fields = cells.where("col_header in ('Mail', 'Ref')").select("doc_id", F.col("text").alias("value"), (F.col("col_header") == "Mail").alias("is_pii"), F.array().cast("array<string>").alias("suppress_types"), F.lit("EMAIL_ADDRESS").alias("override"), F.col("block_id").alias("seq"))
    people = cells.where("col_header in ('Employee', 'Member name', 'Contact')").select("doc_id", F.col("text").alias("name"))
    dates = b.where("block_type = 'prose'").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b(?:issued|posted|dated|on|of) ([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})"), F.lit(1))).alias("value"), F.lit(False).alias("is_pii"))
    hints = cells.where("col_header = 'Tag'").select("doc_id", F.col("text").alias("hint"))
    heads = cells.select("doc_id", "table_id", F.col("col_header").alias("h"), F.col("col_header").isin("Mail", "E-mail", "Tel.", "Phone", "Mobile", "Employee", "Member name", "Contact").alias("pii")).distinct()
    per = heads.groupBy("doc_id", "table_id").agg(F.max("pii").alias("has_pii"), F.array_compact(F.collect_list(F.when(~F.col("pii"), F.col("h")))).alias("plain"), F.array_compact(F.collect_list(F.when(F.col("pii"), F.col("h")))).alias("personal"))
    tables = per.withColumn("table_no", F.pmod(F.crc32("table_id"), F.lit(2**31 - 1)).cast("int")).select("doc_id", "table_no", "has_pii", "plain", "personal")
    return D.schema_filter(every, fields, dates, people, hints, tables)


_FILTERED = f"""WITH b AS (SELECT DISTINCT doc_id, block_id, text, block_type, col_header, table_id FROM extracted_blocks), c AS (SELECT * FROM b WHERE block_type = 'table_cell' AND text IS NOT NULL AND col_header IS NOT NULL),
f AS (SELECT doc_id, block_id, entity_type, value, substr(text, greatest(start - 200, 0)::BIGINT + 1, (least(start + length(value) + 200, length(text)) - greatest(start - 200, 0))::BIGINT) AS near FROM ({spans_sql('b', _FILTER_KINDS, 'doc_id, block_id')})
  UNION ALL SELECT doc_id, block_id, 'ORGANIZATION', text, '' FROM c WHERE col_header IN ('Employee', 'Member name', 'Contact', 'Department')),
d AS (SELECT row_number() OVER () AS id, f.*, CASE WHEN is_scanned THEN 0.4 ELSE 0.9 END AS confidence FROM f JOIN documents USING (doc_id)),
fields AS (SELECT doc_id, lower(trim(text)) AS k, col_header = 'Mail' AS pii, block_id AS seq FROM c WHERE col_header IN ('Mail', 'Ref')),
r1 AS (SELECT id, arg_min(CASE WHEN pii THEN 'reclassify' ELSE 'suppress' END, seq) AS act FROM d JOIN fields e ON e.doc_id = d.doc_id AND e.k = lower(trim(d.value)) WHERE NOT pii OR entity_type <> 'EMAIL_ADDRESS' GROUP BY 1),
t AS (SELECT doc_id, table_id, bool_or(p) AS has_pii, coalesce(list(h) FILTER (NOT p), []) AS plain, coalesce(list(h) FILTER (p), []) AS personal FROM (SELECT DISTINCT doc_id, table_id, col_header AS h, col_header IN ('Mail', 'E-mail', 'Tel.', 'Phone', 'Mobile', 'Employee', 'Member name', 'Contact') AS p FROM c) GROUP BY 1, 2),
h AS (SELECT doc_id, flatten(list(plain)) AS any_plain FROM t GROUP BY 1),
r2 AS (SELECT DISTINCT id FROM d JOIN t USING (doc_id) JOIN h USING (doc_id) WHERE len(any_plain) > 0 AND CASE WHEN has_pii THEN len(list_filter(plain, lambda x: regexp_matches(near, '(?i)' || regexp_escape(trim(x)) || '\\b'))) > 0 AND len(list_filter(personal, lambda x: regexp_matches(near, '(?i)' || regexp_escape(trim(x)) || '\\b'))) = 0
  ELSE len(list_filter(any_plain, lambda x: regexp_matches(near, '(?i)\\b' || regexp_escape(trim(x)) || '\\b'))) > 0 END),
dates AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\b(?:issued|posted|dated|on|of) ([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1)) AS v FROM b WHERE block_type = 'prose'),
people AS (SELECT DISTINCT doc_id, lower(trim(text)) AS k FROM c WHERE col_header IN ('Employee', 'Member name', 'Contact')), hints AS (SELECT doc_id, list(DISTINCT lower(text)) AS hs FROM c WHERE col_header = 'Tag' GROUP BY 1),
x AS (SELECT d.*, r1.act, CASE WHEN confidence < 0.5 THEN NULL WHEN r1.act IS NOT NULL THEN 'field_map' WHEN r2.id IS NOT NULL THEN 'table' WHEN contains(upper(entity_type), 'DATE') AND dates.v IS NOT NULL THEN 'date' WHEN entity_type = 'ORGANIZATION' AND people.k IS NOT NULL THEN 'person'
  WHEN len(list_filter(coalesce(hs, []), lambda y: contains(y, lower(trim(value))) OR contains(lower(trim(value)), y))) > 0 THEN 'hint' END AS rule FROM d LEFT JOIN r1 USING (id) LEFT JOIN r2 ON r2.id = d.id LEFT JOIN dates ON dates.doc_id = d.doc_id AND dates.v = trim(value) LEFT JOIN people ON people.doc_id = d.doc_id AND people.k = lower(trim(value)) LEFT JOIN hints ON hints.doc_id = d.doc_id),
z AS (SELECT *, CASE WHEN rule IS NULL THEN 'keep' WHEN rule = 'field_map' THEN act WHEN rule = 'person' THEN 'reclassify' ELSE 'suppress' END AS action, CASE WHEN rule = 'field_map' AND act = 'reclassify' THEN 'EMAIL_ADDRESS' WHEN rule = 'person' THEN 'PERSON' END AS new_type FROM x)
"""


@query(_FILTERED + "SELECT entity_type, action, rule, new_type, count(*) AS n FROM z GROUP BY 1, 2, 3, 4")
def schema_filtered(spark, sf_dir) -> DataFrame:
    return _filter_inputs(spark, sf_dir).groupBy("entity_type", "action", "rule", "new_type").agg(F.count("*").alias("n"))


@query(_FILTERED + "SELECT doc_id, entity_type, CASE WHEN length(value) <= 4 THEN repeat('*', length(value)) ELSE repeat('*', length(value) - 4) || right(value, 4) END AS detected_text, action, rule AS reason, new_type FROM z WHERE rule IS NOT NULL")
def suppression_log(spark, sf_dir) -> DataFrame:
    return D.suppression_log(_filter_inputs(spark, sf_dir))


@query("SELECT region, count(*) AS n_patterns FROM (SELECT unnest([" + ", ".join(f"'{p[3]}'" for p in V.PATTERNS) + "]) AS region) GROUP BY 1")
def pattern_regions(spark, sf_dir) -> DataFrame:
    """The regions that patterns are for, with how many each has."""
    return spark.createDataFrame([(r, sum(p[3] == r for p in V.PATTERNS)) for r in D.regions()], "region string, n_patterns bigint")


_UK = [p[0] for p in D.chosen(["UK"]) if p[0] not in LOOKAROUND]


@query(" UNION ALL ".join(f"SELECT '{k}' AS entity_type, sum(len(regexp_extract_all(text, {q(pattern(k))})))::BIGINT AS n_matches, count(*) AS n_texts FROM documents WHERE regexp_matches(text, {q(pattern(k))}) HAVING count(*) > 0" for k in _UK))
def detect_region_counts(spark, sf_dir) -> DataFrame:
    """Matches of the patterns of one region and of those that hold everywhere."""
    return D.counts(spread(read(spark, sf_dir, "documents").select("text")), types=_UK)


_REPORT = " UNION ALL ".join(f"SELECT doc_id, page_or_sheet, '{k}' AS k, {dict((p[0], p[2]) for p in V.PATTERNS)[k]} AS s, unnest(regexp_extract_all(text, {q(pattern(k))})) AS v FROM b WHERE text IS NOT NULL" for k in CORE)


@query(f"""WITH b AS (SELECT DISTINCT doc_id, block_id, page_or_sheet, file_type, text FROM extracted_blocks), h AS (SELECT doc_id, page_or_sheet, count(*) AS pii_hits, count(*) FILTER (s < 0.75) AS low_confidence, count(DISTINCT k) AS n_types FROM ({_REPORT}) GROUP BY 1, 2)
SELECT doc_id, page_or_sheet, CASE WHEN bool_or(lower(file_type) IN ('csv', 'xlsx', 'xls', 'parquet', 'avro')) THEN 'sheet' ELSE 'digital' END AS page_type, count(*) AS blocks_extracted, coalesce(any_value(pii_hits), 0) AS pii_hits, coalesce(any_value(low_confidence), 0) AS low_confidence, coalesce(any_value(n_types), 0) AS n_types FROM b LEFT JOIN h USING (doc_id, page_or_sheet) GROUP BY 1, 2""")
def page_reports(spark, sf_dir) -> DataFrame:
    b = read(spark, sf_dir, "extracted_blocks").select("doc_id", "block_id", "page_or_sheet", "file_type", "text").distinct()
    r = D.page_report(b, D.detect(b, types=CORE).drop("text"))
    return r.withColumn("n_types", F.coalesce(F.size(F.map_keys("by_type")), F.lit(0))).withColumn("n_types", F.greatest("n_types", F.lit(0)).cast("bigint")).drop("by_type")


_ROLE_SQL = "CASE " + " ".join(f"WHEN section = {q(k)} THEN {q(v)}" for k, v in V.SECTION_ROLES.items()) + " ELSE 'unknown' END"
_HEAD_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, {q('(?i)' + '|'.join(p))}) THEN {q(k)}" for k, p in V.SECTION_HEADINGS.items()) + " " + " ".join(f"WHEN contains(lower(col_header), {q(w)}) THEN {q(k)}" for w, k in V.SECTION_COLUMNS.items()) + " END"


@query(f"""WITH b AS (SELECT DISTINCT doc_id, block_id, text, col_header FROM extracted_blocks WHERE text IS NOT NULL), h AS (SELECT *, {_HEAD_SQL} AS heading FROM b), s AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_id ROWS UNBOUNDED PRECEDING) AS section FROM h)
SELECT entity_type, role, count(*) AS n FROM (SELECT block_id, {_ROLE_SQL} AS role FROM s) JOIN ({spans_sql('b', CORE, 'block_id')}) USING (block_id) GROUP BY 1, 2""")
def detection_roles(spark, sf_dir) -> DataFrame:
    """Detections by the role of the section they stand in."""
    b = read(spark, sf_dir, "extracted_blocks").where("text is not null").select("doc_id", "block_id", "text", "col_header").distinct()
    return S.with_roles(D.detect(b, types=CORE).drop("text"), S.block_roles(b)).groupBy("entity_type", F.col("entity_role").alias("role")).agg(F.count("*").alias("n"))


# ---- text functions

_ENDS = lambda c, a, b: f"CASE WHEN length({c}) <= {a + b} THEN repeat('*', length({c})) ELSE left({c}, {a}) || repeat('*', length({c}) - {a + b}) || right({c}, {b}) END"


@query(f"""SELECT subject_id, {_ENDS('canonical_name', 2, 2)} AS name_ends, {_ENDS('canonical_name', 0, 4)} AS name_last, CASE WHEN coalesce(canonical_email, '') = '' THEN '' ELSE '***@***.***' END AS email,
CASE WHEN coalesce(canonical_phone, '') = '' THEN '' WHEN length(regexp_replace(canonical_phone, '\\D', '', 'g')) < 4 THEN '***' ELSE '***-***-' || right(regexp_replace(canonical_phone, '\\D', '', 'g'), 4) END AS phone FROM notification_subjects""")
def masked_subjects(spark, sf_dir) -> DataFrame:
    s = read(spark, sf_dir, "notification_subjects")
    return s.select("subject_id", X.mask_ends("canonical_name", 2, 2).alias("name_ends"), X.mask_ends("canonical_name", 0, 4).alias("name_last"), X.mask_email("canonical_email").alias("email"), X.mask_phone("canonical_phone").alias("phone"))


@query(f"SELECT record_id, {_ENDS('normalized_value', 2, 2)} AS stored_value, sha256('pepper:' || normalized_value) AS value_hash, 'hash' AS storage_policy FROM pii_records WHERE trim(normalized_value) <> ''")
def storage_strict(spark, sf_dir) -> DataFrame:
    r = read(spark, sf_dir, "pii_records").where("trim(normalized_value) <> ''").select("record_id", F.col("normalized_value").alias("value"), "normalized_value")
    return sinks.stored(r, "pepper").select("record_id", "stored_value", "value_hash", "storage_policy")


def _chain(c: str, rules: list[tuple[str, str]]) -> str:
    for p, to in rules:
        c = f"regexp_replace({c}, {q(p)}, {q(to)}, 'g')"
    return c


@query(f"SELECT log_id, {_chain('prompt_text', V.OUTBOUND_MASKS)} AS masked FROM llm_call_logs")
def outbound_masks(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "llm_call_logs").select("log_id", X.mask_outbound("prompt_text").alias("masked"))


_SCRUB = _chain("prompt_text", [(p, "[REDACTED]") for p in V.LOG_SCRUBS] + [(r"(?i)(raw_value(?:_encrypted)?\s*[=:]\s*)([^,\s]+)", r"\1[REDACTED]")])


@query(f"SELECT log_id, {_SCRUB} AS scrubbed, " + " OR ".join(f"regexp_matches(prompt_text, {q(p)})" for p in V.LOG_SCRUBS) + " AS holds_personal FROM llm_call_logs")
def scrubbed_logs(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "llm_call_logs").select("log_id", X.scrub_log("prompt_text").alias("scrubbed"), X.holds_personal("prompt_text").alias("holds_personal"))


_MAIL = "lower(trim(raw_email))"


@query(f"""SELECT record_id, raw_email, CASE WHEN instr({_MAIL}, '@') = 0 THEN {_MAIL} WHEN substr({_MAIL}, instr({_MAIL}, '@') + 1) IN ('gmail.com', 'googlemail.com')
THEN replace(left({_MAIL}, instr({_MAIL}, '@') - 1), '.', '') || '@' || substr({_MAIL}, instr({_MAIL}, '@') + 1) ELSE {_MAIL} END AS email FROM pii_records WHERE raw_email IS NOT NULL""")
def normal_emails(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "pii_records").where("raw_email is not null").select("record_id", "raw_email", N.email("raw_email").alias("email"))


_P = "string_split(regexp_replace(v, '[-./]', '/', 'g'), '/')"
_YEAR = f"CASE WHEN length({_P}[3]) = 2 THEN CASE WHEN {_P}[3]::INT < 30 THEN 2000 + {_P}[3]::INT ELSE 1900 + {_P}[3]::INT END ELSE {_P}[3]::INT END"
_ISO = lambda y, m, d: f"strftime(try_strptime(lpad(({y})::VARCHAR, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0'), '%Y-%m-%d'), '%Y-%m-%d')"


@query(f"""WITH r AS (SELECT record_id, raw_dob, trim(raw_dob) AS v, upper(coalesce(country, 'US')) AS c FROM pii_records WHERE raw_dob IS NOT NULL)
SELECT record_id, raw_dob, CASE WHEN regexp_matches(v, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN {_ISO(f'{_P}[1]', f'{_P}[2]', f'{_P}[3]')}
WHEN regexp_matches(v, '^\\d{{1,2}} [A-Za-z]{{3}} \\d{{4}}$') THEN strftime(try_strptime(v, '%d %b %Y'), '%Y-%m-%d') WHEN regexp_matches(v, '^\\d{{1,2}} [A-Za-z]{{4,}} \\d{{4}}$') THEN strftime(try_strptime(v, '%d %B %Y'), '%Y-%m-%d')
WHEN regexp_matches(v, '^[A-Za-z]{{3}} \\d{{1,2}}, \\d{{4}}$') THEN strftime(try_strptime(v, '%b %d, %Y'), '%Y-%m-%d') WHEN regexp_matches(v, '^[A-Za-z]{{4,}} \\d{{1,2}}, \\d{{4}}$') THEN strftime(try_strptime(v, '%B %d, %Y'), '%Y-%m-%d')
WHEN regexp_matches(v, '^\\d{{1,2}}[-./]\\d{{1,2}}[-./]\\d{{1,4}}$') THEN CASE WHEN c IN ('US', 'PH') THEN {_ISO(_YEAR, f'{_P}[1]', f'{_P}[2]')} ELSE {_ISO(_YEAR, f'{_P}[2]', f'{_P}[1]')} END
WHEN regexp_matches(v, '^\\d{{4}}[-./]\\d{{1,2}}[-./]\\d{{1,4}}$') THEN {_ISO(f'{_P}[1]', f'{_P}[2]', f'{_P}[3]')} END AS dob FROM r""")
def normal_dobs(spark, sf_dir) -> DataFrame:
    r = read(spark, sf_dir, "pii_records").where("raw_dob is not null")
    return r.select("record_id", "raw_dob", N.dob("raw_dob", F.coalesce("country", F.lit("US"))).alias("dob"))


_TRIM = lambda c: f"regexp_replace({c}, '^[\\s\\p{{Z}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{85}}]+$', '', 'g')"
_COLLAPSE = lambda c: f"regexp_replace({c}, '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g')"


def soundex_sql(c: str) -> str:
    s = f"regexp_replace(upper(regexp_replace({c}, '[^A-Za-z]', '', 'g')), '[^A-Z]', '', 'g')"
    runs = f"translate({s}, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000')"
    for d in "0123456":
        runs = f"regexp_replace({runs}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {s} = '' THEN '0000' ELSE rpad(left({s}, 1) || replace(substr({runs}, 2), '0', ''), 4, '0') END"


def title_sql(c: str) -> str:
    return f"array_to_string([upper(left(x, 1)) || lower(substr(x, 2)) FOR x IN regexp_extract_all({c}, '\\pL+|[^\\pL]+')], '')"



def names_sql(source: str) -> str:
    """Common table expressions that end in nn (record_id, raw_name, name): normal names of a table (record_id, raw_name)."""
    return f"""n1 AS (SELECT record_id, raw_name, {_COLLAPSE(_TRIM('raw_name'))} AS v FROM {source} WHERE raw_name IS NOT NULL), n2 AS (SELECT *, regexp_replace(v, {q(V.HONORIFICS)}, '') AS bare FROM n1), n3 AS (SELECT *, [{_TRIM('x')} FOR x IN string_split(bare, ',')] AS ps FROM n2),
n4 AS (SELECT *, len(ps) = 2 AND len(list_filter(ps, lambda x: x = '' OR regexp_matches(x, '\\p{{Nd}}') OR regexp_matches(x, {q(V.NON_LATIN)}) OR lower(x) IN ({", ".join(map(q, V.PLACES))}))) = 0 AS turned FROM n3),
nn AS (SELECT record_id, raw_name, CASE WHEN regexp_matches(v, {q(V.NON_LATIN)}) THEN v ELSE {title_sql(_COLLAPSE(_TRIM("CASE WHEN turned THEN regexp_replace(ps[2] || ' ', " + q(V.HONORIFICS) + ", '') || ps[1] ELSE bare END")))} END AS name FROM n4)"""


@query(f"WITH {names_sql('pii_records')} SELECT record_id, raw_name, name, {soundex_sql('raw_name')} AS code FROM nn")
def normal_names(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "pii_records").where("raw_name is not null").select("record_id", "raw_name", N.name("raw_name").alias("name"), soundex("raw_name").alias("code"))


@query("""WITH r AS (SELECT record_id, raw_phone, regexp_replace(raw_phone, '(?i)\\s*(?:x|ext\\.?)\\s*\\d+\\s*$', '') AS v FROM pii_records WHERE raw_phone IS NOT NULL),
d AS (SELECT *, regexp_matches(trim(v), '^(\\+|00)') AS plus, regexp_replace(regexp_replace(regexp_replace(v, '\\(0\\)', '', 'g'), '^\\s*00', '+'), '\\D', '', 'g') AS d FROM r)
SELECT record_id, raw_phone, CASE WHEN plus AND regexp_matches(d, '^[1-9]\\d{6,14}$') AND (d[1] <> '1' OR regexp_matches(d, '^1[2-9]\\d{2}[2-9]\\d{6}$')) THEN '+' || d
WHEN NOT plus AND regexp_matches(d, '^1?([2-9]\\d{2}[2-9]\\d{6})$') THEN '+1' || regexp_extract(d, '^1?([2-9]\\d{2}[2-9]\\d{6})$', 1) END AS phone FROM d""")
def normal_phones(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "pii_records").where("raw_phone is not null").select("record_id", "raw_phone", N.phone("raw_phone").alias("phone"))


def jaro_winkler_sql(source: str) -> str:
    """Common table expressions jr and jw (x, y, s) with the similarity of distinct pairs of a table (x, y); half transpositions count."""
    return f"""jr AS (SELECT x, y, 0 AS i, repeat('0', length(y)) AS used, '' AS seen FROM {source} UNION ALL
SELECT x, y, i + 1, CASE WHEN js IS NULL THEN used ELSE left(used, js - 1) || '1' || substr(used, js + 1) END, CASE WHEN js IS NULL THEN seen ELSE seen || x[i + 1] END
FROM (SELECT x, y, i, used, seen, list_min(list_filter(range(greatest(1, i + 1 - greatest(greatest(length(x), length(y)) // 2 - 1, 0)), least(length(y), i + 1 + greatest(greatest(length(x), length(y)) // 2 - 1, 0)) + 1), lambda k: used[k] = '0' AND y[k] = x[i + 1]))::INT AS js FROM jr WHERE i < length(x))),
jm AS (SELECT x, y, seen, length(seen) AS m, array_to_string(list_transform(list_filter(range(1, length(y) + 1), lambda k: used[k] = '1'), lambda k: y[k]), '') AS other FROM jr WHERE i = length(x)),
jj AS (SELECT x, y, CASE WHEN x = y THEN 1.0 WHEN m = 0 THEN 0.0 ELSE (m::DOUBLE / length(x) + m::DOUBLE / length(y) + (m - len(list_filter(range(1, m + 1), lambda k: seen[k] <> other[k])) / 2.0)::DOUBLE / m) / 3 END AS j,
  CASE WHEN x[1:4] = y[1:4] THEN least(4, length(x), length(y)) WHEN x[1:3] = y[1:3] THEN 3 WHEN x[1:2] = y[1:2] THEN 2 WHEN x[1] = y[1] THEN 1 ELSE 0 END AS p FROM jm),
jw AS MATERIALIZED (SELECT x, y, (j + p * 0.1 * (1 - j))::DOUBLE AS s FROM jj)"""


_NAMES = "|".join(sorted(N.STATES, key=len, reverse=True))
_SHORT = "|".join(sorted(set(N.STATES.values())))
_COUNTRY = "CASE " + " ".join(f"WHEN regexp_matches(v, {q(p)}) THEN '{c}'" for p, c in V.COUNTRY_WORDS) + f" WHEN regexp_matches(v, {q(N.POSTAL['GB'])}) THEN 'GB' WHEN regexp_matches(v, {q(N.POSTAL['IN'])}) THEN 'IN' WHEN regexp_matches(v, {q(N.POSTAL['CA'])}) THEN 'CA' WHEN regexp_matches(v, {q(f'(?i){chr(92)}b(?:{_NAMES}){chr(92)}b')}) THEN 'US' WHEN regexp_matches(v, {q(f'{chr(92)}b(?:{_SHORT}){chr(92)}b')}) THEN 'US' WHEN regexp_matches(v, {q(N.POSTAL['US'])}) THEN 'US' END"
_PICK = lambda of: "CASE l " + " ".join(f"WHEN '{k}' THEN {of(p)}" for k, p in N.POSTAL.items()) + f" ELSE {of(N.POSTAL['US'])} END"
_BEFORE = lambda p: "(?s)" + ("(?i)" if p.startswith("(?i)") else "") + "^(.*?)" + p.removeprefix("(?i)")
_END, _END2 = f"(?i)(?:^|[,\\s]+)({_NAMES})\\s*$", f"(?i)(?:^|[,\\s]+)({_SHORT})\\s*$"
_STATE = "CASE lower(regexp_extract(t, " + q(_END) + ", 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.STATES.items()) + " END"


@query(f"""WITH r AS (SELECT DISTINCT record_id, normalized_value, {_TRIM('normalized_value')} AS v FROM pii_records WHERE entity_type = 'ADDRESS' AND normalized_value IS NOT NULL), c AS (SELECT *, {_COUNTRY} AS country, coalesce({_COUNTRY}, 'US') AS l FROM r),
z AS (SELECT *, {_PICK(lambda p: f"regexp_extract(v, {q(p)}, 1)")} AS code, {_PICK(lambda p: f"regexp_extract(v, {q(_BEFORE(p))}, 1)")} AS before FROM c), t AS (SELECT *, CASE WHEN code <> '' THEN regexp_replace(before, '[, ]+$', '') ELSE v END AS t FROM z),
s AS (SELECT *, CASE WHEN l = 'US' THEN coalesce({_STATE}, nullif(upper(regexp_extract(t, {q(_END2)}, 1)), '')) END AS state, CASE WHEN l = 'US' AND regexp_matches(t, {q(_END)}) THEN regexp_replace(t, {q(_END)}, '') WHEN l = 'US' THEN regexp_replace(t, {q(_END2)}, '') ELSE t END AS rest FROM t),
p AS (SELECT *, list_filter([lower({_TRIM('x')}) FOR x IN string_split(rest, ',')], lambda x: x <> '') AS ps, regexp_matches(v, '\\b\\d+\\s+\\w') OR code <> '' AS ok FROM s)
SELECT record_id, normalized_value, country, CASE WHEN ok THEN ps[1] END AS street, CASE WHEN ok THEN ps[2] END AS city, CASE WHEN ok THEN state END AS state, CASE WHEN ok THEN nullif(CASE WHEN l IN ('GB', 'CA', 'US') THEN upper(replace(code, ' ', '')) ELSE code END, '') END AS zip FROM p""")
def normal_addresses(spark, sf_dir) -> DataFrame:
    r = read(spark, sf_dir, "pii_records").where("entity_type = 'ADDRESS' and normalized_value is not null").select("record_id", "normalized_value").distinct()
    a = r.withColumn("country", N.country_of("normalized_value")).withColumn("a", N.address("normalized_value"))
    return a.select("record_id", "normalized_value", "country", "a.street", "a.city", "a.state", "a.zip")


@query(f"""WITH RECURSIVE n AS (SELECT record_id, lower(raw_name) AS x, lower(normalized_value) AS y FROM pii_records WHERE raw_name <> '' AND normalized_value <> ''), u AS (SELECT DISTINCT x, y FROM n), {jaro_winkler_sql("u")} SELECT record_id, round(s, 6) AS similarity FROM n JOIN jw USING (x, y)""")
def name_similarity(spark, sf_dir) -> DataFrame:
    """Jaro-Winkler of raw and normalised values."""
    r = read(spark, sf_dir, "pii_records").where("raw_name <> '' and normalized_value <> ''")
    return r.select("record_id", F.round(jaro_winkler(F.lower("raw_name"), F.lower("normalized_value")), 6).alias("similarity"))


# ---- structure


@query("SELECT sha256, doc_id FROM (SELECT lower(sha256) AS sha256, doc_id, row_number() OVER (PARTITION BY lower(sha256) ORDER BY doc_id) AS n FROM documents WHERE trim(sha256) <> '') WHERE n = 1")
def discovery_first_seen(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("trim(sha256) <> ''").select(F.lower("sha256").alias("sha256"), "doc_id")
    return R.first_seen(d, ["doc_id"])


_CLASS = "CASE " + " ".join(f"WHEN lower(trim(coalesce(file_type, ''))) IN ({', '.join(map(q, v))}) THEN {q(k)}" for k, v in V.STRUCTURE_CLASSES.items()) + " ELSE 'non-extractable' END"


@query(f"SELECT file_type, structure_class, structure_class <> 'non-extractable' AS can_auto_process, count(*) AS n FROM (SELECT file_type, {_CLASS} AS structure_class FROM documents) GROUP BY 1, 2, 3")
def catalog_classes(spark, sf_dir) -> DataFrame:
    return S.catalogued(read(spark, sf_dir, "documents")).groupBy("file_type", "structure_class", "can_auto_process").agg(F.count("*").alias("n"))


@query("SELECT page_class, count(*) AS n FROM (SELECT CASE WHEN w > 50 THEN 'digital' WHEN w > 5 THEN 'corrupted' ELSE 'scanned' END AS page_class FROM (SELECT len(list_filter(string_split_regex(text, '[\\s\\x{00A0}\\x{2007}\\x{202F}]+'), lambda x: x <> '')) AS w FROM extracted_blocks WHERE block_type = 'prose' AND text IS NOT NULL)) GROUP BY 1")
def page_classes(spark, sf_dir) -> DataFrame:
    b = read(spark, sf_dir, "extracted_blocks").where("block_type = 'prose' and text is not null")
    return b.groupBy(S.page_class(F.col("text")).alias("page_class")).agg(F.count("*").alias("n"))


_KINDS = ", ".join(f"{{'k': {q(k)}, 'p': {i}, 'n': len(list_filter({words(ws)}, lambda w: contains(c, w)))}}" for i, (k, ws) in enumerate(V.DOCUMENT_WORDS.items()))


@query(f"""WITH b AS (SELECT DISTINCT doc_id, block_id, text, page_or_sheet FROM extracted_blocks WHERE text IS NOT NULL AND (try_cast(page_or_sheet AS INT) IS NULL OR try_cast(page_or_sheet AS INT) <= 5)), d AS (SELECT doc_id, string_agg(lower(text), ' ' ORDER BY block_id) AS c FROM b GROUP BY 1),
k AS (SELECT doc_id, len(list_filter(string_split_regex(c, '[\\s\\p{{Z}}\\x{{85}}]+'), lambda x: x <> '')) AS w, list_sort([{_KINDS}], 'ASC') AS ks FROM d), u AS (SELECT doc_id, w, unnest(ks) AS s FROM k), r AS (SELECT doc_id, w, s.k AS k, s.n AS n, row_number() OVER (PARTITION BY doc_id ORDER BY s.n DESC, s.p) AS i FROM u)
SELECT doc_id, CASE WHEN a.n = 0 THEN 'unknown' ELSE a.k END AS document_type, CASE WHEN a.n = 0 THEN 0.0 ELSE round(greatest(0.3, least(0.95, least(1.0, a.n::DOUBLE / greatest(a.w, 1) * 50 + (a.n - b.n)::DOUBLE / a.n * 0.5))), 6) END AS confidence FROM r a JOIN r b USING (doc_id) WHERE a.i = 1 AND b.i = 2""")
def document_types(spark, sf_dir) -> DataFrame:
    return S.document_type(read(spark, sf_dir, "extracted_blocks").where("text is not null").select("doc_id", "block_id", "text", "page_or_sheet").distinct())


_HEAD = "CASE " + " ".join(f"WHEN regexp_matches(text, {q('(?i)' + '|'.join(p))}) THEN {q(k)}" for k, p in V.SECTION_HEADINGS.items()) + " " + " ".join(f"WHEN contains(lower(col_header), {q(w)}) THEN {q(k)}" for w, k in V.SECTION_COLUMNS.items()) + " END"
_ROLE = "CASE " + " ".join(f"WHEN section = {q(k)} THEN {q(v)}" for k, v in V.SECTION_ROLES.items()) + " ELSE 'unknown' END"


@query(f"""WITH b AS (SELECT DISTINCT doc_id, block_id, text, col_header FROM extracted_blocks WHERE text IS NOT NULL), h AS (SELECT *, {_HEAD} AS heading FROM b), s AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_id ROWS UNBOUNDED PRECEDING) AS section FROM h)
SELECT block_id, section, {_ROLE} AS role FROM s""")
def section_roles(spark, sf_dir) -> DataFrame:
    b = read(spark, sf_dir, "extracted_blocks").where("text is not null").select("doc_id", "block_id", "text", "col_header").distinct()
    return S.sections(b).select("block_id", "section", "role")


def _pages(spark, sf_dir) -> DataFrame:
    b = read(spark, sf_dir, "extracted_blocks").where("block_type = 'prose' and text is not null").select("doc_id", "block_id", "text", F.expr("try_cast(page_or_sheet as int)").alias("page"))
    return b.where("page is not null").distinct()


_PAGES = "(SELECT DISTINCT doc_id, block_id, text, try_cast(page_or_sheet AS INT) AS page FROM extracted_blocks WHERE block_type = 'prose' AND text IS NOT NULL AND try_cast(page_or_sheet AS INT) IS NOT NULL)"
_SIG = "(" + " OR ".join(f"regexp_matches(text, {q(p)})" for p in V.ONSET_SIGNALS) + ")"


@query(f"SELECT doc_id, greatest(coalesce(min(page) FILTER ({_SIG}) - 1, 0), 0) AS onset FROM {_PAGES} GROUP BY 1")
def onset_pages(spark, sf_dir) -> DataFrame:
    return S.onset(_pages(spark, sf_dir))


@query(f"SELECT doc_id, page, rank FROM (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY first)::INT AS rank FROM (SELECT doc_id, page, min(block_id) AS first FROM {_PAGES} WHERE {_SIG} GROUP BY 1, 2)) WHERE rank <= 5")
def candidate_pages(spark, sf_dir) -> DataFrame:
    return S.candidate_pages(_pages(spark, sf_dir)).select("doc_id", "page", "rank")


_SURE = [p for p in V.PATTERNS if p[2] >= 0.70]
_NINO = pattern("NATIONAL_INSURANCE_UK").replace("(?!BG|GB|NK|KN|TN|NT|ZZ)", "")
_OWN = {"PHONE_US": "regexp_matches(text, " + q("(?:^|[^\\pL\\p{Nd}_])" + pattern("PHONE_US").removeprefix(r"(?<!\w)").removesuffix(r"(?!\w)") + "(?:$|[^\\pL\\p{Nd}_])") + ")",
        "NATIONAL_INSURANCE_UK": f"len(list_filter(regexp_extract_all(text, {q(_NINO)}), lambda x: left(x, 2) NOT IN ('BG', 'GB', 'NK', 'KN', 'TN', 'NT', 'ZZ'))) > 0"}
_SURE_SQL = " OR ".join(_OWN.get(p[0], f"regexp_matches(text, {q(p[1])})") for p in _SURE)


@query(f"""WITH p AS (SELECT * FROM {_PAGES}), sure AS (SELECT DISTINCT doc_id, page FROM p WHERE {_SURE_SQL}), c AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY min(block_id)) AS r FROM p WHERE {_SIG} GROUP BY 1, 2 QUALIFY r <= 5),
t AS (SELECT doc_id, r * 2 AS k, page AS p FROM c UNION ALL SELECT doc_id, r * 2 + 1, page + 1 FROM c), o AS (SELECT doc_id, page AS p, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS r FROM (SELECT DISTINCT doc_id, page FROM p) WHERE (doc_id, page) NOT IN (SELECT doc_id, p FROM t) QUALIFY r <= 20),
f AS (SELECT doc_id, arg_min(p, k) AS o FROM (SELECT * FROM t UNION ALL SELECT doc_id, r + 1000, p FROM o) x WHERE (doc_id, p) IN (SELECT doc_id, page FROM sure) GROUP BY 1) SELECT DISTINCT p.doc_id, coalesce(f.o, 0) AS onset FROM p LEFT JOIN f USING (doc_id)""")
def verified_onsets(spark, sf_dir) -> DataFrame:
    p = _pages(spark, sf_dir)
    found = D.detect(p, types=[x[0] for x in _SURE]).select("doc_id", "page", "score")
    return S.verified_onset(p, found)


@query(f"""WITH b AS (SELECT DISTINCT doc_id, block_id, text, page_or_sheet, file_type FROM extracted_blocks WHERE text IS NOT NULL) SELECT doc_id, coalesce(arg_min(page_or_sheet, block_id) FILTER ({_SIG} AND lower(file_type) NOT IN ('csv', 'xlsx', 'xls', 'parquet', 'avro')), '0') AS onset FROM b GROUP BY 1""")
def block_onsets(spark, sf_dir) -> DataFrame:
    return S.block_onset(_kinds_of_blocks(spark, sf_dir))


def _kinds_of_blocks(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "extracted_blocks").where("text is not null").select("doc_id", "block_id", "text", "page_or_sheet", "file_type").distinct()


@query(f"""WITH b AS (SELECT DISTINCT doc_id, block_id, text, page_or_sheet, lower(file_type) AS f FROM extracted_blocks WHERE text IS NOT NULL), o AS (SELECT doc_id, CASE WHEN bool_or(f IN ('csv', 'xlsx', 'xls', 'parquet', 'avro')) THEN arg_min(page_or_sheet, block_id) ELSE coalesce(arg_min(page_or_sheet, block_id) FILTER ({_SIG}), arg_min(page_or_sheet, block_id)) END AS onset FROM b GROUP BY 1),
x AS (SELECT *, page_or_sheet = onset AS here, min(block_id) FILTER (page_or_sheet = onset) OVER (PARTITION BY doc_id) AS first FROM b JOIN o USING (doc_id)), s AS (SELECT block_id, f, row_number() OVER (PARTITION BY doc_id ORDER BY block_id)::INT AS sample_no FROM x WHERE CASE WHEN f = 'pdf' OR f IN ('csv', 'xlsx', 'xls', 'parquet', 'avro') THEN here ELSE block_id >= first END)
SELECT block_id, sample_no FROM s WHERE f = 'pdf' OR sample_no <= CASE WHEN f IN ('csv', 'xlsx', 'xls', 'parquet', 'avro') THEN 50 ELSE 20 END""")
def kind_samples(spark, sf_dir) -> DataFrame:
    """The sample of each document by its kind, from the first sheet of a workbook, else the first page with a signal, else the first."""
    b = _kinds_of_blocks(spark, sf_dir)
    first = b.groupBy("doc_id").agg(F.min_by("page_or_sheet", "block_id").alias("p"), F.max(F.lower("file_type").isin(S.TABULAR)).alias("table"))
    hit = b.where(S.has_signal(F.col("text"))).groupBy("doc_id").agg(F.min_by("page_or_sheet", "block_id").alias("h"))
    on = first.join(hit, "doc_id", "left").select("doc_id", F.when(F.col("table"), F.col("p")).otherwise(F.coalesce("h", "p")).alias("onset"))
    return S.sample_blocks(b, on).select("block_id", "sample_no")


@query(f"WITH o AS (SELECT doc_id, greatest(coalesce(min(page) FILTER ({_SIG}) - 1, 0), 0) AS onset FROM {_PAGES} GROUP BY 1) SELECT block_id, sample_no FROM (SELECT block_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_id)::INT AS sample_no FROM {_PAGES} JOIN o USING (doc_id) WHERE page >= onset) WHERE sample_no <= 20")
def sample_blocks(spark, sf_dir) -> DataFrame:
    p = _pages(spark, sf_dir)
    return S.sampled(p, S.onset(p)).select("block_id", "sample_no")


@query(f"""WITH l AS (SELECT block_id, text, string_split_regex(lag(text) OVER (PARTITION BY doc_id ORDER BY page, block_id), '\\r\\n|\\n') AS b FROM {_PAGES}), t AS (SELECT block_id, text, array_to_string(b[greatest(len(b) - 4, 1):], chr(10)) AS tail FROM l)
SELECT block_id, coalesce(length(tail), 0)::INT AS tail_len, sha256(CASE WHEN tail IS NULL THEN text ELSE tail || chr(10) || text END) AS stitched FROM t""")
def stitched_pages(spark, sf_dir) -> DataFrame:
    p = _pages(spark, sf_dir).withColumn("o", F.struct("page", "block_id"))
    return S.stitched(p, page="o").select("block_id", "tail_len", F.sha2("stitched", 256).alias("stitched"))


_FORM = "(?i)^(?:" + "|".join(V.ID_FORMS) + ")$"


@query(f"SELECT table_id, column_no, round(avg(CASE WHEN regexp_matches(trim(text), {q(_FORM)}) THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n, avg(CASE WHEN regexp_matches(trim(text), {q(_FORM)}) THEN 1.0 ELSE 0.0 END) > 0.8 AS review FROM extracted_blocks WHERE block_type = 'table_cell' AND trim(text) <> '' GROUP BY 1, 2")
def id_columns(spark, sf_dir) -> DataFrame:
    return S.id_columns(read(spark, sf_dir, "extracted_blocks").where("block_type = 'table_cell'"), ["table_id", "column_no"]).select("table_id", "column_no", F.round("share", 6).alias("share"), "n", "review")


@query("""WITH b AS (SELECT DISTINCT doc_id, block_id, text FROM extracted_blocks WHERE text IS NOT NULL), r AS (SELECT block_id, text, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY block_id) - length(text) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS no FROM b)
SELECT block_id, substr(text, 1, (1000 - before)::BIGINT) AS excerpt FROM r WHERE before < 1000 AND no <= 40""")
def prompt_excerpts(spark, sf_dir) -> DataFrame:
    b = read(spark, sf_dir, "extracted_blocks").where("text is not null").select("doc_id", "block_id", "text").distinct()
    return S.prompt_budget(b, chars=1000).select("block_id", "excerpt")


@query("""WITH b AS (SELECT DISTINCT doc_id, page_or_sheet, block_id, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM extracted_blocks WHERE bbox IS NOT NULL)
SELECT a.block_id AS a, b.block_id AS b FROM b a JOIN b ON a.doc_id = b.doc_id AND a.page_or_sheet = b.page_or_sheet AND a.block_id < b.block_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""")
def box_overlaps(spark, sf_dir) -> DataFrame:
    """Blocks of one page whose boxes share an area."""
    b = read(spark, sf_dir, "extracted_blocks").where("bbox is not null").select("doc_id", "page_or_sheet", "block_id", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1").distinct()
    return S.overlapping(b, b, ["doc_id", "page_or_sheet"]).where("l.block_id < r.block_id").select(F.col("l.block_id").alias("a"), F.col("r.block_id").alias("b"))


@query("""SELECT log_id, CASE WHEN json_valid(response_text) AND trim(response_text) LIKE '{%' THEN 'unknown' END AS document_type, CASE WHEN json_valid(response_text) AND trim(response_text) LIKE '{%' THEN greatest(0.0, least(1.0, coalesce(json_extract(response_text, '$.confidence')::DOUBLE, 0.5))) END AS confidence FROM llm_call_logs""")
def structure_replies(spark, sf_dir) -> DataFrame:
    """Replies read as a structure: none names a known kind, confidences are clamped, what is no JSON object is null."""
    r = read(spark, sf_dir, "llm_call_logs").select("log_id", S.structure_reply(F.col("response_text")).alias("r"))
    return r.select("log_id", "r.document_type", "r.confidence")


@query("SELECT decision, count(*) AS n, round(avg(confidence), 4) AS mean FROM (SELECT json_extract_string(response_text, '$.decision') AS decision, json_extract(response_text, '$.confidence')::DOUBLE AS confidence FROM llm_call_logs WHERE json_valid(response_text)) GROUP BY 1")
def model_replies(spark, sf_dir) -> DataFrame:
    r = read(spark, sf_dir, "llm_call_logs").where("trim(response_text) <> ''").select(S.parsed_reply(F.col("response_text"), "decision string, confidence double").alias("r")).where("r is not null and (r.decision is not null or r.confidence is not null)")
    return r.groupBy("r.decision").agg(F.count("*").alias("n"), F.round(F.avg("r.confidence"), 4).alias("mean"))


# ---- resolution


def _records(spark, sf_dir) -> DataFrame:
    r = read(spark, sf_dir, "pii_records")
    keep = [c for c in r.columns if c != "record_id"]
    return r.groupBy("record_id").agg(F.max_by(F.struct(*keep), F.struct("ingested_at", F.xxhash64(*keep))).alias("v")).select("record_id", "v.*")


_DOB = f"""CASE WHEN regexp_matches(v, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN {_ISO(f'{_P}[1]', f'{_P}[2]', f'{_P}[3]')}
WHEN regexp_matches(v, '^\\d{{1,2}} [A-Za-z]{{3}} \\d{{4}}$') THEN strftime(try_strptime(v, '%d %b %Y'), '%Y-%m-%d') WHEN regexp_matches(v, '^\\d{{1,2}} [A-Za-z]{{4,}} \\d{{4}}$') THEN strftime(try_strptime(v, '%d %B %Y'), '%Y-%m-%d')
WHEN regexp_matches(v, '^[A-Za-z]{{3}} \\d{{1,2}}, \\d{{4}}$') THEN strftime(try_strptime(v, '%b %d, %Y'), '%Y-%m-%d') WHEN regexp_matches(v, '^[A-Za-z]{{4,}} \\d{{1,2}}, \\d{{4}}$') THEN strftime(try_strptime(v, '%B %d, %Y'), '%Y-%m-%d')
WHEN regexp_matches(v, '^\\d{{1,2}}[-./]\\d{{1,2}}[-./]\\d{{1,4}}$') THEN CASE WHEN c IN ('US', 'PH') THEN {_ISO(_YEAR, f'{_P}[1]', f'{_P}[2]')} ELSE {_ISO(_YEAR, f'{_P}[2]', f'{_P}[1]')} END
WHEN regexp_matches(v, '^\\d{{4}}[-./]\\d{{1,2}}[-./]\\d{{1,4}}$') THEN {_ISO(f'{_P}[1]', f'{_P}[2]', f'{_P}[3]')} END"""
# all pairs of records, scored: what the blocked joins must come to
_PAIRS = f"""WITH RECURSIVE l AS (SELECT *, {_TRIM('raw_dob')} AS v, upper(coalesce(country, 'US')) AS c FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) AS latest FROM pii_records) WHERE latest = 1),
n AS MATERIALIZED (SELECT record_id, nullif(CASE WHEN instr({_MAIL}, '@') = 0 THEN {_MAIL} WHEN substr({_MAIL}, instr({_MAIL}, '@') + 1) IN ('gmail.com', 'googlemail.com') THEN replace(left({_MAIL}, instr({_MAIL}, '@') - 1), '.', '') || '@' || substr({_MAIL}, instr({_MAIL}, '@') + 1) ELSE {_MAIL} END, '') AS email,
  nullif(raw_phone, '') AS phone, nullif(lower({_TRIM('raw_name')}), '') AS nm, {soundex_sql('lower(' + _TRIM('raw_name') + ')')} AS sx, {_DOB} AS dob, nullif(upper(replace(coalesce(raw_address.zip, ''), ' ', '')), '') AS zip, upper(coalesce(raw_address.country, '')) AS land, lower(coalesce(raw_address.street, '')) AS street, entity_role AS role FROM l),
c AS MATERIALIZED (SELECT DISTINCT x.nm AS x, y.nm AS y FROM n x JOIN n y ON x.record_id < y.record_id WHERE x.nm <> y.nm AND jaro_winkler_similarity(x.nm, y.nm) >= 0.80
  UNION SELECT DISTINCT x.street, y.street FROM n x JOIN n y ON x.record_id < y.record_id AND x.zip = y.zip WHERE x.street <> y.street AND x.street <> '' AND y.street <> ''), {jaro_winkler_sql("c")},
j AS MATERIALIZED (SELECT x.record_id AS a, y.record_id AS b, coalesce(x.email = y.email, false) AS e, coalesce(x.phone = y.phone, false) AS p, coalesce(x.dob = y.dob, false) AS d, coalesce(x.nm = y.nm OR CASE WHEN regexp_matches(x.nm || y.nm, {q(V.NON_LATIN)}) THEN w.s >= 0.88 ELSE w.s >= 0.92 OR x.sx = y.sx AND w.s >= 0.80 END, false) AS nm,
  coalesce((x.land = '' OR y.land = '' OR x.land = y.land) AND x.zip = y.zip AND (x.street = '' OR y.street = '' OR x.street = y.street OR z.s >= 0.85), false) AS ad, coalesce(x.role, '') IN ('primary_subject') AND coalesce(y.role, '') IN ('institutional', 'provider') OR coalesce(y.role, '') IN ('primary_subject') AND coalesce(x.role, '') IN ('institutional', 'provider') AS veto FROM n x JOIN n y ON x.record_id < y.record_id LEFT JOIN jw w ON w.x = x.nm AND w.y = y.nm LEFT JOIN jw z ON z.x = x.street AND z.y = y.street),
s AS MATERIALIZED (SELECT a, b, (CASE WHEN veto THEN 0.0 ELSE least(1.0, e::INT * 0.40 + p::INT * 0.35 + (nm AND d)::INT * 0.35 + (nm AND ad)::INT * 0.25 + nm::INT * 0.10) END)::DOUBLE AS confidence FROM j), e AS MATERIALIZED (SELECT * FROM s WHERE confidence >= 0.3 - 1e-9)"""
_GROUPS = _PAIRS + """, two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT record_id AS n, record_id AS m FROM n UNION SELECT two.b, r.m FROM r JOIN two ON two.a = r.n), g AS MATERIALIZED (SELECT n AS record_id, min(m) AS group_id FROM r GROUP BY 1)"""


@query(_PAIRS + " SELECT a, b, round(confidence, 6) AS confidence FROM e")
def resolved_edges(spark, sf_dir) -> DataFrame:
    return R.edges(_records(spark, sf_dir)).select("a", "b", F.round("confidence", 6).alias("confidence"))


@query(_GROUPS + " SELECT record_id, group_id FROM g")
def resolved_groups(spark, sf_dir) -> DataFrame:
    return R.groups(_records(spark, sf_dir))


@query(_GROUPS + """, lowest AS (SELECT x.group_id, min(confidence) AS least FROM s JOIN g x ON x.record_id = a JOIN g y ON y.record_id = b WHERE x.group_id = y.group_id GROUP BY 1)
SELECT group_id, count(*) AS size, round(coalesce(any_value(least), 1.0::DOUBLE), 6) AS merge_confidence, coalesce(any_value(least), 1.0) < 0.8 - 1e-9 AS needs_review FROM g LEFT JOIN lowest USING (group_id) GROUP BY 1""")
def group_confidence(spark, sf_dir) -> DataFrame:
    return R.group_confidence(_records(spark, sf_dir)).withColumn("merge_confidence", F.round("merge_confidence", 6)).withColumn("needs_review", F.col("merge_confidence") < 0.8)


_MODE = lambda c, as_: f"(SELECT group_id, {c} AS {as_} FROM (SELECT group_id, {c}, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, length({c}) DESC, {c}) AS i FROM v WHERE {c} <> '' GROUP BY 1, 2) WHERE i = 1)"


@query(_GROUPS + f""", {names_sql('l')}, v AS MATERIALIZED (SELECT group_id, l.record_id, entity_type, nn.name, lower(raw_email) AS mail, l.raw_phone AS phone FROM g JOIN l USING (record_id) LEFT JOIN nn ON nn.record_id = l.record_id)
SELECT group_id, canonical_name, canonical_email, canonical_phone, types, n_records FROM (SELECT group_id, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS types, count(*)::INT AS n_records FROM v GROUP BY 1) LEFT JOIN {_MODE('name', 'canonical_name')} USING (group_id) LEFT JOIN {_MODE('mail', 'canonical_email')} USING (group_id) LEFT JOIN {_MODE('phone', 'canonical_phone')} USING (group_id)""")
def resolved_subjects(spark, sf_dir) -> DataFrame:
    r = _records(spark, sf_dir)
    return R.subjects(r, R.groups(r)).select("group_id", "canonical_name", "canonical_email", "canonical_phone", F.concat_ws(",", "pii_types_found").alias("types"), F.size("source_records").alias("n_records"))


@query(f"""WITH RECURSIVE s AS (SELECT DISTINCT group_id, subject_id, lower({_TRIM('canonical_name')}) AS nm FROM notification_subjects WHERE trim(canonical_name) <> ''), p AS (SELECT a.subject_id AS a, b.subject_id AS b, a.nm AS x, b.nm AS y, {soundex_sql('a.nm')} AS sx, {soundex_sql('b.nm')} AS sy FROM s a JOIN s b ON a.group_id = b.group_id AND a.subject_id < b.subject_id), u AS (SELECT DISTINCT x, y FROM p), {jaro_winkler_sql("u")},
m AS (SELECT *, CASE WHEN x = y THEN 1.0 WHEN CASE WHEN regexp_matches(x || y, {q(V.NON_LATIN)}) THEN s >= 0.88 ELSE s >= 0.92 OR sx = sy AND s >= 0.80 END THEN s ELSE 0.0 END AS confidence FROM p JOIN jw USING (x, y)) SELECT a, b, round(confidence::DOUBLE, 6) AS confidence, confidence >= 0.5 AS likely FROM m""")
def name_matches(spark, sf_dir) -> DataFrame:
    """Names of the subjects of one group: confidence that they are one, and whether it is likely one person."""
    s = read(spark, sf_dir, "notification_subjects").where("trim(canonical_name) <> ''").select("group_id", "subject_id", "canonical_name").distinct()
    p = s.alias("l").join(s.alias("r"), F.expr("l.group_id = r.group_id and l.subject_id < r.subject_id")).select(F.col("l.subject_id").alias("a"), F.col("r.subject_id").alias("b"), F.col("l.canonical_name").alias("x"), F.col("r.canonical_name").alias("y"))
    return p.select("a", "b", F.round(name_match("x", "y"), 6).alias("confidence"), likely_same_person("x", "y").alias("likely"))


_ZIP = lambda c: f"upper(replace(coalesce({c}.zip, ''), ' ', ''))"


@query(f"""WITH RECURSIVE s AS (SELECT DISTINCT group_id, subject_id, canonical_address AS d FROM notification_subjects WHERE canonical_address IS NOT NULL), p AS (SELECT a.subject_id AS a, b.subject_id AS b, a.d AS c, b.d AS e, lower(coalesce(a.d.street, '')) AS x, lower(coalesce(b.d.street, '')) AS y FROM s a JOIN s b ON a.group_id = b.group_id AND (a.subject_id < b.subject_id)), u AS (SELECT DISTINCT x, y FROM p WHERE x <> '' AND y <> ''), {jaro_winkler_sql("u")}
SELECT a, b, (CASE WHEN upper(coalesce(c.country, '')) <> '' AND upper(coalesce(e.country, '')) <> '' AND upper(c.country) <> upper(e.country) OR {_ZIP('c')} = '' OR {_ZIP('c')} <> {_ZIP('e')} THEN 0.0 WHEN x = '' OR y = '' THEN 0.60 WHEN x = y THEN 0.90 WHEN s >= 0.85 THEN 0.75 ELSE 0.0 END)::DOUBLE AS confidence FROM p LEFT JOIN jw USING (x, y)""")
def address_grades(spark, sf_dir) -> DataFrame:
    """How surely the addresses of the subjects of one group are one."""
    s = read(spark, sf_dir, "notification_subjects").where("canonical_address is not null").select("group_id", "subject_id", "canonical_address").distinct()
    p = s.alias("l").join(s.alias("r"), F.expr("l.group_id = r.group_id and l.subject_id < r.subject_id")).select(F.col("l.subject_id").alias("a"), F.col("r.subject_id").alias("b"), F.col("l.canonical_address").alias("x"), F.col("r.canonical_address").alias("y"))
    return p.select("a", "b", address_match("x", "y").alias("confidence"))


_SSN = "(SELECT DISTINCT block_id, doc_id, unnest(regexp_extract_all(text, " + q(pattern("SSN")) + ")) AS v FROM extracted_blocks WHERE text IS NOT NULL)"


@query(f"SELECT grade, count(*) AS n FROM (SELECT (CASE WHEN a.v = b.v THEN 0.95 WHEN levenshtein(a.v, b.v) = 1 THEN 0.75 ELSE 0.0 END)::DOUBLE AS grade FROM {_SSN} a JOIN {_SSN} b ON a.doc_id = b.doc_id AND (a.block_id, a.v) < (b.block_id, b.v)) GROUP BY 1")
def id_grades(spark, sf_dir) -> DataFrame:
    """How surely the numbers found in one document are one."""
    d = D.detect(read(spark, sf_dir, "extracted_blocks").select("doc_id", "block_id", "text").distinct(), types=["SSN"]).select("doc_id", "block_id", "value", "entity_type").distinct()
    p = d.alias("l").join(d.alias("r"), (F.col("l.doc_id") == F.col("r.doc_id")) & (F.struct("l.block_id", "l.value") < F.struct("r.block_id", "r.value")))
    return p.groupBy(government_match("l.entity_type", "l.value", "r.entity_type", "r.value").alias("grade")).agg(F.count("*").alias("n"))


@query("SELECT group_id, canonical_name FROM (SELECT group_id, canonical_name, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, length(canonical_name) DESC, canonical_name) AS n FROM notification_subjects WHERE canonical_name <> '' GROUP BY 1, 2) WHERE n = 1")
def best_names(spark, sf_dir) -> DataFrame:
    return R.best_value(read(spark, sf_dir, "notification_subjects"), "group_id", "canonical_name")


@query("""WITH a AS (SELECT DISTINCT group_id, subject_id, canonical_address AS d, coalesce(canonical_address.zip, '') AS z FROM notification_subjects WHERE canonical_address IS NOT NULL),
t AS (SELECT group_id, z FROM (SELECT group_id, z, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, z DESC) AS n FROM a WHERE z <> '' GROUP BY 1, 2) WHERE n = 1)
SELECT group_id, d.street AS street, d.zip AS zip FROM (SELECT a.group_id, d, row_number() OVER (PARTITION BY a.group_id ORDER BY subject_id) AS n FROM a LEFT JOIN t USING (group_id) WHERE t.z IS NULL OR t.z = a.z) WHERE n = 1""")
def best_addresses(spark, sf_dir) -> DataFrame:
    s = read(spark, sf_dir, "notification_subjects").select("group_id", "subject_id", "canonical_address").distinct()
    return R.best_address(s, "group_id", "canonical_address", "subject_id").select("group_id", "canonical_address.street", "canonical_address.zip")


@query()
def upserted_subjects(spark, sf_dir) -> DataFrame:
    s = read(spark, sf_dir, "notification_subjects").dropDuplicates(["subject_id"]).select("subject_id", "canonical_email", "canonical_phone", "pii_types_found", "source_records", "merge_confidence")
    old = F.pmod(F.crc32("subject_id"), F.lit(2)) == 0
    return R.upserted(s.where(old), s.where(~old)).select("subject_id", F.size("pii_types_found").alias("n_types"), F.size("source_records").alias("n_records"), "merge_confidence")


# ---- reports


@query("SELECT count(*) FILTER (status <> 'discovered') AS documents_processed, count(DISTINCT ingestion_run_id) AS runs, count(*) FILTER (is_scanned) AS scanned, (SELECT count(*) FROM notification_subjects WHERE review_status = 'AI_PENDING') AS pending FROM documents")
def dashboard_stats(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").agg(F.count_if(F.col("status") != "discovered").alias("documents_processed"), F.countDistinct("ingestion_run_id").alias("runs"), F.count_if(F.col("is_scanned")).alias("scanned"))
    n = read(spark, sf_dir, "notification_subjects").agg(F.count_if(F.col("review_status") == "AI_PENDING").alias("pending"))
    return d.join(n, F.lit(True))


@query("SELECT project_id, count(*) AS pending_count, min(d.created_at) AS oldest FROM ingestion_runs r JOIN documents d ON d.ingestion_run_id = r.run_id WHERE d.status = 'discovered' AND project_id IS NOT NULL GROUP BY 1")
def needs_attention(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("status = 'discovered'").groupBy("ingestion_run_id").agg(F.count("*").alias("n"), F.min("created_at").alias("o"))
    r = read(spark, sf_dir, "ingestion_runs").where("project_id is not null").select("project_id", F.col("run_id").alias("ingestion_run_id"))
    return d.join(r, "ingestion_run_id").groupBy("project_id").agg(F.sum("n").alias("pending_count"), F.min("o").alias("oldest"))


@query("SELECT run_id, r.status, count(doc_id) AS total, count(doc_id) FILTER (d.status <> 'discovered') AS processed, CASE WHEN count(doc_id) = 0 THEN 0.0 ELSE round(count(doc_id) FILTER (d.status <> 'discovered') / count(doc_id) * 100, 1) END AS pct FROM ingestion_runs r LEFT JOIN documents d ON d.ingestion_run_id = r.run_id GROUP BY 1, 2")
def run_progress(spark, sf_dir) -> DataFrame:
    """Progress of each run: one left join of a pre-aggregate instead of a count for each run."""
    d = read(spark, sf_dir, "documents").groupBy(F.col("ingestion_run_id").alias("run_id")).agg(F.count("*").alias("total"), F.count_if(F.col("status") != "discovered").alias("processed"))
    r = read(spark, sf_dir, "ingestion_runs").select("run_id", "status").join(d, "run_id", "left").fillna(0, ["total", "processed"])
    return r.withColumn("pct", F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("processed") / F.col("total") * 100, 1)))


@query("SELECT project_id, count(DISTINCT run_id) AS runs, count(doc_id) AS documents, max(r.started_at) AS last_started, coalesce(any_value(n.subjects), 0) AS subjects FROM ingestion_runs r LEFT JOIN documents d ON d.ingestion_run_id = r.run_id LEFT JOIN (SELECT project_id AS p, count(DISTINCT subject_id) AS subjects FROM notification_subjects GROUP BY 1) n ON n.p = r.project_id WHERE project_id IS NOT NULL GROUP BY 1")
def active_projects(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").groupBy(F.col("ingestion_run_id").alias("run_id")).agg(F.count("*").alias("n"))
    r = read(spark, sf_dir, "ingestion_runs").where("project_id is not null").select("project_id", "run_id", "started_at").join(d, "run_id", "left")
    a = r.groupBy("project_id").agg(F.countDistinct("run_id").alias("runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.max("started_at").alias("last_started"))
    s = read(spark, sf_dir, "notification_subjects").groupBy("project_id").agg(F.countDistinct("subject_id").alias("subjects"))
    return a.join(s, "project_id", "left").fillna(0, ["subjects"])


_FEED = [("documents", "document", "document_id", "created_at"), ("ingestion_runs", "run", "run_id", "started_at"), ("llm_call_logs", "call", "log_id", "created_at"), ("notification_subjects", "subject", "subject_id", "updated_at")]


@query("SELECT kind, id, happened FROM (" + " UNION ALL ".join(f"(SELECT DISTINCT '{k}' AS kind, {i} AS id, {t} AS happened FROM {n} ORDER BY happened DESC NULLS LAST, id LIMIT 20)" for n, k, i, t in _FEED) + ") ORDER BY happened DESC NULLS LAST, kind, id LIMIT 20")
def recent_activity(spark, sf_dir) -> DataFrame:
    feed = None
    for n, k, i, t in _FEED:
        f = read(spark, sf_dir, n).select(F.lit(k).alias("kind"), F.col(i).alias("id"), F.col(t).alias("happened")).distinct().orderBy(F.desc_nulls_last("happened"), "id").limit(20)
        feed = f if feed is None else feed.unionByName(f)
    return feed.orderBy(F.desc_nulls_last("happened"), "kind", "id").limit(20)


@query("SELECT source, doc_type, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), (doc_type), ())")
def catalog_summary(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").groupingSets([[F.col("source")], [F.col("doc_type")], []], F.col("source"), F.col("doc_type")).agg(F.count("*").alias("n"))


@query("SELECT run_id, status, started_at, (SELECT count(*) FROM ingestion_runs WHERE status <> 'archived') AS total FROM ingestion_runs WHERE status <> 'archived' ORDER BY started_at DESC, run_id LIMIT 10 OFFSET 10")
def runs_page(spark, sf_dir) -> DataFrame:
    """A page of the runs, with how many there are in all."""
    r = read(spark, sf_dir, "ingestion_runs").where("status <> 'archived'")
    page = r.select("run_id", "status", "started_at").orderBy(F.desc("started_at"), "run_id").offset(10).limit(10)
    return page.join(F.broadcast(r.agg(F.count("*").alias("total"))), F.lit(True))  # one row


_STATES = ["AI_PENDING", "HUMAN_REVIEW", "APPROVED", "NOTIFIED", "REJECTED"]


@query("SELECT project_id, status, n FROM (SELECT project_id, " + ", ".join(f"count(DISTINCT subject_id) FILTER (review_status = '{x}') AS {x}" for x in _STATES) + " FROM notification_subjects GROUP BY 1) UNPIVOT (n FOR status IN (" + ", ".join(_STATES) + "))")
def queue_counts(spark, sf_dir) -> DataFrame:
    """How many subjects of each project wait in each state, zeros included."""
    s = read(spark, sf_dir, "notification_subjects").select("project_id", "subject_id", "review_status").distinct()
    n = s.groupBy("project_id").agg(*[F.count_if(F.col("review_status") == x).alias(x) for x in _STATES])
    return n.unpivot("project_id", _STATES, "status", "n")


@query("SELECT DISTINCT subject_id FROM notification_subjects s WHERE review_status = 'AI_PENDING' AND NOT EXISTS (SELECT 1 FROM notification_subjects t WHERE t.group_id = s.group_id AND t.review_status = 'HUMAN_REVIEW')")
def queue_entries(spark, sf_dir) -> DataFrame:
    """Subjects that may enter a queue: pending ones of whose group none stands in it already."""
    s = read(spark, sf_dir, "notification_subjects").select("group_id", "subject_id", "review_status").distinct()
    return s.where("review_status = 'AI_PENDING'").join(s.where("review_status = 'HUMAN_REVIEW'").select("group_id"), "group_id", "left_anti").select("subject_id").distinct()


@query("SELECT project_id, count(DISTINCT subject_id) AS population, least(count(DISTINCT subject_id), 50, greatest(5, ceil(count(DISTINCT subject_id) * 0.05)::BIGINT)) AS sample_size FROM notification_subjects GROUP BY 1")
def qc_sample_sizes(spark, sf_dir) -> DataFrame:
    """How many subjects of each project a check takes: a share, at least five, at most fifty and all there are."""
    n = read(spark, sf_dir, "notification_subjects").groupBy("project_id").agg(F.countDistinct("subject_id").alias("population"))
    return n.withColumn("sample_size", S.sample_size(F.col("population"), 0.05, 5, 50))


@query("SELECT run_id, unnest([" + ", ".join(map(q, S.STAGES)) + "]) AS stage, CASE status WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'failed' ELSE 'pending' END AS status FROM ingestion_runs")
def stage_status(spark, sf_dir) -> DataFrame:
    return S.stage_status(read(spark, sf_dir, "ingestion_runs").select("run_id", "status"))


@query("""WITH d AS (SELECT ingestion_run_id AS run_id, doc_id, size_bytes, sum(size_bytes) OVER (PARTITION BY ingestion_run_id ORDER BY doc_id) AS total FROM documents WHERE lower(file_type) IN ('pdf', 'docx', 'xlsx', 'xls', 'csv', 'html', 'htm', 'eml', 'msg', 'parquet', 'avro'))
SELECT run_id, count(*) AS n_files, sum(size_bytes)::BIGINT AS total_bytes, coalesce(arg_min(CASE WHEN size_bytes > 4000 THEN 'file too large' ELSE 'total too large' END, doc_id) FILTER (size_bytes > 4000 OR total > 40000), 'accepted') AS outcome FROM d GROUP BY 1""")
def upload_gate(spark, sf_dir) -> DataFrame:
    """Whether each run's files pass the caps of a file and of a whole upload, and which fails first."""
    d = read(spark, sf_dir, "documents").select(F.col("ingestion_run_id").alias("run_id"), "doc_id", "file_type", "size_bytes")
    return files.upload_gate(d, ["run_id"], "doc_id", most_file=4000, most_total=40000)


_QA = " UNION ALL ".join(f"SELECT doc_id, {dict((p[0], p[2]) for p in V.PATTERNS)[k]} AS s, unnest(regexp_extract_all(text, {q(pattern(k))})) AS v FROM documents WHERE text IS NOT NULL" for k in CORE)


@query(f"SELECT doc_id, count(*) AS total_extractions, count(*) FILTER (s < 0.75) AS flagged_count FROM ({_QA}) GROUP BY 1")
def qa_report(spark, sf_dir) -> DataFrame:
    """Extractions of each document, and how many of them are less than sure."""
    d = D.detect(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), types=CORE)
    return d.groupBy("doc_id").agg(F.count("*").alias("total_extractions"), F.count_if("needs_layer2").alias("flagged_count"))


@query("SELECT log_id, document_id, model FROM llm_call_logs WHERE decision IS NULL ORDER BY created_at DESC, log_id LIMIT 50")
def undecided_calls(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "llm_call_logs").where("decision is null").orderBy(F.desc("created_at"), "log_id").limit(50).select("log_id", "document_id", "model")


@query("SELECT run_id, count(doc_id) AS n_documents, arg_min(file_name, (d.created_at, doc_id)) AS first_file, epoch(any_value(completed_at)) - epoch(any_value(started_at)) AS seconds FROM ingestion_runs r LEFT JOIN documents d ON d.ingestion_run_id = r.run_id GROUP BY 1")
def run_summary(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").groupBy(F.col("ingestion_run_id").alias("run_id")).agg(F.count("*").alias("n_documents"), F.min_by("file_name", F.struct("created_at", "doc_id")).alias("first_file"))
    r = read(spark, sf_dir, "ingestion_runs").select("run_id", (F.unix_micros(F.col("completed_at").cast("timestamp")) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6).alias("seconds"))
    return r.join(d, "run_id", "left").fillna(0, ["n_documents"])


@query("SELECT project_id, run_id, run_seq FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY run_seq DESC) AS n FROM ingestion_runs WHERE project_id IS NOT NULL) WHERE n = 1")
def latest_runs(spark, sf_dir) -> DataFrame:
    return D.latest(read(spark, sf_dir, "ingestion_runs").where("project_id is not null").select("project_id", "run_id", "run_seq"), ["project_id"], F.desc("run_seq"))


@query("SELECT subject_id FROM (SELECT DISTINCT subject_id, sha256(subject_id || '#qc') AS h FROM notification_subjects WHERE review_status = 'AI_PENDING') ORDER BY h LIMIT 25")
def qc_sample(spark, sf_dir) -> DataFrame:
    """A reproducible sample without replacement: the least salted hashes."""
    return read(spark, sf_dir, "notification_subjects").where("review_status = 'AI_PENDING'").select("subject_id").distinct().orderBy(F.sha2(F.concat("subject_id", F.lit("#qc")), 256)).limit(25).select("subject_id")


@query("SELECT log_id, use_case, model, created_at FROM llm_call_logs WHERE accepted ORDER BY created_at DESC, log_id LIMIT 50")
def recent_calls(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "llm_call_logs").where("accepted").select("log_id", "use_case", "model", "created_at").orderBy(F.desc("created_at"), "log_id").limit(50)


@query("SELECT DISTINCT s.subject_id FROM notification_subjects s WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(source_records) AS x, subject_id FROM notification_subjects) u JOIN pii_records p ON p.record_id = u.x WHERE u.subject_id = s.subject_id)")
def subjects_without_records(spark, sf_dir) -> DataFrame:
    """Anti-join: subjects of which no source record is known."""
    s = read(spark, sf_dir, "notification_subjects")
    known = s.select("subject_id", F.explode("source_records").alias("record_id")).join(read(spark, sf_dir, "pii_records").select("record_id").distinct(), "record_id", "left_semi").select("subject_id").distinct()
    return s.select("subject_id").distinct().join(known, "subject_id", "left_anti")


# ---- sinks and sources

@query("SELECT record_id, normalized_value AS stored_value, sha256('pepper:' || normalized_value) AS value_hash, 'encrypted' AS storage_policy, normalized_value AS decrypted FROM pii_records WHERE trim(normalized_value) <> ''")
def storage_investigation(spark, sf_dir) -> DataFrame:
    """Values kept for an investigation: as they are, hashed, and encrypted so that the key brings them back."""
    r = read(spark, sf_dir, "pii_records").where("trim(normalized_value) <> ''").select("record_id", F.col("normalized_value").alias("value"), "normalized_value")
    d = sinks.stored(r, "pepper", strict=False, key="0123456789abcdef")
    return d.select("record_id", "stored_value", "value_hash", "storage_policy", X.decrypted("value_encrypted", "0123456789abcdef").alias("decrypted"))


_BOOL = "CASE WHEN notification_required IS NULL THEN '' WHEN notification_required THEN 'True' ELSE 'False' END"


@query(f"""SELECT coalesce(canonical_name, '') AS canonical_name, CASE WHEN coalesce(canonical_email, '') = '' THEN '' ELSE '***@***.***' END AS canonical_email,
CASE WHEN coalesce(canonical_phone, '') = '' THEN '' WHEN length(regexp_replace(canonical_phone, '\\D', '', 'g')) < 4 THEN '***' ELSE '***-***-' || right(regexp_replace(canonical_phone, '\\D', '', 'g'), 4) END AS canonical_phone,
CASE WHEN canonical_address IS NULL THEN '' WHEN concat_ws(', ', nullif(canonical_address.state, ''), nullif(canonical_address.zip, '')) = '' THEN '***' ELSE concat_ws(', ', nullif(canonical_address.state, ''), nullif(canonical_address.zip, '')) END AS canonical_address,
printf('%.4f', merge_confidence) AS merge_confidence, {_BOOL} AS notification_required, coalesce(review_status, '') AS review_status FROM notification_subjects WHERE merge_confidence >= 0.5 AND list_has_any(pii_types_found, ['SSN', 'EMAIL'])""")
def export_subjects(spark, sf_dir) -> DataFrame:
    fields = ["canonical_name", "canonical_email", "canonical_phone", "canonical_address", "merge_confidence", "notification_required", "review_status"]
    return sinks.export_rows(read(spark, sf_dir, "notification_subjects"), fields, min_confidence=0.5, types=["SSN", "EMAIL"])


@query("""SELECT subject_id, coalesce(canonical_name, '') AS canonical_name, coalesce(canonical_address.street, '') AS street, coalesce(canonical_address.city, '') AS city, CASE WHEN canonical_address IS NULL THEN 'SKIPPED' ELSE 'RENDERED' END AS status,
CASE WHEN canonical_address IS NULL THEN '' ELSE 'p_' || subject_id || '.html' END AS letter_filename, CASE WHEN canonical_address IS NOT NULL THEN 'Dear ' || coalesce(canonical_name, '') || ', $missing costs $5' END AS letter FROM notification_subjects""")
def letter_manifest(spark, sf_dir) -> DataFrame:
    m = sinks.letters(read(spark, sf_dir, "notification_subjects"), "p", "Dear $name, $missing costs $$5")
    return m.select("subject_id", "canonical_name", "street", "city", "status", "letter_filename", "letter")


_REGION = ["r_regionkey", "r_name"]


@query("SELECT col_header, page_or_sheet, text, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS col_header, '0' AS page_or_sheet, trim({c}::VARCHAR) AS text FROM {t}" for t, cs in (("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("region", _REGION)) for c in cs) + ") WHERE text <> '' GROUP BY 1, 2, 3")
def parquet_cells(spark, sf_dir) -> DataFrame:
    """Every cell of two tables as block rows, the page being the row group."""
    b = files.parquet_blocks(spark, f"{sf_dir}/nation.parquet").unionByName(files.parquet_blocks(spark, f"{sf_dir}/region.parquet"))
    return b.groupBy("col_header", "page_or_sheet", "text").agg(F.count("*").alias("n"))


@query("SELECT p.record_id, pos::INT AS pos, p.entity_type FROM (SELECT subject_id, unnest(source_records) AS record_id, unnest(range(len(source_records))) AS pos FROM (SELECT DISTINCT subject_id, source_records FROM notification_subjects)) u JOIN (SELECT DISTINCT record_id, entity_type FROM pii_records) p ON p.record_id = u.record_id")
def ordered_lookup(spark, sf_dir) -> DataFrame:
    """Records of an id list in its order."""
    s = read(spark, sf_dir, "notification_subjects").select("subject_id", "source_records").distinct()
    ids = s.select("subject_id", F.posexplode("source_records").alias("pos", "record_id"))
    return ids.join(read(spark, sf_dir, "pii_records").select("record_id", "entity_type").distinct(), "record_id").select("record_id", "pos", "entity_type")


# ---- plans and streams


_ALL_SQL = f"""SELECT category, count(*) AS n FROM (SELECT unnest({categories_sql('entity_type')}) AS category FROM (SELECT DISTINCT doc_id, page_or_sheet, entity_type, value FROM ({spans_sql("(SELECT DISTINCT doc_id, block_id, page_or_sheet, text, col_header FROM extracted_blocks WHERE col_header IS NULL)", ['EMAIL', 'PHONE_INTL', 'SSN', 'IPV4', 'PAN', 'AADHAAR'], 'doc_id, page_or_sheet')}))) GROUP BY 1"""


@query(_ALL_SQL)
def pipeline_prose_density(spark, sf_dir) -> DataFrame:
    """The plan on blocks that stand in no column: detections that survive, one a value of each page, counted by category."""
    b = read(spark, sf_dir, "extracted_blocks").where("col_header is null").distinct()
    return D.density(pipeline.detected(b, types=["EMAIL", "PHONE_INTL", "SSN", "IPV4", "PAN", "AADHAAR"])).where("doc_id is null").select("category", "n")


@query()
def pipeline_density(spark, sf_dir) -> DataFrame:
    """The whole plan on blocks: detections after all layers, counted by category."""
    b = read(spark, sf_dir, "extracted_blocks").distinct()
    found = pipeline.detected(b, types=["EMAIL", "PHONE_US", "PHONE_INTL", "SSN", "IPV4", "PAN", "AADHAAR"])
    return D.density(found).where("doc_id is null").select("category", "n")


@query()
def pipeline_individuals(spark, sf_dir) -> DataFrame:
    b = read(spark, sf_dir, "extracted_blocks").distinct()
    out = pipeline.run(b, types=["EMAIL", "PHONE_US", "SSN", "PAN"])
    return out["groups"].groupBy("group_id").agg(F.count("*").alias("n_records")).groupBy("n_records").agg(F.count("*").alias("n_groups"))


@query(f"SELECT entity_type, count(*) AS n FROM ({spans_sql('documents', ['EMAIL', 'IPV4'], 'doc_id')}) GROUP BY 1")
def stream_counts(spark, sf_dir) -> DataFrame:
    """Detections in a stream of documents, run until the input is used up."""
    out = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read(spark, sf_dir, "documents").schema)
    src = spark.readStream.schema(ddl).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    d = stream.D.detect(src.select("doc_id", "created_at", "text"), types=["EMAIL", "IPV4"]).select("doc_id", "entity_type", "value")
    d.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id bigint, entity_type string, value string").parquet(out).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, month, n, sum(n) OVER (PARTITION BY event_type ORDER BY month) AS running FROM (SELECT entity_type AS event_type, strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM pii_records WHERE created_at IS NOT NULL GROUP BY 1, 2)")
def records_by_month(spark, sf_dir) -> DataFrame:
    m = read(spark, sf_dir, "pii_records").where("created_at is not null").groupBy(F.col("entity_type").alias("event_type"), F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return m.withColumn("running", F.sum("n").over(W.partitionBy("event_type").orderBy("month")))
