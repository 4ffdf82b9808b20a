"""Structure of documents: kind, sections, roles, where personal data begins, samples, page stitching, catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V


def structure_class(file_type: Column) -> Column:
    """structured, semi-structured, unstructured or non-extractable by extension."""
    t = F.lower(F.trim(F.coalesce(file_type, F.lit(""))))
    out = None
    for kind, types in V.STRUCTURE_CLASSES.items():
        out = F.when(t.isin(types), kind) if out is None else out.when(t.isin(types), kind)
    return out.otherwise("non-extractable")


def catalogued(docs: DataFrame) -> DataFrame:
    """docs with structure_class, can_auto_process and the reason for a manual review."""
    kind = structure_class(F.col("file_type"))
    reason = F.when(F.trim(F.coalesce("file_type", F.lit(""))) == "", "no extension").otherwise(F.concat(F.lit("not supported: "), F.lower(F.trim("file_type"))))
    return docs.withColumn("structure_class", kind).withColumn("can_auto_process", kind != "non-extractable").withColumn("manual_review_reason", F.when(kind == "non-extractable", reason))


def page_class(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))
    return F.when(words > 50, "digital").when(words > 5, "corrupted").otherwise("scanned")


SEAM = 24  # letters at the end of a block in which a word that goes on in the next may begin: more than any of DOCUMENT_WORDS has


def document_type(blocks: DataFrame, doc: str = "doc_id", text: str = "text", order: str = "block_id") -> DataFrame:
    """Rows (doc, document_type, confidence): the kind of most known words on the first five pages, the first kind on a tie.

    Confidence is fifty times the hits a word of text plus half of the share by which the best kind leads, between 0.3 and 0.95.
    Blocks are joined by a space: each yields one bit a known word, also where one begins at the end of the block before; the
    bits are or-ed and words summed per document, so no text is collected.
    """
    known = [(k, w) for k, ws in V.DOCUMENT_WORDS.items() for w in ws]
    page = F.expr("try_cast(page_or_sheet as int)")
    low = F.lower(F.col(text))
    b = blocks.where(page.isNull() | (page <= 5)).where(F.col(text).isNotNull())
    spaced = [w for _, w in known if " " in w]
    b = b.withColumn("_t", low).withColumn("_seam", F.concat(F.right(F.lag(low).over(W.partitionBy(doc).orderBy(order)), F.lit(SEAM)), F.lit(" "), F.left(low, F.lit(SEAM)))) if spaced else b
    flags = [F.max(F.contains("_t", F.lit(w)) | (F.coalesce(F.contains("_seam", F.lit(w)), F.lit(False)) if " " in w else F.lit(False))).alias(f"w{i}") for i, (_, w) in enumerate(known)]
    words = F.size(F.filter(F.split(F.col(text), r"(?U)\s+"), lambda x: x != ""))
    found = b.groupBy(doc).agg(F.sum(words).alias("words"), *flags)
    scores = []
    at = 0
    for place, (kind, ws) in enumerate(V.DOCUMENT_WORDS.items()):
        hits = sum((F.coalesce(F.col(f"w{at + i}"), F.lit(False)).cast("int") for i in range(len(ws))), F.lit(0))
        scores.append(F.struct(hits.alias("n"), F.lit(-place).alias("place"), F.lit(kind).alias("kind")))
        at += len(ws)
    s = F.reverse(F.array_sort(F.array(*scores)))
    top, second = s.getItem(0), s.getItem(1)
    raw = F.least(F.lit(1.0), top["n"] / F.greatest("words", F.lit(1)) * 50 + (top["n"] - second["n"]) / top["n"] * 0.5)
    conf = F.greatest(F.lit(0.3), F.least(F.lit(0.95), raw))
    return found.select(doc, F.when(top["n"] == 0, "unknown").otherwise(top["kind"]).alias("document_type"), F.when(top["n"] == 0, 0.0).otherwise(F.round(conf, 6)).alias("confidence"))


def section_heading(text: Column, header: Column) -> Column:
    """The section that a block opens, by its text or else its column header; null if none."""
    out = None
    for kind, patterns in V.SECTION_HEADINGS.items():
        hit = text.rlike("(?i)" + "|".join(patterns))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    for word, kind in V.SECTION_COLUMNS.items():
        out = out.when(F.contains(F.lower(header), F.lit(word)), kind)
    return out


def sections(blocks: DataFrame, doc: str = "doc_id", order: str = "block_id") -> DataFrame:
    """blocks with section, section_no and role: a heading opens a section, which lasts until another kind's heading."""
    w = W.partitionBy(doc).orderBy(order)
    b = blocks if "heading" in blocks.columns else blocks.withColumn("heading", section_heading(F.col("text"), F.col("col_header")))
    b = b.withColumn("section", F.last("heading", ignorenulls=True).over(w))
    changed = F.coalesce((F.col("section") != F.lag("section").over(w)) | F.lag("section").over(w).isNull() & F.col("section").isNotNull(), F.lit(False))
    roles = F.create_map(*[F.lit(x) for kv in V.SECTION_ROLES.items() for x in kv])
    return b.withColumn("_c", changed.cast("int")).withColumn("section_no", F.sum("_c").over(w)).withColumn("role", F.coalesce(roles[F.col("section")], F.lit("unknown"))).withColumn(
        "role_confidence", F.when(F.col("section").isNull(), 0.0).otherwise(F.lit(0.85) * F.lit(0.9))).drop("_c")


def block_roles(blocks: DataFrame, doc: str = "doc_id", order: str = "block_id") -> DataFrame:
    """Rows (doc, order, section, role, role_confidence) of all blocks; texts are read once and left before the shuffle."""
    b = blocks.select(doc, order, section_heading(F.col("text"), F.col("col_header")).alias("heading")).distinct()
    return sections(b, doc, order).select(doc, order, "section", "role", "role_confidence")


def with_roles(found: DataFrame, roles: DataFrame, doc: str = "doc_id", order: str = "block_id") -> DataFrame:
    """Matches with entity_role and entity_role_confidence of their block; null where its role isn't known."""
    r = roles.groupBy(doc, order).agg(F.min_by(F.struct("role", "role_confidence"), F.struct("role")).alias("_r"))
    return found.join(r, [doc, order], "left").withColumn("entity_role", F.col("_r.role")).withColumn("entity_role_confidence", F.col("_r.role_confidence")).drop("_r")


def merged_roles(own: DataFrame, model: DataFrame, doc: str = "doc_id", order: str = "block_id") -> DataFrame:
    """Roles by headings and by a model in one: the model's count only where the headings tell none."""
    a = own.select(doc, order, F.struct("role", "role_confidence").alias("_a"))
    b = model.groupBy(doc, order).agg(F.max_by(F.struct("role", "role_confidence"), "role_confidence").alias("_b"))
    r = F.when(F.col("_a.role") != "unknown", F.col("_a")).otherwise(F.coalesce("_b", "_a"))
    return a.join(b, [doc, order], "full").select(doc, order, r.alias("_r")).select(doc, order, "_r.role", "_r.role_confidence")


def merged_types(own: DataFrame, model: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Kinds of documents (doc, document_type, confidence): the model's only where the words tell none."""
    b = model.select(doc, F.struct("document_type", "confidence").alias("_b"))
    r = F.when((F.col("document_type") == "unknown") & F.col("_b").isNotNull(), F.col("_b")).otherwise(F.struct("document_type", "confidence"))
    return own.join(b, doc, "left").select(doc, r.alias("_r")).select(doc, "_r.*")


def merged_sections(own: DataFrame, model: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Sections (doc, section, blocks array<bigint>, seq): all by headings, and those of a model that share no block with them or with one of the model's taken before."""
    claimed = own.groupBy(doc).agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("_c"))
    m = model.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("seq", "section", "blocks"))).alias("_m"))  # the sections of one reply
    start = F.struct(F.coalesce("_c", F.array().cast("array<bigint>")).alias("c"), F.array().cast("array<struct<seq:int,section:string,blocks:array<bigint>>>").alias("out"))
    taken = F.aggregate("_m", start, lambda acc, x: F.when(F.arrays_overlap(acc["c"], x["blocks"]), acc).otherwise(F.struct(F.array_union(acc["c"], x["blocks"]).alias("c"), F.array_append(acc["out"], x).alias("out"))))["out"]
    more = m.join(claimed, doc, "left").select(doc, F.explode(taken).alias("x")).select(doc, "x.section", "x.blocks", "x.seq", F.lit("model").alias("by"))
    return own.select(doc, "section", "blocks", "seq", F.lit("headings").alias("by")).unionByName(more)


TABULAR = ["csv", "xlsx", "xls", "parquet", "avro"]


def block_onset(blocks: DataFrame, doc: str = "doc_id", order: str = "block_id") -> DataFrame:
    """Rows (doc, onset): the page or sheet of the first block with a signal; "0" for tables and without any."""
    hit = has_signal(F.col("text")) & ~F.lower("file_type").isin(TABULAR)
    return blocks.groupBy(doc).agg(F.min_by("page_or_sheet", F.when(hit, F.col(order))).alias("p")).select(doc, F.coalesce("p", F.lit("0")).alias("onset"))


def sample_blocks(blocks: DataFrame, starts: DataFrame, doc: str = "doc_id", order: str = "block_id", table_rows: int = 50, prose: int = 20) -> DataFrame:
    """The sample of each document, by kind: all blocks of a PDF's onset page, the first of a table's onset sheet, the first of other texts from the onset on."""
    b = blocks.join(starts, doc).withColumn("_on", F.col("page_or_sheet") == F.col("onset")).withColumn("_kind", F.when(F.lower("file_type") == "pdf", "pdf").when(F.lower("file_type").isin(TABULAR), "table").otherwise("prose"))
    b = b.withColumn("_from", F.min(F.when(F.col("_on"), F.col(order))).over(W.partitionBy(doc)))
    b = b.where(F.when(F.col("_kind") == "prose", F.col(order) >= F.col("_from")).otherwise(F.col("_on")))
    b = b.withColumn("sample_no", F.row_number().over(W.partitionBy(doc).orderBy(order)))
    most = F.when(F.col("_kind") == "table", table_rows).when(F.col("_kind") == "prose", prose)
    return b.where(F.col("sample_no") <= F.coalesce(most, F.col("sample_no"))).drop("_on", "_kind", "_from")


def has_signal(text: Column) -> Column:
    out = F.lit(False)
    for pattern in V.ONSET_SIGNALS:
        out = out | text.rlike(pattern)
    return out


def onset(blocks: DataFrame, doc: str = "doc_id", page: str = "page", back: int = 1) -> DataFrame:
    """Rows (doc, onset): the first page with a signal, less one, not below 0; 0 without any."""
    return blocks.groupBy(doc).agg(F.min(F.when(has_signal(F.col("text")), F.col(page))).alias("p")).select(doc, F.greatest(F.coalesce(F.col("p") - back, F.lit(0)), F.lit(0)).alias("onset"))


def candidate_pages(blocks: DataFrame, doc: str = "doc_id", page: str = "page", order: str = "block_id", most: int = 5) -> DataFrame:
    """The first pages with a signal, in order of appearance."""
    p = blocks.where(has_signal(F.col("text"))).groupBy(doc, page).agg(F.min(order).alias("first"))
    return p.withColumn("rank", F.row_number().over(W.partitionBy(doc).orderBy("first"))).where(F.col("rank") <= most)


def verified_onset(blocks: DataFrame, detected: DataFrame, doc: str = "doc_id", page: str = "page", order: str = "block_id", scan: int = 20) -> DataFrame:
    """Rows (doc, onset): the first candidate page, or the page after it, with a detection of 0.70 or more; else such a
    page among the first `scan` others; else 0."""
    sure = detected.where("score >= 0.70").select(doc, page).distinct()
    cand = candidate_pages(blocks, doc, page, order)
    tries = cand.select(doc, F.explode(F.array(F.struct((F.col("rank") * 2).alias("k"), F.col(page).alias("p")), F.struct((F.col("rank") * 2 + 1).alias("k"), (F.col(page) + 1).alias("p")))).alias("t")).select(doc, "t.*")
    rest = blocks.select(doc, F.col(page).alias("p")).distinct().join(tries.select(doc, "p").distinct(), [doc, "p"], "left_anti")
    rest = rest.withColumn("r", F.row_number().over(W.partitionBy(doc).orderBy("p"))).where(F.col("r") <= scan).select(doc, (F.col("r") + 1000).alias("k"), "p")
    found = tries.unionByName(rest).join(sure.withColumnRenamed(page, "p"), [doc, "p"], "left_semi").groupBy(doc).agg(F.min_by("p", "k").alias("o"))
    return blocks.select(doc).distinct().join(found, doc, "left").select(doc, F.coalesce("o", F.lit(0)).alias("onset"))


def sampled(blocks: DataFrame, starts: DataFrame, doc: str = "doc_id", page: str = "page", order: str = "block_id", prose: int = 20) -> DataFrame:
    """The first blocks of each document from its onset page on."""
    b = blocks.join(starts, doc).where(F.col(page) >= F.col("onset"))
    return b.withColumn("sample_no", F.row_number().over(W.partitionBy(doc).orderBy(order))).where(F.col("sample_no") <= prose)


def stitched(pages: DataFrame, doc: str = "doc_id", sheet: str | None = None, page: str = "page", text: str = "text", lines: int = 5) -> DataFrame:
    """pages with the last lines of the page before in front, how long that tail is (without the line break), and from_page, the page it is of: what is found in it spans both."""
    w = W.partitionBy(*[c for c in (doc, sheet) if c]).orderBy(page)
    before = F.split(F.lag(text).over(w), r"\R")
    tail = F.array_join(F.slice(before, F.greatest(F.size(before) - lines + 1, F.lit(1)), lines), "\n")
    out = pages.withColumn("tail", tail).withColumn("tail_len", F.coalesce(F.length("tail"), F.lit(0))).withColumn("from_page", F.when(F.col("tail").isNotNull(), F.lag(page).over(w)))
    return out.withColumn("stitched", F.when(F.col("tail").isNull(), F.col(text)).otherwise(F.concat("tail", F.lit("\n"), F.col(text)))).drop("tail")


def id_columns(cells: DataFrame, by: list[str], share: float = 0.80) -> DataFrame:
    """Columns whose non-blank values are structured identifiers by more than the share."""
    one = F.regexp_like(F.trim("text"), F.lit("(?i)^(?:" + "|".join(V.ID_FORMS) + ")$"))
    return cells.where(F.trim("text") != "").groupBy(*by).agg(F.avg(F.when(one, 1.0).otherwise(0.0)).alias("share"), F.count("*").alias("n")).withColumn("review", F.col("share") > share)


def overlapping(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of boxes of one page that share an area: an equi-join on the page with four inequalities as residual."""
    cond = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in by]
    cond += [F.col("l.x0") < F.col("r.x1"), F.col("r.x0") < F.col("l.x1"), F.col("l.y0") < F.col("r.y1"), F.col("r.y0") < F.col("l.y1")]
    return a.alias("l").join(b.alias("r"), cond)


def prompt_budget(blocks: DataFrame, doc: str = "doc_id", order: str = "block_id", chars: int = 4000, most: int = 40) -> DataFrame:
    """Blocks that fit a running budget of characters, the one that passes it cut, at most so many of a document."""
    w = W.partitionBy(doc).orderBy(order)
    b = blocks.withColumn("upto", F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("no", F.row_number().over(w))
    left = F.lit(chars) - (F.col("upto") - F.length("text"))
    return b.where((left > 0) & (F.col("no") <= most)).withColumn("excerpt", F.substring("text", F.lit(1), left.cast("int"))).drop("upto")


def unfenced(reply: Column) -> Column:
    """A model's reply without the lines that fence its code."""
    lines = F.filter(F.split(F.trim(reply), "\n"), lambda x: ~F.startswith(F.trim(x), F.lit("```")))
    return F.when(F.startswith(F.trim(reply), F.lit("```")), F.array_join(lines, "\n")).otherwise(F.trim(reply))


def parsed_reply(reply: Column, schema: str) -> Column:
    """JSON of a model's reply without its code fence; what doesn't parse is null."""
    return F.from_json(F.regexp_replace(F.regexp_replace(reply, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""), schema, {"mode": "PERMISSIVE"})


def each(reply: Column, field: str, schema: str) -> Column:
    """The elements of an array of a reply, each parsed by itself: one that is none is dropped and hurts no other."""
    raw = F.from_json(reply, f"`{field}` array<string>")[field]
    known = F.filter(F.transform(raw, lambda x: F.when(F.startswith(F.ltrim(x), F.lit("{")), F.from_json(x, schema))), lambda x: x.isNotNull())
    return F.coalesce(known, F.from_json(F.lit("[]"), f"array<{T.StructType.fromDDL(schema).simpleString()}>"))


def clamped(c: Column, default: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(default))))


def structure_reply(reply: Column) -> Column:
    """A model's structure of a document: kind (unknown if it is none) and clamped confidence, sections and roles of known kinds only; null if the reply is no JSON object."""
    r = unfenced(reply)
    head = F.from_json(r, "document_type string, confidence double")
    kind = F.when(head["document_type"].isin(list(V.DOCUMENT_WORDS)), head["document_type"]).otherwise("unknown")
    sections_ = F.filter(each(r, "sections", "section_type string, page_start int, page_end int, block_indices array<int>, confidence double"), lambda x: x["section_type"].isin(list(V.SECTION_ROLES)))
    roles = F.filter(each(r, "entity_roles", "block_index int, entity_role string, confidence double"), lambda x: x["entity_role"].isin(sorted(set(V.SECTION_ROLES.values()))) & (x["block_index"] >= 0))
    return F.when(F.startswith(r, F.lit("{")) & F.get_json_object(r, "$").isNotNull(), F.struct(kind.alias("document_type"), clamped(head["confidence"]).alias("confidence"), sections_.alias("sections"), roles.alias("entity_roles")))


def schema_reply(reply: Column) -> Column:
    """A model's understanding of a document, element by element: fields, people, dates, tables, hints and the clamped confidence; null if the reply is no JSON object."""
    r = unfenced(reply)
    head = F.from_json(r, "document_type string, suppression_hints array<string>, schema_confidence double")
    fields = each(r, "field_map", "label string, value_example string, semantic_type string, is_pii boolean, presidio_override string, suppress_types array<string>")
    people = F.transform(each(r, "people", "name string, role string, is_pii_subject boolean"), lambda p: F.struct(p["name"].alias("name"), F.coalesce(p["role"], F.lit("unknown")).alias("role"), F.coalesce(p["is_pii_subject"], F.lit(False)).alias("is_pii_subject")))
    fields = F.transform(fields, lambda f: F.struct(f["label"].alias("label"), f["value_example"].alias("value"), F.coalesce(f["is_pii"], F.lit(False)).alias("is_pii"), f["presidio_override"].alias("override"), F.coalesce(f["suppress_types"], F.array().cast("array<string>")).alias("suppress_types")))
    return F.when(F.startswith(r, F.lit("{")) & F.get_json_object(r, "$").isNotNull(), F.struct(
        F.coalesce(head["document_type"], F.lit("unknown")).alias("document_type"), fields.alias("fields"), people.alias("people"), each(r, "date_contexts", "value string, semantic_type string, is_pii boolean").alias("dates"),
        each(r, "tables", "columns array<struct<header:string,contains_pii:boolean>>, has_pii_columns boolean").alias("tables"),
        F.coalesce(head["suppression_hints"], F.array().cast("array<string>")).alias("hints"), clamped(head["schema_confidence"]).alias("confidence")))


STAGES = ["Discovery", "Cataloging", "PII Detection", "PII Extraction", "Normalization", "Entity Resolution", "Quality Assurance", "Notification"]


def stage_status(runs: DataFrame, own: str | None = None) -> DataFrame:
    """Rows (run_id, stage, status): own (map of stage to status) if the run has any, else what the run's status tells: completed, failed or pending."""
    s = runs.withColumn("_own", F.col(own) if own else F.lit(None).cast("map<string,string>")).withColumn("stage", F.explode(F.array(*map(F.lit, STAGES))))
    told = F.when(F.coalesce(F.size(F.map_keys("_own")), F.lit(0)) > 0, F.coalesce(F.col("_own")[F.col("stage")], F.lit("pending"))).otherwise(F.when(F.col("status").isin("completed", "failed"), F.col("status")).otherwise("pending"))
    return s.select("run_id", "stage", told.alias("status"))


def sample_size(population: Column, rate: float, least: int = 1, most: int | None = None) -> Column:
    """A share of a population, rounded up, at least `least`, at most `most` and all there are."""
    if not 0 < rate <= 1 or least < 1:
        raise ValueError("rate must be in (0, 1] and least at least 1")
    n = F.greatest(F.lit(least).cast("bigint"), F.ceil(population * F.lit(rate)))
    n = F.least(n, F.lit(most).cast("bigint")) if most is not None else n
    return F.when(population <= 0, F.lit(0).cast("bigint")).otherwise(F.least(n, population))
