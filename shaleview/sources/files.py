"""Readers of files into block rows, through binaryFile or Spark's own sources; each file is read by one task, files in parallel."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from email import message_from_bytes, policy
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import ID_FORMS
from . import avro

EXTENSIONS = ["pdf", "docx", "xlsx", "xls", "csv", "html", "htm", "eml", "msg", "parquet", "avro"]
BLOCK = "text string, page_or_sheet string, source_path string, file_type string, block_type string, row_no int, column_no int, table_id string, col_header string, row_index int"
COLUMNS = [c.split()[0] for c in BLOCK.split(", ")]


def block(text: str, page, kind: str = "prose", row=None, column=None, table=None, header=None, index=None) -> tuple:
    return text, str(page), kind, row, column, table, header, index


class _Visible(HTMLParser):
    hidden = {"script", "style", "head", "meta", "link"}
    void = {"meta", "link"}

    def __init__(self, hidden: set[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.hidden, self.depth, self.parts = hidden or self.hidden, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.hidden and tag not in self.void

    def handle_endtag(self, tag):
        self.depth -= tag in self.hidden and tag not in self.void and self.depth > 0

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def html_lines(markup: str, hidden: set[str] | None = None) -> list[str]:
    """Visible, trimmed, non-blank lines."""
    p = _Visible(hidden)
    p.feed(markup)
    return [s for part in p.parts for line in part.split("\n") if (s := line.strip())]


def read_html(data: bytes, path: str) -> Iterator[tuple]:
    for line in html_lines(data.decode("utf-8", "replace")):
        yield block(line, 0)


def read_email(data: bytes, path: str) -> Iterator[tuple]:
    """Text of every body part that is no attachment; the page is the part's number."""
    n = 0
    for part in message_from_bytes(data, policy=policy.default).walk():
        if part.is_multipart() or part.get_content_disposition() == "attachment" or part.get_content_type() not in ("text/plain", "text/html"):
            continue
        raw = part.get_payload(decode=True) or b""
        try:
            text = raw.decode(part.get_content_charset() or "utf-8", "replace")
        except LookupError:
            text = raw.decode("utf-8", "replace")
        lines = html_lines(text, {"script", "style"}) if part.get_content_type() == "text/html" else [s for x in text.splitlines() if (s := x.strip())]
        for line in lines:
            yield block(line, n)
        n += 1


_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def id_column(values: list[str], share: float = 0.80) -> bool:
    """Whether more than the share of the non-blank values are structured identifiers."""
    v = [x.strip() for x in values if x.strip()]
    return bool(v) and sum(any(re.fullmatch(f, x, re.I) for f in ID_FORMS) for x in v) / len(v) > share


def _cell(c, shared: list[str]) -> str:
    if c.get("t") == "inlineStr":
        return "".join(t.text or "" for t in c.iter(_M + "t"))
    v = c.find(_M + "v")
    return "" if v is None or v.text is None else shared[int(v.text)] if c.get("t") == "s" else v.text


def read_xlsx(data: bytes, path: str) -> Iterator[tuple]:
    """Visible sheets: header row 1, then every cell of rows 2 on, blank ones too; headers of identifier columns are marked."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = ["".join(t.text or "" for t in si.iter(_M + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_M + "sheet"):
        if sheet.get("state", "visible") != "visible":
            continue
        target = targets[sheet.get(_R + "id")].lstrip("/")
        rows: dict[int, dict[int, str]] = {}
        for c in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(_M + "c"):
            letters, number = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
            column = 0
            for x in letters:
                column = column * 26 + ord(x) - 64
            rows.setdefault(int(number), {})[column] = _cell(c, shared)
        if not rows:
            continue
        width, last, name = max(max(r) for r in rows.values()), max(rows), sheet.get("name")
        heads = [rows.get(1, {}).get(i, "") for i in range(1, width + 1)]
        marked = [f"[REVIEW] {h}" if id_column([rows.get(r, {}).get(i, "") for r in range(2, last + 1)]) else h for i, h in enumerate(heads, 1)]
        table = f"{path}#{name}"
        for i, h in enumerate(marked, 1):
            yield block(h, name, "table_header", 1, i, table, h)
        for r in range(2, last + 1):
            for i, h in enumerate(marked, 1):
                yield block(rows.get(r, {}).get(i, ""), name, "table_cell", r, i, table, h, r - 2)


def read_docx(data: bytes, path: str) -> Iterator[tuple]:
    """Paragraphs, then tables with their header row, which is kept where blank."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(_W + "body")
    said = lambda e: "".join(t.text or "" for t in e.iter(_W + "t")).strip()
    for p in body.findall(_W + "p"):
        if s := said(p):
            yield block(s, 0)
    for n, t in enumerate(body.findall(_W + "tbl")):
        heads: list[str] = []
        for r, row in enumerate(t.findall(_W + "tr")):
            cells = [said(c) for c in row.findall(_W + "tc")]
            heads = heads or cells
            for i, text in enumerate(cells):
                if r == 0:
                    yield block(text, 0, "table_header", 0, i, f"{path}#{n}", text)
                elif text:
                    yield block(text, 0, "table_cell", r, i, f"{path}#{n}", heads[i] if i < len(heads) else None, r - 1)


def read_avro(data: bytes, path: str) -> Iterator[tuple]:
    for text, page, row, column, header in avro.cells(data):
        yield block(text, page, "table_cell", row, column, None, header, row)


READERS: dict[str, Callable[[bytes, str], Iterator[tuple]]] = {"html": read_html, "htm": read_html, "xml": read_html, "eml": read_email, "xlsx": read_xlsx, "docx": read_docx, "avro": read_avro}
FALLBACK: list[Callable[[bytes, str], Iterator[tuple]]] = []  # at most one reader, for extensions that have none


def register(extension: str, reader: Callable[[bytes, str], Iterator[tuple]]) -> None:
    """Use reader(bytes, path) for files of an extension, before any built-in one; "*" is for those that have none."""
    if extension == "*":
        FALLBACK[:] = [reader]
    else:
        READERS[extension.lower().lstrip(".")] = reader


def reader_for(path: str) -> Callable[[bytes, str], Iterator[tuple]]:
    name = path.rsplit("/", 1)[-1]
    if "." not in name:
        raise ValueError(f"{path}: no extension")
    extension = name.rsplit(".", 1)[1].lower()
    if extension not in READERS and FALLBACK:
        return FALLBACK[0]
    if extension not in READERS:
        raise ValueError(f"{path}: no reader for {extension}")
    return READERS[extension]


def discovered(spark: SparkSession, *roots: str, extensions: list[str] | None = None) -> DataFrame:
    """Files below the roots with their hash; the first of equal content stays, in the order of the roots, then paths."""
    found = None
    for i, root in enumerate(roots):
        d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root).select(
            F.lit(i).alias("root_no"), F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"),
            F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("file_type"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
        found = d if found is None else found.unionByName(d)
    found = found.where(F.col("file_type").isin(extensions or EXTENSIONS))
    first = F.struct("root_no", "source_path")
    return found.groupBy("sha256").agg(F.min_by(F.struct("source_path", "file_name", "file_type", "size_bytes"), first).alias("f")).select("f.*", "sha256").orderBy("source_path")


def fetched(spark: SparkSession, documents: DataFrame, path: str = "source_path") -> DataFrame:
    """documents with the content of their file; each path is opened by one task, a missing file gives null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for at in f[path]:
                try:
                    with open(str(at).removeprefix("file://").removeprefix("file:"), "rb") as h:
                        out.append(h.read())
                except OSError:
                    out.append(None)
            yield f.assign(content=out)

    return documents.mapInPandas(run, T.StructType([*documents.schema.fields, T.StructField("content", T.BinaryType())]))


def upload_gate(listing: DataFrame, by: list[str], order: str, most_file: int = 100 << 20, most_total: int = 500 << 20) -> DataFrame:
    """Rows (by, n_files, total_bytes, outcome) of each upload: accepted, or what its first file beyond a cap is; files of other types don't count."""
    total = F.sum("size_bytes").over(W.partitionBy(*by).orderBy(order))
    d = listing.where(F.lower("file_type").isin(EXTENSIONS)).withColumn("_total", total)
    bad = F.when(F.col("size_bytes") > most_file, "file too large").when(F.col("_total") > most_total, "total too large")
    return d.groupBy(*by).agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("total_bytes"), F.coalesce(F.min_by(bad, F.when(bad.isNotNull(), F.col(order))), F.lit("accepted")).alias("outcome"))


# Kinds of failures, and which of them are worth another try.
CATEGORIES = {"transient_io": True, "ocr_timeout": True, "corrupt_file": False, "schema_violation": False, "unknown": True}


def category(e: BaseException) -> str:
    """The kind of a failure."""
    if isinstance(e, TimeoutError):
        return "ocr_timeout"
    if isinstance(e, (AssertionError, TypeError)) or isinstance(e, ValueError) and "block" in str(e) and "avro" not in str(e):
        return "schema_violation"
    if isinstance(e, (zipfile.BadZipFile, ElementTree.ParseError, UnicodeError, EOFError, KeyError, ValueError, IndexError)):
        return "corrupt_file"
    return "transient_io" if isinstance(e, OSError) else "unknown"


def blocks(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """Block rows of every file below root that has a byte reader; a file that can't be read gives one row of type error, with its category."""
    readers = dict(READERS)
    fallback = list(FALLBACK)
    schema = BLOCK + ", error string, category string, retryable boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                extension = path.rsplit(".", 1)[-1].lower()
                try:
                    rows = [(t, page, path, extension, kind, *rest, None, None, None) for t, page, kind, *rest in readers.get(extension, *fallback)(bytes(content), path)]
                except Exception as e:  # a corrupt file must not end the job
                    rows = [(None, None, path, extension, "error", None, None, None, None, None, f"{type(e).__name__}: {e}"[:200], category(e), CATEGORIES[category(e)])]
                yield pd.DataFrame(rows, columns=[*COLUMNS, "error", "category", "retryable"])

    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    wanted = kind.isin([e for e in (extensions or list(readers)) if e in readers]) | (kind.isin(extensions) if extensions and fallback else F.lit(bool(fallback) and not extensions))
    return d.where(wanted).select("path", "content").mapInPandas(run, schema)


def cells(df: DataFrame, path: str, file_type: str, page: Column | None = None) -> DataFrame:
    """A table's cells as block rows: trimmed, blank ones dropped, every value as text."""
    names = [c for c in df.columns if c != "_page"]
    each = F.array(*[F.struct(F.lit(i).alias("column_no"), F.lit(c).alias("col_header"), F.trim(F.col(f"`{c}`").cast("string")).alias("text")) for i, c in enumerate(names)])
    return df.select((F.lit("0") if page is None else page).alias("page_or_sheet"), F.explode(each).alias("c")).where("c.text <> ''").select("c.text", "page_or_sheet", F.lit(path).alias("source_path"), F.lit(file_type).alias("file_type"), F.lit("table_cell").alias("block_type"), "c.column_no", "c.col_header")


def csv_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Header blocks once, then cells; all text, nothing inferred, NA stays text."""
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    heads = spark.createDataFrame([(c, "0", path, "csv", "table_header", i, c) for i, c in enumerate(df.columns)], "text string, page_or_sheet string, source_path string, file_type string, block_type string, column_no int, col_header string")
    return heads.unionByName(cells(df, path, "csv"))


def row_groups(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Rows (path, page, first, last): the rows of each row group, from the footers of the files, each read by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs, parquet

        for f in frames:
            out = []
            for path in f["path"]:
                files, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                meta = parquet.read_metadata(at, filesystem=files)
                n = 0
                for i in range(meta.num_row_groups):
                    out.append((path, i, n, n + meta.row_group(i).num_rows - 1))
                    n += meta.row_group(i).num_rows
            yield pd.DataFrame(out, columns=["path", "page", "first", "last"])

    return paths.mapInPandas(run, "path string, page int, first bigint, last bigint")


def parquet_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of Parquet files; the page is the number of the row group."""
    df = spark.read.parquet(path)
    names = df.columns
    d = df.select(*[f"`{c}`" for c in names], F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    g = row_groups(spark, spark.createDataFrame([(p,) for p in df.inputFiles()], "path string"))
    # the file's path joins, its few row groups are told apart by their rows
    at = d.join(g, (F.regexp_replace("_path", "^file:/+", "/") == F.regexp_replace("path", "^file:/+", "/")) & F.col("_row").between(F.col("first"), F.col("last")))
    return cells(at.select(*[f"`{c}`" for c in names], F.col("page").cast("string").alias("_page")), path, "parquet", F.col("_page"))


def table_blocks(spark: SparkSession, url: str, table: str, properties: dict | None = None) -> DataFrame:
    """Cells of a database table through JDBC."""
    return cells(spark.read.jdbc(url, table, properties=properties or {}), f"{url}/{table}", "jdbc")
