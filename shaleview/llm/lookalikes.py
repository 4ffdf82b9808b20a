"""Problem 10: visually identical text with different characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codepoints as cp
from .common import read

KINDS = ["fullwidth", "combining", "zero_width", "nbsp", "lookalike"]


def char_kinds(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, char_kind), one for each kind of odd character that the text has.

    Null and empty texts have no rows; rows of a repeated key are taken together; other columns are ignored.
    """
    spec = df.select(key).schema[key]
    out = f"{spec.name} {spec.dataType.simpleString()}, char_kind string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(KINDS)
        for b in batches:
            row, kind = np.nonzero(cp.kinds(*cp.explode(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), names.take(pa.array(kind))], [spec.name, "char_kind"])

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, out)


def unified(df: DataFrame, text: str = "text", out: str = "unified_text") -> DataFrame:
    """df with the text in one consistent form in a further column; null stays null."""
    cols = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{c}`" for c in cols]).schema) + f", `{out}` string"
    at = cols.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(at)
            new = cp.implode(*cp.unify(*cp.explode(col)), valid=np.array(col.is_valid()))
            yield pa.RecordBatch.from_arrays([*b.columns, new.cast(pa.string())], [*b.schema.names, out])

    return df.select(*[f"`{c}`" for c in cols]).mapInArrow(run, schema)


def p10_found(spark, sf_dir) -> DataFrame:
    return char_kinds(read(spark, sf_dir, "documents")).distinct()


def p10_unified(spark, sf_dir) -> DataFrame:
    """Every document's text in one form, as a digest and its length."""
    df = unified(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", F.length("unified_text").alias("n_unified"), F.sha2("unified_text", 256).alias("unified_sha256"))


SQL = {
    "p10_found": r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[\x{00AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{0300}-\x{036F}]', '', 'g'), '[\p{Latin}\p{Cyrillic}\p{Greek}]+')) AS word FROM d)
SELECT doc_id, 'fullwidth' AS char_kind FROM d WHERE regexp_matches(text, '[\x{FF01}-\x{FF5E}\x{3000}]')
UNION SELECT doc_id, 'combining' FROM d WHERE regexp_matches(text, '[\x{0300}-\x{034E}\x{0350}-\x{036F}]')
UNION SELECT doc_id, 'zero_width' FROM d WHERE regexp_matches(text, '[\x{00AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]')
UNION SELECT doc_id, 'nbsp' FROM d WHERE regexp_matches(text, '[\x{00A0}\x{2007}\x{202F}]')
UNION SELECT doc_id, 'lookalike' FROM w WHERE regexp_matches(word, '\p{Latin}') AND regexp_matches(word, '[\p{Cyrillic}\p{Greek}]') OR regexp_matches(word, '\p{Cyrillic}') AND regexp_matches(word, '\p{Greek}')
""",
}
QUERIES = {"p10_found": p10_found, "p10_unified": p10_unified}
