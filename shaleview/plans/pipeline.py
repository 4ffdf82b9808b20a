"""The stages in one plan: blocks to detections, records, individuals and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import written
from ..operators import detection as D
from ..operators import resolution as R
from ..operators import structure as S

FIELD_OF = {"EMAIL": "raw_email", "EMAIL_ADDRESS": "raw_email", "PHONE_US": "raw_phone", "PHONE_INTL": "raw_phone", "PHONE_NUMBER": "raw_phone", "PERSON": "raw_name",
            "DATE_OF_BIRTH_DMY": "raw_dob", "DATE_OF_BIRTH_MDY": "raw_dob", "DATE_OF_BIRTH_ISO": "raw_dob"}


def detected(blocks: DataFrame, layers: tuple[int, ...] = (1, 2, 3), roles: bool = True, **options) -> DataFrame:
    """Matches that survive suppression, with the layers' scores and the role of their block's section, one a value of each document."""
    d = D.detect(blocks, **options)
    if roles:
        d = S.with_roles(d, S.block_roles(blocks))
    if 2 in layers:
        d = D.signal_boost(d, role="entity_role" if roles else None)
    if 3 in layers and "col_header" in d.columns:
        d = D.header_inference(d)
    d = D.suppressed(d).where("fp_reason is null").drop("fp_reason", "text")
    return D.best_per_value(d, ["doc_id", "page_or_sheet"], ["block_id", "start"])


def assembled(found: DataFrame) -> DataFrame:
    """One record a detection; a table row's other fields join it where the row has a single value of them."""
    fields = ("raw_name", "raw_email", "raw_phone", "raw_dob")
    row = ["doc_id", "page_or_sheet", "table_id", "row_index"]
    own = {f: F.when(F.col("entity_type").isin([k for k, v in FIELD_OF.items() if v == f]), F.col("value")) for f in fields}
    role = F.col("entity_role") if "entity_role" in found.columns else F.lit(None).cast("string")
    r = found.select(*row, "block_id", "entity_type", "start", "end", "value", role.alias("entity_role"), *[c.alias(f) for f, c in own.items()])
    in_row = F.col("table_id").isNotNull() & F.col("row_index").isNotNull()
    cells = r.where(in_row)
    single = cells.groupBy(*row).agg(*[F.when(F.min(f) == F.max(f), F.min(f)).alias(f"row_{f}") for f in fields])
    same = F.lit(True)
    for c in row:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = cells.alias("l").join(single.alias("r"), same, "left").select("l.*", *[f"r.row_{f}" for f in fields])
    every = joined.unionByName(r.where(~in_row), allowMissingColumns=True)
    place = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "page_or_sheet", "block_id", "entity_type", "start", "end", "value")]
    return every.select(F.sha2(F.concat_ws("#", *place), 256).alias("record_id"), "entity_type", F.col("value").alias("normalized_value"), *[F.coalesce(f, f"row_{f}").alias(f) for f in fields],
                        F.lit(None).cast("struct<street:string,city:string,state:string,zip:string,country:string>").alias("raw_address"), F.lit("US").alias("country"), "entity_role", F.col("doc_id").cast("string").alias("source_document_id"))


def run(blocks: DataFrame, anchors: list[str] | None = None, **options) -> dict[str, DataFrame]:
    """Detections, density, records, groups and subjects of a corpus; only the tables between stages are written."""
    found = written(detected(blocks, **options), "run-detections")
    records = written(assembled(found), "run-records")
    members = written(R.groups(records, anchors), "run-groups")
    return {"detections": found, "density": D.density(found), "records": records, "groups": members, "subjects": R.subjects(records, members)}
