"""Sinks: masked export, letter manifest, mail delivery, storage of extracted values, audit log."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V

EVENTS = ["ai_extraction", "human_review", "approval", "escalation", "notification_sent"]


def export_fields(wanted: list[str] | None) -> list[str]:
    """The wanted fields that may be exported, in their order; none valid means the default ones."""
    return [f for f in wanted or [] if f in V.EXPORT_ALLOWED] or V.EXPORT_DEFAULT


def export_rows(subjects: DataFrame, fields: list[str] | None = None, project: str | None = None, min_confidence: float | None = None, status: str | None = None, types: list[str] | None = None) -> DataFrame:
    """Filtered, masked and formatted rows of text; the filters reach the scan."""
    d = subjects
    if project is not None:
        d = d.where(F.col("project_id") == project)
    if min_confidence is not None:
        d = d.where(F.col("merge_confidence") >= min_confidence)
    if status is not None:
        d = d.where(F.col("review_status") == status)
    if types:
        d = d.where(F.arrays_overlap("pii_types_found", F.array(*map(F.lit, types))))
    masks = {"canonical_email": X.mask_email, "canonical_phone": X.mask_phone, "canonical_address": X.mask_address}
    kinds = dict(d.dtypes)
    return d.select(*[(masks[f](f) if f in masks else X.formatted(f, kinds[f])).alias(f) for f in export_fields(fields)])


def export_csv(subjects: DataFrame, path: str, **filters) -> None:
    export_rows(subjects, **filters).write.mode("overwrite").option("header", True).csv(path)


def letters(subjects: DataFrame, protocol: str, template: str) -> DataFrame:
    """Manifest columns and the letter's text; subjects without an address are skipped."""
    a = F.col("canonical_address")
    skipped = a.isNull()
    name = F.concat(F.lit(f"{protocol}_"), F.col("subject_id"), F.lit(".html"))
    values = {"name": F.col("canonical_name"), "subject_id": F.col("subject_id"), "street": a["street"], "city": a["city"], "state": a["state"], "zip": a["zip"], "country": a["country"]}
    return subjects.select("subject_id", F.coalesce("canonical_name", F.lit("")).alias("canonical_name"), *[F.coalesce(a[c], F.lit("")).alias(c) for c in ("street", "city", "state", "zip", "country")],
                           F.when(skipped, "").otherwise(name).alias("letter_filename"), F.when(skipped, "SKIPPED").otherwise("RENDERED").alias("status"),
                           F.when(skipped, "no address").otherwise("").alias("error"), F.when(~skipped, X.safe_substitute(template, values)).alias("letter"))


def deliver(subjects: DataFrame, send: Callable[[str, str], None], body: str, attempts: int = 3, per_minute: int = 100, sleep: Callable[[float], None] = time.sleep,
            tasks: int = 1, already: DataFrame | None = None) -> DataFrame:
    """Rows (subject_id, status, attempts): send(address, text) with retries after 1, 2, 4 s.

    per_minute holds for the whole job: each of `tasks` tasks sends its share of it. already: subjects (subject_id) that have got
    their mail and get none again. Delivery is at least once: a task that is lost is run again, so write the result and pass
    it as `already` next time.
    """
    if already is not None:
        subjects = subjects.join(already.select("subject_id").distinct(), "subject_id", "left_anti")

    def run(frames):
        for f in frames:
            out = []
            for key, address in zip(f["subject_id"], f["canonical_email"]):
                if not address:
                    out.append((key, "SKIPPED", 0))
                    continue
                for n in range(1, attempts + 1):
                    try:
                        send(address, body)
                        out.append((key, "DELIVERED", n))
                        break
                    except Exception:  # any transport error is retried
                        if n == attempts:
                            out.append((key, "FAILED", n))
                        else:
                            sleep(2.0 ** (n - 1))
                sleep(60.0 * tasks / per_minute)
            f = f.iloc[: len(out)].assign(status=[o[1] for o in out], attempts=[o[2] for o in out])
            yield f[["subject_id", "status", "attempts"]]

    return subjects.select("subject_id", F.coalesce("canonical_email", F.lit("")).alias("canonical_email")).repartition(tasks, "subject_id").mapInPandas(run, "subject_id string, status string, attempts int")


def stored(found: DataFrame, salt: str, strict: bool = True, key: str | None = None, days: int = 30) -> DataFrame:
    """found without its value: masked and hashed, or (not strict) normalised, hashed and encrypted with a date of deletion."""
    raw = F.coalesce("normalized_value", "value")
    checked = F.when(F.coalesce(F.trim("value"), F.lit("")) == "", F.raise_error(F.lit("empty value"))).otherwise(raw)
    d = found.withColumn("_v", checked)
    if strict:
        d = d.withColumn("stored_value", X.mask_ends("_v", 2, 2)).withColumn("value_hash", X.salted_hash("_v", salt)).withColumn("value_encrypted", F.lit(None).cast("string")).withColumn("storage_policy", F.lit("hash")).withColumn("retain_until", F.lit(None).cast("date"))
    else:
        d = d.withColumn("stored_value", F.col("_v")).withColumn("value_hash", X.salted_hash("_v", salt)).withColumn("value_encrypted", X.encrypted("value", key)).withColumn("storage_policy", F.lit("encrypted")).withColumn("retain_until", F.date_add(F.current_date(), days))
    return d.drop("_v", "value", "normalized_value")


def append_audit(events: DataFrame, path: str) -> None:
    """Append events after checking type and actor; a human decision needs a rationale."""
    bad = ~F.col("event_type").isin(EVENTS) | (F.trim(F.coalesce("actor", F.lit(""))) == "") | F.col("event_type").isin("human_review", "approval") & (F.trim(F.coalesce("rationale", F.lit(""))) == "")
    checked = events.withColumn("event_type", F.when(bad, F.raise_error(F.concat(F.lit("invalid audit event: "), F.coalesce("event_type", F.lit("null"))))).otherwise(F.col("event_type")))
    checked.write.mode("append").parquet(path)


def audit_history(log: DataFrame, subject: str) -> DataFrame:
    return log.where(F.col("subject_id") == subject).orderBy("timestamp")


def audit_by_type(log: DataFrame, kind: str) -> DataFrame:
    return log.where(F.col("event_type") == kind).orderBy("timestamp")


def audit_recent(log: DataFrame, most: int = 100) -> DataFrame:
    return log.orderBy(F.desc("timestamp")).limit(most)
