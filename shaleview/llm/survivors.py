"""Problem 5: the surviving values of each group of duplicate records.

A record is dominated if another of its group is at least as complete in every field, as recent and as trusted, and differs.
Undominated records are the first dominance layer of their group, what is undominated without them the second, and so on. The
survivor takes each field from the first layer by policy (completeness, then recency, then trust, then the smaller key);
fields that are null in it are filled from the second layer, and so on until nothing is missing or no record is left.

A layer is found in two steps: each Arrow batch drops what it can (the skyline of a union lies in the union of the skylines),
then the rest meets by group, streamed through a running skyline, so that of a group of any size only undominated
records are ever held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, written

FIELDS = ["canonical_name", "canonical_email", "canonical_phone"]
# What is written where a name is missing.
FILLERS = ["unknown", "n/a", "na", "none", "null", "nil", "test", "tbd", "anonymous", "not known", "not given", "no name", "name withheld", "withheld", "redacted", "-"]
EMAIL = r"^[^@\s*?]+@[^@\s.*?]+(\.[^@\s.*?]+)+$"
PHONE = r"^\+(1[0-9]{10}|[2-9][0-9]{10,14})$"


def completeness(field: str) -> Column:
    """0 where the value is not usable, otherwise larger for fuller values.

    A name counts two for each part written out and one for an initial; an email or number is complete or not.
    """
    v = F.trim(F.coalesce(F.col(field), F.lit("")))
    if field == "canonical_email":
        return v.rlike(EMAIL).cast("int")
    if field == "canonical_phone":
        return F.regexp_replace(v, r"[\s().-]", "").rlike(PHONE).cast("int")
    full = F.size(F.regexp_extract_all(v, F.lit(r"(?U)\p{L}[\p{L}\p{M}'’-]+"), F.lit(0)))
    initial = F.size(F.regexp_extract_all(v, F.lit(r"(?U)(?<![\p{L}\p{M}'’-])\p{L}(?![\p{L}\p{M}'’-])"), F.lit(0)))
    return F.when(F.lower(v).isin(FILLERS) | (full == 0) | v.rlike(r"[0-9*?@]"), 0).otherwise(2 * full + initial)


def undominated(b: pa.Table, group: str, levels: list[str], dims: list[str]) -> np.ndarray:
    """Mask of the rows that no other row of their group dominates in all levels and both dims (greater is better); equal rows stay.

    levels are integers of few values, dims two doubles without nulls.
    """
    keep = np.ones(b.num_rows, bool)
    if not b.num_rows:
        return keep
    g = pc.fill_null(pc.dictionary_encode(b.column(group).combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
    full = np.stack([b.column(c).to_numpy() for c in levels], 1)
    fresh, trust = (b.column(c).to_numpy() for c in dims)
    for level in np.unique(full, axis=0):
        # rows at least as full as the level, the freshest first: a row is dominated by an earlier, different one of as much trust
        at = np.flatnonzero((full >= level).all(1))
        mine = (full[at] == level).all(1)
        o = np.lexsort((mine, -trust[at], -fresh[at], g[at]))
        at, mine = at[o], mine[o]
        rank = np.unique(trust[at], return_inverse=True)[1] + (g[at].astype(np.int64) + 1) * (len(at) + 1)  # rises from group to group
        best = np.concatenate(([-1], np.maximum.accumulate(rank)[:-1]))
        new = np.ones(len(at), bool)
        new[1:] = (g[at][1:] != g[at][:-1]) | (fresh[at][1:] != fresh[at][:-1]) | (trust[at][1:] != trust[at][:-1]) | (mine[1:] != mine[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))  # equal rows share what comes before the first of them
        keep[at[mine & (best[first] >= rank)]] = False
    return keep


def skyline(df: DataFrame, group: str, levels: list[str], dims: list[str]) -> DataFrame:
    """df without rows that another row of their group dominates, over all partitions."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(undominated(pa.Table.from_batches([b]), group, levels, dims)))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # undominated rows of the last group, which may go on
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            t = t.filter(pa.array(undominated(t, group, levels, dims)))
            last = pc.equal(t.column(group), t.column(group)[-1]) if t.num_rows else None
            if last is None:
                continue
            held = t.filter(last)
            yield from t.filter(pc.invert(last)).combine_chunks().to_batches()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return df.mapInArrow(local, df.schema).repartition(group).sortWithinPartitions(group).mapInArrow(merged, df.schema)


def records(df: DataFrame, group: str = "group_id", key: str = "subject_id", fields: list[str] | None = None, recency: str = "updated_at", trust: str = "merge_confidence") -> DataFrame:
    """Distinct rows (g, k, fresh, trust, f0.., v0..): completeness and value of each field; null groups and keys are left out."""
    when = F.coalesce(F.unix_micros(F.col(recency).cast("timestamp")).cast("double"), F.lit(float("-inf")))
    sure = F.coalesce(F.col(trust).cast("double"), F.lit(float("-inf")))
    fields = fields or FIELDS
    return df.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(
        F.col(group).alias("g"), F.col(key).alias("k"), when.alias("fresh"), sure.alias("trust"), *[completeness(f).alias(f"f{i}") for i, f in enumerate(fields)], *[F.col(f).alias(f"v{i}") for i, f in enumerate(fields)]).distinct()


def field_survivors(df: DataFrame, group: str = "group_id", key: str = "subject_id", fields: list[str] | None = None,
                    recency: str = "updated_at", trust: str = "merge_confidence") -> DataFrame:
    """Rows (group, field_name, value, key): the surviving value of every field of every group that has a usable one.

    Null groups and keys are left out, null recency or trust counts as least, repeated rows count once; other
    columns are ignored.
    """
    fields = fields or FIELDS
    n = len(fields)
    levels = [f"f{i}" for i in range(n)]
    left = records(df, group, key, fields, recency, trust)
    found = None
    while True:
        layer = written(skyline(left, "g", levels, ["fresh", "trust"]), "p5-layer")
        long = layer.select("g", "k", "fresh", "trust", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"f{i}").alias("full"), F.col(f"v{i}").alias("value")) for i, f in enumerate(fields)])).alias("v")).select("g", "k", "fresh", "trust", "v.*")
        policy = F.struct(-F.col("full"), -F.col("fresh"), -F.col("trust"), F.col("k"))
        best = long.where("full > 0").groupBy("g", "field_name").agg(F.min_by(F.struct("k", "value"), policy).alias("w"))
        if found is not None:
            best = best.join(found, ["g", "field_name"], "left_anti")
        found = best if found is None else found.unionByName(best)
        # the next layer matters only where a field is still null here and usable below. What holds a field's greatest
        # completeness isn't dominated but by what is as complete in it, so this ends after the first layer unless usable
        # values are told otherwise than by completeness
        short = layer.groupBy("g").agg(*[F.max(f).alias(f"m{i}") for i, f in enumerate(levels)])
        missing = F.lit(False)
        for i in range(n):
            missing = missing | (F.col(f"m{i}") == 0) & (F.col(f"f{i}") > 0)
        rest = left.join(short, "g").where(missing).drop(*[f"m{i}" for i in range(n)]).join(layer.select("g", "k").distinct(), ["g", "k"], "left_anti")
        if rest.isEmpty():
            break
        left = written(rest, "p5-rest")
    return found.select(F.col("g").alias(group), "field_name", F.col("w.value").alias("value"), F.col("w.k").alias(key))


def dominance_layers(df: DataFrame, most: int, group: str = "group_id", key: str = "subject_id") -> DataFrame:
    """Rows (group, key, layer) of the first `most` dominance layers; what lies deeper has layer most + 1."""
    fields = FIELDS
    left = written(records(df, group, key), "p5-records")
    out = None
    for i in range(most):
        layer = written(skyline(left, "g", [f"f{j}" for j in range(len(fields))], ["fresh", "trust"]), "p5-layer")
        part = layer.select("g", "k", F.lit(i + 1).alias("layer"))
        out = part if out is None else out.unionByName(part)
        left = written(left.exceptAll(layer), "p5-rest")
    out = out.unionByName(left.select("g", "k", F.lit(most + 1).alias("layer")))
    return out.groupBy(F.col("g").alias(group), F.col("k").alias(key)).agg(F.min("layer").alias("layer"))


def plural_groups(df: DataFrame, group: str = "group_id", key: str = "subject_id") -> DataFrame:
    """Groups of two or more different keys."""
    return df.groupBy(group).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo < hi").select(group)


def p5_found(spark, sf_dir) -> DataFrame:
    subjects = read(spark, sf_dir, "notification_subjects")
    return field_survivors(subjects).join(plural_groups(subjects), "group_id", "left_semi").select("group_id", "field_name", "subject_id")


def p5_survivors(spark, sf_dir) -> DataFrame:
    """One surviving row a group, each field from its best record."""
    best = field_survivors(read(spark, sf_dir, "notification_subjects"))
    return best.groupBy("group_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in FIELDS])


def p5_layers(spark, sf_dir) -> DataFrame:
    """How many subjects stand in each dominance layer of their group."""
    layers = dominance_layers(read(spark, sf_dir, "notification_subjects"), 2)
    return layers.groupBy("layer").agg(F.count("*").alias("n_subjects"))


_BEST = r"""
WITH s AS (SELECT DISTINCT group_id, subject_id, canonical_name, canonical_email, canonical_phone, merge_confidence, updated_at FROM notification_subjects WHERE group_id IS NOT NULL AND subject_id IS NOT NULL),
v AS (
SELECT group_id, subject_id, 'canonical_name' AS field_name, canonical_name AS value, updated_at, merge_confidence,
  CASE WHEN lower(trim(canonical_name)) IN ('unknown','n/a','na','none','null','nil','test','tbd','anonymous','not known','not given','no name','name withheld','withheld','redacted','-') OR regexp_matches(canonical_name, '[0-9*?@]') THEN 0
  ELSE list_sum([CASE WHEN length(regexp_replace(w, '[.,]', '', 'g')) >= 2 THEN 2 ELSE 1 END FOR w IN string_split_regex(trim(canonical_name), '\s+')])
    * (CASE WHEN regexp_matches(canonical_name, '[[:alpha:]]{2}') THEN 1 ELSE 0 END) END AS fullness FROM s
UNION ALL SELECT group_id, subject_id, 'canonical_email', canonical_email, updated_at, merge_confidence, CASE WHEN regexp_matches(trim(canonical_email), '^[^@\s*?]+@[^@\s.*?]+(\.[^@\s.*?]+)+$') THEN 1 ELSE 0 END FROM s
UNION ALL SELECT group_id, subject_id, 'canonical_phone', canonical_phone, updated_at, merge_confidence, CASE WHEN regexp_matches(trim(canonical_phone), '^\+(1[0-9]{10}|[2-9][0-9]{10,14})$') THEN 1 ELSE 0 END FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY fullness DESC, updated_at DESC, merge_confidence DESC, subject_id) AS rn FROM v WHERE fullness > 0)
"""
SQL = {
    "p5_found": _BEST + "SELECT group_id, field_name, subject_id FROM b WHERE rn = 1 AND group_id IN (SELECT group_id FROM s GROUP BY 1 HAVING count(DISTINCT subject_id) > 1)",
    "p5_survivors": _BEST + "SELECT group_id, max(value) FILTER (field_name = 'canonical_name') AS canonical_name, max(value) FILTER (field_name = 'canonical_email') AS canonical_email, max(value) FILTER (field_name = 'canonical_phone') AS canonical_phone FROM b WHERE rn = 1 GROUP BY 1",
}
_PARTS = r"regexp_extract_all(trim(coalesce(canonical_name, '')), '[\pL\pM''’-]+')"
_ROWS = rf"""
WITH r AS (SELECT DISTINCT group_id, subject_id, updated_at, merge_confidence, canonical_name, canonical_email, canonical_phone FROM notification_subjects WHERE group_id IS NOT NULL AND subject_id IS NOT NULL),
t AS (SELECT DISTINCT group_id, subject_id, coalesce(updated_at, TIMESTAMP '0001-01-01') AS u, coalesce(merge_confidence, -1) AS m, CASE WHEN lower(trim(coalesce(canonical_name, ''))) IN ({", ".join(f"'{x}'" for x in FILLERS)}) OR regexp_matches(coalesce(canonical_name, ''), '[0-9*?@]') THEN 0
  WHEN len(list_filter({_PARTS}, lambda x: regexp_matches(x, '\pL.'))) = 0 THEN 0 ELSE 2 * len(list_filter({_PARTS}, lambda x: regexp_matches(x, '\pL.'))) + len(list_filter({_PARTS}, lambda x: regexp_matches(x, '^\pL$'))) END AS a,
  regexp_matches(trim(coalesce(canonical_email, '')), '^[^@\s*?]+@[^@\s.*?]+(\.[^@\s.*?]+)+$')::INT AS b, regexp_matches(regexp_replace(trim(coalesce(canonical_phone, '')), '[\s().-]', '', 'g'), '^\+(1[0-9]{{10}}|[2-9][0-9]{{10,14}})$')::INT AS c FROM r)"""
_OVER = "SELECT 1 FROM {0} y WHERE y.group_id = x.group_id AND y.a >= x.a AND y.b >= x.b AND y.c >= x.c AND y.u >= x.u AND y.m >= x.m AND (y.a > x.a OR y.b > x.b OR y.c > x.c OR y.u > x.u OR y.m > x.m)"
SQL["p5_layers"] = _ROWS + f""", l1 AS (SELECT * FROM t x WHERE NOT EXISTS ({_OVER.format('t')})), d AS (SELECT * FROM t x WHERE EXISTS ({_OVER.format('t')})), l2 AS (SELECT * FROM d x WHERE NOT EXISTS ({_OVER.format('d')})),
a AS (SELECT group_id, subject_id, 1 AS layer FROM l1 UNION ALL SELECT group_id, subject_id, 2 FROM l2 UNION ALL SELECT group_id, subject_id, 3 FROM d x WHERE EXISTS ({_OVER.format('d')}))
SELECT layer, count(*) AS n_subjects FROM (SELECT group_id, subject_id, min(layer)::INT AS layer FROM a GROUP BY 1, 2) GROUP BY 1"""
QUERIES = {"p5_found": p5_found, "p5_survivors": p5_survivors, "p5_layers": p5_layers}
