"""Problem 1: addresses that denote the same location.

A gazetteer is built from the addresses themselves: spellings of towns are clustered within a postal code and within one set of
premises, spellings of streets within a town, a slip leading to the better attested spelling; each (town, street, kind,
direction) is an entry with an identifier, and the numbers and units known on it are its premises. Every address is then resolved by a
beam search: first its town (its own, or those of its postal code, or those where its premises are known), then the entry,
with a missing kind or direction filled from entries that have its premises. After each step, hypotheses that are far
less likely than the best of their address are given up; the address goes to the best one left, unless another of the same
town contradicts it. Addresses that share the identifier, the number and the unit are one location.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .address_parts import parse
from .common import pairs_within, read, written
from .names import FAR, RATIO, leads

BEAM = 7.0  # nats by which a hypothesis may be less likely than the best one of its address
UNKNOWN = -10.0  # nats of a hypothesis that nothing attests
PARTS = ["number", "unit", "name", "kind", "direction", "town", "state", "code", "country"]
FIELDS = ["street", "city", "state", "zip", "country"]
STREET = ["town", "name", "kind", "direction"]


def parts(rows: DataFrame, key: str = "key", address: str = "address") -> DataFrame:
    """Rows (key, parts) of every address that names a street; null fields and extra columns do no harm."""
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType)] + [T.StructField(n, T.StringType()) for n in PARTS])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.astype(object).where(f.notna(), None)
            got = [(k, p) for k, *a in f.itertuples(index=False) if (p := parse(*a))]
            yield pd.DataFrame([(k, *(p[n] for n in PARTS)) for k, p in got], columns=[key, *PARTS])

    return rows.where(F.col(key).isNotNull()).select(key, *[F.col(f"{address}.{f}").alias(f) for f in FIELDS]).mapInPandas(run, schema)


def _settled(rows: DataFrame, by: list[str], column: str, ratio: int = RATIO, far: int = FAR) -> DataFrame:
    """rows with slips in `column` led to the better attested spelling within the `by` group; only rows that are `sure` attest."""
    counts = rows.where(F.col(column) != "").groupBy(*by, F.col(column).alias("s")).agg(F.countDistinct(F.when(F.col("sure"), F.col("key"))).alias("n"))
    led = leads(counts, by, ratio, far).select(*by, F.col("s").alias(column), F.col("t").alias("_to"))
    return rows.join(led, [*by, column], "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def pruned(hypotheses: DataFrame, beam: float = BEAM) -> DataFrame:
    """Hypotheses (key, score, ...) that are at most `beam` less likely than the best of their key."""
    return hypotheses.withColumn("_best", F.max("score").over(W.partitionBy("key"))).where(F.col("score") >= F.col("_best") - beam).drop("_best")


def localities(p: DataFrame) -> DataFrame:
    """Addresses with settled towns: spellings within a postal code, and within one set of premises."""
    p = p.withColumn("sure", F.lit(True))
    coded = _settled(p.where("code <> ''"), ["code"], "town")
    p = written(coded.unionByName(p.where("code = ''")), "p1-codes")
    return written(_settled(p, ["number", "unit", "name"], "town", 1), "p1-towns")


def supposed_towns(p: DataFrame) -> DataFrame:
    """Addresses with a hypothesis a town: their own, else those of their postal code or those where their premises are known.

    Of a code the best attested town and all towns in which the premises are known are tried, so no town is out of reach.
    """
    named = p.where("town <> ''").withColumn("score", F.lit(0.0))
    there = named.groupBy("code", "number", "unit", "name", "direction", F.col("town").alias("t")).agg(F.countDistinct("key").alias("n"))
    usual = named.where("code <> ''").groupBy("code", F.col("town").alias("t")).agg(F.countDistinct("key").alias("n")).groupBy("code").agg(F.max_by("t", F.struct("n", "t")).alias("t"))
    lost = p.where("town = ''").withColumn("sure", F.lit(False))
    place = ["number", "unit", "name", "direction"]
    own = lost.where("code <> ''").join(there.where("code <> ''").select("code", *place, "t", F.log("n").alias("score")), ["code", *place])
    first = lost.where("code <> ''").join(usual, "code").withColumn("score", F.lit(-1.0))
    known = first.select("key").distinct()
    any_ = lost.join(known, "key", "left_anti").join(there.groupBy(*place, "t").agg(F.log(F.sum("n")).alias("score")), place, "left")
    any_ = any_.withColumn("t", F.coalesce("t", F.when(F.col("code") != "", F.concat(F.lit("#"), "code")), F.concat(F.lit("?"), "key"))).fillna(0.0, ["score"])
    cols = ["key", *[c for c in PARTS if c != "town"], "t", "sure", "score"]
    lost = own.select(cols).unionByName(first.select(cols)).unionByName(any_.select(cols)).groupBy(*[c for c in cols if c != "score"]).agg(F.max("score").alias("score")).withColumnRenamed("t", "town")
    return pruned(named.select(lost.columns).unionByName(lost))


def gazetteer(hypotheses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hypotheses with settled street names, premises): premises has rows (entry, town, name, kind, direction, number, unit, n).

    Towns that are only supposed learn the spellings of the named ones, never the reverse.
    """
    h = written(_settled(hypotheses, ["town"], "name"), "p1-streets")
    h = written(_settled(h, ["town", "number", "unit", "direction"], "name", 1, 7), "p1-premises")
    known = h.where("kind <> ''").groupBy(*STREET, "number", "unit").agg(F.countDistinct("key").alias("n"))
    return h, written(known.withColumn("entry", F.xxhash64(*STREET)), "p1-gazetteer")


def locations(rows: DataFrame, key: str = "key", address: str = "address", beam: float = BEAM) -> DataFrame:
    """Rows (key, location) of every address that can be placed.

    Null addresses and those without a street name are left out. Repeated rows of a key count once. An address
    whose town is neither given nor known from its postal code or premises, or whose missing kind of street could be one of
    several, is a location of its own.
    """
    p = written(parts(rows, key, address).withColumnRenamed(key, "key").distinct(), "p1-parts")
    h, premises = gazetteer(written(supposed_towns(localities(p)), "p1-supposed"))
    own = ["key", "number", "unit"]
    # the entry that the address itself writes out, and those that have its premises and contradict nothing
    written_out = h.withColumn("entry", F.xxhash64(*STREET)).select(*own, "entry", "town", "kind", "direction", (F.col("score") + F.when(F.col("kind") != "", 0.0).otherwise(UNKNOWN)).alias("score"), F.lit(False).alias("filled"))
    gaps = h.where("kind = '' or direction = ''").alias("c")
    fits = F.expr("c.town = e.town and c.name = e.name and c.number = e.number and c.unit = e.unit and c.number <> '' and (c.kind = '' or c.kind = e.kind) and (c.direction = '' or c.direction = e.direction) and not (c.kind = e.kind and c.direction = e.direction)")
    filled = gaps.join(premises.alias("e"), fits).select(*[f"c.{x}" for x in own], "e.entry", "e.town", "e.kind", "e.direction", (F.col("c.score") + F.when(F.col("c.direction") == F.col("e.direction"), 0.0).otherwise(-1.0) + F.log("e.n")).alias("score"), F.lit(True).alias("filled"))
    # what is known there counts for more
    attested = premises.select("entry", "number", "unit", F.log1p("n").alias("known"))
    tried = written_out.unionByName(filled).join(attested, ["entry", "number", "unit"], "left").withColumn("score", F.col("score") + F.coalesce("known", F.lit(0.0))).drop("known")
    tried = pruned(tried, beam)
    w = W.partitionBy("key").orderBy(F.desc("score"), "town", "kind", "direction", "entry")
    ranked = tried.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead(F.struct("town", "kind", "direction", "filled")).over(w)).where("r = 1")
    unsure = F.col("filled") & F.col("next").isNotNull() & (F.col("next.town") == F.col("town")) & (F.col("next.kind") != "") & ((F.col("next.kind") != F.col("kind")) | (F.col("next.direction") != F.col("direction")) & F.col("next.filled"))
    return ranked.select(F.col("key").alias(key), F.concat_ws("|", "entry", "number", "unit", F.when(unsure, F.col("key"))).alias("location"))


def all_addresses(spark, sf_dir) -> DataFrame:
    a = read(spark, sf_dir, "pii_records").select(F.col("record_id").alias("key"), F.col("raw_address").alias("address"))
    b = read(spark, sf_dir, "notification_subjects").select(F.col("subject_id").alias("key"), F.col("canonical_address").alias("address"))
    return a.union(b).where("address is not null")


def p1_found(spark, sf_dir) -> DataFrame:
    found = written(locations(all_addresses(spark, sf_dir)), "p1-locations")
    return pairs_within(found, "key", "location", "addr_key_a", "addr_key_b")


def p1_locations(spark, sf_dir) -> DataFrame:
    """How many address rows each location has."""
    return locations(all_addresses(spark, sf_dir)).groupBy("location").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def p1_gazetteer(spark, sf_dir) -> DataFrame:
    """The entries of the gazetteer by kind of street: how many there are, and how many premises they have."""
    p = written(parts(all_addresses(spark, sf_dir)).distinct(), "p1-parts")
    premises = gazetteer(written(supposed_towns(localities(p)), "p1-supposed"))[1]
    return premises.groupBy("kind").agg(F.countDistinct("entry").alias("n_entries"), F.count("*").alias("n_premises"))


QUERIES = {"p1_found": p1_found, "p1_locations": p1_locations, "p1_gazetteer": p1_gazetteer}
SQL: dict = {}
