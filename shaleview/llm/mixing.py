"""Problem 9: mixing sources to target weights.

The size of a document is its number of tokens. Weights come from temperature mixing: the ratio of a source's token share
to its target is raised to an exponent and multiplied onto the target, so exponent 0 gives the targets and 1 the shares as
they are; the exponent is bisected to the least that keeps every source within its repetition limit for the wanted
total (or, without targets, shares are exponentiated to meet a target entropy). The weights are realised as budgeted
block permutations: documents fall into blocks by hash, blocks are taken in a fixed order until the source's
budget is met, and only the last block is cut within. Whole rounds through a source come first.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BLOCKS = 1024


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def sized(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """docs without the text and with n_tokens; null texts have none. The vocabulary (under 2 MB) is read on the driver."""
    ranks = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    keep = [c for c in docs.columns if c not in (text, "n_tokens")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in keep]).schema) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(ranks.value, pattern).encode_ordinary
        for b in batches:
            n = pa.array([len(count(t)) if t else 0 for t in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], n], [*b.schema.names[1:], "n_tokens"])

    return docs.select(F.col(text).alias("_text"), *[f"`{c}`" for c in keep]).mapInArrow(run, schema)


def bisect(ok, low: float, high: float, rounds: int = 80) -> float:
    """The least x in [low, high] at which ok holds, if ok holds from some x on; high if nowhere."""
    if ok(low):
        return low
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (low, middle) if ok(middle) else (middle, high)
    return high


def entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def entropy_weights(shares: np.ndarray, wanted: float) -> tuple[np.ndarray, float]:
    """(weights, exponent): shares raised to the exponent at which their entropy is the wanted one, as near as 0 and 8 allow."""

    def w(x: float) -> np.ndarray:
        p = np.where(shares > 0, np.maximum(shares, 1e-300) ** x, 0)
        return p / p.sum()

    x = bisect(lambda e: entropy(w(e)) <= wanted, 0.0, 8.0)
    return w(x), x


def limited_weights(shares: np.ndarray, targets: np.ndarray, most: np.ndarray, total: float | None) -> tuple[np.ndarray, float, float]:
    """(weights, exponent, total): target * (share / target) ** exponent, normalised, with the least exponent within the limits.

    most: tokens that a source can give at its repetition limit. Without a total, it is the largest at which the targets
    themselves are within the limits. If even exponent 1 isn't, the total is what the limits allow there.
    """
    live = (targets > 0) & (most > 0)
    if not live.any():
        return np.zeros_like(targets), 0.0, 0.0

    def w(x: float) -> np.ndarray:
        p = np.zeros_like(targets)
        p[live] = targets[live] * (np.maximum(shares[live], 1e-300) / targets[live]) ** x
        return p / p.sum()

    room = lambda x: float((most[live] / w(x)[live]).min())
    if total is None:
        return w(0.0), 0.0, room(0.0)
    x = bisect(lambda e: room(e) >= total, 0.0, 1.0)
    return w(x), x, min(total, room(x))


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", total_tokens: float | str | None = None,
            tokenizer: str = TOKENIZER, pattern: str = PATTERN, blocks: int = BLOCKS, seed: int = 17, by_entropy: bool = False) -> DataFrame:
    """Rows (key, source, n_tokens, repeats) of the chosen documents.

    total_tokens: the size wanted; "all" is that of all documents that may be chosen; None is the largest at which every source
    reaches its target exactly, for which the exponent is 0. A larger size is reached by the least exponent that keeps the
    repetition limits. by_entropy: token shares are exponentiated to the entropy of the targets instead.

    Documents of a null source, of one without a target, and without tokens aren't chosen; rows of a repeated key count once.
    Each source misses its budget by less than one document. A source with a target but no documents gives its weight to the others.
    """
    block = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(blocks))
    d = docs.select(key, source, text).where(f"{source} is not null and {key} is not null").join(F.broadcast(targets.select(source).distinct()), source)  # one row a source
    d = sized(d, text, tokenizer, pattern).where("n_tokens > 0")
    d = written(d.groupBy(key).agg(F.min_by(F.struct(source, "n_tokens"), F.struct(source, "n_tokens")).alias("v")).select(key, "v.*").withColumn("block", block), "p9-sized")
    # at most blocks rows a source; sources are as many as the targets
    per_block = d.groupBy(source, "block").agg(F.sum("n_tokens").alias("t")).toPandas()
    t = targets.groupBy(source).agg(F.max("target_weight").alias("weight"), F.max("max_repeats").alias("most")).toPandas()
    have = per_block.groupby(source)["t"].sum()
    size = np.array([float(have.get(s, 0)) for s in t[source]])
    shares, wanted, most = size / max(size.sum(), 1), t["weight"].to_numpy(float), size * t["most"].to_numpy(float)
    if by_entropy:
        wanted = entropy_weights(shares, entropy(wanted / max(wanted.sum(), 1e-300)))[0] if size.any() else wanted
    weights, _, total = limited_weights(shares, wanted, most, size.sum() if total_tokens == "all" else total_tokens)
    rounds, cut = [], []
    order = np.random.default_rng(seed).permutation(blocks)
    place = np.argsort(order)
    for s, n, w in zip(t[source], size, weights):
        if n <= 0 or w <= 0:
            continue
        budget = w * total
        whole = int(math.floor(budget / n + 1e-9))
        left = max(0.0, budget - whole * n)
        own = per_block[per_block[source] == s].assign(p=lambda x: place[x["block"].to_numpy()]).sort_values("p")
        before = own["t"].cumsum() - own["t"]
        for b, tb, at in zip(own["block"], own["t"], before):
            if at + tb <= left:
                cut.append((s, int(b), float(tb)))
            elif at < left:
                cut.append((s, int(b), float(left - at)))
        rounds.append((s, whole))
    spark = docs.sparkSession
    kind = d.schema[source].dataType.simpleString()
    r = spark.createDataFrame(rounds, f"{source} {kind}, whole int")
    c = spark.createDataFrame(cut, f"{source} {kind}, block bigint, room double")
    run = F.sum("n_tokens").over(W.partitionBy(source, "block").orderBy(F.xxhash64(F.col(key), F.lit(seed + 1)), key).rowsBetween(W.unboundedPreceding, 0))
    more = d.join(F.broadcast(c), [source, "block"]).withColumn("run", run).where(F.col("run") <= F.col("room")).select(key, F.lit(1).alias("more"))
    chosen = d.join(F.broadcast(r), source).join(more, key, "left").withColumn("repeats", F.col("whole") + F.coalesce("more", F.lit(0)))
    return chosen.where("repeats > 0").select(key, source, "n_tokens", "repeats")


def p9_mix(spark, sf_dir) -> DataFrame:
    return mixture(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))


def shares(spark, sf_dir, **options) -> DataFrame:
    """The actual share of each source in a mix, beside its target."""
    m = written(mixture(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"), **options), "p9-mix")
    by = m.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("n_documents"), F.max("repeats").alias("most_repeats"))
    total = F.sum("tokens").over(W.partitionBy())  # one row a source
    return read(spark, sf_dir, "mix_targets").join(by, "source", "left").select(
        "source", "target_weight", "max_repeats", F.round(F.col("tokens") / total, 6).alias("actual_share"), "tokens", "n_documents", "most_repeats")


def p9_shares(spark, sf_dir) -> DataFrame:
    return shares(spark, sf_dir)


def p9_shares_of_all(spark, sf_dir) -> DataFrame:
    """Shares of a mix as large as all documents: the exponent is bisected to keep the repetition limits."""
    return shares(spark, sf_dir, total_tokens="all")


def p9_shares_by_entropy(spark, sf_dir) -> DataFrame:
    """Shares of a mix by token shares, exponentiated to the entropy of the targets."""
    return shares(spark, sf_dir, by_entropy=True)


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_shares_of_all": p9_shares_of_all, "p9_shares_by_entropy": p9_shares_by_entropy}
SQL: dict = {}
