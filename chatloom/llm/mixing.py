"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. A source's rows, in the order of a seeded hash, form blocks of `block_rows` rows (the last may hold
   fewer). Only the counts by source reach the driver.
2. Without target weights the sources' own shares are the target, and all blocks are drawn. With them, the
   total is the greatest at which the sources reach their weights. Where `keep` names another total, that is
   divided by weight; a source that has fewer gives all it has, and the others share what is left by their
   weights. Largest remainders make the quotas whole.
3. The vector of quotas is the root of a binary tree over the output shards. A node splits its vector
   by one multivariate-hypergeometric draw, seeded by seed and node, until each shard has its exact
   count of blocks of every source.
4. The blocks of a source are in a seeded permutation (a Feistel network); shards take disjoint consecutive
   stretches of it. Each shard is sorted by a seeded hash of its rows.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.llm import text as T
from chatloom.llm.common import cut, table

BLOCK_ROWS, SHARD_ROWS, SEED, BUCKET_ROWS = 16, 4096, 42, 8192
#: Entries of the table of blocks by shard and source, which goes to all executors (8 bytes each). Beyond it shards hold more rows.
MOST_CELLS = 16_000_000
#: The query's target weights: the sources' sizes to this power, which lifts small sources over a hot one.
TEMPER = 0.7


def quotas(available: list[int], weights: list[float], total: int) -> list[int]:
    """Whole numbers of blocks by source: in proportion to weights as far as available, summing to min(total, sum of those of positive weight)."""
    out = [0] * len(available)
    open_ = [i for i, w in enumerate(weights) if w > 0 and available[i] > 0]
    left = min(total, sum(available[i] for i in open_))
    while open_ and left > 0:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] >= available[i] * whole]
        if full:
            for i in full:
                out[i] = available[i]
            left -= sum(available[i] for i in full)
            open_ = [i for i in open_ if i not in set(full)]
            continue
        share = {i: left * weights[i] / whole for i in open_}
        for i in open_:
            out[i] = int(share[i])
        rest = left - sum(out[i] for i in open_)
        for i in sorted(open_, key=lambda i: (out[i] - share[i], i))[:rest]:
            out[i] += 1
        break
    return out


def reachable(available: list[int], weights: list[float]) -> int:
    """The greatest total of blocks at which no source of positive weight and with any block falls short of its share."""
    some = [(n, w) for n, w in zip(available, weights) if n > 0 and w > 0]
    return int(min((n / w for n, w in some), default=0) * sum(w for _, w in some) + 1e-9)


def split(quota: list[int], shards: int, seed: int) -> np.ndarray:
    """[shard, source] blocks: the tree of draws. Shards differ by one block at most."""
    out = np.zeros((shards, len(quota)), np.int64)
    total = int(sum(quota))
    upto = [total * k // shards for k in range(shards + 1)]
    todo = [(0, shards, np.asarray(quota, np.int64))]
    while todo:
        lo, hi, counts = todo.pop()
        if hi - lo == 1:
            out[lo] = counts
            continue
        mid = (lo + hi) // 2
        draw = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, lo, hi])))
        left = draw.multivariate_hypergeometric(counts, upto[mid] - upto[lo], method="marginals")
        todo += [(lo, mid, left), (mid, hi, counts - left)]
    return out


def permuted(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where each of the numbers x under n goes in a seeded permutation of them: four Feistel rounds over the next power of 4, repeated while the result is not under n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2) if n > 1 else 1
    mask = np.uint64((1 << half) - 1)
    out = x.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in range(4):
            left, right = right, left ^ (T.mix64(right, int(seed) * 4 + k) & mask)
        out[todo] = left << np.uint64(half) | right
        todo &= out >= n
    return out.astype(np.int64)


def placed(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, keep: float | None = None, shards: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED, default_weight: float = 1.0, temper: float | None = None, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(row, shard, position) of each drawn row, as mix() says; row: the struct of the columns of docs."""
    if weights is not None and temper is not None:
        raise ValueError("weights and temper exclude each other")
    if weights is None and temper is None and keep is None:
        keep = 1.0
    weights = dict(weights or {})
    if min([default_weight, *weights.values()]) < 0 or block_rows < 1 or not 0 <= (1 if keep is None else keep) <= 1 or (shards is not None and shards < 1):
        raise ValueError("weights must be 0 or more, shards and block_rows 1 or more, keep between 0 and 1")
    buckets = max(1, -(-docs.count() // bucket_rows))
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    tie = [F.col(f"row.`{c}`") for c in ("doc_id", "text") if c in names] or [F.lit(0)]
    # named: never null, so that joins and windows on it share one shuffle
    rows = rows.select("row", F.when(F.col("row.source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("row.source").cast("string"))).alias("named"), F.xxhash64(F.lit(seed), *tie).alias("rank"))
    rows = rows.withColumn("bucket", F.least(F.floor((F.col("rank") / 2.0**63 + 1) * (buckets / 2)), F.lit(buckets - 1)).cast("long"))
    # a source is never sorted in one place: its order is by bucket, then within the bucket
    sizes = cut(rows.groupBy("named", "bucket").agg(F.count(F.lit(1)).alias("n")))
    totals = sorted((r["named"], r["n"]) for r in sizes.groupBy("named").agg(F.sum("n").alias("n")).collect())
    blocks = [-(-n // block_rows) for _, n in totals]
    weight = [n**temper if temper is not None else weights.get(s[1:] if s[0] == "1" else None, default_weight) for s, n in totals]
    total = reachable(blocks, weight) if keep is None else min(sum(blocks), max(int(keep * sum(blocks)), 1 if keep else 0))
    quota = quotas(blocks, weight, total)
    if shards is None:
        shards = max(1, min(MOST_CELLS // max(1, len(totals)), -(-total * block_rows // SHARD_ROWS)))
    upto = np.cumsum(split(quota, shards, seed), 0)
    sent = docs.sparkSession.sparkContext.broadcast(({s: i for i, (s, _) in enumerate(totals)}, blocks, upto))

    @F.pandas_udf("int")
    def shard_of(named: pd.Series, block: pd.Series) -> pd.Series:
        """The shard that draws a block; -1 if none does."""
        number, blocks, upto = sent.value
        out = np.full(len(named), -1, np.int32)
        of, b = named.map(number).to_numpy(), block.to_numpy()
        for i in np.unique(of):
            at = np.flatnonzero(of == i)
            shard = np.searchsorted(upto[:, i], permuted(b[at], blocks[i], seed + 1 + i), "right")
            out[at] = np.where(shard < len(upto), shard, -1)
        return pd.Series(out)

    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("named").orderBy("bucket")) - F.col("n")).drop("n")
    part = Window.partitionBy("named", "bucket").orderBy("rank", F.xxhash64("row"))
    spots = rows.join(before, ["named", "bucket"]).withColumn("spot", F.col("before") + F.row_number().over(part) - 1)
    drawn = spots.withColumn("shard", shard_of("named", F.floor(F.col("spot") / block_rows).cast("long"))).where("shard >= 0")
    inside = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "named", "spot"), "named", "spot")
    return drawn.select("row", "shard", "named", "spot").withColumn("position", F.row_number().over(inside) - 1).select("row", "shard", "position")


def mix(docs: DataFrame, *args, **options) -> DataFrame:
    """The columns of docs, shard and position: each drawn row once. The arguments are those of placed().

    keep None: without weights and temper all rows are drawn, with them as many blocks as reachable() says. Else
    `keep` of all blocks (rounded down, at least one if there is any) are drawn, by equal weights where none
    are given. temper: a source weighs its rows to that power. A source that `weights` doesn't name weighs
    default_weight; a null source is a source of its own, an empty one another; a weight of 0
    draws nothing, a negative one is an error. shards: as many as hold SHARD_ROWS rows each, but no more than
    MOST_CELLS by the sources, unless given. Rows that repeat are rows of their own: the hash of doc_id and text orders
    them, and the other columns order those that tie. Columns of docs called shard or position, in any
    case, make room for the new ones; stage() keeps them. Null and very long texts are rows like others. An
    empty table gives an empty result.
    """
    rows = placed(docs, *args, **options)
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("shard", "position")), "shard", "position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), temper=TEMPER)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, as the sources' own shares are the target: a shard is in one partition, in the order of position. The columns are those of docs, whatever their names."""
    return placed(docs).sortWithinPartitions("shard", "position").select("row.*")
