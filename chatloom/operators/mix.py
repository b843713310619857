"""Mixing named sources by weight with exact, seeded counts.

A row's rank in its source is that of md5(seed:source:key); it depends neither on partitions nor on
other sources. Only the sizes of the sources reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts of a source that are ordered each by a task of its own.
BUCKETS = 1024


@dataclass(frozen=True)
class SourceStats:
    source: str
    weight: float
    requested: int
    available: int
    written: int


def allocate(weights: list[float], total: int) -> list[int]:
    """Rounded shares (halves to even); what is missing or too much is the largest's, of equal ones the first's."""
    if not weights:
        raise ValueError("at least one source is needed")
    whole = sum(weights)
    if whole <= 0 or min(weights) < 0:
        raise ValueError("weights must not be negative, nor all 0")
    out = [round(total * (w / whole)) for w in weights]
    top = max(range(len(out)), key=lambda i: (out[i], -i))
    out[top] += total - sum(out)
    if out[top] < 0:
        raise ValueError("total is too small for so many sources")
    return out


def rank_hash(seed: int, *key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key)))


def ranked(rows: DataFrame, source: str, key: str, seed: int, buckets: int = BUCKETS) -> DataFrame:
    """rows with `pick`, each row's place from 1 in the seeded order of its source.

    A source is ordered bucket by bucket of the hash, so it is never in one task.
    """
    h = rank_hash(seed, F.col(source), F.col(key))
    some = rows.withColumn("_h", h).withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * buckets / 65536).withColumn("_b", F.floor("_b"))
    sizes = some.groupBy(source, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(source).orderBy("_b")) - F.col("_n")).drop("_n")
    inside = Window.partitionBy(source, "_b").orderBy("_h", F.col(key))
    # one row for each source and bucket
    return some.join(before, [source, "_b"]).withColumn("pick", F.col("_before") + F.row_number().over(inside)).select(*rows.columns, "pick")


def mix(rows: DataFrame, weights: Mapping[str, float], source: str, key: str, total: int | None = None, seed: int = 42, oversample: bool = False) -> tuple[DataFrame, list[SourceStats]]:
    """(rows with `pick` and `copy`, stats): of each source so many rows as its share of total, without replacement.

    A source with fewer rows gives all of them; with `oversample` it is drawn from with replacement
    instead. Without total all rows are taken. In the end, sort by shuffle_key for a seeded order.
    """
    names = list(weights)
    mine = rows.where(F.col(source).isin(names))
    sizes = {r[0]: r[1] for r in mine.groupBy(source).count().collect()}
    available = [sizes.get(n, 0) for n in names]
    allocate([weights[n] for n in names], 0)
    wanted = available if total is None else allocate([weights[n] for n in names], total)
    whole = sum(weights.values())
    again = [i for i, n in enumerate(names) if oversample and wanted[i] > available[i] > 0]
    written = [w if i in again else min(w, a) for i, (w, a) in enumerate(zip(wanted, available))]
    stats = [SourceStats(n, weights[n] / whole, *x) for n, *x in zip(names, wanted, available, written)]
    place = ranked(mine, source, key, seed)
    most = F.create_map(*(F.lit(x) for n, w in zip(names, wanted) for x in (n, w)))
    plain = [n for i, n in enumerate(names) if i not in again]
    out = place.where(F.col(source).isin(plain) & (F.col("pick") <= most[F.col(source)])).withColumn("copy", F.lit(0).cast("long"))
    for i in again:
        draws = rows.sparkSession.range(wanted[i]).select(F.col("id").alias("copy"), (F.pmod(F.conv(F.substring(rank_hash(seed, F.col("id")), 1, 8), 16, 10).cast("long"), F.lit(available[i])) + 1).alias("pick"))
        out = out.unionByName(place.where(F.col(source) == names[i]).join(draws, "pick"))
    return out, stats


def shuffle_key(seed: int, source: str, key: str) -> Column:
    return rank_hash(seed, F.col(source), F.col(key), F.col("pick"), F.col("copy"))
