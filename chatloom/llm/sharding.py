"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a vector of the bytes that each of k shards would hold. Two partial partitions
combine by adding one in descending to the other in ascending order. Differencing starts from one
partial partition per group, and repeatedly combines the two with the largest spread (greatest less
least entry), until one is left.

Groups are hashed to buckets. Each bucket is differenced by one task; what the buckets leave are again
partial partitions, of which one task differences FAN_IN at a time, level by level, until one is left. So no
task holds more than one bucket's groups or FAN_IN partial partitions, and the driver holds none.

As many shards as the bytes ask for may be too many for one partial partition: then groups are divided among
LANES first, and those of each lane again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.common import cut, table

LANES, BUCKET_GROUPS, FAN_IN = 64, 8192, 512
#: Bytes of a shard at most, on average, where no number of shards is given; there are LANES shards at least.
SHARD_BYTES = 256_000_000


def difference(parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sums by shard of the combination of `parts`, and for each part the shard that each of its entries goes to."""
    if not parts:
        return np.zeros(0, np.int64), []
    k = len(parts[0])
    # of each combined part: its sums, and the parts in it with their entries in the order of its sums
    heap = [(-int(p.max() - p.min()), i, p, [(i, np.arange(k))]) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        down, up = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
        sums = a[down] + b[up]
        members = (in_a, down), (in_b, up)
        heapq.heappush(heap, (-int(sums.max() - sums.min()), serial, sums, members))
        serial += 1
    _, _, sums, tree = heap[0]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(parts)
    todo = [(tree, np.arange(k))]  # shard order[j] holds entry j
    while todo:
        node, order = todo.pop()
        if isinstance(node, list):
            at = np.empty(k, np.int64)
            at[node[0][1]] = order
            out[node[0][0]] = at
            continue
        for child, perm in node:
            at = np.empty(k, np.int64)
            at[perm] = order
            todo.append((child, at))
    return sums, out


def partition(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums by shard, the shard of each size): k-way differencing of single numbers.

    The entries of a single number but one are 0. Only entries other than 0 are kept until a partial
    partition has k of them, which makes the many small combinations cheap.
    """
    n = len(sizes)
    heap: list[tuple[int, int, list[tuple[int, int]]]] = []
    children: list[tuple[int, int] | None] = [None] * n
    # a set of groups that share a shard is a node; a partial partition lists (bytes, node), ascending, zeros left out
    for i, s in enumerate(sizes.tolist()):
        heap.append((-s, i, [(s, i)]))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        spare = k - len(a)
        merged = []
        if len(b) <= spare:
            merged = a + b
        else:  # b's greatest meet a's zeros, a's greatest b's zeros; the rest meets in opposite order
            low, high = b[: len(b) - spare], b[len(b) - spare :]
            merged = high + a[len(low) :]
            for x, y in zip(low, reversed(a[: len(low)])):
                children.append((x[1], y[1]))
                merged.append((x[0] + y[0], len(children) - 1))
        merged.sort()
        heapq.heappush(heap, (-(merged[-1][0] - (merged[0][0] if len(merged) == k else 0)), serial, merged))
        serial += 1
    shard = np.zeros(n, np.int64)
    sums = np.zeros(k, np.int64)
    for j, (size, node) in enumerate(heap[0][2] if heap else []):
        sums[j] = size
        todo = [node]
        while todo:
            x = todo.pop()
            pair = children[x]
            if pair is None:
                shard[x] = j
            else:
                todo += pair
    return sums, shard


def _level(groups: DataFrame, k: int, bucket_groups: int, fan_in: int) -> DataFrame:
    """(grp, bytes, shard) of such rows, the groups of each shard divided among k: shard s gives s * k to s * k + k - 1."""
    kind = groups.schema["grp"].dataType.simpleString()
    need = groups.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / bucket_groups).cast("long").alias("buckets"))
    groups = groups.join(need, "shard").withColumn("bucket", F.pmod(F.xxhash64("grp", "shard"), F.col("buckets")))

    def lanes_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "grp"], ascending=[False, True], kind="stable", ignore_index=True)
        _, lane = partition(pdf["bytes"].to_numpy(), k)
        return pdf.assign(lane=lane.astype(np.int32))[["grp", "bytes", "shard", "bucket", "lane"]]

    lanes = cut(groups.select("grp", "bytes", "shard", "bucket").groupBy("shard", "bucket").applyInPandas(lanes_of, f"grp {kind}, bytes long, shard long, bucket long, lane int"))
    by_lane = F.map_from_entries(F.collect_list(F.struct("lane", "bytes")))
    sums = lanes.groupBy("shard", "bucket", "lane").agg(F.sum("bytes").alias("bytes")).groupBy("shard", "bucket").agg(by_lane.alias("m"))
    sums = sums.select("shard", "bucket", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("sums"))

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket", kind="stable", ignore_index=True)
        total, where = difference([np.array(x, np.int64) for x in pdf["sums"]])
        return pd.DataFrame({"shard": pdf["shard"], "bucket": pdf["bucket"], "up": pdf["bucket"] // fan_in, "turn": [w.tolist() for w in where], "sums": [total.tolist()] + [None] * (len(pdf) - 1)})

    most, moved = int(need.agg(F.max("buckets")).first()[0] or 1), None
    while most > 1:  # moved: (shard, bucket, at, turn) of the first buckets; at: the bucket they are part of by now; turn: where each lane went
        step = cut(sums.groupBy("shard", F.floor(F.col("bucket") / fan_in).alias("up")).applyInPandas(join_up, "shard long, bucket long, up long, turn array<int>, sums array<long>"))
        if moved is None:
            moved = step.select("shard", "bucket", F.col("up").alias("at"), "turn")
        else:
            later = step.select("shard", F.col("bucket").alias("at"), "up", F.col("turn").alias("then"))
            moved = moved.join(later, ["shard", "at"]).select("shard", "bucket", F.col("up").alias("at"), F.transform("turn", lambda x: F.get("then", x)).alias("turn"))
        sums, most = step.where("sums is not null").select("shard", F.col("up").alias("bucket"), "sums"), -(-most // fan_in)
    if moved is not None:
        lanes = lanes.join(moved.select("shard", "bucket", "turn"), ["shard", "bucket"]).withColumn("lane", F.get("turn", F.col("lane")))
    return lanes.select("grp", "bytes", (F.col("shard") * k + F.col("lane")).alias("shard"))


def shard_groups(groups: DataFrame, shards: int | None = None, bucket_groups: int = BUCKET_GROUPS, fan_in: int = FAN_IN, lanes: int = LANES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(grp, bytes, shard) of (grp, bytes): one shard for each group, of near-equal bytes in sum.

    Rows that repeat a group are one, of their bytes in sum; null is a group like others. Null bytes count as 0.
    Groups of equal size go in the order of grp. shards: the number given, in one level; else `lanes`, or its
    least power of which none holds more than shard_bytes on average, in as many levels.
    """
    groups = cut(groups.groupBy("grp").agg(F.sum(F.coalesce("bytes", F.lit(0))).cast("long").alias("bytes")).withColumn("shard", F.lit(0).cast("long")))
    ways = [shards] if shards is not None else [lanes]
    whole = groups.agg(F.sum("bytes")).first()[0] or 0
    while shards is None and whole > shard_bytes * lanes ** len(ways):
        ways.append(lanes)
    for k in ways:
        groups = _level(groups, k, bucket_groups, fan_in)
    return groups.select("grp", "bytes", F.col("shard").cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int | None = None, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """(doc_id, bytes, shard) of every row: exact copies of a text stay together, and the shards' bytes are balanced.

    bytes: of the text in UTF-8, 0 for null. All null texts are one group, all empty ones another. Rows
    that repeat count each, in one shard. Groups of equal size go in the order of their digest. Null ids
    stay null. Other columns aren't read. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(F.unhex(F.md5("text")), F.lit(b"")).alias("grp"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    placed = shard_groups(rows.select("grp", "bytes"), shards, bucket_groups)
    return rows.join(placed.select("grp", "shard"), "grp").select("doc_id", "bytes", "shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
