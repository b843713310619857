"""Nearest neighbours: an inverted file of coarse centroids, product-quantised residuals, exact reranking.

1. Coarse centroids by Lloyd's iterations over a sample of FIT_ROWS vectors at most (all, where there are no
   more): tasks send sums by centroid. Codebooks of the residuals, one for each of PIECES stretches of
   dimensions, in the same way. Every vector is then stored in the list of its nearest centroid with its codes.
2. Lists lie in buckets of about BUCKET_ROWS vectors; a list fuller than that lies in parts, in several.
3. The queries are the vectors whose id is divisible by EVERY, against all vectors. A query goes once to each
   bucket that holds any of its `probes` nearest lists. There a table of distances from its residual to the
   codewords gives each stored vector's approximate distance (the query itself is not quantised); the
   `rerank` best over these lists, and all that are as near by it as the last of these, are measured exactly,
   and the `k` nearest of all buckets are the result.
4. Exact search of AUDITED vectors of all lists, and of as many of the fullest, over all vectors tells how many
   probes reach RECALL. Then the search itself is held against it, and `rerank` and `probes` are raised until it
   shows RECALL, too. With all lists visited and all measured it is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.common import cut, table

K, RERANK, PIECES, WORDS, ROUNDS, LIST_ROWS, BUCKET_ROWS, EVERY = 10, 64, 16, 256, 4, 48, 16_384, 100
#: Vectors that centroids and codebooks are fitted on, at most; a list has SAMPLE_ROWS of them at least.
FIT_ROWS, SAMPLE_ROWS = 262_144, 16
AUDITED, RECALL = 64, 0.93

FORM = "vec_id long, rank int, neighbour_id long, distance double"


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def nearest(x: np.ndarray, centers: np.ndarray, k: int = 1) -> np.ndarray:
    """[row, k]: the nearest centers, ascending by distance, in blocks."""
    half = (centers**2).sum(1) / 2
    out = np.empty((len(x), k), np.int64)
    block = max(16, 8_000_000 // max(len(centers), 1))
    for a in range(0, len(x), block):
        d = half[None] - x[a : a + block] @ centers.T
        if k == 1:
            out[a : a + block, 0] = d.argmin(1)
        else:
            top = np.argpartition(d, k - 1, 1)[:, :k] if k < d.shape[1] else np.tile(np.arange(k), (len(d), 1))
            out[a : a + block] = np.take_along_axis(top, np.take_along_axis(d, top, 1).argsort(1, kind="stable"), 1)
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances over the last axis, rounded to 6 places; those that are equal then count as equal."""
    return np.round(np.sqrt(((a.astype(np.float64) - b) ** 2).sum(-1)), 6)


def _sums(label: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros((n, x.shape[1]))
    np.add.at(total, label, x)
    return np.bincount(label, minlength=n), total


def _step(vectors: DataFrame, centers: list[np.ndarray], coarse: np.ndarray | None, dim: int) -> list[np.ndarray]:
    """One of Lloyd's iterations over `vectors`, for each of the codebooks `centers`, which share the dimensions; a center without vectors stays."""
    sent = vectors.sparkSession.sparkContext.broadcast((centers, coarse))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, coarse = sent.value
        width = dim // len(centers)
        held = [(np.zeros(len(c), np.int64), np.zeros((len(c), width))) for c in centers]
        for batch in batches:
            x = _matrix(batch["embedding"], dim)
            if coarse is not None:
                x = x - coarse[nearest(x, coarse)[:, 0]]
            for j, c in enumerate(centers):
                part = np.ascontiguousarray(x[:, j * width : (j + 1) * width])
                n, total = _sums(nearest(part, c)[:, 0], part, len(c))
                held[j][0][:] += n
                held[j][1][:] += total
        for j, (n, total) in enumerate(held):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), j, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], ["book", "word", "n", "total"])

    rows = vectors.select("embedding").mapInArrow(run, "book int, word int, n long, total array<double>")
    # element-wise sums; rows of a task are added in no fixed order, so they are rounded before
    flat = rows.select("book", "word", "n", F.posexplode("total")).groupBy("book", "word", "pos").agg(F.sum(F.col("col").cast("decimal(30,9)")).cast("double").alias("s"), F.sum("n").alias("n"))
    t = flat.toArrow()
    new = [c.copy() for c in centers]
    book, word, pos, s, n = (t[c].to_numpy() for c in ("book", "word", "pos", "s", "n"))
    for j in range(len(centers)):
        at = book == j
        new[j][word[at], pos[at]] = (s[at] / n[at]).astype(np.float32)
    return new


def _first(vectors: DataFrame, n: int) -> np.ndarray:
    """The n vectors that come first by a hash: Lloyd's iterations begin from these."""
    t = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("embedding").toArrow()
    x = _matrix(t["embedding"], len(t["embedding"][0]))
    return np.unique(x, axis=0)


class Index:
    def __init__(self, coarse: np.ndarray, books: list[np.ndarray]):
        self.coarse, self.books = coarse, books
        self.width = coarse.shape[1] // len(books)

    def codes(self, residual: np.ndarray) -> np.ndarray:
        w = self.width
        return np.stack([nearest(np.ascontiguousarray(residual[:, j * w : (j + 1) * w]), b)[:, 0] for j, b in enumerate(self.books)], 1).astype(np.uint8)

    def approximate(self, q: np.ndarray, lists: list[set[int]], of: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """[query, stored] squared distances of queries to stored vectors by their codes; infinite in lists that a query doesn't visit. Stored vectors are sorted by their list `of`."""
        w = self.width
        near = np.full((len(q), len(of)), np.inf, np.float32)
        edges = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
        for a, b in zip(edges[:-1], edges[1:]):
            mine = np.array([i for i, visited in enumerate(lists) if int(of[a]) in visited], np.int64)
            if not len(mine):
                continue
            r = q[mine] - self.coarse[of[a]]
            total = np.repeat((r**2).sum(1)[:, None], b - a, 1)
            for j, book in enumerate(self.books):
                total += ((book**2).sum(1)[None] - 2 * r[:, j * w : (j + 1) * w] @ book.T).astype(np.float32)[:, codes[a:b, j]]
            near[mine[:, None], np.arange(a, b)[None]] = total
        return near

    def visit(self, q: np.ndarray, q_id: np.ndarray, lists: list[set[int]], x: np.ndarray, x_id: np.ndarray, of: np.ndarray, codes: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray]:
        """([query, k] row among x or -1, distance) of the stored vectors of one bucket."""
        to = np.full((len(q), k), -1, np.int64)
        far = np.full((len(q), k), np.inf)
        # neither the table of approximate distances nor the vectors to rerank are large at once
        block = max(16, min(2_000_000 // max(len(x), 1), 1_000_000 // (min(rerank, len(x)) * q.shape[1])))
        for a in range(0, len(q), block):
            part, ids = q[a : a + block], q_id[a : a + block]
            near = self.approximate(part, lists[a : a + block], of, codes)
            near[ids[:, None] == x_id[None]] = np.inf
            top = np.argpartition(near, rerank - 1, 1)[:, :rerank] if rerank < len(x) else np.tile(np.arange(len(x)), (len(part), 1))
            last = np.take_along_axis(near, top, 1).max(1)
            many = np.flatnonzero(((near <= last[:, None]) & np.isfinite(near)).sum(1) > top.shape[1])
            # vectors tied with the last one: all are measured, for one query at a time
            for rows, top in [(np.arange(len(part)), top), *((np.array([i]), np.flatnonzero((near[i] <= last[i]) & np.isfinite(near[i]))[None]) for i in many)]:
                exact = _distances(part[rows][:, None], x[top])
                exact[~np.isfinite(np.take_along_axis(near[rows], top, 1))] = np.inf
                order = np.lexsort((x_id[top], exact), axis=1)[:, :k]
                n = order.shape[1]
                far[a + rows, :n] = np.take_along_axis(exact, order, 1)
                to[a + rows, :n] = np.take_along_axis(top, order, 1)
        to[~np.isfinite(far)] = -1
        return to, far


def build(vectors: DataFrame, dim: int, count: int, list_rows: int = LIST_ROWS, rounds: int = ROUNDS, fit_rows: int = FIT_ROWS) -> Index:
    """The index of `count` vectors, fitted on those of fit_rows at most that a hash of the id picks."""
    sample = vectors if count <= fit_rows else cut(vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1_000_000)) < fit_rows * 1_000_000 // count))
    lists = max(1, min(count // list_rows, fit_rows // SAMPLE_ROWS))
    first = _first(sample, max(lists, WORDS))
    coarse = first[np.random.Generator(np.random.Philox(1)).permutation(len(first))[:lists]]
    for _ in range(rounds):
        coarse = _step(sample, [coarse], None, dim)[0]
    pieces = max(p for p in range(1, min(PIECES, dim) + 1) if dim % p == 0)
    rest = first[:WORDS] - coarse[nearest(first[:WORDS], coarse)[:, 0]]
    books = [np.ascontiguousarray(b) for b in np.split(rest, pieces, axis=1)]
    for _ in range(rounds):
        books = _step(sample, books, coarse, dim)
    return Index(coarse, books)


def store(rows: DataFrame, index: Index, dim: int, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """((bucket, list, vec_id, embedding, codes) of every vector, (list, buckets) of every list with any)."""
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            x = _matrix(batch["embedding"], dim)
            at = nearest(x, index.coarse)[:, 0]
            codes = index.codes(x - index.coarse[at])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch["vec_id"], batch["embedding"], pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "vec_id", "embedding", "codes"])

    coded = cut(rows.mapInArrow(run, "list int, vec_id long, embedding array<float>, codes binary"))
    sizes = coded.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    buckets = max(1, -(-int(sizes.agg(F.sum("n")).first()[0] or 0) // bucket_rows))
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / bucket_rows).cast("int"))
    place = F.pmod(F.xxhash64("list", "part"), F.lit(buckets)).cast("int")
    stored = coded.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    stored = cut(stored.select(place.alias("bucket"), "list", "vec_id", "embedding", "codes"))
    where = sizes.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).groupBy("list").agg(F.collect_set(place).alias("buckets"))
    return stored, cut(where)


def search(stored: DataFrame, where: DataFrame, queries: DataFrame, index: Index, probes: int, k: int = K, rerank: int = RERANK) -> DataFrame:
    """(vec_id, found: array of (distance, neighbour)) of each query, from what store() gives."""
    sent = stored.sparkSession.sparkContext.broadcast(index)
    dim = index.coarse.shape[1]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse = sent.value.coarse
        n = min(probes, len(coarse))
        for batch in batches:
            to = nearest(_matrix(batch["embedding"], dim), coarse, n)
            yield pa.RecordBatch.from_arrays([pa.array(to.ravel().astype(np.int32)), batch["vec_id"].take(pa.array(np.repeat(np.arange(len(to)), n)))], ["list", "vec_id"])

    def visit(key: tuple[pa.Scalar, ...], x: pa.Table, q: pa.Table) -> pa.Table:
        if not len(x) or not len(q):
            return pa.table({"vec_id": pa.array([], pa.int64()), "found": pa.array([], pa.list_(pa.struct([("distance", pa.float64()), ("neighbour", pa.int64())])))})
        x = x.combine_chunks().sort_by([("list", "ascending"), ("vec_id", "ascending")])
        x_id, q_id = x["vec_id"].to_numpy(), q["vec_id"].to_numpy()
        codes = np.frombuffer(b"".join(x["codes"].to_pylist()), np.uint8).reshape(len(x), -1)
        lists = [set(v) for v in q["lists"].to_pylist()]
        to, far = sent.value.visit(_matrix(q["embedding"], dim), q_id, lists, _matrix(x["embedding"], dim), x_id, x["list"].to_numpy(), codes, k, rerank)
        ok = to >= 0
        flat = pa.StructArray.from_arrays([pa.array(far[ok]), pa.array(x_id[to[ok]])], ["distance", "neighbour"])
        return pa.table({"vec_id": pa.array(q_id), "found": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ok.sum(1))]).astype(np.int32)), flat)})

    asked = queries.select("vec_id", "embedding").mapInArrow(route, "list int, vec_id long").join(where, "list").select("vec_id", "list", F.explode("buckets").alias("bucket"))
    asked = asked.groupBy("vec_id", "bucket").agg(F.collect_set("list").alias("lists")).join(queries.select("vec_id", "embedding"), "vec_id")
    met = stored.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(visit, "vec_id long, found array<struct<distance: double, neighbour: long>>")
    # a vector is stored once, so no neighbour comes twice
    return met.groupBy("vec_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def exact_search(vectors: DataFrame, queries: DataFrame, dim: int, k: int = K) -> dict[int, list[tuple[float, int]]]:
    """Brute force over all vectors, of few queries, which go to all tasks."""
    t = queries.toArrow()
    sent = vectors.sparkSession.sparkContext.broadcast((t["vec_id"].to_numpy(), _matrix(t["embedding"], dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_id, q = sent.value
        for batch in batches:
            x, x_id = _matrix(batch["embedding"], dim).astype(np.float64), batch["vec_id"].to_numpy()
            far = np.stack([_distances(row, x) for row in q])
            far[q_id[:, None] == x_id[None]] = np.inf
            order = np.lexsort((np.broadcast_to(x_id, far.shape), far), axis=1)[:, :k]
            got = np.take_along_axis(far, order, 1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_id, order.shape[1])), pa.array(got), pa.array(x_id[order.ravel()])], ["vec_id", "distance", "neighbour"])

    rows = vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, distance double, neighbour long").where("distance < double('infinity')")
    best = rows.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("found"))
    return {r["vec_id"]: [(x["distance"], x["neighbour"]) for x in r["found"]] for r in best.collect()}


def audit(rows: DataFrame, stored: DataFrame, where: DataFrame, index: Index, dim: int, k: int, rerank: int, recall: float = RECALL) -> tuple[int, int]:
    """(probes, rerank) at which AUDITED vectors of all, and as many of the fullest list, each show the recall."""
    by_hash = [F.xxhash64("vec_id", F.lit(1)), "vec_id"]
    fullest = stored.groupBy("list").count().orderBy(F.desc("count"), "list").first()["list"]
    most = stored.groupBy("bucket").count().agg(F.max("count")).first()[0]
    hot = stored.where(F.col("list") == fullest).select("vec_id", "embedding").orderBy(*by_hash).limit(AUDITED)
    samples = [cut(d) for d in (rows.orderBy(*by_hash).limit(AUDITED), hot)]
    groups = [{r[0] for r in d.select("vec_id").collect()} for d in samples]
    audited = cut(samples[0].union(samples[1]).dropDuplicates(["vec_id"]))
    true = exact_search(rows, audited, dim, k)
    pairs = audited.toArrow()
    order = dict(zip(pairs["vec_id"].to_pylist(), nearest(_matrix(pairs["embedding"], dim), index.coarse, len(index.coarse))))
    of = {r["vec_id"]: r["list"] for r in stored.where(F.col("vec_id").isin(sorted({x for found in true.values() for _, x in found}))).select("vec_id", "list").collect()}

    def share(found: dict[int, set[int]]) -> float:
        return min(sum(len(found.get(i, set()) & {x for _, x in true.get(i, [])}) for i in g) / max(1, sum(len(true.get(i, [])) for i in g)) for g in groups)

    # the place of each true neighbour's list among those nearest to its query
    place = {i: {x: int(np.flatnonzero(order[i] == of[x])[0]) for _, x in found} for i, found in true.items()}
    least, probes = 1, len(index.coarse)
    while least < probes:  # the fewest probes whose lists hold that share
        middle = (least + probes) // 2
        if share({i: {x for x, n in p.items() if n < middle} for i, p in place.items()}) >= recall:
            probes = middle
        else:
            least = middle + 1
    while any(true.values()):
        got = {r["vec_id"]: {x["neighbour"] for x in r["found"]} for r in search(stored, where, audited, index, probes, k, rerank).collect()}
        if share(got) >= recall or (probes == len(index.coarse) and rerank >= most):
            break
        probes, rerank = min(len(index.coarse), probes + max(1, probes // 16)), min(2 * rerank, max(most, rerank))
    return probes, rerank


def neighbours(embeddings: DataFrame, k: int = K, rerank: int = RERANK, list_rows: int = LIST_ROWS, bucket_rows: int = BUCKET_ROWS, every: int = EVERY, fit_rows: int = FIT_ROWS, recall: float = RECALL) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest others, by Euclidean distance and of equal ones by id, of the vectors whose id is divisible by `every`, among all vectors.

    Vectors of another length are searched among their own. Those with a null id, no entry, or a null or
    non-finite one have no distance and take no part. A vec_id is one vector: of rows that repeat it, the
    greatest stands for all. Other columns aren't read. A vector without another of its length has no neighbours.
    """
    rows = embeddings.where("vec_id is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = cut(rows.groupBy("vec_id").agg(F.max("embedding").alias("embedding")))
    found = []
    for dim, count in rows.groupBy(F.size("embedding").alias("dim")).count().orderBy("dim").collect():
        mine = rows.where(F.size("embedding") == dim)
        index = build(mine, dim, count, list_rows, fit_rows=fit_rows)
        stored, where = store(mine, index, dim, bucket_rows)
        probes, most = audit(mine, stored, where, index, dim, k, rerank, recall)
        found.append(search(stored, where, mine.where(F.col("vec_id") % every == 0), index, probes, k, most))
    if not found:
        return rows.sparkSession.createDataFrame([], FORM)
    flat = reduce(DataFrame.union, found).select("vec_id", F.posexplode("found"))
    return flat.select("vec_id", (F.col("pos") + 1).alias("rank"), F.col("col.neighbour").alias("neighbour_id"), F.col("col.distance").alias("distance"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
