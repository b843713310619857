"""SimHash near-duplicates: navigable small-world graphs over Hamming distance.

1. Every text gets a 128-bit SimHash of its distinct words, and `routes` min-wise keys of the same words, in
   which a word of LONG_WORD bytes or more is 16 times as likely to be the least as a shorter one. Texts equal
   byte for byte collapse to one point first, wordless ones too.
2. A key sends a point to one shard, so that a copy shares a shard with its original unless all of
   the keys differ: this routing replaces the broadcast of every query to every shard. A shard holds about
   `shard_rows` points. The points of one of more than four times as many (a very frequent key) are split among
   parts, and each query of that shard is broadcast to all of its parts.
3. In each part a navigable small-world graph is built, and every row searches it as a query; one that is in the
   graph begins at its own place, too. Some queries of each part are audited by exact scan; under `recall` all rows
   of the part are held against all of its points but those of their tree. So is a row whose beam is full of hits.
4. Minimum spanning trees of the hits of each part are verified on the texts, by the Jaccard similarity of
   the sets of word pairs; verified edges are unioned. Where an edge of a tree fails, all pairs at most
   `radius` apart of that tree's points with points of other components are verified too.
5. Recall across shards is audited: AUDITED points of all and AUDITED of those with copies are compared with all
   fingerprints, and what is close but apart is verified. Under `recall`, all repeats with twice the routes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.llm import text as T
from chatloom.llm.common import components, cut, sliced, table

RADIUS, JACCARD, ROUTES, SHARD_ROWS = 26, 0.5, 4, 8192
FORWARD, REVERSE, BEAM, STEP, ENTRIES, AUDITED, RECALL = 8, 16, 32, 4, 16, 32, 0.95
LONG_WORD, MOST_ROUTES = 4, 64
#: Points of a part whose beams are held at once.
HELD_QUERIES = 2048
#: Rows that a worker handles at once.
HELD_ROWS = 1000
#: Bits of the map of ids by which rows are chosen before a join, and its words of 64 bits at most (8 MB).
BITS_AN_ID, MOST_WORDS = 16, 1 << 20
_BIG = np.int64(1) << 62


def distinct_words(h: np.ndarray, length: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of each row's distinct words, whether each has LONG_WORD bytes or more, pointer of the rows)."""
    own = T.owners(ptr)
    word = (h >> np.uint64(16) << np.uint64(1)) | (length >= LONG_WORD)  # 48 bits, and the length's
    out = []
    for first in range(0, max(1, len(ptr) - 1), 1 << 15):  # a row's number has 15 bits of the key
        part = slice(ptr[first], ptr[min(first + (1 << 15), len(ptr) - 1)])
        key = np.sort(((own[part] - first).astype(np.uint64) << np.uint64(49)) | word[part])
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        out.append(((key >> np.uint64(49)).astype(np.int64) + first, key & np.uint64((1 << 49) - 1)))
    own, word = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    return T.mix64(word >> np.uint64(1)), (word & np.uint64(1)).astype(bool), np.searchsorted(own, np.arange(len(ptr)))


def simhash(features: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """128 bits of each row, as two uint64: bit i is set where more than half of the features have it."""
    n = len(ptr) - 1
    out = np.zeros((n, 2), np.uint64)
    if not len(features):
        return out
    count = np.diff(ptr)
    parts = -(-count // 255)  # eight counters of a byte share a word, so at most 255 features are summed at once
    first = np.repeat(ptr[:-1], parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    bits = np.unpackbits(np.stack([features, T.mix64(features, 7)], 1).view(np.uint8), axis=1).view(np.uint64)
    sums = np.add.reduceat(bits, first, axis=0).view(np.uint8).astype(np.int64)
    filled = count > 0
    total = np.add.reduceat(sums, (np.cumsum(parts) - parts)[filled], axis=0)
    out[filled] = np.packbits(2 * total > count[filled, None], axis=1).view(np.uint64)
    return out


def min_keys(features: np.ndarray, long: np.ndarray, ptr: np.ndarray, routes: int) -> np.ndarray:
    """For each of `routes` hash functions, the least value among a row's features; those of long words are divided by 16."""
    out = np.zeros((len(ptr) - 1, routes), np.uint64)
    filled = np.diff(ptr) > 0
    shift = np.where(long, 4, 0).astype(np.uint64)
    for k in range(routes if filled.any() else 0):
        out[filled, k] = np.minimum.reduceat(T.mix64(features, 100 + k) >> shift, ptr[:-1][filled])
    return out


def fingerprints(docs: DataFrame, routes: int = ROUTES) -> DataFrame:
    """(doc_id, same, f0, f1, keys) of the documents that have a doc_id and a text; same: the text's digest; keys are none where there is no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = T.buffers(batch["text"])
            for a, b, d, o in T.chunks(data, offs):
                starts, ends, ptr = T.words(low := T.lower(d), o, T.WORD)
                features, long, fptr = distinct_words(T.span_hash(low, starts, ends), ends - starts, ptr)
                fp, keys = simhash(features, fptr).view(np.int64), min_keys(features, long, fptr, routes).view(np.int64)
                some = np.diff(fptr) > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * routes)]), pa.int32()), pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.slice(a, b - a).column(c) for c in ("doc_id", "same")), pa.array(fp[:, 0]), pa.array(fp[:, 1]), lists], ["doc_id", "same", "f0", "f1", "keys"])

    some = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    return some.select("doc_id", digest().alias("same"), "text").mapInArrow(sliced(run, HELD_ROWS), "doc_id long, same binary, f0 long, f1 long, keys array<long>")


def digest() -> Column:
    return F.unhex(F.md5("text"))


class Graph:
    """A navigable small-world graph over 128-bit points, searched by many queries in lockstep.

    A point keeps the FORWARD links to the nearest points at its insertion (early ones are long
    ranges) and the REVERSE nearest of the links made to it later. Points are inserted in a seeded
    random order in batches, each linked to the graph before it and among its own.
    """

    def __init__(self, points: np.ndarray, beam: int = BEAM):
        n = len(points)
        order = np.random.Generator(np.random.Philox(n)).permutation(n)
        self.points, self.order = points[order], order
        self.links = np.full((n, FORWARD + REVERSE), -1, np.int32)
        done = 0
        while done < n:
            size = min(n - done, 64 if not done else min(done, 512))
            new = np.arange(done, done + size)
            near = distances(self.points[new], self.points[new])
            near[np.arange(size), np.arange(size)] = 999
            found = (near.astype(np.int64) << 32) | new
            if done:
                found = np.concatenate([found, self.search(self.points[new], beam, done)], 1)
            found = np.sort(found, 1)[:, :FORWARD]
            to, far = np.where(found < (np.int64(999) << 32), found & 0xFFFFFFFF, -1), found >> 32
            self.links[new, : to.shape[1]] = to
            self._reverse(to.ravel(), np.repeat(new, to.shape[1]), far.ravel())
            done += size

    def _reverse(self, at: np.ndarray, source: np.ndarray, far: np.ndarray) -> None:
        ok = at >= 0
        at, source, far = at[ok], source[ok], far[ok]
        if not len(at):
            return
        touched = np.unique(at)
        old = self.links[touched, FORWARD:]
        row, col = np.nonzero(old >= 0)
        old_at, old_source = touched[row], old[row, col]
        old_far = np.bitwise_count(self.points[old_at] ^ self.points[old_source]).sum(1, dtype=np.int64)
        at, source, far = np.concatenate([at, old_at]), np.concatenate([source, old_source]), np.concatenate([far, old_far])
        k = np.lexsort((source, far, at))
        at, source = at[k], source[k]
        first = np.searchsorted(at, touched)
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        keep = rank < REVERSE
        self.links[touched, FORWARD:] = -1
        self.links[at[keep], FORWARD + rank[keep]] = source[keep]

    def search(self, queries: np.ndarray, beam: int, known: int | None = None, at: np.ndarray | None = None) -> np.ndarray:
        """[query, beam] of distance << 32 | position among self.points, ascending; _BIG where fewer are found. at: a position from which each query begins besides the entries, -1 for none."""
        n = len(self.points) if known is None else known
        out = np.full((len(queries), beam), _BIG, np.int64)
        block = max(64, min(2048, 16_000_000 // max(n, 1)))
        entry = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64))
        for a in range(0, len(queries), block):
            q = queries[a : a + block]
            best = np.full((len(q), beam), _BIG, np.int64)
            start = np.sort((distances(q, self.points[entry]).astype(np.int64) << 33) | (entry << 1), 1)[:, :beam]
            best[:, : start.shape[1]] = start
            seen = np.zeros((len(q), n), bool)
            seen[:, entry] = True
            if at is not None:
                row = np.flatnonzero(at[a : a + block] >= 0)
                spot = at[a : a + block][row]
                row, spot = row[~seen[row, spot]], spot[~seen[row, spot]]
                near = np.bitwise_count(q[row] ^ self.points[spot]).sum(1, dtype=np.int64)
                best[row, -1] = np.minimum(best[row, -1], near << 33 | spot << 1)
                best.sort(1)
                seen[row, spot] = True
            rows = np.arange(len(q))
            while len(rows):
                now = best[rows]
                open_ = np.where(now & 1, _BIG, now)
                pick = np.argpartition(open_, STEP - 1, 1)[:, :STEP] if beam > STEP else np.tile(np.arange(beam), (len(rows), 1))
                key = np.take_along_axis(open_, pick, 1)
                more = (key < _BIG).any(1)
                if not more.all():
                    rows, now, pick, key = rows[more], now[more], pick[more], key[more]
                    if not len(rows):
                        break
                real = key < _BIG
                np.put_along_axis(now, pick, np.where(real, key | 1, np.take_along_axis(now, pick, 1)), 1)
                near = np.where(real[:, :, None], self.links[(key >> 1 & 0x7FFFFFFF) * real], -1).reshape(len(rows), -1)
                fresh = (near >= 0) & ~seen[rows[:, None], near]
                r, c = np.nonzero(fresh)
                ids = near[r, c].astype(np.int64)
                seen[rows[r], ids] = True
                far = np.bitwise_count(q[rows[r]] ^ self.points[ids])
                cand = np.full(near.shape, _BIG, np.int64)
                cand[r, c] = ((far[:, 0].astype(np.int64) + far[:, 1]) << 33) | (ids << 1)
                cand.sort(1)
                cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = _BIG
                best[rows] = np.sort(np.concatenate([now, cand], 1), 1)[:, :beam]
            out[a : a + block] = np.where(best < _BIG, (best >> 33 << 32) | (best >> 1 & 0xFFFFFFFF), _BIG)
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All Hamming distances between two arrays of points."""
    return np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.int16) + np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])


def forest(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray, root: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Kruskal: indices of the edges of a minimum spanning forest, and the union-find parents after it."""
    root, kept = root or list(range(n)), []
    for k in np.argsort(far, kind="stable").tolist():
        x, y = int(a[k]), int(b[k])
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return kept, root


def _labels(root: list[int]) -> np.ndarray:
    r = np.array(root)
    while (r[r] != r).any():
        r = r[r]
    return r


def part_trees(ids: np.ndarray, points: np.ndarray, inserted: np.ndarray, radius: int = RADIUS, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, id, tree): the edges of minimum spanning trees of the pairs at most `radius` apart, of all rows as queries against the inserted ones; tree: the id of a point of it."""
    n, own = len(ids), np.flatnonzero(inserted)
    none = np.zeros(0, np.int64)
    if n < 2 or not len(own):
        return none, none, none
    graph = Graph(points[own])
    spot = own[graph.order]  # a position in the graph to a row
    audited = np.unique(np.linspace(0, n - 1, min(n, AUDITED)).astype(np.int64))
    exact = (distances(points[audited], points[spot]) <= radius) & (spot[None, :] != audited[:, None])
    at = np.full(n, -1, np.int64)
    at[spot] = np.arange(len(own))
    full, hits = np.zeros(n, bool), []
    for a in range(0, n, HELD_QUERIES):  # of a block's beams only the hits are held
        found = graph.search(points[a : a + HELD_QUERIES], beam, at=at[a : a + HELD_QUERIES])
        hit = found < (np.int64(radius + 1) << 32)
        full[a : a + HELD_QUERIES] = hit[:, -1]
        row, col = np.nonzero(hit)
        hits.append((a + row, spot[found[row, col] & 0xFFFFFFFF], found[row, col] >> 32))
    of, to, far = (np.concatenate(c) for c in zip(*hits))
    open_ = ~full[audited]
    want = exact[open_].sum()
    got = np.isin(of[of != to], audited[open_]).sum()
    if beam < len(own) and got < RECALL * want:
        full[:] = True
    apart = of != to
    of, to, far = of[apart], to[apart], far[apart]
    kept, root = forest(n, of, to, far)
    edges = [(of[kept], to[kept])]
    rows, label = np.flatnonzero(full), _labels(root)
    block = max(1, 500_000 // len(own))
    for a in range(0, len(rows), block):  # what a full beam may not hold, or a search may miss: hits outside the row's tree
        q = rows[a : a + block]
        d = distances(points[q], points[spot])
        x, y = np.nonzero((d <= radius) & (label[spot][None, :] != label[q][:, None]))
        if len(x):
            kept, root = forest(n, q[x], spot[y], d[x, y], root)
            edges.append((q[x][kept], spot[y][kept]))
            label = _labels(root) if kept else label
    of, to = (np.concatenate(c) for c in zip(*edges))
    return ids[of], ids[to], ids[label[of]]


def spread_points(points: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, part, node, f0, f1, own) of (node, f0, f1, keys): a point in all parts of its shards; own: whether it is inserted in that part."""
    count = points.agg(F.sum(F.size("keys"))).first()[0] or 0
    shards = max(1, -(-int(count) // shard_rows))
    spread = points.select("node", "f0", "f1", F.explode(F.array_distinct(F.transform("keys", lambda k: F.pmod(k, F.lit(shards))))).alias("shard"))
    parts = spread.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (4 * shard_rows)).cast("int").alias("parts"))
    spread = spread.join(parts, "shard").withColumn("home", F.pmod(F.xxhash64("node", "shard"), F.col("parts")).cast("int"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return cut(spread.select("shard", "part", "node", "f0", "f1", (F.col("home") == F.col("part")).alias("own")))


def _points(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fp = np.stack([t["f0"].to_numpy(), t["f1"].to_numpy()], 1).view(np.uint64)
    return t["node"].to_numpy(), np.ascontiguousarray(fp), t["own"].to_numpy(zero_copy_only=False)


def candidate_trees(spread: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(shard, part, a, b, tree), a < b: what part_trees() finds in every part."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        a, b, tree = part_trees(*_points(t.combine_chunks().sort_by("node")), radius)
        return pa.table({"shard": pa.array([key[0].as_py()] * len(a), pa.int64()), "part": pa.array([key[1].as_py()] * len(a), pa.int32()), "a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64()), "tree": pa.array(tree, pa.int64())})

    parts = spread.select("shard", "part").distinct().count()
    # a number of its own: bytes, by which partitions are joined at run time, say nothing of the searches' cost; small ones, as parts differ much
    tasks = max(1, min(parts, max(32 * spread.sparkSession.sparkContext.defaultParallelism, parts // 4)))
    return spread.repartition(tasks, "shard", "part").groupBy("shard", "part").applyInArrow(run, "shard long, part int, a long, b long, tree long")


def scan_again(spread: DataFrame, asks: DataFrame, label: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: all pairs at most `radius` apart of the points `asks` (shard, part, node) with the points of their part, but for pairs of one component of `label` (node, root)."""
    asked = spread.join(asks.select("shard", "part").distinct(), ["shard", "part"], "left_semi").join(asks.withColumn("asks", F.lit(True)), ["shard", "part", "node"], "left").join(label, "node", "left")
    asked = asked.select("shard", "part", "node", "f0", "f1", "own", F.coalesce("asks", F.lit(False)).alias("asks"), F.coalesce("root", "node").alias("root"))

    def run(t: pa.Table) -> pa.Table:
        ids, points, own = _points(t)
        rows, spot, root = np.flatnonzero(t["asks"].to_numpy(zero_copy_only=False)), np.flatnonzero(own), t["root"].to_numpy()
        found = [np.zeros((2, 0), np.int64)]
        for a in range(0, len(rows), 256):
            q = rows[a : a + 256]
            x, y = np.nonzero((root[spot][None, :] != root[q][:, None]) & (distances(points[q], points[spot]) <= radius))
            found.append(np.sort(np.stack([ids[q[x]], ids[spot[y]]]), 0))
        low, high = np.unique(np.concatenate(found, 1), axis=1)
        return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

    return asked.groupBy("shard", "part").applyInArrow(run, "a long, b long")


def word_pairs(docs: DataFrame) -> DataFrame:
    """(node, pairs) of (node, text): sorted hashes of the distinct pairs of adjacent words; of the word, where there is one only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = T.buffers(batch["text"])
            for a, b, d, o in T.chunks(data, offs):
                starts, ends, ptr = T.words(low := T.lower(d), o, T.WORD)
                h = T.span_hash(low, starts, ends)
                grams, gptr = T.ngrams(h, ptr, 2)
                lists = [np.unique(grams[gptr[i] : gptr[i + 1]] if gptr[i + 1] > gptr[i] else h[ptr[i] : ptr[i + 1]]) for i in range(b - a)]
                ends_ = np.cumsum([0, *map(len, lists)])
                flat = np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.slice(a, b - a).column("node"), pa.ListArray.from_arrays(pa.array(ends_, pa.int32()), pa.array(flat))], ["node", "pairs"])

    return docs.select("node", "text").mapInArrow(sliced(run, HELD_ROWS), "node long, pairs array<long>")


def among(rows: DataFrame, ids: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """The rows whose doc_id is one of those in ids, and some others, for the caller's join to drop: those whose bit is set in a broadcast map.

    So that join doesn't shuffle all rows: of the others about one in BITS_AN_ID, more where the map would have over
    most_words words of 64 bits.
    """
    words = max(1, min(most_words, -(-ids.count() * BITS_AN_ID // 64)))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(64 * words))
    word, bit = F.shiftright(at, 6).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")
    found = ids.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(words, np.int64)
    held[found["word"].to_numpy()] = found["bits"].to_numpy()
    sent = rows.sparkSession.createDataFrame(pa.table({"held": pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array(held))}))
    return rows.crossJoin(F.broadcast(sent)).where(F.getbit(F.get("held", word), bit) == 1).select(*rows.columns)


def verified(docs: DataFrame, texts: DataFrame, edges: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """The edges (a, b) between nodes whose texts have a Jaccard similarity of word pairs of `jaccard` or more."""
    ends = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(texts.select("node", F.col("rep").alias("doc_id"), "same"), "node"))
    some = among(docs.select("doc_id", "text").where("text <> ''"), ends)
    rows = some.select("doc_id", digest().alias("same"), "text").join(ends, ["doc_id", "same"])
    sets = word_pairs(rows).groupBy("node").agg(F.first("pairs").alias("pairs"))  # rows that repeat have one text
    left, right = sets.toDF("a", "pa"), sets.toDF("b", "pb")
    shared = F.size(F.array_intersect("pa", "pb"))
    return edges.join(left, "a").join(right, "b").where(shared >= jaccard * (F.size("pa") + F.size("pb") - shared)).select("a", "b")


def routing_recall(docs: DataFrame, texts: DataFrame, roots: DataFrame, radius: int, jaccard: float) -> float:
    """Of the pairs at most `radius` apart that verify, of AUDITED points of all and AUDITED with copies, the share that is in one component."""
    points = texts.where(F.size("keys") > 0).select("node", "f0", "f1")
    by_hash = F.xxhash64("node", F.lit(3))
    some = points.join(roots.select("node"), "node", "left_semi").orderBy(by_hash).limit(AUDITED)
    t = points.orderBy(by_hash).limit(AUDITED).union(some).distinct().toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((t["node"].to_numpy(), np.stack([t["f0"].to_numpy(), t["f1"].to_numpy()], 1).view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = sent.value
        for batch in batches:
            near, mine = np.stack([batch["f0"].to_numpy(), batch["f1"].to_numpy()], 1).view(np.uint64), batch["node"].to_numpy()
            x, y = np.nonzero((distances(asked, near) <= radius) & (ids[:, None] != mine[None]))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], mine[y])), pa.array(np.maximum(ids[x], mine[y]))], ["a", "b"])

    pairs = points.mapInArrow(sliced(run, HELD_ROWS), "a long, b long").distinct().join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    pairs = cut(pairs.select("a", "b", (F.coalesce("ra", "a") == F.coalesce("rb", "b")).alias("met")))
    met = pairs.where("met").count()
    apart = pairs.where("not met").select("a", "b")
    lost = 0 if apart.isEmpty() else verified(docs, texts, apart, jaccard).count()
    return met / (met + lost) if met + lost else 1.0


def copies(docs: DataFrame, radius: int = RADIUS, jaccard: float = JACCARD, routes: int = ROUTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, same, keep_id) of each document that has a copy before it; a document is a doc_id and a text, whose digest is `same`."""
    prints = cut(fingerprints(docs, routes))
    texts = prints.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.first("keys").alias("keys"))
    # the least doc_id of a text is its node; where texts share that, the others' nodes are hashes
    one = F.row_number().over(Window.partitionBy("rep").orderBy("same")) == 1
    texts = cut(texts.withColumn("node", F.when(one, F.col("rep")).otherwise(F.xxhash64("rep", "same"))))
    spread = spread_points(texts.where(F.size("keys") > 0), shard_rows)
    trees = cut(candidate_trees(spread, radius))
    tried = cut(trees.select("a", "b").distinct())
    true = cut(verified(docs, texts, tried, jaccard))
    roots = components(true).toDF("node", "root")
    failed = cut(trees.join(true, ["a", "b"], "left_anti").select("shard", "part", "tree").distinct())
    if not failed.isEmpty():
        asks = trees.join(failed, ["shard", "part", "tree"], "left_semi").select("shard", "part", F.explode(F.array("a", "b")).alias("node")).distinct()
        rest = cut(scan_again(spread, asks, roots, radius).distinct().join(tried, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            roots = components(true.union(verified(docs, texts, rest, jaccard))).toDF("node", "root")
    if routes < MOST_ROUTES and routing_recall(docs, texts, roots, radius, jaccard) < RECALL:
        return copies(docs, radius, jaccard, 2 * routes, shard_rows)
    mine = prints.select("doc_id", "same").distinct().join(texts.select("same", "node"), "same").join(roots, "node", "left").select("doc_id", "same", F.coalesce("root", "node").alias("root"))
    kept = mine.groupBy("root").agg(F.min(F.struct("doc_id", "same")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return mine.join(kept, "root").where("struct(doc_id, same) <> kept").select("doc_id", "same", F.col("kept.doc_id").alias("keep_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, jaccard: float = JACCARD, routes: int = ROUTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, keep_id) of each document that has an exact or near copy with a lesser doc_id; keep_id: the least of its group.

    Rows that repeat doc_id and text are one document. Different texts of one doc_id are documents of their
    own, the one of least digest before the others; here a doc_id has a row for each keep_id of its texts, but
    none for itself. Texts equal byte for byte are copies, be they empty or without a word; others without a
    word have no near copies. Rows with a null doc_id or text are never copies. Other columns aren't read. Long
    texts are read whole. An empty table gives no rows. Equal distances resolve by the order of doc_id.
    """
    return copies(docs, radius, jaccard, routes, shard_rows).where("doc_id <> keep_id").select("doc_id", "keep_id").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents but those with a copy before them, as copies() says; of each group one stays. Rows with a null id or text stay."""
    names = docs.columns
    gone = copies(docs).select(F.col("doc_id").alias("id"), "same").alias("gone")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").alias("id"), digest().alias("same"))
    return rows.join(gone, ["id", "same"], "left_anti").select("row.*")
