"""Repeated passages by suffix arrays built with two-stage sorting.

A passage is a run of `length` or more words, words being split at ASCII white space and compared
byte for byte. Every window of `length` words belongs to the group of its minimizer, the least hash
among the n-grams of `gram` words in it, so equal windows always meet in one group.

1. Runs of windows with one minimizer are listed per document, without text. Only minimizers of two
   documents or more can repeat across documents; the others' runs go. A minimizer of more than `hot_runs`
   runs is divided by a second one of the same windows, from another hash.
2. The words of the runs that remain (as 32-bit codes) collapse where they are equal before they are brought
   together by minimizer; which documents hold them stays apart. Over the distinct runs of whole groups a suffix
   array is built: only the suffixes smaller than their successors are sorted directly (by the words up to the
   next of them, and where these tie, by the ranks of twice as many of them each time), and all others are
   induced from them by one scan over the buckets of first words. Then the common prefix of each adjacent pair
   is computed.
3. Neighbours whose common prefix has `length` words or more begin with the same window. All of its occurrences
   but those in the document of least doc_id are repeats. Adjacent windows join to spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chatloom.llm import text as T
from chatloom.llm.common import cut, table

LENGTH, GRAM = 50, 8
#: Words of distinct runs that one suffix array takes, beyond which the next whole group begins another.
ARRAY_WORDS = 400_000
#: Runs of one minimizer beyond which a second minimizer divides them.
HOT_RUNS = 65_536


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i:i+width] for each i where it fits; by doubling."""
    if len(x) < width:
        return x[:0]
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def minimizer_runs(h: np.ndarray, ptr: np.ndarray, length: int, gram: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, minimizer, first window, windows) of the runs of consecutive windows of a row with one minimizer; for those in `hot` (sorted), with one pair of minimizers."""
    none = np.zeros(0, np.int64)
    if len(h) < length:
        return none, none.view(np.uint64), none, none
    g = h[: len(h) - gram + 1].copy()
    for k in range(1, gram):
        g = g * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - gram + 1 + k]
    least = sliding_min(T.mix64(g), length - gram + 1)
    if hot is not None and len(hot):
        some = hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least
        if some.any():
            least = np.where(some, T.mix64(least, 5) ^ sliding_min(T.mix64(g, 9), length - gram + 1), least)
    own = T.owners(ptr)
    inside = own[: len(least)] == own[length - 1 :]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (own[1 : len(least)] != own[: len(least) - 1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return none, none.view(np.uint64), none, none
    count = np.add.reduceat(inside.astype(np.int64), starts)
    row = own[starts]
    return row, least[starts], starts - ptr[row], count


def doubled(order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence of ranks in order, of its places sorted by rank; fresh: whether a rank differs from the one before.

    Those that tie are sorted by the rank that follows at 1, 2, 4 and so on places; the end is less than all. The
    rounds are as many as the binary logarithm of the longest common prefix, whatever the sequence repeats.
    """
    n = len(order)
    order, head = order.copy(), np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    open_ = np.arange(n)  # spots of `order` that may tie
    ahead = 1
    while True:
        same = head[open_][1:] == head[open_][:-1]
        open_ = open_[np.append(same, False) | np.append(False, same)]
        if not len(open_):
            return order
        at = order[open_]
        after = np.where(at + ahead < n, rank[np.minimum(at + ahead, n - 1)], -1)
        k = np.lexsort((after, head[open_]))
        at, after, mine = at[k], after[k], head[open_]
        new = np.ones(len(k), bool)
        new[1:] = (mine[1:] != mine[:-1]) | (after[1:] != after[:-1])
        order[open_] = at
        head[open_] = np.maximum.accumulate(np.where(new, open_, 0))
        rank[at] = head[open_]
        ahead *= 2


def two_stage(t: np.ndarray) -> np.ndarray:
    """The suffix array of small whole numbers, a suffix before those that it is a prefix of.

    A suffix is of type B if it is smaller than the suffix after it, else of type A; the last one is A. Only
    B is sorted directly: by the numbers from one B to the next, in which a B stands behind an A of the same
    number. What ties there is settled by the order of the sequence of ranks, as doubled() finds it; the stretches
    together are never longer than 2 n. A are put at the front of their bucket in the order of a scan, which
    meets a suffix's successor before the suffix.
    """
    n = len(t)
    if n < 2:
        return np.arange(n)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:] - t[:-1])
    step[-1] = -1
    settled = np.where(step != 0, np.arange(n), n)
    settled = np.minimum.accumulate(settled[::-1])[::-1]
    rising = step[settled] > 0
    direct = np.flatnonzero(rising)
    if len(direct):
        raw = (2 * t + rising).astype(">u4").tobytes()
        stop = np.minimum(np.append(direct[1:] + 1, n), n)
        keys = [raw[4 * a : 4 * b] for a, b in zip(direct.tolist(), stop.tolist())]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        fresh = np.ones(len(order), bool)
        fresh[1:] = [keys[a] != keys[b] for a, b in zip(order[1:].tolist(), order[:-1].tolist())]
        del keys
        if not fresh.all():
            order = doubled(order, fresh)
        direct = direct[order]
    size = np.bincount(t, minlength=int(t.max()) + 1)
    head = np.concatenate([[0], np.cumsum(size)[:-1]])
    out = np.full(n, -1, np.int64)
    if len(direct):
        bucket = t[direct]
        back = np.bincount(bucket, minlength=len(size))
        out[(head + size - back)[bucket] + np.arange(len(direct)) - np.searchsorted(bucket, bucket)] = direct
    sa, front, falling, words = out.tolist(), head.tolist(), (~rising).tolist(), t.tolist()
    sa[front[words[-1]]] = n - 1  # the end, which is less than all, comes before the last suffix
    front[words[-1]] += 1
    for k in range(n):
        j = sa[k] - 1
        if j >= 0 and falling[j]:
            c = words[j]
            sa[front[c]] = j
            front[c] += 1
    return np.array(sa, np.int64)


def suffix_array(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of `codes` in the order of their suffixes, by two-stage sorting.

    `ends` gives each segment's end; a suffix ends with its segment, and of two suffixes where one is
    a prefix of the other, that one is first; of equal ones, the one in the earlier segment.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    _, rank = np.unique(codes, return_inverse=True)
    # with a terminator after each segment, less than all words and in the order of the segments
    segments = len(ends)
    stops = ends + np.arange(segments)
    t = np.empty(n + segments, np.int64)
    t[np.arange(n) + np.searchsorted(ends, np.arange(n), "right")] = rank + segments
    t[stops] = np.arange(segments)
    sa = two_stage(t)[segments:]
    return sa - np.searchsorted(stops, sa)  # without the terminators


def common_prefixes(codes: np.ndarray, left: np.ndarray, sa: np.ndarray, vector: int = 64) -> np.ndarray:
    """The words that each adjacent pair of the suffix array has in common; left: words up to the segment's end.

    Up to `vector` words by comparing all pairs at once; the longer ones in the order of the text, where each is
    at most one shorter than the one before.
    """
    x, y = sa[:-1], sa[1:]
    most = np.minimum(left[x], left[y])
    out = np.zeros(len(x), np.int64)
    alive = np.arange(len(x))
    for k in range(vector):
        alive = alive[most[alive] > k]
        alive = alive[codes[x[alive] + k] == codes[y[alive] + k]]
        out[alive] = k + 1
        if not len(alive):
            return out
    words, bound = codes.tolist(), most.tolist()
    last, n = -2, 0
    for k in alive[np.argsort(x[alive])].tolist():
        i, j = int(x[k]), int(y[k])
        n = max(vector, n - 1) if i == last + 1 else vector
        while n < bound[k] and words[i + n] == words[j + n]:
            n += 1
        out[k], last = n, i
    return out


def repeats_of_groups(codes: np.ndarray, lens: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(segment, first window in it, windows, first doc, its first window): the windows of distinct segments with the first document that has them.

    codes: words of the segments, one after another, with lengths lens; the first document that holds
    segment i is doc[i], from word start[i].
    """
    ends = np.cumsum(lens)
    sa = suffix_array(codes, ends)
    owner = np.repeat(np.arange(len(lens)), lens)
    offset = np.arange(len(codes)) - np.repeat(ends - lens, lens)
    left = np.repeat(ends, lens) - np.arange(len(codes))
    # classes of equal windows, among the suffixes of `length` words or more
    new = np.ones(len(sa), bool)
    new[1:] = common_prefixes(codes, left, sa) < length
    label = np.cumsum(new) - 1
    long = left[sa] >= length
    sa, label = sa[long], label[long]
    if not len(sa):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    d, p = doc[owner[sa]], start[owner[sa]] + offset[sa]
    k = np.lexsort((p, d, label))
    first = k[np.searchsorted(label, label[k])]  # label is ascending
    source_doc, source_at = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
    source_doc[sa[k]], source_at[sa[k]] = d[first], p[first]
    pos = np.flatnonzero(left >= length)
    seg, at, sd, sp = owner[pos], offset[pos], source_doc[pos], source_at[pos]
    run = np.ones(len(pos), bool)
    run[1:] = (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1) | (sd[1:] != sd[:-1]) | (sp[1:] != sp[:-1] + 1)
    s = np.flatnonzero(run)
    return seg[s], at[s], np.diff(np.append(s, len(run))), sd[s], sp[s]


def repeated_windows(segments: DataFrame, length: int) -> DataFrame:
    """(mm, same, at, windows, first_doc_id, first_start_word) of (mm, same, codes, first: struct of doc_id and start, last: doc_id), of which whole groups mm must be in a partition, sorted by mm."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        data, offs = _binary(t["codes"])
        lead = t["first"].combine_chunks() if isinstance(t["first"], pa.ChunkedArray) else t["first"]
        doc, start = (lead.field(c).to_numpy().astype(np.int64) for c in range(2))
        seg, *out = repeats_of_groups(np.ascontiguousarray(data).view(np.uint32), np.diff(offs) // 4, doc, start, length)
        again = np.flatnonzero(out[2] < t["last"].to_numpy()[seg])  # windows that some holder of the segment has from another document
        seg, out = seg[again], [c[again] for c in out]
        return pa.RecordBatch.from_arrays([*(t[c].combine_chunks().take(pa.array(seg)) for c in ("mm", "same")), *(pa.array(c, pa.int64()) for c in out)], ["mm", "same", "at", "windows", "first_doc_id", "first_start_word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            mm = batch["mm"].to_numpy()
            if not len(mm):
                continue
            width = np.diff(_binary(batch["codes"])[1]) // 4
            edge = np.flatnonzero(mm[1:] != mm[:-1]) + 1
            bounds, a = np.concatenate([[0], edge, [len(mm)]]), 0
            total = np.concatenate([[0], np.cumsum(width)])
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                fresh = lo > 0 or (held and held[-1]["mm"][-1].as_py() != mm[0])
                if fresh and size + total[lo] - total[a] >= ARRAY_WORDS:
                    if lo > a:
                        held.append(batch.slice(a, lo - a))
                    yield solve(held)
                    held, size, a = [], 0, lo
            held.append(batch.slice(a))
            size += total[-1] - total[a]
        if held:
            yield solve(held)

    return segments.mapInArrow(run, "mm long, same long, at long, windows long, first_doc_id long, first_start_word long")


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offs) of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def text_key() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64("text")


def spans_of_texts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """repeated_spans() with `key`, the text_key() of the text that has the passage."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").select("doc_id", text_key().alias("key"), "text")
    spark = docs.sparkSession

    def list_runs(hot: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, keys = batch["doc_id"].to_numpy(), batch["key"].to_numpy()
                data, offs = T.buffers(batch["text"])
                for a, _, d, o in T.chunks(data, offs):
                    starts, ends, ptr = T.words(d, o, T.NOT_SPACE)
                    row, least, first, count = minimizer_runs(T.span_hash(d, starts, ends), ptr, length, gram, hot.value)
                    yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(ids[a + row]), pa.array(keys[a + row]), pa.array(first, pa.int32()), pa.array(count, pa.int32())], ["mm", "doc_id", "key", "start", "windows"])

        return rows.mapInArrow(run, "mm long, doc_id long, key long, start int, windows int").repartition("mm")

    def groups(runs: DataFrame) -> DataFrame:
        return runs.groupBy("mm").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")

    none = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    runs = list_runs(none)
    alive = cut(groups(runs).select("mm", "n"))
    # at most one in hot_runs of all runs is a hot minimizer
    hot = np.sort(alive.where(F.col("n") > hot_runs).select("mm").toArrow()["mm"].to_numpy().view(np.uint64))
    if len(hot):
        runs = list_runs(spark.sparkContext.broadcast(hot))
        alive = groups(runs)
    wanted = runs.join(alive.select("mm"), "mm", "left_semi").groupBy("doc_id", "key").agg(F.collect_set(F.struct("mm", "start", "windows")).alias("runs"))
    held = rows.join(wanted, ["doc_id", "key"])

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch["doc_id"].to_numpy(), batch["key"].to_numpy()
            runs = batch["runs"]
            of = np.diff(runs.offsets.to_numpy())
            mm, start, count = (runs.flatten().field(c).to_numpy() for c in range(3))
            to = np.concatenate([[0], np.cumsum(of)])
            data, offs = T.buffers(batch["text"])
            for a, b, d, o in T.chunks(data, offs):
                s, e, ptr = T.words(d, o, T.NOT_SPACE)
                code = (T.span_hash(d, s, e) >> np.uint64(32)).astype(np.uint32)
                own = np.repeat(np.arange(b - a), of[a:b])
                m, at, n = mm[to[a] : to[b]], start[to[a] : to[b]], count[to[a] : to[b]]
                width = n.astype(np.int64) + length - 1
                first = ptr[own] + at
                size = np.concatenate([[0], np.cumsum(width)])
                pick = np.repeat(first - size[:-1], width) + np.arange(size[-1])
                lo = 0
                while lo < len(m):
                    hi = max(lo + 1, int(np.searchsorted(size, size[lo] + 250_000, "right")) - 1)
                    blob = np.frombuffer(code[pick[size[lo] : size[hi]]].tobytes(), np.uint8)
                    edge = (size[lo : hi + 1] - size[lo]) * 4
                    codes = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(blob)])
                    same = T.span_hash(blob, edge[:-1], edge[1:]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(m[lo:hi]), pa.array(same), pa.array(ids[a + own[lo:hi]]), pa.array(keys[a + own[lo:hi]]), pa.array(at[lo:hi].astype(np.int32)), codes], ["mm", "same", "doc_id", "key", "start", "codes"])
                    lo = hi

    members = cut(held.mapInArrow(list_words, "mm long, same long, doc_id long, key long, start int, codes binary"))
    # equal runs collapse before the shuffle; the documents that hold them follow without their words
    segments = members.groupBy("mm", "same").agg(F.first("codes").alias("codes"), F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last"))
    solved = cut(repeated_windows(segments.repartition("mm").sortWithinPartitions("mm"), length))
    found = members.drop("codes").join(solved, ["mm", "same"]).where("doc_id > first_doc_id")
    found = found.select("doc_id", "key", (F.col("start") + F.col("at")).alias("start_word"), "windows", "first_doc_id", "first_start_word").distinct()
    diagonal = Window.partitionBy("doc_id", "key", "first_doc_id", F.col("first_start_word") - F.col("start_word")).orderBy("start_word")
    joined = found.withColumn("new", F.coalesce((F.lag(F.col("start_word") + F.col("windows")).over(diagonal) < F.col("start_word")).cast("int"), F.lit(1)))
    joined = joined.withColumn("span", F.sum("new").over(diagonal)).groupBy("doc_id", "key", "first_doc_id", (F.col("first_start_word") - F.col("start_word")).alias("d"), "span")
    return joined.agg(
        F.min("start_word").alias("start_word"), (F.max(F.col("start_word") + F.col("windows")) - F.min("start_word") + length - 1).alias("n_words"), F.min("first_start_word").alias("first_start_word")
    ).select("doc_id", "key", "start_word", "n_words", "first_doc_id", "first_start_word")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id, first_start_word) of every passage that a document of lesser doc_id has too.

    A span is a longest run of repeated windows with one first document and one distance to it;
    first_doc_id is the least document that has the window, first_start_word its first place there.
    Spans of a document may overlap. Repeats within one document, or among texts that share a doc_id, aren't
    repeats. Null doc_ids and null texts have none; texts of fewer words than `length` neither. Different
    texts of one doc_id have their spans each; rows that repeat doc_id and text have them once. Other columns
    aren't read. An empty table gives no rows.
    """
    return spans_of_texts(docs, length, gram, hot_runs).drop("key").distinct()


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the words of the spans (doc_id, key, start_word, n_words) of their doc_id and text, each with the white space after it; n_chars follows. A text with no word left loses its row."""
    cuts = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct(F.col("start_word").alias("a"), F.col("n_words").alias("n"))).alias("cuts")).withColumnRenamed("doc_id", "id")
    names, form = docs.columns, docs.schema
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key().alias("key"), F.col("text").alias("text")).join(cuts, ["id", "key"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch["cuts"].to_pylist()
            out = []
            for value, cut_ in zip(batch["text"], cuts):
                raw = value.as_buffer().to_pybytes()
                d = np.frombuffer(raw, np.uint8)
                s, e, _ = T.words(d, np.array([0, len(d)]), T.NOT_SPACE)
                gone = np.zeros(len(s) + 1, np.int64)
                for x in cut_:
                    gone[min(x["a"], len(s))] += 1
                    gone[min(x["a"] + x["n"], len(s))] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                if gone.all():
                    out.append(None)
                    continue
                nxt = np.append(s[1:], len(d))
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                keep, at = [], 0
                for x, y in zip(edges[::2], edges[1::2]):
                    keep.append(raw[at : s[x]])
                    at = int(nxt[y - 1])
                keep.append(raw[at:])
                out.append(b"".join(keep).decode())
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(out, pa.string())], ["row", "left"])

    changed = held.where("cuts is not null").select("row", "text", "cuts").mapInArrow(run, StructType([StructField("row", form), StructField("left", StringType())])).where("left is not null")
    new = {"text": F.col("left")} | ({"n_chars": F.length("left").cast(form["n_chars"].dataType)} if "n_chars" in names else {})
    changed = changed.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in names))
    return held.where("cuts is null").select("row.*").union(changed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_spans(docs, spans_of_texts(docs))


#: Each window of 50 words that a lesser document has too, with its least place; joined to spans.
SQL = rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\t\n\x0B\f\r\x1C-\x1F ]+'), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT doc_id, i - 1 AS p, md5(array_to_string(words[i : i + {LENGTH - 1}], ' ')) AS h
  FROM w, LATERAL (SELECT unnest(range(1, len(words) - {LENGTH - 2})) AS i)
), f AS (
  SELECT h, min({{'d': doc_id, 'p': p}}) AS m FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)
), r AS (
  SELECT g.doc_id, g.p, f.m.d AS fd, f.m.p AS fp FROM g JOIN f USING (h) WHERE g.doc_id > f.m.d
), s AS (
  SELECT *, p - row_number() OVER (PARTITION BY doc_id, fd, fp - p ORDER BY p) AS island FROM r
)
SELECT doc_id, min(p) AS start_word, count(*) + {LENGTH - 1} AS n_words, fd AS first_doc_id, min(fp) AS first_start_word
FROM s GROUP BY doc_id, fd, fp - p, island
"""
