"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the words of a text, and the first bytes of each (STEMS), as 64-bit hashes. Labels give
toxic or not, so the toxic ones are graded here: the labelled texts fall into two halves, and a text's
markers are the features that toxic texts of the *other* half have far more often than others. Grade 1 goes up to
the median of the marker counts of the half's toxic texts, grade 2 is above. No text's own label has a part in
its markers. How much more often (one of LIFTS) is enough for a feature of the model is chosen by the likelihood
of the second half under a model of the first.

P(grade <= j) = sigmoid(threshold_j - x.w): one weight vector for all thresholds, which ascend. A
feature's value is log(1 + count), not divided by length, so that a toxic passage counts as much in a
long text as in a short one. Expected severity is the sum of P(grade > j) over j.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import text as T
from chatloom.llm.common import cut, table

STEMS, GRADES = (4, 5), 3
#: The labelled sample that the model is fitted on.
TRAIN_DOCS = 8000
#: A feature takes part if so many labelled toxic texts have it (a rarer one says nothing of others), and one of LIFTS times as often as others do; markers of a grade have MARKER_LIFT.
LEAST_DOCS, LIFTS, MARKER_LIFT = 4, (5.0, 10.0, 20.0, 40.0), 20.0
TOXIC_FROM = 0.5


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and of every word's stem, in no order."""
    low = T.lower(data)
    starts, ends, ptr = T.words(low, offs, T.WORD)
    own = T.owners(ptr)
    rows, found = [own], [T.span_hash(low, starts, ends)]
    for stem in STEMS:
        longer = ends - starts > stem
        rows.append(own[longer])
        found.append(T.mix64(T.span_hash(low, starts[longer], starts[longer] + stem), stem))
    return np.concatenate(rows), np.concatenate(found)


def counted(row: np.ndarray, column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, times) of the distinct pairs, ascending."""
    key, times = np.unique(row.astype(np.int64) * width + column, return_counts=True)
    return key // width, key % width, times


@dataclass
class Model:
    known: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def columns(self, row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, times) of the known features."""
        some = np.flatnonzero(self.sieve[(feature & np.uint64((1 << 20) - 1)).astype(np.int64)])
        row, feature = row[some], feature[some]
        at = np.minimum(np.searchsorted(self.known, feature), max(len(self.known) - 1, 0))
        hit = self.known[at] == feature if len(self.known) else np.zeros(len(feature), bool)
        return counted(row[hit], at[hit], max(len(self.known), 1))

    def above(self, n: int, row: np.ndarray, column: np.ndarray, times: np.ndarray) -> np.ndarray:
        """[row, j]: P(grade > j)."""
        z = np.bincount(row, self.weights[column] * np.log1p(times), n)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - z[:, None], -500, 500)))


def balanced(grade: np.ndarray) -> np.ndarray:
    """[row, grade] one-hot, weighted so that toxic and other texts count alike."""
    n, toxic = len(grade), grade > 0
    return np.eye(GRADES)[grade] * np.where(toxic, n / (2 * max(toxic.sum(), 1)), n / (2 * max((~toxic).sum(), 1)))[:, None]


def loss(free: np.ndarray, n: int, row: np.ndarray, column: np.ndarray, value: np.ndarray, one: np.ndarray, width: int, ridge: float) -> tuple[float, np.ndarray]:
    """(mean negative log-likelihood and ridge, its gradient) at the weights, the first threshold, and the logarithms of the gaps to the others."""
    w, gaps = free[:width], np.exp(free[width + 1 :])
    cuts = free[width] + np.concatenate([[0], np.cumsum(gaps)])
    z = np.bincount(row, w[column] * value, n)
    s = 1 / (1 + np.exp(np.clip(z[:, None] - cuts[None], -500, 500)))  # P(grade <= j)
    p = np.maximum(np.diff(np.concatenate([np.zeros((n, 1)), s, np.ones((n, 1))], 1), axis=1), 1e-12)
    q = one / p
    by_cut = -(q[:, :-1] - q[:, 1:]) * s * (1 - s) / n  # of the loss, by each cut less z
    g = np.empty_like(free)
    g[:width] = np.bincount(column, value * -by_cut.sum(1)[row], width) + ridge * w
    c = by_cut.sum(0)
    g[width] = c.sum()
    g[width + 1 :] = np.cumsum(c[::-1])[::-1][1:] * gaps
    return float(-(one * np.log(p)).sum() / n + ridge / 2 * (w @ w)), g


def fit(n: int, row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, rounds: int = 1000, rate: float = 0.05, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on loss()."""
    free = np.zeros(width + GRADES - 1)
    free[width] = 1.0
    m, v, one = np.zeros_like(free), np.zeros_like(free), balanced(grade)
    for t in range(1, rounds + 1):
        _, g = loss(free, n, row, column, value, one, width, ridge)
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        free -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return free[:width], free[width] + np.concatenate([[0], np.cumsum(np.exp(free[width + 1 :]))])


def lift(inside: np.ndarray, outside: np.ndarray, toxic: int, other: int) -> np.ndarray:
    """How many times as often toxic texts have a feature; a text's half is added to those of others."""
    return (inside / max(toxic, 1)) / ((outside + 0.5) / max(other, 1))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """A model fitted on the `train_docs` labelled documents that are first by a hash of doc_id. None if they have no toxic or no other text."""
    by_hash = F.xxhash64("doc_id")
    judged = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = cut(judged.orderBy(by_hash, "doc_id").limit(train_docs).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")))
    # train_docs rows at most
    some = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text <> ''").join(F.broadcast(picked), "doc_id"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch["toxic"].to_numpy() + 2 * batch["half"].to_numpy()
            data, offs = T.buffers(batch["text"])
            for a, b, d, o in T.chunks(data, offs):
                row, feature = features(d, o)
                known, at = np.unique(feature, return_inverse=True)
                row, at, _ = counted(row, at, max(len(known), 1))
                key, n = np.unique(at.astype(np.int64) * 4 + kind[a:b][row], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(known[key // 4].view(np.int64)), pa.array((key % 4).astype(np.int32)), pa.array(n)], ["feature", "kind", "n"])

    sizes = {(r["half"], r["toxic"]): r["n"] for r in some.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = np.array([sizes.get((k // 2, k % 2), 0) for k in range(4)])  # others and toxic ones of the first half, then of the second
    if not (size[0] + size[2] and size[1] + size[3]):
        return None
    seen = some.select("text", "toxic", "half").mapInArrow(tally, "feature long, kind int, n long").groupBy("feature").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)))
    # only what toxic texts share reaches the driver
    t = seen.where(F.col("n1") + F.col("n3") >= LEAST_DOCS).where((F.col("n1") + F.col("n3")) / int(size[1] + size[3]) >= LIFTS[0] * (F.col("n0") + F.col("n2") + 0.5) / int(size[0] + size[2])).toArrow()
    names, n = t["feature"].to_numpy().view(np.uint64), np.stack([t[f"n{k}"].to_numpy() for k in range(4)], 1)
    order = np.argsort(names)
    names, n = names[order], n[order]
    model = Model(names, np.zeros(len(names)), np.ones(GRADES - 1))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = T.buffers(batch["text"])
            for a, b, d, o in T.chunks(data, offs):
                row, at, times = sent.value.columns(*features(d, o))
                ends = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (at, times))
                yield pa.RecordBatch.from_arrays([*(batch.slice(a, b - a).column(c) for c in ("doc_id", "toxic", "half")), *lists], ["doc_id", "toxic", "half", "at", "times"])

    rows = some.mapInArrow(pick, "doc_id long, toxic int, half int, at array<int>, times array<int>").toArrow().combine_chunks().sort_by("doc_id")
    toxic, half = rows["toxic"].to_numpy().astype(np.int64), rows["half"].to_numpy()
    lists, times = rows["at"].combine_chunks(), rows["times"].combine_chunks().flatten().to_numpy()
    row, column = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().astype(np.int64)
    grade = toxic.copy()
    for h in (0, 1):  # graded by the markers of the other half
        marker = lift(n[:, 3 - 2 * h], n[:, 2 - 2 * h], size[3 - 2 * h], size[2 - 2 * h]) >= MARKER_LIFT
        marks = np.bincount(row, marker[column] * times, len(rows))
        mine = (half == h) & (toxic == 1)
        if mine.any():
            grade[mine & (marks > np.median(marks[mine]))] = 2

    def fitted(good: np.ndarray, texts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        hit = good[column] & texts[row]
        number = np.cumsum(texts) - 1
        return fit(int(texts.sum()), number[row[hit]], (np.cumsum(good) - 1)[column[hit]], np.log1p(times[hit]), grade[texts], int(good.sum()), rounds)

    first, tried = half == 0, []
    for least in LIFTS if size.all() else ():
        good = (n[:, 1] >= LEAST_DOCS / 2) & (lift(n[:, 1], n[:, 0], size[1], size[0]) >= least)
        weights, cuts = fitted(good, first, 300)
        hit = good[column] & ~first[row]
        free = np.concatenate([weights, cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-9))])
        number = np.cumsum(~first) - 1
        tried.append((loss(free, int((~first).sum()), number[row[hit]], (np.cumsum(good) - 1)[column[hit]], np.log1p(times[hit]), balanced(grade[~first]), int(good.sum()), 0.0)[0], least))
    least = min(tried)[1] if tried else LIFTS[0]
    good = lift(n[:, 1] + n[:, 3], n[:, 0] + n[:, 2], size[1] + size[3], size[0] + size[2]) >= least
    weights, thresholds = fitted(good, np.ones(len(rows), bool), 1000)
    return Model(names[good], weights, thresholds)


def severity(docs: DataFrame, model: Model | None, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """(doc_id, severity, grade, toxic) of every row.

    severity: the expected grade, 0 to GRADES - 1; grade: the most probable one, the lesser of equal
    ones; toxic: whether P(grade > 0) is toxic_from or more. Null and empty texts have no features, and
    so the severity of a text that has none. Without a model all three are null. Rows that repeat are
    judged each; null ids stay null. A P(grade > 0) equal to
    toxic_from is toxic. Other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            data, offs = T.buffers(batch["text"])
            for a, b, d, o in T.chunks(data, offs):
                n = b - a
                if model is None:
                    cols = [pa.nulls(n, t) for t in (pa.float64(), pa.int32(), pa.bool_())]
                else:
                    above = model.above(n, *model.columns(*features(d, o)))
                    each = -np.diff(np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1), axis=1)
                    cols = [pa.array(np.round(above.sum(1), 6)), pa.array(each.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= toxic_from)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, n), *cols], ["doc_id", "severity", "grade", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, train(docs, table(spark, sf_dir, "labels")))
