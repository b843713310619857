"""Quality by the log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

The 1- and 2-grams of words (split at white space, compared byte for byte) are hashed to 2 ** BITS buckets.

Target multinomial: the labelled documents of quality 1, smoothed towards the raw one with as much weight as
they have themselves. Raw multinomial: all documents. A text's score is the mean over its n-grams of
log(target) - log(raw), so it doesn't grow with length, and a text is kept if that is the threshold or more.
The same rule holds for every text, at every length.

The threshold isn't set by hand: all labelled documents fall into FOLDS folds, each is scored by a target of the
other folds' good ones, and it is where the shares of good and of bad ones on the right side have the greatest
mean. The target that scores the corpus is of the good ones of all folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import text as T
from chatloom.llm.common import cut, table

BITS, SMOOTHING = 20, 0.5
#: Folds of the labelled documents.
FOLDS = 4
#: Up to so many trusted ids go to all executors (8 bytes each); more are joined by a shuffle, with the same counts.
SENT_IDS = 4_000_000
#: Up to so many labelled rows go to all executors for the threshold; more are joined by a shuffle, with the same counts.
SENT_LABELS = 1_000_000
#: Held-out scores are counted by steps of this size.
STEP = 1e-3


def grams(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every 1- and 2-gram."""
    starts, ends, ptr = T.words(data, offs, T.NOT_SPACE)
    h = T.span_hash(data, starts, ends)
    rows, buckets = [], []
    for n in (1, 2):
        g, gptr = T.ngrams(h, ptr, n)
        rows.append(T.owners(gptr))
        buckets.append((T.mix64(g, n) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def _tally(docs: DataFrame, trusted: tuple[np.ndarray, np.ndarray] | None, folds: int, bits: int) -> DataFrame:
    """(bucket, raw, target by fold) summed by task; trusted: ids, ascending, and their folds; where it is None, docs have doc_id, text and `fold`, null for those not trusted."""
    sent = docs.sparkSession.sparkContext.broadcast(trusted)
    names = [f"t{k}" for k in range(folds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros((folds, 1 << bits), np.int64)
        known = sent.value
        for batch in batches:
            if known is None:
                fold = batch["fold"].fill_null(-1).to_numpy(zero_copy_only=False)
            else:
                ids, of = known
                mine = batch["doc_id"].fill_null(0).to_numpy()
                at = np.minimum(np.searchsorted(ids, mine), max(len(ids) - 1, 0))
                good = (ids[at] == mine if len(ids) else np.zeros(len(mine), bool)) & batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
                fold = np.where(good, of[at] if len(ids) else -1, -1)
            data, offs = T.buffers(batch["text"])
            for a, b, d, o in T.chunks(data, offs):
                row, bucket = grams(d, o, bits)
                np.add.at(raw, bucket, 1)
                mine = fold[a:b][row]
                np.add.at(target, (mine[mine >= 0], bucket[mine >= 0]), 1)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), *(pa.array(t[some]) for t in target)], ["bucket", "raw", *names])

    return docs.mapInArrow(run, ", ".join(["bucket int", "raw long", *(f"{c} long" for c in names)]))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good, fold) of all labelled documents whose labels agree."""
    some = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("quality").alias("top")).where("q = top")
    return cut(some.select("doc_id", (F.col("q") == 1).alias("good"), F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(FOLDS)).cast("int").alias("fold")))


def judged(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id) trusted, (doc_id, good) held out): one split, with the first fold held out."""
    known = labelled(labels)
    return known.where("good and fold <> 0").select("doc_id"), known.where("fold = 0").select("doc_id", "good")


def tallies(docs: DataFrame, trusted: DataFrame, folds: int, bits: int = BITS, sent_ids: int = SENT_IDS) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all documents, and [fold, bucket] over the trusted ones (doc_id, fold)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if trusted.count() <= sent_ids:
        t = trusted.toArrow()
        ids, fold = t["doc_id"].to_numpy().astype(np.int64), t["fold"].to_numpy().astype(np.int8)
        counts = _tally(text, (ids[k := np.argsort(ids)], fold[k]), folds, bits)
    else:
        counts = _tally(text.join(trusted.select("doc_id", "fold"), "doc_id", "left"), None, folds, bits)
    total = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), *(F.sum(f"t{k}").alias(f"t{k}") for k in range(folds))).toArrow()
    raw, target = np.zeros(1 << bits), np.zeros((folds, 1 << bits))
    at = total["bucket"].to_numpy()
    raw[at] = total["raw"].to_numpy()
    for k in range(folds):
        target[k, at] = total[f"t{k}"].to_numpy()
    return raw, target


def ratio(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(target) - log(raw) by bucket, of counts. All 0 if the target has none."""
    if not target.any():
        return np.zeros(len(raw), np.float32)
    q = (raw + smoothing) / (raw + smoothing).sum()
    p = (target / target.sum() + q) / 2
    return (np.log(p) - np.log(q)).astype(np.float32)


def ratios(docs: DataFrame, trusted: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING, sent_ids: int = SENT_IDS) -> np.ndarray:
    """ratio() of counts over all documents and over the trusted ones (doc_id)."""
    raw, target = tallies(docs, trusted.select("doc_id", F.lit(0).alias("fold")), 1, bits, sent_ids)
    return ratio(raw, target[0], smoothing)


def threshold_of(steps: list[tuple[int, int, int]]) -> float | None:
    """From (step, good, bad) counts of held-out scores: where the mean of the shares of good ones at or above and of bad ones beneath is greatest, half way between the steps there, and at the lowest of equal places; None without good or bad ones."""
    good, bad = sum(s[1] for s in steps), sum(s[2] for s in steps)
    if not good or not bad:
        return None
    steps = sorted(steps)
    kept, gone, best = good, 0, []
    for k, (_, g, b) in enumerate(steps):  # steps[k] and all above are kept
        best.append((kept / good + gone / bad, k))
        kept, gone = kept - g, gone + b
    k = max(best, key=lambda x: (round(x[0], 12), -x[1]))[1]
    below = steps[k - 1][0] + 1 if k else steps[k][0]
    return (below + steps[k][0]) / 2 * STEP


def _scores(batch: pa.RecordBatch, by_bucket: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, n-grams, mean ratio)."""
    bits = len(by_bucket).bit_length() - 1
    data, offs = T.buffers(batch["text"])
    for a, b, d, o in T.chunks(data, offs):
        row, bucket = grams(d, o, bits)
        n = np.bincount(row, minlength=b - a)
        yield a, b, n, np.round(np.bincount(row, by_bucket[bucket], b - a) / np.maximum(n, 1), 6)


def threshold(docs: DataFrame, held: DataFrame, by_bucket: np.ndarray, sent_labels: int = SENT_LABELS) -> float | None:
    """threshold_of() the scores of all of `held`: (doc_id, good), or (doc_id, good, fold), where by_bucket is [fold, bucket] and a document is scored by its fold's."""
    sent = docs.sparkSession.sparkContext.broadcast(np.atleast_2d(by_bucket))
    held = held if "fold" in held.columns else held.withColumn("fold", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch["fold"].to_numpy()
            for k in np.unique(fold):
                mine = batch.filter(pa.array(fold == k))
                for a, b, n, mean in _scores(mine, sent.value[k]):
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.floor(mean[some] / STEP).astype(np.int32)), mine["good"].slice(a, b - a).take(pa.array(some))], ["step", "good"])

    few = held.count() <= sent_labels
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(held) if few else held, "doc_id").select("text", "good", "fold").mapInArrow(run, "step int, good boolean")
    steps = rows.groupBy("step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect()
    return threshold_of([tuple(r) for r in steps])


def score(docs: DataFrame, by_bucket: np.ndarray, least: float | None) -> DataFrame:
    """(doc_id, n_grams, score, keep) of every row; keep: whether the score is `least` or more, an equal one too. None: all that have n-grams are kept.

    Null, empty and blank texts have no n-grams: their score is null, and they aren't kept. Rows that
    repeat are judged each, null ids stay null. Other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(by_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, n, mean in _scores(batch, sent.value):
                good = (n > 0) & (mean >= least if least is not None else True)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(mean, mask=n == 0), pa.array(good)], ["doc_id", "n_grams", "score", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_grams long, score double, keep boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = labelled(table(spark, sf_dir, "labels"))
    raw, target = tallies(docs, known.where("good").select("doc_id", "fold"), FOLDS)
    whole = target.sum(0)
    others = np.stack([ratio(raw, whole - t) for t in target])
    return score(docs, ratio(raw, whole), threshold(docs, known, others))
