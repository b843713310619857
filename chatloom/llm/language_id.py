"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes fall into 128 classes (letters without case, one class each for digits, white space and other
ASCII, and the bytes of multi-byte characters). The network embeds the classes, applies filters of
several widths, takes each filter's greatest response over a window of fixed length, and ends in a
softmax. A text is tiled by windows from end to end; the mean of their probabilities, weighted by the
bytes they hold, is the text's.

The softmax knows no other language than the labelled ones, so texts of none are told by their pairs
of bytes: the mean log-probability of a class after the one before it, in the most probable language.
Punctuation counts as white space; pairs without a letter, and those with a digit, don't count. A text
passes where that mean is over a limit between the language's own texts and random letters of its alphabet.

For application, embedding and filters are multiplied out into tables by pair of classes, so that a
filter bank of width 4 at a position is the sum of two table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chatloom.llm import text as T
from chatloom.llm.common import sliced, table

WINDOW, WIDTHS, FILTERS, EMBED = 192, (2, 3, 4), 16, 8
#: The labelled sample that the network is fitted on: so many documents, with all of their windows.
TRAIN_DOCS = 1000
#: Rows that a worker judges at once.
HELD_ROWS = 1000
#: Added to the count of each pair of classes; an alphabet's least share of a language's letters; how far the
#: limit is from random letters' mean towards the language's.
SMOOTH, LEAST_SHARE, LIMIT = 0.1, 5e-4, 0.4

_PAD = 127
CLASSES = np.full(256, 28, np.uint8)
CLASSES[97:123] = CLASSES[65:91] = np.arange(26)
CLASSES[48:58] = 26
CLASSES[[9, 10, 11, 12, 13, 32]] = 27
CLASSES[128:192] = np.arange(32, 96)
CLASSES[192:256] = 104
CLASSES[[0xC2, 0xC3, 0xC4, 0xC5]] = [96, 97, 98, 99]
CLASSES[0xC6:0xD0], CLASSES[0xD0:0xE0], CLASSES[0xE0:0xF0] = 100, 101, 102
LETTER = np.ones(128, bool)
LETTER[[26, 27, 28, _PAD]] = False
#: The classes as pairs take them: punctuation as white space.
PAIRED = np.arange(128, dtype=np.uint8)
PAIRED[28] = 27


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes [n, WINDOW], bytes in each, pointer of each row into them): texts tiled end to end; an empty one has no window."""
    count = -(-np.diff(offs) // WINDOW)
    ptr = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(count)), count)
    start = offs[:-1][row] + WINDOW * (np.arange(ptr[-1]) - ptr[:-1][row])
    held = np.minimum(offs[1:][row] - start, WINDOW)
    out = np.full((len(row), WINDOW), _PAD, np.uint8)
    inside = np.arange(WINDOW)[None, :] < held[:, None]
    out[inside] = CLASSES[data]
    return out, held, ptr


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    #: By label and pair of classes the log-probability less the label's limit, 0 for pairs that don't count; None: no text is rejected by its pairs.
    pairs: np.ndarray | None = None

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """For each width, rows to add at a position: by pair of classes, and by class where the width is odd."""
        done = []
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            at = [(self.embed @ f[k]).astype(np.float32) for k in range(w)]
            pairs = [(at[k][:, None] + at[k + 1][None]).reshape(128 * 128, FILTERS) for k in range(0, w - 1, 2)]
            pairs[0] += b
            done.append((*pairs, at[-1]) if w % 2 else tuple(pairs))
        return done

    def probabilities(self, x: np.ndarray, tables: list[tuple[np.ndarray, ...]] | None = None) -> np.ndarray:
        tables = tables or self.tables()
        out = np.empty((len(x), len(self.labels)), np.float32)
        for a in range(0, len(x), 64):  # what a block touches stays in the processor's cache
            c = x[a : a + 64]
            pair = c[:, :-1].astype(np.intp) * 128 + c[:, 1:]
            top = []
            for w, rows in zip(WIDTHS, tables):
                n = WINDOW - w + 1
                r = rows[0].take(pair[:, :n], 0)
                for k in range(1, len(rows)):
                    r += rows[k].take(pair[:, 2 * k : 2 * k + n] if len(rows[k]) > 128 else c[:, w - 1 : w - 1 + n], 0)
                top.append(r.max(1))
            z = np.maximum(np.concatenate(top, 1), 0) @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[a : a + 64] = z / z.sum(1, keepdims=True)
        return out


def loss(p: list[np.ndarray], c: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(weighted mean cross-entropy, its gradients) of a batch of windows; p: embedding, filters, biases, output weights and bias."""
    nw, n_rows = len(WIDTHS), len(c)
    e = p[0][c]
    g = [np.zeros_like(q) for q in p]
    cols, tops, args = [], [], []
    for j, w in enumerate(WIDTHS):
        n = WINDOW - w + 1
        col = np.concatenate([e[:, q : q + n] for q in range(w)], 2)
        r = col @ p[1 + j].reshape(w * EMBED, FILTERS) + p[1 + nw + j]
        arg = r.argmax(1)
        cols.append(col)
        args.append(arg)
        tops.append(np.take_along_axis(r, arg[:, None], 1)[:, 0])
    pre = np.concatenate(tops, 1)
    h = np.maximum(pre, 0)
    z = h @ p[-2] + p[-1]
    z = np.exp(z - z.max(1, keepdims=True))
    d = z / z.sum(1, keepdims=True)
    value = float(-(weight * np.log(d[np.arange(n_rows), target])).sum() / n_rows)
    d[np.arange(n_rows), target] -= 1
    d *= weight[:, None] / n_rows
    g[-2], g[-1] = h.T @ d, d.sum(0)
    dh = (d @ p[-2].T) * (pre > 0)
    de = np.zeros_like(e)
    for j, w in enumerate(WIDTHS):
        part = dh[:, j * FILTERS : (j + 1) * FILTERS]
        at = args[j]
        seen = np.take_along_axis(cols[j], at[:, :, None], 1)  # [batch, filters, w * embed]
        g[1 + j] = np.einsum("bf,bfc->cf", part, seen).reshape(w, EMBED, FILTERS)
        g[1 + nw + j] = part.sum(0)
        back = part[:, :, None] * p[1 + j].reshape(w * EMBED, FILTERS).T[None]
        for q in range(w):
            np.add.at(de, (np.arange(n_rows)[:, None], at + q), back[:, :, q * EMBED : (q + 1) * EMBED])
    np.add.at(g[0], c, de)
    g[0][_PAD] = 0
    return value, g


def fit(x: np.ndarray, y: np.ndarray, labels: list[str], share: np.ndarray | None = None, epochs: int = 3, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> Network:
    """Adam on loss(), classes weighted to count alike; share: what each window counts for within its class."""
    rng = np.random.Generator(np.random.Philox(seed))
    k = len(labels)
    shapes = [(128, EMBED), *((w, EMBED, FILTERS) for w in WIDTHS), *((FILTERS,) for _ in WIDTHS), (FILTERS * len(WIDTHS), k), (k,)]
    p = [rng.normal(0, 0.5 / np.sqrt(np.prod(s[:-1]) if i and len(s) > 1 else 1), s).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for i, s in enumerate(shapes)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    p[0][_PAD] = 0
    share = np.ones(len(y)) if share is None else share
    weight = (share * len(y) / (k * np.maximum(np.bincount(y, share, k), 1e-9))[y]).astype(np.float32)
    nw, t = len(WIDTHS), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            i = order[a : a + batch]
            _, g = loss(p, x[i].astype(np.intp), y[i], weight[i])
            t += 1
            for q in range(len(p)):
                m[q] += 0.1 * (g[q] - m[q])
                v[q] += 0.001 * (g[q] ** 2 - v[q])
                p[q] -= rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)
    return Network(labels, p[0], p[1 : 1 + nw], p[1 + nw : 1 + 2 * nw], p[-2], p[-1])


def pair_scores(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """[label, pair]: log-probability of the second class after the first, less the label's limit; 0 for pairs that don't count.

    The limit is LIMIT of the way from the mean over all pairs of the label's alphabet (its letters and
    white space), taken as equally frequent, to that over its own windows.
    """
    counted = LETTER[:, None] | LETTER[None]
    counted[[26, _PAD]] = counted[:, [26, _PAD]] = False
    counted = counted.ravel()
    out = np.zeros((k, 128 * 128), np.float32)
    for label in range(k):
        c = PAIRED[x[y == label]]
        n = np.bincount((c[:, :-1].astype(np.intp) * 128 + c[:, 1:]).ravel(), minlength=128 * 128).reshape(128, 128).astype(np.float64)
        n[_PAD] = n[:, _PAD] = 0
        # a class that is hardly or never seen makes no pair probable
        score = np.log((n + SMOOTH) / (np.maximum(n.sum(1, keepdims=True), n.sum() / 128) + SMOOTH * 128)).ravel()
        letters = n.sum(0) * LETTER
        alphabet = np.append(np.flatnonzero(letters > LEAST_SHARE * letters.sum()), 27)
        random = (alphabet[:, None] * 128 + alphabet[None]).ravel()
        if (n.ravel() * counted).sum():
            score -= LIMIT * np.average(score, weights=n.ravel() * counted) + (1 - LIMIT) * score[random][counted[random]].mean()
        out[label] = score * counted
    return out


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Network | None:
    """A network fitted on all windows of the labelled documents that are first by a hash of doc_id, `train_docs` of them at most; a document's windows together count as one. None if none is labelled."""
    named = docs.where("doc_id is not null and trim(lang) <> '' and text <> ''")
    ids = [r[0] for r in named.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).collect()]

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _, ptr = windows(*T.buffers(batch["text"]))
            n = np.diff(ptr)
            of = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(of), batch["lang"].take(of), pa.array(1 / n[of]), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "lang", "share", "x"])

    if not ids:
        return None
    rows = named.select("doc_id", "lang", "text").where(F.col("doc_id").isin(ids)).mapInArrow(tiled, "doc_id long, lang string, share double, x binary").collect()
    rows.sort(key=lambda r: (r[0], r[1], bytes(r[3])))
    labels = sorted({r[1] for r in rows})
    x = np.frombuffer(b"".join(bytes(r[3]) for r in rows), np.uint8).reshape(-1, WINDOW)
    y = np.array([labels.index(r[1]) for r in rows])
    network = fit(x, y, labels, np.array([r[2] for r in rows]))
    network.pairs = pair_scores(x, y, len(labels))
    return network


class Judge:
    """Called with a column of texts, gives the index in `names` and the mean probability of each text's language, and whether its pairs of bytes are that language's."""

    def __init__(self, network: Network | None):
        self.network, self.tables = network, network.tables() if network else None
        self.names = pa.array([*(network.labels if network else []), "und"])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best, top, known = np.full(len(texts), len(self.names) - 1), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for a, _, d, o in T.chunks(*T.buffers(texts)) if self.network else ():
            x, held, ptr = windows(d, o)
            if not len(x):
                continue
            p = self.network.probabilities(x, self.tables) * held[:, None].astype(np.float64)
            some = np.flatnonzero(np.diff(ptr) > 0)
            mean = np.add.reduceat(p, ptr[:-1][some], 0) / np.diff(o)[some, None]
            best[a + some], top[a + some] = mean.argmax(1), mean.max(1)
            known[a + some] = self.known(d, o[np.append(some, len(o) - 1)], mean.argmax(1))
        return best, np.round(np.minimum(top, 1.0), 6), known

    def known(self, data: np.ndarray, offs: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Whether each text, none of them empty, has a positive sum of its language's pair scores. White space stands before its first and after its last byte, so that a text of one letter has pairs."""
        pairs = self.network.pairs
        if pairs is None:
            return np.ones(len(best), bool)
        c = PAIRED[CLASSES][data].astype(np.int32)
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[offs[:-1]] = 27
        base = (best * (128 * 128)).astype(np.int32)
        flat = pairs.ravel()
        score = flat.take(before * 128 + c + np.repeat(base, np.diff(offs)))
        return np.add.reduceat(score, offs[:-1], dtype=np.float64) + flat[base + c[offs[1:] - 1] * 128 + 27] > 0


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, predicted, probability, keep) of every row.

    predicted: the most probable language (of equal ones the first by name); probability: its mean over the text;
    keep: whether the text's pairs of bytes are that language's (Judge.known),
    which texts without a letter, random letters and foreign scripts aren't. Null and empty texts, and all
    texts where no label was there to train on, are 'und' with probability 0, and not kept. Rows that repeat are judged each;
    null ids stay null. Other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value)
        for batch in batches:
            best, top, known = judge(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], judge.names.take(pa.array(best)), pa.array(top), pa.array(known & (best < len(judge.names) - 1))], ["doc_id", "predicted", "probability", "keep"])

    return docs.select("doc_id", "text").mapInArrow(sliced(run, HELD_ROWS), "doc_id long, predicted string, probability double, keep boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that identify() keeps, in one pass: the text of a row is judged beside the row. A null or blank `lang` becomes the language found; others stay."""
    names = docs.columns
    network = train(docs)
    rows, text = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")), names.index("text")
    sent = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value)
        for batch in batches:
            best, _, known = judge(batch["row"].field(text))
            good = pa.array(known & (best < len(judge.names) - 1))
            yield pa.RecordBatch.from_arrays([batch["row"].filter(good), judge.names.take(pa.array(best)).filter(good)], ["row", "predicted"])

    kept = rows.mapInArrow(sliced(run, HELD_ROWS), StructType([StructField("row", docs.schema), StructField("predicted", StringType())]))
    lang = F.coalesce(F.when(F.trim(F.col("row").getField("lang")) != "", F.col("row").getField("lang")), F.col("predicted"))
    return kept.select(*((lang if c == "lang" else F.col("row").getField(c)).alias(c) for c in names))
