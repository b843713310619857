"""Byte-level BPE with a public vocabulary: overlapping chunk encoding, and decoding.

1. A text of up to `chunk` characters is one chunk. A longer one is cut into chunks that overlap by
   `overlap` characters, and its chunks go to tasks of their own.
2. Each chunk is pre-tokenised on its own. The first pieces of a chunk may be wrong, as it begins
   anywhere, and so may those that end within LOOK characters of its end: what follows may be part of them.
3. Neighbours are stitched at the first boundary that both have in their overlap: pre-tokenising looks
   at nothing before a piece's start, so from a common boundary on both agree. A document with an
   overlap in which no boundary meets (such as one word of thousands of letters) is encoded whole.
4. Each chunk encodes its pieces between its two stitches; a document's tokens are put together again.

Decoding concatenates the bytes of the tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.llm.common import cut, in_order, sliced, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK, OVERLAP = 32_768, 1024
#: The characters beyond a piece's end that the pattern may have looked at, and some more.
LOOK = 8
#: Texts of a batch that are held as tokens at once, in bytes.
HELD_BYTES = 1_000_000
#: Chunks of long texts whose pieces are held as Python numbers at once.
HELD_CHUNKS = 16
_TOKENS = "doc_id long, n_tokens long, tokens array<int>, n_bytes long, exact boolean, place long"
_made: dict[bytes, tiktoken.Encoding] = {}


def vocabulary(path: str = VOCABULARY) -> bytes:
    """The file of ranks; the driver reads it and sends it to the executors."""
    with open(path, "rb") as f:
        return f.read()


def encoding(ranks: bytes) -> tiktoken.Encoding:
    """The encoder of such a file; made once in a process."""
    if ranks not in _made:
        pairs = (line.split() for line in ranks.splitlines() if line)
        _made[ranks] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _made[ranks]


def boundaries(text: str) -> list[int]:
    """The end of each piece of a text."""
    return [m.end() for m in regex.finditer(PATTERN, text)]


def _coded(enc: tiktoken.Encoding, ids: pa.Array, texts: pa.Array, places: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of _TOKENS for whole texts."""
    a, n = 0, len(texts)
    while a < n:
        rows, held, b = [], 0, a
        while b < n and held < HELD_BYTES:
            text = texts[b].as_py()
            if text is None:
                rows.append((None, None, None, None))
            else:
                tokens, raw = enc.encode_ordinary(text), text.encode()
                rows.append((len(tokens), tokens, len(raw), enc.decode_bytes(tokens) == raw))
                held += len(raw)
            b += 1
        count, tokens, size, exact = zip(*rows)
        yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(count, pa.int64()), pa.array(tokens, pa.list_(pa.int32())), pa.array(size, pa.int64()), pa.array(exact, pa.bool_()), places.slice(a, b - a)], ["doc_id", "n_tokens", "tokens", "n_bytes", "exact", "place"])
        a = b


def _whole(docs: DataFrame, ranks: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        for batch in batches:
            yield from _coded(enc, batch["doc_id"], batch["text"], batch["place"])

    return docs.select("doc_id", "text", "place").mapInArrow(sliced(run, 1000), _TOKENS)


def _chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, digest, k, lo, piece_ends, chunk): the chunks of long texts, pre-tokenised."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch["text"]):
                text = text.as_py()
                starts = range(0, max(len(text) - overlap, 1), chunk)
                one = pa.array([i] * len(starts))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(one), batch["digest"].take(one), pa.array(range(len(starts)), pa.int32()), pa.array(starts, pa.int64()), pa.array([text[s : s + chunk + overlap] for s in starts])], ["doc_id", "digest", "k", "lo", "chunk"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = pa.array([boundaries(x.as_py()) for x in batch["chunk"]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ends], [*batch.schema.names, "piece_ends"])

    rows = "doc_id long, digest binary, k int, lo long, chunk string"
    return long.mapInArrow(sliced(split, 1), rows).repartition("doc_id", "digest", "k").mapInArrow(sliced(pieces, HELD_CHUNKS), f"{rows}, piece_ends array<int>")


def encode(docs: DataFrame, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, place: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, tokens, n_bytes, exact) of every row.

    tokens are those of the whole text in one go; exact: whether decoding gives the text's bytes again.
    A null text has nulls in all but doc_id, an empty one no tokens. Null ids stay null. Rows that repeat
    come out as often. Strings that look like special tokens are ordinary text. place: a column of numbers that the
    result has as place. Other columns aren't read.
    """
    if not LOOK < overlap <= chunk:
        raise ValueError(f"overlap must be between {LOOK + 1} and chunk")
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    docs = docs.select("doc_id", "text", (F.col(f"`{place}`") if place else F.lit(-1)).cast("long").alias("place"))
    is_long = F.coalesce(F.length("text") > chunk + overlap, F.lit(False))
    # equal rows are one here, and have their number restored: a chunk is known by id, text and place
    long = cut(docs.where(is_long).groupBy("doc_id", F.unhex(F.md5("text")).alias("digest")).agg(F.first("text").alias("text"), F.collect_list("place").alias("places")))
    parts = cut(_chunks(long.select("doc_id", "digest", "text"), chunk, overlap))
    same = Window.partitionBy("doc_id", "digest").orderBy("k")
    tail = F.transform(F.filter("piece_ends", lambda e: (e >= chunk) & (e < chunk + overlap - LOOK)), lambda e: (e - chunk).cast("int"))
    edges = parts.select("doc_id", "digest", "k", F.filter("piece_ends", lambda e: (e > 0) & (e < overlap)).alias("head"), tail.alias("tail"), F.array_max("piece_ends").alias("size"))
    # where this chunk takes over from the one before, in places of the chunk; the one before hands over there
    meets = F.array_min(F.array_intersect("head", F.lag("tail").over(same)))
    edges = edges.withColumn("first", F.when(F.col("k") == 0, 0).otherwise(meets))
    edges = edges.withColumn("last", F.when(F.lead("k").over(same).isNull(), F.col("size")).otherwise(F.lead("first").over(same) + chunk))
    edges = cut(edges.select("doc_id", "digest", "k", "first", "last"))
    lost = edges.where("first is null or last is null").select("doc_id", "digest").distinct()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        known: dict[str, list[int]] = {}
        for batch in batches:
            out, fine = [], []
            for text, ends, first, last in zip(batch["chunk"], batch["piece_ends"].to_pylist(), batch["first"].to_pylist(), batch["last"].to_pylist()):
                text, at, tokens = text.as_py(), first, []
                for e in ends:
                    if first < e <= last:
                        piece = text[at:e]
                        if piece not in known:
                            if len(known) > 200_000:
                                known.clear()
                            known[piece] = enc._core_bpe.encode_single_piece(piece.encode())
                        tokens += known[piece]
                        at = e
                out.append(tokens)
                fine.append((len(raw := text[first:last].encode()), enc.decode_bytes(tokens) == raw))
            size, exact = zip(*fine) if fine else ((), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["digest"], batch["k"], pa.array(out, pa.list_(pa.int32())), pa.array(size, pa.int64()), pa.array(exact, pa.bool_())], ["doc_id", "digest", "k", "tokens", "n_bytes", "exact"])

    met, gone = edges.alias("e"), lost.alias("x")
    # doc_ids are compared null-safely: those of rows without an id meet, too
    held = parts.alias("p").join(met, [F.col("e.digest") == F.col("p.digest"), F.col("e.doc_id").eqNullSafe(F.col("p.doc_id")), F.col("e.k") == F.col("p.k")])
    held = held.select("p.doc_id", "p.digest", "p.k", "chunk", "piece_ends", "first", "last").alias("h")
    held = held.join(gone, [F.col("h.digest") == F.col("x.digest"), F.col("h.doc_id").eqNullSafe(F.col("x.doc_id"))], "left_anti")
    coded = held.mapInArrow(sliced(code, HELD_CHUNKS), "doc_id long, digest binary, k int, tokens array<int>, n_bytes long, exact boolean")
    joined = coded.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("k", "tokens"))).alias("parts"), F.sum("n_bytes").alias("n_bytes"), F.bool_and("exact").alias("exact"))
    joined = joined.select("doc_id", "digest", F.flatten(F.transform("parts", lambda p: p["tokens"])).alias("tokens"), "n_bytes", "exact").alias("j")
    copies = long.select("doc_id", "digest", "places").alias("c")
    times = F.explode("places").alias("place")
    stitched = joined.join(copies, [F.col("j.digest") == F.col("c.digest"), F.col("j.doc_id").eqNullSafe(F.col("c.doc_id"))])
    stitched = stitched.select("j.doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens", "n_bytes", "exact", times)
    rest = long.alias("l").join(gone, [F.col("l.digest") == F.col("x.digest"), F.col("l.doc_id").eqNullSafe(F.col("x.doc_id"))], "left_semi")
    rest = rest.select("doc_id", "text", times)
    out = _whole(docs.where(~is_long), ranks).union(stitched).union(_whole(rest, ranks))
    return out if place else out.drop("place")


def decode(coded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows with doc_id and tokens: the tokens' bytes one after another, as UTF-8, with U+FFFD for what isn't. Null tokens give a null text, none an empty one; a token that the vocabulary lacks is an error that names it. Rows that repeat come out as often; other columns aren't read."""
    ranks = coded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        for batch in batches:
            texts = []
            for t in batch["tokens"].to_pylist():
                bad = [x for x in t or () if x is None or not 0 <= x < enc.n_vocab]
                if bad:
                    raise ValueError(f"no such token: {bad[0]}")
                texts.append(None if t is None else enc.decode_bytes(t).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "tokens").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document, and place: its number in the order in which the stage before, the mix, holds them."""
    return encode(in_order(docs, "doc_id", "text"), place="place")
