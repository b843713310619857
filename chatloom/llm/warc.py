"""WARC records, and fixity audits of replicas by Merkle trees.

Records are laid out in files by ascending page_id; a record's place is its file and byte offset. The
leaves of a file's tree are its records' SHA-256, each node above hashes up to 2 ** FAN_BITS ordered
neighbours, which cover a range of offsets, and the files' roots are in turn the leaves of the
archive's tree. Two replicas are compared from the root downwards: only children of nodes that differ
are looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.llm.common import cut, table

FAN_BITS, FILE_RECORDS = 6, 4096
#: Bytes read at once, of a header at most, and held as rows at once.
PIECE, MOST_HEADER, HELD_BYTES = 1 << 16, 1 << 20, 8_000_000
MAGIC = b"\x1f\x8b\x08"


def record(url: Column, body: Column) -> Column:
    """The bytes of a WARC/1.1 resource record."""
    body = F.coalesce(body.cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n"))


class Fault(Exception):
    """Something that can't be read; what follows it may be."""


def opened(path: str):
    """A file of any file system that pyarrow knows, as a stream of bytes."""
    if path.startswith("file:"):
        return open(unquote(urlparse(path).path), "rb")
    system, name = FileSystem.from_uri(path)
    return system.open_input_stream(name)


def _gzip_header(raw: bytes) -> int | None:
    """The length of a gzip member's header; None if it isn't whole."""
    at = 10
    if len(raw) < 10:
        return None
    if raw[3] & 4:
        if len(raw) < 12:
            return None
        at += 2 + int.from_bytes(raw[10:12], "little")
    for flag in (8, 16):
        if raw[3] & flag:
            end = raw.find(b"\0", at)
            if end < 0:
                return None
            at = end + 1
    at += 2 * bool(raw[3] & 2)
    return at if len(raw) >= at else None


def plain(stream) -> Iterator[bytes | Fault]:
    """The bytes of a stream, of gzip members one by one where it begins with one. After a Fault it goes on at the next member."""
    raw = stream.read(PIECE)
    if raw[:2] != MAGIC[:2]:
        while raw:
            yield raw
            raw = stream.read(PIECE)
        return
    while True:
        while (head := _gzip_header(raw)) is None and (more := stream.read(PIECE)):
            raw += more
        if head is None:
            if raw:
                yield Fault("gzip member cut short")
            return
        d, crc, size, wrong = zlib.decompressobj(-15), 0, 0, None
        raw = raw[head:]
        while not d.eof:
            try:
                out = d.decompress(raw, PIECE)
            except zlib.error as e:
                wrong = f"damaged gzip member: {e}"
                break
            crc, size = zlib.crc32(out, crc), size + len(out)
            if out:
                yield out
            raw = d.unconsumed_tail
            if not d.eof and not raw and not (raw := stream.read(PIECE)):
                wrong = "gzip member cut short"
                break
        if wrong is None:
            raw = d.unused_data
            while len(raw) < 8 and (more := stream.read(PIECE)):
                raw += more
            if raw[:8] != crc.to_bytes(4, "little") + (size & 0xFFFFFFFF).to_bytes(4, "little"):
                wrong = "gzip member with another checksum"
            raw = raw[8:]
        if wrong is not None:
            yield Fault(wrong)
        while (at := raw.find(MAGIC)) < 0 and (more := stream.read(PIECE)):
            raw = raw[-2:] + more
        if at < 0:
            return
        raw = raw[at:]


def records(stream) -> Iterator[tuple]:
    """(offset, length, kind, uri, digest, digest_ok, sha256, body, fault) of a stream's records and faults, in their order."""
    held, base, ended = b"", 0, False
    source = plain(stream)

    def row(size: int, fields: dict[str, str], body: bytes | None, fault: str | None) -> tuple:
        digest = fields.get("warc-block-digest")
        ok = hashlib.sha256(body).hexdigest() == digest[7:].lower() if body is not None and digest and digest.lower().startswith("sha256:") else None
        return base, size, fields.get("warc-type"), fields.get("warc-target-uri"), digest, ok, hashlib.sha256(held[:size]).hexdigest(), body, fault

    while True:
        broken = None
        need = 1
        while True:  # until the record at the front is whole
            lead = len(held) - len(held.lstrip(b"\r\n"))
            held, base = held[lead:], base + lead
            end = held.find(b"\r\n\r\n")
            fields: dict[str, str] = {}
            size = None
            if held and not b"WARC/".startswith(held[:5]):
                need = 0
            elif end >= 0:
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in held[:end].decode("utf-8", "replace").split("\r\n")[1:])}
                value = fields.get("content-length", "")
                size = int(value) if value.isascii() and value.isdigit() else None
                need = 0 if size is None else end + 4 + size
            elif len(held) > MOST_HEADER:
                need = 0
            else:
                need = len(held) + 1
            if len(held) >= need or ended or broken:
                break
            try:
                item = next(source)
            except StopIteration:
                ended = True
                continue
            if isinstance(item, Fault):
                broken = str(item)
            else:
                held += item
        if not held:
            if broken is not None:
                yield row(0, {}, None, broken)
            elif ended:
                return
            continue
        if size is not None and len(held) >= need:
            yield row(need, fields, held[end + 4 : need], None)
            held, base = held[need:], base + need
        else:  # on to what looks like the next record
            fault = "no record" if not b"WARC/".startswith(held[:5]) else "record cut short" if size is not None else "no valid Content-Length" if end >= 0 else "header without an end"
            at = held.find(b"\r\nWARC/", 1)
            while at < 0 and not ended and not broken and need == 0:
                try:
                    item = next(source)
                except StopIteration:
                    ended = True
                    break
                if isinstance(item, Fault):
                    broken = str(item)
                else:
                    held += item
                    at = held.find(b"\r\nWARC/", 1)
            at = len(held) if at < 0 else at + 2
            body = held[end + 4 : at] if size is not None else None
            yield row(at, fields, body, fault)
            held, base = held[at:], base + at
        if broken is not None:
            yield row(0, {}, None, broken)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, kind, uri, digest, digest_ok, sha256, body, fault) of the records of .warc and .warc.gz files.

    Files are read as streams, a record at a time, and members of a .gz file one by one. offset and length are
    those of the plain bytes; sha256 is the whole record's. digest_ok is null where a record has no sha256 block
    digest. fault is null for a whole record. Bytes that aren't a record, a record without a valid
    Content-Length or cut short, and a gzip member that is damaged, cut short or has another checksum give a row
    of their own with the fault, and reading goes on at the next record or member. An empty file has no rows. Bodies may be
    empty or long; records that repeat are rows each.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["offset", "length", "kind", "uri", "digest", "digest_ok", "sha256", "body", "fault"]
        for pdf in parts:
            for name in pdf["path"]:
                with opened(name) as stream:
                    rows, held = [], 0
                    for r in records(stream):
                        rows.append(r)
                        held += 500 + len(r[7] or b"")
                        if held > HELD_BYTES:
                            yield pd.DataFrame(rows, columns=names).assign(file=name)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names).assign(file=name)

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(run, "file string, offset long, length long, kind string, uri string, digest string, digest_ok boolean, sha256 string, body binary, fault string")


def archive_audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, slot) of the records that differ between two archives as read_warc() gives them, or that only one has; name: the file's, without folders; slot: the record's number in it. Faults differ from whole records."""

    def named(df: DataFrame) -> DataFrame:
        rows = df.select(F.element_at(F.split("file", "/"), -1).alias("name"), "offset", "length", F.sha2(F.concat_ws(":", "sha256", "fault"), 256).alias("digest"))
        return rows.withColumn("slot", F.row_number().over(Window.partitionBy("name").orderBy("offset", "length", "digest")).cast("long") - 1)

    both = [cut(named(df)) for df in (left, right)]
    # as many rows as there are files
    names = both[0].select("name").union(both[1].select("name")).distinct()
    number = cut(names.select("name", (F.row_number().over(Window.orderBy("name")).cast("long") - 1).alias("file")))
    bad = audit(*(cut(df.join(number, "name").select("file", "slot", "digest")) for df in both))
    return bad.join(number, "file").select("name", "slot")


def place(pages: DataFrame, body: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, slot, page_id, offset, length, digest): every record's place in the archive, without its bytes.

    file: page_id divided by file_records (null ids are in file -1); slot: the record's number within
    it, by page_id, then url and digest, so that rows that repeat have slots of their own.
    """
    rows = pages.select("page_id", F.col("url").alias("url"), record(F.col("url"), F.col(body)).alias("bytes"))
    rows = rows.select("page_id", "url", F.coalesce(F.floor(F.col("page_id") / file_records), F.lit(-1)).cast("long").alias("file"), F.length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("digest"))
    order = Window.partitionBy("file").orderBy("page_id", "url", "digest")
    rows = rows.withColumn("slot", F.row_number().over(order).cast("long") - 1)
    return rows.select("file", "slot", "page_id", (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "digest")


def levels(leaves: DataFrame, low: int, inner: int, outer: int) -> list[DataFrame]:
    """(f, node, digest) of an archive's tree, records first and the root last.

    f: the file's number from `low`. `inner` levels join neighbours within a file, `outer` ones
    neighbouring files. A node's digest covers its children's places as well as their digests.
    """
    out = [leaves.select((F.col("file") - low).alias("f"), F.col("slot").alias("node"), "digest")]
    for depth in range(1, inner + outer + 1):
        key = _above(depth, inner)
        inside = F.transform(F.array_sort(F.collect_list(F.struct("f", "node", "digest"))), lambda x: F.concat_ws(":", x["f"].cast("string"), x["node"].cast("string"), x["digest"]))
        out.append(cut(out[-1].groupBy(*(k.alias(n) for n, k in key.items())).agg(F.sha2(F.array_join(inside, ","), 256).alias("digest"))))
    return out


def _above(depth: int, inner: int) -> dict[str, Column]:
    """The place at level `depth` of the parent of a node at the level beneath."""
    within = depth <= inner
    return {"f": F.col("f") if within else F.shiftright("f", FAN_BITS), "node": F.shiftright("node", FAN_BITS) if within else F.col("node")}


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, slot) of the records that differ between two replicas, or that only one has; from place() of each.

    Both trees are as high as the larger replica needs, so roots meet roots. Equal roots end the audit
    at once; else only the children of nodes that differ are compared, level by level. Each of the
    inputs is read several times and should be stored. Two empty replicas have no differences.
    """
    low, high, slots = left.select("file", "slot").union(right.select("file", "slot")).agg(F.min("file"), F.max("file"), F.max("slot")).first()
    if low is None:
        return left.select("file", "slot").limit(0)
    inner, outer = (-(-int(x).bit_length() // FAN_BITS) for x in (slots, high - low))
    a, b = levels(left, low, inner, outer), levels(right, low, inner, outer)
    suspects = None
    for depth in range(inner + outer, -1, -1):
        x, y = (side[depth] for side in (a, b))
        if suspects is not None:
            up = _above(depth + 1, inner)
            above = suspects.select(F.col("f").alias("up_f"), F.col("node").alias("up_node"))
            x, y = (s.join(above, (up["f"] == F.col("up_f")) & (up["node"] == F.col("up_node")), "left_semi") for s in (x, y))
        both = x.withColumnRenamed("digest", "x").join(y.withColumnRenamed("digest", "y"), ["f", "node"], "full")
        suspects = cut(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("f", "node"))
        if not suspects.head(1):
            break
    return suspects.select((F.col("f") + low).alias("file"), F.col("node").alias("slot"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages with a known fault: about one page in 512, by the digest of its page_id, ends in another character."""
    hit = F.md5(F.col("page_id").cast("string")).substr(1, 3).isin("0a7", "9c2", "b51", "e08", "4d3", "617", "2fe", "d9b")
    last = F.when(F.col("html").endswith("x"), "y").otherwise("x")
    html = F.when(hit & (F.col("html") != ""), F.concat(F.expr("left(html, length(html) - 1)"), last)).otherwise(F.col("html"))
    return pages.select("page_id", "url", html.alias("html"))


def fixity(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, file, slot, offset, length, digest, intact) of every record of pages; intact: whether the replica has the same bytes in its place.

    A null url or html counts as empty. Rows that repeat have a slot each. Pages of any length are hashed whole. Columns other than page_id,
    url and html aren't read. Two empty tables give no rows.
    """
    mine, other = cut(place(pages)), cut(place(replica))
    bad = audit(mine, other).withColumn("bad", F.lit(True))
    return mine.join(bad, ["file", "slot"], "left").select("page_id", "file", "slot", "offset", "length", "digest", F.col("bad").isNull().alias("intact"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return fixity(pages, damaged(pages))


_RECORD = """'WARC/1.1' || n || 'WARC-Type: resource' || n || 'WARC-Target-URI: ' || coalesce(url, '') || n || 'WARC-Block-Digest: sha256:' || sha256(b) || n
  || 'Content-Type: text/html' || n || 'Content-Length: ' || strlen(b) || n || n || b || n || n"""

SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, chr(13) || chr(10) AS n FROM pages),
d AS (SELECT *, CASE WHEN html <> '' AND substr(md5(CAST(page_id AS VARCHAR)), 1, 3) IN ('0a7', '9c2', 'b51', 'e08', '4d3', '617', '2fe', 'd9b')
  THEN left(html, length(html) - 1) || CASE WHEN html LIKE '%x' THEN 'y' ELSE 'x' END ELSE html END AS other FROM p),
r AS (SELECT page_id, url, {_RECORD.replace("sha256(b)", "sha256(html)").replace("strlen(b)", "strlen(html)").replace("|| b ||", "|| html ||")} AS one,
  {_RECORD.replace("sha256(b)", "sha256(other)").replace("strlen(b)", "strlen(other)").replace("|| b ||", "|| other ||")} AS two FROM d),
s AS (SELECT page_id, url, CAST(coalesce(floor(page_id / {FILE_RECORDS}), -1) AS BIGINT) AS file, sha256(one) AS digest, CAST(strlen(one) AS BIGINT) AS length, one = two AS intact FROM r)
SELECT page_id, file, row_number() OVER w - 1 AS slot, CAST(sum(length) OVER w - length AS BIGINT) AS "offset", length, digest, intact
FROM s WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST, url NULLS FIRST, digest ROWS UNBOUNDED PRECEDING)
"""
