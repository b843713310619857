"""Files and folders: listing, opening, one-file sinks, and the drivers that turn files into files with counts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.exprs import is_json, strip
from chatloom.operators import mix as mixing
from chatloom.operators import turns
from chatloom.operators.adapters import ChatOptions
from chatloom.operators.convert import convert, parsed
from chatloom.operators.dedup import dedupe_lines
from chatloom.operators.profile import limited, records
from chatloom.sources.jsonl import PEEK, as_key, detect_shape, json_rows, line_number, scan, split_values, strict_lines

SUFFIXES = (".parquet", ".json", ".jsonl")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def listed(spark: SparkSession, folder: str, suffixes: Sequence[str] = SUFFIXES) -> list[str]:
    """The files under a folder, at any depth, that end in one of suffixes in any case; sorted, relative to it."""
    fs, p = _fs(spark, folder)
    root, found, files = fs.getFileStatus(p).getPath().toString().rstrip("/"), [], fs.listFiles(p, True)
    while files.hasNext():
        name = files.next().getPath().toString()
        if PurePosixPath(name).suffix.lower() in suffixes:
            found.append(name[len(root) + 1 :])
    return sorted(found)


def peek(spark: SparkSession, path: str, size: int = PEEK) -> bytes:
    """The first bytes of a file."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, fs.getFileStatus(p).getLen())))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written by the driver; its folder is made."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def write_rows(df: DataFrame, path: str, column: str = "value", single: bool | None = None) -> None:
    """A text column as lines in a folder of parts, or in one file: where `single` says so, or else where path has a suffix. What is there is replaced."""
    spark = df.sparkSession
    rows = df.select(F.col(column).alias("value"))
    fs, p = _fs(spark, path)
    if not (bool(PurePosixPath(path).suffix) if single is None else single):
        rows.write.mode("overwrite").text(path)
        return
    made = f"{path}.parts-{uuid.uuid4().hex}"
    rows.coalesce(1).write.text(made)
    _, folder = _fs(spark, made)
    part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    fs.delete(p, True)
    fs.rename(part, p)
    fs.delete(folder, True)


def load(spark: SparkSession, path: str, encoding: str = "utf-8", max_rows: int | None = None) -> DataFrame:
    """(value, path, line_key) of the lines of a file or folder. Other encodings than UTF-8 are decoded by the text reader."""
    return limited(scan(spark, path, encoding), max_rows)


def load_objects(spark: SparkSession, path: str, max_rows: int | None = None, log: Callable[[str], None] = print) -> DataFrame:
    """(raw, line_key) of the JSON objects of a file's lines, max_rows of them at most. With one invalid line (before the last of those), its place is logged and there is no row."""
    lines = scan(spark, path).withColumn("raw", strip(F.col("value"))).where("raw <> ''")
    bad = lines.where(~is_json(F.col("raw"))).orderBy("line_key").select("line_key", "path").first()
    good = limited(parsed(lines).where("schema_of_variant(v) like 'OBJECT%'").select("raw", "line_key"), max_rows)
    if bad is not None and (max_rows is None or good.where(F.col("line_key") < as_key(bad["line_key"])).count() < max_rows):
        log(f"invalid JSON in {bad['path']}, line {line_number(lines.sparkSession, bad['path'], bad['line_key'])}")
        return good.limit(0)
    return good


def iter_objects(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """(raw, line_key) of the JSON objects of a .jsonl file, or of a .json file: the items of a list, or the one object.

    Invalid JSON is an error. max_rows: of .jsonl objects at most so many, one at least; of a list's
    items the first so many, whatever they are. A .json file that isn't one JSON value is read as lines.
    """
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".jsonl":
        return records(scan(spark, path), None if max_rows is None else max(1, max_rows)).select("raw", "line_key")
    if suffix != ".json":
        raise ValueError(f"neither .json nor .jsonl: {path}")
    whole = spark.read.text(path, wholetext=True).select(strip(F.col("value")).alias("value"))
    if not whole.select(is_json(F.ltrim("value", F.lit("﻿")))).first()[0]:
        return records(scan(spark, path), max_rows).select("raw", "line_key")
    is_list = whole.select(F.ltrim("value", F.lit("﻿")).startswith("[")).first()[0]
    items = ["posexplode(try_variant_get(parse_json(value), '$', 'array<variant>')) as (line_key, v)"] if is_list else ["0 as line_key", "parse_json(value) as v"]
    rows = whole.select(F.ltrim("value", F.lit("﻿")).alias("value")).selectExpr(*items)
    rows = rows if max_rows is None or not is_list else rows.where(F.col("line_key") < max_rows)
    return rows.where("schema_of_variant(v) like 'OBJECT%'").select(F.to_json("v").alias("raw"), "line_key")


@dataclass(frozen=True)
class Converted:
    lines_read: int
    lines_written: int


def convert_file(spark: SparkSession, src: str, dst: str, adapter: str = "auto", output_format: str = "messages", options: ChatOptions | None = None, encoding: str = "utf-8", single: bool | None = None) -> Converted:
    """Lines to examples. lines_read counts all physical lines, blank and invalid ones too. One pass, in the order of the lines."""
    read, written = Observation(), Observation()
    lines = load(spark, src, encoding).observe(read, F.count(F.lit(1)).alias("n"))
    rows = convert(lines, adapter, output_format, options)
    body = [c for c in rows.columns if c not in ("line_key", "meta_source", "meta_branch")]
    out = rows.select(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("value")).observe(written, F.count(F.lit(1)).alias("n"))
    write_rows(out, dst, single=single)
    return Converted(read.get["n"], written.get["n"])


@dataclass(frozen=True)
class Deduped:
    total: int
    kept: int

    @property
    def removed(self) -> int:
        return self.total - self.kept


def dedupe_file(spark: SparkSession, src: str | list[str], dst: str, keys: Sequence[str] | None = None, algorithm: str | Callable[[bytes], str] = "md5", single: bool | None = None) -> Deduped:
    """The first of equal lines, as they are and in their order; src may be several files. total counts lines that aren't blank, invalid ones too."""
    read, written = Observation(), Observation()
    lines = scan(spark, src).where(strip(F.col("value")) != "").observe(read, F.count(F.lit(1)).alias("n"))
    out = dedupe_lines(lines, keys, algorithm).orderBy("line_key").observe(written, F.count(F.lit(1)).alias("n"))
    write_rows(out, dst, "raw", single)
    return Deduped(read.get["n"], written.get["n"])


def turn_report(spark: SparkSession, src: str) -> dict:
    """total, single, multi and the distribution by number of answers."""
    hist = {r["n_turns"]: r["n"] for r in turns.distribution(turns.with_turns(scan(spark, src))).collect()}
    return {"total": sum(hist.values()), "single": hist.get(1, 0), "multi": sum(n for k, n in hist.items() if k != 1), "distribution": dict(sorted(hist.items()))}


def split_file(spark: SparkSession, src: str, single_out: str, multi_out: str, single: bool | None = None) -> tuple[int, int]:
    """Lines with one answer and all others, as they are; both outputs are written, and their counts given."""
    counts = []
    for part, dst in zip(turns.split(turns.with_turns(scan(spark, src))), (single_out, multi_out)):
        seen = Observation()
        write_rows(part.observe(seen, F.count(F.lit(1)).alias("n")), dst, "raw", single)
        counts.append(seen.get["n"])
    return counts[0], counts[1]


def normalize_file(spark: SparkSession, src: str, dst: str, single: bool | None = None) -> int:
    """One file of any shape, or Parquet, as JSON lines; the number of records."""
    seen = Observation()
    rows = json_rows(spark.read.parquet(src)) if PurePosixPath(src).suffix.lower() == ".parquet" else normalized(spark, src)
    write_rows(rows.observe(seen, F.count(F.lit(1)).alias("n")), dst, single=single)
    return seen.get["n"]


def normalized(spark: SparkSession, path: str) -> DataFrame:
    """(value): the JSON values of a file by its shape. Lines are scanned in splits; only a file that is one document is read whole.

    The shape is that of the first 64 KiB. A document that is cut there, or lies on several lines, is still one.
    A file of lines that ends one in a comma, or holds no JSON, is an error that names it.
    """
    data = peek(spark, path)
    shape = detect_shape(data)
    text = data.decode("utf-8", "replace").lstrip("﻿").strip()
    if shape == "empty":
        return spark.createDataFrame([], "value string")
    if shape == "jsonl" and not (text[:1] in "[{" and not _whole(text.splitlines()[0])):
        return strict_lines(scan(spark, path)).select(F.col("raw").alias("value"))
    if shape == "invalid" and not (len(data) >= PEEK and text[:1] in "[{"):
        raise ValueError(f"cannot normalize {path}: neither JSON lines, a list nor objects")
    rows = split_documents(spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), "value"))
    return rows.orderBy("pos").select("value")


def _whole(line: str) -> bool:
    try:
        json.loads(line.strip().rstrip(","))
    except ValueError:
        return False
    return True


def split_documents(files: DataFrame) -> DataFrame:
    """(path, pos, value) of whole texts (path, value): a list's items, or the values that follow one another.

    Texts go to Python by the hundred, as rows: a batch of Arrow would hold 10,000 of them, of any length, at once.
    """

    @F.udf("array<string>", useArrow=False)
    def values(path, text):
        try:
            out = split_values(text)
            for x in out:
                x.encode()  # half a surrogate pair is an error, as when it is written
        except ValueError as e:
            raise ValueError(f"cannot normalize {path}: {e}") from None
        return out

    rows = files.select("path", F.posexplode(values("path", F.validate_utf8("value"))).alias("pos", "value"))
    return rows.select("path", F.col("pos").cast("long").alias("pos"), "value")


@dataclass(frozen=True)
class Normalized:
    files: int
    records: int
    failed: tuple[tuple[str, str], ...]


def normalize_folder(spark: SparkSession, src: str, dst: str, log: Callable[[str], None] = print) -> Normalized:
    """All .parquet, .json and .jsonl files under src as .jsonl files of the same relative paths under dst. A file that fails is logged and left out."""
    files, total, failed = 0, 0, []
    for name in listed(spark, src):
        to = f"{dst.rstrip('/')}/{PurePosixPath(name).with_suffix('.jsonl')}"
        try:
            n = normalize_file(spark, f"{src.rstrip('/')}/{name}", to, single=True)
        except Exception as e:  # noqa: BLE001
            failed.append((name, f"{type(e).__name__}: {e}".split("\n")[0]))
            log(f"[fail] {name}: {failed[-1][1]}")
            continue
        files, total = files + 1, total + n
        log(f"[ok] {name} -> {to} ({n} records)")
    return Normalized(files, total, tuple(failed))


@dataclass(frozen=True)
class Mixed:
    total_written: int
    seed: int
    output: str
    sources: tuple[mixing.SourceStats, ...]


def load_sources(spark: SparkSession, paths: Sequence[str], encoding: str = "utf-8") -> DataFrame:
    """(source, key, value): the valid JSON lines of each path, stripped but as they are, objects or not. A path that isn't there is an error."""
    for p in paths:
        if not exists(spark, p):
            raise FileNotFoundError(p)
    rows = [parsed(load(spark, p, encoding)).select(F.lit(str(i)).alias("source"), F.concat_ws(":", "line_key.path", F.col("line_key.block").cast("string"), F.col("line_key.n").cast("string")).alias("key"), F.col("raw").alias("value")) for i, p in enumerate(paths)]
    return reduce(DataFrame.union, rows)


def mix_files(spark: SparkSession, sources: Sequence[tuple[str, float]], dst: str, total: int | None = None, seed: int = 42, oversample: bool = False, encoding: str = "utf-8", single: bool | None = None) -> Mixed:
    """Lines of several files by weight, in a seeded order; a path may come twice. The counts are exact."""
    if not sources:
        raise ValueError("at least one source is needed")
    weights = {str(i): w for i, (_, w) in enumerate(sources)}
    rows, stats = mixing.mix(load_sources(spark, [p for p, _ in sources], encoding), weights, "source", "key", total, seed, oversample)
    write_rows(rows.orderBy(mixing.shuffle_key(seed, "source", "key")), dst, single=single)
    named = tuple(mixing.SourceStats(sources[int(s.source)][0], s.weight, s.requested, s.available, s.written) for s in stats)
    return Mixed(sum(s.written for s in named), seed, dst, named)


def write_recipe(spark: SparkSession, mixed: Mixed) -> str:
    """<output>.mix.json beside the output: how it was mixed, and when."""
    to = str(PurePosixPath(mixed.output).with_suffix(".mix.json"))
    told = [{"path": s.source, "weight": s.weight, "requested": s.requested, "available": s.available, "written": s.written} for s in mixed.sources]
    recipe = {"version": 1, "seed": mixed.seed, "total_written": mixed.total_written, "output": mixed.output, "sources": told, "created_at": datetime.now(UTC).isoformat()}
    write_text(spark, to, json.dumps(recipe, ensure_ascii=False, indent=2))
    return to

