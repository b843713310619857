"""Text scans, shape detection and normalisation to JSON lines; sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.exprs import is_json, strip

PEEK = 65_536


def scan(spark: SparkSession, paths: str | list[str], encoding: str = "utf-8") -> DataFrame:
    """(value, path, line_key) of all physical lines, blank ones too; line_key ascends in the order of files and lines."""
    name = encoding.lower().replace("_", "-")
    if name in ("utf-8", "utf8"):
        lines = spark.read.text(paths)
    else:  # a file of another encoding is one split
        whole = spark.read.format("binaryFile").load(paths).select(F.decode("content", name).alias("text"), F.col("path").alias("file"), F.lit(0).alias("block"))
        lines = whole.select("file", "block", F.posexplode(F.split(F.regexp_replace("text", "(\r\n|\n|\r)$", ""), "\r\n|\n|\r"))).select(F.col("col").alias("value"), F.col("file").alias("path"), F.col("block").cast("long").alias("block"), F.col("pos").cast("long").alias("n"))
        return lines.select("value", "path", F.struct("path", "block", "n").alias("line_key"))
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return lines.select("value", "path", F.struct("path", "block", "n").alias("line_key"))


def line_number(spark: SparkSession, path: str, line_key: Row) -> int:
    """The number from 1 of a line of a file."""
    return scan(spark, path).where(F.col("line_key") < as_key(line_key)).count() + 1


def as_key(line_key: Row) -> Column:
    return F.struct(F.lit(line_key["path"]).alias("path"), F.lit(line_key["block"]).cast("long").alias("block"), F.lit(line_key["n"]).cast("long").alias("n"))


def detect_shape(data: bytes) -> str:
    """jsonl, single_line, json_array, invalid or empty, by the first 64 KiB of a file."""
    text = data[:PEEK].decode("utf-8", "replace")
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        return "empty"
    if len(lines) > 1:
        return "jsonl"
    try:
        value = json.loads(lines[0].strip())
    except ValueError:
        return "single_line" if "}{" in lines[0] else "invalid"
    return "json_array" if isinstance(value, list) else "single_line" if isinstance(value, dict) else "invalid"


def split_values(text: str) -> list[str]:
    """The JSON values that follow one another in a text; a list's items each."""
    text, at, out = text.strip().lstrip("\ufeff").strip(), 0, []
    while at < len(text):
        value, at = json.JSONDecoder().raw_decode(text, at)
        while at < len(text) and text[at].isspace():
            at += 1
        out += value if isinstance(value, list) and not out and at >= len(text) else [value]
    return [json.dumps(x, ensure_ascii=False) for x in out]


def strict_lines(lines: DataFrame) -> DataFrame:
    """Stripped lines that aren't blank, without a byte order mark in front; one that ends in a comma or isn't JSON is an error that names the file and the line's place."""
    raw = F.col("raw")
    place = F.concat(F.col("path"), F.lit(", block at byte "), F.col("line_key.block").cast("string"), F.lit(", line "), (F.col("line_key.n") % (1 << 33) + 1).cast("string"), F.lit(": "), F.substring("raw", 1, 80))
    checked = F.when(raw.endswith(","), F.raise_error(F.concat(F.lit("Cannot normalize: trailing comma: "), place))).when(~is_json(raw), F.raise_error(F.concat(F.lit("Cannot normalize: invalid JSON: "), place))).otherwise(raw)
    return lines.withColumn("raw", strip(F.ltrim(strip(F.col("value")), F.lit("\ufeff")))).where("raw <> ''").withColumn("raw", checked)


def json_rows(df: DataFrame) -> DataFrame:
    """(value): each row as JSON text. Nulls stay, decimals and timestamps are text, times with their microseconds."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("timestamp", "timestamp_ntz"):
            c = F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.000000$", "")
        elif kind.startswith("decimal"):
            c = c.cast("string")
        cols.append(c.alias(name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(df: DataFrame, path: str, column: str = "value", mode: str = "errorifexists") -> None:
    """One text column as lines."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)
