"""Scan, adapt, emit: one chain of expressions without a shuffle, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.exprs import barrier, configure, fields, parse, strip, valid, value
from chatloom.operators.adapters import ChatOptions, adapter
from chatloom.operators.emitters import emitter


def parsed(lines: DataFrame, strict: bool = False) -> DataFrame:
    """lines with raw (the stripped value) and v of the rows that aren't blank, each parsed once. Invalid JSON is left out, or an error if strict."""
    configure(lines.sparkSession)
    some = lines.withColumn("raw", strip(F.col("value"))).where("raw <> ''")
    some = some.select("*", parse(F.col("raw")).alias("_parsed"), barrier())
    good = valid(F.col("_parsed"), F.col("raw"))
    if strict:
        good = F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("invalid JSON: "), F.substring("raw", 1, 80))).cast("boolean"))
    return some.where(good & (F.col("_at") >= 0)).withColumn("v", value(F.col("_parsed"))).drop("_parsed", "_at")


def convert(lines: DataFrame, adapter_name: str = "auto", output_format: str = "messages", options: ChatOptions | None = None, strict: bool = False) -> DataFrame:
    """The emitted columns, meta_source and meta_branch, of the examples in lines (a column `value` of JSON texts), and line_key where lines have one."""
    take, emit = adapter(adapter_name, options), emitter(output_format)
    key = [c for c in lines.columns if c == "line_key"]
    rows = parsed(lines, strict).select(*key, fields(F.col("v")).alias("m"), barrier()).where("m is not null and _at >= 0")
    made = rows.select(*key, take(F.col("m")).alias("all"), barrier()).where("_at >= 0")
    found = made.select(*key, F.explode("all").alias("x"))
    return found.select(*key, emit(F.col("x.messages")).alias("row"), F.col("x.source").alias("meta_source"), F.col("x.branch").alias("meta_branch")).select(*key, "row.*", "meta_source", "meta_branch")
