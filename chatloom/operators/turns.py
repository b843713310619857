"""Turn counts: an answer is a message whose role is exactly `assistant`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.exprs import at, barrier, fields, items, string_at
from chatloom.operators.convert import parsed


def count_turns(m: Column) -> Column:
    """Answers of a record with `messages`; 0 where it has none."""
    answers = F.filter(F.transform(items(at(m, "messages")), fields), lambda x: F.coalesce(string_at(x, "role") == "assistant", F.lit(False)))
    return F.coalesce(F.size(answers), F.lit(0))


def with_turns(lines: DataFrame) -> DataFrame:
    """(raw, n_turns) of the JSON objects among lines, and line_key where lines have one; invalid JSON is an error."""
    key = [c for c in lines.columns if c == "line_key"]
    rows = parsed(lines, strict=True).select(*key, "raw", fields(F.col("v")).alias("m"), barrier()).where("m is not null and _at >= 0")
    return rows.select(*key, "raw", count_turns(F.col("m")).alias("n_turns"))


def distribution(rows: DataFrame) -> DataFrame:
    """(n_turns, n) of rows with n_turns, ascending."""
    return rows.groupBy("n_turns").agg(F.count(F.lit(1)).alias("n")).orderBy("n_turns")


def report(rows: DataFrame) -> DataFrame:
    """One row: total, single (one answer) and multi (any other number, 0 too)."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_turns") == 1).alias("single"), F.count_if(F.col("n_turns") != 1).alias("multi"))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("n_turns = 1"), rows.where("n_turns <> 1")
