"""Key frequencies and uniformity of JSON objects."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.exprs import barrier, fields
from chatloom.operators.convert import parsed


def limited(rows: DataFrame, max_rows: int | None, order: str = "line_key") -> DataFrame:
    """The first max_rows rows in the order of a column; all for None."""
    return rows if max_rows is None else rows.orderBy(order).limit(max_rows)


def records(lines: DataFrame, max_rows: int | None = None, order: str = "line_key") -> DataFrame:
    """lines with raw, v and m (the fields) of the JSON objects, the first max_rows of them. Invalid JSON is an error."""
    rows = parsed(lines, strict=True).select("*", fields(F.col("v")).alias("m"), barrier()).where("m is not null and _at >= 0").drop("_at")
    return limited(rows, max_rows, order)


def key_frequency(lines: DataFrame, recursive: bool = False, max_rows: int | None = None, order: str = "line_key") -> DataFrame:
    """(key, n): objects that have a key at the top, or occurrences of a key at any depth. Invalid JSON is an error; max_rows objects at most, in the order of a column."""
    rows = records(lines, max_rows, order)
    if not recursive:
        return rows.select(F.explode(F.map_keys("m")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter[str] = Counter()
        for part in parts:
            for text in part["raw"]:
                todo = [json.loads(text)]
                while todo:
                    x = todo.pop()
                    if isinstance(x, dict):
                        tally.update(x.keys())
                        todo += x.values()
                    elif isinstance(x, list):
                        todo += x
        yield pd.DataFrame({"key": list(tally), "n": list(tally.values())}).astype({"n": "int64"})

    return rows.select("raw").mapInPandas(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def uniform_schema(lines: DataFrame, max_rows: int | None = None, order: str = "line_key") -> DataFrame:
    """One row (uniform): whether there are rows, all objects, of one set of keys, among the first max_rows values. Invalid JSON is an error."""
    rows = limited(parsed(lines, strict=True), max_rows, order).select(F.to_json(F.array_sort(F.map_keys(fields(F.col("v"))))).alias("keys"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count("keys").alias("objects"), F.min("keys").alias("lo"), F.max("keys").alias("hi"))
    return seen.select(((F.col("n") > 0) & (F.col("objects") == F.col("n")) & F.col("lo").eqNullSafe(F.col("hi"))).alias("uniform"))
