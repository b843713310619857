"""Exact deduplication that keeps the first row of equal identity."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.operators.convert import parsed

HASHES: dict[str, Callable[[Column], Column]] = {"md5": F.md5, "sha256": lambda c: F.sha2(c, 256)}


def canonical(raw: Column, keys: Sequence[str] | None = None) -> Column:
    """JSON text with sorted keys at all depths, by Python in Arrow batches, as the JVM would take 1.0 for 1 (identity 'native' does, and costs no Python); of objects only `keys`, absent ones left out. Numbers keep their spelling's type: 1, 1.0 and true differ."""
    chosen = None if keys is None else set(keys)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            value = json.loads(text)
            if chosen is not None and isinstance(value, dict):
                value = {k: x for k, x in value.items() if k in chosen}
            return json.dumps(value, sort_keys=True, ensure_ascii=False).encode("utf-8", "replace").decode()

        return texts.map(one)

    return run(raw)


def keep_first(df: DataFrame, identity: Column, order: str, algorithm: str | Callable[[bytes], str] = "md5") -> DataFrame:
    """The row of least `order` for each identity. Partly aggregated before the shuffle, unlike a window."""
    if callable(algorithm):
        call = algorithm
        h = F.pandas_udf(lambda s: s.map(lambda x: call(x.encode())), "string")(identity)
    elif algorithm in HASHES:
        h = HASHES[algorithm](identity)
    else:
        raise ValueError(f"unknown hash {algorithm!r}; there are {', '.join(sorted(HASHES))}")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), h.alias("h"), F.col(order).alias("o"))
    return rows.groupBy("h").agg(F.min_by("row", "o").alias("row")).select("row.*")


def dedupe_lines(lines: DataFrame, keys: Sequence[str] | None = None, algorithm: str | Callable[[bytes], str] = "md5", identity: str = "exact", order: str = "line_key") -> DataFrame:
    """The first of the JSON lines of equal value. Blank and invalid lines go.

    identity 'native' stays in the JVM but takes 1 for 1.0; `keys` needs 'exact'.
    """
    if identity not in ("exact", "native") or (identity == "native" and keys is not None):
        raise ValueError("identity must be exact or native, and native takes no keys")
    rows = parsed(lines)
    value = canonical(F.col("raw"), keys) if identity == "exact" else F.to_json("v")
    return keep_first(rows.withColumn("_same", value).drop("v"), F.col("_same"), order, algorithm).drop("_same")
