"""The conversion over a stream of text files: the same expressions, stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatloom.operators.adapters import ChatOptions
from chatloom.operators.convert import convert


def convert_stream(spark: SparkSession, path: str, adapter_name: str = "auto", output_format: str = "messages", options: ChatOptions | None = None) -> DataFrame:
    return convert(spark.readStream.text(path), adapter_name, output_format, options)
