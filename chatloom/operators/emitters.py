"""Emitters: from messages to the columns of an output row; and between one-turn and many-turn records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.functions.exprs import strip
from chatloom.operators.adapters import MESSAGES, instruction_messages


def contents(messages: Column, role: str) -> Column:
    return F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"])


def emit_messages(messages: Column) -> Column:
    return F.struct(messages.cast(MESSAGES).alias("messages"))


def emit_alpaca(messages: Column) -> Column:
    """The users' texts joined as instruction, the assistant's last as output; a plain pair is taken verbatim."""
    pair = (F.size(messages) == 2) & (F.get(messages, F.lit(0))["role"] == "user") & (F.get(messages, F.lit(1))["role"] == "assistant")
    asked = F.array_join(contents(messages, "user"), "\n")
    answer = F.coalesce(F.try_element_at(contents(messages, "assistant"), F.lit(-1)), F.lit(""))
    return F.struct(F.coalesce(F.when(pair, asked).otherwise(strip(asked)), F.lit("")).alias("instruction"), F.lit("").alias("input"), answer.alias("output"))


def single_to_multi(instruction: Column, more: Column, output: Column) -> Column:
    """Messages of one turn; null unless instruction and output hold something. Instruction and input are a blank line apart."""
    full = lambda c: F.coalesce(strip(c) != "", F.lit(False))
    return F.when(full(instruction) & full(output), instruction_messages(instruction, more, output, "\n\n"))


def multi_to_single(messages: Column, joiner: str = "\n") -> Column:
    """(instruction, input, output): the users' texts and the last answer, stripped; null without an assistant."""
    answers = contents(messages, "assistant")
    row = F.struct(strip(F.array_join(contents(messages, "user"), joiner)).alias("instruction"), F.lit("").alias("input"), strip(F.try_element_at(answers, F.lit(-1))).alias("output"))
    return F.when(F.size(answers) > 0, row)


EMITTERS: dict[str, Callable[[Column], Column]] = {"messages": emit_messages, "alpaca": emit_alpaca}


def register_emitter(name: str, make: Callable[[Column], Column]) -> None:
    """A further output format, under a name that none has yet."""
    if name in EMITTERS:
        raise ValueError(f"there is an output format {name!r} already")
    EMITTERS[name] = make


def emitter(name: str) -> Callable[[Column], Column]:
    if name not in EMITTERS:
        raise ValueError(f"unknown output format {name!r}; there are {', '.join(sorted(EMITTERS))}")
    return EMITTERS[name]
