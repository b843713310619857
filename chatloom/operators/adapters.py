"""Adapters: from a record to an array of examples.

An adapter is a function of a column, the fields of a record as map<string, variant>, that gives
array<struct<messages, source, branch>>, empty where a record holds nothing; convert() explodes it. All are
plain expressions in one stage.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from dataclasses import field as field_
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.functions.exprs import at, fields, first_string, has_key, items, mapped, string_at, strip

MESSAGES = "array<struct<role: string, content: string>>"
EXAMPLES = f"array<struct<messages: {MESSAGES}, source: string, branch: string>>"
LIST_ROLES = {"human": "user", "gpt": "assistant", "bing": "assistant"}
CHAT_ROLES = LIST_ROLES | {"bot": "assistant"}
MODES = ("winner", "both", "a", "b")

Adapter = Callable[[Column], Column]


@dataclass(frozen=True)
class ChatOptions:
    """Which keys the chat adapter looks for, in order, and how it takes pairwise records."""

    conversation_keys: tuple[str, ...] = ("messages", "conversation", "conversations")
    role_keys: tuple[str, ...] = ("role", "from")
    content_keys: tuple[str, ...] = ("content", "value", "text")
    instruction_keys: tuple[str, ...] = ("instruction", "question", "prompt")
    output_keys: tuple[str, ...] = ("output", "response", "answer")
    input_keys: tuple[str, ...] = ("input", "context")
    role_map: Mapping[str, str] = field_(default_factory=dict)
    pairwise_mode: str = "winner"

    def __post_init__(self) -> None:
        if self.pairwise_mode not in MODES:
            raise ValueError(f"pairwise_mode must be one of {', '.join(MODES)}")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def examples(messages: Column, source: str, branch: str | None = None) -> Column:
    """One example, or none where there is no message."""
    one = F.array(F.struct(messages.cast(MESSAGES).alias("messages"), F.lit(source).alias("source"), F.lit(branch).cast("string").alias("branch"))).cast(EXAMPLES)
    return F.when(F.size(messages) > 0, one).otherwise(F.array().cast(EXAMPLES))


def instruction_messages(instruction: Column, more: Column, output: Column, joiner: str = "\n") -> Column:
    """A user message of the stripped instruction and input, and the assistant's; blank ones are left out."""
    plain = lambda c: strip(F.coalesce(c, F.lit("")))
    lines = F.filter(F.array(plain(instruction), plain(more)), lambda x: x != "")
    both = F.array(message("user", F.array_join(lines, joiner)), message("assistant", plain(output)))
    return F.filter(both, lambda m: m["content"] != "")


def alpaca(m: Column) -> Column:
    output = F.coalesce(first_string(m, ["output"]), string_at(m, "response"))
    return examples(instruction_messages(string_at(m, "instruction"), string_at(m, "input"), output), "alpaca")


def turn_pairs(turns: Column) -> Column:
    """The user turns followed at once by an assistant turn; turns: array<struct<role, content>>, null where an item is no object.

    As the turn after a match is an assistant's, no match can begin there, so adjacency is all that counts.
    """
    user = lambda i: F.coalesce(F.get(turns, i)["role"] == "user", F.lit(False)) & F.coalesce(F.get(turns, i + 1)["role"] == "assistant", F.lit(False))
    steps = F.when(F.size(turns) >= 2, F.sequence(F.lit(0), F.size(turns) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(steps, user), lambda i: F.array(F.get(turns, i), F.get(turns, i + 1)).cast(MESSAGES))


def objects(v: Column) -> Column:
    """The items of a list as maps, null where an item is no object."""
    return F.transform(items(v), fields)


def sharegpt(m: Column) -> Column:
    def turn(x: Column) -> Column:
        role = mapped(F.lower(strip(F.coalesce(string_at(x, "from"), F.lit("")))), LIST_ROLES)
        return F.when(x.isNotNull(), F.struct(role.alias("role"), strip(F.coalesce(string_at(x, "value"), F.lit(""))).alias("content")))

    # in steps, each a variable of the next, so that none is evaluated for every use
    pairs = F.flatten(F.transform(F.array(F.transform(objects(at(m, "conversations")), turn)), lambda turns: F.coalesce(turn_pairs(turns), F.array().cast(f"array<{MESSAGES}>"))))
    return F.transform(pairs, lambda x: F.struct(x.alias("messages"), F.lit("sharegpt").alias("source"), F.lit(None).cast("string").alias("branch"))).cast(EXAMPLES)


def coerce(list_: Column, options: ChatOptions) -> Column:
    """Messages of a list's objects that have a role (a string, not blank) and a content (any string)."""
    names = dict(options.role_map) or CHAT_ROLES

    def one(x: Column) -> Column:
        role = mapped(F.lower(strip(first_string(x, options.role_keys))), names)
        return F.struct(role.alias("role"), F.coalesce(*(string_at(x, k) for k in options.content_keys), F.lit(None).cast("string")).alias("content"))

    found = F.filter(F.transform(objects(list_), one), lambda x: x["role"].isNotNull() & x["content"].isNotNull())
    return F.coalesce(found, F.array().cast(MESSAGES)).cast(MESSAGES)


def one_example(messages: Column, source: str, branch: str | None = None) -> Column:
    """examples(), with messages evaluated once."""
    return F.flatten(F.transform(F.array(messages), lambda x: examples(x, source, branch)))


def pairwise(m: Column, options: ChatOptions) -> Column:
    winner = strip(F.lower(F.coalesce(F.try_variant_get(at(m, "winner"), "$", "string"), F.lit(""))))
    won = {"winner": lambda s: winner.isin(s, f"model_{s}"), "both": lambda s: F.lit(True)}.get(options.pairwise_mode, lambda s: F.lit(s == options.pairwise_mode))
    sides = [F.when(won(s), one_example(coerce(at(m, f"conversation_{s}"), options), "chat:pairwise", s)).otherwise(F.array().cast(EXAMPLES)) for s in "ab"]
    return F.concat(*sides)


def chat(m: Column, options: ChatOptions = ChatOptions()) -> Column:
    """The first that fits: pairwise, a conversation list, plain text, instruction and output."""
    full = lambda k: F.size(F.coalesce(items(at(m, k)), F.array().cast("array<variant>"))) > 0
    out = F.when(has_key(m, "conversation_a") & has_key(m, "conversation_b"), pairwise(m, options))
    for key in options.conversation_keys:
        out = out.when(full(key), one_example(coerce(at(m, key), options), "chat"))
    text = first_string(m, ["text"])
    out = out.when(text.isNotNull(), examples(F.array(message("assistant", strip(text))), "chat:text"))
    some = F.coalesce(first_string(m, [*options.instruction_keys, *options.output_keys]).isNotNull(), F.lit(False))
    plain = one_example(instruction_messages(first_string(m, options.instruction_keys), first_string(m, options.input_keys), first_string(m, options.output_keys)), "alpaca")
    return out.when(some, plain).otherwise(F.array().cast(EXAMPLES))


ADAPTERS: dict[str, Adapter] = {"alpaca": alpaca, "sharegpt": sharegpt, "chat": chat, "auto": chat}


def register_adapter(name: str, make: Adapter) -> None:
    """A further adapter, under a name that none has yet."""
    if name in ADAPTERS:
        raise ValueError(f"there is an adapter {name!r} already")
    ADAPTERS[name] = make


def adapter(name: str, options: ChatOptions | None = None) -> Adapter:
    """The adapter of a name; options count for chat and auto only."""
    if name not in ADAPTERS:
        raise ValueError(f"unknown adapter {name!r}; there are {', '.join(sorted(ADAPTERS))}")
    return partial(chat, options=options) if options and ADAPTERS[name] is chat else ADAPTERS[name]
