"""Settings of a conversion: options from mappings, preset files, and how they are merged."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from chatloom.operators.adapters import ADAPTERS, MODES, ChatOptions
from chatloom.operators.emitters import EMITTERS

TEMPLATE = """# A preset for `convert`.
adapter: auto
output_format: messages
encoding: utf-8

# How records are read by the adapters auto and chat; what is left out keeps its default.
adapter_options:
  chat:
    # pairwise_mode: both          # or winner, a, b
    # conversation_keys: [messages, dialogue]
    # role_keys: [role, speaker]
    # content_keys: [content, text]
    # instruction_keys: [instruction]
    # input_keys: [input]
    # output_keys: [output, response]
    # role_map: {customer: user, agent: assistant}
"""
_DEFAULT = ChatOptions()


@dataclass(frozen=True)
class ConvertConfig:
    adapter: str
    output_format: str
    encoding: str = "utf-8"
    chat: ChatOptions | None = None


def read_mapping(path: str | Path, what: str = "preset", yaml_suffixes: tuple[str, ...] | None = None) -> dict:
    """The mapping in a JSON or YAML file. YAML: what ends in yaml_suffixes, by default all but .json."""
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    suffix = path.suffix.lower()
    if suffix == ".json" if yaml_suffixes is None else suffix not in yaml_suffixes:
        data = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ImportError(f"PyYAML is needed for {path}") from e
        data = yaml.safe_load(text)
    if data is None:
        data = {}
    if not isinstance(data, dict):
        raise ValueError(f"a {what} must be a mapping, not {type(data).__name__}")
    return data


def chat_fields(data: Mapping) -> dict:
    """The options that a mapping sets, checked; others in it are left out."""
    out = {}
    for f in fields(ChatOptions):
        if f.name not in data:
            continue
        value = data[f.name]
        if f.name.endswith("_keys"):
            if not isinstance(value, (list, tuple)):
                raise ValueError(f"{f.name} must be a list of strings")
            out[f.name] = tuple(map(str, value))
        elif f.name == "role_map":
            if value is not None and not isinstance(value, Mapping):
                raise ValueError("role_map must map strings to strings, or be null")
            out[f.name] = {str(k): str(v) for k, v in (value or {}).items()}
        else:
            out[f.name] = str(value)
    return out


def chat_options(data: Mapping) -> ChatOptions:
    return ChatOptions(**chat_fields(data))


def changed(options: ChatOptions) -> dict:
    """What differs from the defaults: a layer can't set a field back to its default."""
    return {k: v for k, v in asdict(options).items() if v != getattr(_DEFAULT, k)}


def _text(data: Mapping, key: str) -> str:
    value = data.get(key)
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{key} must be a string that isn't empty")
    return value.strip()


def load_preset(path: str | Path) -> ConvertConfig:
    data = read_mapping(path)
    options = data.get("adapter_options")
    if options is not None and not isinstance(options, dict):
        raise ValueError("adapter_options must be a mapping")
    chat = (options or {}).get("chat")
    if chat is not None and not isinstance(chat, dict):
        raise ValueError("adapter_options.chat must be a mapping")
    encoding = _text(data, "encoding") if data.get("encoding") else "utf-8"
    return ConvertConfig(_text(data, "adapter"), _text(data, "output_format"), encoding, None if chat is None else chat_options(chat))


def validate_preset(path: str | Path) -> None:
    """An error that says what is wrong with a preset file."""
    config = load_preset(path)
    for what, value, known in (("adapter", config.adapter, ADAPTERS), ("output_format", config.output_format, EMITTERS), ("pairwise_mode", (config.chat or _DEFAULT).pairwise_mode, MODES)):
        if value not in known:
            raise ValueError(f"unknown {what} {value!r}; there are {', '.join(sorted(known))}")


def build_config(preset: str | Path | None = None, adapter: str | None = None, output_format: str | None = None, encoding: str | None = None, chat: ChatOptions | None = None, kwargs_json: str | None = None) -> ConvertConfig:
    """A preset, over which go the chat options of a JSON text ({"chat": {...}}), then `chat`, and the other arguments that are given."""
    base = load_preset(preset) if preset is not None else None
    layers = [changed(base.chat)] if base and base.chat else []
    if kwargs_json:
        try:
            data = json.loads(kwargs_json)
        except ValueError as e:
            raise ValueError(f"the adapter options aren't JSON: {e}") from None
        if not isinstance(data, dict) or not isinstance(data.get("chat") or {}, dict):
            raise ValueError('the adapter options must be an object, as in {"chat": {}}')
        if data.get("chat") is not None:
            layers.append(chat_fields(data["chat"]))
    if chat is not None:
        layers.append(changed(chat))
    merged = {k: v for layer in layers for k, v in layer.items()}
    adapter, output_format = adapter or (base.adapter if base else None), output_format or (base.output_format if base else None)
    if not adapter or not output_format:
        raise ValueError("an adapter and an output format are needed, from a preset or as arguments")
    return ConvertConfig(adapter, output_format, encoding or (base.encoding if base else "utf-8"), ChatOptions(**merged) if layers else None)


def load_mix(path: str | Path) -> tuple[list[tuple[str, float]], dict]:
    """((path, weight) of the sources, the options total, seed, output and oversample that are set) of a mix file."""
    data = read_mapping(path, "mix file", (".yaml", ".yml"))
    sources = data.get("sources")
    if not isinstance(sources, list) or not sources:
        raise ValueError("a mix file needs a list of sources")
    out = []
    for i, s in enumerate(sources):
        if not isinstance(s, dict):
            raise ValueError(f"sources[{i}] must be a mapping")
        if not s.get("path") or s.get("weight") is None:
            raise ValueError(f"sources[{i}] needs a path and a weight")
        out.append((str(s["path"]), float(s["weight"])))
    made = {"total": int, "seed": int, "output": str, "oversample": bool}
    return out, {k: f(data[k]) for k, f in made.items() if data.get(k) is not None}
