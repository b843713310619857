"""The catalog of what to fetch."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from chatloom.config import read_mapping

KINDS = ("hf", "url_raw", "url_github_tree", "url_github_clone")
RAW_SUFFIXES = (".json.gz", ".jsonl", ".json")


@dataclass(frozen=True)
class Token:
    """Where a secret is: a file or a variable of the environment."""

    env: str | None = None
    file: str | None = None

    def resolve(self, explicit: str | None = None) -> str | None:
        """The first that isn't blank: the explicit one, the file's, the variable's."""
        in_file = Path(self.file).expanduser() if self.file else None
        for value in (explicit, in_file.read_text(encoding="utf-8") if in_file and in_file.is_file() else None, os.environ.get(self.env) if self.env else None):
            if value and value.strip():
                return value.strip()
        return None


@dataclass(frozen=True)
class Entry:
    name: str
    hf: str | None = None
    url: str | None = None
    config: str | None = None
    split: str | None = None
    ext: tuple[str, ...] = ()
    mode: str | None = None
    lfs: bool = False
    output: str | None = None

    def kind(self) -> str:
        """One of KINDS; an error for a URL that no connector takes."""
        if self.hf:
            return "hf"
        low = (self.url or "").lower()
        if "raw.githubusercontent.com" in low or low.endswith(RAW_SUFFIXES):
            return "url_raw"
        if "github.com" in low:
            return "url_github_clone" if self.mode == "clone" else "url_github_tree"
        raise ValueError(f"{self.name!r}: no connector for {redact(self.url or '')}")


@dataclass(frozen=True)
class Manifest:
    entries: tuple[Entry, ...] = ()
    hf_token: Token = Token()
    github_token: Token = Token()
    output_root: str = "./raw"
    on_error: str = "continue"
    resume: bool = True


def safe_name(name: str) -> str:
    """Fit for a file, as functions.exprs.sanitize_name() makes it."""
    return re.sub(r"\s+", "_", re.sub(r'[<>:"/\\|?*]', "_", name)).strip("_") or "unnamed"


def redact(url: str) -> str:
    """Without user and password."""
    return re.sub(r"(https?://)[^/@\s]+@", r"\1", url)


def raw_suffix(url: str) -> str:
    return next((s for s in RAW_SUFFIXES if url.lower().endswith(s)), ".jsonl")


def _entry(i: int, item: object) -> Entry:
    if not isinstance(item, Mapping):
        raise ValueError(f"datasets[{i}] must be a mapping")
    name = item.get("name")
    if not isinstance(name, str) or not name.strip():
        raise ValueError(f"datasets[{i}] needs a name")
    if bool(item.get("hf")) == bool(item.get("url")):
        raise ValueError(f"datasets[{i}] ({name}) needs either hf or url")
    ext, mode = item.get("ext") or (), item.get("mode")
    if mode not in (None, "tree", "clone"):
        raise ValueError(f"datasets[{i}] ({name}): mode must be tree or clone")
    plain = {k: None if item.get(k) is None else str(item[k]) for k in ("hf", "url", "config", "split", "output")}
    return Entry(name.strip(), ext=tuple(str(e).lower() for e in ([ext] if isinstance(ext, str) else ext)), mode=mode, lfs=bool(item.get("lfs", False)), **plain)


def parse_manifest(data: Mapping) -> Manifest:
    if int(data.get("version", 1)) != 1:
        raise ValueError(f"there is no manifest version {data['version']}, only 1")
    auth, defaults, items = data.get("auth") or {}, data.get("defaults") or {}, data.get("datasets") or []
    on_error = defaults.get("on_error", "continue")
    if on_error not in ("continue", "fail"):
        raise ValueError("defaults.on_error must be continue or fail")
    if not isinstance(items, list):
        raise ValueError("datasets must be a list")
    tokens = {f"{k}_token": Token(auth.get(f"{k}_token_env"), auth.get(f"{k}_token_file")) for k in ("hf", "github")}
    return Manifest(tuple(_entry(i, x) for i, x in enumerate(items)), output_root=str(defaults.get("output_root", "./raw")), on_error=on_error, resume=bool(defaults.get("resume", True)), **tokens)


def load_manifest(path: str | Path) -> Manifest:
    return parse_manifest(read_mapping(path, "manifest", (".yaml", ".yml", ".json")))
