"""The connectors: a hub's datasets, single URLs, the files of a repository, and clones."""

from __future__ import annotations

import json
import re
import shutil
import subprocess
import urllib.error
import urllib.request
from pathlib import Path
from urllib.parse import quote, urlsplit

TIMEOUT = 60
_REPO = re.compile(r"https?://(?:www\.)?github\.com/([^/]+)/([^/?#]+?)(?:\.git)?(?:/.*)?")
_TOKEN_HOSTS = ("github.com", "www.github.com", "huggingface.co")


class FetchError(RuntimeError):
    """A call to a server failed."""


class GitMissing(RuntimeError):
    """There is no git, or no git-lfs, to run."""


def _get(url: str, token: str | None, accept: str | None = None) -> bytes:
    headers = {"User-Agent": "chatloom"} | ({"Accept": accept} if accept else {}) | ({"Authorization": f"token {token}"} if token else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT) as answer:
            return answer.read()
    except urllib.error.HTTPError as e:
        raise FetchError(f"{url}: HTTP {e.code} {e.reason}") from e
    except urllib.error.URLError as e:
        raise FetchError(f"{url}: {e.reason}") from e


def raw_file(url: str, dst: str | Path, token: str | None = None) -> Path:
    dst = Path(dst)
    body = _get(url, token)
    dst.parent.mkdir(parents=True, exist_ok=True)
    dst.write_bytes(body)
    return dst


def repo_name(url: str) -> tuple[str, str]:
    found = _REPO.fullmatch(url.strip())
    if not found:
        raise ValueError(f"not a repository's URL: {url!r}")
    return found[1], found[2]


def wanted(tree: list[dict], ext: tuple[str, ...]) -> list[str]:
    """The paths of a tree's files that end in one of ext, in any case; all for none."""
    ends = tuple(e.lower() for e in ext)
    return [n["path"] for n in tree if n.get("type") == "blob" and n.get("path") and (not ends or n["path"].lower().endswith(ends))]


def repo_files(url: str, folder: str | Path, ext: tuple[str, ...] = (), token: str | None = None, branch: str | None = None) -> list[Path]:
    """The files of a repository's tree, flat: / becomes _, and a path whose name is taken gets a number."""
    owner, repo = repo_name(url)
    api = f"https://api.github.com/repos/{owner}/{repo}"
    ask = lambda what: json.loads(_get(what, token, "application/vnd.github+json"))
    branch = branch or ask(api).get("default_branch") or "main"
    tree = ask(f"{api}/git/trees/{quote(branch, safe='')}?recursive=1").get("tree", [])
    folder, out, taken = Path(folder), [], set()
    folder.mkdir(parents=True, exist_ok=True)
    for path in wanted(tree, tuple(ext)):
        name, n = path.replace("/", "_"), 1
        while name in taken:
            name, n = f"{n}_{path.replace('/', '_')}", n + 1
        taken.add(name)
        out.append(raw_file(f"https://raw.githubusercontent.com/{owner}/{repo}/{quote(branch)}/{quote(path)}", folder / name, token))
    return out


def with_token(url: str, token: str | None) -> str:
    """The URL with the token as password, for the hosts that take it and no others."""
    parts = urlsplit(url)
    if not token or (parts.hostname or "").lower() not in _TOKEN_HOSTS:
        return url
    return parts._replace(scheme=parts.scheme or "https", netloc=f"user:{token}@{parts.netloc.rpartition('@')[2]}").geturl()


def clone(url: str, folder: str | Path, token: str | None = None, lfs: bool = False) -> Path:
    """A clone, or a pull where there is one."""
    if shutil.which("git") is None:
        raise GitMissing("git is needed to clone")
    folder = Path(folder)
    if (folder / ".git").is_dir():
        subprocess.run(["git", "-C", str(folder), "pull", "--ff-only"], check=True)
    else:
        folder.parent.mkdir(parents=True, exist_ok=True)
        try:
            subprocess.run(["git", "clone", with_token(url, token), str(folder)], check=True)
        except subprocess.CalledProcessError as e:  # its message would hold the token
            raise FetchError(f"git clone of {url} failed with {e.returncode}") from None
    if lfs:
        if shutil.which("git-lfs") is None:
            raise GitMissing("git-lfs is needed for an entry with lfs")
        subprocess.run(["git", "-C", str(folder), "lfs", "pull"], check=True)
    return folder


def hf_dataset(name: str, dst: str | Path, config: str | None = None, split: str | None = None, token: str | None = None, load=None) -> Path:
    """A hub's dataset as JSON lines. load: what loads one, instead of the package `datasets`."""
    if load is None:
        try:
            from datasets import load_dataset as load
        except ImportError as e:
            raise ImportError("the package `datasets` is needed for hf entries") from e
    options = {"split": split or "train"} | ({"name": config} if config is not None else {}) | ({"token": token} if token else {})
    dst = Path(dst)
    dst.parent.mkdir(parents=True, exist_ok=True)
    load(name, **options).to_json(str(dst))
    return dst
