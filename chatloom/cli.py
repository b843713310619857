"""The command line: fetch, normalize, convert, mix, dedupe, turns and preset, over the same functions as the library."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

import chatloom

WRONG_INPUT, WRONG_ARGUMENTS = 1, 2


def say(*what: object) -> None:
    print(*what, file=sys.stderr)


def stop(code: int, why: object) -> None:
    say(f"error: {why}")
    raise SystemExit(code)


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("chatloom").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("chatloom", description="Chat and instruction data: fetch, normalize, convert, mix, dedupe, turns.")
    top.add_argument("--version", action="version", version=chatloom.__version__)
    sub = top.add_subparsers(dest="command", required=True)

    def files(name: str, told: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=told)
        p.add_argument("-i", "--input", required=True)
        p.add_argument("-o", "--output", required=True)
        return p

    p = files("convert", "JSON lines to training examples")
    p.add_argument("--preset")
    p.add_argument("--from", dest="adapter")
    p.add_argument("-f", "--format")
    p.add_argument("--adapter-kwargs", metavar="JSON")
    p.add_argument("--encoding")
    files("normalize", "files of any shape, or a folder of them, to JSON lines")
    p = files("dedupe", "the first of equal lines")
    p.add_argument("--keys", nargs="+")
    p.add_argument("--algorithm", choices=("md5", "sha256"), default="md5")
    p = sub.add_parser("turns", help="how many answers the lines have; and the lines with one and with others")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("--single-out")
    p.add_argument("--multi-out")
    p = sub.add_parser("mix", help="lines of several files by weight")
    p.add_argument("config", nargs="?")
    p.add_argument("-i", "--input", nargs="+", metavar="FILE:WEIGHT")
    p.add_argument("-o", "--output")
    p.add_argument("-n", "--total", type=int)
    p.add_argument("--seed", type=int)
    p.add_argument("--oversample", action="store_true")
    p.add_argument("--no-recipe", action="store_true")
    p.add_argument("--encoding", default="utf-8")
    p = sub.add_parser("preset", help="a preset to begin with, or the check of one").add_subparsers(dest="action", required=True)
    p.add_parser("init").add_argument("-o", "--output")
    p.add_parser("validate").add_argument("path")
    p = sub.add_parser("fetch", help="the entries of a manifest, an hf://name, or a URL")
    p.add_argument("source")
    p.add_argument("-o", "--output")
    p.add_argument("--hf-token")
    p.add_argument("--github-token")
    p.add_argument("--only", nargs="+")
    p.add_argument("--on-error", choices=("continue", "fail"))
    p.add_argument("--no-resume", action="store_true")
    p.add_argument("--ext", nargs="+", default=())
    p.add_argument("--mode", choices=("tree", "clone"))
    p.add_argument("--lfs", action="store_true")
    p.add_argument("--split")
    p.add_argument("--config")
    return top


def convert(a: argparse.Namespace) -> None:
    from chatloom.config import build_config
    from chatloom.operators.adapters import adapter
    from chatloom.operators.emitters import emitter
    from chatloom.sources import files

    try:
        c = build_config(a.preset, a.adapter, a.format, a.encoding, None, a.adapter_kwargs)
        adapter(c.adapter), emitter(c.output_format)
    except (ValueError, OSError, ImportError) as e:
        stop(WRONG_ARGUMENTS, e)
    spark = session()
    if not files.exists(spark, a.input):
        stop(WRONG_INPUT, f"no such input: {a.input}")
    n = files.convert_file(spark, a.input, a.output, c.adapter, c.output_format, c.chat, c.encoding)
    say(f"read {n.lines_read} lines, wrote {n.lines_written} examples")


def normalize(a: argparse.Namespace) -> None:
    from chatloom.sources import files

    spark = session()
    if not files.exists(spark, a.input):
        stop(WRONG_INPUT, f"no such input: {a.input}")
    if files.is_file(spark, a.input):
        say(f"{a.input} -> {a.output}: {files.normalize_file(spark, a.input, a.output)} records")
        return
    done = files.normalize_folder(spark, a.input, a.output, say)
    say(f"[done] {done.files} files, {done.records} records, {len(done.failed)} failed")


def dedupe(a: argparse.Namespace) -> None:
    from chatloom.sources import files

    spark = session()
    if not files.exists(spark, a.input):
        stop(WRONG_INPUT, f"no such input: {a.input}")
    n = files.dedupe_file(spark, a.input, a.output, a.keys, a.algorithm)
    say(f"total={n.total:,} kept={n.kept:,} removed={n.removed:,} ({100 * n.removed / max(n.total, 1):.2f}%)")


def turns(a: argparse.Namespace) -> None:
    from chatloom.sources import files

    if bool(a.single_out) != bool(a.multi_out):
        stop(WRONG_ARGUMENTS, "--single-out and --multi-out go together")
    spark = session()
    if not files.exists(spark, a.input):
        stop(WRONG_INPUT, f"no such input: {a.input}")
    print(json.dumps(files.turn_report(spark, a.input), indent=2))
    if a.single_out:
        one, other = files.split_file(spark, a.input, a.single_out, a.multi_out)
        say(f"single: {one:,} -> {a.single_out}\nmulti: {other:,} -> {a.multi_out}")


def mix(a: argparse.Namespace) -> None:
    from chatloom.config import load_mix
    from chatloom.sources import files

    sources, options = [], {}
    try:
        if a.config:
            if not Path(a.config).is_file():
                stop(WRONG_INPUT, f"no such mix file: {a.config}")
            sources, options = load_mix(a.config)
        for spec in () if a.config else a.input or ():
            path, _, weight = spec.rpartition(":")
            sources.append((path, float(weight)))
    except (ValueError, ImportError) as e:
        stop(WRONG_ARGUMENTS, e)
    if not sources:
        stop(WRONG_ARGUMENTS, "give a mix file or --input FILE:WEIGHT")
    output = a.output or options.get("output")
    if not output:
        stop(WRONG_ARGUMENTS, "give --output")
    seed = a.seed if a.seed is not None else options.get("seed", 42)
    total = a.total if a.total is not None else options.get("total")
    again = a.oversample or options.get("oversample", False)
    spark = session()
    try:
        done = files.mix_files(spark, sources, output, total, seed, again, a.encoding)
    except (FileNotFoundError, ValueError) as e:
        stop(WRONG_INPUT, e)
    for s in done.sources:
        say(f"  {s.source}: weight={s.weight:.4f} written={s.written:,}" + (f" (of {s.requested:,} asked for)" if s.written < s.requested else ""))
    say(f"total written: {done.total_written:,} -> {output}")
    if not a.no_recipe:
        say(f"recipe: {files.write_recipe(spark, done)}")


def preset(a: argparse.Namespace) -> None:
    from chatloom.config import TEMPLATE, validate_preset

    if a.action == "validate":
        try:
            validate_preset(a.path)
        except (ValueError, OSError, ImportError) as e:
            stop(WRONG_INPUT, e)
        say("ok")
    elif a.output:
        Path(a.output).write_text(TEMPLATE, encoding="utf-8")
        say(f"wrote {a.output}")
    else:
        print(TEMPLATE, end="")


def fetch(a: argparse.Namespace) -> None:
    from chatloom.fetch.manifest import RAW_SUFFIXES, Entry, Manifest, load_manifest
    from chatloom.fetch.runner import run

    if a.source.startswith(("hf://", "http://", "https://")):
        low = a.source.rstrip("/")
        name = low[5:] if low.startswith("hf://") else low.lower().rsplit("/", 1)[-1]
        name = next((name[: -len(s)] for s in RAW_SUFFIXES if name.endswith(s)), name)
        one = Entry(name or "fetch", *((low[5:], None) if low.startswith("hf://") else (None, a.source)), a.config, a.split, tuple(a.ext), a.mode, a.lfs)
        try:
            one.kind()
        except ValueError as e:
            stop(WRONG_INPUT, e)
        manifest = Manifest((one,), resume=False, on_error="fail")
    elif Path(a.source).is_file():
        manifest = load_manifest(a.source)
        manifest = replace(manifest, on_error=a.on_error or manifest.on_error, resume=manifest.resume and not a.no_resume)
    else:
        stop(WRONG_INPUT, f"no such manifest: {a.source}")
    try:
        run(manifest, a.output, a.only, a.hf_token, a.github_token, say)
    except (RuntimeError, ValueError) as e:
        stop(WRONG_INPUT, e)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    {"convert": convert, "normalize": normalize, "dedupe": dedupe, "turns": turns, "mix": mix, "preset": preset, "fetch": fetch}[a.command](a)
