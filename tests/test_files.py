"""File drivers, configuration, the fetch plane with fakes, and the command line."""

import gzip
import json
import re
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from chatloom import cli, config
from chatloom.fetch import connectors, runner
from chatloom.fetch import manifest as manifests
from chatloom.operators.adapters import ChatOptions
from chatloom.sources import files


def jsonl(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def back(path):
    return [json.loads(x) for x in open(path, encoding="utf-8")]


def test_convert_file(spark, tmp_path):
    src = jsonl(tmp_path / "in.jsonl", {"text": "é"}, " ", "broken", [1], {"instruction": "q", "output": "a"}, {})
    done = files.convert_file(spark, src, str(tmp_path / "deep/out.jsonl"), "auto", "messages")
    assert (done.lines_read, done.lines_written) == (6, 2)
    assert [x["messages"][-1]["content"] for x in back(tmp_path / "deep/out.jsonl")] == ["é", "a"]
    done = files.convert_file(spark, src, str(tmp_path / "folder"), "auto", "alpaca")
    assert done.lines_written == 2 and (tmp_path / "folder").is_dir() and spark.read.text(str(tmp_path / "folder")).count() == 2
    (tmp_path / "latin.jsonl").write_bytes('{"text": "é"}\r\n{"text": "ü"}\r\n'.encode("iso-8859-1"))
    done = files.convert_file(spark, str(tmp_path / "latin.jsonl"), str(tmp_path / "l.jsonl"), encoding="iso-8859-1")
    assert (done.lines_read, done.lines_written) == (2, 2) and [x["messages"][0]["content"] for x in back(tmp_path / "l.jsonl")] == ["é", "ü"]


def test_dedupe_and_split_files(spark, tmp_path):
    one = jsonl(tmp_path / "1.jsonl", '{"a": 1,  "b": 2}', {"b": 2, "a": 1}, "broken", "", {"a": 2})
    two = jsonl(tmp_path / "2.jsonl", {"a": 2}, {"a": 3})
    done = files.dedupe_file(spark, [one, two], str(tmp_path / "out.jsonl"))
    assert (done.total, done.kept, done.removed) == (6, 3, 3)
    assert open(tmp_path / "out.jsonl").read() == '{"a": 1,  "b": 2}\n{"a": 2}\n{"a": 3}\n'
    say = {"role": "assistant", "content": "x"}
    src = jsonl(tmp_path / "t.jsonl", {"messages": [say]}, {"messages": [say, say]}, {}, [1])
    assert files.split_file(spark, src, str(tmp_path / "s.jsonl"), str(tmp_path / "m.jsonl")) == (1, 2)
    assert back(tmp_path / "s.jsonl") == [{"messages": [say]}] and len(back(tmp_path / "m.jsonl")) == 2
    assert files.turn_report(spark, src) == {"total": 3, "single": 1, "multi": 2, "distribution": {0: 1, 1: 1, 2: 1}}


def test_normalize_folder(spark, tmp_path):
    src = tmp_path / "src"
    jsonl(src / "a/one.jsonl", {"a": 1}, "", [2])
    jsonl(src / "a/list.JSON", "[" + ",".join(['{"x": "' + "y" * 50 + '"}'] * 3000) + "]")  # longer than what is peeked at
    jsonl(src / "many.json", '{"a": "}{"}{"b": 1} {"c": 2}')
    jsonl(src / "bad.jsonl", '{"a": 1},')
    jsonl(src / "pretty.json", '{\n "a": [1,\n 2]\n}')
    jsonl(src / "note.txt", "no data")
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    next((tmp_path / "p").glob("*.parquet")).rename(src / "t.parquet")
    said = []
    done = files.normalize_folder(spark, str(src), str(tmp_path / "dst"), said.append)
    assert done.files == 5 and done.records == 2 + 3000 + 3 + 1 + 3 and [n for n, _ in done.failed] == ["bad.jsonl"]
    assert back(tmp_path / "dst/a/one.jsonl") == [{"a": 1}, [2]] and back(tmp_path / "dst/many.jsonl") == [{"a": "}{"}, {"b": 1}, {"c": 2}]
    assert back(tmp_path / "dst/pretty.jsonl") == [{"a": [1, 2]}] and back(tmp_path / "dst/t.jsonl") == [{"id": i} for i in range(3)]
    assert len(back(tmp_path / "dst/a/list.jsonl")) == 3000 and not (tmp_path / "dst/note.jsonl").exists()


def test_loaders(spark, tmp_path):
    raw = lambda df: [json.loads(r.raw) for r in df.orderBy("line_key").collect()]
    src = jsonl(tmp_path / "x.jsonl", {"a": 1}, [2], {"a": 3}, "broken", {"a": 4})
    said = []
    assert raw(files.load_objects(spark, src, log=said.append)) == [] and "line 4" in said[0]
    assert raw(files.load_objects(spark, src, max_rows=2)) == [{"a": 1}, {"a": 3}]  # what follows the last isn't looked at
    assert raw(files.load_objects(spark, src, max_rows=0)) == []
    good = jsonl(tmp_path / "good.jsonl", {"a": 1}, 5, {"a": 3})
    assert raw(files.iter_objects(spark, good)) == [{"a": 1}, {"a": 3}] and raw(files.iter_objects(spark, good, 1)) == [{"a": 1}] == raw(files.iter_objects(spark, good, 0))
    listed = jsonl(tmp_path / "l.json", '[{"a": 1}, 2, {"a": 3}]')
    assert raw(files.iter_objects(spark, listed)) == [{"a": 1}, {"a": 3}] and raw(files.iter_objects(spark, listed, 2)) == [{"a": 1}]
    assert raw(files.iter_objects(spark, jsonl(tmp_path / "o.json", '{"a": 1}'), 0)) == [{"a": 1}]
    assert raw(files.iter_objects(spark, jsonl(tmp_path / "s.json", "3"))) == []
    assert raw(files.iter_objects(spark, jsonl(tmp_path / "lines.json", {"a": 1}, {"a": 2}))) == [{"a": 1}, {"a": 2}]
    with pytest.raises(ValueError):
        files.iter_objects(spark, str(tmp_path / "x.csv"))
    with pytest.raises(Exception, match="invalid JSON"):
        files.iter_objects(spark, src).collect()


def test_mix_files(spark, tmp_path):
    a = jsonl(tmp_path / "a.jsonl", *({"src": "a", "i": i} for i in range(50)), "broken")
    b = jsonl(tmp_path / "b.jsonl", *({"src": "b", "i": i} for i in range(10)), 7)
    run = lambda out, **k: files.mix_files(spark, [(a, 3), (b, 1)], str(tmp_path / out), **k)
    done = run("x.jsonl", total=40)
    assert [(s.requested, s.available, s.written) for s in done.sources] == [(30, 50, 30), (10, 11, 10)] and done.total_written == 40
    rows = [json.dumps(r) for r in back(tmp_path / "x.jsonl")]
    assert len(set(rows)) == 40 and rows != sorted(rows)
    run("y.jsonl", total=40)
    assert open(tmp_path / "x.jsonl").read() == open(tmp_path / "y.jsonl").read()
    run("z.jsonl", total=40, seed=1)
    assert open(tmp_path / "x.jsonl").read() != open(tmp_path / "z.jsonl").read()
    assert run("all.jsonl").total_written == 61
    assert run("over.jsonl", total=80, oversample=True).total_written == 80 and len(back(tmp_path / "over.jsonl")) == 80
    told = json.load(open(files.write_recipe(spark, done)))
    assert told["version"] == 1 and told["sources"][0] == {"path": a, "weight": 0.75, "requested": 30, "available": 50, "written": 30} and told["created_at"].endswith("+00:00")
    with pytest.raises(FileNotFoundError):
        files.mix_files(spark, [(str(tmp_path / "none"), 1)], str(tmp_path / "n"))
    with pytest.raises(ValueError):
        files.mix_files(spark, [], str(tmp_path / "n"))


def test_config(tmp_path):
    p = tmp_path / "p.yaml"
    p.write_text("adapter: chat\noutput_format: alpaca\nencoding: latin-1\nadapter_options: {chat: {pairwise_mode: both, role_keys: [who], role_map: {a: user}}}\n")
    c = config.build_config(p)
    assert (c.adapter, c.output_format, c.encoding) == ("chat", "alpaca", "latin-1") and c.chat == ChatOptions(pairwise_mode="both", role_keys=("who",), role_map={"a": "user"})
    c = config.build_config(p, output_format="messages", kwargs_json='{"chat": {"pairwise_mode": "a"}}', chat=ChatOptions(input_keys=("in",)))
    assert (c.output_format, c.chat.pairwise_mode, c.chat.input_keys, c.chat.role_keys) == ("messages", "a", ("in",), ("who",))
    assert config.build_config(p, chat=ChatOptions()).chat.pairwise_mode == "both"  # a default overrides nothing
    config.validate_preset(p)
    t = tmp_path / "t.yaml"
    t.write_text(config.TEMPLATE)
    config.validate_preset(t)
    for text in ("adapter: x\noutput_format: alpaca", "adapter: chat\noutput_format: x", "adapter: ''\noutput_format: alpaca", "- 1", "adapter: chat\noutput_format: alpaca\nadapter_options: {chat: {role_keys: who}}", "adapter: chat\noutput_format: alpaca\nadapter_options: {chat: {pairwise_mode: c}}"):
        t.write_text(text)
        with pytest.raises(ValueError):
            config.validate_preset(t)
    for bad in ("[1]", "{", '{"chat": 1}'):
        with pytest.raises(ValueError):
            config.build_config(adapter="chat", output_format="alpaca", kwargs_json=bad)
    with pytest.raises(ValueError):
        config.build_config(adapter="chat")
    m = tmp_path / "m.json"
    m.write_text('{"sources": [{"path": "a", "weight": 2}], "total": 5, "seed": 0, "oversample": true}')
    assert config.load_mix(m) == ([("a", 2.0)], {"total": 5, "seed": 0, "oversample": True})
    for text in ("{}", '{"sources": []}', '{"sources": [{"path": "a"}]}', '{"sources": [1]}', "[]"):
        m.write_text(text)
        with pytest.raises(ValueError):
            config.load_mix(m)


MANIFEST = {
    "version": 1, "defaults": {"on_error": "continue"}, "auth": {"hf_token_env": "NO_SUCH_TOKEN"},
    "datasets": [{"name": "a b", "hf": "org/x", "split": "test"}, {"name": "raw", "url": "https://x.org/d.JSON"}, {"name": "tree", "url": "https://github.com/o/r", "ext": ".JSONL"}, {"name": "clone", "url": "https://github.com/o/r", "mode": "clone"}, {"name": "odd", "url": "https://x.org/page"}],
}


def test_manifest(tmp_path, monkeypatch):
    m = manifests.parse_manifest(MANIFEST)
    assert [e.kind() for e in m.entries[:4]] == ["hf", "url_raw", "url_github_tree", "url_github_clone"] and m.entries[2].ext == (".jsonl",)
    for bad in ({"version": 2}, {"defaults": {"on_error": "x"}}, {"datasets": {"a": 1}}, {"datasets": [1]}, {"datasets": [{"name": ""}]}, {"datasets": [{"name": "x"}]}, {"datasets": [{"name": "x", "hf": "a", "url": "b"}]}, {"datasets": [{"name": "x", "url": "b", "mode": "z"}]}):
        with pytest.raises(ValueError):
            manifests.parse_manifest(bad)
    (tmp_path / "t").write_text(" from file \n")
    monkeypatch.setenv("SOME_TOKEN", "from env")
    token = manifests.Token("SOME_TOKEN", str(tmp_path / "t"))
    assert token.resolve("given") == "given" and token.resolve(" ") == "from file" and replace(token, file=str(tmp_path / "none")).resolve() == "from env" and manifests.Token().resolve() is None
    assert manifests.safe_name('a/b: "c"') == "a_b___c" and manifests.safe_name("//") == "unnamed" and manifests.redact("https://u:p@h/x") == "https://h/x" and manifests.raw_suffix("X.JSON.GZ") == ".json.gz"


def test_run(tmp_path):
    m = manifests.parse_manifest(MANIFEST)
    calls = []

    def fake(entry, to, hf, gh):
        calls.append((entry.name, to.name, hf, gh))
        if entry.name == "raw":
            raise OSError("no network")
        to.mkdir(parents=True) if "github" in entry.kind() else None
        (to / "f" if to.is_dir() else runner.with_suffix(to, ".jsonl")).write_text("x")

    take = dict.fromkeys(manifests.KINDS, fake)
    said = []
    out = runner.run(m, tmp_path, hf_token="h", log=said.append, take=take)
    assert out.succeeded == ["a b", "tree", "clone"] and [n for n, _ in out.failed] == ["raw", "odd"] and out.total == 5 and calls[0] == ("a b", "a_b", "h", None)
    out = runner.run(m, tmp_path, log=said.append, take=take)
    assert out.skipped == ["a b", "tree", "clone"]
    assert runner.run(replace(m, resume=False), tmp_path, only=["tree"], log=said.append, take=take | {"url_github_tree": lambda *a: None}).succeeded == ["tree"]
    with pytest.raises(RuntimeError, match="no network"):
        runner.run(replace(m, on_error="fail"), tmp_path, only=["raw"], log=said.append, take=take)
    with pytest.raises(ValueError, match="nobody"):
        runner.run(m, tmp_path, only=["nobody"], log=said.append)
    assert runner.target(manifests.Entry("x", output="elsewhere/y"), tmp_path).as_posix() == "elsewhere/y"


def test_connectors(tmp_path, monkeypatch):
    served = {"https://api.github.com/repos/o/r": b'{"default_branch": "dev"}', "https://api.github.com/repos/o/r/git/trees/dev?recursive=1": json.dumps({"tree": [{"type": "blob", "path": "a/b.JSONL"}, {"type": "blob", "path": "a_b.JSONL"}, {"type": "tree", "path": "c.jsonl"}, {"type": "blob", "path": "d.txt"}]}).encode()}
    asked = []

    def get(url, token, accept=None):
        asked.append((url, token))
        return served.get(url, url.encode())

    monkeypatch.setattr(connectors, "_get", get)
    got = connectors.repo_files("https://github.com/o/r.git/tree/x", tmp_path / "t", (".jsonl",), "tok")
    assert [p.name for p in got] == ["a_b.JSONL", "1_a_b.JSONL"] and got[0].read_text().endswith("/o/r/dev/a/b.JSONL") and all(t == "tok" for _, t in asked)
    assert connectors.raw_file("https://x/y", tmp_path / "n/y.json").read_text() == "https://x/y"
    assert connectors.with_token("https://github.com/o/r", "t") == "https://user:t@github.com/o/r" and connectors.with_token("https://github.com.evil.org/o", "t") == "https://github.com.evil.org/o"
    with pytest.raises(ValueError):
        connectors.repo_name("https://gitlab.com/o/r")

    class Data:
        def to_json(self, path):
            open(path, "w").write("{}")

    seen = {}
    connectors.hf_dataset("org/x", tmp_path / "h/x.jsonl", None, None, None, load=lambda name, **k: seen.update(k, name_=name) or Data())
    assert seen == {"name_": "org/x", "split": "train"} and (tmp_path / "h/x.jsonl").exists()
    ran = []
    monkeypatch.setattr(connectors.subprocess, "run", lambda args, check: ran.append(args))
    monkeypatch.setattr(connectors.shutil, "which", lambda name: "/bin/" + name)
    connectors.clone("https://github.com/o/r", tmp_path / "c", "t", True)
    (tmp_path / "c/.git").mkdir(parents=True)
    connectors.clone("https://github.com/o/r", tmp_path / "c")
    assert [a[1] if a[1] != "-C" else a[3] for a in ran] == ["clone", "lfs", "pull"]
    monkeypatch.setattr(connectors.shutil, "which", lambda name: None)
    with pytest.raises(connectors.GitMissing):
        connectors.clone("https://github.com/o/r", tmp_path / "c")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    src = jsonl(tmp_path / "in.jsonl", {"text": "a"}, {"text": "a"}, "broken")
    at = lambda name: str(tmp_path / name)

    def code(*args):
        with pytest.raises(SystemExit) as e:
            cli.main(list(args))
        return e.value.code

    cli.main(["convert", "-i", src, "-o", at("c.jsonl"), "--from", "auto", "--format", "messages"])
    assert "read 3 lines, wrote 2 examples" in capsys.readouterr().err
    cli.main(["dedupe", "-i", src, "-o", at("d.jsonl")])
    assert "total=3 kept=1 removed=2 (66.67%)" in capsys.readouterr().err
    cli.main(["turns", "-i", at("c.jsonl"), "--single-out", at("s.jsonl"), "--multi-out", at("m.jsonl")])
    assert json.loads(capsys.readouterr().out)["single"] == 2 and len(back(at("s.jsonl"))) == 2
    cli.main(["mix", "-i", at("c.jsonl") + ":1", "-o", at("x.jsonl"), "-n", "1"])
    assert len(back(at("x.jsonl"))) == 1 and (tmp_path / "x.mix.json").exists()
    (tmp_path / "mix.yaml").write_text(f"sources: [{{path: {at('c.jsonl')}, weight: 1}}]\noutput: {at('y.jsonl')}\n")
    cli.main(["mix", at("mix.yaml"), "--no-recipe"])
    assert len(back(at("y.jsonl"))) == 2 and not (tmp_path / "y.mix.json").exists()
    cli.main(["normalize", "-i", at("c.jsonl"), "-o", at("n.jsonl")])
    cli.main(["preset", "init", "-o", at("p.yaml")])
    cli.main(["preset", "validate", at("p.yaml")])
    cli.main(["convert", "-i", src, "-o", at("c2.jsonl"), "--preset", at("p.yaml")])
    assert back(at("c2.jsonl")) == back(at("c.jsonl")) and back(at("n.jsonl")) == back(at("c.jsonl"))
    assert code("convert", "-i", at("none"), "-o", at("o"), "--from", "auto", "--format", "messages") == 1
    assert code("convert", "-i", src, "-o", at("o"), "--from", "nobody", "--format", "messages") == 2
    assert code("convert", "-i", src, "-o", at("o")) == 2
    assert code("turns", "-i", src, "--single-out", at("o")) == 2
    assert code("mix", "-o", at("o")) == 2 and code("mix", "-i", "x:y", "-o", at("o")) == 2 and code("mix", "-i", at("none") + ":1", "-o", at("o")) == 1 and code("mix", at("none.yaml")) == 1
    assert code("fetch", at("none.yaml")) == 1 and code("fetch", "https://x.org/page") == 1
    assert code("preset", "validate", at("none.yaml")) == 1 and code("--version") == 0 and code() == 2
    taken = []
    monkeypatch.setitem(runner.CONNECTORS, "url_raw", lambda e, to, hf, gh: taken.append((e.url, runner.with_suffix(to, manifests.raw_suffix(e.url)).name)))
    cli.main(["fetch", "https://x.org/Data.jsonl", "-o", at("raw")])
    assert taken == [("https://x.org/Data.jsonl", "data.jsonl")]


def test_listing_and_gzip(spark, tmp_path):
    (tmp_path / "x.json.gz").write_bytes(gzip.compress(b'{"a": 1}\n{"a": 2}\n'))
    jsonl(tmp_path / "b/y.JSON", {})
    assert files.listed(spark, str(tmp_path)) == ["b/y.JSON"] and files.load(spark, str(tmp_path / "x.json.gz"), max_rows=1).count() == 1


def worker_peaks():
    """The most MB that each of Spark's Python workers has held."""
    out = {}
    for p in Path("/proc").glob("[0-9]*"):
        try:
            if b"pyspark.daemon" in (p / "cmdline").read_bytes():
                out[p.name] = int(re.search(r"VmHWM:\s+(\d+)", (p / "status").read_text())[1]) / 1024
        except OSError:
            continue
    return out


def test_split_documents_holds_few_texts_at_once(spark):
    """2,000 texts of 100 kB in one task are 400 MB as strings of two bytes a letter."""
    one = F.concat(F.lit('\ufeff [{"n": '), F.col("id").cast("string"), F.lit('}, "'), F.repeat(F.lit("a"), 100_000), F.lit('"]'))
    texts = spark.range(2000).coalesce(1).select(F.col("id").cast("string").alias("path"), one.alias("value"))
    before = worker_peaks()
    out = files.split_documents(texts).agg(F.count(F.lit(1)), F.sum(F.length("value")), F.sum("pos")).first()
    assert tuple(out) == (4000, sum(len(json.dumps({"n": i})) + 100_002 for i in range(2000)), 2000)
    assert max(n - before.get(pid, 0) for pid, n in worker_peaks().items()) < 250


def test_split_documents_values(spark):
    split = lambda *values: [tuple(r) for r in files.split_documents(spark.createDataFrame(list(zip("abcdef", values)), "path string, value string").coalesce(1)).collect()]
    assert split('[1, {"é": "\\ud83d\\ude00"}]', " ", '{"a":1} {"a":2}\n[3]', "[]") == [("a", 0, "1"), ("a", 1, '{"é": "😀"}'), ("c", 0, '{"a": 1}'), ("c", 1, '{"a": 2}'), ("c", 2, "[3]")]
    for bad in ('{"a": 1', '["\\ud800"]'):
        with pytest.raises(PythonException, match="cannot normalize b"):
            split("[1]", bad)
