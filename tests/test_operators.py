"""Rules of the operators, case by case."""

import json

import pytest

from pyspark.sql import functions as F

from chatloom.functions import exprs
from chatloom.functions.exprs import is_json, strip
from chatloom.operators import adapters, mix
from chatloom.operators.adapters import ChatOptions, adapter, register_adapter
from chatloom.operators.convert import convert
from chatloom.operators.dedup import dedupe_lines
from chatloom.operators.emitters import emitter, register_emitter
from chatloom.operators.profile import key_frequency, uniform_schema
from chatloom.operators.turns import report, with_turns
from chatloom.sources import files, jsonl
from chatloom.streaming.convert import convert_stream


def lines(spark, *values):
    texts = [v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_key long, value string").coalesce(1)


def said(spark, name, *values, options=None):
    return [[(m.role, m.content) for m in r.messages] for r in convert(lines(spark, *values), name, options=options).collect()]


def test_strip_and_json(spark):
    cases = ['[1],"end-of-line-5b0f1c92"] x', '"end-of-line-5b0f1c92"', "1,2", "{}", "1", " [1] ", "null", '{"a":1},', '{"a":1}{"a":2}', '{"a":1}]', '{"a":1} x', "[1],[2]", "", "{", '"x"', '{"a":1,"a":2}']
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")

    def ok(s):
        try:
            json.loads(s.strip())
        except ValueError:
            return False
        return True

    assert [r[0] for r in df.select(is_json(strip(df.s))).collect()] == [ok(c) for c in cases]
    odd = ["　 a\xa0", "\x1c\x1fa\x85", "​a", ""]
    df = spark.createDataFrame([(c,) for c in odd], "s string")
    assert [r[0] for r in df.select(strip(df.s)).collect()] == [c.strip() for c in odd]


def test_alpaca(spark):
    assert said(spark, "alpaca", {"instruction": " do ", "input": "this", "output": "ok"}) == [[("user", "do\nthis"), ("assistant", "ok")]]
    assert said(spark, "alpaca", {"input": "only", "output": " ", "response": "r"}) == [[("user", "only"), ("assistant", "r")]]
    assert said(spark, "alpaca", {"output": "alone"}, {"instruction": " ", "output": None}, {"instruction": 5}, [1], "broken{") == [[("assistant", "alone")]]


def test_sharegpt(spark):
    turn = lambda who, what: {"from": who, "value": what}
    talk = [turn("system", "s"), turn("human", "a"), turn("Human ", "b"), turn("gpt", " c "), 7, turn("user", ""), turn("bing", "d"), turn("human", "x"), turn("bot", "y")]
    assert said(spark, "sharegpt", {"conversations": talk}) == [[("user", "b"), ("assistant", "c")], [("user", ""), ("assistant", "d")]]
    assert said(spark, "sharegpt", {"conversations": talk[:1]}, {"conversations": []}, {"conversations": None}, {}) == []


def test_chat_routes(spark):
    m = {"messages": [{"role": " GPT", "content": " kept "}, {"role": "critic", "content": ""}, {"role": "user"}, 3, {"from": "human", "value": "v"}]}
    assert said(spark, "chat", m) == [[("assistant", " kept "), ("critic", ""), ("user", "v")]]
    assert said(spark, "chat", {"messages": [], "conversation": [{"role": "user", "content": "c"}]}) == [[("user", "c")]]
    assert said(spark, "chat", {"messages": [1], "text": "t"}) == []
    assert said(spark, "chat", {"text": " t ", "instruction": "i"}) == [[("assistant", "t")]]
    assert said(spark, "chat", {"text": " ", "question": "q", "context": "c", "answer": "a"}) == [[("user", "q\nc"), ("assistant", "a")]]
    assert said(spark, "auto", {"input": "only"}) == []
    own = ChatOptions(conversation_keys=("dia.log",), role_map={"critic": "user"})
    assert said(spark, "chat", {"dia.log": [{"role": "critic", "content": "x"}, {"role": "gpt", "content": "y"}]}, options=own) == [[("user", "x"), ("gpt", "y")]]


def test_first_answer_key(spark):
    assert said(spark, "chat", {"instruction": "q", "response": "R", "answer": "A"}) == [[("user", "q"), ("assistant", "R")]]
    assert said(spark, "chat", {"instruction": " ", "question": "Q", "output": "", "answer": "A"}) == [[("user", "Q"), ("assistant", "A")]]


def test_registries(spark):
    register_adapter("first", lambda m: adapters.examples(F.array(adapters.message("assistant", exprs.string_at(m, "x"))), "first"))
    register_emitter("size", lambda messages: F.struct(F.size(messages).alias("size")))
    assert [r.size for r in convert(lines(spark, {"x": "a"}), "first", "size").collect()] == [1]
    for register, name in ((register_adapter, "chat"), (register_emitter, "alpaca")):
        with pytest.raises(ValueError, match="already"):
            register(name, lambda m: m)


def test_each_line_is_parsed_once(spark):
    plan = convert(lines(spark, {"text": "a"}), "chat")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parse_json(concat([,") <= 3, plan.count("parse_json(concat([,")  # the value, and the two forms for texts that hold the end mark


def test_pairwise(spark):
    pair = {s: [{"role": "user", "content": s[-1]}] for s in ("conversation_a", "conversation_b")}
    wins = [pair | {"winner": w} for w in ("model_a", " B", "tie", None)] + [pair]
    assert said(spark, "chat", *wins) == [[("user", "a")], [("user", "b")]]
    assert said(spark, "chat", pair, options=ChatOptions(pairwise_mode="both")) == [[("user", "a")], [("user", "b")]]
    assert said(spark, "chat", pair, options=ChatOptions(pairwise_mode="b")) == [[("user", "b")]]
    assert said(spark, "chat", {"conversation_a": None, "conversation_b": None, "text": "t"}) == []
    with pytest.raises(ValueError):
        ChatOptions(pairwise_mode="c")


def test_unknown_names():
    with pytest.raises(ValueError):
        adapter("x")
    with pytest.raises(ValueError):
        emitter("x")


def test_strict_convert_raises(spark):
    with pytest.raises(Exception, match="invalid JSON"):
        convert(lines(spark, {"text": "a"}, "{"), strict=True).collect()


def test_dedupe(spark):
    df = lines(spark, {"a": 1, "b": 2}, '{"b": 2, "a": 1}', {"a": 1.0, "b": 2}, {"a": True, "b": 2}, "broken{", " ", [1], [1], {"a": None}, {})
    assert sorted(r.line_key for r in dedupe_lines(df).collect()) == [0, 2, 3, 6, 8, 9]
    assert sorted(r.line_key for r in dedupe_lines(df, keys=["a"]).collect()) == [0, 2, 3, 6, 8, 9]
    assert sorted(r.line_key for r in dedupe_lines(df, keys=[]).collect()) == [0, 6]
    assert sorted(r.line_key for r in dedupe_lines(df, algorithm="sha256").collect()) == [0, 2, 3, 6, 8, 9]
    assert sorted(r.line_key for r in dedupe_lines(df, algorithm=lambda b: str(len(b))).collect())[0] == 0
    assert 2 not in {r.line_key for r in dedupe_lines(df, identity="native").collect()}
    with pytest.raises(ValueError):
        dedupe_lines(df, algorithm="crc")


def test_profile(spark):
    df = lines(spark, {"m": [{"r": 1}, {"r": {"m": 2}}], "k": None}, {"k": 1}, [1])
    assert {r.key: r.n for r in key_frequency(df).collect()} == {"m": 1, "k": 2}
    assert {r.key: r.n for r in key_frequency(df, recursive=True).collect()} == {"m": 2, "k": 2, "r": 2}
    assert {r.key: r.n for r in key_frequency(df, max_rows=1).collect()} == {"m": 1, "k": 1}
    for bad in (key_frequency, uniform_schema):
        with pytest.raises(Exception, match="invalid JSON"):
            bad(lines(spark, {"a": 1}, "{")).collect()
    assert uniform_schema(lines(spark, {"a": 1}, {"b": 1}), max_rows=1).first()[0] is True
    assert uniform_schema(df).first()[0] is False
    assert uniform_schema(lines(spark, {"a": 1, "b": 2}, {"b": 0, "a": None})).first()[0] is True
    assert uniform_schema(df.limit(0)).first()[0] is False


def test_turns(spark):
    one = {"role": "assistant", "content": "x"}
    got = with_turns(lines(spark, {"messages": [one]}, {"messages": [one, one]}, {}, {"messages": None}, [one], {"messages": [{"role": "Assistant"}]}))
    assert tuple(report(got).first()) == (5, 1, 4)


def test_allocate():
    assert mix.allocate([1, 1, 1], 100) == [34, 33, 33]
    assert mix.allocate([1] * 4, 6) == [0, 2, 2, 2]
    assert mix.allocate([1] * 4, 2) == [2, 0, 0, 0]
    assert mix.allocate([7, 93], 150) == [11, 139] and mix.allocate([7, 31, 62], 150) == [11, 46, 93]
    assert mix.allocate([0.4, 0.3, 0.3], 5) == [1, 2, 2]
    for bad in ([], [0, 0], [1, -1]):
        with pytest.raises(ValueError):
            mix.allocate(bad, 3)
    with pytest.raises(ValueError):
        mix.allocate([0.1] * 10, 6)


def test_mix(spark):
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", i) for i in range(10)], "src string, i long")
    take = lambda **k: mix.mix(rows, {"a": 1, "b": 1, "none": 1}, "src", "i", **k)
    out, stats = take(total=90)
    assert [(s.source, s.requested, s.available, s.written) for s in stats] == [("a", 30, 50, 30), ("b", 30, 10, 10), ("none", 30, 0, 0)]
    assert out.count() == 40 and out.select("src", "i").distinct().count() == 40
    more, stats = take(total=90, oversample=True)
    assert more.where("src = 'b'").count() == 30 and [s.written for s in stats] == [30, 30, 0]
    assert take()[0].count() == 60
    same = sorted(map(tuple, take(total=90)[0].collect()))
    assert same == sorted(map(tuple, mix.mix(rows.repartition(5), {"a": 1, "b": 1, "none": 1}, "src", "i", 90)[0].collect()))
    assert same != sorted(map(tuple, take(total=90, seed=1)[0].collect()))


@pytest.mark.parametrize(
    "text, shape, values",
    [
        ('{"a":1}\n\n{"a":2}\n', "jsonl", 2),
        ('[{"a":1},{"a":2},3]', "json_array", 3),
        ('{"a":"}{"}{"b":1} {"c":2}', "single_line", 3),
        ('{"a":1}', "single_line", 1),
        ("", "empty", 0),
        ('﻿{"a":1} \r\n{"b":2}\r\n', "jsonl", 2),
        ('[\n {"a": 1},\n {"b": 2}\n]', "jsonl", 2),
    ],
)
def test_shapes(spark, tmp_path, text, shape, values):
    assert jsonl.detect_shape(text.encode()) == shape
    (tmp_path / "x.json").write_bytes(text.encode())
    got = files.normalized(spark, str(tmp_path / "x.json")).collect()
    assert len(got) == values and all(json.loads(r.value) is not None for r in got)


def test_bad_files(spark, tmp_path):
    assert jsonl.detect_shape(b"3") == "invalid" and jsonl.detect_shape(b"{") == "invalid"
    for text, why in (('{"a":1},\n{"a":2}\n', "trailing comma: .*x.jsonl.* line 1"), ("3", "neither"), ('"x"', "neither"), ('{"a":1}\nbroken\n', "invalid JSON: .*x.jsonl.* line 2"), ("[1, 2", "x.jsonl")):
        (tmp_path / "x.jsonl").write_text(text)
        with pytest.raises(Exception, match=why):
            files.normalized(spark, str(tmp_path / "x.jsonl")).collect()


def test_files_and_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.jsonl").write_text('{"text": "é"}\n\nbroken\n{"question": "q"}\n')
    assert convert(jsonl.scan(spark, str(src))).count() == 2
    rows = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, TIMESTAMP '2024-01-01 00:00:00.000005' AS t, CAST(1.50 AS DECIMAL(4,2)) AS d")
    assert json.loads(jsonl.json_rows(rows).first()[0]) == {"a": 1, "b": None, "t": "2024-01-01 00:00:00.000005", "d": "1.50"}
    jsonl.write_lines(jsonl.json_rows(rows), str(out))
    assert spark.read.text(str(out)).count() == 1
    q = convert_stream(spark, str(src)).writeStream.format("memory").queryName("converted").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("converted").count() == 2
