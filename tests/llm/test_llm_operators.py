"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import gzip
import itertools
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from chatloom.llm import bpe, common, language_id, mixing, near_dedup, neighbours, quality, sharding, suffix_dedup, toxicity, warc
from chatloom.llm import text as T

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("row", "named", "rank", "bucket", "block", "spot", "shard", "position", "grp", "bytes", "k", "digest", "same", "keys", "mm", "start", "cuts", "left", "keep", "copies", "tokens", "a", "b", "features", "good")


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], SCHEMA)


def clashing(df):
    return df.select("*", *(F.lit(n).alias(c) for n, c in enumerate(CLASH)))


def words(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a long text, repeats and ties, with many clashing columns."""
    rng = random.Random(3)
    text = words(rng, 120)
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (2, text, "en", "s"), (3, None, None, None), (None, text, "en", "s"), (None, None, None, None), (4, "", "en", ""), (5, " \n ", "en", "s"), (6, "x" * 150_000, "en", "s"), (7, words(rng, 30_000), "en", None)]
    return clashing(table(spark, rows))


@pytest.fixture(scope="module")
def none(spark):
    return clashing(table(spark, []))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1
def test_quotas_and_tree():
    assert mixing.quotas([10, 10, 10], [1, 1, 2], 8) == [2, 2, 4]
    assert mixing.quotas([1, 10, 10], [1, 1, 1], 12) == [1, 6, 5]
    assert mixing.quotas([5, 5], [0, 1], 9) == [0, 5]
    out = mixing.split([7, 0, 13, 40], 6, 1)
    assert out.sum(0).tolist() == [7, 0, 13, 40] and set(out.sum(1)) == {10}


def test_mix(spark, odd, none):
    docs = table(spark, [(i, f"t{i}", "en", "big" if i % 4 else f"s{i // 4 % 2}") for i in range(800)])
    got = mixing.mix(docs, keep=0.5, block_rows=4, shards=5)
    assert got.count() == 400 and got.select("doc_id").distinct().count() == 400
    sizes = {r[0]: r[1] for r in got.groupBy("source").count().collect()}
    assert sizes == {"s0": 100, "s1": 100, "big": 200}  # of 100 blocks each wants a third; the small sources give all 25 they have
    short = mixing.mix(docs, keep=0.5, block_rows=7, shards=5)  # each source's last block is short
    assert 400 - 3 * 7 <= short.count() <= 400 and short.select("doc_id").distinct().count() == short.count()
    assert {r[0] for r in got.groupBy("shard").count().select("count").collect()} == {80}
    again = mixing.mix(docs.repartition(7), keep=0.5, block_rows=4, shards=5)
    assert rows(got) == rows(again)
    assert rows(got.select("doc_id")) != rows(mixing.mix(docs, keep=0.5, block_rows=4, shards=5, seed=1).select("doc_id"))
    assert mixing.mix(odd, keep=1.0).count() == 10
    assert mixing.mix(none).count() == 0
    user = odd.drop("shard", "position").withColumn("Shard", F.lit(99)).withColumn("POSITION", F.col("doc_id") * 7)
    kept = mixing.stage(spark, user, SF)
    assert kept.columns == user.columns and rows(kept) == rows(user)  # all columns keep their values
    assert mixing.mix(user).columns == [c for c in user.columns if c.lower() not in ("shard", "position")] + ["shard", "position"]
    with pytest.raises(ValueError):
        mixing.mix(docs, {"big": -1})


def test_mix_drops_only_what_the_weights_need(spark):
    docs = table(spark, [(i, f"t{i}", "en", "big" if i % 4 else f"s{i // 4 % 2}") for i in range(800)])
    assert mixing.mix(docs).count() == 800 and mixing.stage(spark, docs, SF).count() == 800
    got = mixing.mix(docs, {"big": 2, "s0": 1, "s1": 1}, block_rows=4)
    assert {r[0]: r[1] for r in got.groupBy("source").count().collect()} == {"big": 200, "s0": 100, "s1": 100}
    at_target = mixing.mix(docs, {"big": 6, "s0": 1, "s1": 1}, block_rows=4)
    assert at_target.count() == 800
    assert mixing.reachable([10, 0, 5], [1, 1, 0]) == 10 and mixing.reachable([], []) == 0


def test_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 70_001):
        got = mixing.permuted(np.arange(n), n, 9)
        assert sorted(got.tolist()) == list(range(n))
    assert mixing.permuted(np.arange(50), 50, 1).tolist() != mixing.permuted(np.arange(50), 50, 2).tolist()


def test_mix_against_plain_loops(spark):
    """Blocks, quotas, tree and permutation by plain lists over the same hashes."""
    docs = table(spark, [(i, f"t{i}", "en", None if i % 11 == 0 else "big" if i % 4 else "small") for i in range(500)])
    hashed = docs.select("doc_id", "source", F.xxhash64(F.lit(42), "doc_id", "text").alias("h")).collect()
    for options in ({"weights": {"big": 1, "small": 3, None: 1}}, {"temper": 0.5}, {"keep": 0.6}):
        by = {}
        for r in sorted(hashed, key=lambda r: r.h):
            by.setdefault("0" if r.source is None else "1" + r.source, []).append(r.doc_id)
        names = sorted(by)
        blocks = [-(-len(by[n]) // 4) for n in names]
        weight = [{"1big": 1, "1small": 3, "0": 1}[n] if "weights" in options else len(by[n]) ** 0.5 if "temper" in options else 1 for n in names]
        total = int(0.6 * sum(blocks)) if "keep" in options else int(min(b / w for b, w in zip(blocks, weight)) * sum(weight) + 1e-9)
        parts = mixing.split(mixing.quotas(blocks, weight, total), 6, 42)
        want = {}
        for i, n in enumerate(names):
            to = mixing.permuted(np.arange(blocks[i]), blocks[i], 43 + i)
            for b in range(blocks[i]):
                shard = next((k for k in range(6) if to[b] < sum(parts[: k + 1, i])), None)
                if shard is not None:
                    want |= {d: shard for d in by[n][4 * b : 4 * b + 4]}
        got = mixing.mix(docs, block_rows=4, shards=6, bucket_rows=50, **options).collect()
        assert {r.doc_id: r.shard for r in got} == want and len(got) == len(want)
        for k in range(6):
            assert sorted(r.position for r in got if r.shard == k) == list(range(sum(v == k for v in want.values())))


# 2
def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(300)] + [(7, None, None), (7, None, None), (None, "u", "<b>")], "page_id long, url string, html string")
    pages = pages.withColumn("file", F.lit(1)).withColumn("digest", F.lit("d"))
    whole = common.cut(warc.place(pages, file_records=16))
    assert whole.count() == 303 and whole.select("file", "slot").distinct().count() == 303
    assert warc.audit(whole, whole).count() == 0
    bad = common.cut(warc.place(pages.withColumn("html", F.when(F.col("page_id").isin(3, 200), "?").otherwise(F.col("html"))), file_records=16))
    want = rows(whole.join(bad.select("file", "slot", F.col("digest").alias("d")), ["file", "slot"]).where("digest <> d").select("file", "slot"))
    assert len(want) == 2 and rows(warc.audit(whole, bad)) == want
    short = common.cut(warc.place(pages.where("page_id < 290"), file_records=16))
    missing = whole.join(short, ["file", "slot"], "left_anti").select("file", "slot")
    assert set(rows(missing)) <= set(rows(warc.audit(whole, short)))
    empty = common.cut(warc.place(pages.limit(0)))
    assert warc.audit(empty, empty).count() == 0 and warc.audit(whole, empty).count() == 303


def made(spark, *pages):
    df = spark.createDataFrame([(i, f"http://{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [bytes(r[0]) for r in df.orderBy("page_id").select(warc.record(F.col("url"), F.col("html"))).collect()]


def read(spark, path):
    return [(r.uri, None if r.body is None else bytes(r.body).decode(), r.digest_ok, r.fault) for r in warc.read_warc(spark, str(path)).orderBy("file", "offset", "length").collect()]


def test_read_warc(spark, tmp_path):
    raw = made(spark, "<p>é</p>", "", "long " * 100_000)
    (tmp_path / "a.warc").write_bytes(b"".join(raw))
    whole = [("http://0", "<p>é</p>", True, None), ("http://1", "", True, None), ("http://2", "long " * 100_000, True, None)]
    assert read(spark, tmp_path / "a.warc") == whole
    got = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [r.offset for r in got] == [0, len(raw[0]), len(raw[0]) + len(raw[1])]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    assert read(spark, tmp_path / "b.warc.gz") == whole
    (tmp_path / "empty.warc").write_bytes(b"")
    assert read(spark, tmp_path / "empty.warc") == []


def test_read_damaged_warc(spark, tmp_path):
    a, b, c = made(spark, "<p>a</p>", "<p>b</p>", "<p>c</p>")
    good = {x: (f"http://{i}", f"<p>{x}</p>", True, None) for i, x in enumerate("abc")}
    name = tmp_path / "x.warc"

    def of(data):
        name.write_bytes(data)
        return read(spark, name)

    assert of(a + b + c[:-9])[:2] == [good["a"], good["b"]] and of(a + b + c[:-9])[2][3] == "record cut short"
    wrong = b.replace(b"Content-Length: 8", b"Content-Length: x")
    assert [r[3] for r in of(a + wrong + c)] == [None, "no valid Content-Length", None] and of(a + wrong + c)[2] == good["c"]
    assert [r[3] for r in of(a + b"rubbish\r\n" + c)] == [None, "no record", None]
    assert of(a.replace(b"<p>a", b"<p>z") + c) == [("http://0", "<p>z</p>", False, None), good["c"]]
    assert [r[3] for r in of(b"not a warc at all")] == ["no record"]
    za, zb, zc = (gzip.compress(x) for x in (a, b, c))
    crc = bytearray(zb)
    crc[-6] ^= 1
    assert of(za + bytes(crc) + zc) == [good["a"], good["b"], (None, None, None, "gzip member with another checksum"), good["c"]]
    assert of(za + zb + zc[:-20])[:2] == [good["a"], good["b"]] and of(za + zb + zc[:-20])[-1][3] == "gzip member cut short"
    body = bytearray(zb)
    body[10:40] = b"\xff" * 30
    got = of(za + bytes(body) + zc)
    assert got[0] == good["a"] and got[-1] == good["c"] and any(r[3] for r in got[1:-1])


def test_archives_are_compared(spark, tmp_path):
    raw = made(spark, *(f"<p>{i}</p>" for i in range(70)))
    for side in ("left", "right"):
        (tmp_path / side).mkdir()
        for k in (0, 1):
            mine = [gzip.compress(x) for x in raw[35 * k : 35 * k + 35]]
            if side == "right" and k == 1:
                mine[4] = gzip.compress(raw[39].replace(b"<p>3", b"<p>4"))
            (tmp_path / side / f"{k}.warc.gz").write_bytes(b"".join(mine))
    left, right = (warc.read_warc(spark, str(tmp_path / side)) for side in ("left", "right"))
    assert rows(warc.archive_audit(left, right)) == [("1.warc.gz", 4)] and warc.archive_audit(left, left).count() == 0


# 3
def test_bpe_equals_whole_encoding(spark, odd, none):
    enc = bpe.encoding(bpe.vocabulary())
    rng = random.Random(5)
    alphabet = ["a", "b", " ", "  ", "\n", "'s", "é", "日本", "7", "!?", "　", "\x1c", "​", "🙂", "<|endoftext|>", "I'll"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 30, 400, 3000]))) for _ in range(60)] + ["z" * 2000, " " * 900 + "a", "a b " * 500]
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in bpe.encode(docs, chunk=64, overlap=24).collect()}
    for i, t in enumerate(texts):
        assert got[i].tokens == enc.encode_ordinary(t) and got[i].exact and got[i].n_bytes == len(t.encode()), i
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == dict(enumerate(texts))
    out = bpe.encode(odd).collect()
    assert len(out) == 10 and sum(r.tokens is None for r in out) == 2
    assert all(r.exact for r in out if r.tokens is not None)
    assert [r.n_tokens for r in out if r.doc_id == 6] == [len(enc.encode_ordinary("x" * 150_000))]
    assert bpe.encode(none).count() == 0
    cut_ = " ".join(["x" * n + "'re it's" for n in range(40)]) * 3  # contractions across every chunk's end
    got = bpe.encode(table(spark, [(1, cut_, "en", "s")]), chunk=40, overlap=20).first()
    assert got.tokens == enc.encode_ordinary(cut_) and got.exact
    odd_tokens = spark.createDataFrame([(1, []), (2, None), (2, [65]), (2, [65])], "doc_id long, tokens array<int>")
    assert rows(bpe.decode(odd_tokens)) == rows(spark.createDataFrame([(1, ""), (2, None), (2, enc.decode([65])), (2, enc.decode([65]))], "doc_id long, text string"))
    with pytest.raises(Exception, match="no such token: 999999"):
        bpe.decode(spark.createDataFrame([(1, [999_999])], "doc_id long, tokens array<int>")).collect()


# 4
def brute_spans(texts, length):
    """Every window that a lesser document has, joined to spans."""
    first, cells = {}, []
    for i, t in sorted(texts.items()):
        w = t.split()
        for p in range(len(w) - length + 1):
            first.setdefault(tuple(w[p : p + length]), (i, p))
    for i, t in sorted(texts.items()):
        w, run = t.split(), None
        for p in range(len(w) - length + 1):
            fd, fp = first[tuple(w[p : p + length])]
            if fd < i:
                cells.append((i, fd, fp - p, p))
    out = []
    cells.sort()
    for k, g in itertools.groupby(enumerate(cells), lambda x: (x[1][:3], x[1][3] - x[0])):
        g = [c for _, c in g]
        out.append((k[0][0], g[0][3], len(g) + length - 1, k[0][1], g[0][3] + k[0][2]))
    return sorted(out)


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(60):
        segs = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 6))]
        flat, ends = np.array(sum(segs, []), np.uint32), np.cumsum([len(s) for s in segs])
        suffixes = sorted((tuple(s[p:]), n, int(e) - len(s) + p) for n, (s, e) in enumerate(zip(segs, ends)) for p in range(len(s)))
        assert suffix_dedup.suffix_array(flat, ends).tolist() == [x[2] for x in suffixes]


def test_common_prefixes():
    rng = random.Random(2)
    for _ in range(40):
        segs = [[rng.randrange(2) for _ in range(rng.randrange(1, 60))] for _ in range(rng.randrange(1, 5))]
        flat, ends = np.array(sum(segs, []), np.uint32), np.cumsum([len(s) for s in segs])
        left = np.concatenate([np.arange(len(s), 0, -1) for s in segs])
        sa = suffix_dedup.suffix_array(flat, ends)
        plain = [next((n for n in range(min(left[x], left[y])) if flat[x + n] != flat[y + n]), min(left[x], left[y])) for x, y in zip(sa, sa[1:])]
        assert suffix_dedup.common_prefixes(flat, left, sa, vector=3).tolist() == plain


def test_periodic_text_is_sorted_in_little_memory():
    import tracemalloc

    codes = np.tile(np.array([7, 3], np.uint32), 30_000)
    tracemalloc.start()
    sa = suffix_dedup.suffix_array(codes, np.array([60_000]))
    lcp = suffix_dedup.common_prefixes(codes, np.arange(60_000, 0, -1), sa)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert sa[:3].tolist() == [59_999, 59_997, 59_995] and lcp[:2].tolist() == [1, 3] and lcp.max() == 59_998


def test_rising_periods_are_sorted():
    """A word, or a row of words, over and over before a greater one: suffixes of the type sorted directly tie with the next, thousands of times."""
    for period in ([5], [3, 7], [2, 4, 6, 9], [4, 1, 4, 9]):
        codes = np.append(np.tile(np.array(period, np.uint32), 4000), np.array([10], np.uint32))
        sa = suffix_dedup.suffix_array(codes, np.array([len(codes)]))
        raw = codes.astype(">u4").tobytes()
        some = sa[:: len(sa) // 500]
        assert sorted(sa.tolist()) == list(range(len(codes))) and all(raw[4 * a :] < raw[4 * b :] for a, b in zip(some, some[1:]))
    rng = random.Random(23)
    for _ in range(60):
        segs = [([rng.randrange(3) for _ in range(rng.randrange(1, 5))] * 30)[: rng.randrange(1, 60)] for _ in range(rng.randrange(1, 5))]
        flat, ends = np.array(sum(segs, []), np.uint32), np.cumsum([len(s) for s in segs])
        suffixes = sorted((tuple(s[p:]), n, int(e) - len(s) + p) for n, (s, e) in enumerate(zip(segs, ends)) for p in range(len(s)))
        assert suffix_dedup.suffix_array(flat, ends).tolist() == [x[2] for x in suffixes]


def test_spans_of_rising_periods(spark):
    texts = {i: f"{'lone ' * (i % 3)}{'c ' * 2500}end{i // 2}" for i in range(1, 13)} | {20: "a b " * 1500 + "last", 21: "a b " * 1600 + "z"}
    got = suffix_dedup.repeated_spans(table(spark, [(i, t, "en", "s") for i, t in texts.items()]))
    assert sorted(map(tuple, got.collect())) == brute_spans(texts, 50)


def test_hot_minimizer_is_divided(spark):
    """A phrase in all documents, each time among other words, makes one group; divided, it gives the same spans."""
    rng = random.Random(21)
    phrase = words(rng, 6)
    texts = {i: " ".join([words(rng, 8), phrase, words(rng, 8)]) for i in range(40)}
    texts |= {40 + i: words(rng, 3) + " " + texts[i] for i in range(0, 40, 4)}
    docs = table(spark, [(i, t, "en", "s") for i, t in texts.items()])
    got = suffix_dedup.repeated_spans(docs, length=10, gram=3, hot_runs=8)
    assert sorted(map(tuple, got.collect())) == brute_spans(texts, 10)


def test_texts_that_share_an_id_keep_their_words(spark):
    rng = random.Random(22)
    a, b = words(rng, 70), words(rng, 70)
    docs = table(spark, [(1, a, "en", "s"), (2, a, "en", "s"), (2, b, "en", "s"), (2, a + " tail", "en", "s"), (2, a + " tail", "en", "s")])
    assert rows(suffix_dedup.stage(spark, docs, SF).select("doc_id", "text")) == sorted([(1, a), (2, b), (2, "tail"), (2, "tail")], key=repr)


def test_spans(spark, odd, none):
    rng = random.Random(9)
    shared = [words(rng, n) for n in (12, 30, 60)]
    texts = {i: " ".join([words(rng, rng.randrange(20)), rng.choice(shared), words(rng, 9), rng.choice(shared + [""]), "a a a a a a a a a a a a a a"][: rng.randrange(1, 6)]) for i in range(60)}
    got = suffix_dedup.repeated_spans(table(spark, [(i, t, "en", "s") for i, t in texts.items()]), length=10, gram=4)
    assert sorted(map(tuple, got.collect())) == brute_spans(texts, 10)
    assert {r.doc_id for r in suffix_dedup.repeated_spans(odd).collect()} == {2}
    assert suffix_dedup.repeated_spans(none).count() == 0
    left = suffix_dedup.stage(spark, odd, SF)
    assert left.columns == odd.columns and left.where("doc_id = 2").count() == 0 and left.count() == 9
    assert suffix_dedup.stage(spark, none, SF).count() == 0
    head, tail, body = "only here", "and the end", words(rng, 60)
    docs = table(spark, [(1, body, "en", "s"), (2, f"{head}\n{body}  {tail}", "en", "s")])
    assert rows(suffix_dedup.stage(spark, docs, SF).select("doc_id", "text"))[1] == (2, f"{head}\n{tail}")


# 5
def test_toxicity(spark, odd, none):
    rng = random.Random(2)
    marks = ["idiot", "moron", "scum", "stupid", "clown", "loser", "filth", "vermin"]
    clean = [(i, words(rng, 60), "en", "s") for i in range(300)]
    some = [(1000 + i, " ".join(words(rng, 15) + " " + w for w in rng.sample(marks, 1 + i % 6)), "en", "s") for i in range(120)]
    train = table(spark, clean + some)
    model = toxicity.train(train, spark.createDataFrame([(i, 1, int(i >= 1000)) for i, *_ in clean + some], "doc_id long, quality int, toxic int"))
    assert (np.diff(model.thresholds) > 0).all()
    fresh = [(1, words(rng, 300)), (2, words(rng, 300) + " Idiot! " + words(rng, 20)), (3, " ".join(marks)), (4, None), (5, ""), (6, "idiot moron scum stupid"), (6, "idiot moron scum stupid")]
    fresh = table(spark, [(i, t, "en", "s") for i, t in fresh])
    got = {r.doc_id: r for r in toxicity.severity(fresh, model).collect()}
    assert [got[i].toxic for i in range(1, 7)] == [False, True, True, False, False, True] and toxicity.severity(fresh, model).count() == 7
    assert got[3].severity > got[6].severity > got[2].severity > got[1].severity and got[3].grade == 2
    # severity follows the number of markers in texts that weren't trained on
    held = [(i, " ".join(words(rng, 10) + " " + w for w in rng.sample(marks, 1 + i % 6)), "en", "s") for i in range(60)]
    found = {r.doc_id: r.severity for r in toxicity.severity(table(spark, held), model).collect()}
    assert np.corrcoef([found[i] for i in range(60)], [1 + i % 6 for i in range(60)])[0, 1] > 0.8
    # by plain loops over words and stems, whose weights are looked up one by one
    weight = dict(zip(model.known.tolist(), model.weights))
    hash_of = lambda b: int(T.span_hash(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
    for i, text, *_ in held[:20]:
        n = Counter()
        for w in text.lower().encode().split():
            n[hash_of(w)] += 1
            for stem in toxicity.STEMS:
                if len(w) > stem:
                    n[int(T.mix64(np.array([hash_of(w[:stem])], np.uint64), stem)[0])] += 1
        z = sum(weight.get(f, 0) * math.log1p(k) for f, k in n.items())
        assert abs(found[i] - sum(1 / (1 + math.exp(c - z)) for c in model.thresholds)) < 1e-5
    tie = 1 / (1 + math.exp(model.thresholds[0]))  # of a text without features
    assert toxicity.severity(fresh.where("doc_id = 5"), model, toxic_from=tie).first().toxic
    assert toxicity.severity(odd, model).count() == 10 and toxicity.severity(none, model).count() == 0
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert toxicity.train(train, labels.limit(0)) is None and toxicity.train(none, labels) is None
    assert toxicity.severity(fresh, None).where("severity is not null").count() == 0


def test_toxicity_gradient():
    rng = np.random.Generator(np.random.Philox(3))
    n, width = 30, 7
    row, column = rng.integers(0, n, 90), rng.integers(0, width, 90)
    value, one, free = rng.random(90), toxicity.balanced(rng.integers(0, 3, n)), rng.normal(0, 0.4, width + 2)
    _, g = toxicity.loss(free, n, row, column, value, one, width, 0.1)
    for k in range(len(free)):
        up, down = free.copy(), free.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        slope = (toxicity.loss(up, n, row, column, value, one, width, 0.1)[0] - toxicity.loss(down, n, row, column, value, one, width, 0.1)[0]) / 2e-6
        assert abs(slope - g[k]) < 1e-6


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("pmod(xxhash64(doc_id, 77), 3) > 0"))
    held = labels.where("pmod(xxhash64(doc_id, 77), 3) = 0").select("doc_id", F.col("toxic").alias("truth"))
    right = toxicity.severity(docs.join(held, "doc_id"), model).join(held, "doc_id").groupBy("truth").agg(F.avg((F.col("toxic").cast("int") == F.col("truth")).cast("int")))
    shares = dict(map(tuple, right.collect()))
    assert shares[1] >= 0.85 and shares[0] >= 0.97, shares


# 6
def test_quality_against_plain_counts(spark, odd, none):
    """Scores from Counters of the n-grams themselves, which differ from hashed ones by rare collisions only."""
    rng = random.Random(17)
    texts = {i: words(rng, rng.randrange(1, 40), 300 if i % 3 else 900) for i in range(90)}
    docs = table(spark, [(i, t, "en", "s") for i, t in texts.items()])
    good = {i for i in texts if i % 3}
    trusted = spark.createDataFrame([(i,) for i in good], "doc_id long")
    by = quality.ratios(docs, trusted)
    assert np.array_equal(by, quality.ratios(docs, trusted, sent_ids=0))  # the shuffled way gives the same counts
    grams = {i: [(n, *w[k : k + n]) for n in (1, 2) for w in [t.split()] for k in range(len(w) - n + 1)] for i, t in texts.items()}
    raw, target = Counter(g for x in grams.values() for g in x), Counter(g for i in good for g in grams[i])
    whole, sum_, t = sum(raw.values()) + 0.5 * 2**quality.BITS, 0, sum(target.values())
    ratio = {g: math.log((target[g] / t + (n + 0.5) / whole) / 2) - math.log((n + 0.5) / whole) for g, n in raw.items()}
    got = {r.doc_id: r for r in quality.score(docs, by, 0.0).collect()}
    for i, x in grams.items():
        want = sum(ratio[g] for g in x) / len(x)
        sum_ += abs(got[i].score - want) < 1e-4
        assert got[i].n_grams == len(x) and got[i].keep == (got[i].score >= 0)
    assert sum_ >= 75  # some 2,500 n-grams in 2 ** 20 buckets: about three pairs of them collide
    tie = got[0].score
    assert quality.score(docs.where("doc_id = 0"), by, tie).first().keep  # an equal score is kept
    assert quality.score(odd, by, None).count() == 10 and quality.score(odd, by, None).where("score is null and not keep").count() == 4
    assert quality.score(none, by, 0.0).count() == 0 and not quality.ratios(none, trusted).any()
    alike = table(spark, [(1, "the quick brown foxes jumped", "en", "s"), (2, "zxq vvvvv kkkkk qqqqq xxxxxx", "en", "s")])
    taught = quality.ratios(alike, spark.createDataFrame([(1,)], "doc_id long"))
    assert [r.score > 0 for r in quality.score(alike, taught, None).orderBy("doc_id").collect()] == [True, False]


def test_quality_threshold(spark):
    assert quality.threshold_of([(0, 0, 5), (10, 1, 1), (20, 9, 0)]) == pytest.approx((11 + 20) / 2 * quality.STEP)  # cut above 10: 9/10 and 1, against 1 and 5/6
    assert quality.threshold_of([(0, 3, 0)]) is None and quality.threshold_of([]) is None
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trusted, held = quality.judged(labels)
    assert not {r[0] for r in trusted.collect()} & {r[0] for r in held.collect()} and held.count() > 50
    by = quality.ratios(docs, trusted)
    least = quality.threshold(docs, held, by)
    right = quality.score(docs, by, least).join(held, "doc_id").groupBy("good").agg(F.avg((F.col("keep") == F.col("good")).cast("int"))).collect()
    assert all(r[1] >= 0.9 for r in right) and len(right) == 2


# 7
def test_quality_counts_all_labels(spark):
    """All labelled documents are in the threshold, each scored by the others' target, and all good ones are in the target of the scores."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    known = quality.labelled(labels)
    agree = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.count_distinct("quality").alias("n")).where("n = 1")
    assert known.count() == agree.count() and {r[0] for r in known.select("fold").distinct().collect()} == set(range(quality.FOLDS))
    good = known.where("good")
    raw, target = quality.tallies(docs, good, quality.FOLDS)
    assert np.array_equal(target, quality.tallies(docs, good, quality.FOLDS, sent_ids=0)[1])
    assert np.array_equal(quality.ratio(raw, target.sum(0)), quality.ratios(docs, good.select("doc_id")))
    others = np.stack([quality.ratio(raw, target.sum(0) - t) for t in target])
    steps = Counter()
    for k in range(quality.FOLDS):
        by = quality.ratios(docs, good.where(F.col("fold") != k).select("doc_id"))
        assert np.array_equal(by, others[k])
        for r in quality.score(docs, by, None).join(known.where(F.col("fold") == k), "doc_id").where("score is not null").collect():
            steps[math.floor(r.score / quality.STEP), r.good] += 1
    want = quality.threshold_of([(s, steps[s, True], steps[s, False]) for s in {s for s, _ in steps}])
    assert quality.threshold(docs, known, others) == quality.threshold(docs, known, others, sent_labels=0) == want
    got = quality.query(spark, "/root/testdata/sf0.001")
    assert rows(got) == rows(quality.score(docs, quality.ratio(raw, target.sum(0)), want))


def test_shards(spark, odd, none):
    rng = random.Random(4)
    sizes = np.sort(np.array([rng.randrange(1, 5000) for _ in range(700)]))[::-1]
    sums, shard = sharding.partition(sizes, 8)
    assert np.array_equal(np.bincount(shard, sizes, 8).astype(int), sums) and sums.max() - sums.min() <= 10
    assert sorted(sharding.partition(np.array([8, 7, 6, 5, 4]), 2)[0].tolist()) == [14, 16]  # the textbook's example
    for k, n in ((2, 9), (5, 23), (8, 64), (7, 3)):  # the short form gives what plain differencing of whole vectors does
        few = np.sort(np.array([rng.randrange(1, 1000) for _ in range(n)]))[::-1]
        plain, _ = sharding.difference([np.array([0] * (k - 1) + [x]) for x in few])
        short, lane = sharding.partition(few, k)
        assert np.array_equal(np.bincount(lane, few, k).astype(int), short) and short.max() - short.min() == plain.max() - plain.min()
    groups = spark.createDataFrame([(str(i), int(s)) for i, s in enumerate(sizes)], "grp string, bytes long")
    out = sharding.shard_groups(groups, 8, bucket_groups=64, fan_in=3)  # 11 buckets: three levels
    by = [r[1] for r in out.groupBy("shard").agg(F.sum("bytes")).collect()]
    assert out.count() == 700 and len(by) == 8 and max(by) - min(by) <= 0.01 * sum(by) / 8
    deep = sharding.shard_groups(groups, lanes=4, shard_bytes=int(sizes.sum()) // 10)  # 16 shards in two levels
    by = [r[1] for r in deep.groupBy("shard").agg(F.sum("bytes")).collect()]
    assert deep.count() == 700 and len(by) == 16 and max(by) - min(by) <= 0.02 * sum(by) / 16
    twice = spark.createDataFrame([("a", 3), ("a", 4), (None, None), (None, 5)], "grp string, bytes long")
    assert rows(sharding.shard_groups(twice, 2).select("grp", "bytes")) == [("a", 7), (None, 5)]
    even = spark.createDataFrame([(c, 5) for c in "dbca"], "grp string, bytes long")  # equal sizes go by grp
    assert rows(sharding.shard_groups(even, 4)) == rows(sharding.shard_groups(even.orderBy("grp"), 4))
    got = sharding.shard_documents(odd, 3)
    assert got.count() == 10 and got.where("doc_id in (1, 2)").select("shard").distinct().count() == 1
    assert got.where("bytes > 0 or shard is not null").count() == 10
    assert sharding.shard_documents(none).count() == 0


# 8
def jaccards(texts):
    """Every pair of texts and the Jaccard similarity of their sets of adjacent words, by plain sets."""
    sets = {}
    for i, t in texts.items():
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())
        if w:
            sets[i] = set(zip(w, w[1:])) or {(w[0],)}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both:
            yield a, b, both / (len(sets[a]) + len(sets[b]) - both)


def test_near_duplicates(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pairs = list(jaccards(texts))
    got = {r.doc_id: r.keep_id for r in near_dedup.near_duplicates(docs, shard_rows=64).collect()}
    root = lambda i: got.get(i, i)
    sure = [(a, b) for a, b, j in pairs if j >= 0.8]
    assert sure and sum(root(a) == root(b) for a, b in sure) >= 0.97 * len(sure)
    group = {}
    for a, b, j in pairs:  # nothing is joined that isn't connected by true pairs
        if j >= near_dedup.JACCARD:
            group.setdefault(a, set()).add(b)
            group.setdefault(b, set()).add(a)
    for i, k in got.items():
        seen, todo = {i}, [i]
        while todo:
            for x in group.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        assert k in seen and k < i
    assert {(r.doc_id, r.keep_id) for r in near_dedup.near_duplicates(odd).collect()} == {(2, 1)}
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.stage(spark, odd, SF)
    assert kept.columns == odd.columns and kept.count() == 9 and kept.where("doc_id = 2").count() == 0
    assert near_dedup.stage(spark, none, SF).count() == 0


def test_texts_that_share_an_id(spark):
    """A document is an id and a text: nothing goes with a copy but the copy."""
    rng = random.Random(12)
    a, b = words(rng, 80), words(rng, 80)
    docs = table(spark, [(1, a, "en", "s"), (2, a, "en", "s"), (2, b, "en", "s"), (3, "?!", "en", "s"), (4, "?!", "en", "s"), (5, "", "en", "s"), (6, "", "en", "s"), (7, b + " more", "en", "s")])
    left = sorted((r.doc_id, r.text) for r in near_dedup.stage(spark, docs, SF).collect())
    assert left == [(1, a), (2, b), (3, "?!"), (5, "")]
    assert {(r.doc_id, r.keep_id) for r in near_dedup.near_duplicates(docs).collect()} == {(2, 1), (4, 3), (6, 5), (7, 2)}


def test_fingerprint_against_plain_loops():
    """Each bit is set where more than half of the distinct words have it; short words count, at every number of words."""
    for text in ("a b c", "a bb ccc dddd eeeee", "one", " ".join(f"word{i}" for i in range(700))):
        data = np.frombuffer(text.encode(), np.uint8)
        s, e, ptr = T.words(data, np.array([0, len(data)]), T.WORD)
        features, long, fptr = near_dedup.distinct_words(T.span_hash(data, s, e), e - s, ptr)
        assert len(features) == len(set(text.split())) and long.sum() == sum(len(w) >= 4 for w in set(text.split()))
        bits = np.unpackbits(np.stack([features, T.mix64(features, 7)], 1).view(np.uint8), axis=1)
        want = np.packbits([2 * sum(int(row[k]) for row in bits) > len(bits) for k in range(128)]).view(np.uint64)
        assert near_dedup.simhash(features, fptr)[0].tolist() == want.tolist()


def test_routes_are_audited(spark):
    """Copies that a routing by one poor key parts are found by the audit, which asks for more routes."""
    rng = random.Random(13)
    base = [words(rng, 60).split() for _ in range(60)]
    many = [(2 * i + k, " ".join(w if k == 0 else [f"n{i}", *w[:40], f"m{i}", *w[42:]]), "en", "s") for i, w in enumerate(base) for k in (0, 1)]
    got = near_dedup.near_duplicates(table(spark, many), routes=1, shard_rows=4).collect()
    assert len(got) >= 0.9 * len(base) and all(r.keep_id == r.doc_id - 1 for r in got)


def test_copies_of_a_hot_group(spark):
    """A shard far over its size is split, and its copies are found across the parts."""
    rng = random.Random(8)
    base = words(rng, 200).split()
    many = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(200)] = f"n{i}"
        many.append((i, " ".join(w), "en", "s"))
    got = near_dedup.near_duplicates(table(spark, many), shard_rows=16).collect()
    assert len(got) == 399 and {r.keep_id for r in got} == {0}


def test_reordered_text_hides_no_copy(spark):
    """A text of the same words in another order is as near as the true copy, and of lesser doc_id; it fails, and the copy is still found."""
    rng = random.Random(11)
    base = [f"word{i}x" for i in range(200)]
    other = rng.sample(base, 200)
    near = base[:100] + ["word999x"] + base[101:]
    docs = table(spark, [(i, " ".join(w), "en", "s") for i, w in enumerate((other, base, near))])
    assert {(r.doc_id, r.keep_id) for r in near_dedup.near_duplicates(docs).collect()} == {(2, 1)}


def test_only_candidates_texts_are_shuffled(spark):
    """Verification moves the texts of the edges' ends, not all; a map that is too small for the ids lets others through but loses none."""
    rng = random.Random(14)
    many = [(i, words(rng, 300), "en", "s") for i in range(600)]
    many[7] = (7, many[3][1] + " more", "en", "s")
    docs = table(spark, many).cache()
    assert docs.count() == 600
    ids = docs.where("doc_id % 5 = 0").select("doc_id")
    want = {r.doc_id for r in ids.collect()}
    for most_words, most in ((near_dedup.MOST_WORDS, 180), (1, 600)):
        got = [r.doc_id for r in near_dedup.among(docs.select("doc_id", "text"), ids, most_words).collect()]
        assert want <= set(got) and len(got) == len(set(got)) <= most
    assert near_dedup.among(docs, ids.limit(0)).count() == 0
    texts = docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("rep"), near_dedup.digest().alias("same"))
    edges = spark.createDataFrame([(3, 7), (3, 8)], "a long, b long")
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the ends were many
    try:
        before = shuffled()
        assert rows(near_dedup.verified(docs, texts, edges)) == [(3, 7)]
        moved = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert 0 < moved < sum(len(t) for _, t, *_ in many) / 8, moved


def test_scan_again_leaves_no_pair(spark):
    """Points that ask meet all points of their part but those of their component."""
    spread = spark.createDataFrame([(0, 0, i, i % 2, 0, True) for i in range(6)], "shard long, part int, node long, f0 long, f1 long, own boolean")
    asks = spark.createDataFrame([(0, 0, 1)], "shard long, part int, node long")
    label = spark.createDataFrame([(2, 1), (5, 4)], "node long, root long")
    assert rows(near_dedup.scan_again(spread, asks, label)) == [(0, 1), (1, 3), (1, 4), (1, 5)]


def test_a_failed_audit_leaves_no_pair(monkeypatch):
    """Where the searches miss what the audit sees, the part is scanned: each pair within the radius is in one tree."""
    rng = np.random.default_rng(31)
    base = rng.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    points = np.concatenate([base, base ^ np.uint64(1 << 5), base[:40] ^ np.uint64(7 << 9)])
    n = len(points)
    root = list(range(n))
    x, y = np.nonzero(near_dedup.distances(points, points) <= near_dedup.RADIUS)
    want = near_dedup._labels(near_dedup.forest(n, x, y, np.zeros(len(x)), root)[1])
    monkeypatch.setattr(near_dedup.Graph, "search", lambda self, queries, beam, *_, **__: np.full((len(queries), beam), near_dedup._BIG))
    a, b, tree = near_dedup.part_trees(np.arange(n), points, np.ones(n, bool))
    got = near_dedup._labels(near_dedup.forest(n, a, b, np.zeros(len(a)), list(range(n)))[1])
    assert len(a) == 340 and got.tolist() == want.tolist() and (got[a] == got[tree]).all()


def test_a_search_begins_at_its_own_place():
    """Points that no entry leads to, as copies link to each other, are found by each other."""
    points = np.random.default_rng(32).integers(0, 1 << 63, (200, 2), dtype=np.uint64)
    g = near_dedup.Graph(points)
    g.links[:] = -1
    g.links[101, 0], g.links[102, 0] = 102, 101
    found = g.search(g.points[[101, 102, 150]], 20, at=np.array([101, 102, -1]))
    assert {101, 102} <= set(found[0] & 0xFFFFFFFF) and {101, 102} <= set(found[1] & 0xFFFFFFFF) and not {101, 102, 150} & set(found[2] & 0xFFFFFFFF)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    root = list(range(90))
    for _ in range(90):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long")
    want = sorted(((i, r) for i, r in enumerate(root) if i != r), key=repr)
    assert rows(common.components(df)) == want == rows(common.components(df, small=0))
    assert common.components(df.limit(0)).count() == 0


# 9
def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()
    network = language_id.train(docs.where("doc_id % 2 = 0"), train_docs=300)
    held = docs.where("doc_id % 2 = 1 and n_chars > 200")
    right = language_id.identify(held, network).join(held.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("predicted")).cast("int"))).first()[0]
    assert right >= 0.97
    out = language_id.identify(odd, network).collect()
    assert len(out) == 10 and sum(r.predicted == "und" and not r.keep for r in out) == 3
    assert language_id.identify(none, network).count() == 0 and language_id.train(none) is None
    assert language_id.identify(odd, None).where("keep").count() == 0
    kept = language_id.stage(spark, odd, SF)
    clean = {r.doc_id: (r.text, r.lang) for r in docs.where("doc_id % 2 = 0 and n_chars > 300").limit(50).collect()}
    lost = docs.where("doc_id % 2 = 0").withColumn("lang", F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("lang"))).withColumn("keep", F.lit("x"))
    filled = {r.doc_id: (r.text, r.lang) for r in language_id.stage(spark, lost, SF).collect()}  # a missing language is found
    assert all(filled[i] == clean[i] for i in clean)
    assert kept.columns == odd.columns and kept.count() == sum(r.keep for r in language_id.identify(odd, language_id.train(odd)).collect())


def test_language_of_no_label(spark):
    """Random letters, digits and foreign scripts are rejected; short clean texts are kept."""
    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()
    network = language_id.train(docs.where("doc_id % 2 = 0"), train_docs=300)
    alphabets = {"letters": "abcdefghijklmnopqrstuvwxyz", "digits": "0123456789.,-#/", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "han": [chr(c) for c in range(0x4E00, 0x9FA5)]}
    made = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 9))) for _ in range(n))
    odd = table(spark, [(i, made(a, 12), "en", "s") for i, a in enumerate(list(alphabets.values()) * 25)])
    assert language_id.identify(odd, network).where("keep").count() == 0
    clean = [r.text.split()[:12] for r in docs.where("doc_id % 2 = 1 and n_chars > 200").limit(200).collect()]
    kept = language_id.identify(table(spark, [(i, " ".join(w), "en", "s") for i, w in enumerate(clean)]), network)
    assert kept.where("keep").count() >= 0.98 * len(clean)


def test_language_of_texts_against_plain_loops(spark):
    """A text's probabilities by tiling it, padding, convolving and averaging in plain loops; and the limit by its pairs one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = language_id.train(docs, train_docs=60)
    got = {r.doc_id: r for r in language_id.identify(docs.where("n_chars < 900"), network).collect()}
    for r in docs.where("n_chars < 900").limit(25).collect():
        raw = r.text.encode()
        total = np.zeros(len(network.labels))
        for a in range(0, len(raw), language_id.WINDOW):
            part = [int(language_id.CLASSES[b]) for b in raw[a : a + language_id.WINDOW]]
            e = network.embed[part + [language_id._PAD] * (language_id.WINDOW - len(part))].astype(float)
            top = []
            for w, f, b in zip(language_id.WIDTHS, network.filters, network.biases):
                top += [max(float((e[k : k + w, :, None] * f).sum((0, 1))[j] + b[j]) for k in range(len(e) - w + 1)) for j in range(language_id.FILTERS)]
            z = np.maximum(top, 0) @ network.out + network.out_bias
            total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(part)
        best = int(total.argmax())
        c = [27, *(int(language_id.PAIRED[language_id.CLASSES[b]]) for b in raw), 27]
        known = sum(float(network.pairs[best][x * 128 + y]) for x, y in zip(c, c[1:])) > 0
        assert got[r.doc_id].predicted == network.labels[best] and abs(got[r.doc_id].probability - total[best] / len(raw)) < 1e-4 and got[r.doc_id].keep == known
    even = language_id.Network(["a", "b"], network.embed, network.filters, network.biases, np.zeros((48, 2), np.float32), np.zeros(2, np.float32))
    assert {(r.predicted, r.probability) for r in language_id.identify(docs.limit(5), even).collect()} == {("a", 0.5)}  # of equal ones the first by name


def test_language_gradient():
    rng = np.random.Generator(np.random.Philox(2))
    k, p = 3, []
    for shape in [(128, language_id.EMBED), *((w, language_id.EMBED, language_id.FILTERS) for w in language_id.WIDTHS), *((language_id.FILTERS,) for _ in language_id.WIDTHS), (language_id.FILTERS * len(language_id.WIDTHS), k), (k,)]:
        p.append(rng.normal(0, 0.5, shape))
    c, target, weight = rng.integers(0, 100, (4, language_id.WINDOW)), np.array([0, 1, 2, 1]), np.array([1.0, 0.5, 2.0, 1.0])
    _, g = language_id.loss(p, c, target, weight)
    for q, x in enumerate(p):
        flat, back = x.reshape(-1), g[q].reshape(-1)
        for i in rng.integers(0, flat.size, 6):
            old, value = flat[i], []
            for step in (1e-6, -1e-6):
                flat[i] = old + step
                value.append(language_id.loss(p, c, target, weight)[0])
            flat[i] = old
            assert abs((value[0] - value[1]) / 2e-6 - back[i]) < 1e-5


def test_tables_equal_the_network():
    rng = np.random.Generator(np.random.Philox(1))
    x = rng.integers(0, 128, (8, language_id.WINDOW)).astype(np.uint8)
    net = language_id.fit(x, np.array([0, 1] * 4), ["a", "b"], epochs=1)
    top = []
    for w, f, b in zip(language_id.WIDTHS, net.filters, net.biases):
        e = net.embed[x]
        n = x.shape[1] - w + 1
        top.append((sum(e[:, k : k + n] @ f[k] for k in range(w)) + b).max(1))
    z = np.maximum(np.concatenate(top, 1), 0) @ net.out + net.out_bias
    z = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(net.probabilities(x), z / z.sum(1, keepdims=True), atol=1e-4)


# 10
def brute_neighbours(ids, x, k=10):
    far = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 6)
    np.fill_diagonal(far, np.inf)
    return {i: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (far[n, j], ids[j])) if np.isfinite(far[n, j])][:k] for n, i in enumerate(ids)}


def test_neighbours(spark):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = neighbours.neighbours(emb, list_rows=32, bucket_rows=100, every=2)
    ids, x = zip(*((r.vec_id, r.embedding) for r in emb.orderBy("vec_id").collect()))
    true = brute_neighbours(ids, np.array(x, np.float64))
    found = {}
    for r in got.collect():
        found.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id))
    assert all(sorted(k for k, _ in v) == list(range(1, 11)) for v in found.values()) and set(found) == {i for i in ids if i % 2 == 0}
    assert sum(len(set(true[i]) & {b for _, b in v}) for i, v in found.items()) >= 0.9 * 10 * len(found)


def test_neighbours_exactly(spark):
    """With all lists visited and all measured it is brute force; the query's set is the ids divisible by 100."""
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    ids, x = zip(*((r.vec_id, r.embedding) for r in emb.orderBy("vec_id").collect()))
    true = brute_neighbours(ids, np.array(x, np.float64))
    got = {}
    for r in neighbours.neighbours(emb, rerank=10_000, recall=1.0).orderBy("rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbour_id)
    assert got == {i: v for i, v in true.items() if i % 100 == 0} and got


def test_neighbours_of_many_copies(spark):
    """Equal vectors, many more than are reranked, come by id; a list fuller than a bucket lies in parts."""
    rng = np.random.Generator(np.random.Philox(9))
    x = np.round(rng.normal(size=(900, 8)), 3)
    x[300:600] = x[300]
    ids = rng.permutation(900)
    emb = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    found = {}
    for r in neighbours.neighbours(emb, rerank=16, every=1, bucket_rows=128).collect():
        found.setdefault(r.vec_id, {})[r.rank] = r.neighbour_id
    copies = sorted(ids[300:600].tolist())
    for i in copies:
        assert [found[i][n] for n in range(1, 11)] == [c for c in copies[:11] if c != i][:10]


def test_audit_raises_rerank(spark):
    rng = np.random.Generator(np.random.Philox(10))
    x = rng.normal(size=(600, 16)).astype(np.float32)
    rows_ = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = neighbours.Index(np.zeros((1, 16), np.float32), [rng.normal(size=(64, 16)).astype(np.float32)])  # few codewords: codes tell little
    stored, where = neighbours.store(rows_, index, 16)
    probes, rerank = neighbours.audit(rows_, stored, where, index, 16, 10, 10)
    assert probes == 1 and rerank > 10


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    some = [(1, v), (1, v), (2, v), (3, [5.0, 5.0, 5.0, 5.0]), (None, v), (4, None), (5, []), (6, [1.0]), (9, [3.0]), (7, [float("nan")] * 4), (8, [None, 1.0, 1.0, 1.0])]
    emb = spark.createDataFrame(some, "vec_id long, embedding array<float>").withColumn("list", F.lit(0)).withColumn("bucket", F.lit(0)).withColumn("codes", F.lit("c"))
    got = rows(neighbours.neighbours(emb, every=1).select("vec_id", "rank", "neighbour_id", "distance"))
    assert [r[:3] for r in got] == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2), (6, 1, 9), (9, 1, 6)] and got[0][3] == 0
    assert neighbours.neighbours(emb.limit(0)).count() == 0
    assert neighbours.neighbours(emb.where("vec_id = 3")).count() == 0


def test_shared_folder_must_be_set_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        common.shared(Session())


def test_encoder_is_the_public_one():
    assert isinstance(bpe.encoding(bpe.vocabulary()), tiktoken.Encoding) and os.path.exists(bpe.VOCABULARY)
