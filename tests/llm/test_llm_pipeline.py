"""The pipeline and the SQL of the queries that have one."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatloom.llm import bpe, common, language_id, mixing, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*(f"`{c}`" for c in columns)).collect())) == sorted(cur.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r[0] for r in now.select("doc_id").collect()}
        now, _ = common.stored(stage(spark, now, SF), name)
        assert now.columns == docs.columns
        assert {r[0] for r in now.select("doc_id").collect()} <= before
        assert now.count() == now.select("doc_id").distinct().count()
        if name == "language_id":
            kept = language_id.identify(docs, language_id.train(docs)).where("keep")
            assert {r.doc_id for r in kept.collect()} == {r[0] for r in now.select("doc_id").collect()}
        if name == "near_dedup":
            assert now.select(F.md5("text")).distinct().count() == now.count()
    enc = bpe.encoding(bpe.vocabulary())
    last = {r.doc_id: r.tokens for r in corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()}
    assert last == {r.doc_id: enc.encode_ordinary(r.text) for r in now.collect()}
    assert set(last) <= set(texts)
    whole = {r.doc_id: r.tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == last


def test_a_word_repeated_thousands_of_times_passes_stage_3(spark):
    """Before words greater and lesser than it: the suffixes of the repeats tie with each other."""
    texts = [(i, f"{'lone ' * i}{'c ' * 2500}end{i // 2}") for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["suffix_dedup"](spark, docs, SF).collect()}
    assert left[0] == texts[0][1] and all("c c" not in t for i, t in left.items() if i)


def test_the_mix_orders_the_result(spark, monkeypatch):
    """The places of the last stage are those of the mix: shard by shard, each in its order; long texts and repeats have theirs, too."""
    monkeypatch.setattr(mixing, "SHARD_ROWS", 16)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = docs.orderBy(F.desc("n_chars"), "doc_id").limit(3).withColumn("text", F.repeat("text", 4))
    docs = docs.union(long).union(long.limit(1)).union(long.limit(1).withColumn("text", F.lit("x" * 40_000)))
    docs = common.stored(docs, "docs")[0]
    spots = {}
    for r in mixing.placed(docs).select("row.doc_id", "shard", "position").collect():
        spots.setdefault(r.doc_id, []).append((r.shard, r.position))
    mixed, _ = common.stored(mixing.stage(spark, docs, SF), "mixing")
    got = bpe.stage(spark, mixed, SF).orderBy("place").collect()
    assert [r.place for r in got] == list(range(docs.count())) and max(r.n_bytes for r in got) > bpe.CHUNK + bpe.OVERLAP
    shards = {}
    for r in got:
        shards.setdefault(next(s for s, p in spots[r.doc_id] if p == len(shards.get(s, ()))), []).append(r)
    assert len(shards) > 8 and [r.place for rs in shards.values() for r in rs] == list(range(len(got)))
    plain, _ = common.stored(docs, "plain")
    assert [r.doc_id for r in bpe.stage(spark, plain, SF).orderBy("place").collect()] != [r.doc_id for r in got]
    assert bpe.stage(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), SF).first().n_tokens == 2


def test_pipeline_on_an_odd_table(spark, tmp_path):
    """Nulls, empties, repeats, ids that texts share and names that clash, through all stages."""
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and n_chars between 700 and 3000").orderBy("doc_id").limit(12).collect()
    a, b, c, d = (base[i].text for i in (2, 5, 6, 7))
    more = [(100 + i, r.text, r.lang, "s") for i, r in enumerate((base[8], base[10]))]
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (2, b, None, None), (2, b, None, None), (3, None, "en", "s"), (None, None, None, None), (None, c, "en", "s"), (4, "", "en", "s"), (5, d, " ", ""), (6, "zzqx wkqj xxqz qqzw", "en", "s"), *more]
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for n, name in enumerate(("row", "Shard", "position", "key", "same", "node", "keep", "predicted", "digest", "named")):
        docs = docs.withColumn(name, F.lit(n) + F.coalesce("doc_id", F.lit(0)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now, _ = common.stored(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
        assert all(r.position == 2 + (r.doc_id or 0) and r.Shard == 1 + (r.doc_id or 0) for r in now.collect())
    left = sorted(((r.doc_id or 0, r.text, r.lang) for r in now.collect()))
    assert left == sorted([(0, c, "en"), (1, a, "en"), (2, b, "en"), (2, b, "en"), (5, d, "en"), *((i, t, lang) for i, t, lang, _ in more)])
    enc = bpe.encoding(bpe.vocabulary())
    got = sorted((r.doc_id or 0, r.tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted((i, enc.encode_ordinary(t)) for i, t, _ in left)
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
