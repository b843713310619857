"""Tables, the shared folder, and graph components over DataFrames."""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of `documents`, which every stage of the pipeline but the last returns.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


#: Edges that the driver may join to components itself: 4 MB of them.
SMALL_EDGES = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where that is unset, and Spark runs in this process alone (tests), a temporary folder is
    used; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="chatloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet to a folder of its own in the shared folder, and read again; and that folder."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def in_order(docs: DataFrame, *names: str) -> DataFrame:
    """The columns `names` of docs, and place: the row's number from 0 on in the order in which the files of docs hold the rows. Where docs aren't read from files, places ascend as the rows come, with gaps."""
    try:
        held = docs.metadataColumn("_metadata")
        rows = docs.select(*names, held["file_path"].alias("_file"), held["row_index"].alias("_row"))
    except AnalysisException:
        return docs.select(*names, F.monotonically_increasing_id().alias("place"))
    # by length first, as the numbers in the names of many files do not all have five digits
    counts = sorted(rows.groupBy("_file").count().collect(), key=lambda r: (len(r[0]), r[0]))
    ahead = [0, *itertools.accumulate(r[1] for r in counts)]
    begins = docs.sparkSession.createDataFrame([(r[0], n) for r, n in zip(counts, ahead)], "_file string, _begin long")
    return rows.join(F.broadcast(begins), "_file").select(*names, (F.col("_begin") + F.col("_row")).alias("place"))


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sliced(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over slices of `rows` rows. At the end, memory that the worker has freed goes back to the system, as Spark keeps the worker for other stages."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b.slice(a, rows) for b in batches for a in range(0, b.num_rows, rows))
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return over


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60, small: int = SMALL_EDGES) -> DataFrame:
    """(node, root) of every node in edges that isn't the least of its connected component.

    Alternates large-star and small-star steps, each a shuffle of the edges, until the stars no
    longer change. Every round is checkpointed, so a lost executor costs no more than one round.
    `small` edges at most (16 bytes each) are joined by the driver instead, with the same result.
    """
    e = cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct())
    if e.count() <= small:
        t = e.toArrow()
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for u, v in zip(t["u"].to_pylist(), t["v"].to_pylist()):
            u, v = top(u), top(v)
            root[max(u, v)] = min(u, v)
        rows = [(x, top(x)) for x in list(root)]
        found = pa.table({"node": pa.array([x for x, r in rows if x != r], pa.int64()), "root": pa.array([r for x, r in rows if x != r], pa.int64())})
        return e.sparkSession.createDataFrame(found)
    last = None
    for _ in range(most):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if tuple(now) == last and now[0] == now[2]:
            break
        last = tuple(now)
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
