"""What the text operators share: reading, folds, checkpoints and Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables. Only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; where none is named, one of our own, and that only on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and context.master.split("[")[0] != "local":
            raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that lost executors cost no recomputation of what came before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def least_hashes(rows: DataFrame, n: int, slices: int = 200) -> set[tuple[str, int]]:
    """rows: k and h. For each k about n different h: the least of each of the slices, so that no k has a task of its own."""
    order = Window.partitionBy("k", F.pmod("h", F.lit(slices))).orderBy("h")
    found = rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= -(-n // slices))
    return {(r["k"], r["h"]) for r in found.select("k", "h").collect()}


def texts_of(docs: DataFrame, text: str, hashes: set[int], chars: int) -> dict[int, str]:
    """The first chars characters of the texts with these hashes, of a bounded number: each task passes on one row of a text."""
    if not hashes:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(hashes))

    def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = set(shared.value)
        for b in batches:
            at = []
            for i, h in enumerate(b.column(0).to_pylist()):
                if h in left:
                    left.remove(h)
                    at.append(i)
            if at:
                yield b.take(pa.array(at))

    rows = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.substring(text, 1, chars).alias("text"))
    return {r["h"]: r["text"] for r in rows.mapInArrow(first_of_each, "h long, text string").dropDuplicates(["h"]).collect()}


def bounded_sample(docs: DataFrame, key: str, text: str, n: int, chars: int) -> dict[str, list[str]]:
    """For each value of key (as text) about n different texts' first chars characters, whatever the input's size. No text is shuffled but those."""
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.xxhash64(text).alias("h"))
    wanted = least_hashes(rows, n)
    texts = texts_of(docs.where(F.col(key).isNotNull()), text, {h for _, h in wanted}, chars)
    out: dict[str, list[str]] = {}
    for k, h in sorted(wanted):
        if h in texts:
            out.setdefault(k, []).append(texts[h])
    return out


def stored(df: DataFrame, what: str, lasting: bool = False) -> DataFrame:
    """Write to the shared folder as Parquet and read again: lineage ends there, and later reads take only the columns they need. A lasting table outlives scratch."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _shelves and not lasting:
        _shelves[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shelves: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored within are deleted at its end, but for lasting ones."""
    paths: list[str] = []
    _shelves.append(paths)
    try:
        yield
    finally:
        _shelves.remove(paths)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(conf).delete(at, True)


def spare(taken: list[str], name: str) -> str:
    """A column name that none of those taken is, whatever its case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def give_back() -> None:
    """Return a worker's free memory to the system at a task's end: workers live on, and the next stage's tasks need it beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems than glibc do so themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)
