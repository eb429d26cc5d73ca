"""Helpers that the training-data operators share: tables, scratch space, components, words."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words: space, and tab to carriage return. ``bytes.split()`` uses the same set.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a session in one process gets a local one; a cluster must name its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='lineloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Paths of the tables stored in the innermost ``scratch`` of this thread, None outside.
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage. The table goes when the session's JVM ends, or with the ``scratch`` it is made in."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lineloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes the tables stored within at its end, but for those stored by the function it gives, and lets their shuffle files go.

    What outlives the block must read tables so stored alone.
    """
    outer, mine = _made.get(), []
    token = _made.set(mine)

    def kept(df: DataFrame, tag: str) -> DataFrame:
        inner = _made.set(outer)
        try:
            return stored(df, tag)
        finally:
            _made.reset(inner)

    try:
        yield kept
    finally:
        _made.reset(token)
        for path in mine:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        freed(spark)


def freed(spark: SparkSession) -> None:
    """Shuffle files of plans that nobody holds any more go when the JVM collects their handles, which may be long after the disk is full; this asks for it now."""
    gc.collect()
    spark._jvm.System.gc()


#: A sieve has so many words of 64 bits, whatever the number of keys.
_SLOTS = 1 << 18


def sieved(df: DataFrame, column: str, keys: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag`` that is true on all rows whose ``column`` is among the bigints of ``keys`` (its one column), and on few others.

    The sieve is a bitmap of hashes of bounded size, so it may be broadcast however many keys there are; the more, the more other rows are
    flagged. Rows that are not need no shuffle to tell that they have no partner.
    """

    def place(c: Column) -> tuple[Column, Column]:
        h = F.xxhash64(F.lit(64), c.cast("bigint"))
        return F.pmod(h, F.lit(_SLOTS)).cast("bigint"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int")

    slot, bit = place(F.col(keys.columns[0]))
    words = keys.select(slot.alias("_slot"), bit.alias("_bit")).groupBy("_slot").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit"))).alias("_bits"))
    slot, bit = place(F.col(column))
    at = df.withColumn("_at", slot).withColumn("_bit", bit).join(F.broadcast(words), F.col("_at") == F.col("_slot"), "left")
    hit = F.call_function("shiftrightunsigned", F.col("_bits"), F.col("_bit")).bitwiseAND(F.lit(1).cast("bigint")) == 1
    return at.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(hit, F.lit(False)).alias(flag))


def sifted(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is among ``keys``, and few others; see ``sieved``."""
    return sieved(df, column, keys, "_hit").where("_hit").drop("_hit")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            yield fn(batch)

    return run


def crc32_of_id(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has two non-null bigint columns. Returns (node, component): for each node that an edge
    touches, the smallest node of its component. Each round shuffles the current edges, which never grow
    in number of nodes, and ends in a reliable checkpoint. The rounds grow with the logarithm of the
    longest path. An empty input gives an empty result.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    # the mark of a state: equal marks mean that the round changed nothing
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # large star: every larger neighbour of u is tied to the least of u and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low).distinct()
        now = cut(small)
        last, seen = seen, mark(now)
        del both, least, large, low, small
        freed(edges.sparkSession)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
