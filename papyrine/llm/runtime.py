"""Shared plumbing of the training-data operators: shared storage, Arrow batches, size-checked joins."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch at most. Documents are a few kB on average, so a batch stays at a few MB.
BATCH_ROWS = 1000
#: Bytes of one Arrow batch at most, for very long documents.
BATCH_BYTES = 16 << 20
#: A join side is broadcast only if it was counted and has no more rows than this (times its row width).
BROADCAST_BYTES = 48 << 20
#: attach_parts: so many broadcasts at most in one join.
PARTS = 8
#: Intermediate tables between two collections of the driver's heap, and their number so far.
GC_TABLES, _tables = 16, 0


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches of this session by rows and by bytes, and has shuffle files deleted when their query ends:
    an operator runs many queries one after the other, whose files would otherwise stay until the driver's heap is
    collected."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def trimmed(blocks: Callable) -> Callable:
    """A function over Arrow batches that gives memory back to the system when its task ends. Workers are used again by
    later tasks, and what one operator has freed would otherwise count against the next one's."""

    @wraps(blocks)
    def run(batches):
        try:
            yield from blocks(batches)
        finally:
            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def sliced(batches: Iterator, rows: int) -> Iterator:
    """The batches in pieces of `rows` rows, so that what is made of a piece's texts can go before the next one's."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one if driver and
    executors are one process, as in tests; otherwise an error, since executors could not read each other's files."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    sc = spark.sparkContext
    if (set_dir := sc._jsc.sc().getCheckpointDir()).isDefined():
        return set_dir.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="papyrine-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def tables_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; it goes when the driver ends, or by sweep()."""
    path = f"{shared_dir(spark)}/papyrine/{spark.sparkContext.applicationId}"
    fs, p = _filesystem(spark, path)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def sweep(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application. Results that are not yet written elsewhere read them."""
    fs, p = _filesystem(spark, tables_dir(spark))
    fs.delete(p, True)


def _collect(spark: SparkSession) -> None:
    """Has the driver's heap collected after every GC_TABLES tables: plans and broadcasts of queries that have ended would
    otherwise fill it up to its limit, and stay there, since an operator runs many short ones."""
    global _tables
    _tables += 1
    if _tables % GC_TABLES == 0:
        gc.collect()
        spark._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._papyrine_path = path
    _collect(spark)
    return out


def release(*dfs: DataFrame) -> None:
    """Deletes tables that materialize() wrote and nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_papyrine_path", None)
        if path:
            fs, p = _filesystem(df.sparkSession, path)
            fs.delete(p, True)


def attach(big: DataFrame, small: DataFrame, key: str | list[str], rows: int, row_bytes: int, how: str = "left", salts: int = 16) -> DataFrame:
    """Joins big to small, which has `rows` rows, one for each key.

    small is broadcast if its counted size is within BROADCAST_BYTES. Otherwise keys of big are salted, so that one
    key with a third of all rows is dealt to `salts` tasks, and small is repeated once for each salt. salts=1 is for keys
    that no large part of the rows can share.
    """
    keys = [key] if isinstance(key, str) else key
    if rows * row_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), keys, how)
    if salts == 1:
        return big.join(small, keys, how)
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def attach_parts(big: DataFrame, small: DataFrame, key: str, rows: int, row_bytes: int, how: str = "left") -> DataFrame:
    """As attach, for a big side with whole texts, which would fill the disk if they were shuffled.

    Where small is too large for one broadcast, keys are dealt into parts by hash, big is read once for each part, and each
    part of small is broadcast; beyond PARTS of them both sides are shuffled.
    """
    parts = -(-rows * row_bytes // max(1, BROADCAST_BYTES))
    if parts <= 1 or parts > PARTS:
        return attach(big, small, key, rows, row_bytes, how, salts=1)
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    return reduce(DataFrame.union, [big.where(part == i).join(F.broadcast(small.where(part == i)), key, how) for i in range(parts)])


def attach_counted(big: DataFrame, small: DataFrame, keys: list[str], rows: int, row_bytes: int, often: int = 20_000) -> DataFrame:
    """Inner join of big to small, one row for each key, whose column `copies` says how many rows of big have the key.

    small is broadcast if its counted size allows. Otherwise keys with over `often` rows, at most one for each `often` rows
    of big, are joined by broadcast, and the rest, of bounded size each, by shuffle; nothing is repeated.
    """
    if rows * row_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small.drop("copies")), keys, "inner")
    hot, cold = small.where(F.col("copies") > often).drop("copies"), small.where(F.col("copies") <= often).drop("copies")
    n = hot.count()
    if not n:
        return big.join(cold, keys, "inner")
    if n * row_bytes > BROADCAST_BYTES:
        return attach(big, small.drop("copies"), keys, rows, row_bytes, "inner")
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "inner")
    return big.join(F.broadcast(hot), keys, "inner").unionByName(rest)
