"""What the operators share: shared-folder tables, joins on hot keys, and Arrow
maps over texts."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir.  In local mode, where
    driver and executors are one, a temporary folder serves if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="weft-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: later stages start from
    files that outlive any executor, and nothing above is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written() tables that no later plan reads, and has the driver's JVM
    let go of finished plans, so that their shuffle files are deleted, too."""
    for table in tables:
        path = getattr(table, "_weft_path", None)
        if path:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    if tables:
        settle(tables[0].sparkSession)


def settle(spark: SparkSession) -> None:
    """Has the driver's JVM let go of finished plans: their shuffle files go."""
    spark.sparkContext._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage and give freed heap back to
    the system: what a stage with large shuffles leaves of a heap is missing beside
    it when the next stage's Python workers start.  One small task a core, with a
    full collection each; the scheduler deals them over the executors."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between
    tasks and stages, and what they keep adds up beside the JVM's memory."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """fn over the Arrow batches of df, batch by batch.  A batch is bounded by
    spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
                release()

    return df.mapInArrow(run, schema)


#: Bytes that are broadcast at most.
BROADCAST_BYTES = 16 << 20


def _width(f: T.StructField) -> Column:
    c = named(f.name)
    if isinstance(f.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(f.dataType, T.ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) * 8 + 24
    return F.lit(8)


def few(df: DataFrame) -> DataFrame:
    """df (written; of numbers, strings, and arrays of numbers), to be broadcast if
    it has at most BROADCAST_BYTES; else the join that it stands in is shuffled."""
    fixed = {T.LongType, T.IntegerType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType}
    if {type(f.dataType) for f in df.schema.fields} <= fixed:
        return F.broadcast(df) if df.count() * 8 * (1 + len(df.columns)) <= BROADCAST_BYTES else df
    width = F.lit(8)
    for f in df.schema.fields:
        width = width + _width(f)
    return F.broadcast(df) if (df.agg(F.sum(width.cast("bigint"))).first()[0] or 0) <= BROADCAST_BYTES else df


#: A key is hot with this share of a table's rows (so there are at most so many
#: hot keys), and HOT_ROWS rows; its rows are dealt over SALTS tasks.
HOT_SHARE, HOT_ROWS, SALTS = 1_000, 2_000, 64


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys) of the hot keys of df (written): HOT_SHARE rows at most."""
    least = max(HOT_ROWS, df.count() // HOT_SHARE + 1)
    return df.groupBy(*keys).count().where(F.col("count") >= least).select(*keys)


def salted(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, hot: DataFrame) -> DataFrame:
    """left.join(right, on, how), where left's rows of hot keys (of some of the
    columns in on) go to SALTS tasks each, and right's to all of them."""
    keys, mark = hot.columns, F.broadcast(hot.withColumn("__hot", F.lit(True)))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    every = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    dealt = left.join(mark, keys, "left").withColumn("__salt", salt).drop("__hot")
    copied = right.join(mark, keys, "left").withColumn("__salt", every).drop("__hot")
    return dealt.join(copied, [*on, "__salt"], how).drop("__salt")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def lists(values: pa.Array, bounds) -> pa.ListArray:
    """A list column from flat values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
