"""Shared plumbing: table reading, Arrow batches, checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python objects at a time; bounds a worker's memory, not the result.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def trim() -> None:
    """Give freed memory back: a worker outlives its task and shares its executor with others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its own counsel
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trim()


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], dict], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """mapInArrow over bounded slices; `each` gives a dict of columns for one slice."""
    target = to_arrow(schema)
    small_batches(df.sparkSession)

    def run(batches):
        for part in slices(batches, rows):
            got = each(part)
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def to_arrow(schema: str) -> pa.Schema:
    """An Arrow schema for a flat DDL string of the types above."""
    return pa.schema([pa.field(n, _TYPES[t]) for n, t in (x.split() for x in schema.split(","))])


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode, where the session names none."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="scriptoria-"))
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


class Scratch:
    """Tables written to a folder of their own below the shared one, which cuts their lineage.

    `drop` removes a table that nothing needs any more; what is left goes when the driver ends, as a
    result that is read later may still need it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.tables = spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}", []
        atexit.register(self.clear)

    def keep(self, df: DataFrame) -> DataFrame:
        path, schema = f"{self.folder}/{len(self.tables)}", df.schema
        df.write.parquet(path)
        del df  # else the plan, and with it the shuffle files, would outlive the collection
        release(self.spark)
        self.tables.append((self.spark.read.schema(schema).parquet(path), path))
        return self.tables[-1][0]

    def remove(self, path: str) -> None:
        """Remove a folder that was written beside the tables."""
        self._delete(path)

    def drop(self, *tables: DataFrame) -> None:
        for table, path in self.tables:
            if any(table is t for t in tables):
                self._delete(path)

    def clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            self._delete(self.folder)

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the frame does not have, by any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def row_digest(df: DataFrame) -> Column:
    """64 bits of all columns of a row; maps, which have no hash, as JSON."""
    plain = lambda f: "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()
    name = lambda f: F.col("`" + f.name.replace("`", "``") + "`")
    return F.xxhash64(*(name(f) if plain(f) else F.to_json(F.struct(name(f))) for f in df.schema), *(name(f).isNull() for f in df.schema))


def text_key(text: str) -> tuple[Column, Column]:
    """128 bits of a text, computed in the JVM; null and empty texts differ."""
    return F.xxhash64(F.col(text).isNull(), F.col(text)), F.xxhash64(F.lit(71), F.col(text))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage there.

    The shuffle files behind it are of no more use. Spark's cleaner removes them when the driver's garbage
    is collected, which a driver with little to do puts off; so it is asked for here.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    del df  # else the plan, and with it the shuffle files, would outlive the collection
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner remove the shuffle files of finished steps whose plans nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch, where whole texts go through Python: bounds the workers' memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
