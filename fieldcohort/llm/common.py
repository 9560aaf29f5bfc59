"""What the operators of this subpackage share: the shared folder, staged tables, Arrow slices."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python operator works on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder if all of Spark is one process (tests); on a cluster an error, since each
    executor would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fieldcohort-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Bytes of the batches that Spark hands to Python while a table is staged (its default is 64 MB).
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Bound Spark's Arrow batches for what runs inside, so that long texts do not pile up in executors; the session's own
    value is there again afterwards."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf
    explicit, before = name in conf.getAll, conf.get(name)
    conf.set(name, str(most))
    try:
        yield
    finally:
        conf.set(name, before) if explicit else conf.unset(name)


_open = threading.local()


def staged(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: the lineage ends there, and losing an executor
    costs no recomputation of what stands above.

    Inside ``passing`` the table is removed at the end, unless a result needs it longer (``keep``); then it belongs to the
    ``passing`` around that one, if there is one.  Tables that a returned DataFrame reads stay in the folder."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, tag)
    if len(levels := getattr(_open, "levels", ())) > 1:
        levels[-2 if keep else -1].append(path)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the tables that were staged inside."""
    levels = _open.__dict__.setdefault("levels", [[]])
    levels.append([])
    try:
        yield
    finally:
        for path in levels.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if len(levels) == 1:
            levels[0].clear()


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task and would keep it beside the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts, or lists of 8-byte numbers, of a slice have about ``most`` bytes (one row at least).

    Spark's batches have up to 64 MB unless the session says otherwise; what Python makes of a slice is bounded by this."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        length = pc.multiply(pc.list_value_length(col).cast(pa.int64()), 8) if pa.types.is_list(col.type) else pc.binary_length(col)
        sizes = np.asarray(pc.fill_null(length, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def open_file(uri: str):
    """A file below the shared folder, opened for reading where a task runs: by the system where it is local or mounted there,
    by Arrow's file systems elsewhere."""
    if local := local_path(uri):
        return open(local, "rb")  # noqa: SIM115
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    return store.open_input_file(inner)


def local_path(uri: str) -> str | None:
    """The path of a local file, of a name with or without scheme; None for other file systems."""
    return re.sub(r"^file:/*", "/", uri) if re.match(r"file:|/", uri) else None


def within(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has ``rows`` rows at most; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


#: Ids up to which a table of ids is broadcast; a long each, some 32 MB as a hash table.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``ids`` (id); rows without doc_id stay.

    Up to BROADCAST_IDS ids are broadcast, so that the texts stay where they are; beyond that both sides are shuffled."""
    gone = staged(ids.where("id is not null").select(F.col("id").alias("__gone")).distinct(), tag, keep=True)
    gone = F.broadcast(gone) if within(gone, BROADCAST_IDS) else gone
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


#: A key is hot if it has more than one in so many rows; there are no more hot keys than this.
HOT = 1000
#: Rows (of a few numbers each) up to which any one of its keys fits a task, so that no join of a table is divided.
EASY = 1 << 24


def join_by_key(rows: DataFrame, one: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which has a row for each key and in ``n`` how many rows have that key.

    Beyond EASY rows, keys with more than 1 / HOT of the ``total`` rows, HOT of them at most, are broadcast, so that their
    rows stay where they are; only the others are shuffled."""
    if total <= EASY:
        return rows.join(one, keys)
    is_hot = F.col(n) * HOT > total
    hot = F.broadcast(one.where(is_hot))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(one.where(~is_hot), keys)
    return rows.join(hot, keys).unionByName(cold)


def crc32_fold(column, folds: int):
    """crc32 of the value as text, modulo ``folds``."""
    return F.crc32(column.cast("string").cast("binary")) % folds
