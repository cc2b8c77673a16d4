"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java regex class of the six blank characters that separate words.
BLANK = r"[\x20\x09-\x0D]"
NON_BLANK_RUN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master without one gets a temporary folder (tests); elsewhere executors
    would not see each other's files, so a missing setting is an error.
    """
    context = spark.sparkContext
    conf = context.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = getattr(context, "_scrollsift_shared", None)
    if path is None:
        path = "file://" + tempfile.mkdtemp(prefix="scrollsift-")
        context._scrollsift_shared = path
    return path


#: Open scopes of tables to delete, the innermost last; the first lasts as long as the process.
_scopes: list[list[tuple[SparkSession, str]]] = [[]]


#: Rows are texts of any length, so few of them are held at a time by a scan or on the way to Python.
BATCH_ROWS = 512
_BATCHES = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is planned inside takes at most BATCH_ROWS rows at a time."""
    before = {key: spark.conf.get(key) for key in _BATCHES}
    try:
        for key, rows in before.items():
            spark.conf.set(key, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
        yield
    finally:
        for key, rows in before.items():
            spark.conf.set(key, rows)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts lineage in a way that survives lost executors. The table goes when its scope
    ends (``scratch``), when it is discarded, or with the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scrollsift-{name}-{uuid.uuid4().hex}"
    if _scopes == [[]]:
        atexit.register(_sweep)
    _scopes[-1].append((spark, path))
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scrollsift_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    """Delete the tables that are left when the process ends."""
    for scope in _scopes:
        for spark, path in scope:
            with contextlib.suppress(Exception):  # the JVM may have gone before
                _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    gone = {t._scrollsift_path: t.sparkSession for t in tables}
    for path, spark in gone.items():
        _delete(spark, path)
    for scope in _scopes:
        scope[:] = [x for x in scope if x[1] not in gone]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete all tables written inside at the end, but those put into the list it gives."""
    keep: list[DataFrame] = []
    _scopes.append([])
    try:
        yield keep
    finally:
        kept = {t._scrollsift_path for t in keep}
        for _, path in (inner := _scopes.pop()):
            if path not in kept:
                _delete(spark, path)
        _scopes[-1].extend(x for x in inner if x[1] in kept)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns x0, x1 and so on, and which of them has each name.

    Names are taken exactly, so that a column whose name differs in case only makes
    none ambiguous; of equal names the first counts. ``toDF(*df.columns)`` names them again.
    """
    place: dict[str, str] = {}
    for i, name in enumerate(df.columns):
        place.setdefault(name, f"x{i}")
    return df.toDF(*[f"x{i}" for i in range(len(df.columns))]), place


def named(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, free of others that clash with them."""
    rows, place = numbered(df)
    return rows.select(*[F.col(place[n]).alias(n) for n in names])


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def slices(batch: pa.RecordBatch, max_bytes: int = 8 << 20, col: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that each part holds about ``max_bytes`` of text."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(col)), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    start, n = 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def packed(batch: pa.RecordBatch, col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the n + 1 offsets; null counts as empty."""
    arr = pc.fill_null(batch.column(col), "")
    arr = arr.cast(pa.large_binary()) if not pa.types.is_large_binary(arr.type) else arr
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def count_kind(spans: str, kind: str) -> Column:
    """How many spans of a kind an array has."""
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def hash_sample(rows: DataFrame, of: str, key: tuple[str, ...], most: int) -> DataFrame:
    """(of, *key, o), distinct: at most ``most`` keys of each value of ``of``, in the order of their hash ``o``.

    About twice as many keys as wanted pass a limit on the hash, so that few rows meet
    for the exact cut, however many rows there are and however often one is repeated.
    """
    order = F.xxhash64(*[F.col(k).cast("string") for k in key], F.lit("sample"))
    hashed = rows.select(of, *key, order.alias("o"))
    sizes = written(hashed.groupBy(of).agg(F.approx_count_distinct("o", 0.02).alias("n")), "sizes")
    place = F.shiftrightunsigned("o", 11) / float(1 << 53)
    some = hashed.join(sizes, of).filter(place * F.col("n") < 2 * most + 100).select(of, *key, "o").distinct()
    nth = F.row_number().over(Window.partitionBy(of).orderBy("o", *key))
    return some.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")
