"""Helpers the operators share: scratch tables, checked broadcasts, positions and running totals
that never pull one hot group into one task."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
CHUNK = 8192
TASK_CHARS = 4_000_000
KEPT_ROWS = 128
_FOLDERS: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only for a local master."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
        root = tempfile.mkdtemp(prefix="foliospark-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """One folder per application under the scratch root; all scratch tables of a session are in it."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS.add(app)
        atexit.register(_clear_quietly, spark)
    return f"{scratch_root(spark)}/foliospark-{app}"


def scratch_path(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove the session's scratch tables through Spark's file system. Call it when no table that is still to be read comes
    from this library any more; it also runs when the driver ends."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _clear_quietly(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session has no file system to ask
        clear_scratch(spark)


def materialise(df: DataFrame) -> DataFrame:
    """Write once to shared storage and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, stored: bool = False) -> DataFrame:
    """Hint a broadcast only after counting that the side is small; otherwise AQE plans the join.

    The side is written first, so that counting it does not compute it twice; ``stored`` says that
    it is a written table already.
    """
    table = df if stored else materialise(df)
    return F.broadcast(table) if table.count() <= max_rows else table


def shuffled(df: DataFrame) -> DataFrame:
    """Ask for a sort-merge join with this side: Spark takes a table for as large as the one that it was exploded from, or that
    a Python function read, and would collect and broadcast many times the room it thinks of."""
    return df.hint("merge")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables of wide rows that are persisted and first read in here are kept in batches of ``KEPT_ROWS`` rows at most.

    Where they do not fit, a task writes batches to disk by a Java stream, which holds on to the last hundred of them. With Spark's
    batches of about 4 MB that is most of an executor's heap, outside what Spark accounts for.
    """
    name = "spark.sql.inMemoryColumnarStorage.batchSize"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), KEPT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core ahead of heavy per-row work.

    Only for plans without a shuffle; a large input has more partitions anyway and passes unchanged.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def side_by_side(docs: DataFrame, text: str, chars: int = TASK_CHARS) -> DataFrame:
    """Documents dealt by ``doc_id``, ahead of tables of their words that are grouped by it: a text is moved and not its words.

    Words take many times the room of a text, so the number of partitions follows the characters, about ``chars`` in each.
    """
    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // chars)), "doc_id")


def task_sums(rows: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """The sum over all tasks of the flat array of doubles that ``fn`` makes of a task's batches; null if no task has one.

    An array crosses the shuffle in chunks, and the task that a chunk is sent to adds its parts up as they stream in: neither
    a task nor the driver ever holds more than one array, however many tasks there are.
    """
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = fn(batches)
        if values is not None:
            parts = [values[i:i + CHUNK].tobytes() for i in range(0, len(values), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(*[c.to_pylist() for c in batch.columns]):
                values = np.frombuffer(part)
                total[chunk] = total[chunk] + values if chunk in total else values
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["chunk", "part"])

    parts = rows.mapInArrow(made, "chunk int, part binary").repartition("chunk").mapInArrow(added, "chunk int, part binary")
    found = sorted(parts.collect())  # one array
    return np.concatenate([np.frombuffer(r["part"]) for r in found]) if found else None


def hash_key(id_col: str, seed: int) -> Column:
    """A random-looking order that depends on the seed and the id alone, not on partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def hash_bucket(key: Column) -> Column:
    """The first four hex digits: 65,536 even buckets in the order of the key."""
    return F.substring(key, 1, 4)


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None,
            maxima: dict[str, str] | None = None) -> DataFrame:
    """Add inclusive running sums and maxima ``{new column: source column}`` per ``keys`` in ``order``.

    The rows are range-partitioned over keys *and* order, so one key may spread over many tasks; each
    task scans its own range, and per-range totals (one row per range and key) carry over.
    """
    part = "_range"
    ranged = materialise(
        df.repartitionByRange(*[F.col(c) for c in keys + order]).withColumn(part, F.spark_partition_id())
    )
    inside = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    scans = [(new, src, F.sum) for new, src in (sums or {}).items()] + [(new, src, F.max) for new, src in (maxima or {}).items()]
    local = ranged.select("*", *[fn(src).over(inside).alias(f"_in_{new}") for new, src, fn in scans])
    carried = (
        ranged.groupBy(part, *keys)
        .agg(*[fn(src).alias(f"_t_{new}") for new, src, fn in scans])
        .select(part, *keys, *[fn(f"_t_{new}").over(before).alias(f"_off_{new}") for new, _, fn in scans])
    )
    merged = [
        (F.col(f"_in_{new}") + F.coalesce(F.col(f"_off_{new}"), F.lit(0)) if fn is F.sum
         else F.greatest(f"_in_{new}", f"_off_{new}")).alias(new)
        for new, _, fn in scans
    ]
    return local.join(carried, [part, *keys]).select(*df.columns, *merged)
