"""Helpers shared by the training-data operators.

* ``prepare`` lets Python workers import this package (local runs; a cluster
  ships it with ``--py-files``);
* ``stage`` cuts lineage by a Parquet table in the shared folder named by
  ``spark.checkpoint.dir``, so a lost executor re-reads files instead of
  recomputing, and a costly step runs once;
* ``shuffles_freed`` lets shuffle files go as soon as the action that made them ends;
* ``prefix_sums`` gives running totals without one task per group.
"""

from __future__ import annotations

import os
import re
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.session import ensure_checkpoint_dir

#: The six characters every contract calls white space, as a Java regex class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_staged: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers and the checkpoint folder known."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    ensure_checkpoint_dir(spark)
    return spark


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "2m") -> None:
    """Rows go to Python workers in batches of about ``size`` unless the session names a size of its own. Spark's
    64 MB (or 10,000 rows) are held several times over: by the executor, by Arrow and as Python strings."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, size)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (lineage ends there)."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> list[str]:
    """Paths of all tables staged so far, oldest first."""
    return list(_staged)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that nothing will read again (between pipeline stages)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in _staged:
            _staged.remove(name)


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Actions within delete their shuffle files when they end. Otherwise those stay until the
    driver happens to collect its garbage, however many steps later. For frames that are run once:
    running the same one again would make its shuffles anew."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


class Scratch:
    """Staged tables by name, deleted as soon as their readers have written theirs.

    ``write`` replaces a table of the same name: the new one is complete before
    the old one goes, so it may be derived from it. ``drop`` is called when
    everything that read a table is itself on disk; nothing is recomputed from
    a dropped table, so a lost executor needs none."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.schemas = spark, {}, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = work_path(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name], self.schemas[name] = path, df.schema
        return self.read(name)

    def read(self, *names: str) -> DataFrame:
        """The rows of tables of one schema."""
        return self.spark.read.schema(self.schemas[names[0]]).parquet(*(self.paths[n] for n in names))

    def drop(self, *names: str) -> None:
        release(self.spark, [self.paths.pop(n) for n in names if n in self.paths])


_worker: dict[str, tuple] = {}


def worker_holds(owner: str, *clear) -> None:
    """Called at the start of a task with functions that empty what its operator keeps in the
    Python worker between tasks: a reused worker drops the tables of other operators, so it
    holds those of one at a time and gives their memory back."""
    others = [name for name in _worker if name != owner]
    for name in others:
        for f in _worker.pop(name):
            f()
    if others:
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)
    _worker[owner] = clear


def fresh(df: DataFrame, name: str) -> str:
    """A column name ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text):
    """Number of maximal runs of non-white-space characters; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, out: str, chunk: int = 500,
                rows: int | None = None) -> DataFrame:
    """Running total of ``value`` before each row, within ``group``.

    Rows are dealt by hash of their order key into chunks of about ``chunk``
    rows; each chunk is summed by one small window, and chunk totals are summed
    the same way (two levels, so a window holds about ``chunk`` rows, then
    about the square root of the number of chunks). The order of a group is
    (chunk, order key): any fixed order serves callers, and it is repeatable.
    Rows with the same order key get arbitrary but consistent places only when
    they are identical in ``order``; callers pass keys that tell rows apart.
    """
    n = df.count() if rows is None else rows
    chunks = max(1, -(-n // chunk))
    width = max(1, int(chunks ** 0.5))
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    df = df.withColumn("_super", F.floor(F.col("_chunk") / width))
    totals = df.groupBy(group, "_super", "_chunk").agg(F.sum(value).alias("_sum"))

    def run(window_keys, order_keys, what):
        w = Window.partitionBy(*window_keys).orderBy(*order_keys).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(what).over(w), F.lit(0))

    supers = totals.groupBy(group, "_super").agg(F.sum("_sum").alias("_sum"))
    supers = supers.select(group, "_super", run([group], ["_super"], "_sum").alias("_a"))
    totals = totals.select(group, "_super", "_chunk", run([group, "_super"], ["_chunk"], "_sum").alias("_b"))
    offsets = totals.join(supers, _same(totals, supers, [group, "_super"])).select(
        totals[group].alias("_g"), totals["_chunk"].alias("_c"), (F.col("_a") + F.col("_b")).alias("_off"))
    inner = df.withColumn("_in", run([group, "_chunk"], order, value))
    joined = inner.join(offsets, inner[group].eqNullSafe(offsets["_g"]) & (inner["_chunk"] == offsets["_c"]))
    return joined.withColumn(out, F.col("_off") + F.col("_in")).drop(
        "_chunk", "_super", "_in", "_g", "_c", "_off")


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def runs(sizes: list[int], limit: int):
    """(start, end) of consecutive rows whose sizes add up to about ``limit``."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def text_sizes(column) -> list[int]:
    """Bytes of each value of an Arrow string or binary column (nulls: 0)."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def cut_text(text: str, size: int, cut: re.Pattern) -> list[str]:
    """Pieces of about ``size`` code points that part where ``cut`` matches (its end)."""
    out, start = [], 0
    while len(text) - start > size and (m := cut.search(text, start + size)):
        out.append(text[start:m.end()])
        start = m.end()
    return [*out, text[start:]]
