"""Shared plumbing of the training-data operators: shared folder, written tables, memory of Python workers, column helpers."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaflow.llm import rolling

BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, one of our own, in local mode
    alone: on a cluster a folder of one machine would lose rows, so that is an error."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        return place
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + _own_folder()


@lru_cache
def _own_folder() -> str:
    """A folder of this process, deleted at its end."""
    folder = tempfile.mkdtemp(prefix="lumaflow-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def stash(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    few: the rows are narrow; they are dealt anew by size first, so that they make few files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if few else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in stashed:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _size(text: str) -> int:
    """Bytes of a setting such as 64m, 67108864b or 1024."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", text.lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit[:1]]


def small_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """Arrow batches of bounded bytes bound what a task holds beside its own work, however long single texts are.

    The one session setting the operators touch: it is lowered, never raised, and changes no result."""
    conf = df.sparkSession.conf
    if _size(conf.get(BATCH_SETTING)) > most:
        conf.set(BATCH_SETTING, most)
    return df


def regrouped(batches, rows: int):
    """Arrow batches of short rows, joined to about so many rows each."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_caches: dict[str, list[dict]] = {}


def worker_cache(owner: str) -> dict:
    """A cache that a Python worker keeps between the tasks of one operator."""
    _caches.setdefault(owner, []).append({})
    return _caches[owner][-1]


def drop_other_caches(owner: str = "") -> None:
    """Workers are used again by other operators: empty the caches that those before left behind."""
    for name, own in _caches.items():
        if name != owner:
            for cache in own:
                cache.clear()


@lru_cache
def _trim() -> Callable[[int], int] | None:
    """The C library's malloc_trim, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task."""
    rolling.forget()
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def lean(run: Callable, owner: str = "") -> Callable:
    """A mapInArrow function that drops what other operators left in the worker, and gives back what it freed itself."""

    def task(batches):
        drop_other_caches(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def lean_group(run: Callable[[pa.Table], pa.Table], large: int = 8 << 20) -> Callable[[pa.Table], pa.Table]:
    """An applyInArrow function that gives back what large groups took."""

    def group(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes >= large:
            give_back()
        return out

    return group


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def text_bytes(column: str | Column = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def crc_bucket(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def running_total(groups: DataFrame, by: list[str], at: str, value: str, name: str, span: int = 1000) -> DataFrame:
    """Adds name: the sum of `value` over the rows of the same `by` with a smaller `at` (0 for the first).

    `groups` has one row by (by, at). Two levels: totals of `span` neighbouring places are summed first, then
    places inside a span, so no task orders more than (places / span) or span rows of one `by`."""
    spans = groups.withColumn("_span", F.floor(F.col(at) / F.lit(span)).cast("long"))
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    whole = spans.groupBy(*by, "_span").agg(F.sum(value).alias("_sum"))
    whole = whole.select(*by, "_span", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_span").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    own = spans.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).alias("g")
    same = F.col("g._span") == F.col("w._span")
    for c in by:
        same = same & F.col(f"g.{c}").eqNullSafe(F.col(f"w.{c}"))
    return own.join(whole.alias("w"), same).select(*[F.col(f"g.{c}") for c in groups.columns], (F.col("_before") + F.col("_inside")).alias(name))
