"""Shared folder, lineage cuts and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import threading
import time
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.sources.stage import durable, release, shared_folder, stored

__all__ = ["durable", "release", "shared_folder", "stored"]

#: Labels (languages, classes) that a model may learn.
MAX_GROUPS = 1000


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("*",)))


def extended(df: DataFrame, **fields: T.DataType) -> T.StructType:
    """The schema of ``df`` and further fields."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in fields.items())])


def spread_join(
    rows: DataFrame,
    other: DataFrame,
    keys: list[str],
    by: list[str],
    how: str = "inner",
    total: int | None = None,
    counts: DataFrame | None = None,
    share: int = 1000,
    once: bool = False,
) -> DataFrame:
    """``rows`` joined with ``other`` by ``keys``, so that no key's rows meet in one task.

    A key of more than 1 / ``share`` of all rows is split by a hash of the columns ``by`` over so
    many tasks that none takes more than such a part; the rows of ``other`` with that key are
    repeated for each. Keys are counted with partial sums; fewer than ``share`` can be so heavy, so
    the driver takes that many at most. ``total`` is the number of rows, or more, and ``counts`` has
    the rows ``n`` of each key, if these are known. Rows with a null key are spread too; they match
    nothing. Up to ``share`` rows in all are too few to spread. With ``once``, one row of ``other``
    counts for each key; that takes no shuffle of its own.
    """
    if total is None:
        total = rows.count()
    heavy = []
    if total > share:
        if counts is None:
            counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        top = counts.select(*keys, "n").orderBy(F.desc("n")).limit(share).collect()
        heavy = [r for r in top if r["n"] * share > total]
    if not heavy:
        return rows.join(other.dropDuplicates(keys) if once else other, keys, how)
    tasks = [(*(r[k] for k in keys), -(-r["n"] * share // total)) for r in heavy if all(r[k] is not None for k in keys)]
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("__tasks", T.IntegerType())])
    split = F.broadcast(rows.sparkSession.createDataFrame(tasks, T.StructType([T.StructField(f.name, f.dataType) for f in schema])))
    row = F.xxhash64(*by)
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    salt = F.when(no_key, F.pmod(row, F.lit(share))).otherwise(F.coalesce(F.pmod(row, F.col("__tasks")), F.lit(0))).cast("int")
    left = rows.join(split, keys, "left").withColumn("__salt", salt).drop("__tasks")
    last = F.coalesce(F.col("__tasks"), F.lit(1)) - 1
    right = other.join(split, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), last))).drop("__tasks")
    if once:
        right = right.dropDuplicates([*keys, "__salt"])
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def bitmap(hashes: DataFrame, column: str, n: int, most: int) -> tuple[Column, int]:
    """An array of longs, as a scalar, with a bit set for each hash of ``column``; and the number of its bits.

    64 bits for each of ``n`` hashes, but never over ``most`` in all: beyond it, more that is not listed passes.
    """
    bits = 1 << min(most.bit_length() - 1, max(12, (64 * n).bit_length()))
    h = F.col(column)
    words = hashes.groupBy(F.shiftright(h.bitwiseAND(bits - 1), 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))).alias("w")
    )
    every = hashes.sparkSession.range(bits // 64, numPartitions=1).join(F.broadcast(words), F.col("id") == F.col("word"), "left")
    filled = F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")))
    return every.agg(F.transform(F.array_sort(filled), lambda x: x["w"]).alias("bitmap")).scalar(), bits


def in_bitmap(known: Column, bits: int, h: Column) -> Column:
    word = F.get(known, F.shiftright(h.bitwiseAND(bits - 1), 6).cast("int"))
    return F.bit_get(word, h.bitwiseAND(63).cast("int")) == 1


def refuse(keep: Iterable[str], *made: str) -> None:
    """Columns that are kept may not have the names of those that are made."""
    if clash := sorted(set(keep) & set(made)):
        raise ValueError(f"columns that are kept have names of results: {clash}")


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).to_pylist()
        start = size = 0
        for i, n in enumerate(ends):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def give_back() -> None:
    """Return memory that this process has freed to the system: Arrow's pool, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


#: Seconds after which a Python worker lets go of what it keeps, if no task asks for it: an executor has more idle
#: workers than cores, and each would hold its models all through the stages that come after.
IDLE_S = 10

_KEPT: dict = {}
_USED: dict = {}
_LOCK = threading.Lock()


def _let_go(idle: float) -> None:
    """Forget what was not asked for in ``idle`` seconds; ends once nothing is kept."""
    while True:
        time.sleep(idle / 4)
        with _LOCK:
            if time.monotonic() - _USED.get("at", 0) < idle:
                continue
            _KEPT.clear()
            _USED.clear()
        give_back()
        return


def kept_by_worker(key: Hashable, make: Callable):
    """What a Python worker keeps from task to task under ``key``: one thing at a time, so stages do not pile up.

    It is kept until it was not asked for in IDLE_S seconds, so it is to be asked for at each batch. What a task holds stays its own.
    """
    with _LOCK:
        watched = bool(_USED)
        _USED["at"] = time.monotonic()
        made = _KEPT.get(key)
    if not watched:
        threading.Thread(target=_let_go, args=(IDLE_S,), daemon=True).start()
    if made is None:
        _KEPT.clear()
        give_back()
        made = _KEPT[key] = make()
        _USED["at"] = time.monotonic()
    return made


def bounded_sample(df: DataFrame, key: Column, group: Column, bound: int) -> DataFrame:
    """At most about ``bound`` rows of each group, chosen by a hash of ``key`` alone.

    The share kept follows from one count per group, so no group meets in one task and
    the choice does not depend on partitioning. Over MAX_GROUPS groups are refused: their counts
    come to the driver.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(group.alias("g")).count().limit(MAX_GROUPS + 1).collect()}
    if len(sizes) > MAX_GROUPS:
        raise ValueError(f"over {MAX_GROUPS} groups to sample from")
    share = F.lit(1.0)
    for value, n in sizes.items():
        if value is not None and n > bound:
            share = F.when(group == F.lit(value), F.lit(bound / n)).otherwise(share)
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
