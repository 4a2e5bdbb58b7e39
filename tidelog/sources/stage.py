"""Tables kept for later steps of a job: written once to the folder that all executors share, then read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that ``stored`` wrote and nobody released.
_WRITTEN: list[str] = []
#: Catalogue tables of ``bucketed`` by path.
_TABLES: dict[str, str] = {}
#: Whether Spark deletes the shuffle files of an action as soon as it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """What is written in this block leaves no shuffle files behind; a written table needs none of them again."""
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests on one machine), a temporary folder takes its place;
    on a cluster that would lose data, so it is refused there.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-"))
        return sc.getCheckpointDir()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: later stages outlive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def path_for(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``clear`` deletes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = path_for(spark, name)
    with _shuffles_cleaned(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int | None = None, most: float = 4.0) -> DataFrame:
    """``df`` stored in ``buckets`` files by a hash of ``keys``, each sorted by them; by default as many as a shuffle has partitions.

    Grouping by the keys, alone or with others, and joins of two such tables with as many buckets need no
    shuffle. Where the rows of one key are more than ``most`` buckets' share, one task would read them all
    again and again; such a table is stored without buckets, and Spark splits the key when it shuffles.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = path_for(spark, name), f"{name}_{uuid.uuid4().hex}"
    with _shuffles_cleaned(spark):
        out = df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys)
        out.option("compression", "zstd").option("path", path).saveAsTable(table)
    _TABLES[path] = table
    kept = spark.table(table)
    kept.stored_at = path
    rows, largest = kept.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if rows > 1000 and largest * n > most * rows:
        flat = stored(kept, name)
        release(kept)
        return flat
    return kept


def _delete(spark: SparkSession, path: str) -> None:
    if path in _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned; no DataFrame made of them may be run any more. Others are left alone."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete what ``stored`` wrote in this session, when no DataFrame over it is needed any more.

    Checkpoints of ``durable`` go by themselves where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
