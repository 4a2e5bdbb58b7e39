"""Writers: staged and validated publishing, save modes, CSV, tables, views and reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MODES = {"skip": "ignore", "fail": "errorifexists", "replace": "overwrite", "append": "append"}


class PathError(ValueError):
    """Inputs and outputs are missing, or get in each other's way."""


def check_paths(spark: SparkSession, inputs: list[str], outputs: list[str]) -> None:
    """Inputs exist; outputs differ from each other and from the inputs."""
    if len(set(outputs)) != len(outputs):
        raise PathError(f"outputs must differ: {outputs}")
    if both := set(inputs) & set(outputs):
        raise PathError(f"an output would replace an input: {sorted(both)}")
    for path in inputs:
        if not _exists(spark, path):
            raise PathError(f"{path} does not exist")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def publish(
    tables: dict[str, tuple],
    validate: Callable[[str, DataFrame], None] | None = None,
    sort_by: dict[str, list[str]] | None = None,
) -> dict[str, int]:
    """Write all tables beside their targets, read and validate each, and only then swap them in.

    ``tables`` has (DataFrame, target path) by name, or (DataFrame, target path, form) with a ``Form``
    for other files than Parquet; the rows of each are returned. ``sort_by`` names the columns that
    order a table over all its files. If a write, a check or a swap fails, all that was published before
    is there again, and the staged files go. Only a driver that dies between two renames leaves tables
    of both kinds; the older ones then lie beside, as ``-old`` (``snapshot`` leaves no such gap).
    """
    staged: dict[str, tuple[str, str]] = {}
    rows: dict[str, int] = {}
    spark = next(iter(tables.values()))[0].sparkSession
    try:
        for name, (df, target, *form) in tables.items():
            form = form[0] if form else parquet_form((sort_by or {}).get(name))
            stage = f"{target.rstrip('/')}._staging-{uuid.uuid4().hex}"
            staged[name] = (stage, target)
            form.write(df, stage)
            again = form.read(spark, stage, df.schema)
            if [(f.name, f.dataType) for f in again.schema] != [(f.name, f.dataType) for f in df.schema]:
                raise ValueError(f"{name} reads back with another schema")
            if validate is not None:
                validate(name, again)
            rows[name] = again.count()
        _swap(spark, list(staged.values()))
    finally:
        for stage, _ in staged.values():
            p, fs = _path(spark, stage)
            if fs.exists(p):
                fs.delete(p, True)
    return rows


@dataclass(frozen=True)
class Form:
    """How a table is written to a path, and read again: ``read`` gets the session, the path and the schema that was written."""

    write: Callable[[DataFrame, str], None]
    read: Callable[[SparkSession, str, StructType], DataFrame]


def parquet_form(sort_by: list[str] | None = None) -> Form:
    return Form(lambda df, path: write_parquet(df, path, sort_by=sort_by), lambda spark, path, _: spark.read.parquet(path))


def csv_form(single_file: bool = False) -> Form:
    """CSV with a header; what is read again is cast to the schema, and a value of another type fails the check."""
    form = "yyyy-MM-dd HH:mm:ss"
    options = {"header": True, "escape": '"', "enforceSchema": False, "mode": "FAILFAST", "timestampNTZFormat": form, "timestampFormat": form}
    return Form(
        lambda df, path: write_csv(df, path, single_file=single_file),
        lambda spark, path, schema: spark.read.schema(schema).options(**options).csv(path),
    )


def dated_form(column: str, within: list[str]) -> Form:
    """Parquet with a folder for each value of a text column of dates, so that a window of time reads only its days.

    Rows are dealt out by ranges of the date and of ``within``, so a day of very many rows is
    several files, each sorted; a small day is one.
    """

    def write(df: DataFrame, path: str) -> None:
        order = [column, *within]
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(column).option("compression", "snappy").parquet(path)

    return Form(write, lambda spark, path, schema: spark.read.schema(schema).parquet(path).select(*schema.fieldNames()))


def _swap(spark: SparkSession, staged: list[tuple[str, str]]) -> None:
    """Every stage takes its target's place, or none: what was moved away stays until all renames are through."""
    begun: list[tuple[str, str]] = []
    try:
        for stage, target in staged:
            (new, fs), (old, _), (kept, _) = _path(spark, stage), _path(spark, target), _path(spark, f"{stage}-old")
            if fs.exists(old) and not fs.rename(old, kept):
                raise OSError(f"cannot move {target} away")
            begun.append((stage, target))
            if not fs.rename(new, old):
                raise OSError(f"cannot publish {target}")
    except BaseException:
        for stage, target in reversed(begun):
            (old, fs), (kept, _) = _path(spark, target), _path(spark, f"{stage}-old")
            fs.delete(old, True)
            if fs.exists(kept):
                fs.rename(kept, old)
        raise
    for stage, _ in staged:
        kept, fs = _path(spark, f"{stage}-old")
        fs.delete(kept, True)


def write_parquet(df: DataFrame, path: str, mode: str = "fail", row_group_bytes: int = 128 << 20, sort_by: list[str] | None = None) -> None:
    """Snappy Parquet; an empty DataFrame keeps its schema. ``sort_by`` orders by range over all files."""
    out = df.orderBy(*sort_by) if sort_by else df
    out.write.mode(MODES[mode]).option("compression", "snappy").option("parquet.block.size", row_group_bytes).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "fail", single_file: bool = False) -> None:
    """CSV with a header, times as ``yyyy-MM-dd HH:mm:ss``. One file only where that is asked for."""
    out = df.coalesce(1) if single_file else df
    form = "yyyy-MM-dd HH:mm:ss"
    out.write.mode(MODES[mode]).options(header=True, timestampNTZFormat=form, timestampFormat=form).csv(path)


#: Settings under which Spark plans by the statistics of tables: estimates by column, and the order of joins.
_BY_STATISTICS = ("spark.sql.cbo.enabled", "spark.sql.cbo.planStats.enabled", "spark.sql.cbo.joinReorder.enabled", "spark.sql.statistics.histogram.enabled")


def plan_by_statistics(spark: SparkSession, on: bool = True) -> None:
    """From now on ``spark`` orders joins and estimates filters by what ``write_table`` gathered, its histograms included."""
    for key in _BY_STATISTICS:
        spark.conf.set(key, str(on).lower())


def write_table(df: DataFrame, table: str, mode: str = "skip", cluster_by: list[str] | None = None, statistics: bool = False) -> None:
    """A catalogue table. ``cluster_by`` sorts files by range, so that scans skip row groups; that and
    column ``statistics``, with histograms where ``plan_by_statistics`` is on, take the place of indexes."""
    out = df
    if cluster_by:
        out = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    out.write.mode(MODES[mode]).format("parquet").saveAsTable(table)
    if statistics:
        df.sparkSession.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def load_once(df: DataFrame, table: str, mode: str, source: str, cluster_by: list[str]) -> int:
    """Add rows to a table that has a partition for each file that was loaded, named by the last column, ``source``; its rows are returned.

    A file's partition is overwritten as a whole, so what is loaded twice counts once, and a load that died is
    made good by the next one. With mode ``replace`` the table begins anew; ``skip`` and ``fail`` are as in ``write_table``.
    """
    spark = df.sparkSession
    exists = spark.catalog.tableExists(table)
    if exists and mode == "skip":
        return spark.table(table).count()
    if exists and mode == "fail":
        raise ValueError(f"{table} already exists")
    if exists and mode == "append" and source not in spark.table(table).columns:
        raise ValueError(f"{table} does not keep its loads apart")
    order = [source, *cluster_by]
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
    if not exists or mode == "replace":
        out.format("parquet").partitionBy(source).saveAsTable(table)
    else:
        out.option("partitionOverwriteMode", "dynamic").insertInto(table)
    return spark.table(table).count()


def create_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def verify(spark: SparkSession, table: str, rows: int, columns: list[str], types: list[str] | None = None) -> None:
    """Raises unless the table or view exists with these columns (of these types) and so many rows."""
    if not spark.catalog.tableExists(table):
        raise ValueError(f"{table} does not exist")
    found = [c.name for c in spark.catalog.listColumns(table)]
    if found != columns:
        raise ValueError(f"{table} has columns {found}")
    if types is not None and (kinds := [kind for _, kind in spark.table(table).dtypes]) != types:
        raise ValueError(f"{table} has types {kinds}")
    if (n := spark.table(table).count()) != rows:
        raise ValueError(f"{table} has {n} rows, not {rows}")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file, on whatever file system the path names; an older one is replaced."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_json(spark: SparkSession, report: dict, path: str) -> None:
    write_text(spark, json.dumps(report, indent=2, default=str, ensure_ascii=False) + "\n", path)


def render_markdown(title: str, sections: dict[str, dict]) -> str:
    """A report as Markdown: a table of names and values for each section."""
    text = [f"# {title}", ""]
    for head, values in sections.items():
        text += [f"## {head}", "", "| name | value |", "| --- | ---: |"]
        text += [f"| {k} | {f'{v:,}' if isinstance(v, int) and not isinstance(v, bool) else v} |" for k, v in values.items()]
        text.append("")
    return "\n".join(text)
