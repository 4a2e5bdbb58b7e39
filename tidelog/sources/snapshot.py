"""Several tables published as one: data files of their own for each version, and a manifest that names them.

A folder holds ``data/<table>-<id>`` and ``manifests/<number>.json``. Writing a version adds data that no manifest
names yet, reads and checks it, and last puts one new manifest, which must not exist before. Readers take the
highest manifest that is whole, so at every moment they find all tables of one version, on file systems and object
stores alike: nothing is renamed or overwritten. Of two writers of the same number the second one fails.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.sources import publish

#: Digits of a manifest's number in its name.
_DIGITS = 12


class ConflictError(RuntimeError):
    """Another writer published the version that this one was to be."""


def _names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = publish._path(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def _sealed(body: dict) -> str:
    text = json.dumps(body, sort_keys=True)
    return json.dumps({"body": body, "sha256": hashlib.sha256(text.encode()).hexdigest()})


def _opened(text: str) -> dict | None:
    """The manifest in a file, or None if the file is not whole."""
    try:
        outer = json.loads(text)
        whole = outer["sha256"] == hashlib.sha256(json.dumps(outer["body"], sort_keys=True).encode()).hexdigest()
    except (ValueError, KeyError, TypeError):
        return None
    return outer["body"] if whole else None


def _read_text(spark: SparkSession, path: str) -> str:
    p, fs = publish._path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """The newest whole manifest (``version`` and ``tables``: data folder by name), or that of a version; None if there is none."""
    for name in reversed(_names(spark, f"{root}/manifests")):
        if version is None or name == f"{version:0{_DIGITS}d}.json":
            found = _opened(_read_text(spark, f"{root}/manifests/{name}"))
            if found is not None:
                return found
    return None


def resolve(spark: SparkSession, root: str, table: str) -> str:
    """The folder of a table's data: that of the newest version, or ``root/table`` where nothing was published by manifest."""
    found = manifest(spark, root)
    return f"{root}/{found['tables'][table]}" if found and table in found["tables"] else f"{root}/{table}"


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; it is an error if there is one."""
    p, fs = publish._path(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise ConflictError(path) from e
        raise
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def publish_snapshot(
    tables: dict[str, DataFrame],
    root: str,
    validate: Callable[[str, DataFrame], None] | None = None,
    forms: dict[str, publish.Form] | None = None,
    notes: dict | None = None,
) -> tuple[int, dict[str, int]]:
    """Publish tables as a new version of ``root``: the version, and the rows of each. ``notes`` go into the manifest.

    Tables of the version before that are not given stay as they were. If a write or a check fails, or the
    driver dies at any step, readers go on to find the version before; what was written of the new one is
    named by no manifest, and ``vacuum`` deletes it.
    """
    spark = next(iter(tables.values())).sparkSession
    before = manifest(spark, root) or {"version": 0, "tables": {}}
    placed, rows = dict(before["tables"]), {}
    for name, df in tables.items():
        form = (forms or {}).get(name) or publish.parquet_form()
        placed[name] = f"data/{name}-{uuid.uuid4().hex}"
        form.write(df, f"{root}/{placed[name]}")
        again = form.read(spark, f"{root}/{placed[name]}", df.schema)
        if [(f.name, f.dataType) for f in again.schema] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError(f"{name} reads back with another schema")
        if validate is not None:
            validate(name, again)
        rows[name] = again.count()
    # a file that is not whole keeps its number
    taken = [int(x.split(".")[0]) for x in _names(spark, f"{root}/manifests") if x.split(".")[0].isdigit() and int(x.split(".")[0]) > before["version"]]
    if any(manifest(spark, root, n) for n in taken):
        raise ConflictError(f"{root} has a newer version than {before['version']}")
    version = max([before["version"], *taken]) + 1
    _put(spark, f"{root}/manifests/{version:0{_DIGITS}d}.json", _sealed({"version": version, "tables": placed, "notes": notes or {}}))
    return version, rows


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A Parquet table of the newest version, or of the one named."""
    found = manifest(spark, root, version)
    if found is None or table not in found["tables"]:
        raise ValueError(f"{root} has no table {table}" + (f" in version {version}" if version is not None else ""))
    return spark.read.parquet(f"{root}/{found['tables'][table]}")


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the manifests before the newest ``keep`` whole ones, and all data that those kept do not name.

    Not to be run while another version is being written.
    """
    whole = [(name, found) for name in _names(spark, f"{root}/manifests") if (found := _opened(_read_text(spark, f"{root}/manifests/{name}")))]
    kept = whole[-keep:]
    named = {path for _, found in kept for path in found["tables"].values()}
    gone = [f"data/{x}" for x in _names(spark, f"{root}/data") if f"data/{x}" not in named]
    gone += [f"manifests/{name}" for name, _ in whole[:-keep]]
    for path in gone:
        p, fs = publish._path(spark, f"{root}/{path}")
        fs.delete(p, True)
    return gone
