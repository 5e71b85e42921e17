"""Publishing a set of tables at once: one manifest names the version of every table.

Each table is written to a folder of its own version and checked.  Only when all are good is a
manifest written and the pointer moved to it by one rename.  Until then, and after any failure
between two tables, readers see the old set whole; a reader that resolved a manifest keeps its
versions, because nothing is ever written over.  A later set may hold some of the tables only:
the others are carried over from the set before.

Layout: ``root/<table>/version=<id>/``, ``root/manifests/<number>-<id>`` and ``root/CURRENT``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from fluxora.sources.files import (
    POINTER,
    _fs,
    _replace_file,
    current_version,
    exists,
    remove_folders,
)

Check = Callable[[str, DataFrame], list[str]]


class Conflict(RuntimeError):
    """Another set was published since this one began."""


def manifest(spark: SparkSession, root: str, name: str | None = None) -> dict:
    """The manifest in force, or the one of that name; empty when nothing is published."""
    name = name or current_version(spark, root)
    if name is None:
        return {"name": None, "number": 0, "before": None, "tables": {}}
    text = spark.read.text(f"{root}/manifests/{name}", wholetext=True).first()["value"]
    return json.loads(text)


def read_set(spark: SparkSession, root: str, name: str | None = None) -> dict[str, DataFrame]:
    """Every table of one set, all resolved by the same manifest."""
    found = manifest(spark, root, name)
    if found["name"] is None:
        raise FileNotFoundError(f"nothing published below {root}")
    return {t: spark.read.parquet(f"{root}/{t}/{v}") for t, v in found["tables"].items()}


def publish_set(
    tables: Mapping[str, DataFrame], root: str, check: Check
) -> tuple[str | None, dict[str, list[str]]]:
    """Write and check all tables, then put them in force together.

    ``check(name, written)`` names what is wrong with a table.  With any problem nothing
    changes for readers; every table is still checked, so that all problems are told.
    """
    if not tables:
        raise ValueError("a set needs a table")
    spark = next(iter(tables.values())).sparkSession
    old = manifest(spark, root)
    versions, problems = {}, {}
    try:
        for name, df in tables.items():
            version = f"version={uuid.uuid4().hex}"
            versions[name] = version
            df.write.parquet(f"{root}/{name}/{version}")
            found = check(name, spark.read.schema(df.schema).parquet(f"{root}/{name}/{version}"))
            if found:
                problems[name] = found
    except BaseException:
        _discard(spark, root, versions)
        raise
    if problems:
        _discard(spark, root, versions)
        return None, problems
    return _put_in_force(spark, root, old, old["tables"] | versions), {}


def _put_in_force(spark: SparkSession, root: str, old: dict, tables: dict[str, str]) -> str:
    number = old["number"] + 1
    name = f"{number:08d}-{uuid.uuid4().hex}"
    new = {"name": name, "number": number, "before": old["name"], "tables": tables}
    _replace_file(spark, f"{root}/manifests/{name}", json.dumps(new, sort_keys=True))
    if current_version(spark, root) != old["name"]:
        raise Conflict(f"{root} moved on from {old['name']}")
    _replace_file(spark, f"{root}/{POINTER}", name)
    return name


def _discard(spark: SparkSession, root: str, versions: Mapping[str, str]) -> None:
    remove_folders(spark, [_uri(spark, f"{root}/{t}/{v}") for t, v in versions.items()])


def _uri(spark: SparkSession, path: str) -> str:
    fs, jpath = _fs(spark, path)
    return str(fs.makeQualified(jpath).toUri())


def roll_back(spark: SparkSession, root: str) -> str:
    """Put the set before the one in force back in force; its manifest's name."""
    before = manifest(spark, root)["before"]
    if before is None or not exists(spark, f"{root}/manifests/{before}"):
        raise LookupError(f"no set before the one in force below {root}")
    _replace_file(spark, f"{root}/{POINTER}", before)
    return before


def clean_up(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove the versions that none of the last ``keep`` sets in force name.

    Sets count back from the one in force; versions of failed or undone sets go as well.  To
    be run when no set is being published.
    """
    if keep < 1:
        raise ValueError("the set in force has to stay")
    kept, name = [], current_version(spark, root)
    while name is not None and len(kept) < keep and exists(spark, f"{root}/manifests/{name}"):
        kept.append(manifest(spark, root, name))
        name = kept[-1]["before"]
    if not kept:
        return []
    alive = {f"{t}/{v}" for m in kept for t, v in m["tables"].items()}
    names = {m["name"] for m in kept}
    gone = []
    for folder in _children(spark, root):
        if folder == "manifests":
            gone += [f"manifests/{n}" for n in _children(spark, f"{root}/manifests") if n not in names]
        elif folder != POINTER:
            versions = [f"{folder}/{v}" for v in _children(spark, f"{root}/{folder}")]
            gone += [v for v in versions if v not in alive and "/version=" in v]
    remove_folders(spark, [_uri(spark, f"{root}/{g}") for g in gone])
    return sorted(gone)


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder: tables, versions of one table, manifests."""
    fs, jpath = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath) if not s.getPath().getName().startswith("."))
