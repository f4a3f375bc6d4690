"""Tables that are replaced in one step.

A version is written into a folder of its own and published by one empty file whose name carries the
version: creating it is a single step on every file system. Until then readers see the former
version, and a writer that dies leaves a folder that nobody reads and the next publication deletes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Folder of the published names, hidden from scans of the table's folder.
PUBLISHED = "_published"
#: Versions that stay, so that readers of the former one can finish.
KEPT = 2


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, files = _folder(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []


def versions(spark: SparkSession, path: str) -> list[str]:
    """Published versions from the first to the last, ``<number>.<folder>``."""
    return [n for n in _names(spark, f"{path}/{PUBLISHED}") if "." in n and not n.startswith(".")]


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version published last; None when there is none."""
    found = versions(spark, path)
    return f"{path}/{found[-1].split('.', 1)[1]}" if found else None


def publish(spark: SparkSession, path: str, folder: str) -> None:
    """Make ``folder``, a version below ``path``, the current one."""
    found = versions(spark, path)
    number = int(found[-1].split(".")[0]) + 1 if found else 1
    mark, files = _folder(spark, f"{path}/{PUBLISHED}/{number:010d}.{folder}")
    files.create(mark, False).close()


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """``write`` a new version into the folder it is given, publish it and delete versions before the former one.

    One writer at a time: a version that another is still writing would count as left behind.
    """
    name = f"version-{uuid.uuid4().hex}"
    write(f"{path}/{name}")
    publish(spark, path, name)
    old = versions(spark, path)[:-KEPT]
    kept = {v.split(".", 1)[1] for v in versions(spark, path)[-KEPT:]}
    for left in [f"{PUBLISHED}/{v}" for v in old] + [n for n in _names(spark, path) if n.startswith("version-") and n not in kept]:
        target, files = _folder(spark, f"{path}/{left}")
        files.delete(target, True)
