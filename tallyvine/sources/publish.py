"""Folders that readers see as a whole: versions behind a commit log.

Data goes to a new folder first. Then a log entry that names it is written under a name that no reader looks at, and renamed to the
next number, which fails if another writer was first. Readers take the entry with the highest number. Whatever
a writer stops at, readers see the version before it or the whole new one; folders that no entry names are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

LOG, DIGITS = "_log", 20


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file with this text; an error if it is there."""
    out = _store(spark, path).create(_path(spark, path), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read(spark: SparkSession, path: str) -> str:
    source = _store(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def move_if_absent(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file in one step, unless the target is there."""
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(_path(spark, target).toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        context.rename(_path(spark, source), _path(spark, target), plain)
    except Exception:
        if _store(spark, target).exists(_path(spark, target)):
            return False
        raise
    return True


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, in order."""
    log = f"{path}/{LOG}"
    if not _store(spark, log).exists(_path(spark, log)):
        return []
    names = [s.getPath().getName() for s in _store(spark, log).listStatus(_path(spark, log))]
    return sorted(int(n) for n in names if len(n) == DIGITS and n.isdigit())


def latest(spark: SparkSession, path: str) -> dict | None:
    """Facts of the version with the highest number, and the folder of its data; None if there is none."""
    found = numbers(spark, path)
    if not found:
        return None
    entry = json.loads(read(spark, f"{path}/{LOG}/{found[-1]:0{DIGITS}d}"))
    return entry["facts"] | {"number": found[-1], "folder": f"{path}/{entry['folder']}"}


def publish(spark: SparkSession, path: str, write: Callable[[str], dict | None], **facts) -> int:
    """Let write fill a new folder, then publish it with these facts (and those that write returns); the number of the version."""
    name = f"data-{uuid.uuid4().hex}"
    facts |= write(f"{path}/{name}") or {}
    draft = f"{path}/{LOG}/.draft-{uuid.uuid4().hex}"
    put(spark, draft, json.dumps({"folder": name, "facts": facts}))
    number = max(numbers(spark, path), default=0) + 1
    while not move_if_absent(spark, draft, f"{path}/{LOG}/{number:0{DIGITS}d}"):
        number += 1
    return number


def data_folder(spark: SparkSession, path: str) -> str:
    """The folder of the newest version, or path itself where nothing was published (a file or folder of someone else)."""
    found = latest(spark, path)
    return found["folder"] if found else path
