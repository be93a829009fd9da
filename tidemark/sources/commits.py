"""A log of numbered commits. Writers take the next number by a move that fails if it is taken; no clock is involved."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer was first."""


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _fs(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, folder: str) -> None:
    path = _path(spark, folder)
    _fs(spark, path).delete(path, True)


def latest(spark: SparkSession, root: str) -> tuple[int, dict[str, Any]]:
    """The number and content of the last commit; 0 and nothing before the first."""
    folder = _path(spark, root, "_commits")
    fs = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
    if not numbers:
        return 0, {}
    last = max(numbers)
    stream = fs.open(_path(spark, root, "_commits", f"{last:012d}.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return last, json.loads(text)


def commit(spark: SparkSession, root: str, number: int, content: dict[str, Any]) -> bool:
    """Whether this writer got the number. The content is written aside first, so that readers never see a part of it."""
    aside, place = (_path(spark, root, "_commits", n) for n in (f"_{uuid.uuid4().hex}", f"{number:012d}.json"))
    fs = _fs(spark, aside)
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    jvm = spark._jvm
    no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, place, no_overwrite)
    except Exception as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(e) or fs.exists(place):
            return False
        raise
    return True
