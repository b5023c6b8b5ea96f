"""Numbered commits beside a table: each names all that is valid, and only one writer gets a number."""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession

#: Seconds after which a commit that was opened and not written counts as given up.
GIVEN_UP = 10.0


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and a function that makes its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def latest_commit(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """The highest number in use, and what the latest written commit says (None before the first)."""
    fs, make = file_system(spark, folder)
    if not fs.exists(make(folder)):
        return 0, None
    numbers = sorted((int(name) for name in (s.getPath().getName() for s in fs.listStatus(make(folder))) if name.isdigit()),
                     reverse=True)
    for n in numbers:
        waited = time.monotonic()
        while not (text := _read(spark, f"{folder}/{n:010d}")) and time.monotonic() - waited < GIVEN_UP:
            time.sleep(0.2)
        if text:
            return numbers[0], json.loads(text)
    return (numbers[0] if numbers else 0), None


def commit(spark: SparkSession, folder: str, number: int, content: dict) -> bool:
    """Write commit ``number``; False when another writer has it. The file system must create files exclusively."""
    fs, make = file_system(spark, folder)
    path = make(f"{folder}/{number:010d}")
    if fs.exists(path):
        return False
    try:
        out = fs.create(path, False)
    except Exception as error:  # py4j wraps what Java throws
        if "AlreadyExists" in str(error):
            return False
        raise
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    return True


def _read(spark: SparkSession, path: str) -> str:
    fs, make = file_system(spark, path)
    stream = fs.open(make(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
