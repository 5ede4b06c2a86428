"""Versions of a table that consists of folders: a version is a small JSON file that appears by one rename, whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The highest version under path/manifest and its content; -1 and {} if there is none."""
    place, files = _files(spark, f"{path}/manifest")
    if not files.exists(place):
        return -1, {}
    names = [s.getPath().getName() for s in files.listStatus(place)]
    version = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), default=-1)
    if version < 0:
        return -1, {}
    return version, json.loads(spark.read.text(f"{path}/manifest/{version:012d}.json", wholetext=True).first()[0])


def commit(spark: SparkSession, path: str, version: int, content: dict, keep: int = 10) -> None:
    """Makes `content` the version; raises FileExistsError if someone else has. The versions before the last `keep` are deleted."""
    jvm = spark.sparkContext._jvm
    place, files = _files(spark, f"{path}/manifest")
    files.mkdirs(place)
    hidden = jvm.org.apache.hadoop.fs.Path(place, f".{uuid.uuid4().hex}")
    out = files.create(hidden)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(place, f"{version:012d}.json")
    if files.exists(target) or not files.rename(hidden, target):
        files.delete(hidden, False)
        raise FileExistsError(f"version {version} of {path} is there already")
    for old in range(max(0, version - 2 * keep), version - keep):
        files.delete(jvm.org.apache.hadoop.fs.Path(place, f"{old:012d}.json"), False)


def delete(spark: SparkSession, path: str) -> None:
    place, files = _files(spark, path)
    files.delete(place, True)
