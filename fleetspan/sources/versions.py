"""Tables that are replaced as a whole: written aside, then named by a manifest that readers follow.

A version's files lie in a folder of their own.  Only once they are all there does a manifest with the next number
take its place, by a rename.  A write that fails leaves the version before as it was, and who reads while a new one
is written keeps what they began with.
"""

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MANIFEST = re.compile(r"_version-(\d{10})\.json")


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Names of the manifests, oldest first."""
    files, Path = _file_system(spark, path)
    if not files.exists(Path(path)):
        return []
    names = [status.getPath().getName() for status in files.listStatus(Path(path))]
    return sorted(name for name in names if MANIFEST.fullmatch(name))


def versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of all versions, oldest first."""
    files, Path = _file_system(spark, path)
    found = []
    for name in _manifests(spark, path):
        stream = files.open(Path(f"{path}/{name}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        found.append(f"{path}/{json.loads(text)['data']}")
    return found


def current(spark: SparkSession, path: str) -> str:
    """The folder to read: that of the newest version, or ``path`` itself where no manifest lies."""
    found = versions(spark, path)
    return found[-1] if found else path


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Write a new version with ``write(folder)`` and make it the current one; returns its folder.

    Two writers that meet get different numbers; the one with the higher number wins.
    """
    data = f"data-{uuid.uuid4().hex}"
    write(f"{path}/{data}")
    files, Path = _file_system(spark, path)
    staged = Path(f"{path}/.{data}.json")
    stream = files.create(staged, True)
    try:
        stream.write(bytearray(json.dumps({"data": data}).encode()))
    finally:
        stream.close()
    while True:
        names = _manifests(spark, path)
        number = int(MANIFEST.fullmatch(names[-1])[1]) + 1 if names else 1
        target = Path(f"{path}/_version-{number:010d}.json")
        if not files.exists(target) and files.rename(staged, target):
            return f"{path}/{data}"


def forget(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Take away all but the newest ``keep`` versions, manifests first."""
    if keep < 1:
        raise ValueError("the current version stays")
    files, Path = _file_system(spark, path)
    names, folders = _manifests(spark, path), versions(spark, path)
    for name, folder in list(zip(names, folders))[:-keep]:
        files.delete(Path(f"{path}/{name}"), False)
        files.delete(Path(folder), True)
