"""Small metadata files on any Hadoop file system, with exclusive creation as the only commit primitive."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class FileExists(Exception):
    pass


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system: a bare one belongs to the cluster's default file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return str(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target))


# Schemes that Hadoop and Arrow spell differently.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def arrow_uri(uri: str) -> str:
    """A URI as Hadoop writes it, as Arrow reads it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        return "file://" + uri[5:]
    scheme, mark, rest = uri.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}{mark}{rest}"


def open_uri(uri: str) -> tuple[Any, str]:
    """Arrow's file system and the path in it, for a URI as Hadoop writes it; works on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(uri))


# Object stores, where a file appears whole when it is closed and a rename is a copy.
OBJECT_STORES = ("s3", "s3a", "s3n", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cosn", "obs")


def publish(spark: SparkSession, path: str, data: bytes) -> None:
    """Put a new file in its place in one step; FileExists if there is one already, any other fault as it is.

    The bytes are written under a hidden name first, so neither a reader nor a writer that dies in between ever leaves
    a part of them under the final one. Then the hidden file is linked (local files) or renamed without overwriting.
    """
    sc = spark.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    scheme = target.toUri().getScheme()
    if fs.exists(target):
        raise FileExists(path)
    if scheme == "file":
        name = target.toUri().getPath()
        folder, last = os.path.split(name)
        os.makedirs(folder, exist_ok=True)
        hidden = f"{folder}/.{last}.{uuid.uuid4().hex}"
        try:
            with open(hidden, "wb") as out:
                out.write(data)
                out.flush()
                os.fsync(out.fileno())
            os.link(hidden, name)
        except FileExistsError:
            raise FileExists(path) from None
        finally:
            if os.path.exists(hidden):
                os.remove(hidden)
        return
    hidden = target if scheme in OBJECT_STORES else jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    try:
        out = fs.create(hidden, False)
        out.write(data)
        out.close()
        if hidden is not target:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(hidden, target, sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if hidden is not target:
            fs.delete(hidden, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            raise FileExists(path) from None
        raise


class Store:
    """Files below a root folder, by relative name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, qualified(spark, root).rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path("").getFileSystem(self._conf)

    def uri(self, name: str) -> str:
        return name if ":" in name else f"{self.root}/{name}" if name else self.root

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.uri(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def list(self, name: str) -> list[tuple[str, int]]:
        """(uri, bytes) of the files and folders directly below a folder; empty if it does not exist."""
        if not self.exists(name):
            return []
        return sorted((str(s.getPath()), s.getLen()) for s in self._fs.listStatus(self.path(name)))

    def folders(self, name: str) -> list[str]:
        return sorted(str(s.getPath()) for s in self._fs.listStatus(self.path(name)) if s.isDirectory()) if self.exists(name) else []

    def untouched(self, name: str, before_millis: int) -> list[str]:
        """Folders directly below one that were last changed before a time."""
        return sorted(str(s.getPath()) for s in self._fs.listStatus(self.path(name)) if s.isDirectory() and s.getModificationTime() < before_millis) if self.exists(name) else []

    def read(self, name: str) -> Any:
        stream = self._fs.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, name: str, content: Any) -> None:
        """Write a new file; FileExists if there is one already."""
        publish(self.spark, self.uri(name), json.dumps(content, default=str).encode())

    def delete(self, name: str) -> bool:
        return self._fs.delete(self.path(name), True)

    def latest(self, folder: str, known: int = 0) -> int:
        """Highest version of the numbered files in a folder, 0 if there are none.

        Numbers have no gaps, so if the one after a known version is not there, the folder is not listed.
        """
        if known and not self.exists(f"{folder}/{known + 1:020d}.json"):
            return known
        return max([0, *(int(uri.rsplit("/", 1)[1].split(".")[0]) for uri, _ in self.list(folder) if uri.endswith(".json"))])
