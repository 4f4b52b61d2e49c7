"""Metadata documents and folders, through Spark's own file systems.

A document is a folder of numbered versions, each a file of its own that is
moved into place once it is whole. Readers take the newest; a writer that
names the version it started from fails if another one came between. So there
is no moment without a document, and no update is lost silently.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import Aborted

_VERSION = re.compile(r"v([0-9]+)\.json")


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def list(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        fs, at = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def delete(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at) and fs.delete(at, True)

    def _move(self, path: str, to: str) -> bool:
        """Whether the file is now there; False if another one is."""
        hadoop = self._jvm.org.apache.hadoop.fs
        kinds = hadoop.Options.Rename
        never = self._gateway.new_array(kinds, 1)
        never[0] = kinds.NONE
        source, target = hadoop.Path(path), hadoop.Path(to)
        try:
            hadoop.FileContext.getFileContext(target.toUri(), self._conf).rename(source, target, never)
            return True
        except Py4JJavaError as e:
            kind = e.java_exception.getClass().getSimpleName()
            if kind == "FileAlreadyExistsException":
                return False
            if kind != "UnsupportedFileSystemException":
                raise
        fs = target.getFileSystem(self._conf)
        return not fs.exists(target) and fs.rename(source, target)

    # documents

    def version(self, path: str) -> int:
        """The newest version's number; 0 without a document."""
        return max((int(m[1]) for n in self.list(path) if (m := _VERSION.fullmatch(n))), default=0)

    def write_json(self, path: str, value: dict, after: int | None = None) -> int:
        """Add a version; its number. ``after``: the version that the value was made from, Aborted if it is not the newest."""
        while True:
            now = self.version(path)
            if after is not None and now != after:
                raise Aborted(f"{path} was changed by another writer")
            side = f"{path}/_{uuid.uuid4().hex}.tmp"
            fs, at = self._at(side)
            out = fs.create(at, False)
            out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
            out.close()
            if self._move(side, f"{path}/v{now + 1:012d}.json"):
                for old in self.list(path):  # the one before stays for readers that are about to open it
                    if (m := _VERSION.fullmatch(old)) and int(m[1]) < now:
                        self.delete(f"{path}/{old}")
                return now + 1
            self.delete(side)

    def read_json(self, path: str) -> dict | None:
        """None if there is no such document; anything else that goes wrong raises."""
        return self.read_version(path)[0]

    def read_version(self, path: str) -> tuple[dict | None, int]:
        for _ in range(100):
            now = self.version(path)
            if not now:
                return None, 0
            fs, at = self._at(f"{path}/v{now:012d}.json")
            try:
                source = fs.open(at)
            except Py4JJavaError as e:
                if e.java_exception.getClass().getSimpleName() != "FileNotFoundException":
                    raise
                continue  # two versions newer by now
            raw = self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(source)
            source.close()
            return json.loads(bytes(raw)), now
        raise Aborted(f"{path} changes faster than it can be read")
