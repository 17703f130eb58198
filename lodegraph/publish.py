"""Publication of what a writer made: numbered entries, each claimed by one writer only."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession


class TakenError(RuntimeError):
    """Another writer has published this number."""


class Publications:
    """Entries ``1.json``, ``2.json``, ... in a folder; readers go by the last one.

    An entry is written whole under a name of its own and then given its number by an operation that
    fails where the number exists: a hard link on a local or mounted file system, on others a rename
    without overwriting. Both are atomic on local disks, NFS and HDFS. Object stores emulate a rename by
    a check and a copy, which two writers can pass at once: there, keep this folder on a file system.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[tuple[str, int]]:
        at = self._at(folder)
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def numbers(self) -> list[int]:
        """The published numbers in order."""
        return sorted(int(n[:-5]) for n, _ in self._names(self.path) if n.endswith(".json") and n[0] != ".")

    def last(self) -> int:
        """The last published number, 0 before the first."""
        return max(self.numbers(), default=0)

    def entry(self, number: int) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/{number:09d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def entries(self) -> list[dict]:
        return [self.entry(n) for n in self.numbers()]

    def publish(self, number: int, entry: dict) -> None:
        """Gives ``entry`` the number; raises ``TakenError``, and changes nothing, where another has it."""
        temp, final = self._at(f"{self.path}/.{uuid.uuid4().hex}.tmp"), self._at(f"{self.path}/{number:09d}.json")
        self._fs.mkdirs(final.getParent())
        stream = self._fs.create(temp, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                file = lambda p: self._jvm.java.io.File(self._fs.makeQualified(p).toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(file(final), file(temp))
            else:
                none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(temp, final, options)
        except Exception as x:
            if self._fs.exists(final):
                raise TakenError(f"number {number} of {self.path} is taken") from x
            raise
        finally:
            self._fs.delete(temp, False)

    def sweep(self, folder: str, kept: set[str], hours: float) -> list[str]:
        """Deletes what lies in ``folder`` under other names than ``kept`` and is older than ``hours``; returns the names."""
        limit = (time.time() - hours * 3600) * 1000
        gone = [n for n, at in self._names(folder) if n not in kept and at < limit]
        for n in gone:
            self._fs.delete(self._at(f"{folder}/{n}"), True)
        return gone
