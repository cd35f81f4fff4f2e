"""Numbered commits: small JSON files in a shared folder, each of which exactly one writer can create.

A commit is written in full under another name and then renamed to its number, which fails if that number is taken (``FileContext``'s
rename without overwriting, which is atomic on HDFS; an object store needs a committer that gives the same).  Readers see whole commits
only.  Whoever loses reads the new state and decides whether to try again on top of it.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Listed:
    """A file or folder: its name and when it was last changed, in milliseconds."""

    name: str
    changed: int


class Folder:
    """A folder of any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.hadoop = spark, spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        bare = self.hadoop.Path(path)
        self.fs = bare.getFileSystem(self.conf)
        self.path = self.fs.makeQualified(bare)

    def at(self, name: str):
        return self.hadoop.Path(self.path, name)

    def listed(self) -> list[Listed]:
        """What lies in it; nothing if it is not there."""
        if not self.fs.exists(self.path):
            return []
        return [Listed(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(self.path)]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file is now there with this text; False if it was there before."""
        own = self.at(f".{uuid.uuid4().hex}.tmp")
        out = self.fs.create(own, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        rename = getattr(self.hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self.hadoop.FileContext.getFileContext(self.path.toUri(), self.conf).rename(own, self.at(name), options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                raise
            self.fs.delete(own, False)
            return False

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def weight(self, name: str) -> tuple[int, int]:
        """(files, bytes) below a name."""
        found = self.fs.getContentSummary(self.at(name))
        return found.getFileCount(), found.getLength()


class Commits:
    """States of one table or manifest by number; 0 is the state before the first."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.folder = Folder(spark, path)

    def numbers(self) -> list[tuple[int, int]]:
        """(number, time) of each commit, rising."""
        return sorted((int(f.name.removesuffix(".json")), f.changed) for f in self.folder.listed() if re.fullmatch(r"\d+\.json", f.name))

    def state(self, number: int) -> dict:
        return json.loads(self.folder.read(f"{number:010d}.json"))

    def newest(self) -> tuple[int, dict]:
        """(number, state) of the last commit; (0, {}) if there is none."""
        found = self.numbers()
        return (found[-1][0], self.state(found[-1][0])) if found else (0, {})

    def claim(self, number: int, state: dict) -> bool:
        """Publish a state as commit ``number``; False if another writer has that number."""
        return self.folder.create(f"{number:010d}.json", json.dumps(state))

    def forget(self, before: int) -> tuple[list[dict], int]:
        """Remove commits that were followed by another at a time earlier than ``before`` (milliseconds); the newest stays.

        (states that are left, how many were removed)."""
        found, left, gone = self.numbers(), [], 0
        for (number, _), following in zip(found, [*(t for _, t in found[1:]), None], strict=True):
            if following is not None and following < before:
                self.folder.remove(f"{number:010d}.json")
                gone += 1
            else:
                left.append(self.state(number))
        return left, gone
