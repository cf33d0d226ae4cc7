"""Numbered commits: every state of a set of tables has a number, and two writers never both get the same one.

A commit is a small JSON file ``<number>.json`` in the log's folder. It is written aside and renamed to its
name, which fails if the name exists. Whoever comes second has worked from an old state and must start again.
That needs a file system whose rename refuses an existing target in one step, as HDFS does; a local disk checks
first and renames then, which is enough for the writers of one machine's session.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ledgerloom.sinks.publish import hadoop_path

_NUMBERED = re.compile(r"([0-9]{20})\.json")


class CommitConflict(RuntimeError):
    """Another writer has committed since this one looked."""


class CommitLog:
    """Commits of one folder, from 1 on."""

    def __init__(self, spark: SparkSession, home: str) -> None:
        self.spark, self.home = spark, home.rstrip("/")

    def _name(self, number: int) -> str:
        return f"{self.home}/{number:020d}.json"

    def version(self) -> int:
        """Number of the last commit, 0 without one. The listing has one short name per commit."""
        store, folder, _ = hadoop_path(self.spark, self.home)
        if not store.exists(folder):
            return 0
        found = (_NUMBERED.fullmatch(status.getPath().getName()) for status in store.listStatus(folder))
        return max((int(m.group(1)) for m in found if m), default=0)

    def read(self, number: int) -> dict:
        store, path, jvm = hadoop_path(self.spark, self._name(number))
        stream = store.open(path)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> dict | None:
        number = self.version()
        return self.read(number) if number else None

    def entries(self, schema: StructType | str) -> DataFrame:
        """One row per commit with the fields of ``schema``."""
        number = self.version()
        if not number:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json([self._name(n) for n in range(1, number + 1)])

    def commit(self, after: int, content: dict) -> int:
        """Commit ``content`` as the state that follows number ``after``; returns its number."""
        store, aside, jvm = hadoop_path(self.spark, f"{self.home}/.{uuid.uuid4().hex}")
        stream = store.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(content), "utf-8"))
        finally:
            stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        target = store.makeQualified(jvm.org.apache.hadoop.fs.Path(self._name(after + 1)))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(store.makeQualified(aside), target, options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            store.delete(aside, False)
            raise CommitConflict(f"commit {after + 1} of {self.home} exists: another writer was first") from None
        return after + 1
