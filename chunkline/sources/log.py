"""Tables that grow a batch at a time, with commit marks and levelled merging.

A batch writes runs of its own and then a mark, which lists the runs that make the tables up to that batch. Readers take
the runs of one mark, so a batch is seen whole or not at all. ``FAN`` runs of one level are merged to a run of the next: a
row is written once a level, a batch reads no more than the runs it merges, and readers see few runs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

FAN, KEPT_MARKS = 8, 4


class Marks:
    """The marks of a log below ``path``: small files, each put in place whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path}/_marks"
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._read = jvm.org.apache.commons.io.IOUtils.toString

    def ids(self) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, batch_id: int) -> Any:
        """What the mark says: of a run log, its runs (level, last batch)."""
        stream = self._fs.open(self._at(str(batch_id)))
        try:
            return json.loads(self._read(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, batch_id: int, runs: Any) -> None:
        half = self._at(f".{batch_id}-{uuid.uuid4().hex}")
        out = self._fs.create(half, True)
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()
        # a name that is taken is not given again
        if self._fs.exists(self._at(str(batch_id))) or not self._fs.rename(half, self._at(str(batch_id))):
            self._fs.delete(half, False)
            raise OSError(f"mark {batch_id} of {self.path} is there already")

    def drop(self, batch_id: int) -> None:
        self._fs.delete(self._at(str(batch_id)), False)


class RunLog:
    """One table of rows with a ``batch_id``, of which the newest row of each key counts.

    ``merge`` makes one run of several; by default rows are only put together.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.spark, self.path, self.schema, self.merge, self.marks = spark, path, schema, merge, Marks(spark, path)

    def _run(self, level: int, batch_id: int) -> str:
        return f"{self.path}/run-{level}-{batch_id}"

    def done(self, batch_id: int) -> bool:
        return batch_id in self.marks.ids()

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The batch's own run, anew if the batch is run again."""
        rows.write.mode("overwrite").parquet(self._run(0, batch_id))

    def commit(self, batch_id: int) -> None:
        """Merges what is due, then shows the batch to readers."""
        earlier = [i for i in self.marks.ids() if i < batch_id]
        runs = (self.marks.read(earlier[-1]) if earlier else []) + [[0, batch_id]]
        while len(runs) >= FAN and len({level for level, _ in runs[-FAN:]}) == 1:
            level = runs[-1][0]
            old, runs = runs[-FAN:], runs[:-FAN]
            self.merge(self._read(old)).write.mode("overwrite").parquet(self._run(level + 1, batch_id))
            runs.append([level + 1, batch_id])
        self.marks.write(batch_id, runs)
        self._vacuum()

    def _vacuum(self) -> None:
        """Old marks go, and the runs that only they had."""
        ids = self.marks.ids()
        kept = {tuple(r) for i in ids[-KEPT_MARKS:] for r in self.marks.read(i)}
        for i in ids[:-KEPT_MARKS]:
            for run in self.marks.read(i):
                if tuple(run) not in kept:
                    self.marks._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._run(*run)), True)
            self.marks.drop(i)

    def _read(self, runs: list[list[int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._run(*r) for r in runs])

    def runs(self) -> list[list[int]]:
        ids = self.marks.ids()
        return self.marks.read(ids[-1]) if ids else []

    def table(self) -> DataFrame:
        """The rows of the newest mark, merged."""
        return self.merge(self._read(self.runs()))
