"""A collection on storage: appended mutations over a key-sorted snapshot.

    <path>/current.json          which snapshot counts, and which mutations it has taken in
    <path>/snapshots/<version>/  Parquet, sorted by key
    <path>/log/batch=<n>/        Parquet, a folder a batch

Readers take what the pointer names, so a compaction is seen whole or not at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood import model
from driftwood.operators import lww, stats
from driftwood.plans import compaction
from driftwood.sources.files import read_pointer, swap_pointer


class Collection:
    """``columns`` is a DDL string of the value columns, without key, time and seq."""

    def __init__(self, spark: SparkSession, path: str, columns: str, key_type: str = "string"):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = f"key {key_type}, time timestamp, seq long, op string, set_cols array<string>, {columns}"
        self.columns = model.value_columns(spark.createDataFrame([], self.schema))

    # --- writing

    def _append(self, rows: DataFrame) -> None:
        batch = uuid.uuid4().hex
        empty = self.spark.createDataFrame([], self.schema)
        empty.unionByName(rows, allowMissingColumns=True).write.parquet(f"{self.path}/log/batch={batch}")

    def write(self, rows: DataFrame, time, seq: str) -> None:
        """Upserts: sets the columns that ``rows`` (key, seq, some columns) has."""
        self._append(model.writes(rows, "key", F.lit(time).cast("timestamp"), F.col(seq), [c for c in rows.columns if c in self.columns]))

    def update(self, rows: DataFrame, time, seq: str) -> None:
        """Like ``write``, for keys that are live; other rows are void."""
        self.write(lww.update_existing(self.log(), rows), time, seq)

    def delete(self, keys: DataFrame, time, seq: str) -> None:
        self._append(model.deletes(keys, "key", F.lit(time).cast("timestamp"), F.col(seq)))

    # --- reading

    def _current(self) -> dict:
        return read_pointer(self.spark, f"{self.path}/current.json") or {"snapshot": None, "taken": []}

    def _batches(self) -> list[str]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().toString() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _open(self, current: dict) -> list[str]:
        return [b for b in self._batches() if b.rpartition("=")[2] not in current["taken"]]

    def log(self) -> DataFrame:
        """All mutations that count, as one log: the snapshot's and those after it."""
        current = self._current()
        paths = self._open(current) + ([f"{self.path}/snapshots/{current['snapshot']}"] if current["snapshot"] else [])
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def get_column(self, column: str) -> DataFrame:
        return lww.get_column(self.log(), column)

    def get_single_field(self, key, column: str) -> DataFrame:
        return lww.get_single_field(self.log(), key, column)

    def get_keys(self) -> DataFrame:
        return lww.live_keys(self.log())

    def rows(self) -> DataFrame:
        return lww.resolve(self.log(), self.columns)

    def info(self) -> DataFrame:
        return stats.reader_info(self.log())

    # --- compaction

    def due(self) -> bool:
        """Whether the mutations since the last snapshot have reached a trigger: bytes to
        fold, or batches to combine."""
        fs_of = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        open_ = self._open(self._current())
        size = sum(fs_of.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(b)).getLength() for b in open_)
        return size >= compaction.FOLD_BYTES or len(open_) >= compaction.COMBINE_FILES

    def compact(self, size: int = 0, only_if_due: bool = False) -> str | None:
        """Rewrites all mutations as a new snapshot, sorted by key in files of about 256 MB,
        and makes it the current one. Reads are the same before and after. With
        ``only_if_due`` nothing is done below the triggers."""
        if only_if_due and not self.due():
            return None
        current = self._current()
        taken = [b.rpartition("=")[2] for b in self._open(current)]
        version = uuid.uuid4().hex
        files = compaction.output_files(size) if size else None
        rows = lww.compacted(self.log())
        rows = rows.repartitionByRange(files, "key") if files else rows.repartitionByRange("key")
        rows.sortWithinPartitions("key").write.parquet(f"{self.path}/snapshots/{version}")
        swap_pointer(self.spark, f"{self.path}/current.json", {"snapshot": version, "taken": current["taken"] + taken})
        return version

    def clean(self) -> int:
        """Deletes mutations and snapshots that the pointer no longer names. Run it when no
        reader of an older version is left."""
        current = self._current()
        jvm = self.spark._jvm
        gone = [b for b in self._batches() if b.rpartition("=")[2] in current["taken"]]
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone += [s.getPath().toString() for s in (fs.listStatus(at) if fs.exists(at) else []) if s.getPath().getName() != current["snapshot"]]
        for path in gone:
            fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)
        return len(gone)
