"""Reading and writing log files, blobs and key-value logs with Spark's own formats."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.functions.scalars import manifest_digest

#: So many bytes of a log's head tell whether it was rotated.
SIGNATURE_BYTES = 512
#: Parts of a log file's name: pid, born, thread, from, and once closed to, count and id.
LOG_NAME = r"pid([0-9]+)_born([0-9]+)_thread([A-Za-z0-9]+)_from([0-9]+)(?:_to([0-9]+)_count([0-9]+)_id([A-Za-z0-9]+))?\.jsonl"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their file's name; torn or foreign lines are dropped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    return lines.select(F.from_json("value", f"{schema}, _torn string", {"columnNameOfCorruptRecord": "_torn"}).alias("e"), "file").where("e is not null and e._torn is null").select("e.*", "file").drop("_torn")


def write_log(entries: DataFrame, path: str, most_rows: int = 1_000_000) -> None:
    """Appends entries as JSON lines, a new file every ``most_rows``."""
    entries.write.mode("append").option("maxRecordsPerFile", most_rows).option("compression", "gzip").json(path)


def log_catalog(files: DataFrame, name: str) -> DataFrame:
    """``files`` with what their names tell: pid, born, thread, from_time, to_time, count, id."""
    part = lambda i: F.nullif(F.regexp_extract(name, LOG_NAME, i), F.lit(""))
    kinds = (("pid", "long"), ("born", "long"), ("thread", "string"), ("from_time", "long"), ("to_time", "long"), ("count", "long"), ("file_id", "string"))
    return files.where(F.col(name).rlike(LOG_NAME)).select("*", *(part(i + 1).cast(kind).alias(c) for i, (c, kind) in enumerate(kinds)))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, modified`` of all files under a folder. Only these columns are asked
    of the binary source, so no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def without_deleted(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Files that no marker ``(delete_files array)`` names."""
    return files.join(markers.select(F.explode("delete_files").alias("file")), "file", "left_anti")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, sha256`` of files, both of the bytes with line ends normalised."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", manifest_digest(F.col("content")).alias("d")).select("path", "d.*")


def log_tail(spark: SparkSession, path: str, state: dict) -> tuple[DataFrame, dict]:
    """New lines ``(line)`` of a log that is rotated, and the state to pass next time:
    ``signature`` of the head and ``offset`` read so far (bytes).

    A first look starts at the end. A file that has another head, or is shorter than what
    was read, is new and is read from its start; else reading goes on at the offset. Text
    behind the last newline waits.
    """
    content = spark.read.format("binaryFile").load(path).select("content", "length", F.sha2(F.substring("content", 1, state.get("head", SIGNATURE_BYTES)), 256).alias("seen"), F.sha2(F.substring("content", 1, SIGNATURE_BYTES), 256).alias("signature"))
    whole = F.length("content") - F.coalesce(F.locate("\n", F.reverse(F.decode("content", "ISO-8859-1"))), F.lit(0)) + 1
    end = F.when(F.decode("content", "ISO-8859-1").contains("\n"), whole).otherwise(0)
    row = content.select("length", "seen", "signature", end.cast("long").alias("end")).first()
    fresh = {"signature": row.signature, "head": min(SIGNATURE_BYTES, row.length), "offset": row.end}
    start = row.end if not state else 0 if row.seen != state["signature"] or row.length < state["offset"] else state["offset"]
    part = content.select(F.substring(F.col("content"), F.lit(start + 1), F.lit(max(0, row.end - start))).cast("string").alias("text"))
    return part.select(F.explode(F.split("text", "\n")).alias("line")).where("line != ''"), fresh


def replay_key_values(log: DataFrame) -> DataFrame:
    """``key, value, time`` of a log ``(key, value, time, file, pos, deleted)``; of equal
    times the later entry counts."""
    best = log.groupBy("key").agg(F.max_by(F.struct("value", "time", "deleted"), F.struct("time", "file", "pos")).alias("b"))
    return best.where("not b.deleted").select("key", "b.value", "b.time")


def needs_compaction(records: int, keys: int) -> bool:
    return records > max(1000, 3 * keys)


def newest_release(files: DataFrame, name: str, content: str) -> DataFrame:
    """Of deploy files ``<app>_<version>.json`` the newest of each app by releaseTime."""
    parsed = files.select(F.regexp_extract(name, r"^(.*)_([^_]+)\.json$", 1).alias("app"), F.regexp_extract(name, r"^(.*)_([^_]+)\.json$", 2).alias("version"), F.get_json_object(content, "$.releaseTime").cast("long").alias("release_time"))
    return parsed.where("app != '' and release_time is not null").groupBy("app").agg(F.max_by("version", F.struct("release_time", "version")).alias("version"), F.max("release_time").alias("release_time"))


def parse_flat_yaml(text: Column) -> Column:
    """A flat YAML mapping (fenced or not) as map<string,string>; nested values are left out."""
    body = F.regexp_replace(text, r"(?s)^.*?```(?:ya?ml)?\n(.*?)```.*$", "$1")
    pairs = F.filter(F.transform(F.split(body, "\n"), lambda line: F.struct(F.regexp_extract(line, r"^([A-Za-z0-9_.-]+)\s*:\s*(.+?)\s*$", 1).alias("key"), F.regexp_replace(F.regexp_extract(line, r"^([A-Za-z0-9_.-]+)\s*:\s*(.+?)\s*$", 2), r"^[\"']|[\"']$", "").alias("value"))), lambda p: p["key"] != "")
    return F.map_from_entries(F.array_distinct(pairs))


def read_pointer(spark: SparkSession, path: str) -> dict | None:
    """The small JSON file that says which version of a table counts, by Hadoop's file API."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def swap_pointer(spark: SparkSession, path: str, value: dict) -> None:
    """Puts a new pointer in place in one step: written beside it and renamed over it."""
    jvm = spark._jvm
    target, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".new")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename
    context.rename(fresh, target, options)
