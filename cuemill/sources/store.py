"""Stage cache and file formats.

Artifacts are Spark folders written by Spark's own commit protocol; the manifest is a small JSON
table read and written through Spark as well, so that any file system it knows will do."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CUES = "media_id bigint, seq bigint, start_ms bigint, end_ms bigint, raw_text string, plain_text string, attributes array<struct<key:string,value:string>>"
FRAMES = "media_id bigint, index bigint, sample_s double, text string, observations array<struct<text:string,x:double,y:double,w:double,h:double>>, reused boolean"


def stage_key(*parts) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def contiguous_prefix(records: DataFrame, key: str = "media_id", index: str = "index", order: str | Column = "written") -> DataFrame:
    """The last record of each index, as far as indices run 0, 1, 2, … without a gap."""
    latest = F.row_number().over(W.partitionBy(key, index).orderBy(F.desc(order) if isinstance(order, str) else order))
    rows = records.withColumn("_n", latest).where("_n = 1").drop("_n")
    place = F.row_number().over(W.partitionBy(key).orderBy(index))
    return rows.withColumn("_p", place).where(F.col(index) == F.col("_p") - 1).drop("_p")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame records from JSON lines; lines that do not parse are skipped, the last of an index wins."""
    lines = spark.read.text(path).select(F.from_json("value", FRAMES).alias("r"), F.col("_metadata.file_modification_time").alias("t"), F.monotonically_increasing_id().alias("written"))
    rows = lines.where("r.index is not null").select("r.*", "t", "written")
    return contiguous_prefix(rows.withColumn("written", F.struct("t", "written"))).drop("t", "written")


STAGES = {"speech": ("locale",), "frames": ("locale", "fps"), "texts": ("locale", "fps", "profile", "layout"), "merge": ("speech", "texts", "locale")}


def key_of(stage: str, **parts) -> str:
    """Key of a stage from the settings that its result depends on."""
    return stage_key(stage, *[parts[p] for p in STAGES[stage]])


def fingerprint(spark: SparkSession, path: str) -> dict:
    """Path, size and time of change (seconds) of an input file, by Spark's file reader."""
    row = spark.read.format("binaryFile").load(path).select("path", "length", F.unix_micros("modificationTime").alias("t")).first()
    return {"path": row["path"], "size": row["length"], "modified": row["t"] / 1e6}


def workspace(root: str, mark: dict) -> str:
    """Folder of an input below a root, by its fingerprint."""
    return f"{root.rstrip('/')}/{stage_key(mark['path'], mark['size'], mark['modified'])}"


def to_iso(t: Column) -> Column:
    """A timestamp as ISO 8601 in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_iso(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


class StageStore:
    """Stages of one input below a folder: reuse when input, key and state agree and the artifact is there, else compute and write.

    mark is the input's fingerprint; a manifest of another input, or one that cannot be read, counts as none."""

    def __init__(self, spark: SparkSession, root: str, resume: bool = True, mark: dict | None = None):
        self.spark, self.root, self.resume, self.input = spark, root.rstrip("/"), resume, mark

    def _path(self, stage: str, what: str) -> str:
        return f"{self.root}/{stage}.{what}"

    def _files(self, path: str):
        """The file system of a path and the path, as Spark's own Hadoop client sees them."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def exists(self, path: str) -> bool:
        files, at = self._files(path)
        return files.exists(at)

    def delete(self, path: str) -> None:
        files, at = self._files(path)
        files.delete(at, True)

    def mark(self, stage: str, state: str, key: str, error: str | None = None, metadata: dict[str, str] | None = None, reset: tuple[str, ...] = ()) -> None:
        """Write a stage's record; metadata stays as it was unless given, artifacts named in reset go first."""
        for what in reset:
            self.delete(self._path(stage, what))
        if metadata is None and state != "running":
            metadata = (self.state(stage) or {}).get("metadata", {})
        now = datetime.now(UTC).isoformat(timespec="seconds")
        record = {"stage": stage, "state": state, "key": key, "error": error, "metadata": metadata or {}, "input": self.input, "updated": now}
        text = json.dumps(record, sort_keys=True)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(self._path(stage, "state"))

    def state(self, stage: str) -> dict | None:
        path = self._path(stage, "state")
        row = self.spark.read.text(path).first() if self.exists(path) else None
        try:
            record = json.loads(row[0]) if row else None
        except ValueError:
            return None
        return record if record and record.get("input") == self.input else None

    def reusable(self, stage: str, key: str, what: str = "cues") -> bool:
        got = self.state(stage) if self.resume else None
        return bool(got) and got["state"] == "completed" and got["key"] == key and self.exists(f"{self._path(stage, what)}/_SUCCESS")

    def load_or_create(self, stage: str, key: str, create, schema: str = CUES) -> DataFrame:
        """The stage's artifact, made anew unless it can be reused."""
        if not self.reusable(stage, key):
            self.recompute(stage, key, create)
        return self.spark.read.schema(schema).json(self._path(stage, "cues"))

    def recompute(self, stage: str, key: str, create) -> None:
        """Compute and write a stage whatever is there, as the merge of two timelines is."""
        self.mark(stage, "running", key)
        try:
            create().write.mode("overwrite").json(self._path(stage, "cues"))
        except Exception as e:
            self.mark(stage, "failed", key, str(e)[:500])
            raise
        self.mark(stage, "completed", key)

    def load(self, stage: str, schema: str = CUES) -> DataFrame | None:
        """The stage's artifact, or None where there is none."""
        path = self._path(stage, "cues")
        return self.spark.read.schema(schema).json(path) if self.exists(path) else None

    def append_frames(self, records: DataFrame, key: str, total: int) -> None:
        """Append frame records and note how far their contiguous indices reach."""
        path = self._path("frames", "records")
        records.write.mode("append").json(path)
        done = read_frames(self.spark, path).agg(F.coalesce(F.max("index") + 1, F.lit(0)).alias("n")).first()["n"]
        self.mark("frames", "completed" if done >= total else "running", key, metadata={"frames": str(total), "completed": str(done)})


def write_documents(lines: DataFrame, path: str) -> None:
    """ASS documents, a folder for each media item; lines are sorted in the partition of their item."""
    lines.repartition("media_id").sortWithinPartitions("media_id", "line_no").select("media_id", "line").write.partitionBy("media_id").mode("overwrite").text(path)
