"""S3's sink: reports that are written in steps, each of which is there as a whole or not at all.

A sink is a folder of segments and manifests. A segment holds, as JSON lines by partition of tracks, the reports that are new
or have changed since the one before, and marks for tracks that are gone; a report that is the same, by a fingerprint
of its row, isn't written again. The manifest with the highest number lists the segments that count, in order. It's
written beside its place and renamed into it once its segment stands, so a write that is interrupted leaves the sink as it
was (and a folder that nothing lists, which the next write removes); a write of the same reports changes nothing. Two
writers at once both work from the same manifest; the second finds the number taken and fails. After `COMPACT`
segments the next one holds everything."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Partitions of a segment; segments in a row before all is written anew.
PARTITIONS, COMPACT = 64, 16
_STATE = ["_print", "_gone", "_part"]


class Folder:
    """A folder in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, of: str) -> list[str]:
        at = self._at(of)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """As a whole or not at all; fails if the name is taken."""
        beside = self._at(f"{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(beside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(beside, self._at(name)):
            self._fs.delete(beside, False)
            raise FileExistsError(f"{self.path}/{name} was written by another")

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def _manifest(folder: Folder) -> tuple[int, dict]:
    """The number and content of the manifest that counts; 0 and none before the first write."""
    numbers = [int(n.removesuffix(".json")) for n in folder.names("manifests") if n.removesuffix(".json").isdigit()]
    if not numbers:
        return 0, {"segments": [], "schema": None}
    return max(numbers), json.loads(folder.read(f"manifests/{max(numbers)}.json"))


def _commit(folder: Folder, number: int, content: dict) -> None:
    folder.write(f"manifests/{number}.json", json.dumps(content))


def _latest(spark: SparkSession, folder: Folder, content: dict) -> DataFrame:
    """The last row of every track, gone or not."""
    schema = T.StructType.fromJson(content["schema"])
    parts = [spark.read.schema(schema).json(f"{folder.path}/segments/{s}").withColumn("_segment", F.lit(i)) for i, s in enumerate(content["segments"])]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    whole = F.struct(*[F.col(c) for c in schema.names])
    return rows.groupBy("track_id").agg(F.max_by(whole, "_segment").alias("r")).select("r.*")


def write_report(report: DataFrame, path: str) -> int:
    """S3: brings the sink at `path` to hold exactly the rows of report(track_id, ...), of which a track has one, and returns
    how many tracks were written: 0 if nothing has changed. Columns must stay the same from write to write."""
    spark = report.sparkSession
    folder = Folder(spark, path)
    number, content = _manifest(folder)
    for name in set(folder.names("segments")) - set(content["segments"]):  # of a write that didn't end
        folder.remove(f"segments/{name}")
    marked = report.withColumn("_print", F.sha2(F.to_json(F.struct(*[F.col(c) for c in report.columns])), 256)).withColumn("_gone", F.lit(False))
    state = marked.withColumn("_part", F.pmod(F.xxhash64("track_id"), F.lit(PARTITIONS)).cast("int"))
    schema = json.loads(state.schema.json())
    if content["schema"] and [f["name"] for f in content["schema"]["fields"]] != state.columns:
        raise ValueError("the report has other columns than the sink")
    compact = not content["segments"] or len(content["segments"]) >= COMPACT
    if not content["segments"]:
        changed = state
    else:
        before = _latest(spark, folder, content).select("track_id", F.col("_print").alias("_had"), F.col("_gone").alias("_was_gone"))
        met = state.alias("n").join(before.alias("b"), "track_id", "full")
        left = F.col("_print").isNull() & ~F.col("_was_gone")
        new = F.col("_print").isNotNull() & (F.col("_had").isNull() | F.col("_was_gone") | (F.col("_had") != F.col("_print")))
        values = {c: F.col(f"n.{c}") for c in state.columns if c != "track_id"}
        values |= {"_gone": F.col("_print").isNull(), "_part": F.pmod(F.xxhash64("track_id"), F.lit(PARTITIONS)).cast("int")}
        changed = met.where(left | new).select("track_id", *[c.alias(n) for n, c in values.items()]).select(*state.columns)
    segment = uuid.uuid4().hex
    where = f"{folder.path}/segments/{segment}"
    changed.repartition("_part").write.partitionBy("_part").json(where)
    stored = spark.read.schema(state.schema).json(where)
    written = stored.count()
    if not written and content["segments"]:
        folder.remove(f"segments/{segment}")
        return 0
    if compact and content["segments"]:  # everything again, in one segment
        folder.remove(f"segments/{segment}")
        state.repartition("_part").write.partitionBy("_part").json(where)
    _commit(folder, number + 1, {"segments": [segment] if compact else [*content["segments"], segment], "schema": schema})
    return written


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The reports in the sink at `path`, as they were written last."""
    folder = Folder(spark, path)
    _, content = _manifest(folder)
    if not content["segments"]:
        raise FileNotFoundError(f"{path} holds no report")
    return _latest(spark, folder, content).where(~F.col("_gone")).drop(*_STATE)
