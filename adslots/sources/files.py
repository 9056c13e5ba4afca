"""S2's source: analysis payloads from files, and what couldn't be read of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that is read; each is read by one task, whole.
MAX_BYTES = 64 << 20

OVERSIZED, NOT_TEXT, NOT_JSON, NO_TRACK = "over the size limit", "not UTF-8", "not JSON", "no track_id"


def _track(line: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(line), "$.track_id", "long")


def scan_payloads(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(payloads, rejects) of the files under `path`, of one JSON object a line, each with its track_id.

    payloads(track_id, payload, file, line_offset) are the lines that can be read. rejects(file, line_offset, n_bytes, reason)
    are files over max_bytes (whose content isn't read at all) and files that are no UTF-8, at offset 0, and lines
    that are no JSON or have no track_id, at the byte where they start. A bad line doesn't cost its file the others; blank
    lines and empty files hold nothing. A folder without files gives two empty results."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    none = F.lit(0).cast("long").alias("line_offset")
    large = files.where(F.col("length") > max_bytes).select(F.col("path").alias("file"), none, F.col("length").alias("n_bytes"), F.lit(OVERSIZED).alias("reason"))
    fit = files.where(F.col("length") <= max_bytes).select(F.col("path").alias("file"), "length", F.is_valid_utf8(F.col("content").cast("string")).alias("ok"), F.col("content").cast("string").alias("text"))
    binary = fit.where(~F.col("ok")).select("file", none, F.col("length").alias("n_bytes"), F.lit(NOT_TEXT).alias("reason"))

    good = fit.where("ok")
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("i"), F.rtrim(line, F.lit("\r")).alias("line")))
    told = F.filter(lines, lambda x: F.trim(x["line"]) != "")
    # a line's place is counted from the text itself
    at = lambda x: F.when(x["i"] == 0, F.lit(0)).otherwise(F.octet_length(F.call_function("substring_index", F.col("text"), F.lit("\n"), x["i"])) + 1).cast("long")
    placed = F.transform(told, lambda x: F.struct(at(x).alias("line_offset"), x["line"].alias("line"), _track(x["line"]).alias("track_id"), F.try_parse_json(x["line"]).isNull().alias("broken")))
    rows = good.select("file", F.explode(placed).alias("x")).select("file", "x.*")
    bad = rows.where("track_id IS NULL").select("file", "line_offset", F.octet_length("line").cast("long").alias("n_bytes"), F.when(F.col("broken"), NOT_JSON).otherwise(NO_TRACK).alias("reason"))
    payloads = rows.where("track_id IS NOT NULL").select("track_id", F.col("line").alias("payload"), "file", "line_offset")
    return payloads, large.unionByName(binary).unionByName(bad)
