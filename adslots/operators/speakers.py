"""Speakers, voices and scripts (K1 to K6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import by_track, field, unfenced, trimmed


def top_speakers(turns: DataFrame, k: int = 2) -> DataFrame:
    """K1: (track_id, turn_idx, speaker, start_ms, end_ms) of the two labels that speak longest, named A and B (the
    one heard first, at equal length); empty turns and other labels go."""
    real = turns.where("end_ms > start_ms")
    totals = real.groupBy("track_id", "label").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total"), F.min("turn_idx").alias("first"))
    names = totals.withColumn("n", F.row_number().over(by_track(F.desc("total"), "first"))).where(F.col("n") <= k).select("track_id", "label", F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("n"), F.lit(1)).alias("speaker"))
    return real.join(names, ["track_id", "label"]).select("track_id", "turn_idx", "speaker", "start_ms", "end_ms")


def within_budget(used: DataFrame, max_ms: int) -> DataFrame:
    """What is taken of each turn, of which `used` were taken before."""
    length = F.col("end_ms") - F.col("start_ms")
    return used.withColumn("take_ms", F.least(length, F.greatest(F.lit(0), F.lit(max_ms) - F.col("used")))).where("take_ms > 0").select("track_id", "speaker", "turn_idx", "start_ms", "take_ms")


def sample_budget(speakers: DataFrame, max_ms: int = 30000) -> DataFrame:
    """K2: (track_id, speaker, turn_idx, start_ms, take_ms): turns in order until the budget is used, the last cut."""
    w = W.partitionBy("track_id", "speaker").orderBy("turn_idx").rowsBetween(W.unboundedPreceding, -1)
    length = F.col("end_ms") - F.col("start_ms")
    return within_budget(speakers.withColumn("used", F.coalesce(F.sum(length).over(w), F.lit(0))), max_ms)


def _line(idx: int, speaker: str, text: Column) -> Column:
    return F.struct(F.lit(idx).alias("line_idx"), F.lit(speaker).alias("speaker"), text.alias("text"))


def template_lines(products: DataFrame, opener: str = "Quick shout-out to %s.") -> DataFrame:
    """The lines of a script that has none, by mode. Another opener serves where no model is configured."""
    both = F.concat_ws(" ", "name", "blurb")
    lines = (
        F.when(F.col("ad_mode") == "DUO", F.array(_line(0, "A", F.format_string(opener, "name")), _line(1, "B", F.col("blurb"))))
        .when(F.col("ad_mode") == "B_ONLY", F.array(_line(0, "B", both))).otherwise(F.array(_line(0, "A", both)))
    )
    return products.select("track_id", F.explode(lines).alias("l")).select("track_id", "l.*")


def script_lines(responses: DataFrame, products: DataFrame) -> DataFrame:
    """K3: (track_id, line_idx, speaker, text) of answers; lines that are no objects, of other speakers or empty go,
    the others stay; tracks left without lines get the template of their mode."""
    v = responses.select("track_id", F.try_parse_json(unfenced(F.col("raw_text"))).alias("v"))
    lines = v.select("track_id", F.posexplode(F.try_variant_get("v", "$.segments", "array<variant>")).alias("line_idx", "s"))
    said = lines.select("track_id", "line_idx", F.upper(trimmed(F.coalesce(field(F.col("s"), "$.speaker"), F.lit("")))).alias("speaker"), trimmed(F.coalesce(field(F.col("s"), "$.text"), F.lit(""))).alias("text")).where("speaker IN ('A', 'B') AND text <> ''")
    without = products.join(said.select("track_id").distinct(), "track_id", "left_anti")
    return said.unionByName(template_lines(without))


def lines_for_mode(lines: DataFrame, products: DataFrame, opener: str = "Quick shout-out to %s.") -> DataFrame:
    """K4: one-speaker modes keep that speaker's lines, or say the blurb; a duo of fewer than two lines is replaced."""
    mine = products.select("track_id", "ad_mode")
    kept = lines.join(mine, "track_id").where((F.col("ad_mode") == "DUO") | (F.substring("ad_mode", 1, 1) == F.col("speaker"))).withColumn("_n", F.count(F.lit(1)).over(by_track()))
    enough = kept.where((F.col("ad_mode") != "DUO") | (F.col("_n") >= 2)).select("track_id", "line_idx", "speaker", "text")
    without = products.join(enough.select("track_id").distinct(), "track_id", "left_anti")
    duo = template_lines(without.where("ad_mode = 'DUO'"), opener)
    one = without.where("ad_mode <> 'DUO'").select("track_id", F.lit(0).alias("line_idx"), F.substring("ad_mode", 1, 1).alias("speaker"), F.col("blurb").alias("text"))
    return enough.unionByName(duo).unionByName(one)


def resolve_voice(wanted: DataFrame, settings: DataFrame, clones: DataFrame, default_voice: str | None = None) -> DataFrame:
    """K5: wanted(track_id, speaker, explicit) with voice and error. Explicit, then the speaker's setting, then the
    default; a clone replaces what was resolved, but can't stand in for nothing."""
    found = (
        wanted.join(settings.select("speaker", F.col("voice").alias("_set")), "speaker", "left")
        .join(clones.select("track_id", "speaker", F.col("voice").alias("_clone")), ["track_id", "speaker"], "left")
        .withColumn("_base", F.coalesce(F.nullif("explicit", F.lit("")), F.nullif("_set", F.lit("")), F.lit(default_voice).cast("string")))
    )
    error = F.when(F.col("_base").isNull(), F.concat(F.lit("no voice for speaker "), "speaker"))
    return found.select("track_id", "speaker", F.when(F.col("_base").isNotNull(), F.coalesce("_clone", "_base")).alias("voice"), error.alias("error"))


def block_layout(parts: DataFrame, pause_ms: int = 180, max_ms: int = 25000) -> DataFrame:
    """K6: parts(track_id, line_idx, dur_ms) with start_ms in the ad, its total_ms, and whether it's accepted."""
    w = by_track("line_idx").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur_ms") + pause_ms).over(w), F.lit(0))
    total = F.sum(F.col("dur_ms") + pause_ms).over(by_track()) - pause_ms
    return parts.withColumn("start_ms", start).withColumn("total_ms", total).withColumn("accepted", F.col("total_ms") <= max_ms)
