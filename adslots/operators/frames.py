"""Signal frames: levels, quiet places, beats, peaks, loudness (F1 to F8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import by_track


def frame_rms(samples: DataFrame, frame: int = 2205, hop: int = 1102) -> DataFrame:
    """(track_id, frame_idx, rms) of complete overlapping frames of samples(track_id, i, amp).

    Samples are summed once, in tiles of a hop; a frame is the sum of the tiles it covers and of the head of the
    next one, so samples aren't multiplied. A track shorter than a frame gives one row, at 0, without level."""
    whole, rest = divmod(frame, hop)
    sq = F.col("amp") * F.col("amp")
    tiles = samples.groupBy("track_id", F.floor(F.col("i") / hop).alias("tile")).agg(
        F.sum(sq).alias("all"), F.sum(F.when(F.col("i") % hop < rest, sq).otherwise(0.0)).alias("head"), F.max("i").alias("last")
    )
    w = by_track("tile")
    total = sum((F.lead("all", k).over(w) for k in range(1, whole)), F.col("all"))
    if rest:
        total = total + F.lead("head", whole).over(w)
    n = F.max("last").over(by_track()) + 1
    framed = tiles.select("track_id", F.col("tile").alias("frame_idx"), n.alias("n"), F.sqrt(total / frame).alias("rms"))
    complete = F.col("frame_idx") * hop + frame <= F.col("n")
    short = (F.col("n") < frame) & (F.col("frame_idx") == 0)
    return framed.where(complete | short).select("track_id", "frame_idx", F.when(complete, F.col("rms")).alias("rms"))


def quietest(frames: DataFrame, k: int = 12, hop: int = 1102, rate: int = 44100) -> DataFrame:
    """the k quietest frames of each track, quietest first; ties by place."""
    rank = F.row_number().over(by_track("rms", "frame_idx"))
    at = F.floor(F.col("frame_idx") * hop / F.lit(float(rate)) * 1000).cast("long")
    return frames.withColumn("rank", rank).where(F.col("rank") <= k).select("track_id", "rank", "frame_idx", at.alias("ms"))


def quiet_threshold(frames: DataFrame, below_db: float = 16.0, floor_db: float = -40.0) -> DataFrame:
    """(track_id, threshold_db): the track's level less below_db, or floor_db for digital silence."""
    power = F.avg("ms_power")
    return frames.groupBy("track_id").agg(F.when(power > 0, 10 * F.log10(power) - below_db).otherwise(F.lit(floor_db)).alias("threshold_db"))


def quiet_frames(frames: DataFrame, thresholds: DataFrame) -> DataFrame:
    level = F.when(F.col("ms_power") > 0, 10 * F.log10("ms_power")).otherwise(F.lit(float("-inf")))
    return frames.join(thresholds, "track_id").where(level <= F.col("threshold_db"))


def quiet_runs(frames: DataFrame, thresholds: DataFrame, min_ms: int = 500, frame_ms: int = 100) -> DataFrame:
    """(track_id, start_ms, end_ms) of the longest runs of frames at or below the threshold."""
    quiet = quiet_frames(frames, thresholds)
    island = quiet.withColumn("island", F.col("frame_idx") - F.row_number().over(by_track("frame_idx")))
    runs = island.groupBy("track_id", "island").agg(F.min("t_ms").alias("start_ms"), (F.max("t_ms") + frame_ms).alias("end_ms"))
    return runs.where(F.col("end_ms") - F.col("start_ms") >= min_ms).select("track_id", "start_ms", "end_ms")


def silence_candidates(runs: DataFrame, max_n: int | None = 30) -> DataFrame:
    """(track_id, start_ms, end_ms, ms, silence_ms): the middle of every run, the first max_n by time."""
    out = runs.select("track_id", "start_ms", "end_ms", F.expr("(start_ms + end_ms) div 2").alias("ms"), (F.col("end_ms") - F.col("start_ms")).alias("silence_ms"))
    if max_n is None:
        return out
    return out.withColumn("_n", F.row_number().over(by_track("ms", "start_ms"))).where(F.col("_n") <= max_n).drop("_n")


def distinct_middles(runs: DataFrame) -> DataFrame:
    """F5, the other form: the distinct middles, with no limit."""
    return silence_candidates(runs, None).select("track_id", "ms").distinct()


def beats_and_minima(minima: DataFrame, beats: DataFrame) -> DataFrame:
    """(track_id, ms, rank, beat) of both: rank is null for beats, beat for minima."""
    return minima.select("track_id", "ms", "rank", F.lit(None).cast("long").alias("beat")).unionByName(
        beats.select("track_id", F.col("beat_ms").alias("ms"), F.lit(None).cast("int").alias("rank"), F.col("beat_ms").alias("beat"))
    )


def snapped(found: DataFrame, max_n: int) -> DataFrame:
    """(track_id, seq, ms) from the beats before and after each minimum."""
    later = F.col("before").isNull() | (F.col("after") - F.col("ms") < F.col("ms") - F.col("before"))
    near = found.where("rank IS NOT NULL").withColumn("to", F.when(later, F.col("after")).otherwise(F.col("before")))
    once = near.groupBy("track_id", F.coalesce("to", "ms").alias("ms")).agg(F.min("rank").alias("rank"))
    return once.withColumn("seq", F.row_number().over(by_track("rank"))).where(F.col("seq") <= max_n).select("track_id", "seq", "ms")


def snap_to_beat(minima: DataFrame, beats: DataFrame, max_n: int = 30) -> DataFrame:
    """every minimum (track_id, rank, ms) goes to its nearest beat, the earlier of two; of minima on one beat
    the quietest stays; tracks without beats keep their own places. (track_id, seq, ms), in order of energy.

    Beats and minima are merged in time order; the last beat before and the first after are read off by windows that
    only grow, forwards and backwards."""
    before = F.last("beat", ignorenulls=True).over(by_track("ms").rangeBetween(W.unboundedPreceding, 0))
    after = F.last("beat", ignorenulls=True).over(by_track(F.desc("ms")).rangeBetween(W.unboundedPreceding, 0))
    return snapped(beats_and_minima(minima, beats).withColumn("before", before).withColumn("after", after), max_n)


def peak_envelope(samples: DataFrame, n: int = 900) -> DataFrame:
    """(track_id, block, peak), n blocks for each track; samples after the last whole block are left out."""
    size = samples.groupBy("track_id").agg(F.greatest(F.lit(1).cast("long"), F.floor((F.max("i") + 1) / n)).alias("size"))
    block = F.floor(F.col("i") / F.col("size"))
    peaks = samples.join(size, "track_id").select("track_id", block.alias("block"), F.abs("amp").alias("amp")).where(F.col("block") < n).groupBy("track_id", "block").agg(F.max("amp").alias("peak"))
    every = size.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block"))
    return every.join(peaks, ["track_id", "block"], "left").withColumn("peak", F.coalesce("peak", F.lit(0.0)))


def _lufs(power: Column) -> Column:
    return F.lit(-0.691) + 10 * F.log10(power)


def _blocks(frames: DataFrame, n: int) -> DataFrame:
    """(track_id, t_ms, power): the mean power of the n frames from each on."""
    w = by_track("frame_idx")
    power = sum((F.lead("ms_power", j).over(w) for j in range(1, n)), F.col("ms_power")) / n
    whole = F.lead("frame_idx", n - 1).over(w) == F.col("frame_idx") + n - 1
    return frames.select("track_id", "t_ms", power.alias("power"), whole.alias("_whole")).where("_whole").drop("_whole")


def gated(blocks: DataFrame, key: list[str], name: str) -> DataFrame:
    """(key, name): the loudness of blocks(key, power) with gates at -70 and at 10 below the mean of what is left."""
    loud = blocks.where("power > 0").where(_lufs(F.col("power")) > -70)
    gate = loud.groupBy(*key).agg((_lufs(F.avg("power")) - 10).alias("gate"))
    return loud.join(gate, key).where(_lufs(F.col("power")) > F.col("gate")).groupBy(*key).agg(_lufs(F.avg("power")).alias(name))


def context_loudness(frames: DataFrame, slots: DataFrame, ads: DataFrame, window_ms: int = 4000, frame_ms: int = 100, block_ms: int = 400) -> DataFrame:
    """F8: slots(track_id, ms) with target_lufs, the gated loudness around the slot; before_lufs, that of the track's ad
    ads(track_id, frame_idx, t_ms, ms_power); gain_db, which brings it there; and after_lufs, that of the ad measured
    again with the gain on it (where the gates may leave out other blocks).

    Blocks of block_ms at each frame inside the window, gated as in ITU-R BS.1770. Frames hold weighted power.
    Without a block over the gate the loudness is -70."""
    n, key = block_ms // frame_ms, ["track_id", "ms"]
    near = slots.select(*key).join(_blocks(frames, n), "track_id").where((F.col("t_ms") >= F.col("ms") - window_ms) & (F.col("t_ms") + block_ms <= F.col("ms") + window_ms))
    spoken = _blocks(ads, n)
    level = lambda c: F.coalesce(c, F.lit(-70.0)).alias(c)
    found = slots.join(gated(near.select(*key, "power"), key, "target_lufs"), key, "left").join(gated(spoken, ["track_id"], "before_lufs"), "track_id", "left")
    gained = found.select(*slots.columns, level("target_lufs"), level("before_lufs")).withColumn("gain_db", F.col("target_lufs") - F.col("before_lufs"))
    louder = gained.select(*key, "gain_db").join(spoken, "track_id").select(*key, (F.col("power") * F.pow(F.lit(10.0), F.col("gain_db") / 10)).alias("power"))
    return gained.join(gated(louder, key, "after_lufs"), key, "left").withColumn("after_lufs", level("after_lufs"))
