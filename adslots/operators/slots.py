"""Slot records, their explanations, and the lists a user edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import by_track, clamp, half_up, trimmed

# The texts of a slot's explanation.
PRO_BEAT = "Beat-aligned low-energy valley"
PRO_LONG = "Natural pause detected (~%dms)"
PRO_PAUSE = "Clear pause boundary detected"
PROS = ("Low background energy at cut", "Clean sentence boundary / transition")
PRO_PAD = "Natural pacing supports insertion"
CON_SHORT = "Short pause may feel abrupt"
CON_EARLY = "Early placement may feel disruptive"
CON_LATE = "Late placement may feel rushed"
CON_NOISE = "Slight background noise present"
CON_PAD = "Minor tonal shift possible"
RATIONALE = "Chosen for a clear pause near %.1fs that minimizes disruption."


def slot_record(picks: DataFrame) -> DataFrame:
    """C11: picks with insertion_ms, insertion_time_seconds, confidence_percent, band and label (m:ss)."""
    t = F.col("ms") / F.lit(1000.0)
    at = F.when(F.col("duration_s").isNull(), F.greatest(F.lit(0.0), t)).otherwise(clamp(t, 0.0, F.col("duration_s")))
    confidence = half_up(clamp(F.lit(70) + F.col("score") * 25, 70.0, 95.0))
    whole = F.floor(F.col("_t")).cast("long")
    return (
        picks.withColumn("_t", at).withColumn("insertion_ms", half_up(F.col("_t") * 1000)).withColumn("insertion_time_seconds", F.round("_t", 3))
        .withColumn("confidence_percent", confidence)
        .withColumn("band", F.when(F.col("confidence_percent") >= 90, "high").when(F.col("confidence_percent") >= 80, "mid").otherwise("low"))
        .withColumn("label", F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0")))
        .drop("_t")
    )


def _filled(items: Column, n: int, pad: str) -> Column:
    return F.slice(F.concat(F.slice(items, 1, n), F.array_repeat(F.lit(pad), n)), 1, n)


def pros_cons(slots: DataFrame) -> DataFrame:
    """Slots with three pros, two cons and a rationale."""
    pause, t, d = F.col("silence_ms"), F.col("insertion_time_seconds"), F.col("duration_s")
    known = d.isNotNull() & (d != 0)
    first = F.when(F.col("mode") == "song", F.lit(PRO_BEAT)).when(pause >= 800, F.format_string(PRO_LONG, pause)).when(pause >= 500, F.lit(PRO_PAUSE))
    pros = F.array_compact(F.array(first, *map(F.lit, PROS)))
    cons = F.array_compact(F.array(F.when((pause > 0) & (pause < 600), F.lit(CON_SHORT)), F.when(known & (t < 10), F.lit(CON_EARLY)).when(known & (t > d - 10), F.lit(CON_LATE)), F.lit(CON_NOISE)))
    return slots.withColumn("pros", _filled(pros, 3, PRO_PAD)).withColumn("cons", _filled(cons, 2, CON_PAD)).withColumn("rationale", F.format_string(RATIONALE, t))


def override_details(slots: DataFrame, details: DataFrame) -> DataFrame:
    """details(track_id, pos, insertion_ms, pros, cons, rationale) replace those of the slot at that place, the
    first detail of a place only, and each part only if it's whole."""
    first = details.groupBy("track_id", "insertion_ms").agg(F.min(F.struct("pos", F.col("pros").alias("p"), F.col("cons").alias("c"), F.col("rationale").alias("r"))).alias("d"))
    d = F.col("d")
    return (
        slots.join(first, ["track_id", "insertion_ms"], "left")
        .withColumn("pros", F.when(F.size(d["p"]) == 3, d["p"]).otherwise(F.col("pros")))
        .withColumn("cons", F.when(F.size(d["c"]) == 2, d["c"]).otherwise(F.col("cons")))
        .withColumn("rationale", F.coalesce(F.nullif(trimmed(d["r"]), F.lit("")), F.col("rationale")))
        .drop("d")
    )


def pair_suggestions(reports: DataFrame) -> DataFrame:
    """C14: (track_id, pos, time, confidence) of reports(track_id, payload): points are numbers, paired with
    confidences by place, or objects with both; a missing confidence is 72, a point that's no number goes."""
    v = reports.select("track_id", F.try_parse_json("payload").alias("v"))
    points = v.select("track_id", F.try_variant_get("v", "$.confidences", "array<variant>").alias("all"), F.posexplode(F.try_variant_get("v", "$.points", "array<variant>")).alias("pos", "p"))
    whole = F.schema_of_variant(F.col("p")).startswith("OBJECT")
    number = lambda x, path: F.try_variant_get(x, path, "string").try_cast("double")
    time = F.when(whole, number(F.col("p"), "$.time")).otherwise(number(F.col("p"), "$"))
    confidence = F.when(whole, number(F.col("p"), "$.confidence")).otherwise(number(F.get("all", F.col("pos")), "$"))
    return points.select("track_id", "pos", time.alias("time"), F.coalesce(confidence, F.lit(72.0)).alias("confidence")).where("time IS NOT NULL AND NOT isnan(time)")


def ui_slots(suggestions: DataFrame, lengths: DataFrame) -> DataFrame:
    """(track_id, id, time, confidence): the first three suggestions, or, with fewer, three standard places."""
    ranked = suggestions.withColumn("n", F.row_number().over(by_track("pos"))).where("n <= 3")
    three = ranked.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("n", "time", "confidence"))).alias("s"))
    d = F.col("duration_s")
    known = F.coalesce(d > 0, F.lit(False))
    standard = F.array(*[F.struct(F.lit(n).alias("n"), F.when(known, F.lit(r) * d).otherwise(F.lit(t)).alias("time"), F.lit(c).alias("confidence")) for n, r, t, c in ((1, 0.22, 12.0, 92.0), (2, 0.48, 24.0, 85.0), (3, 0.72, 36.0, 78.0))])
    rows = lengths.join(three, "track_id", "left").select("track_id", "duration_s", F.explode(F.when(F.size("s") >= 3, F.col("s")).otherwise(standard)).alias("x"))
    time = F.when(known, F.least(F.greatest(F.lit(0.0), F.col("x.time")), d)).otherwise(F.greatest(F.lit(0.0), F.col("x.time")))
    return rows.select("track_id", F.concat(F.lit("slot-"), F.col("x.n").cast("string")).alias("id"), time.alias("time"), F.col("x.confidence").alias("confidence"))


def add_manual(slots: DataFrame, manual: DataFrame, lengths: DataFrame) -> DataFrame:
    """Slots with one manual(track_id, minutes, seconds) slot for a track, unless it lies past a known end or
    before the start; its id is the first free slot-n from the count plus one; confidence 75; pos is by time."""
    wanted = manual.join(lengths.select("track_id", "duration_s"), "track_id", "left").withColumn("time", (F.col("minutes") * 60 + F.col("seconds")).cast("double"))
    fits = wanted.where((F.col("time") >= 0) & (F.coalesce(F.col("duration_s"), F.lit(0.0)).eqNullSafe(0.0) | (F.col("time") <= F.col("duration_s"))))
    taken = slots.groupBy("track_id").agg(F.collect_set("id").alias("ids"), F.count(F.lit(1)).cast("int").alias("n"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n = F.coalesce("n", F.lit(0))
    # of size(ids) + 1 numbers at least one is free
    free = F.array_except(F.transform(F.sequence(n + 1, n + 1 + F.size(ids)), lambda k: F.concat(F.lit("slot-"), k.cast("string"))), ids)
    new = fits.join(taken, "track_id", "left").select("track_id", F.get(free, F.lit(0)).alias("id"), "time", F.lit(75.0).alias("confidence"))
    return slots.unionByName(new).withColumn("pos", F.row_number().over(by_track("time", "id")))
