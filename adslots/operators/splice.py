"""Splice plans, overlays and audits (M1 to M5). Times are milliseconds; frames are numbered from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import by_track


def _piece(ord_: int, kind: str, start: Column, end: Column) -> Column:
    return F.struct(F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), start.alias("src_start_ms"), end.alias("src_end_ms"))


def splice_pieces(slots: DataFrame, preview_ms: int | None = None) -> DataFrame:
    """M1: three pieces (track_id, slot, ord, kind, src_start_ms, src_end_ms) for each slot(track_id, slot, at_ms,
    duration_ms, ad_ms); a preview takes only preview_ms on each side. An unknown end is null."""
    zero = F.lit(0).cast("long")
    at = F.greatest(zero, F.least("at_ms", F.coalesce("duration_ms", "at_ms")))
    start = F.greatest(zero, F.col("_at") - preview_ms) if preview_ms else zero
    end = F.least(F.coalesce("duration_ms", F.col("_at") + preview_ms), F.col("_at") + preview_ms) if preview_ms else F.col("duration_ms")
    pieces = F.array(_piece(0, "main", start, F.col("_at")), _piece(1, "ad", zero, F.col("ad_ms")), _piece(2, "main", F.col("_at"), end))
    return slots.withColumn("_at", at).select("track_id", "slot", F.explode(pieces).alias("p")).select("track_id", "slot", "p.*")


def timeline(slots: DataFrame, lengths: DataFrame) -> DataFrame:
    """M2: the pieces (track_id, ord, kind, src_start_ms, src_end_ms, out_start_ms) of a track with all its ads.

    Ads are set in from the last on, so that at one place the one set in later comes first: order (at, ord desc)."""
    w = by_track("at_ms", F.desc("ord"))
    placed = (
        slots.withColumn("k", F.row_number().over(w)).withColumn("from_ms", F.coalesce(F.lag("at_ms").over(w), F.lit(0).cast("long")))
        .withColumn("before", F.coalesce(F.sum("ad_ms").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
    )
    return timeline_pieces(placed, lengths)


def timeline_pieces(placed: DataFrame, lengths: DataFrame) -> DataFrame:
    """The pieces from the ads (track_id, at_ms, ad_ms, k, from_ms, before): an ad's number, the place of the one before it,
    and the length of all before it."""

    def rows(df: DataFrame, ord_: Column, kind: str, a: Column, b: Column, out: Column) -> DataFrame:
        return df.select("track_id", ord_.cast("int").alias("ord"), F.lit(kind).alias("kind"), a.alias("src_start_ms"), b.alias("src_end_ms"), out.alias("out_start_ms"))

    both = placed.select("track_id", F.explode(F.array(
        F.struct((F.col("k") * 2 - 2).alias("ord"), F.lit("main").alias("kind"), F.col("from_ms").alias("src_start_ms"), F.col("at_ms").alias("src_end_ms"), (F.col("from_ms") + F.col("before")).alias("out_start_ms")),
        F.struct((F.col("k") * 2 - 1).alias("ord"), F.lit("ad").alias("kind"), F.lit(0).cast("long").alias("src_start_ms"), F.col("ad_ms").alias("src_end_ms"), (F.col("at_ms") + F.col("before")).alias("out_start_ms")),
    )).alias("p")).select("track_id", "p.*")
    ends = placed.groupBy("track_id").agg(F.max("k").alias("k"), F.max("at_ms").alias("at"), F.sum("ad_ms").alias("ads"))
    tail = rows(lengths.join(ends, "track_id"), F.col("k") * 2, "main", F.col("at"), F.col("duration_ms"), F.col("at") + F.col("ads"))
    return both.unionByName(tail)


def _ramp(i: Column, n: Column) -> Column:
    """0 at i = 0, 1 from i = n on; 1 everywhere if n is 0."""
    return F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), i / F.greatest(n, F.lit(1)))))


def overlay_plan(size: DataFrame, crossfade: int) -> DataFrame:
    """(track_id, n, ad, p, l, c1, m, c2) of tracks(track_id, n, ad, at), all in samples: the ad's place p, its length l in
    the programme, the crossfades c1 before and c2 after it, and the end m of the ad in the mix."""
    p = F.least(F.greatest("at", F.lit(0).cast("long")), F.col("n"))
    plan = size.select("track_id", "n", "ad", p.alias("p")).withColumn("l", F.least("ad", F.col("n") - F.col("p")))
    fade = F.lit(crossfade).cast("long")
    return plan.withColumn("c1", F.least(fade, "p", "l")).withColumn("m", F.col("p") + F.col("l") - F.col("c1")).withColumn("c2", F.least(fade, "m", F.col("n") - F.col("p") - F.col("l")))


def overlay_gain(frames: DataFrame, promo: DataFrame, slots: DataFrame, duck_db: float = 0.0, crossfade: int = 2, fade: int = 2, duck_ramp: int = 1) -> DataFrame:
    """M3: the mix (track_id, out_idx, amp) of an ad laid over the programme. frames(track_id, frame_idx, amp),
    promo(track_id, i, amp), slots(track_id, at). Lengths are in frames; all ramps are linear.

    The programme isn't lengthened: the part under the ad (ducked if asked) is crossfaded with what comes before
    and after, which shortens the whole by both crossfades; an ad past the end is cut. A track without an ad, or
    without a slot, stays as it is."""
    size = frames.groupBy("track_id").agg((F.max("frame_idx") + 1).alias("n")).join(promo.groupBy("track_id").agg((F.max("i") + 1).alias("ad")), "track_id").join(slots, "track_id")
    plan = overlay_plan(size, crossfade)
    c1, c2, m, length = F.col("c1"), F.col("c2"), F.col("m"), F.col("l")
    out_fade = lambda o: 1 - _ramp(o - (m - c2), c2) * F.when(c2 > 0, 1.0).otherwise(0.0)  # noqa: E731  of what is joined so far
    joined = frames.join(plan, "track_id", "left")
    i, j = F.col("frame_idx"), F.col("frame_idx") - F.col("p")
    k = j - length
    pre = (1 - _ramp(i - (F.col("p") - c1), c1) * F.when(c1 > 0, 1.0).otherwise(0.0)) * out_fade(i)
    duck = F.lit(1.0) if duck_db <= 0 else F.lit(10 ** (-duck_db / 20)) * _ramp(j, F.lit(duck_ramp)) * _ramp(length - 1 - j, F.lit(duck_ramp))
    mid = duck * _ramp(j, c1) * out_fade(F.col("p") - c1 + j)
    alone = F.col("p").isNull()
    main = joined.select(
        "track_id",
        F.when(alone | (i < F.col("p")), i).when(k < 0, F.col("p") - c1 + j).otherwise(m - c2 + k).alias("out_idx"),
        (F.col("amp") * F.when(alone, 1.0).when(i < F.col("p"), pre).when(k < 0, mid).otherwise(_ramp(k, c2))).alias("amp"),
    )
    a = F.col("i")
    faded = _ramp(a, F.lit(fade)) * _ramp(F.col("ad") - 1 - a, F.lit(fade)) * _ramp(a, c1) * out_fade(F.col("p") - c1 + a)
    ad = promo.join(plan, "track_id").where(a < length).select("track_id", (F.col("p") - c1 + a).alias("out_idx"), (F.col("amp") * faded).alias("amp"))
    return main.unionByName(ad).groupBy("track_id", "out_idx").agg(F.sum("amp").alias("amp"))


def audit(plan: DataFrame, actual: DataFrame, preview_s: float | None = None, tolerance_s: float = 0.1) -> DataFrame:
    """M4: plan(track_id, at_s, duration_s, ad_s) with expected_s, actual_s and match: true, false or unknown."""
    at, d = F.col("at_s"), F.col("duration_s")
    if preview_s:
        window = F.greatest(F.lit(0.0), F.least(F.coalesce(d, at + preview_s), at + preview_s) - F.greatest(F.lit(0.0), at - preview_s))
        expected = window + F.col("ad_s")
    else:
        expected = d + F.col("ad_s")
    out = plan.join(actual, "track_id", "left").withColumn("expected_s", expected)
    same = F.abs(F.col("actual_s") - F.col("expected_s")) < tolerance_s
    return out.select("track_id", "expected_s", "actual_s", F.when(same.isNull(), "unknown").when(same, "true").otherwise("false").alias("match"))


def audit_summary(audited: DataFrame) -> DataFrame:
    """M4: (match, n, worst_s): how many merges match, and the largest deviation among them."""
    off = F.abs(F.col("actual_s") - F.col("expected_s"))
    return audited.groupBy("match").agg(F.count(F.lit(1)).alias("n"), F.max(off).alias("worst_s"))


def room_tone_bed(frames: DataFrame, promo: DataFrame, slots: DataFrame, tone: int = 6, gain_db: float = -26.0, podcasts_only: bool = True) -> DataFrame:
    """M5: (track_id, i, amp) of the ad with the last `tone` frames before the slot under it, repeated over its
    length; without any, the ad as it is. slots(track_id, mode, at); a one-speaker ad has a bed in podcasts only, one of
    two speakers (podcasts_only false) in every mode."""
    bedded = slots.where("mode = 'podcast'") if podcasts_only else slots
    near = frames.join(bedded.select("track_id", "at"), "track_id").where((F.col("frame_idx") < F.col("at")) & (F.col("frame_idx") >= F.col("at") - tone))
    numbered = near.select("track_id", (F.row_number().over(by_track("frame_idx")) - 1).cast("long").alias("k"), F.col("amp").alias("bed"))
    n = numbered.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    asked = promo.join(n, "track_id", "left").withColumn("k", F.pmod(F.col("i"), F.col("n")))
    return asked.join(numbered, ["track_id", "k"], "left").select("track_id", "i", (F.col("amp") + F.coalesce(F.col("bed") * F.lit(10 ** (gain_db / 20)), F.lit(0.0))).alias("amp"))
