"""Candidate places and their choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import UNAVAILABLE, by_track, clamp, ends_sentence, half_up, trimmed


#: Candidates of an island folded into one list.
FOLD = 256


def _latest(duration_ms: Column, end_buffer: int) -> Column:
    return F.greatest(F.lit(0).cast("long"), duration_ms - end_buffer)


def bound(cands: DataFrame, lengths: DataFrame, min_offset: int = 30000, end_buffer: int = 15000) -> DataFrame:
    """Candidates from min_offset to end_buffer before the end; a track without any such keeps all of its.
    lengths(track_id, duration_ms); a length that is 0, negative or unknown bounds nothing."""
    length = F.coalesce("duration_ms", F.lit(0))
    inside = (length <= 0) | ((F.col("ms") >= min_offset) & (F.col("ms") <= _latest(length, end_buffer)))
    judged = cands.join(lengths.select("track_id", "duration_ms"), "track_id", "left").withColumn("_ok", inside).withColumn("_any", F.max("_ok").over(by_track()))
    return judged.where(F.col("_ok") | ~F.col("_any")).drop("_ok", "_any", "duration_ms")


def default_insertion(lengths: DataFrame, cands: DataFrame, min_offset: int = 30000) -> DataFrame:
    """(track_id, default_ms): the first candidate from min_offset on, else the last, else min_offset; before the end."""
    found = cands.groupBy("track_id").agg(F.coalesce(F.min(F.when(F.col("ms") >= min_offset, F.col("ms"))), F.max("ms")).alias("found"))
    place = F.coalesce("found", F.lit(min_offset).cast("long"))
    length = F.col("duration_ms")
    return lengths.join(found, "track_id", "left").select("track_id", F.when(length > 0, F.least(place, length - 1)).otherwise(place).alias("default_ms"))


def apply_choice(defaults: DataFrame, cands: DataFrame, choices: DataFrame, lengths: DataFrame, min_offset: int = 30000, end_buffer: int = 15000) -> DataFrame:
    """(track_id, chosen_ms). A choice is a place in the track's bounded list cands(track_id, seq, ms); one that
    isn't there, or lies outside the bounds, leaves the default."""
    listed = cands.withColumn("pos", F.row_number().over(by_track("seq")) - 1).select("track_id", "pos", F.col("ms").alias("picked"))
    length = F.coalesce("duration_ms", F.lit(0))
    bad = (F.col("picked") < min_offset) | ((length > 0) & (F.col("picked") > _latest(length, end_buffer)))
    return (
        defaults.join(choices.select("track_id", F.col("chosen_index").alias("pos")), "track_id", "left").join(listed, ["track_id", "pos"], "left")
        .join(lengths.select("track_id", "duration_ms"), "track_id", "left")
        .select("track_id", F.when(F.col("picked").isNull() | bad, F.col("default_ms")).otherwise(F.col("picked")).alias("chosen_ms"))
    )


def boundary_candidates(segments: DataFrame, episodes: DataFrame) -> DataFrame:
    """C4: (track_id, seq, ms, silence_ms, snippet): ends of segments that end a sentence, with the pause that
    follows; the next start is taken before any segment is left out."""
    ahead = F.lead("start_s").over(by_track("seg_idx"))
    all_ = segments.select("track_id", F.col("seg_idx").alias("seq"), trimmed("text").alias("snippet"), "end_s", F.coalesce(ahead, F.col("end_s")).alias("next_s"))
    end = F.col("end_s")
    return (
        all_.where(ends_sentence(F.col("snippet")) & ~F.isnan(end) & (F.abs(end) < F.lit(float("inf"))))
        .join(episodes.select("track_id", "duration_s"), "track_id", "left")
        .where(F.col("duration_s").isNull() | (end <= F.col("duration_s")))
        .select("track_id", "seq", half_up(end * 1000).alias("ms"), half_up(F.greatest(F.lit(0.0), (F.col("next_s") - end) * 1000)).alias("silence_ms"), "snippet")
    )


def collapse_near(base: DataFrame, extra: DataFrame, gap: int = 400) -> DataFrame:
    """Both lists, (track_id, seq, ms, silence_ms, snippet), in time order (base first at one place), where a
    candidate within `gap` of the last kept one replaces it if its pause is longer, or it alone ends a sentence.

    A step over `gap` always starts anew, so the fold runs inside the islands between such steps; candidates alone in
    their island pass through. An island's list is as long as its candidates, in the worst case the track's, and is
    folded in pieces, in time that is linear but for the number of pieces."""
    both = base.withColumn("src", F.lit(0)).unionByName(extra.withColumn("src", F.lit(1)))
    w = by_track("ms", "src", "seq")
    stepped = both.withColumn("_new", (F.coalesce(F.col("ms") - F.lag("ms").over(w) > gap, F.lit(True))).cast("int")).withColumn("island", F.sum("_new").over(w))
    item = F.struct("ms", "src", "seq", "silence_ms", "snippet", ends_sentence(F.col("snippet")).alias("ends"))
    islands = stepped.groupBy("track_id", "island").agg(F.sort_array(F.collect_list(item)).alias("c"))

    none = F.slice("c", F.lit(1), F.lit(0))

    def step(s: Column, c: Column) -> Column:
        """One candidate more; the last one kept stands apart, as it may still be replaced."""
        last = s["last"]
        far, better = c["ms"] - last["ms"] > gap, (c["silence_ms"] > last["silence_ms"]) | (c["ends"] & ~last["ends"])
        kept = F.when(last.isNotNull() & far, F.concat(s["kept"], F.array(last))).otherwise(s["kept"])
        return F.struct(kept.alias("kept"), F.when(last.isNull() | far | better, c).otherwise(last).alias("last"))

    def piece(s: Column, i: Column) -> Column:
        """FOLD candidates more: what a piece keeps is appended as one list, so no list is copied for each candidate."""
        part = F.slice("c", i * FOLD + 1, F.lit(FOLD))
        inner = F.aggregate(part, F.struct(none.alias("kept"), s["last"].alias("last")), step)
        return F.transform(F.array(inner), lambda x: F.struct(F.concat(s["done"], F.array(x["kept"])).alias("done"), x["last"].alias("last")))[0]

    start = F.struct(F.slice(F.array(none), 1, 0).alias("done"), F.get(none, F.lit(0)).alias("last"))
    pieces = F.sequence(F.lit(0), F.floor((F.size("c") - 1) / F.lit(FOLD)).cast("int"))
    folded = F.when(F.size("c") == 1, F.col("c")).otherwise(F.aggregate(pieces, start, piece, lambda s: F.concat(F.flatten(s["done"]), F.array(s["last"]))))
    out = islands.select("track_id", F.explode(folded).alias("c"))
    return out.select("track_id", "c.ms", "c.silence_ms", "c.snippet", "c.src", "c.seq")


def fill_empty(episodes: DataFrame, cands: DataFrame) -> DataFrame:
    """Candidates, and three standard places for every track without one. Candidates are read once."""
    d = F.col("duration_s")
    known = F.array(*[half_up(d * r * 1000) for r in (0.25, 0.5, 0.75)])
    unknown = F.array(*[F.lit(ms).cast("long") for ms in (12000, 24000, 36000)])
    item = lambda *v: F.struct(*[x.alias(k) for k, x in zip(("ms", "silence_ms", "snippet", "src", "seq"), v, strict=True)])
    standard = F.transform(F.when(d > 0, known).otherwise(unknown), lambda ms, i: item(ms, F.lit(0).cast("long"), F.lit(""), F.lit(2), i))
    own = item(*[F.col(f"c.{k}") for k in ("ms", "silence_ms", "snippet", "src", "seq")])
    both = episodes.select("track_id", "duration_s").alias("e").join(cands.withColumn("_has", F.lit(True)).alias("c"), F.col("e.track_id") == F.col("c.track_id"), "full")
    rows = both.select(F.coalesce("e.track_id", "c.track_id").alias("track_id"), F.explode(F.when(F.col("_has"), F.array(own)).otherwise(standard)).alias("x"))
    return rows.select("track_id", "x.*").select(*cands.columns)


def score(cands: DataFrame, episodes: DataFrame) -> DataFrame:
    """Candidates with score (0 to 1), mode and duration_s; additions in one fixed order."""
    joined = cands.join(episodes.select("track_id", "mode", "duration_s"), "track_id")
    t, d, pause = F.col("ms") / F.lit(1000.0), F.col("duration_s"), F.col("silence_ms")
    has_text = F.col("snippet").isNotNull() & ~F.col("snippet").isin("", UNAVAILABLE)
    known = d.isNotNull() & (d != 0)
    s = F.lit(0.4)
    s = s + F.when(F.coalesce(pause, F.lit(0)) != 0, F.least(F.lit(0.4), pause / F.lit(2000.0) * 0.4)).otherwise(0.0)
    s = s + F.when(F.col("mode") == "song", 0.1).otherwise(0.0)
    s = s + F.when(has_text & ends_sentence(F.col("snippet")), 0.3).when(has_text, -0.2).otherwise(0.0)
    s = s + F.when(known & (t / d >= 0.2) & (t / d <= 0.8), 0.1).otherwise(0.0)
    s = s + F.when(known & ((t < 5) | (t > d - 5)), -0.3).otherwise(0.0)
    return joined.withColumn("score", clamp(s, 0.0, 1.0))


def select_separated(scored: DataFrame, sep_ms: int = 6000, k: int = 3) -> DataFrame:
    """(track_id, mode, duration_s, picks): up to k candidates, best first, each at least sep_ms from those
    before. Each round is a minimum over the track of what the rounds before leave: one partitioning for all."""
    key = F.struct((-F.col("score")).alias("neg"), F.col("ms"), F.col("src"), F.col("seq"), F.col("silence_ms"), F.col("snippet"), F.col("score"))
    w = by_track()
    rows, free, picks = scored, F.lit(True), []
    for n in range(k):
        rows = rows.withColumn(f"_p{n}", F.min(F.when(free, key)).over(w))
        free = free & F.coalesce(F.abs(F.col("ms") - F.col(f"_p{n}.ms")) >= sep_ms, F.lit(False))
        picks.append(F.col(f"_p{n}"))
    first = rows.where(key == F.col("_p0"))
    slim = lambda p: F.struct(p["ms"].alias("ms"), p["silence_ms"].alias("silence_ms"), p["snippet"].alias("snippet"), p["score"].alias("score"))
    out = first.select("track_id", "mode", "duration_s", F.array_compact(F.array(*[F.when(p.isNotNull(), slim(p)) for p in picks])).alias("picks"))
    return out.dropDuplicates(["track_id"])


def top_up(selected: DataFrame, sep_ms: int = 6000, k: int = 3, ratios: Sequence[float] = (0.22, 0.5, 0.78)) -> DataFrame:
    """Picks filled up to k: standard places that are free, then places after the last pick."""
    d = F.col("duration_s")

    def pick(ms: Column, score_: float) -> Column:
        return F.struct(ms.cast("long").alias("ms"), F.lit(0).cast("long").alias("silence_ms"), F.lit("").alias("snippet"), F.lit(score_).alias("score"))

    rows = selected
    for r in ratios:
        at = F.lit(r) * d * 1000
        rows = rows.withColumn("_at", at)
        wanted = (F.size("picks") < k) & d.isNotNull() & (d != 0) & ~F.exists("picks", lambda p: F.abs(p["ms"] - F.col("_at")) < sep_ms)
        rows = rows.withColumn("picks", F.when(wanted, F.concat("picks", F.array(pick(half_up(F.col("_at")), 0.5)))).otherwise(F.col("picks")))
    last = F.coalesce(F.array_max(F.transform("picks", lambda p: p["ms"])), F.lit(0).cast("long"))
    missing = F.lit(k) - F.size("picks")
    pads = F.when(missing > 0, F.transform(F.sequence(F.lit(1), F.greatest(missing, F.lit(1))), lambda i: pick(last + i * sep_ms, 0.4)))
    none = F.slice("picks", F.lit(1), F.lit(0))
    return rows.withColumn("picks", F.concat("picks", F.coalesce(pads, none))).drop("_at")


def clamp_dedupe(topped: DataFrame) -> DataFrame:
    """One row for each pick, (track_id, mode, duration_s, ord, ms, silence_ms, snippet, score), at least
    200 ms before the end, the first of those at one place."""
    rows = topped.select("track_id", "mode", "duration_s", F.posexplode("picks").alias("ord", "p")).select("track_id", "mode", "duration_s", "ord", "p.*")
    limit = F.greatest(F.lit(0).cast("long"), half_up(F.col("duration_s") * 1000) - 200)
    clamped = rows.withColumn("ms", F.when(F.col("duration_s").isNull(), F.col("ms")).otherwise(F.least(F.col("ms"), limit)))
    first = F.min("ord").over(by_track().partitionBy("track_id", "ms"))
    return clamped.withColumn("_first", first).where("ord = _first").drop("_first")
