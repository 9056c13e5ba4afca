"""Catalogue inputs: durations, nested analysis payloads, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import UNAVAILABLE, field, half_up, trimmed


def episodes(raw: DataFrame) -> DataFrame:
    """(track_id, mode, duration_s) of raw(track_id, mode, probe_s, analysis_ms).

    A probed length counts if it's finite and positive; else the analysis' length, if it isn't 0; else null."""
    probe = F.col("probe_s")
    probed = F.when(probe.isNotNull() & ~F.isnan(probe) & (probe > 0) & (probe < F.lit(float("inf"))), probe)
    analysed = F.nullif(F.col("analysis_ms"), F.lit(0).cast("long")) / F.lit(1000.0)
    return raw.select(
        "track_id",
        F.when(F.lower(trimmed(F.coalesce("mode", F.lit("podcast")))) == "song", "song").otherwise("podcast").alias("mode"),
        F.coalesce(probed, analysed).alias("duration_s"),
    )


def read_analysis(payloads: DataFrame, lengths: DataFrame) -> DataFrame:
    """Candidates (track_id, seq, ms, silence_ms, snippet, source) of payloads(track_id, payload).

    Numbers may come as strings. A bad element goes, the others stay; a payload that isn't JSON gives one row
    with nulls and source `fallback`, so that its recording isn't lost."""
    v = payloads.select("track_id", F.try_parse_json("payload").alias("v"))
    items = v.select("track_id", "v", F.posexplode_outer(F.try_variant_get("v", "$.candidates", "array<variant>")).alias("seq", "c"))
    place = F.coalesce(field(F.col("c"), "$.mid_ms"), field(F.col("c"), "$.ms"), field(F.col("c"), "$.time_ms"), F.lit("0")).try_cast("double")
    silence = field(F.col("c"), "$.silence_ms").try_cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = items.select(
        "track_id", "seq", "v", F.col("c").isNotNull().alias("is_item"), place.alias("place"),
        F.when(finite(silence), silence).otherwise(0.0).alias("silence_ms"), F.col("v").isNull().alias("broken"),
    )
    good = (
        rows.where(F.col("is_item") & finite(F.col("place")) & (F.col("place") >= 0))
        .withColumn("ms", half_up(F.col("place")))
        .join(lengths.select("track_id", "duration_s"), "track_id", "left")
        .where(F.col("duration_s").isNull() | (F.col("ms") <= F.col("duration_s") * 1000))
    )
    snippets = F.try_variant_get("v", "$.snippets", "map<string,string>")
    return good.select(
        "track_id", "seq", "ms", F.col("silence_ms").cast("long").alias("silence_ms"),
        F.coalesce(trimmed(F.try_element_at(snippets, F.col("ms").cast("string"))), F.lit("")).alias("snippet"), F.lit("heuristic").alias("source"),
    ).union(
        rows.where("broken").select("track_id", F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit("fallback"))
    )


def analysis_source(payloads: DataFrame) -> DataFrame:
    """S3: (track_id, source): `heuristic` where the payload could be read, else `fallback`."""
    return payloads.select("track_id", F.when(F.try_parse_json("payload").isNull(), "fallback").otherwise("heuristic").alias("source"))


def slot_report(slots: DataFrame, lengths: DataFrame, origins: DataFrame, statements: DataFrame) -> DataFrame:
    """S3: one row per track with its slots, most confident first (ties in the order of selection), where its analysis
    comes from (`fallback` without one), and its sponsors' statements (K8's rows) in order.

    A track has at most a few slots and sponsors, so its lists are bounded."""
    best = F.sort_array(F.collect_list(F.struct((-F.col("confidence_percent")).alias("rank"), F.col("ord").alias("ord"), F.struct(*[c for c in slots.columns if c not in ("track_id", "ord")]).alias("slot"))))
    out = slots.groupBy("track_id").agg(best.alias("s")).select("track_id", F.transform("s", lambda x: x["slot"]).alias("slots"))
    said = statements.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.struct("id", "name", "statement", "generated").alias("s")))).alias("said"))
    nothing = F.array().cast("array<struct<id:string,name:string,statement:string,generated:boolean>>")
    return (
        out.join(lengths.select("track_id", F.col("duration_s").alias("duration")), "track_id", "left").join(origins.select("track_id", "source"), "track_id", "left").join(said, "track_id", "left")
        .select(
            "track_id", "duration", F.coalesce("source", F.lit("fallback")).alias("source"), "slots",
            F.transform("slots", lambda s: s["insertion_time_seconds"]).alias("points"),
            F.transform("slots", lambda s: s["confidence_percent"]).alias("confidences"),
            F.coalesce(F.transform("said", lambda x: x["s"]), nothing).alias("sponsor_statements"),
        )
    )


def audit_record(
    chosen: DataFrame, cands: DataFrame, bounded: DataFrame, episodes: DataFrame, beats: DataFrame, loudness: DataFrame, contexts: DataFrame, prompts: DataFrame, responses: DataFrame,
    min_offset: int = 30000, end_buffer: int = 15000, prompt_chars: int = 500,
) -> DataFrame:
    """S3's audit: one row per chosen(track_id, chosen_ms) with what the choice was made from: the candidates before and
    after the bounds (an analysis gives at most 30 of a track), mode and tempo (if episodes has it), the beats in order, their number and the
    place of the chosen one among them (null if it's none), loudness(track_id, target_lufs, before_lufs, after_lufs), the limits, what was
    said before (the mark of a missing transcript where contexts(track_id, ms, context) has nothing for the place), the
    prompt's first prompt_chars characters and the raw answer. What a track lacks is null."""
    in_order = lambda df, name: df.groupBy("track_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "ms"))), lambda x: x["ms"]).alias(name))
    none = F.array().cast("array<bigint>")
    at = chosen.join(beats, "track_id").groupBy("track_id").agg(
        F.array_sort(F.collect_list("beat_ms")).alias("beat_times_ms"),
        F.count(F.lit(1)).alias("beat_times_count"),
        F.when(F.max(F.col("beat_ms") == F.col("chosen_ms")), F.sum(F.when(F.col("beat_ms") < F.col("chosen_ms"), 1).otherwise(0))).alias("chosen_beat_index"),
    )
    heard = contexts.where("context <> ''").groupBy("track_id", F.col("ms").alias("chosen_ms")).agg(F.min("context").alias("context"))
    out = chosen.join(in_order(cands, "candidates_ms"), "track_id", "left").join(in_order(bounded, "candidates_for_prompt_ms"), "track_id", "left")
    tempo = F.col("tempo") if "tempo" in episodes.columns else F.lit(None).cast("double").alias("tempo")
    for other in (episodes.select("track_id", "mode", tempo), at, loudness.select("track_id", "target_lufs", "before_lufs", "after_lufs"), prompts.select("track_id", F.substring("prompt", 1, prompt_chars).alias("prompt")), responses.select("track_id", "raw_text")):
        out = out.join(other, "track_id", "left")
    return out.join(heard, ["track_id", "chosen_ms"], "left").select(
        "track_id", "chosen_ms", F.coalesce("candidates_ms", none).alias("candidates_ms"), F.coalesce("candidates_for_prompt_ms", none).alias("candidates_for_prompt_ms"), "mode", "tempo", F.coalesce("beat_times_ms", none).alias("beat_times_ms"),
        F.coalesce("beat_times_count", F.lit(0).cast("long")).alias("beat_times_count"), "chosen_beat_index", "target_lufs", "before_lufs", "after_lufs",
        F.lit(min_offset).alias("min_insert_ms"), F.lit(end_buffer).alias("end_buffer_ms"), F.coalesce("context", F.lit(UNAVAILABLE)).alias("transcript_before"), "prompt", "raw_text",
    )
