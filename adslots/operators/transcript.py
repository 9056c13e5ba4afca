"""What was said before a candidate, prompts, and model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import by_track, field, unfenced, trimmed

#: Instruction of a prompt; a parameter, as its wording changes no data.
HEADER = "Choose the best place for a one-sentence promo from the candidates below and write the promo."
SCRIPT_HEADER = "Write a short ad, of 8 to 15 seconds, that sounds like part of the conversation, without emojis and hashtags."
#: Fixed value: the form of an answer.
SCRIPT_SHAPE = 'Answer with JSON only: {"segments": [{"speaker": "A", "text": "..."}, {"speaker": "B", "text": "..."}]}'
BROKEN = "The answer was not valid JSON; the default place is used."


def context_before(cands: DataFrame, segments: DataFrame, window_ms: int = 15000, max_n: int = 5) -> DataFrame:
    """Candidates (track_id, seq, ms, ...) with context: the segments that overlap the window before, in order;
    empty after a track's first max_n candidates.

    A track's windows, max_n at most, are one row; each segment meets them once, and goes on only for those it overlaps.
    So no row is multiplied, however long a segment is."""
    numbered = cands.withColumn("_n", F.row_number().over(by_track("seq")))
    start = F.greatest(F.lit(0).cast("long"), F.col("ms") - window_ms)
    windows = numbered.where(F.col("_n") <= max_n).groupBy("track_id").agg(F.collect_list(F.struct("seq", start.alias("from_ms"), "ms")).alias("asked"))
    said = segments.select("track_id", "seg_idx", "text", F.round(F.col("start_s") * 1000).cast("long").alias("start_ms"), F.round(F.col("end_s") * 1000).cast("long").alias("end_ms"))
    heard = F.filter("asked", lambda a: (F.col("start_ms") < a["ms"]) & (F.col("end_ms") > a["from_ms"]))
    pairs = said.join(windows, "track_id").select("track_id", "seg_idx", "text", F.explode(F.transform(heard, lambda a: a["seq"])).alias("seq"))
    text = pairs.groupBy("track_id", "seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "text"))), lambda s: s["text"]), " ").alias("context"))
    return cands.join(text, ["track_id", "seq"], "left").withColumn("context", F.coalesce("context", F.lit("")))


def prompt_corpus(products: DataFrame, cands: DataFrame, header: str = HEADER, max_n: int = 30) -> DataFrame:
    """(track_id, prompt) of products(track_id, mode, name, blurb, url) and the first max_n of a track's
    cands(track_id, seq, ms, context), as many as an analysis gives."""
    listed = cands.withColumn("_i", F.row_number().over(by_track("seq")) - 1).where(F.col("_i") < max_n)
    block = F.format_string("[%d] t=%dms\nContext before: %s", F.col("_i"), F.col("ms"), F.coalesce("context", F.lit("")))
    blocks = listed.groupBy("track_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("blocks"))
    url = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("Product URL: "), F.col("url")))
    return products.join(blocks, "track_id", "left").select(
        "track_id",
        F.concat_ws("\n", F.lit(header), F.concat(F.lit("Mode: "), "mode"), F.concat(F.lit("Product name: "), "name"), F.concat(F.lit("Product description: "), "blurb"), url, F.lit("Candidates:"), F.coalesce("blocks", F.lit("No candidates."))).alias("prompt"),
    )


def script_prompts(products: DataFrame, style: str = "friendly", header: str = SCRIPT_HEADER) -> DataFrame:
    """T2, the second prompt: (track_id, prompt) that asks for the lines of an ad (K3 reads the answer) of
    products(track_id, name, blurb, ad_mode)."""
    duo = F.col("ad_mode") == "DUO"
    who = F.when(duo, F.lit("Let both speakers talk, in 2 to 4 lines.")).otherwise(F.concat(F.lit("Let only speaker "), F.substring("ad_mode", 1, 1), F.lit(" talk.")))
    lines = [F.lit(header), F.concat(F.lit("Product name: "), "name"), F.concat(F.lit("Product blurb: "), "blurb"), F.lit(f"Ad style: {style}"), F.concat(F.lit("Ad mode: "), "ad_mode"), who, F.lit(SCRIPT_SHAPE)]
    return products.select("track_id", F.concat_ws("\n", *lines).alias("prompt"))


def joined_texts(kept: DataFrame, limit: int) -> DataFrame:
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "text"))), lambda s: s["text"]), " ")
    return kept.groupBy("track_id").agg(F.substring(joined, 1, limit).alias("transcript"))


def transcript_rollup(segments: DataFrame, limit: int = 3000) -> DataFrame:
    """(track_id, transcript): the segments' texts joined by spaces, cut to `limit` characters. Segments that
    start past the limit are left out before anything is collected."""
    texts = segments.withColumn("text", trimmed("text")).where("text <> ''")
    before = F.sum(F.length("text") + 1).over(by_track("seg_idx").rowsBetween(W.unboundedPreceding, -1))
    return joined_texts(texts.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") <= limit), limit)


def parse_choice(responses: DataFrame, products: DataFrame) -> DataFrame:
    """T4: (track_id, promo_text, chosen_index, rationale) of responses(track_id, raw_text): the product's name and
    no index where the answer doesn't say; an index that is no whole number is set aside as null."""
    v = responses.select("track_id", F.try_parse_json(unfenced(F.col("raw_text"))).alias("v")).join(products.select("track_id", "name"), "track_id", "left")
    raw = field(F.col("v"), "$.chosen_index").try_cast("double")
    index = F.when(raw == F.floor(raw), raw.cast("int"))
    return v.select(
        "track_id", trimmed(F.coalesce(field(F.col("v"), "$.promo_text"), F.col("name"))).alias("promo_text"), index.alias("chosen_index"),
        F.when(F.col("v").isNull(), F.lit(BROKEN)).otherwise(trimmed(F.coalesce(field(F.col("v"), "$.rationale"), F.lit("")))).alias("rationale"),
    )
