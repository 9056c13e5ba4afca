"""Sponsor statements and their slots (K7 to K9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import by_track, trimmed

# The sentence for a sponsor without one of its own.
BRAND, PRODUCT = "Our sponsor", "a thoughtful companion for your day"
STATEMENT = "%s supports this episode with %s, offering a simple way to stay focused and refreshed."


def normalize_statements(raw: DataFrame) -> DataFrame:
    """K7: (track_id, statements) of raw(track_id, value): a JSON array's trimmed non-blank entries, or the text."""
    text = trimmed(F.coalesce("value", F.lit("")))
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<string>")
    entries = F.filter(F.transform(items, lambda x: trimmed(F.coalesce(x, F.lit("")))), lambda x: x != "")
    none = F.array().cast("array<string>")
    return raw.select("track_id", F.when(text == "", none).when(items.isNotNull(), entries).otherwise(F.array(text)).alias("statements"))


def sponsor_statements(sponsors: DataFrame) -> DataFrame:
    """K8: (track_id, ord, id, name, statement, generated) of sponsors(track_id, ord, id, name, brand, product_desc,
    statement)."""
    name = trimmed(F.coalesce("name", "brand", F.lit("")))
    desc, own = trimmed(F.coalesce("product_desc", F.lit(""))), trimmed(F.coalesce("statement", F.lit("")))
    made = F.format_string(STATEMENT, F.when(name == "", BRAND).otherwise(name), F.when(desc == "", PRODUCT).otherwise(desc))
    place = F.row_number().over(by_track("ord"))
    return sponsors.select("track_id", "ord", F.coalesce("id", F.concat(F.lit("sponsor-"), place.cast("string"))).alias("id"), name.alias("name"), F.when(own == "", made).otherwise(own).alias("statement"), (own == "").alias("generated"))


def listed_statements(normalized: DataFrame) -> DataFrame:
    """K8 for plain statements (K7's rows): no names, nothing generated."""
    rows = normalized.select("track_id", F.posexplode("statements").alias("ord", "statement"))
    return rows.select("track_id", "ord", F.concat(F.lit("sponsor-"), (F.col("ord") + 1).cast("string")).alias("id"), F.lit("").alias("name"), "statement", F.lit(False).alias("generated"))


def assign_sponsors(slots: DataFrame, sponsors: DataFrame, previous: DataFrame, max_sponsors: int = 3) -> DataFrame:
    """K9: (track_id, slot_id, sponsor_id): the previous sponsor where it's still there, else the one at the slot's
    place, the last for all places after. slots(track_id, pos, id); previous(track_id, slot_id, sponsor_id)."""
    numbered = sponsors.withColumn("p", F.row_number().over(by_track("ord"))).where(F.col("p") <= max_sponsors).select("track_id", "p", F.col("id").alias("sponsor_id"))
    count = numbered.groupBy("track_id").agg(F.max("p").alias("n"))
    placed = slots.withColumn("p", F.row_number().over(by_track("pos"))).join(count, "track_id").withColumn("p", F.least("p", "n"))
    still = previous.join(numbered.select("track_id", "sponsor_id"), ["track_id", "sponsor_id"], "left_semi").select("track_id", F.col("slot_id").alias("id"), F.col("sponsor_id").alias("_kept"))
    return placed.join(numbered, ["track_id", "p"]).join(still, ["track_id", "id"], "left").select("track_id", F.col("id").alias("slot_id"), F.coalesce("_kept", "sponsor_id").alias("sponsor_id"))
