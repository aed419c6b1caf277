"""Free-text queries to slots: brand, product type, attributes and what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import VOLUME_UNITS, WEIGHT_UNITS, amount_value, first_amount, normalize_text, tokens
from marlstone.operators.aliases import match_phrases

CHARACTERISTICS = ("surface", "moisture", "finish", "properties", "color")


def parse_queries(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Slots of every query (query_id, raw).

    Returns query_id, raw, normalized, tokens, product_type_id/display, brand_id/display,
    ``attributes`` (weight_kg, volume_l and the characteristics) and ``unparsed_tokens``. The first
    match of a kind counts, and the first of each attribute key; only what counts uses up tokens,
    and a used-up token is dropped wherever it stands. Empty and null queries have empty slots.
    """
    base = queries.select("query_id", "raw", normalize_text(F.col("raw")).alias("normalized"))
    base = base.withColumn("tokens", tokens(F.col("normalized")))
    slot = F.when(F.col("kind") == "attribute", F.concat(F.lit("attribute:"), F.col("id"))).otherwise(F.col("kind"))
    matches = match_phrases(base, dictionary).withColumn("slot", slot)
    won = matches.groupBy("query_id", "slot").agg(F.min_by(F.struct("start", "end", "id", "display"), "start").alias("m"))
    pick = lambda name: F.max(F.when(F.col("slot") == name, F.col("m")))
    slots = won.groupBy("query_id").agg(
        pick("product_type").alias("t"),
        pick("brand").alias("b"),
        *[pick(f"attribute:{k}").alias(f"a_{k}") for k in CHARACTERISTICS],
        F.collect_list(F.struct(F.col("m.start").alias("start"), F.col("m.end").alias("end"))).alias("used"),
    )
    joined = base.join(slots, "query_id", "left")
    joined = joined.withColumn("w", first_amount(F.col("normalized"), WEIGHT_UNITS)).withColumn("v", first_amount(F.col("normalized"), VOLUME_UNITS))
    none = F.array().cast("array<string>")
    spans = F.flatten(F.transform(F.col("used"), lambda u: F.slice(F.col("tokens"), u["start"] + 1, u["end"] - u["start"])))
    amounts = F.array_compact(F.array(F.col("w.number"), F.col("w.unit"), F.col("v.number"), F.col("v.unit")))
    joined = joined.withColumn("_gone", F.concat(F.coalesce(spans, none), amounts))
    return joined.select(
        "query_id",
        "raw",
        "normalized",
        "tokens",
        F.col("t.id").alias("product_type_id"),
        F.col("t.display").alias("product_type_display"),
        F.col("b.id").alias("brand_id"),
        F.col("b.display").alias("brand_display"),
        F.struct(
            amount_value(F.col("w")).alias("weight_kg"),
            amount_value(F.col("v")).alias("volume_l"),
            *[F.col(f"a_{k}.display").alias(k) for k in CHARACTERISTICS],
        ).alias("attributes"),
        F.filter("tokens", lambda t: ~F.array_contains(F.col("_gone"), t)).alias("unparsed_tokens"),
    )
