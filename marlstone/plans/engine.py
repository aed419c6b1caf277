"""The whole search: queries in, answers out, as one plan over a batch."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import graph, legacy, resolve, respond, search
from marlstone.operators.parse import parse_queries

MODES = ("off", "shadow", "apply")


@dataclass
class Engine:
    """A catalogue with its dictionary and graph, and optionally an entity index.

    ``embed``: adds ``vector`` to spans (span_id, entity_type, text); where it is absent, or the index
    cannot be used, spans stay unresolved and the deterministic result stands.
    """

    catalog: DataFrame
    dictionary: DataFrame
    edges: DataFrame
    nodes: DataFrame
    index: DataFrame | None = None
    embed: Callable[[DataFrame], DataFrame] | None = None
    site: str = respond.SITE

    def parse(self, queries: DataFrame, mode: str = "apply") -> DataFrame:
        """Slots of the queries, with what the resolver adds; an unknown mode counts as apply."""
        mode = mode if mode in MODES else "apply"
        parsed = parse_queries(queries, self.dictionary)
        if mode == "off" or self.index is None or self.embed is None:
            return parsed.withColumn("product_id", F.lit(None).cast("string")).withColumn("resolver_status", F.lit("not_needed"))
        spans = resolve.route_spans(parsed).withColumn("span_id", F.xxhash64("text", "entity_type"))
        # a span that many queries share is resolved once
        distinct = self.embed(spans.select("span_id", "entity_type", "text").distinct())
        found = resolve.resolve_spans(distinct, self.index).drop("text", "entity_type").join(spans, "span_id")
        routed = resolve.route(parsed, found, self.catalog, mode).withColumnRenamed("query_id", "_id")
        slots = ("brand_id", "brand_display", "product_type_id", "product_type_display", "unparsed_tokens")
        return parsed.drop(*slots).join(routed, F.col("query_id").cast("string") == F.col("_id")).drop("_id")

    def answer(self, queries: DataFrame, top_k: int = 25, mode: str = "apply", force_legacy: bool = False, relax_on_empty: bool = True) -> DataFrame:
        """(query_id, response JSON) for every query (query_id, raw). Queries that are equal but for
        case and outer blanks are answered once."""
        key = F.lower(F.trim(F.coalesce("raw", F.lit(""))))
        asked = queries.withColumn("_key", key)
        once = asked.groupBy("_key").agg(F.min("raw").alias("raw")).select(F.xxhash64("_key").alias("query_id"), "raw")
        parsed = self.parse(once, mode)
        if force_legacy:
            empty = {c: F.lit(None).cast(dict(parsed.dtypes)[c]) for c in ("brand_id", "brand_display", "product_type_id", "product_type_display", "product_id")}
            parsed = parsed.withColumns(empty)
        primary = search.search(parsed, self.catalog, top_k, relax_on_empty)
        beside = graph.complements(search.complement_types(parsed, primary), self.edges, self.nodes, self.catalog)
        nothing = parsed.filter("brand_id IS NULL AND product_type_id IS NULL AND product_id IS NULL").select("query_id")
        fallback = legacy.keyword_search(once.join(nothing, "query_id", "left_semi"), self.catalog, top_k)
        answers = respond.responses(parsed, primary, beside, fallback, self.catalog, self.site)
        return asked.select(F.col("query_id"), F.xxhash64("_key").alias("_q")).join(answers.withColumnRenamed("query_id", "_q"), "_q").drop("_q")

    def search_json(self, spark: SparkSession, raw: str, **options) -> dict:
        """One query, answered as a dict."""
        row = self.answer(spark.createDataFrame([(0, raw)], "query_id long, raw string"), **options).first()
        return json.loads(row["response"])
