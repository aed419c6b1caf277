"""Filter, relax, narrow and rank: parsed queries against the catalogue, all queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import title_plural
from marlstone.operators.parse import CHARACTERISTICS

# Parts of category names that raise or lower a product's score.
RAISED = ("лакокрасочн", "декоративн")
LOWERED = ("сантехник", "инструмент", "климатическ")
PLANED = ("строганый", ("строг", "строган"))


def _amounts_fit(query: str = "q", item: str = "c") -> Column:
    """Weight and volume: a product without the figure passes."""
    fits = F.lit(True)
    for k in ("weight_kg", "volume_l"):
        wanted, has = F.col(f"{query}.attributes.{k}"), F.col(f"{item}.attributes.{k}")
        fits = fits & (wanted.isNull() | has.isNull() | (wanted == has))
    return fits


def match_products(parsed: DataFrame, catalog: DataFrame, relax_on_empty: bool = True) -> DataFrame:
    """Candidates of every query with the tier they passed: (q, c, tier).

    Tier 1 passes all hard filters. If a query with brand and type has none, its brand's products
    (tier 2) or, if the brand has none, its type's (tier 3) take their place, without the amounts.
    Each kind of query goes by an equi-join on its most selective slot.
    """
    if "product_id" not in parsed.columns:
        parsed = parsed.withColumn("product_id", F.lit(None).cast("string"))
    q, c = parsed.alias("q"), catalog.alias("c")
    brand, kind, product = (F.col(f"q.{x}") for x in ("brand_id", "product_type_id", "product_id"))
    on_brand, on_kind, on_product = brand == F.col("c.brand_id"), kind == F.col("c.product_type_id"), product == F.col("c.id")
    both = brand.isNotNull() & kind.isNotNull()

    def rows(joined: DataFrame, tier: Column) -> DataFrame:
        columns = lambda a, df: F.struct(*[F.col(f"{a}.{x}") for x in df.columns]).alias(a)
        return joined.select(columns("q", parsed), columns("c", catalog), tier.cast("int").alias("tier"))

    strict = _amounts_fit()
    by_product = q.filter(product.isNotNull()).join(c, on_product).filter((brand.isNull() | on_brand) & (kind.isNull() | on_kind) & strict)
    by_brand = q.filter(brand.isNotNull() & (product.isNull() | both)).join(c, on_brand)
    exact = strict & (kind.isNull() | F.coalesce(on_kind, F.lit(False))) & product.isNull()
    tier = F.when(exact, 1).when(both & F.lit(relax_on_empty), 2)
    by_kind = q.filter(kind.isNotNull() & brand.isNull() & product.isNull()).join(c, on_kind).filter(strict)
    parts = [rows(by_product, F.lit(1)), rows(by_brand, tier).filter("tier IS NOT NULL"), rows(by_kind, F.lit(1))]
    if relax_on_empty:
        brands = catalog.select(F.col("brand_id").alias("known_brand")).filter("known_brand IS NOT NULL").distinct()
        unknown = q.filter(both).join(brands, brand == F.col("known_brand"), "left_anti").alias("q")
        parts.append(rows(unknown.join(c, on_kind), F.lit(3)))
    every = reduce(DataFrame.union, parts)
    best = F.min("tier").over(Window.partitionBy("q.query_id"))
    return every.withColumn("_best", best).filter("tier = _best").drop("_best")


def narrow_amounts(matched: DataFrame) -> DataFrame:
    """Where a query names a weight and some candidate has exactly it, only those stay; then the same
    for the volume."""
    for k in ("weight_kg", "volume_l"):
        same = F.coalesce(F.col(f"c.attributes.{k}") == F.col(f"q.attributes.{k}"), F.lit(False))
        any_same = F.max(same).over(Window.partitionBy("q.query_id"))
        matched = matched.withColumn("_any", any_same).withColumn("_same", same).filter("_same OR NOT _any").drop("_any", "_same")
    return matched


def relevance() -> Column:
    """Score of a candidate (q, c); every term is a whole number."""
    name, category = F.lower(F.coalesce("c.name", F.lit(""))), F.lower(F.coalesce("c.category", F.lit("")))
    has = lambda text, parts: reduce(lambda a, b: a | b, [text.contains(p) for p in parts])
    score = F.when(F.col("q.product_id") == F.col("c.id"), 100).otherwise(0)
    score = score + F.when(has(category, RAISED), 200).when(has(category, LOWERED), -500).otherwise(0)
    shown = F.lower(F.coalesce("q.product_type_display", F.lit("")))
    score = score + F.when((shown != "") & name.contains(shown), F.when(name.startswith(shown), 250).otherwise(100)).otherwise(0)
    for k in CHARACTERISTICS:
        wanted = F.col(f"q.attributes.{k}")
        near = name.contains(wanted)
        if k == "surface":
            near = near | ((wanted == PLANED[0]) & has(name, PLANED[1]))
        score = score + F.when(wanted.isNull(), 0).when(F.col(f"c.attributes.{k}") == wanted, 50).when(near, 30).otherwise(0)
    left = F.size(F.filter("q.unparsed_tokens", lambda t: F.lower(F.coalesce(F.col("c.name"), F.lit(""))).contains(t)))
    return score + 5 * left


def rank_products(matched: DataFrame, top_k: int = 25) -> DataFrame:
    """Best ``top_k`` of every query by score, catalogue order among equals.

    Returns query_id, rank (from 1), score, tier, attribute_relaxed and the product ``c``.
    """
    wanted = F.coalesce(*[F.col(f"q.attributes.{k}") for k in CHARACTERISTICS])
    per_query = Window.partitionBy("q.query_id")
    scored = matched.withColumn("score", relevance())
    scored = scored.withColumn("attribute_relaxed", wanted.isNotNull() & (F.max("score").over(per_query) < 30))
    ranked = scored.withColumn("rank", F.row_number().over(per_query.orderBy(F.desc("score"), F.col("c.ord"))))
    return ranked.filter(F.col("rank") <= top_k).select(F.col("q.query_id").alias("query_id"), "rank", "score", "tier", "attribute_relaxed", "c")


def primary_title(parsed: DataFrame) -> DataFrame:
    """(query_id, title) of queries in which something was recognised."""
    kind = F.when(F.col("product_type_display").isNotNull(), F.concat(F.lit("Найденные "), title_plural(F.col("product_type_display")))).otherwise(F.lit("Найденные товары"))
    return parsed.select("query_id", F.concat_ws(" ", kind, F.col("brand_display")).alias("title"))


def search(parsed: DataFrame, catalog: DataFrame, top_k: int = 25, relax_on_empty: bool = True) -> DataFrame:
    """Primary results of all queries with a recognised slot."""
    return rank_products(narrow_amounts(match_products(parsed, catalog, relax_on_empty)), top_k)


def complement_types(parsed: DataFrame, primary: DataFrame) -> DataFrame:
    """(query_id, product_type_id) for complements: none where the search fell back to the brand."""
    fell = primary.groupBy("query_id").agg(F.min("tier").alias("tier"))
    known = parsed.filter("product_type_id IS NOT NULL").join(fell, "query_id", "left")
    return known.filter("coalesce(tier, 1) <> 2").select("query_id", "product_type_id")
