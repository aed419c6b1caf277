"""Products and whole answers in the shape that clients get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.search import primary_title

#: Host of the shop whose addresses are shown; every function takes another as a parameter.
SITE = "shop.example"

# The form of image paths, the title of keyword results, versions.
IMAGE = r"^/site/catalog-images/[a-zA-Z0-9_.-]+$"
LEGACY_TITLE = "Результаты поиска (Fallback)"
VERSIONS = {"catalog_version": "canonical-v1", "aliases_version": "aliases-v1", "graph_version": "complement-graph-v1-approved"}


def safe_url(url: Column, site: str = SITE) -> Column:
    """The address if it is a secure one of the shop, else empty."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    good = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & host.isin(site, f"www.{site}")
    return F.when(F.coalesce(good, F.lit(False)), url).otherwise("")


def category_url(url: Column, site: str = SITE) -> Column:
    """Address of a product's category: the path segment after ``catalog``."""
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(safe_url(url, site), F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    name = F.get(parts, F.lit(1))
    good = (F.get(parts, F.lit(0)) == "catalog") & name.rlike("^[A-Za-z0-9_-]+$")
    return F.when(F.coalesce(good, F.lit(False)), F.concat(F.lit(f"https://{site}/catalog/"), name, F.lit("/"))).otherwise("")


def safe_image(image: Column) -> Column:
    return F.when(F.coalesce(image.rlike(IMAGE), F.lit(False)), image).otherwise("")


def shown_price(price: Column) -> Column:
    """Price as text for JSON: whole amounts without a fraction."""
    whole = (price == F.floor(price)) & (F.abs(price) < 1e15)
    return F.when(whole, price.cast("decimal(20,0)").cast("string")).otherwise(price.cast("string"))


def product(columns: list[str], site: str = SITE) -> Column:
    """What is shown of a product, from the columns a catalogue has."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in columns else F.lit("")
    url = text("url")
    return F.struct(
        "id", *[text(c).alias(c) for c in ("name", "brand", "sku")], shown_price(F.col("price")).alias("price"), text("category").alias("category"), text("subcategory").alias("subcategory"),
        safe_url(url, site).alias("url"), category_url(url, site).alias("category_url"), safe_image(text("image")).alias("image"),
    )


def _ordered(rows: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(out))


def responses(parsed: DataFrame, primary: DataFrame, groups: DataFrame, fallback: DataFrame, catalog: DataFrame, site: str = SITE) -> DataFrame:
    """(query_id, response): answers as JSON. Queries in which nothing was recognised get the keyword
    results (``fallback``: query_id, rank, id); the others their ``primary`` products and complements."""
    shown = catalog.select("id", product(catalog.columns, site).alias("product"))
    first = _ordered(primary.select("query_id", "rank", F.col("c.id").alias("id")).join(shown, "id"), ["query_id"], "rank", "product", "found")
    other = _ordered(fallback.select("query_id", "rank", "id").join(shown, "id"), ["query_id"], "rank", "product", "legacy")
    relaxed = primary.groupBy("query_id").agg(F.bool_or("attribute_relaxed").alias("attribute_relaxed"))
    members = groups.select("query_id", "edge_ord", F.posexplode("products").alias("rank", "id")).join(shown, "id")
    filled = groups.drop("products").join(_ordered(members, ["query_id", "edge_ord"], "rank", "product", "products"), ["query_id", "edge_ord"], "left")
    empty = F.from_json(F.lit("[]"), first.schema["found"].dataType)
    group = F.struct("title", "relation", "rationale", "data_gap", "data_gap_message", F.coalesce("products", empty).alias("products"))
    beside = _ordered(filled.withColumn("group", group), ["query_id"], "edge_ord", "group", "complements")
    nothing = F.col("brand_id").isNull() & F.col("product_type_id").isNull()
    joined = parsed.join(primary_title(parsed), "query_id").join(first, "query_id", "left").join(other, "query_id", "left").join(relaxed, "query_id", "left").join(beside, "query_id", "left")
    query = F.struct(*[c for c in ("raw", "normalized", "brand_id", "brand_display", "product_type_id", "product_type_display", "attributes", "unparsed_tokens")])
    answer = F.struct(
        query.alias("query"),
        F.struct(F.when(nothing, LEGACY_TITLE).otherwise(F.col("title")).alias("title"), F.coalesce(F.when(nothing, F.col("legacy")).otherwise(F.col("found")), empty).alias("products")).alias("primary"),
        F.coalesce("complements", F.from_json(F.lit("[]"), beside.schema["complements"].dataType)).alias("complements"),
        F.struct(
            F.when(nothing, "legacy_fallback").otherwise("deterministic_v1").alias("strategy"), nothing.alias("fallback_used"),
            F.coalesce("attribute_relaxed", F.lit(False)).alias("attribute_relaxed"), *[F.lit(v).alias(k) for k, v in VERSIONS.items()],
        ).alias("meta"),
    )
    return joined.select("query_id", F.to_json(answer, {"ignoreNullFields": "false"}).alias("response"))
