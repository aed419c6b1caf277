"""Data-quality checks as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import casefold, is_blank


def missing_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, missing): null or empty values of each field, in one pass."""
    counts = rows.agg(*[F.count_if(F.col(f).isNull() | (F.col(f).cast("string") == "")).alias(f) for f in fields])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields])).alias("x")).select("x.*")


def required_violations(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) of blank required fields."""
    blank = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), is_blank(F.col(f).cast("string")).alias("bad")) for f in fields]), lambda x: x["bad"])
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(blank).alias("x")).select("key", F.col("x.field").alias("field"))


def duplicate_groups(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(key, duplicate_groups): how many values of each key are shared; empty ones do not count."""

    def one(name: str, value: Column) -> DataFrame:
        groups = rows.select(casefold(value.cast("string")).alias("v")).filter("v <> ''").groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return groups.agg(F.lit(name).alias("key"), F.count(F.lit(1)).alias("duplicate_groups"))

    return reduce(DataFrame.union, [one(k, v) for k, v in keys.items()])


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100 * part / F.nullif(whole, F.lit(0)), 2))


def type_coverage(products: DataFrame, scope: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: products, mapped to a type, and how far the approved graph covers the types in scope
    (``scope``: product_type_id; ``edges``: source, target, review_status)."""
    approved = edges.filter("review_status = 'approved'")
    by_type = products.filter("coalesce(product_type_id, '') <> ''").groupBy("product_type_id").agg(F.count(F.lit(1)).alias("n"))
    outgoing = approved.select(F.col("source").alias("product_type_id")).distinct().withColumn("out", F.lit(1))
    scoped = scope.join(by_type, "product_type_id", "left").join(outgoing, "product_type_id", "left").agg(
        F.count(F.lit(1)).alias("scoped_types"),
        F.count("n").alias("types_with_products"),
        F.count_if(F.col("n").isNotNull() & F.col("out").isNotNull()).alias("covered_types"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("scoped_products"),
        F.coalesce(F.sum(F.when(F.col("out").isNotNull(), F.col("n"))), F.lit(0)).alias("covered_products"),
    )
    targets = approved.select(F.col("target").alias("product_type_id")).distinct().join(by_type, "product_type_id", "left_anti").agg(F.count(F.lit(1)).alias("empty_targets"))
    mapped = F.count_if(F.coalesce(F.col("product_type_id"), F.lit("")) != "")
    total = products.agg(F.count(F.lit(1)).alias("products"), mapped.alias("mapped"))
    one = total.join(F.broadcast(scoped)).join(F.broadcast(targets))  # single rows
    return one.withColumn("mapped_percent", percent(F.col("mapped"), F.col("products"))).withColumn("covered_percent", percent(F.col("covered_products"), F.col("scoped_products")))


def gates(metrics: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """PASS or FAIL, and the names of failed checks. ``checks``: conditions that must hold."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return metrics.select(F.when(F.size(failed) == 0, "PASS").otherwise("FAIL").alias("status"), failed.alias("errors"))


def staging_checks(staged: DataFrame, host: str = "shop.example") -> DataFrame:
    """(code, key) of bad staged records (source_product_key, url, sku, retrieved_at, content_sha256,
    raw_snapshot): missing provenance, foreign or insecure addresses, repeated keys, snapshot paths
    that leave their folder."""
    say = lambda df, code: df.select(F.lit(code).alias("code"), F.col("source_product_key").alias("key"))
    netloc = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    secure = F.coalesce(F.try_parse_url("url", F.lit("PROTOCOL")), F.lit("")) == "https"
    lacking = reduce(lambda a, b: a | b, [is_blank(F.col(c)) for c in ("source_product_key", "url", "retrieved_at", "content_sha256", "raw_snapshot")])
    again = lambda c: staged.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(c))).filter(F.col(c).isNotNull() & (F.col("_n") > 1))
    parts = F.split(F.coalesce("raw_snapshot", F.lit("")), "/")
    return reduce(
        DataFrame.union,
        [
            say(staged.filter(lacking), "provenance_missing"),
            say(staged.filter(~(secure & netloc.isin(host, f"www.{host}"))), "foreign_address"),
            say(again("source_product_key"), "repeated_key"),
            say(again("url"), "repeated_address"),
            say(staged.filter(F.array_contains(parts, "..") | F.col("raw_snapshot").startswith("/")), "path_escape"),
        ],
    )


def response_checks(items: DataFrame, groups: DataFrame) -> DataFrame:
    """(query_id, code): products that a response holds twice (``items``: query_id, id over primary and
    complements) and empty groups not marked as a gap (``groups``: query_id, n, data_gap)."""
    twice = items.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("query_id", F.lit("repeated_product").alias("code")).distinct()
    empty = groups.filter("n = 0 AND NOT data_gap").select("query_id", F.lit("unmarked_gap").alias("code")).distinct()
    return twice.union(empty)


def type_examples(products: DataFrame, edges: DataFrame, per_type: int = 8) -> DataFrame:
    """(product_type_id, products, out_degree, examples) of every type that has products."""
    rank = F.row_number().over(Window.partitionBy("product_type_id").orderBy("ord"))
    first = products.filter("product_type_id IS NOT NULL").select("product_type_id", "ord", "id", rank.alias("r")).filter(F.col("r") <= per_type)
    examples = first.groupBy("product_type_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("examples"))
    counts = products.filter("product_type_id IS NOT NULL").groupBy("product_type_id").agg(F.count(F.lit(1)).alias("products"))
    degree = edges.filter("review_status = 'approved'").groupBy(F.col("source").alias("product_type_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    return counts.join(degree, "product_type_id", "left").fillna({"out_degree": 0}).join(examples, "product_type_id")
