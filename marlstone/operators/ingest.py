"""Web pages to staged products: sitemaps, address rules, microdata, merging and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import casefold, strip_markup
from marlstone.functions.udfs import html_unescape, title_case


def sitemap_urls(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(ord, url): addresses between loc tags, in order; broken markup around them does not matter."""
    found = payloads.select(F.posexplode(F.regexp_extract_all(F.decode(F.col(column).cast("binary"), "UTF-8") if dict(payloads.dtypes)[column] == "binary" else F.col(column), F.lit("(?is)<loc>(.*?)</loc>"), F.lit(1))).alias("ord", "u"))
    return found.select("ord", html_unescape(F.regexp_replace("u", r"(?U)^\s+|\s+$", "")).alias("url")).filter("url <> ''")


def allowed_urls(urls: DataFrame, base_host: str, prefixes: list[str], robots: DataFrame | None = None) -> DataFrame:
    """Addresses of the host, without query and fragment, under an allowed path and not disallowed.
    ``robots``: rules (prefix, allow); the longest matching rule counts, allow among equals."""
    part = lambda p: F.try_parse_url("url", F.lit(p))
    path = F.coalesce(part("PATH"), F.lit(""))
    ok = F.lit(False)
    for p in prefixes:
        ok = ok | path.startswith(p)
    host = F.lower(F.coalesce(part("HOST"), F.lit(""))) == base_host.lower()
    kept = urls.filter(host & F.coalesce(part("QUERY"), F.lit("")).eqNullSafe("") & F.coalesce(part("REF"), F.lit("")).eqNullSafe("") & ok).withColumn("path", path)
    if robots is not None:
        met = kept.select("path").distinct().join(F.broadcast(robots), F.col("path").startswith(F.col("prefix")))
        last = met.groupBy("path").agg(F.max_by("allow", F.struct(F.length("prefix"), F.col("allow").cast("int"))).alias("allow"))
        kept = kept.join(last.filter("NOT allow"), "path", "left_anti")
    return kept


def distinct_in_order(urls: DataFrame, key: str = "url", order: str = "ord") -> DataFrame:
    """First occurrence of every value."""
    return urls.groupBy(key).agg(F.min(order).alias(order))


def clean_path(url: Column) -> Column:
    return F.concat(F.rtrim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")), F.lit("/"))


def leaf_urls(urls: DataFrame) -> DataFrame:
    """Addresses whose path no other path continues by whole segments."""
    rows = urls.withColumn("_path", clean_path(F.col("url")))
    segments = F.split(F.btrim("_path", F.lit("/")), "/")
    parents = rows.select(segments.alias("s")).select(
        F.explode(F.transform(F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0))), lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice("s", F.lit(1), i + 1), "/"), F.lit("/")))).alias("_path")
    ).distinct()
    return rows.join(parents, "_path", "left_anti").drop("_path")


def slug_filter(urls: DataFrame, pattern: str) -> DataFrame:
    """Addresses whose last path segment meets the pattern."""
    return urls.filter(F.coalesce(F.try_element_at(F.split(F.rtrim(clean_path(F.col("url")), F.lit("/")), "/"), F.lit(-1)), F.lit("")).rlike(pattern))


def discovery_stats(urls: DataFrame) -> DataFrame:
    leaves = leaf_urls(distinct_in_order(urls)).agg(F.count(F.lit(1)).alias("leaves"))
    return urls.agg(F.count(F.lit(1)).alias("seen"), F.countDistinct("url").alias("distinct_urls")).join(F.broadcast(leaves))


def attribute(tag: Column, name: str) -> Column:
    """Quoted value of an attribute of a tag; null if it is absent."""
    pattern = rf"(?is)\b{name}\s*=\s*([\"'])(.*?)\1"
    return F.when(tag.rlike(pattern), F.trim(F.regexp_extract(tag, pattern, 2)))


def first_tag(page: Column, tag: str, itemprop: str) -> Column:
    """First tag of a kind with an itemprop."""
    tags = F.regexp_extract_all(page, F.lit(rf"(?is)(<{tag}\b[^>]*>)"), F.lit(1))
    return F.get(F.filter(tags, lambda t: F.lower(F.coalesce(attribute(t, "itemprop"), F.lit(""))) == itemprop.lower()), F.lit(0))


def meta_content(page: Column, itemprop: str) -> Column:
    return strip_markup(attribute(first_tag(page, "meta", itemprop), "content"))


def join_url(base: Column, target: Column) -> Column:
    """Address of a link on a page: absolute, scheme-relative, rooted or relative to its folder."""
    root = F.concat(F.try_parse_url(base, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(base, F.lit("AUTHORITY")))
    folder = F.regexp_replace(F.coalesce(F.nullif(F.try_parse_url(base, F.lit("PATH")), F.lit("")), F.lit("/")), "[^/]*$", "")
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.try_parse_url(base, F.lit("PROTOCOL")), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(root, folder, target))
    )


def parse_products(pages: DataFrame, path_metadata: DataFrame | None = None) -> DataFrame:
    """Products of microdata pages (url, html): name, brand, category, subcategory, sku, price, url,
    image, source_category. Pages without name, category or article number are no products.
    ``path_metadata``: prefix, ord, category, subcategory; the first matching prefix counts. Other
    columns of a page stay with its product."""
    page = F.col("html")
    parsed = {"name", "brand", "source_category", "sku", "price", "image", "category", "subcategory"}
    sku = strip_markup(F.nullif(F.regexp_extract(page, r"(?is)<span\b[^>]*class\s*=\s*([\"'])[^\"']*\bvendorL\b[^\"']*\1[^>]*>(.*?)</span>", 2), F.lit("")))
    rows = pages.select(
        "url",
        "html",
        *[c for c in pages.columns if c not in parsed | {"url", "html"}],
        meta_content(page, "name").alias("name"),
        F.lit(None).cast("string").alias("brand"),
        meta_content(page, "category").alias("source_category"),
        sku.alias("sku"),
        F.replace(meta_content(page, "price"), F.lit(","), F.lit(".")).try_cast("double").alias("price"),
        join_url(F.col("url"), attribute(first_tag(page, "img", "image"), "src")).alias("image"),
    ).filter("name IS NOT NULL AND source_category IS NOT NULL AND sku IS NOT NULL")
    segments = F.split("source_category", "/")
    rows = rows.withColumn("category", title_case(F.get(segments, F.lit(0)))).withColumn("subcategory", title_case(F.element_at(segments, -1)))
    if path_metadata is not None:
        path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
        known = path_metadata.select("prefix", "ord", F.col("category").alias("_c"), F.col("subcategory").alias("_s"))
        met = rows.select("url", path.alias("_path")).distinct().join(F.broadcast(known), F.col("_path").startswith(F.col("prefix")))
        first = met.groupBy("url").agg(F.min_by(F.struct("_c", "_s"), "ord").alias("_m"))
        rows = rows.join(first, "url", "left")
        rows = rows.withColumn("category", F.coalesce(F.nullif("_m._c", F.lit("")), "category")).withColumn("subcategory", F.coalesce(F.nullif("_m._s", F.lit("")), "subcategory")).drop("_m")
    return rows


def stage(products: DataFrame, source_id: str, retrieved_at: Column) -> DataFrame:
    """Parsed products with their provenance and issues."""
    digest = F.sha2(F.encode("html", "UTF-8"), 256)
    return products.withColumn("source_product_key", F.concat(F.lit(f"{source_id}:"), "sku")).withColumn("content_sha256", digest).withColumn("retrieved_at", retrieved_at).withColumn(
        "issues", F.when(F.col("brand").isNull(), F.array(F.lit("brand_not_exposed"))).otherwise(F.array().cast("array<string>"))
    )


def classify_error(message: Column) -> Column:
    return F.when(message.contains("404") | message.contains("410"), "http_404_not_found").otherwise("fetch_or_parse_error")


def trusted(existing: DataFrame) -> DataFrame:
    """Earlier records that can be kept: snapshot and address are there."""
    return existing.filter("coalesce(raw_snapshot, '') <> '' AND coalesce(url, '') <> ''")


def merge_staged(existing: DataFrame, new: DataFrame, key: str = "source_product_key") -> DataFrame:
    """Last record of every key: ``new`` over ``existing``, later ``seq`` over earlier."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_batch"), F.desc("seq")))
    return both.withColumn("_r", rank).filter("_r = 1").drop("_r", "_batch")


def run_report(attempts: DataFrame, previous_keys: DataFrame) -> DataFrame:
    """One row on a run (``attempts``: source_product_key, ok, error): attempts, successes and their
    share, not found, other errors, and keys that are new."""
    new = attempts.filter("ok").select("source_product_key").distinct().join(previous_keys, "source_product_key", "left_anti").agg(F.count(F.lit(1)).alias("new_keys"))
    code = classify_error(F.coalesce("error", F.lit("")))
    n = F.count(F.lit(1))
    sums = attempts.agg(
        n.alias("attempts"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok") & (code == "http_404_not_found")).alias("not_found"),
        F.count_if(~F.col("ok") & (code != "http_404_not_found")).alias("failed"),
        F.coalesce(F.round(100 * F.count_if("ok") / F.nullif(n, F.lit(0)), 2), F.lit(0.0)).alias("success_percent"),
    )
    return sums.join(F.broadcast(new))


def same_host(url: Column, hosts: tuple[str, ...]) -> Column:
    return casefold(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))).isin(*hosts)
