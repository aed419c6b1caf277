"""Quality, ingestion, chat, source and relational queries."""

from __future__ import annotations

import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import chat, ingest, quality
from marlstone.operators.aliases import alias_dictionary, config_rows
from marlstone.operators.index import index_checks
from marlstone.plans.registry import CATALOG, catalog, query, table, values
from marlstone.sources import tables
from marlstone.streaming import ingest as streaming

# ---- quality


@query(
    "SELECT field, CAST(n AS BIGINT) AS missing FROM (SELECT 'p_name' AS field, sum(CASE WHEN p_partkey % 10 = 0 OR p_name = '' THEN 1 ELSE 0 END) AS n FROM part UNION ALL SELECT 'p_brand', sum(CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END) FROM part UNION ALL SELECT 'p_retailprice', count(*) - count(p_retailprice) FROM part)"
)
def v01_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("p_name", F.when(F.col("p_partkey") % 10 != 0, F.col("p_name"))).withColumn("p_brand", F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_brand")))
    return quality.missing_counts(rows, ["p_name", "p_brand", "p_retailprice"])


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, 'p_type' AS field FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_name' FROM part WHERE p_partkey % 13 = 0")
def v02_required(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("p_type", F.when(F.col("p_partkey") % 11 == 0, "  ").otherwise(F.col("p_type"))).withColumn("p_name", F.when(F.col("p_partkey") % 13 != 0, F.col("p_name")))
    return quality.required_violations(rows, "p_partkey", ["p_name", "p_type"])


@query(
    "SELECT 'text' AS key, count(*) AS duplicate_groups FROM (SELECT replace(lower(text), 'ß', 'ss') AS t FROM documents GROUP BY 1 HAVING count(*) > 1 AND t <> '') UNION ALL SELECT 'id', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'source', count(*) FROM (SELECT source FROM documents GROUP BY 1 HAVING count(*) > 1)"
)
def v03_duplicates(spark, sf_dir):
    return quality.duplicate_groups(table(spark, sf_dir, "documents"), {"text": F.col("text"), "id": F.col("doc_id"), "source": F.col("source")})


_SCOPE = ("type:ring", "type:bolt", "type:gear", "type:none")
_LINKS = (("type:ring", "type:bolt", "approved"), ("type:gear", "type:nowhere", "approved"), ("type:bolt", "type:ring", "candidate"), ("type:none", "type:gear", "approved"))
_COVER = f"""WITH {CATALOG}, p AS (SELECT id, CASE WHEN ord % 6 <> 0 THEN product_type_id END AS t FROM catalog), scope AS (SELECT * FROM {values([(s,) for s in _SCOPE], "t")}),
e AS (SELECT * FROM {values(_LINKS, "source, target, review_status")}), n AS (SELECT t, count(*) AS n FROM p WHERE t IS NOT NULL GROUP BY t),
o AS (SELECT DISTINCT source AS t FROM e WHERE review_status = 'approved'),
s AS (SELECT count(*) AS scoped_types, count(n) AS types_with_products, count(CASE WHEN n IS NOT NULL AND o.t IS NOT NULL THEN 1 END) AS covered_types,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS scoped_products, CAST(coalesce(sum(CASE WHEN o.t IS NOT NULL THEN n END), 0) AS BIGINT) AS covered_products FROM scope LEFT JOIN n USING (t) LEFT JOIN o USING (t)),
m AS (SELECT count(*) AS products, count(t) AS mapped FROM p),
g AS (SELECT count(*) AS empty_targets FROM (SELECT DISTINCT target FROM e WHERE review_status = 'approved' AND target NOT IN (SELECT t FROM n))),
metrics AS (SELECT *, round(100.0 * mapped / products, 2) AS mapped_percent, round(100.0 * covered_products / scoped_products, 2) AS covered_percent FROM m, s, g)"""


def _coverage(spark, sf_dir):
    rows = catalog(spark, sf_dir).withColumn("product_type_id", F.when(F.col("ord") % 6 != 0, F.col("product_type_id")))
    scope = spark.createDataFrame([(s,) for s in _SCOPE], "product_type_id string")
    return quality.type_coverage(rows, scope, spark.createDataFrame(list(_LINKS), "source string, target string, review_status string"))


@query(_COVER + " SELECT * FROM metrics")
def v06_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir)


@query(_COVER + " SELECT 'FAIL' AS status, 'mapped,empty_targets' AS errors FROM metrics WHERE mapped_percent < 90 AND covered_percent >= 10 AND empty_targets > 0")
def v07_gates(spark, sf_dir):
    checks = {"mapped": F.col("mapped_percent") >= 90, "covered": F.col("covered_percent") >= 10, "empty_targets": F.col("empty_targets") == 0}
    return quality.gates(_coverage(spark, sf_dir), checks).select("status", F.array_join("errors", ",").alias("errors"))


_STAGED = (
    ("k1", "https://shop.example/a", "t", "s", "raw/a"),
    ("k2", "http://shop.example/b", "t", "s", "raw/b"),
    ("k2", "https://other.example/c", "t", "s", "raw/c"),
    ("k4", "https://shop.example/a", "", "s", "raw/../../x"),
)


@query(
    "SELECT * FROM (VALUES ('provenance_missing', 'k4'), ('foreign_address', 'k2'), ('foreign_address', 'k2'), ('repeated_key', 'k2'), ('repeated_key', 'k2'), ('repeated_address', 'k1'), ('repeated_address', 'k4'), ('path_escape', 'k4')) t(code, key)"
)
def v08_staging(spark, sf_dir):
    return quality.staging_checks(spark.createDataFrame(list(_STAGED), "source_product_key string, url string, retrieved_at string, content_sha256 string, raw_snapshot string"))


@query(
    """WITH i AS (SELECT 'e' || label % 3 AS entity_type, CAST(label AS VARCHAR) AS entity_id, CAST(vec_id % 100 AS VARCHAR) AS p, len(embedding) AS d FROM embeddings)
SELECT 'phrases' AS "check", entity_type AS subject, count(*) AS n FROM i GROUP BY 2 UNION ALL SELECT 'dimension', CAST(d AS VARCHAR), count(*) FROM i GROUP BY 2
UNION ALL SELECT 'repeated', 'all', count(*) FROM (SELECT 1 FROM i GROUP BY entity_type, entity_id, p HAVING count(*) > 1)"""
)
def v09_index_checks(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    index = v.select(
        F.concat(F.lit("e"), (F.col("label") % 3).cast("string")).alias("entity_type"), F.col("label").cast("string").alias("entity_id"), (F.col("vec_id") % 100).cast("string").alias("normalized_phrase"), F.size("embedding").alias("dimension")
    )
    return index_checks(index)


@query("SELECT o_custkey AS query_id, 'repeated_product' AS code FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, l_partkey HAVING count(*) > 1 UNION SELECT c_custkey, 'unmarked_gap' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def v10_response_checks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), "o_orderkey")
    items = orders.join(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id")), F.col("o_orderkey") == F.col("l_orderkey")).select("query_id", "id")
    counts = orders.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    groups = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id")).join(counts, "query_id", "left").fillna({"n": 0}).withColumn("data_gap", F.col("query_id") % 3 != 0)
    return quality.response_checks(items, groups)


@query(
    f"""WITH {CATALOG}, e AS (SELECT * FROM {values(_LINKS, "source, target, review_status")}), r AS (SELECT product_type_id, id, row_number() OVER (PARTITION BY product_type_id ORDER BY ord) AS r FROM catalog)
SELECT product_type_id, count(*) AS products, (SELECT count(*) FROM e WHERE source = product_type_id AND review_status = 'approved') AS out_degree,
  string_agg(CASE WHEN r <= 8 THEN id END, ',' ORDER BY r) AS examples FROM r GROUP BY product_type_id"""
)
def v11_examples(spark, sf_dir):
    edges = spark.createDataFrame(list(_LINKS), "source string, target string, review_status string")
    return quality.type_examples(catalog(spark, sf_dir), edges).withColumn("examples", F.array_join("examples", ","))


# ---- ingestion


_URL = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"


@query(f"SELECT page_id, {_URL} AS path FROM pages WHERE NOT contains(url, '?') AND NOT contains(url, '#') AND (starts_with({_URL}, '/en') OR starts_with({_URL}, '/de')) AND regexp_matches(url, '^https?://(www[.])?[a-z0-9]+')")
def i01_url_canon(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    plain = F.try_parse_url("url", F.lit("QUERY")).isNull() & F.try_parse_url("url", F.lit("REF")).isNull()
    ok = pages.filter(plain & (path.startswith("/en") | path.startswith("/de")) & host.rlike("^(www[.])?[a-z0-9]+"))
    return ok.select("page_id", path.alias("path"))


_ALLOWED = (
    ("https://shop.example/catalog/a/", 1),
    ("https://SHOP.example/catalog/b/", 1),
    ("https://shop.example/catalog/c/?x=1", 0),
    ("https://shop.example/catalog/d/#top", 0),
    ("https://other.example/catalog/e/", 0),
    ("https://shop.example/news/f/", 0),
    ("https://shop.example/catalog/private/g/", 0),
    ("https://shop.example/catalog/private/open/h/", 1),
)


@query(f"SELECT url FROM {values(_ALLOWED, 'url, ok')} WHERE ok = 1")
def s05_robots(spark, sf_dir):
    urls = spark.createDataFrame([(u,) for u, _ in _ALLOWED], "url string")
    robots = spark.createDataFrame([("/catalog/private/", False), ("/catalog/private/open/", True)], "prefix string, allow boolean")
    return ingest.allowed_urls(urls, "shop.example", ["/catalog/"], robots).select("url")


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, min(page_id) AS ord FROM pages GROUP BY 1")
def i02_distinct(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.try_parse_url("url", F.lit("AUTHORITY")).alias("host"), F.col("page_id").alias("ord"))
    return ingest.distinct_in_order(pages, "host")


_PARENTS = (("https://x.example/en/", -1), ("https://x.example/en/1/2/3/", -2), ("https://x.example/fr", -3), ("https://x.example/none/", -4))
_PATHS = f"""u AS (SELECT page_id AS ord, url FROM pages UNION ALL SELECT ord, url FROM {values([(o, u) for u, o in _PARENTS], 'ord, url')}),
p AS (SELECT ord, rtrim({_URL}, '/') || '/' AS path FROM u)"""


@query(f"WITH {_PATHS} SELECT ord FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.path <> a.path AND starts_with(b.path, a.path))")
def i03_leaf_urls(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), "url").unionByName(spark.createDataFrame(list(_PARENTS), "url string, ord long"))
    return ingest.leaf_urls(urls).select("ord")


@query(f"SELECT page_id FROM pages WHERE regexp_matches(split_part(rtrim({_URL}, '/'), '/', -1), '^[0-9]*[05]$')")
def i04_slug(spark, sf_dir):
    return ingest.slug_filter(table(spark, sf_dir, "pages"), "^[0-9]*[05]$").select("page_id")


@query(f"WITH {_PATHS}, d AS (SELECT DISTINCT url FROM u) SELECT (SELECT count(*) FROM u) AS seen, (SELECT count(*) FROM d) AS distinct_urls, count(*) AS leaves FROM (SELECT rtrim({_URL}, '/') || '/' AS path FROM d) a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.path <> a.path AND starts_with(b.path, a.path))")
def i05_stats(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), "url").unionByName(spark.createDataFrame(list(_PARENTS), "url string, ord long"))
    return ingest.discovery_stats(urls)


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, regexp_extract(html, '(?i)<meta\\s+charset=\"([^\"]*)\"', 1) AS charset, len(regexp_extract_all(html, '(?i)<a\\s+href=')) AS links FROM pages")
def i07_page_fields(spark, sf_dir):
    h = F.col("html")
    meta = F.get(F.filter(F.regexp_extract_all(h, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1)), lambda t: ingest.attribute(t, "charset").isNotNull()), F.lit(0))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.nullif(F.trim(F.regexp_extract(h, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")).alias("title"),
        F.coalesce(ingest.attribute(meta, "charset"), F.lit("")).alias("charset"),
        F.size(F.regexp_extract_all(h, F.lit(r"(?i)(<a\s+href=)"), F.lit(1))).cast("long").alias("links"),
    )


def _microdata(spark, sf_dir):
    """Product pages made of the catalogue, some without an article number."""
    c = catalog(spark, sf_dir)
    page = F.concat(
        F.lit('<html><META content="'), "name", F.lit("\" itemprop='name'><meta itemprop=\"category\" content=\""), "category", F.lit("/"), "subcategory",
        F.lit('"><meta itemprop=price content="0"><meta itemprop="price" content="'), F.replace(F.col("price").cast("string"), F.lit("."), F.lit(",")),
        F.lit('"><img itemprop="image" src="/img/'), "id", F.lit('.jpg">'), F.when(F.col("ord") % 9 != 0, F.concat(F.lit('<span class="x vendorL y"> <b>'), "sku", F.lit("</b></span>"))).otherwise(""),
    )
    return c.select(F.concat(F.lit("https://shop.example/catalog/"), "subcategory", F.lit("/"), "id", F.lit("/")).alias("url"), page.alias("html"))


@query(
    f"""WITH {CATALOG} SELECT sku, name, CASE WHEN subcategory = 'gear' THEN 'Gears' ELSE upper(left(category, 1)) || lower(substr(category, 2)) END AS category,
upper(left(subcategory, 1)) || substr(subcategory, 2) AS subcategory, price, 'https://shop.example/img/' || id || '.jpg' AS image FROM catalog WHERE ord % 9 <> 0"""
)
def i10_parse_products(spark, sf_dir):
    known = spark.createDataFrame([("/catalog/gear/", 1, "Gears", ""), ("/catalog/", 2, "", "")], "prefix string, ord int, category string, subcategory string")
    return ingest.parse_products(_microdata(spark, sf_dir), known).select("sku", "name", "category", "subcategory", "price", "image")


_PREFIXES = (("/catalog/ge", 3, "Machines", "Parts"), ("/catalog/gear/1", 1, "", "Ones"), ("/catalog/r", 2, "Bars", ""), ("/catalog/ring/", 4, "Rings", "Rings"), ("/other/", 0, "Other", "Other"))


@query(
    f"""WITH {CATALOG}, k AS (SELECT * FROM {values(_PREFIXES, "prefix, ord, c, s")}), paths AS (SELECT sku, '/catalog/' || subcategory || '/' || id || '/' AS path, category, subcategory FROM catalog WHERE ord % 9 <> 0),
m AS (SELECT sku, arg_min(c, k.ord) AS c, arg_min(s, k.ord) AS s FROM paths JOIN k ON starts_with(path, prefix) GROUP BY sku)
SELECT sku, coalesce(nullif(c, ''), upper(left(category, 1)) || lower(substr(category, 2))) AS category, coalesce(nullif(s, ''), upper(left(subcategory, 1)) || substr(subcategory, 2)) AS subcategory FROM paths LEFT JOIN m USING (sku)"""
)
def i12_path_metadata(spark, sf_dir):
    """The first prefix in the table's order, not the longest; its empty fields fall back to the page's."""
    known = spark.createDataFrame(list(_PREFIXES), "prefix string, ord int, category string, subcategory string")
    return ingest.parse_products(_microdata(spark, sf_dir), known).select("sku", "category", "subcategory")


@query(
    """SELECT page_id FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE sha256(html) END AS raw_snapshot, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE url END AS url FROM pages)
WHERE raw_snapshot <> '' AND url <> ''"""
)
def i15_trusted(spark, sf_dir):
    choose = lambda n, value: F.when(F.col("page_id") % n == 0, F.lit(None)).when(F.col("page_id") % n == 1, F.lit("")).otherwise(value)
    rows = table(spark, sf_dir, "pages").select("page_id", choose(4, F.sha2("html", 256)).alias("raw_snapshot"), choose(3, F.col("url")).alias("url"))
    return ingest.trusted(rows).select("page_id")


@query(f"WITH {CATALOG} SELECT 'shop:' || sku AS source_product_key, 'brand_not_exposed' AS issues FROM catalog WHERE ord % 9 <> 0")
def i13_stage(spark, sf_dir):
    staged = ingest.stage(ingest.parse_products(_microdata(spark, sf_dir)), "shop", F.lit("2024-01-01T00:00:00Z"))
    return staged.select("source_product_key", F.array_join("issues", ",").alias("issues"))


@query(
    """SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id
  ORDER BY CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END DESC, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""
)
def i14_merge_last_write(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("seq"))
    return ingest.merge_staged(rows.filter("event_id % 2 <> 0"), rows.filter("event_id % 2 = 0"), "user_id").drop("seq")


@query(
    """SELECT count(*) AS attempts, count(CASE WHEN event_id % 10 <> 0 THEN 1 END) AS succeeded, count(CASE WHEN event_id % 20 = 0 THEN 1 END) AS not_found,
  count(CASE WHEN event_id % 20 = 10 THEN 1 END) AS failed, round(100.0 * count(CASE WHEN event_id % 10 <> 0 THEN 1 END) / count(*), 2) AS success_percent,
  count(DISTINCT CASE WHEN event_id % 10 <> 0 AND user_id % 4 <> 0 THEN user_id END) AS new_keys FROM events"""
)
def i16_report(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    error = F.when(F.col("event_id") % 20 == 0, "HTTP 404").when(F.col("event_id") % 20 == 10, "timeout")
    attempts = rows.select(F.col("user_id").alias("source_product_key"), (F.col("event_id") % 10 != 0).alias("ok"), error.alias("error"))
    return ingest.run_report(attempts, rows.filter("user_id % 4 = 0").select(F.col("user_id").alias("source_product_key")).distinct())


_LINKS_ON_PAGE = (("https://x.example/a/b.html", "/i/1.jpg", "https://x.example/i/1.jpg"), ("https://x.example/a/b.html", "2.jpg", "https://x.example/a/2.jpg"), ("https://x.example/a/", "//cdn.example/3", "https://cdn.example/3"), ("https://x.example", "4", "https://x.example/4"), ("https://x.example/a", "http://y.example/5", "http://y.example/5"))


@query(f"SELECT base, link, url FROM {values(_LINKS_ON_PAGE, 'base, link, url')}")
def i08_join_url(spark, sf_dir):
    rows = spark.createDataFrame([x[:2] for x in _LINKS_ON_PAGE], "base string, link string")
    return rows.select("base", "link", ingest.join_url(F.col("base"), F.col("link")).alias("url"))


@query("SELECT * FROM (VALUES (0, 'https://x.example/a/'), (1, 'https://x.example/b?c=1&d=2'), (3, 'https://x.example/e')) t(ord, url)")
def s06_sitemap(spark, sf_dir):
    payload = "<urlset><url><loc>https://x.example/a/</loc></url><LOC> https://x.example/b?c=1&amp;d=2\n</Loc><loc> </loc><broken><loc>https://x.example/e</loc>"
    return ingest.sitemap_urls(spark.createDataFrame([(payload,)], "payload string"))


# ---- chat


@query(
    """WITH m AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations),
b AS (SELECT conv_id, arg_min(CASE WHEN role NOT IN ('user', 'assistant') THEN 'bad_role' ELSE 'user_text_too_long' END, turn) AS r FROM m
  WHERE role NOT IN ('user', 'assistant') OR (role = 'user' AND length(t) > 400) GROUP BY conv_id)
SELECT m.conv_id, coalesce(max(b.r), CASE WHEN count(CASE WHEN role = 'user' AND t <> '' THEN 1 END) = 0 THEN 'no_user_message' END) AS reason FROM m LEFT JOIN b USING (conv_id) GROUP BY m.conv_id"""
)
def h01_validate(spark, sf_dir):
    return chat.validate(table(spark, sf_dir, "conversations"))


_INTENT = ((1, 0, "Сравните краску и эмаль", 1), (2, 0, "что  лучше: лак или масло", 1), (3, 0, "нужен лак", 0), (4, 0, "какая из них лучше", 0), (7, 0, "какой из них лучше", 1), (5, 0, "ОТЛИЧИЯ грунтовок", 1), (6, 0, "прекрасный лак", 0))


@query(f"SELECT conv_id, ok = 1 AS comparison FROM {values(_INTENT, 'conv_id, turn, txt, ok')} UNION ALL SELECT 100 + conv_id, false FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND trim(text) <> '')")
def h02_intent(spark, sf_dir):
    literal = spark.createDataFrame([(c, t, "user", x) for c, t, x, _ in _INTENT], "conv_id long, turn long, role string, text string")
    stored = table(spark, sf_dir, "conversations").select((F.col("conv_id") + 100).alias("conv_id"), "turn", "role", "text")
    return chat.wants_comparison(literal.unionByName(stored))


def _replies(spark, sf_dir):
    """Every product in a reply of at most ten, neighbours in the catalogue together: some marked,
    some by name or article number alone, some marked twice."""
    c = catalog(spark, sf_dir)
    groups = c.withColumn("msg_id", F.floor(F.col("ord") / 10).cast("string")).groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "name", "sku"))).alias("p"))
    marker = lambda x: F.concat(F.lit("[id:"), x["id"], F.lit("]"))
    line = lambda x: (
        F.when(x["ord"] % 5 == 0, F.concat(F.lit("Take "), x["sku"], F.lit("; it is fine.")))
        .when(x["ord"] % 5 == 1, F.concat(F.lit("Options:\n"), marker(x), F.lit(" once more:\n"), marker(x)))
        .otherwise(F.concat(F.lit("Option "), x["name"], F.lit(":  "), marker(x)))
    )
    lines = F.array_join(F.transform("p", line), "\n")
    pair = F.concat(F.lit(" [compare:"), F.col("p")[0]["id"], F.lit("| one ] [compare:"), F.get("p", F.lit(1))["id"], F.lit("|two] [compare_result: same]"))
    compare = F.coalesce(pair, F.lit(""))  # the last reply may hold one product
    return groups.select("msg_id", F.concat(lines, compare).alias("text"), F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["sku"].alias("sku"))).alias("products"))


_MARKER = chat.MARKER.replace("(?i)", "")
_TIDY = lambda t: f"trim(regexp_replace(regexp_replace(regexp_replace({t}, '[ \\t]+\\n', chr(10), 'g'), ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))"
_BLOCKS = f"""WITH {CATALOG}, said AS (SELECT CAST(ord // 10 AS VARCHAR) AS msg_id, ord, id, name, sku, row_number() OVER (PARTITION BY ord // 10 ORDER BY ord) AS i,
  CASE WHEN ord % 5 = 0 THEN 'Take ' || sku || '; it is fine.' WHEN ord % 5 = 1 THEN 'Options:' || chr(10) || '[id:' || id || '] once more:' || chr(10) || '[id:' || id || ']'
    ELSE 'Option ' || name || ':  [id:' || id || ']' END AS line FROM catalog),
raw AS (SELECT msg_id, string_agg(line, chr(10) ORDER BY i) || coalesce(' [compare:' || max(CASE WHEN i = 1 THEN id END) || '| one ] [compare:' || max(CASE WHEN i = 2 THEN id END) || '|two] [compare_result: same]', '') AS t FROM said GROUP BY msg_id),
put AS (SELECT said.msg_id, i, id, CASE WHEN strpos(t, name) > 0 THEN strpos(t, name) - 1 + length(name) WHEN strpos(t, sku) > 0 THEN strpos(t, sku) - 1 + length(sku) END AS pos
  FROM said JOIN raw USING (msg_id) WHERE NOT contains(t, '[id:' || id || ']')),
cut AS (SELECT msg_id, pos, string_agg(' [id:' || id || ']', '' ORDER BY i DESC) AS m, coalesce(lag(pos) OVER (PARTITION BY msg_id ORDER BY pos), 0) AS prev, lead(pos) OVER (PARTITION BY msg_id ORDER BY pos) AS nxt FROM put WHERE pos IS NOT NULL GROUP BY msg_id, pos),
marked AS (SELECT raw.msg_id, coalesce(string_agg(substr(t, prev + 1, pos - prev) || m || CASE WHEN nxt IS NULL THEN substr(t, pos + 1) ELSE '' END, '' ORDER BY pos), max(t)) AS t FROM raw LEFT JOIN cut USING (msg_id) GROUP BY raw.msg_id),
places AS (SELECT msg_id, unnest(string_split_regex(t, '{_MARKER}')) AS before, unnest(list_append(regexp_extract_all(t, '{_MARKER}'), '')) AS m, generate_subscripts(string_split_regex(t, '{_MARKER}'), 1) AS place FROM marked),
parts AS (SELECT places.msg_id, place, before, regexp_extract(m, '^\\[(\\w+)', 1) AS kind, nullif(regexp_extract(m, '^\\[(?:id|compare):(\\d+)', 1), '') AS pid,
  {_TIDY("regexp_extract(m, '[|:]([^|:]*)[]]$', 1)")} AS note FROM places),
flags AS (SELECT p.*, s.name, kind = 'id' AND s.id IS NOT NULL AND row_number() OVER (PARTITION BY p.msg_id, kind, pid ORDER BY place) = 1 AS opens,
  kind = 'compare' AND s.id IS NOT NULL AND row_number() OVER (PARTITION BY p.msg_id, kind, pid ORDER BY place) = 1 AS item FROM parts p LEFT JOIN said s ON s.msg_id = p.msg_id AND s.id = p.pid),
shown AS (SELECT *, opens AND sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w <= 10 AS shows, kind = 'compare_result' AND sum(CASE WHEN item THEN 1 ELSE 0 END) OVER w >= 2 AS analyses FROM flags WINDOW w AS (PARTITION BY msg_id ORDER BY place)),
words AS (SELECT *, {_TIDY("CASE WHEN shows THEN regexp_replace(before, '\\s*' || name || '[ \\t:;,.—–()-]*$', '') WHEN item OR analyses OR kind = '' THEN before ELSE regexp_replace(before, '(?:(?:^|\\n)(?:[^\\n]*:)?[ \\t]*)+$', '') END")} AS said FROM shown),
blocks AS (SELECT msg_id, place, 0 AS part, 'text' AS type, said AS "text", NULL AS product_id FROM words WHERE said <> ''
  UNION ALL SELECT msg_id, place, 1, CASE WHEN shows THEN 'product' WHEN item THEN 'comparison_item' ELSE 'comparison_analysis' END, CASE WHEN shows THEN NULL ELSE note END, CASE WHEN analyses THEN NULL ELSE pid END FROM words WHERE shows OR item OR analyses),
numbered AS (SELECT msg_id, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY place, part) - 1 AS INTEGER) AS block_no, type, "text", product_id FROM blocks)"""


@query(_BLOCKS + ' SELECT msg_id, block_no, type, "text", product_id FROM numbered')
def h05_content_blocks(spark, sf_dir):
    return chat.content_blocks(_replies(spark, sf_dir))


@query(
    _BLOCKS
    + """, named AS (SELECT n.*, category FROM numbered n LEFT JOIN catalog ON id = product_id),
heads AS (SELECT *, CASE WHEN type IN ('product', 'comparison_item') AND type = lag(type) OVER w AND category = lag(category) OVER w THEN 0 ELSE 1 END AS head FROM named WINDOW w AS (PARTITION BY msg_id ORDER BY block_no)),
islands AS (SELECT *, sum(head) OVER (PARTITION BY msg_id ORDER BY block_no) AS island FROM heads)
SELECT msg_id, min(block_no) AS block_no, CASE type WHEN 'product' THEN 'product_group' WHEN 'comparison_item' THEN 'comparison' ELSE type END AS type, min(category) AS category,
  coalesce(string_agg(product_id, ',' ORDER BY block_no), '') AS products FROM islands GROUP BY msg_id, island, islands.type HAVING islands.type <> 'comparison_item' OR count(*) >= 2"""
)
def h06_grouped_blocks(spark, sf_dir):
    blocks = chat.content_blocks(_replies(spark, sf_dir))
    out = chat.group_blocks(blocks, catalog(spark, sf_dir).select("id", "category"))
    return out.select("msg_id", "block_no", "type", "category", F.array_join("items.product_id", ",").alias("products"))


@query(
    """WITH b AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
i AS (SELECT conv_id, turn, role, sum(CASE WHEN role = p THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM b)
SELECT CAST(conv_id AS VARCHAR) AS msg_id, CAST(min(turn) AS INTEGER) AS block_no, role AS category, count(*) AS n FROM i GROUP BY conv_id, k, role"""
)
def h06_islands(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    blocks = turns.select(F.col("conv_id").cast("string").alias("msg_id"), F.col("turn").cast("int").alias("block_no"), F.lit("product").alias("type"), F.col("role").alias("product_id"), "text")
    roles = turns.select(F.col("role").alias("id"), F.col("role").alias("category")).distinct()
    return chat.group_blocks(blocks, roles).select("msg_id", "block_no", "category", F.size("items").cast("long").alias("n"))


@query(f"WITH {CATALOG} SELECT subcategory || ' ' || ord // 50 AS query_id, string_agg(id || '|' || name || '|' || brand || '|' || CAST(price AS VARCHAR) || '|' || subcategory, chr(10) ORDER BY ord) AS lines  FROM catalog GROUP BY subcategory, ord // 50")
def h08_catalog_lines(spark, sf_dir):
    return chat.catalog_lines(catalog(spark, sf_dir).withColumn("query_id", F.concat_ws(" ", "subcategory", F.floor(F.col("ord") / 50).cast("string"))).withColumn("rank", F.col("ord")))


@query("SELECT doc_id, md5(replace(text, 'example', '***')) AS digest FROM documents")
def h09_scrub(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(chat.scrub(F.col("text"), ["example", "short"])).alias("digest"))


# ---- sources and sinks


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 5 = 0 DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def s09_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return tables.upsert(rows.filter("event_id % 5 <> 0"), rows.filter("event_id % 5 = 0"), ["user_id", "event_type"], "event_id").select("user_id", "event_id")


@query("SELECT count(*) AS n, CAST(sum(r_regionkey) AS BIGINT) AS s FROM region")
def s08_publish(spark, sf_dir):
    rows = table(spark, sf_dir, "region")
    path = f"{_shared(spark)}/published-{tables.uuid.uuid4().hex}"
    tables.publish(rows.limit(1), path)
    tables.publish(rows, path)
    return tables.read_published(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum("r_regionkey").alias("s"))


def _as_json(spark, rows, name, mark=""):
    """The few rows of a dimension as one JSON array in a file of the shared folder."""
    one = rows.agg(F.concat(F.lit(mark), F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns))))).alias("value"))
    path = f"{_shared(spark)}/{name}-{tables.uuid.uuid4().hex}"
    one.coalesce(1).write.text(path)
    return path


def _shared(spark):
    return (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="marlstone-")).rstrip("/")


@query("SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS ord FROM nation")
def s01_json_catalog(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return tables.with_order(tables.read_json(spark, _as_json(spark, rows, "nation"), rows.schema))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT -1, CAST(0 AS VARCHAR)")
def s02_tolerant_json(spark, sf_dir):
    """A file with a byte order mark, and the number of rows of a file that is not there."""
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    found = tables.read_json(spark, _as_json(spark, rows, "region", "\ufeff"), rows.schema)
    missing = tables.read_json(spark, f"{_shared(spark)}/no-such-{tables.uuid.uuid4().hex}", rows.schema)
    counted = missing.agg(F.lit(-1).cast(rows.schema["r_regionkey"].dataType).alias("r_regionkey"), F.count(F.lit(1)).cast("string").alias("r_name"))
    return found.unionByName(counted)


@query(
    """SELECT phrase, kind, id, display FROM (SELECT 'brand' AS kind, 'brand:' || n_nationkey AS id, n_name AS display, unnest([lower(n_name), 'the ' || lower(n_name), '']) AS phrase FROM nation
UNION ALL SELECT 'product_type', 'type:' || r_regionkey, r_name, unnest([lower(r_name), 'the ' || lower(r_name), '']) FROM region) WHERE phrase <> ''"""
)
def s03_dictionary_files(spark, sf_dir):
    """A file of brands and one of types as one alias dictionary."""
    parts = []
    for name, key, kind, prefix in (("nation", "n", "brand", "brand:"), ("region", "r", "product_type", "type:")):
        shown = F.col(f"{key}_name")
        number = F.col(f"{key}_{name}key")
        entities = table(spark, sf_dir, name).select(
            F.concat(F.lit(prefix), number.cast("string")).alias("id"), shown.alias("display"), F.array(F.upper(shown), F.concat(F.lit("The "), shown, F.lit("!")), F.lit("")).alias("aliases"), number.cast("long").alias("ord")
        )
        parts.append(config_rows(tables.read_json(spark, _as_json(spark, entities, name), entities.schema), kind))
    return alias_dictionary(parts[0].unionByName(parts[1])).select("phrase", "kind", "id", "display")


_DIGESTS = """d AS (SELECT CAST('0x' || substr(md5(concat_ws(chr(31), CAST(c_acctbal AS VARCHAR), CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR))), 1, 12) AS BIGINT) AS d
  FROM (SELECT c_custkey, c_name, c_nationkey, CAST(floor(c_acctbal) AS BIGINT) AS c_acctbal FROM customer))"""


@query(
    f"""WITH {_DIGESTS}, f AS (SELECT count(*) AS n, CAST(sum(d) AS VARCHAR) AS s FROM d)
SELECT 'rows' AS what, n, s, true AS same FROM f UNION ALL SELECT 'reordered', n, s, true FROM f UNION ALL SELECT 'repeated', 2 * n, CAST(2 * CAST(s AS HUGEINT) AS VARCHAR), false FROM f"""
)
def s13_fingerprint(spark, sf_dir):
    """Fingerprints of the customers, of the same in another order, and of each customer twice."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.floor("c_acctbal").alias("c_acctbal"))
    prints = {"rows": tables.fingerprint(rows), "reordered": tables.fingerprint(rows.repartition(5, "c_name")), "repeated": tables.fingerprint(rows.union(rows))}
    return spark.createDataFrame([(k, int(p.split("-")[0]), p.split("-")[1], p == prints["rows"]) for k, p in prints.items()], "what string, n long, s string, same boolean")


@query("SELECT page_id, regexp_replace('page ' || page_id || '/x', '[^A-Za-z0-9_-]+', '_', 'g') || '_' || substr(sha256(html), 1, 12) || '.html.gz' AS name FROM pages")
def s10_snapshot_name(spark, sf_dir):
    sku = F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit("/x"))
    return table(spark, sf_dir, "pages").select("page_id", tables.snapshot_name(sku, F.col("html")).alias("name"))


@query(
    f"""WITH {CATALOG}, r AS (SELECT product_type_id, name, sku, row_number() OVER (PARTITION BY product_type_id ORDER BY ord) AS r FROM catalog)
SELECT product_type_id, '## ' || product_type_id || chr(10) || 'Product count: ' || count(*) || chr(10) || 'Examples:' || chr(10) || string_agg(CASE WHEN r <= 8 THEN '- ' || name || ' (SKU: ' || sku || ')' END, chr(10) ORDER BY r) AS "text" FROM r GROUP BY product_type_id"""
)
def s11_type_corpus(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return tables.type_corpus(c, c.select("product_type_id").distinct())


# ---- relational algebra on the star tables


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2 HAVING count(*) > 1")
def x_join_inner(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance")).filter("customers > 1")


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def x_join_left(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def x_join_semi(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def x_join_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def x_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0")
def x_except(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select("s_nationkey"))


@query("SELECT c_nationkey AS k, 'c' AS src FROM customer UNION SELECT s_nationkey, 's' FROM supplier")
def x_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("src")).union(table(spark, sf_dir, "supplier").select("s_nationkey", F.lit("s"))).distinct()


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n, max(l_shipdate) AS latest, bool_and(l_tax >= 0) AS taxed FROM lineitem GROUP BY 1, 2")
def x_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(
        F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("latest"), F.bool_and(F.col("l_tax") >= 0).alias("taxed")
    )


@query("SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS r, nxt FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nxt FROM orders) WHERE r <= 3")
def x_window_topk(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("r"), F.lead("o_orderkey").over(w).alias("nxt")).filter("r <= 3")


@query(f"WITH {CATALOG} SELECT 'shop:' || sku AS source_product_key, name, price FROM catalog WHERE ord % 9 <> 0")
def i17_stream_ingest(spark, sf_dir):
    """Pages in three files through the stream, merged by key into a published table."""
    folder = (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="marlstone-")).rstrip("/")
    base = f"{folder}/stream-{tables.uuid.uuid4().hex}"
    pages = _microdata(spark, sf_dir).withColumn("retrieved_at", F.lit("2024-01-01T00:00:00Z")).withColumn("seq", F.lit(1).cast("long"))
    pages.repartition(3).write.parquet(f"{base}/pages")
    streaming.ingest_stream(spark, f"{base}/pages", f"{base}/table", f"{base}/checkpoint", "shop", 1).awaitTermination()
    return tables.read_published(spark, f"{base}/table").select("source_product_key", "name", "price")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x_event_windows(spark, sf_dir):
    out = streaming.event_windows(table(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


_REPLIES = ((1, "a [id: 12] b [ID:7]"), (2, "[compare:3| good ] [compare_result: so]"), (3, "[id:x] nothing"))


@query("SELECT * FROM (VALUES (1, 0, 'id', '12', NULL), (1, 1, 'id', '7', NULL), (2, 0, 'compare', '3', 'good'), (2, 1, 'compare_result', NULL, 'so')) t(msg_id, place, kind, product_id, \"text\")")
def h03_markers(spark, sf_dir):
    return chat.markers(spark.createDataFrame(list(_REPLIES), "msg_id int, text string"))


@query(f"WITH {CATALOG} SELECT brand_id AS entity_id, count(*) AS n FROM catalog GROUP BY 1")
def s07_index_scan(spark, sf_dir):
    """Entity index written by type and read for one type."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="marlstone-")
    path = f"{folder.rstrip('/')}/index-{tables.uuid.uuid4().hex}"
    c = catalog(spark, sf_dir)
    rows = c.select(F.lit("brand").alias("entity_type"), F.col("brand_id").alias("entity_id")).union(c.select(F.lit("product_type"), "product_type_id"))
    tables.write_index(rows, path)
    return tables.read_index(spark, path, "brand").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
