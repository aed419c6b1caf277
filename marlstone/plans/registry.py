"""Registry of queries over the driver tables, and the views that map those tables to the model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.aliases import ALIAS_SCHEMA, alias_dictionary
from marlstone.operators.parse import parse_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with equivalent SQL where there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The catalogue as a view of ``part``: names are an adjective and a noun; the noun is the type.
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    nothing = F.lit(None).cast("string")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_partkey").alias("ord"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.concat(F.lit("brand:"), F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("brand_id"),
        F.col("p_type").alias("category"),
        words[1].alias("subcategory"),
        F.concat(F.lit("type:"), words[1]).alias("product_type_id"),
        F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
        F.col("p_retailprice").alias("price"),
        F.struct(
            F.col("p_size").cast("double").alias("weight_kg"), F.lit(None).cast("double").alias("volume_l"), nothing.alias("surface"),
            nothing.alias("moisture"), words[0].alias("finish"), nothing.alias("properties"), nothing.alias("color"),
        ).alias("attributes"),
    )


CATALOG = """catalog AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS ord, p_name AS name, p_brand AS brand,
    'brand:' || replace(p_brand, 'Brand#', '') AS brand_id, p_type AS category, split_part(p_name, ' ', 2) AS subcategory,
    'type:' || split_part(p_name, ' ', 2) AS product_type_id, 'SKU-' || CAST(p_partkey AS VARCHAR) AS sku,
    p_retailprice AS price, CAST(p_size AS DOUBLE) AS weight_kg, split_part(p_name, ' ', 1) AS finish
  FROM part)"""

# Dimensions that both engines get as literal rows.
TYPES = ("ring", "bolt", "anvil", "gear", "gizmo", "plate", "rod", "widget")
FINISHES = ("red", "blue", "large", "new", "cold", "small", "hot", "old")
ALIASES = (
    [("product_type", f"type:{t}", t, a, 10 * i + j) for i, t in enumerate(TYPES) for j, a in enumerate((t, f"{t}s"))]
    + [("brand", f"brand:{i}", f"Brand#{i}", f"brand {i}", i) for i in range(1, 26)]
    + [("attribute", "finish", f, f, i) for i, f in enumerate(FINISHES)]
)
ASKED = (
    (1, "red widget brand#13 20 kg"),
    (2, "Brand 13 WIDGETS, red"),
    (3, "widget brand#99"),
    (4, "gear 7kg brand#5"),
    (5, "hot bolt"),
    (6, "brand#7 anvil 1000 kg"),
    (7, "rods"),
    (8, "brand 21"),
    (9, "nothing here is known"),
    (10, ""),
    (11, "blue red plate 3,5 l extra plate"),
    (12, "old old gizmo gizmo brand#2 brand#3"),
)


def values(rows, columns: str) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(text(v) for v in r) + ')' for r in rows)}) AS v({columns})"


def dictionary(spark: SparkSession) -> DataFrame:
    return alias_dictionary(spark.createDataFrame(list(ALIASES), ALIAS_SCHEMA))


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ASKED), "query_id long, raw string")


def parsed(spark: SparkSession) -> DataFrame:
    return parse_queries(asked(spark), dictionary(spark))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a query: its name, brand and size as a customer might write them."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("query_id"), F.concat("p_name", F.lit(", "), "p_brand", F.lit(" "), F.col("p_size").cast("string"), F.lit("kg new offer")).alias("raw")
    )


OFFERS = "asked AS (SELECT p_partkey AS query_id, p_name || ', ' || p_brand || ' ' || CAST(p_size AS VARCHAR) || 'kg new offer' AS raw FROM part)"
ASKED_SQL = f"asked AS (SELECT * FROM {values(ASKED, 'query_id, raw')})"


def parse_sql(source: str) -> str:
    """CTEs from ``asked`` (query_id, raw) to ``parsed``, one for each step of the parser."""
    return f"""WITH {source},
dict AS (SELECT phrase, kind, id, display FROM (
  SELECT alias AS phrase, kind, id, display, row_number() OVER (PARTITION BY alias ORDER BY
    CASE kind WHEN 'product_type' THEN 1 WHEN 'brand' THEN 2 ELSE 3 END DESC, ord DESC) AS r
  FROM {values(ALIASES, "kind, id, display, alias, ord")}) WHERE r = 1),
norm AS (SELECT query_id, raw, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw),
    '(\\d+),(\\d*)(\\s*(?:kg|l)\\b)', '\\1.\\2\\3', 'g'), '(\\d+\\.?\\d*)\\s*(kg|l)\\b', '\\1 \\2', 'g'),
    '[^a-z0-9_\\s.]', ' ', 'g'), '\\s+', ' ', 'g')) AS normalized FROM asked),
toks AS (SELECT query_id, raw, normalized, list_filter(string_split(normalized, ' '), lambda t: t <> '') AS tokens FROM norm),
starts AS (SELECT query_id, tokens, unnest(range(0, len(tokens))) AS start FROM toks),
grams AS (SELECT query_id, start, n, array_to_string(list_slice(tokens, start + 1, start + n), ' ') AS phrase
  FROM starts, (VALUES (1), (2)) l(n) WHERE start + n <= len(tokens)),
matched AS (SELECT * FROM (SELECT query_id, start, start + n AS stop, kind, id, display,
    row_number() OVER (PARTITION BY query_id, start ORDER BY n DESC) AS r FROM grams JOIN dict USING (phrase)) WHERE r = 1),
won AS (SELECT * FROM (SELECT query_id, start, stop, kind, id, display,
    row_number() OVER (PARTITION BY query_id, kind, CASE WHEN kind = 'attribute' THEN id END ORDER BY start) AS s FROM matched) WHERE s = 1),
slots AS (SELECT query_id, max(CASE WHEN kind = 'product_type' THEN id END) AS product_type_id,
    max(CASE WHEN kind = 'product_type' THEN display END) AS product_type_display,
    max(CASE WHEN kind = 'brand' THEN id END) AS brand_id, max(CASE WHEN kind = 'brand' THEN display END) AS brand_display,
    max(CASE WHEN kind = 'attribute' THEN display END) AS finish FROM won GROUP BY query_id),
amounts AS (SELECT query_id, regexp_extract(normalized, '\\b(\\d+(?:[.,]\\d+)?)\\s*(kg)\\b', 1) AS w,
    regexp_extract(normalized, '\\b(\\d+(?:[.,]\\d+)?)\\s*(l)\\b', 1) AS v FROM toks),
gone AS (SELECT query_id, t FROM (SELECT w.query_id, unnest(list_slice(tokens, start + 1, stop)) AS t FROM won w JOIN toks USING (query_id))
  UNION SELECT query_id, unnest([w, 'kg']) FROM amounts WHERE w <> '' UNION SELECT query_id, unnest([v, 'l']) FROM amounts WHERE v <> ''),
residual AS (SELECT query_id, i, t FROM (SELECT query_id, unnest(tokens) AS t, unnest(range(0, len(tokens))) AS i FROM toks) x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.query_id = x.query_id AND g.t = x.t)),
rest AS (SELECT query_id, string_agg(t, ' ' ORDER BY i) AS residual FROM residual GROUP BY query_id),
parsed AS (SELECT q.query_id, q.normalized, product_type_id, product_type_display, brand_id, brand_display, finish,
    TRY_CAST(replace(nullif(w, ''), ',', '.') AS DOUBLE) AS weight_kg, TRY_CAST(replace(nullif(v, ''), ',', '.') AS DOUBLE) AS volume_l,
    coalesce(residual, '') AS residual
  FROM toks q JOIN amounts USING (query_id) LEFT JOIN slots USING (query_id) LEFT JOIN rest USING (query_id))"""
