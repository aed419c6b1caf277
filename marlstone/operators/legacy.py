"""Keyword search, the fallback for queries in which nothing is recognised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import keywords

#: Most queries that are broadcast to the catalogue at once.
BLOCK = 2000


def _points(word: Column, name: Column, brand: Column, sub: Column, category: Column) -> Column:
    heads = name.contains(F.concat(F.lit(" "), word)) | name.startswith(word)
    return (
        F.when(name.contains(word), F.when(heads, 15).otherwise(10)).otherwise(0)
        + F.when(brand.contains(word), F.when(brand == word, 12).otherwise(8)).otherwise(0)
        + F.when(sub.contains(word), 4).otherwise(0)
        + F.when(category.contains(word), 2).otherwise(0)
    )


def keyword_search(queries: DataFrame, catalog: DataFrame, top_k: int = 25) -> DataFrame:
    """Best products of every query (query_id, raw) by summed keyword points, catalogue order among
    equals: (query_id, rank, score, id, ord). Queries without keywords find nothing.

    Substring matches need every query against every product: queries go to the catalogue in
    broadcast blocks of bounded size, and each partition sends on only scored pairs.
    """
    worded = queries.select("query_id", keywords(F.col("raw")).alias("words")).filter(F.size("words") > 0)
    blocks = max(1, -(-worded.count() // BLOCK))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    items = catalog.select("id", "ord", low("name").alias("n"), low("brand").alias("b"), low("subcategory").alias("s"), low("category").alias("g"))
    text = F.concat_ws("\n", "n", "b", "s", "g")

    def block(i: int) -> DataFrame:
        part = worded.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        return items.withColumn("_t", text).join(F.broadcast(part), F.exists("words", lambda w: F.col("_t").contains(w)))

    met = reduce(DataFrame.union, [block(i) for i in range(blocks)])
    score = F.aggregate("words", F.lit(0), lambda a, w: a + _points(w, F.col("n"), F.col("b"), F.col("s"), F.col("g")))
    scored = met.select("query_id", "id", "ord", score.alias("score")).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top_k).select("query_id", "rank", "score", "id", "ord")


def recent_user_text(messages: DataFrame, last: int = 3) -> DataFrame:
    """(conv_id, raw): the last user messages of a conversation that are not blank, in order, joined
    by line ends."""
    said = messages.filter("role = 'user'").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")).filter("text <> ''")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = said.withColumn("_r", rank).filter(F.col("_r") <= last)
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda m: m["text"]), "\n").alias("raw"))
