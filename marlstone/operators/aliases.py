"""Alias dictionary and set-based phrase matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import normalize_text, tokens

#: Order in which kinds enter the dictionary; of equal phrases the last entry counts.
KINDS = ("product_type", "brand", "attribute")

ALIAS_SCHEMA = "kind string, id string, display string, alias string, ord long"


def taxonomy_rows(attributes: DataFrame) -> DataFrame:
    """Attribute taxonomy (key, display, values[value, display, aliases]) as alias rows."""
    values = attributes.select("key", F.posexplode("values").alias("_v", "value"), F.monotonically_increasing_id().alias("_k"))
    each = values.select("key", "_k", "_v", F.col("value.value").alias("display"), F.posexplode("value.aliases").alias("_a", "alias"))
    return each.select(
        F.lit("attribute").alias("kind"), F.col("key").alias("id"), "display", "alias", F.row_number().over(Window.orderBy("_k", "_v", "_a")).cast("long").alias("ord")
    )


def config_rows(entities: DataFrame, kind: str) -> DataFrame:
    """Brands or product types (id, display, aliases, ord) as alias rows."""
    each = entities.select("id", "display", "ord", F.posexplode("aliases").alias("_a", "alias"))
    return each.select(F.lit(kind).alias("kind"), "id", "display", "alias", (F.col("ord") * 1000 - F.length("alias")).cast("long").alias("ord"))


def alias_dictionary(aliases: DataFrame) -> DataFrame:
    """One entry a normalised phrase: (phrase, n, kind, id, display).

    ``aliases``: rows of ALIAS_SCHEMA. Kinds go in as in :data:`KINDS`, within a kind by ``ord``; a
    phrase that comes again replaces the one before.
    """
    phrase = normalize_text(F.col("alias"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    entries = aliases.withColumn("phrase", phrase).filter("phrase <> ''").withColumn("_seq", F.struct(rank.alias("k"), F.col("ord")))
    last = entries.groupBy("phrase").agg(F.max_by(F.struct("kind", "id", "display"), "_seq").alias("e"))
    return last.select("phrase", F.size(tokens(F.col("phrase"))).alias("n"), "e.*")


def match_phrases(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Longest dictionary phrase from every start: (query_id, start, end, kind, id, display).

    ``queries``: query_id and tokens. Matches of different starts may overlap. The n-grams of all
    lengths that the dictionary has meet it in one equi-join; dictionaries small enough are broadcast
    by the planner.
    """
    lengths = F.broadcast(dictionary.agg(F.collect_set("n").alias("_lengths")))  # one row
    spans = queries.select("query_id", F.col("tokens"), F.posexplode("tokens").alias("start", "_t")).join(lengths)
    fitting = F.filter("_lengths", lambda n: n <= F.size("tokens") - F.col("start"))
    grams = spans.select("query_id", "start", F.explode(fitting).alias("n"), "tokens").select(
        "query_id", "start", "n", F.array_join(F.slice("tokens", F.col("start") + 1, F.col("n")), " ").alias("phrase")
    )
    met = grams.join(dictionary, ["phrase", "n"])
    best = met.groupBy("query_id", "start").agg(F.max_by(F.struct("n", "kind", "id", "display"), "n").alias("m"))
    return best.select("query_id", "start", (F.col("start") + F.col("m.n")).alias("end"), "m.kind", "m.id", "m.display")
