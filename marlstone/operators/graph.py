"""Complement groups from the approved product-type graph, and checks on the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import casefold, is_blank, plural

# Titles of relations.
TITLES = {
    "PREPARE_WITH": "Для подготовки",
    "LEVEL_WITH": "Для выравнивания",
    "APPLY_WITH": "Для нанесения",
    "PROTECT_WITH": "Для защиты",
    "USE_WITH": "Используется с",
    "FINISH_WITH": "Для финишного слоя",
}
OTHER_TITLE = "Рекомендуется"
STATUSES = ("candidate", "rejected", "approved")


def edge_title(relation: Column, label: Column) -> Column:
    titles = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(titles, relation), F.lit(OTHER_TITLE)), F.lit(": "), plural(label))


def approved_edges(types: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outgoing approved edges of each (query_id, product_type_id), with the target's node if known."""
    out = types.join(edges.filter("review_status = 'approved'"), F.col("product_type_id") == F.col("source"))
    named = out.join(nodes.select(F.col("id").alias("node_id"), "label", "contains_any"), F.col("target") == F.col("node_id"), "left")
    return named.select("query_id", "edge_ord", "target", "relation", "rationale", F.coalesce("label", "target").alias("label"), "contains_any")


def edge_products(edges: DataFrame, catalog: DataFrame, per_edge: int = 4) -> DataFrame:
    """First products, in catalogue order, of each target: (target, id, ord, place).

    A product belongs to a target by its type; one without a type, by a keyword in its subcategory.
    The two halves of the condition are joined apart, so the first stays an equi-join.
    """
    targets = edges.select("target", "contains_any").distinct()
    typed = targets.select("target").distinct().join(catalog, F.col("target") == F.col("product_type_id")).select("target", "id", "ord")
    loose = catalog.filter("coalesce(product_type_id, '') = ''").select("id", "ord", F.lower(F.coalesce("subcategory", F.lit(""))).alias("_s"))
    words = targets.select("target", F.explode("contains_any").alias("word")).select("target", F.lower("word").alias("word")).distinct()
    named = loose.join(F.broadcast(words), F.col("_s").contains(F.col("word"))).select("target", "id", "ord").distinct()
    place = F.row_number().over(Window.partitionBy("target").orderBy("ord"))
    return typed.unionByName(named).withColumn("place", place).filter(F.col("place") <= per_edge)


def complements(types: DataFrame, edges: DataFrame, nodes: DataFrame, catalog: DataFrame, per_edge: int = 4) -> DataFrame:
    """Complement groups: query_id, edge_ord, target, relation, rationale, title, data_gap, products
    (ids in catalogue order). ``edges``: source, relation, target, rationale, review_status, edge_ord;
    ``nodes``: id, label, contains_any."""
    out = approved_edges(types, edges, nodes)
    found = edge_products(out, catalog, per_edge).groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda p: p["id"]).alias("products"))
    joined = out.join(found, "target", "left")
    empty = F.col("products").isNull()
    return joined.select(
        "query_id",
        "edge_ord",
        "target",
        "relation",
        "rationale",
        edge_title(F.col("relation"), F.col("label")).alias("title"),
        empty.alias("data_gap"),
        F.when(empty, F.concat(F.lit("В каталоге пока нет карточек для категории '"), F.col("label"), F.lit("'."))).alias("data_gap_message"),
        F.coalesce("products", F.array().cast("array<string>")).alias("products"),
    )


def neighbourhood(nodes: list[dict], edges: list[dict], words: list[str]) -> tuple[list[str], list[tuple]]:
    """Part of a small graph around some words, in the order of its edges: an edge is in if one of
    its ends is in by then or its relation holds a word, and brings its ends in. The order matters,
    so this walks the configuration on the driver; graphs are a few dozen edges."""
    folded = [w.casefold() for w in words if w.strip()]
    inside = {n["id"] for n in nodes if any(w in f"{n['id']} {n.get('label', '')}".casefold() for w in folded)}
    taken = []
    for e in edges:
        ends = {e["source"], e["target"]}
        if ends & inside or any(w in e["relation"].casefold() for w in folded):
            taken.append((e["source"], e["relation"], e["target"]))
            inside |= ends
    return sorted(inside & {n["id"] for n in nodes}), sorted(taken)


def missing_edges(required: DataFrame, edges: DataFrame) -> DataFrame:
    """Required (case_id, source, relation, target) that the graph does not have."""
    return required.join(edges.select("source", "relation", "target"), ["source", "relation", "target"], "left_anti")


def forbidden_nodes(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(case_id, id) of nodes that begin with a forbidden prefix (case_id, prefix)."""
    return nodes.join(F.broadcast(prefixes), F.col("id").startswith(F.col("prefix"))).select("case_id", "id").distinct()


def selector_counts(nodes: DataFrame, catalog: DataFrame, fields: tuple[str, ...] = ("name", "brand", "category", "subcategory")) -> DataFrame:
    """(id, products): catalogue rows in which a node's selector field holds one of its words."""
    words = nodes.filter(F.col("field").isin(*fields)).select("id", "field", F.transform("contains_any", casefold).alias("words"))
    rows = reduce(DataFrame.union, [catalog.select(F.lit(f).alias("field"), casefold(F.coalesce(F.col(f), F.lit(""))).alias("text")) for f in fields])
    counts = rows.groupBy("field", "text").agg(F.count(F.lit(1)).alias("n"))
    met = counts.alias("t").join(F.broadcast(words.alias("w")), (F.col("t.field") == F.col("w.field")) & F.exists("w.words", lambda w: F.col("t.text").contains(w)))
    sums = met.groupBy("id").agg(F.sum("n").alias("products"))
    return nodes.select("id").join(sums, "id", "left").fillna({"products": 0})


def graph_errors(nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...], published: bool = False) -> DataFrame:
    """Every violation of the graph's rules: (code, detail)."""
    say = lambda df, code, *parts: df.select(F.lit(code).alias("code"), F.concat_ws(" ", *parts).alias("detail"))
    named = edges.select("*", F.concat_ws(" ", "source", "relation", "target").alias("edge"))
    ends = named.select("edge", F.explode(F.array("source", "target")).alias("id"))
    found = [
        say(nodes.groupBy("id").count().filter("count > 1"), "duplicate_node", "id"),
        say(nodes.filter(is_blank(F.col("id")) | is_blank(F.col("label"))), "invalid_node", "id", "label"),
        say(ends.join(nodes.select("id"), "id", "left_anti").select("edge").distinct(), "dangling_endpoint", "edge"),
        say(named.filter(~F.coalesce(F.col("relation").isin(*relations), F.lit(False))), "unsupported_relation", "edge"),
        say(named.groupBy("edge").count().filter("count > 1"), "duplicate_edge", "edge"),
        say(named.filter(is_blank(F.col("rationale"))), "no_rationale", "edge"),
        say(named.filter(F.coalesce(F.size("provenance"), F.lit(0)) <= 0), "no_provenance", "edge"),
        say(named.filter(~F.coalesce(F.col("review_status").isin(*STATUSES), F.lit(False))), "invalid_status", "edge"),
    ]
    if published:
        found.append(say(named.filter(~F.coalesce(F.col("review_status") == "approved", F.lit(False))), "not_approved", "edge"))
    return reduce(DataFrame.union, found)


def review_errors(results: DataFrame, expected: DataFrame, status: str) -> DataFrame:
    """Errors of a review report (case_id, verdict, summary, n_evidence): case sets that differ,
    repeated cases, bad verdicts, empty summaries, passes without evidence, and a status that is not
    the gravest verdict."""
    verdicts = ("PASS", "REVIEW", "FAIL")
    valid = F.coalesce(F.col("verdict").isin(*verdicts), F.lit(False))
    gravest = results.filter(valid).agg(
        F.when(F.bool_or(F.col("verdict") == "FAIL"), "FAIL").when(F.bool_or(F.col("verdict") == "REVIEW"), "REVIEW").when(F.count(F.lit(1)) > 0, "PASS").alias("verdict")
    )
    say = lambda df, code, c: df.select(F.lit(code).alias("code"), F.col(c).cast("string").alias("detail"))
    return reduce(
        DataFrame.union,
        [
            say(expected.join(results, "case_id", "left_anti"), "missing_case", "case_id"),
            say(results.join(expected, "case_id", "left_anti"), "unexpected_case", "case_id"),
            say(results.groupBy("case_id").count().filter("count > 1"), "duplicate_case", "case_id"),
            say(results.filter(~valid), "bad_verdict", "case_id"),
            say(results.filter(is_blank(F.col("summary"))), "empty_summary", "case_id"),
            say(results.filter((F.col("verdict") == "PASS") & (F.coalesce("n_evidence", F.lit(0)) == 0)), "no_evidence", "case_id"),
            say(gravest.filter(F.col("verdict") != status), "wrong_status", "verdict"),
        ],
    )
