"""Resolver, search, keyword search and graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import graph, legacy, resolve, respond, search
from marlstone.operators.index import unit_vector
from marlstone.operators.parse import parse_queries
from marlstone.plans.engine import Engine
from marlstone.plans.registry import ASKED_SQL, CATALOG, asked, catalog, dictionary, parse_sql, parsed, query, table, values

# ---- resolver: a span is a vector of ``embeddings``, an entity its label, a phrase its id


def _spans(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("span_id"), F.lit("brand").alias("entity_type"), F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("text"), F.col("embedding").alias("vector"))


def _index(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    label = F.concat(F.lit("brand:"), F.col("label").cast("string"))
    return v.select(
        F.lit("brand").alias("entity_type"), label.alias("entity_id"), label.alias("display"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("normalized_phrase"),
        F.lit(1).alias("trusted"), F.col("embedding").alias("vector"), F.col("vec_id"),
    )


def _met(spark, sf_dir):
    """Every span with every vector of the index but its own."""
    s, x = _spans(spark, sf_dir).alias("s"), _index(spark, sf_dir).alias("x")
    return s.join(x, (F.col("s.entity_type") == F.col("x.entity_type")) & (F.col("span_id") != F.col("vec_id")))


_PAIRS = """s AS (SELECT vec_id AS span_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
x AS (SELECT vec_id, 'brand:' || label AS entity_id, embedding FROM embeddings),
pairs AS (SELECT span_id, x.vec_id, entity_id, greatest(0.0, least(1.0, list_dot_product(CAST(s.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])))) AS e FROM s JOIN x ON span_id <> vec_id)"""


@query(f"WITH {_PAIRS} SELECT span_id, vec_id, round(e, 4) AS e FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY round(e, 9) DESC, vec_id) AS r FROM pairs) WHERE r <= 5")
def r03_cosine_topk(spark, sf_dir):
    scored = _met(spark, sf_dir).select("span_id", "vec_id", resolve.vector_score(F.col("s.vector"), F.col("x.vector")).alias("e"))
    rank = F.row_number().over(Window.partitionBy("span_id").orderBy(F.desc(F.round("e", 9)), "vec_id"))
    return scored.withColumn("r", rank).filter("r <= 5").select("span_id", "vec_id", F.round("e", 4).alias("e"))


def _scored(spark, sf_dir):
    e = F.round(resolve.vector_score(F.col("s.vector"), F.col("x.vector")), 6)
    zero = F.lit(0.0)
    return _met(spark, sf_dir).select(
        "span_id", "entity_id", "display", "normalized_phrase", F.lit(True).alias("trusted"), e.alias("score"), e.alias("embedding_score"), zero.alias("character_score"), zero.alias("transliteration_score")
    )


_BEST = f"""{_PAIRS}, best AS (SELECT span_id, entity_id, max(round(e, 6)) AS score FROM pairs GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY score DESC, entity_id) AS r, lead(score) OVER (PARTITION BY span_id ORDER BY score DESC, entity_id) AS nxt FROM best),
top AS (SELECT span_id, entity_id, score, round(greatest(0.0, score - coalesce(nxt, 0.0)), 6) AS margin FROM ranked WHERE r = 1)"""


@query(f"WITH {_BEST} SELECT span_id, entity_id, round(score, 4) AS score FROM best")
def r08_max_per_entity(spark, sf_dir):
    return resolve.best_per_entity(_scored(spark, sf_dir)).select("span_id", "entity_id", F.round("score", 4).alias("score"))


@query(f"WITH {_BEST} SELECT span_id, entity_id, round(score, 4) AS score, round(margin, 4) AS margin FROM top")
def r10_margin(spark, sf_dir):
    return resolve.rank_entities(resolve.best_per_entity(_scored(spark, sf_dir))).select("span_id", "entity_id", F.round("score", 4).alias("score"), F.round("margin", 4).alias("margin"))


@query(
    f"""WITH {_BEST} SELECT span_id, CASE WHEN score >= 0.5 AND margin >= 0.05 THEN 'resolved' WHEN score >= 0.5 THEN 'ambiguous' ELSE 'suggestion' END AS status,
CASE WHEN score >= 0.5 AND margin >= 0.05 THEN 'score_and_margin_passed' WHEN score >= 0.5 THEN 'margin_below_threshold' ELSE 'auto_resolution_gate_not_passed' END AS reason FROM top"""
)
def r11_decision(spark, sf_dir):
    ranked = resolve.rank_entities(resolve.best_per_entity(_scored(spark, sf_dir)))
    status, reason = resolve.decide(F.col("score"), F.col("margin"), F.col("trusted"), F.lit(0.5), F.lit(0.05), F.lit(True))
    return ranked.select("span_id", status.alias("status"), reason.alias("reason"))


@query()
def r07_resolve(spark, sf_dir):
    """Every span against every vector, its own included."""
    out = resolve.resolve_spans(_spans(spark, sf_dir), _index(spark, sf_dir))
    return out.select("span_id", "status", "entity_id", "score", "margin", "reason", F.size("candidates").alias("n_candidates"))


_LOOKUP = ((1, "product_name", "red widget"), (2, "product_name", "hot hot"), (3, "brand", "brand 7"), (4, "product_type", "rings"), (5, "product_type", "brand 7"))


@query(
    f"""WITH {CATALOG}, idx AS (SELECT 'product_name' AS entity_type, id AS entity_id, name AS display, name AS phrase FROM catalog
  UNION SELECT 'brand', brand_id, brand, replace(brand_id, ':', ' ') FROM catalog UNION SELECT 'product_type', product_type_id, subcategory, subcategory || 's' FROM catalog),
hit AS (SELECT span_id, entity_id, display, row_number() OVER (PARTITION BY span_id ORDER BY entity_id) AS r FROM {values(_LOOKUP, "span_id, entity_type, txt")} JOIN idx ON idx.entity_type = v.entity_type AND idx.phrase = v.txt)
SELECT span_id, min(entity_id) AS entity_id, min(display) AS display FROM (SELECT DISTINCT span_id, entity_id, display FROM hit WHERE r <= 2) GROUP BY span_id HAVING count(*) = 1"""
)
def r02_exact_lookup(spark, sf_dir):
    c = catalog(spark, sf_dir)
    kinds = [("product_name", "id", "name", F.col("name")), ("brand", "brand_id", "brand", F.replace("brand_id", F.lit(":"), F.lit(" "))), ("product_type", "product_type_id", "subcategory", F.concat("subcategory", F.lit("s")))]
    parts = [c.select(F.lit(k).alias("entity_type"), F.col(i).alias("entity_id"), F.col(d).alias("display"), p.alias("normalized_phrase"), F.lit(1).alias("trusted")).distinct() for k, i, d, p in kinds]
    spans = spark.createDataFrame(list(_LOOKUP), "span_id long, entity_type string, phrase string")
    return resolve.exact_hits(spans, parts[0].union(parts[1]).union(parts[2]))


@query("SELECT doc_id, n FROM (SELECT doc_id, len(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: length(t) >= 3 AND regexp_matches(t, '\\p{L}'))) AS n FROM documents)")
def r13_candidate_tokens(spark, sf_dir):
    words = F.split(F.lower("text"), r"\s+")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(resolve.candidate_tokens(words)).cast("long").alias("n"))


@query(f"WITH {CATALOG}, k AS (SELECT 'brand:' || b AS entity_id, 'type:' || t AS product_type_id FROM range(1, 31) r(b), (VALUES ('ring'), ('bolt'), ('none')) v(t)) SELECT * FROM k WHERE EXISTS (SELECT 1 FROM catalog c WHERE c.brand_id = k.entity_id AND c.product_type_id = k.product_type_id)")
def r14_availability(spark, sf_dir):
    k = spark.createDataFrame([(f"brand:{b}", f"type:{t}") for b in range(1, 31) for t in ("ring", "bolt", "none")], "entity_id string, product_type_id string")
    return resolve.available(k, catalog(spark, sf_dir), "brand", ["product_type_id"])


_TYPED = ((1, "widgett brand 13"), (2, "blot red shiny"), (3, "ankil brand#7"), (4, "red widgett branf13"), (5, "gear"))


@query()
def r17_route(spark, sf_dir):
    """Misspelt tokens routed to types; vectors of letter pairs stand in for an embedding model."""

    asked_ = spark.createDataFrame([(str(i), t) for i, t in _TYPED], "query_id string, raw string")
    slots = parse_queries(asked_, dictionary(spark))

    def vector(word):
        return F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.length(word).cast("double") - F.length(F.replace(word, F.char(i + 97), F.lit(""))))

    from marlstone.plans.text_queries import _phrases

    index = _phrases(spark, sf_dir).withColumn("vector", vector(F.col("normalized_phrase")))

    index = index.withColumn("vector", unit_vector(F.col("vector")))
    spans = resolve.route_spans(slots).withColumn("span_id", F.xxhash64("query_id", "text", "entity_type")).withColumn("vector", unit_vector(vector(F.col("text"))))
    spans = spans.dropDuplicates(["span_id"])
    found = resolve.resolve_spans(spans.select("span_id", "entity_type", "text", "vector"), index).join(spans.select("span_id", "query_id"), "span_id")
    routed = resolve.route(slots, found, catalog(spark, sf_dir))
    return routed.select("query_id", "brand_id", "product_type_id", "product_id", F.array_join("unparsed_tokens", " ").alias("residual"), "resolver_status")


@query(
    f"""WITH {CATALOG}, r AS (SELECT *, ord % 4 AS how, ord % 3 = 0 AS wrong FROM catalog),
c AS (SELECT *, CASE WHEN how = 0 THEN NULL WHEN wrong THEN 'brand:0' ELSE brand_id END AS expected,
  CASE how WHEN 0 THEN 'suggestion' WHEN 1 THEN 'exact' WHEN 2 THEN 'resolved' END AS status FROM r)
SELECT count(*) AS cases, count(*) FILTER (status IN ('exact', 'suggestion') AND (expected IS NULL OR expected = brand_id)) AS passed,
  count(*) FILTER (status IN ('exact', 'resolved') AND wrong) AS false_filters FROM c"""
)
def r20_evaluate(spark, sf_dir):
    """Cases made of the catalogue: a quarter has no result, a third expects another brand."""
    how, wrong = F.col("ord") % 4, F.col("ord") % 3 == 0
    c = catalog(spark, sf_dir).withColumn("case_id", F.col("id"))
    expected = F.when(how == 0, F.lit(None)).when(wrong, F.lit("brand:0")).otherwise(F.col("brand_id"))
    cases = c.select("case_id", expected.alias("expected_entity_id"), F.array(F.lit("exact"), F.lit("suggestion")).alias("allowed_statuses"), (~wrong).alias("hard_filter_allowed"))
    status = F.when(how == 0, "suggestion").when(how == 1, "exact").otherwise("resolved")
    results = c.filter(how < 3).select("case_id", status.alias("status"), F.col("brand_id").alias("entity_id"))
    return resolve.evaluate(cases, results)


# ---- search

_SEARCH = (
    parse_sql(ASKED_SQL)
    + f""", {CATALOG}, fits AS (
  SELECT q.query_id, c.id, c.ord, c.name, c.category, c.weight_kg, c.finish, q.weight_kg AS want_kg, q.finish AS want_finish, q.product_type_display, q.residual,
    CASE WHEN (q.brand_id IS NULL OR c.brand_id = q.brand_id) AND (q.product_type_id IS NULL OR c.product_type_id = q.product_type_id)
        AND (q.weight_kg IS NULL OR c.weight_kg = q.weight_kg) THEN 1
      WHEN q.brand_id IS NOT NULL AND q.product_type_id IS NOT NULL AND c.brand_id = q.brand_id THEN 2
      WHEN q.brand_id IS NOT NULL AND q.product_type_id IS NOT NULL AND c.product_type_id = q.product_type_id THEN 3 END AS tier
  FROM parsed q JOIN catalog c ON q.brand_id IS NOT NULL OR q.product_type_id IS NOT NULL),
tiered AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM fits WHERE tier IS NOT NULL),
kept AS (SELECT *, max(CASE WHEN weight_kg = want_kg THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS any_same FROM tiered WHERE tier = best),
narrowed AS (SELECT * FROM kept WHERE any_same = 0 OR weight_kg = want_kg),
scored AS (SELECT *, CASE WHEN product_type_display IS NOT NULL AND contains(lower(name), lower(product_type_display)) THEN
      CASE WHEN starts_with(lower(name), lower(product_type_display)) THEN 250 ELSE 100 END ELSE 0 END
    + CASE WHEN want_finish IS NULL THEN 0 WHEN finish = want_finish THEN 50 WHEN contains(lower(name), want_finish) THEN 30 ELSE 0 END
    + 5 * len(list_filter(string_split(residual, ' '), lambda t: t <> '' AND contains(lower(name), t))) AS score FROM narrowed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank, want_finish IS NOT NULL AND max(score) OVER (PARTITION BY query_id) < 30 AS attribute_relaxed FROM scored)"""
)


def _matched(spark, sf_dir, relax=True):
    return search.match_products(parsed(spark), catalog(spark, sf_dir), relax)


@query(_SEARCH + " SELECT query_id, id FROM fits WHERE tier = 1")
def p01_hard_filter(spark, sf_dir):
    return _matched(spark, sf_dir, False).select("q.query_id", "c.id")


@query(_SEARCH + " SELECT query_id, id, tier FROM tiered WHERE tier = best")
def p03_relax(spark, sf_dir):
    return _matched(spark, sf_dir).select("q.query_id", "c.id", "tier")


@query(_SEARCH + " SELECT query_id, id FROM narrowed")
def p04_narrow(spark, sf_dir):
    return search.narrow_amounts(_matched(spark, sf_dir)).select("q.query_id", "c.id")


@query(_SEARCH + " SELECT query_id, id, CAST(score AS INTEGER) AS score FROM scored")
def p05_score(spark, sf_dir):
    return search.narrow_amounts(_matched(spark, sf_dir)).select("q.query_id", "c.id", search.relevance().alias("score"))


@query(_SEARCH + " SELECT query_id, rank, CAST(score AS INTEGER) AS score, tier, attribute_relaxed, id FROM ranked WHERE rank <= 25")
def p06_topk(spark, sf_dir):
    out = search.search(parsed(spark), catalog(spark, sf_dir))
    return out.select("query_id", "rank", "score", "tier", "attribute_relaxed", "c.id")


@query(
    parse_sql(ASKED_SQL)
    + " SELECT query_id, CASE WHEN product_type_display IS NOT NULL THEN 'Найденные ' || product_type_display || 'ы' ELSE 'Найденные товары' END || coalesce(' ' || brand_display, '') AS title FROM parsed WHERE product_type_id IS NOT NULL OR brand_id IS NOT NULL"
)
def p08_title(spark, sf_dir):
    return search.primary_title(parsed(spark).filter("product_type_id IS NOT NULL OR brand_id IS NOT NULL"))


# An address of the shop and five that are not, by the part's number.
_HOSTS = ("https://shop.example/", "https://www.shop.example/", "http://shop.example/", "https://shop.example.evil.example/", "https://user@evil.example/", "https://SHOP.example/")
_FOLDERS = ("catalog/", "news/", "catalog//", "", "Catalog/")
_ADDRESS = f"""addresses AS (SELECT p_partkey, CASE p_partkey % {len(_HOSTS) + 1} {" ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HOSTS))} END AS host,
  CASE p_partkey % {len(_FOLDERS)} {" ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FOLDERS))} END AS folder,
  CASE WHEN p_partkey % 4 = 0 THEN replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '.') END AS last FROM part)"""


def _addresses(spark, sf_dir):
    n = F.col("p_partkey")
    pick = lambda choices: F.get(F.array(*[F.lit(c) for c in choices]), (n % len(choices)).cast("int"))
    host = F.get(F.array(*[F.lit(h) for h in _HOSTS]), (n % (len(_HOSTS) + 1)).cast("int"))
    last = F.replace("p_name", F.lit(" "), F.when(n % 4 == 0, "_").otherwise("."))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(host, pick(_FOLDERS), last, F.lit("/x1/")).alias("url"))


@query(f"WITH {_ADDRESS} SELECT p_partkey, CASE WHEN p_partkey % 7 IN (0, 1, 5) THEN host || folder || last || '/x1/' ELSE '' END AS url FROM addresses")
def p11_safe_url(spark, sf_dir):
    return _addresses(spark, sf_dir).select("p_partkey", respond.safe_url(F.col("url")).alias("url"))


@query(f"WITH {_ADDRESS} SELECT p_partkey, CASE WHEN p_partkey % 7 IN (0, 1, 5) AND starts_with(folder, 'catalog/') AND p_partkey % 4 = 0 THEN 'https://shop.example/catalog/' || last || '/' ELSE '' END AS category_url FROM addresses")
def p12_category_url(spark, sf_dir):
    return _addresses(spark, sf_dir).select("p_partkey", respond.category_url(F.col("url")).alias("category_url"))


@query()
def p13_response(spark, sf_dir):

    c = catalog(spark, sf_dir)
    p = parsed(spark)
    primary = search.search(p, c, 5)
    groups = graph.complements(search.complement_types(p, primary), _edges(spark), _nodes(spark), c)
    fallback = legacy.keyword_search(asked(spark), c, 5)
    return respond.responses(p, primary, groups, fallback, c)


# ---- keyword search


@query(
    f"""WITH {CATALOG}, {ASKED_SQL}, k AS (SELECT query_id, unnest(list_filter(regexp_extract_all(lower(raw), '[a-zA-Z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ('the', 'a', 'an', 'and', 'or', 'to', 'for'))) AS w FROM asked),
s AS (SELECT query_id, id, ord, sum(CASE WHEN contains(name, w) THEN 10 + CASE WHEN contains(name, ' ' || w) OR starts_with(name, w) THEN 5 ELSE 0 END ELSE 0 END
  + CASE WHEN contains(lower(brand), w) THEN 8 + CASE WHEN lower(brand) = w THEN 4 ELSE 0 END ELSE 0 END
  + CASE WHEN contains(subcategory, w) THEN 4 ELSE 0 END + CASE WHEN contains(lower(category), w) THEN 2 ELSE 0 END) AS score FROM k, catalog GROUP BY 1, 2, 3)
SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(score AS INTEGER) AS score, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM s WHERE score > 0) WHERE rank <= 25"""
)
def l02_keyword_topk(spark, sf_dir):
    return legacy.keyword_search(asked(spark), catalog(spark, sf_dir)).select("query_id", "rank", "score", "id")


@query(
    """SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) AS raw FROM (SELECT conv_id, turn, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations WHERE role = 'user') WHERE t <> '') WHERE r <= 3 GROUP BY conv_id"""
)
def l03_last3_turns(spark, sf_dir):
    return legacy.recent_user_text(table(spark, sf_dir, "conversations"))


# ---- graph: literal edges over the catalogue's types

_EDGES = (
    ("type:widget", "PREPARE_WITH", "type:gear", "a", "approved", 1),
    ("type:widget", "APPLY_WITH", "type:rod", "b", "approved", 2),
    ("type:widget", "FASTEN_WITH", "type:missing", "c", "approved", 3),
    ("type:bolt", "USE_WITH", "type:anvil", "d", "approved", 4),
    ("type:bolt", "USE_WITH", "type:loose", "e", "approved", 5),
    ("type:gear", "FINISH_WITH", "type:widget", "f", "candidate", 6),
    ("type:rod", "PROTECT_WITH", "type:plate", "g", "approved", 7),
    ("type:anvil", "LEVEL_WITH", "type:bolt", "", "approved", 8),
    ("type:plate", "UNKNOWN", "type:ring", "h", "approved", 9),
    ("type:ring", "USE_WITH", "type:nowhere", "i", "approved", 10),
)
_NODES = tuple((f"type:{t}", t, "subcategory", t) for t in ("widget", "gear", "rod", "bolt", "anvil", "plate", "ring")) + (("type:missing", "missing", "subcategory", "zzz"), ("type:loose", "ringка", "subcategory", "ring"))
_RELATIONS = ("PREPARE_WITH", "LEVEL_WITH", "APPLY_WITH", "PROTECT_WITH", "USE_WITH", "FINISH_WITH")


def _edges(spark):
    e = spark.createDataFrame(list(_EDGES), "source string, relation string, target string, rationale string, review_status string, edge_ord int")
    return e.withColumn("provenance", F.when(F.col("edge_ord") == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("doc"))))


def _nodes(spark):
    n = spark.createDataFrame(list(_NODES), "id string, label string, field string, w string")
    return n.withColumn("contains_any", F.array("w")).drop("w")


_GRAPH = f"""edges AS (SELECT * FROM {values(_EDGES, "source, relation, target, rationale, review_status, edge_ord")}), nodes AS (SELECT * FROM {values(_NODES, "id, label, field, w")})"""
_OUT = f"""{parse_sql(ASKED_SQL)}, {_GRAPH}, {CATALOG}, loose AS (SELECT id, ord, subcategory, CASE WHEN ord % 7 <> 0 THEN product_type_id END AS product_type_id FROM catalog),
out AS (SELECT query_id, edge_ord, target, relation, coalesce(label, target) AS label, w FROM parsed JOIN edges ON source = product_type_id AND review_status = 'approved' LEFT JOIN nodes ON nodes.id = target),
hits AS (SELECT query_id, edge_ord, c.id, row_number() OVER (PARTITION BY query_id, edge_ord ORDER BY c.ord) AS place FROM out JOIN loose c ON c.product_type_id = target OR (c.product_type_id IS NULL AND contains(c.subcategory, w)))"""


def _groups(spark, sf_dir):
    c = catalog(spark, sf_dir).withColumn("product_type_id", F.when(F.col("ord") % 7 != 0, F.col("product_type_id")))
    types = parsed(spark).filter("product_type_id IS NOT NULL").select("query_id", "product_type_id")
    return graph.complements(types, _edges(spark), _nodes(spark), c)


@query(_OUT + " SELECT query_id, edge_ord, target, relation FROM out")
def g01_outgoing(spark, sf_dir):
    types = parsed(spark).filter("product_type_id IS NOT NULL").select("query_id", "product_type_id")
    return graph.approved_edges(types, _edges(spark), _nodes(spark)).select("query_id", "edge_ord", "target", "relation")


@query(_OUT + " SELECT query_id, edge_ord, id, CAST(place AS INTEGER) AS place FROM hits WHERE place <= 4")
def g04_top4(spark, sf_dir):
    return _groups(spark, sf_dir).select("query_id", "edge_ord", F.posexplode("products").alias("p", "id")).select("query_id", "edge_ord", "id", (F.col("p") + 1).alias("place"))


@query(_OUT + " SELECT query_id, edge_ord, NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = o.query_id AND h.edge_ord = o.edge_ord) AS data_gap FROM out o")
def g05_gap(spark, sf_dir):
    return _groups(spark, sf_dir).select("query_id", "edge_ord", "data_gap")


@query(
    _OUT
    + """ SELECT query_id, edge_ord, CASE relation WHEN 'PREPARE_WITH' THEN 'Для подготовки' WHEN 'LEVEL_WITH' THEN 'Для выравнивания' WHEN 'APPLY_WITH' THEN 'Для нанесения'
  WHEN 'PROTECT_WITH' THEN 'Для защиты' WHEN 'USE_WITH' THEN 'Используется с' WHEN 'FINISH_WITH' THEN 'Для финишного слоя' ELSE 'Рекомендуется' END || ': ' ||
  CASE WHEN ends_with(label, 'а') THEN left(label, length(label) - 1) || 'и' ELSE label || 'ы' END AS title FROM out"""
)
def g06_title(spark, sf_dir):
    return _groups(spark, sf_dir).select("query_id", "edge_ord", "title")


@query()
def g07_neighbourhood(spark, sf_dir):
    nodes = [{"id": n[0], "label": n[1]} for n in _NODES]
    edges = [{"source": e[0], "relation": e[1], "target": e[2]} for e in _EDGES]
    inside, taken = graph.neighbourhood(nodes, edges, ["widget"])
    return spark.createDataFrame([("node", n) for n in inside] + [("edge", " ".join(e)) for e in taken], "kind string, what string")


_REQUIRED = (("c1", "type:widget", "PREPARE_WITH", "type:gear"), ("c1", "type:gear", "USE_WITH", "type:gear"), ("c2", "type:ring", "USE_WITH", "type:bolt"))


@query(f"WITH {_GRAPH} SELECT case_id, source, relation, target FROM (SELECT * FROM {values(_REQUIRED, 'case_id, source, relation, target')}) r WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.source = r.source AND e.relation = r.relation AND e.target = r.target)")
def g08_required_edges(spark, sf_dir):
    required = spark.createDataFrame(list(_REQUIRED), "case_id string, source string, relation string, target string")
    return graph.missing_edges(required, _edges(spark))


_RESULTS = (("c1", "PASS", "fine", 1), ("c1", "FAIL", "", 0), ("c3", "MAYBE", "x", 1), ("c4", "PASS", "y", 0))


@query("SELECT * FROM (VALUES ('missing_case', 'c2'), ('unexpected_case', 'c3'), ('duplicate_case', 'c1'), ('bad_verdict', 'c3'), ('empty_summary', 'c1'), ('no_evidence', 'c4'), ('wrong_status', 'FAIL')) t(code, detail)")
def g09_review_errors(spark, sf_dir):
    results = spark.createDataFrame(list(_RESULTS), "case_id string, verdict string, summary string, n_evidence int")
    expected = spark.createDataFrame([("c1",), ("c2",), ("c4",)], "case_id string")
    return graph.review_errors(results, expected, "REVIEW")


@query(
    f"""WITH {_GRAPH}, e AS (SELECT *, source || ' ' || relation || ' ' || target AS edge FROM edges)
SELECT 'dangling_endpoint' AS code, edge AS detail FROM e WHERE source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'unsupported_relation', edge FROM e WHERE relation NOT IN {_RELATIONS}
UNION ALL SELECT 'no_rationale', edge FROM e WHERE trim(rationale) = '' UNION ALL SELECT 'no_provenance', edge FROM e WHERE edge_ord = 2
UNION ALL SELECT 'not_approved', edge FROM e WHERE review_status <> 'approved'"""
)
def v04_graph_errors(spark, sf_dir):
    return graph.graph_errors(_nodes(spark), _edges(spark), _RELATIONS, published=True)


@query(f"WITH {_GRAPH}, {CATALOG} SELECT n.id, count(c.id) AS products FROM nodes n LEFT JOIN catalog c ON contains(lower(c.subcategory), n.w) GROUP BY n.id")
def v05_selector_counts(spark, sf_dir):
    return graph.selector_counts(_nodes(spark), catalog(spark, sf_dir))




@query()
def p10_engine(spark, sf_dir):
    """The whole engine over a batch of queries, repeated ones answered once."""
    again = asked(spark).unionByName(asked(spark).select((F.col("query_id") + 100).alias("query_id"), F.upper("raw").alias("raw")))
    return Engine(catalog(spark, sf_dir), dictionary(spark), _edges(spark), _nodes(spark)).answer(again, 5)
