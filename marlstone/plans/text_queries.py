"""Normalisation, parsing, canonicalisation and index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions.udfs import matched_share, nfkc
from marlstone.operators import aliases, canonical, index
from marlstone.operators.parse import parse_queries
from marlstone.plans.registry import ASKED_SQL, CATALOG, OFFERS, TYPES, catalog, dictionary, offers, parse_sql, parsed, query, table

_UNICODE_WORD = "\\p{L}\\p{M}\\p{N}_"


@query(
    f"""SELECT doc_id, length(n) AS n, md5(n) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(lower(text), 'ё', 'е'), '(\\d+),(\\d*)(\\s*(?:кг|kg|л|l)(?:[^{_UNICODE_WORD}]|$))', '\\1.\\2\\3', 'g'),
  '(\\d+\\.?\\d*)\\s*(кг|kg|л|l)([^{_UNICODE_WORD}]|$)', '\\1 \\2\\3', 'g'), '[^{_UNICODE_WORD}\\s.]', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM documents)"""
)
def n01_normalize_text(spark, sf_dir):
    n = tx.normalize_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(n).cast("long").alias("n"), F.md5(n).alias("digest"))


@query(f"SELECT doc_id, length(n) AS n, md5(n) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(text), 'ё', 'е'), '[^{_UNICODE_WORD}\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM documents)")
def n02_normalize_entity(spark, sf_dir):
    n = index.entity_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(n).cast("long").alias("n"), F.md5(n).alias("digest"))


# Names in Cyrillic letters, made of those of ``part``: every letter of the alphabet comes up.
_ROMAN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ"
_ENDINGS = ("ъ", "ы", "ь", "э", "ю", "я", "Ё")
_CYRILLIC_NAMES = f"""names AS (SELECT p_partkey, translate(p_name, '{_ROMAN}', '{_CYRILLIC}') ||
  CASE p_partkey % {len(_ENDINGS)} {" ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENDINGS))} END || ' ' || translate(upper(p_type), '{_ROMAN.upper()}', '{_CYRILLIC.upper()}') AS word FROM part)"""


def _cyrillic_names(spark, sf_dir):
    ending = F.get(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("p_partkey") % len(_ENDINGS)).cast("int"))
    word = F.concat(F.translate("p_name", _ROMAN, _CYRILLIC), ending, F.lit(" "), F.translate(F.upper("p_type"), _ROMAN.upper(), _CYRILLIC.upper()))
    return table(spark, sf_dir, "part").select("p_partkey", word.alias("word"))


def _spelled(text: str) -> str:
    for letter, latin in tx.LATIN.items():
        text = f"replace({text}, '{letter}', '{latin}')"
    return text


@query(f"WITH {_CYRILLIC_NAMES} SELECT p_partkey, word, {_spelled("replace(lower(word), 'ё', 'е')")} AS latin FROM names")
def n03_transliterate(spark, sf_dir):
    return _cyrillic_names(spark, sf_dir).select("p_partkey", "word", tx.transliterate(index.entity_text(F.col("word"))).alias("latin"))


@query("SELECT p_partkey, t AS phrase, regexp_matches(p_name, '(^|[^a-z0-9_])' || t || '([^a-z0-9_]|$)') AS found FROM part, (VALUES ('red'), ('red widget'), ('ring'), ('old'), ('')) v(t) WHERE t <> '' UNION ALL SELECT p_partkey, '', false FROM part")
def n04_contains_phrase(spark, sf_dir):
    phrases = F.explode(F.array(*[F.lit(p) for p in ("red", "red widget", "ring", "old", "")])).alias("phrase")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", phrases)
    return rows.select("p_partkey", "phrase", tx.contains_phrase(F.col("p_name"), F.col("phrase")).alias("found"))


@query(
    "SELECT p_partkey AS key, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand || ' - ' || p_type), '[^a-z0-9_\\s-]', '', 'g'), '[\\s-]+', '_', 'g'), '_') AS slug FROM part"
)
def n05_slug(spark, sf_dir):
    name = F.concat_ws(" ", "p_name", "p_brand", F.lit("-"), "p_type")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), tx.slug(name).alias("slug"))


@query(
    "SELECT page_id, md5(coalesce(t, '')) AS digest, length(t) AS n FROM (SELECT page_id, nullif(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace("
    "regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')), '') AS t FROM pages)"
)
def n06_strip_markup(spark, sf_dir):
    t = tx.strip_markup(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.coalesce(t, F.lit(""))).alias("digest"), F.length(t).cast("long").alias("n"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+\\n', '\n', 'g'), ' {2,}', ' ', 'g'), '\\n{3,}', '\n\n', 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents")
def n07_tidy_reply(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.tidy_reply(F.col("text"))).alias("digest"))


@query(parse_sql(OFFERS) + " SELECT query_id, normalized, len(tokens) AS n_tokens FROM toks")
def q01_tokens(spark, sf_dir):
    n = tx.normalize_text(F.col("raw"))
    return offers(spark, sf_dir).select("query_id", n.alias("normalized"), F.size(tx.tokens(n)).cast("long").alias("n_tokens"))


@query(parse_sql(ASKED_SQL) + " SELECT phrase, kind, id, display FROM dict")
def q02_alias_dictionary(spark, sf_dir):
    return dictionary(spark).select("phrase", "kind", "id", "display")


@query(parse_sql(OFFERS) + " SELECT query_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, kind, id FROM matched")
def q03_alias_match(spark, sf_dir):
    n = offers(spark, sf_dir).select("query_id", tx.tokens(tx.normalize_text(F.col("raw"))).alias("tokens"))
    return aliases.match_phrases(n, dictionary(spark)).select("query_id", "start", F.col("end").alias("stop"), "kind", "id")


@query(parse_sql(OFFERS) + " SELECT query_id, product_type_id, brand_id, finish FROM parsed")
def q04_first_slots(spark, sf_dir):
    return parse_queries(offers(spark, sf_dir), dictionary(spark)).select("query_id", "product_type_id", "brand_id", F.col("attributes.finish").alias("finish"))


@query(parse_sql(ASKED_SQL) + " SELECT query_id, weight_kg, volume_l FROM parsed")
def q07_amounts(spark, sf_dir):
    return parsed(spark).select("query_id", F.col("attributes.weight_kg").alias("weight_kg"), F.col("attributes.volume_l").alias("volume_l"))


@query(parse_sql(OFFERS) + " SELECT query_id, residual FROM parsed")
def q09_residual(spark, sf_dir):
    return parse_queries(offers(spark, sf_dir), dictionary(spark)).select("query_id", F.array_join("unparsed_tokens", " ").alias("residual"))


@query(parse_sql(ASKED_SQL) + " SELECT query_id, normalized, product_type_id, product_type_display, brand_id, brand_display, finish, residual FROM parsed")
def q10_parse(spark, sf_dir):
    p = parsed(spark)
    return p.select("query_id", "normalized", "product_type_id", "product_type_display", "brand_id", "brand_display", F.col("attributes.finish").alias("finish"), F.array_join("unparsed_tokens", " ").alias("residual"))


_BRANDS = [(f"brand:{i}", f"B{i}", f"BRAND#{i}", [f"brand {i}", f"b#{i}"], i) for i in range(1, 21)]
_BRAND_SCHEMA = "id string, display string, catalog_value string, aliases array<string>, ord int"


@query("SELECT p_partkey, CASE WHEN n <= 20 THEN 'brand:' || n END AS brand_id, CASE WHEN n <= 20 THEN 'B' || n ELSE p_brand END AS brand_display FROM (SELECT p_partkey, p_brand, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS n FROM part)")
def c01_brand_resolve(spark, sf_dir):
    brands = spark.createDataFrame(_BRANDS, _BRAND_SCHEMA)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    return canonical.assign_brand(rows, brands).select("p_partkey", "brand_id", "brand_display")


_TYPE_ALIASES = [("type:ring", ["ring", "old gear"]), ("type:gear", ["gear"]), ("type:cold", ["cold"]), ("type:none", ["widge"])]


@query("SELECT p_partkey, CASE WHEN regexp_matches(t, '\\b(ring|old gear)\\b') THEN 'type:ring' WHEN regexp_matches(t, '\\bgear\\b') THEN 'type:gear' WHEN regexp_matches(t, '\\bcold\\b') THEN 'type:cold' END AS product_type_id FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part)")
def c02_type_resolve(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", canonical.type_by_alias(F.concat_ws(" ", "p_name", "p_type"), _TYPE_ALIASES).alias("product_type_id"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS weight_kg, CASE WHEN p_size % 2 = 0 THEN p_size + 0.5 END AS volume_l FROM part")
def c03_name_attributes(spark, sf_dir):
    name = F.concat("p_name", F.lit(" N"), F.col("p_size").cast("string"), F.lit("кг "), F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(",5 л"))).otherwise(F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", canonical.name_attributes(name).alias("a")).select("p_partkey", "a.*")


def _halves(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit(" Sku"), (F.col("p_partkey") % 997).cast("string")).alias("sku"), F.concat(F.lit("https://x.example/P"), (F.col("p_partkey") % 1499).cast("string"), F.lit("/")).alias("url")
    )
    return parts.filter("ord % 3 = 0"), parts.filter("ord % 3 <> 0")


_HALVES = "p AS (SELECT p_partkey AS ord, lower('Sku' || p_partkey % 997) AS sku, lower('https://x.example/P' || p_partkey % 1499) AS url FROM part)"


@query(f"WITH {_HALVES} SELECT s.ord FROM p s WHERE s.ord % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM p o WHERE o.ord % 3 = 0 AND o.sku = s.sku) AND NOT EXISTS (SELECT 1 FROM p o WHERE o.ord % 3 = 0 AND o.url = s.url)")
def c05_not_known(spark, sf_dir):
    snapshot, staged = _halves(spark, sf_dir)
    return canonical.not_known(staged, snapshot).select("ord")


@query()
def c06_first_of_each(spark, sf_dir):
    return canonical.first_of_each(_halves(spark, sf_dir)[1]).select("ord")


@query("SELECT p_partkey, 'shop:' || substr(sha256(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END), 1, 20) AS id FROM part")
def c07_synthetic_id(spark, sf_dir):
    key = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", canonical.synthetic_id(key, F.col("p_brand")).alias("id"))


@query("SELECT p_partkey, length(b) >= 3 AND NOT contains(lower(p_name), b) AND NOT contains(lower(p_type), b) AS ok FROM (SELECT *, lower(CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN p_brand ELSE 'ab' END) AS b FROM part)")
def c08_is_brand(spark, sf_dir):
    b = F.when(F.col("p_partkey") % 3 == 0, F.split("p_name", " ")[1]).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise("ab")
    return table(spark, sf_dir, "part").select("p_partkey", canonical.is_brand(b, F.col("p_name"), F.col("p_type")).alias("ok"))


@query(
    f"""WITH {CATALOG}, f AS (SELECT upper(brand) AS catalog_value, arg_min(brand, ord) AS display FROM catalog GROUP BY 1)
SELECT id, catalog_value, display FROM (VALUES ('brand:seed', 'BRAND#1', 'Seed One')) s(id, catalog_value, display)
UNION ALL SELECT 'brand:' || lower(replace(display, '#', '')), catalog_value, display FROM f WHERE catalog_value <> 'BRAND#1'"""
)
def c09_brand_dictionary(spark, sf_dir):
    seeds = spark.createDataFrame([("brand:seed", "Brand#1", "Seed One", ["seed"]), ("brand:no", "лак", "лак", ["лак"])], "id string, catalog_value string, display string, aliases array<string>")
    return canonical.brand_dictionary(catalog(spark, sf_dir), seeds).select("id", "catalog_value", "display")


# Names that the rules for types must tell apart, and categories, guarded ones among them.
_GOODS = (
    "Опора под брус", "Саморез по дереву", "Сайдинг виниловый", "Лак паркетный", "Лакомый кусок", "Пропитка-лак", "Грунтовка глубокая", "Бетоноконтакт", "Шпатлёвка и шпатлевка",
    "Паста финишная", "Штукатурка", "Эмаль ПФ-115", "Краска", "Некраска", "Колеровка", "Кисточка", "Макловица", "Валик", "Клей для плитки", "Плиточный крепкий клей", "Вагонка", "Рейка",
    "Фанера", "OSB плита", "Гипсокартон", "Пол наливной", "Наливной пол", "Стяжка", "Пена монтажная", "Монтажная пена", "Герметик под покраску", "Силикон", "Затирка", "Муфта", "Кабель",
    "Гидроизоляция", "Минвата", "Плинтус", "Порог с покрытием полимерным эмаль", "Ламинат", "Стеклообои", "УШМ", "Дрель", "Покрытие эмалью", "Ведро", "",
)
_TRADES = (*canonical.NO_PAINT_CATEGORIES, "отделка", "Крепеж и метизы", "краски и лаки", None, "")
_GOODS_SQL = f"""goods AS (SELECT p_partkey, list_extract([{", ".join(f"'{g}'" for g in _GOODS)}], p_partkey % {len(_GOODS)} + 1) || ' ' || p_size AS name,
  list_extract([{", ".join("NULL" if t is None else f"'{t}'" for t in _TRADES)}], (p_partkey // 3) % {len(_TRADES)} + 1) AS trade FROM part)"""


def _goods(spark, sf_dir):
    n = F.col("p_partkey")
    name = F.concat(F.get(F.array(*[F.lit(g) for g in _GOODS]), (n % len(_GOODS)).cast("int")), F.lit(" "), F.col("p_size").cast("string"))
    trade = F.get(F.array(*[F.lit(t) for t in _TRADES]), (F.floor(n / 3) % len(_TRADES)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), trade.alias("trade"))


def _unicode(pattern: str) -> str:
    """A pattern whose word signs know letters of any script, for an engine where they do not."""
    start, end = f"(^|[^{_UNICODE_WORD}])", f"([^{_UNICODE_WORD}]|$)"
    head, tail = pattern.startswith("\\b"), pattern.endswith("\\b")
    middle = pattern[2 * head : len(pattern) - 2 * tail].replace("\\w", f"[{_UNICODE_WORD}]")
    return (start if head else "") + f"({middle})" + (end if tail else "")


_BARE = f"regexp_replace(lower(name), '{canonical.PAINT_TALK.replace('(?U)', '').replace(chr(92) + 'w', f'[{_UNICODE_WORD}]')}', '', 'g')"
_CHAIN = " ".join(f"WHEN regexp_matches(t, '{_unicode(p)}'){' AND NOT guarded' if i in canonical.PAINT_TYPES else ''} THEN '{i}'" for p, i, _ in canonical.TYPE_RULES)


@query(
    f"""WITH {_GOODS_SQL}, texts AS (SELECT p_partkey, coalesce(lower(trade), '') || ' отдел ' || {_BARE} AS t, coalesce(lower(trade), '') IN {canonical.NO_PAINT_CATEGORIES} AS guarded FROM goods)
SELECT p_partkey, CASE {_CHAIN} END AS product_type_id FROM texts"""
)
def c10_rule_classify(spark, sf_dir):
    """All rules and the guard of the paint types."""
    return _goods(spark, sf_dir).select("p_partkey", canonical.type_by_rule(F.col("name"), F.col("trade"), F.lit("Отдел")).alias("product_type_id"))


@query(f"WITH {_GOODS_SQL} SELECT p_partkey, {_BARE} AS name FROM goods")
def c12_clean_name(spark, sf_dir):
    return _goods(spark, sf_dir).select("p_partkey", canonical.without_paint_talk(F.col("name")).alias("name"))


@query(f"WITH {CATALOG} SELECT id, CASE WHEN ord % 2 = 0 THEN 99.0 ELSE weight_kg END AS weight_kg, finish FROM catalog")
def c13_enrich(spark, sf_dir):
    products = catalog(spark, sf_dir)
    raw = F.when(F.col("ord") % 2 == 0, F.lit("99 kg")).otherwise("")
    new = parse_queries(products.select(F.col("id").alias("query_id"), raw.alias("raw")), dictionary(spark))
    return canonical.enrich_attributes(products, new).select("id", "attributes.weight_kg", "attributes.finish")


@query(
    f"""WITH {CATALOG}, rules AS (SELECT DISTINCT product_type_id AS id, subcategory AS display FROM catalog),
known AS (SELECT product_type_id AS id, lower(category) AS a FROM catalog WHERE ord % 5 = 0 UNION SELECT product_type_id, 'bro' || chr(65533) || 'ken' FROM catalog),
forms AS (SELECT subcategory AS display, subcategory || 's' AS a FROM catalog WHERE length(subcategory) <= 4 UNION SELECT subcategory, lower(brand) FROM catalog WHERE length(subcategory) <= 4 AND ord % 50 = 0),
every AS (SELECT id, a FROM known UNION SELECT id, a FROM rules JOIN forms USING (display)
  UNION SELECT id, display || e FROM rules, (VALUES (''), ('ы'), ('и')) v(e) WHERE display NOT IN (SELECT display FROM forms))
SELECT id, string_agg(a, ',' ORDER BY a) AS aliases FROM every JOIN rules USING (id) WHERE NOT contains(a, chr(65533)) GROUP BY id"""
)
def c14_type_aliases(spark, sf_dir):
    """Known aliases from the catalogue's categories, forms of the short nouns only."""
    c = catalog(spark, sf_dir)
    known = c.groupBy(F.col("product_type_id").alias("id")).agg(F.array_append(F.collect_set(F.when(F.col("ord") % 5 == 0, F.lower("category"))), F.lit("bro\ufffdken")).alias("aliases"))
    short = c.filter(F.length("subcategory") <= 4)
    forms = short.groupBy(F.col("subcategory").alias("display")).agg(F.array_append(F.collect_set(F.when(F.col("ord") % 50 == 0, F.lower("brand"))), F.concat("subcategory", F.lit("s"))).alias("forms"))
    out = canonical.type_aliases(known, forms, [("", f"type:{t}", t) for t in TYPES])
    return out.select("id", F.array_join("aliases", ",").alias("aliases"))


@query(
    """WITH p AS (SELECT *, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS n, p_partkey % 3 = 0 AS old, lower(p_name || ' ' || p_type) AS t FROM part),
c AS (SELECT *, CASE WHEN old THEN CAST(p_partkey AS VARCHAR) ELSE 'shop:' || substr(sha256('k' || p_partkey), 1, 20) END AS id FROM p
  WHERE old OR NOT EXISTS (SELECT 1 FROM p o WHERE o.old AND o.p_partkey = p.p_partkey - 1 AND p.p_partkey % 2 = 0))
SELECT id, p_name AS name, CASE WHEN old THEN 'snapshot' ELSE 'staging' END AS source, old AS immutable, CASE WHEN n <= 20 THEN 'brand:' || n END AS brand_id,
  CASE WHEN regexp_matches(t, '\\b(ring|old gear)\\b') THEN 'type:ring' WHEN regexp_matches(t, '\\bgear\\b') THEN 'type:gear' WHEN regexp_matches(t, '\\bcold\\b') THEN 'type:cold' END AS product_type_id,
  CASE WHEN NOT old THEN 'k' || p_partkey END AS source_product_key FROM c"""
)
def c04_canonical_union(spark, sf_dir):
    """A third of the parts as the snapshot, the rest staged; some staged ones have the number of the part before."""
    n = F.col("p_partkey")
    sku = F.when((n % 3 != 0) & (n % 2 == 0), n - 1).otherwise(n)
    nothing = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "part").select(
        n.cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), nothing.alias("subcategory"),
        F.when((n % 3 == 0) | (n % 3 == 1), F.concat(F.lit("Sku "), sku.cast("string"))).alias("sku"), F.col("p_retailprice").alias("price"), nothing.alias("url"), nothing.alias("image"), n.alias("ord"),
    )
    staged = rows.filter("ord % 3 <> 0").withColumn("source_product_key", F.concat(F.lit("k"), "id")).withColumn("retrieved_at", F.lit("2024-01-01")).withColumn("content_sha256", F.sha2("name", 256)).drop("id")
    out = canonical.canonical_catalog(rows.filter("ord % 3 = 0"), staged, spark.createDataFrame(_BRANDS, _BRAND_SCHEMA), _TYPE_ALIASES)
    return out.select("id", "name", "source", "immutable", "brand_id", "product_type_id", "source_product_key")


@query(
    f"""WITH {CATALOG}, c AS (SELECT CASE WHEN ord % 4 <> 0 THEN brand_id END AS brand_id, CASE WHEN ord % 5 <> 0 THEN product_type_id END AS product_type_id FROM catalog)
SELECT count(*) AS products, count(brand_id) AS with_brand, round(100.0 * count(brand_id) / count(*), 2) AS brand_percent,
  count(product_type_id) AS with_type, round(100.0 * count(product_type_id) / count(*), 2) AS type_percent FROM c"""
)
def c15_coverage(spark, sf_dir):
    rows = catalog(spark, sf_dir).select(F.when(F.col("ord") % 4 != 0, F.col("brand_id")).alias("brand_id"), F.when(F.col("ord") % 5 != 0, F.col("product_type_id")).alias("product_type_id"))
    return canonical.coverage(rows)


def _phrases(spark, sf_dir):
    brands = spark.createDataFrame([(f"brand:{i}", f"Brand#{i}", [f"brand {i}"]) for i in range(1, 26)], "id string, display string, aliases array<string>")
    types = spark.createDataFrame([(f"type:{t}", t, [t, f"{t}s"]) for t in TYPES], "id string, display string, aliases array<string>")
    return index.entity_phrases(brands, types, catalog(spark, sf_dir).select("id", "name"))


_PHRASES = f"""phrases AS (
  SELECT DISTINCT entity_type, entity_id, display, trim(regexp_replace(regexp_replace(lower(p), '[^a-z0-9_\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS normalized_phrase FROM (
    SELECT 'brand' AS entity_type, 'brand:' || i AS entity_id, 'Brand#' || i AS display, unnest(['Brand#' || i, 'brand ' || i]) AS p FROM range(1, 26) r(i)
    UNION ALL SELECT 'product_type', 'type:' || t, t, unnest([t, t || 's']) FROM (VALUES {", ".join(f"('{t}')" for t in TYPES)}) v(t)
    UNION ALL SELECT 'product_name', CAST(p_partkey AS VARCHAR), p_name, p_name FROM part))"""


@query(f"WITH {_PHRASES} SELECT entity_type, entity_id, display, normalized_phrase, 1 AS trusted FROM phrases")
def c16_entity_phrases(spark, sf_dir):
    return _phrases(spark, sf_dir)


@query(f"WITH {_PHRASES} SELECT entity_type, count(*) AS pending FROM phrases WHERE entity_type <> 'product_name' OR length(entity_id) % 2 = 1 GROUP BY entity_type")
def c17_pending_vectors(spark, sf_dir):
    wanted = _phrases(spark, sf_dir)
    existing = wanted.filter("entity_type = 'product_name' AND length(entity_id) % 2 = 0").withColumn("vector", F.array(F.lit(1.0))).withColumn("dimension", F.lit(1))
    return index.reuse_vectors(wanted, existing)[1].groupBy("entity_type").agg(F.count(F.lit(1)).alias("pending"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS first FROM embeddings")
def c19_unit_vectors(spark, sf_dir):
    v = F.col("embedding")
    unit = index.unit_vector(v)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(index.dot(v, v)), 4).alias("norm"), F.round(unit[0], 4).alias("first"))


@query()
def r05_matched_share(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", F.round(matched_share(F.col("p_name"), F.lit("red widget")), 6).alias("share"))


@query("SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-zA-Zа-яА-Я0-9]+'), lambda w: length(w) > 1 AND w NOT IN ('the', 'a', 'an', 'and', 'or', 'to', 'for')), ' ') AS words FROM conversations")
def l01_keywords(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(tx.keywords(F.col("text")), " ").alias("words"))


@query("SELECT p_partkey, 'No1 ' || p_name || ' kg' AS n FROM part")
def n02_compatibility(spark, sf_dir):
    """Names in full-width letters, between a numero sign, a circled digit and a unit sign, come back plain."""
    wide = F.translate("p_name", _ROMAN + " ", "".join(chr(ord(c) + 0xFEE0) for c in _ROMAN) + "\u3000")
    return table(spark, sf_dir, "part").select("p_partkey", nfkc(F.concat(F.lit("\u2116\u2460 "), wide, F.lit(" \u338f"))).alias("n"))


@query(
    f"""WITH {_PHRASES}, t AS (SELECT entity_type, count(*) AS wanted, count(*) FILTER (entity_type = 'brand' OR length(entity_id) % 2 = 0) AS present FROM phrases GROUP BY 1)
SELECT entity_type, CASE WHEN entity_type = 'product_type' THEN 'rebuild' WHEN present >= wanted THEN 'complete' ELSE 'building' END AS status FROM t"""
)
def c18_index_status(spark, sf_dir):
    """A status for each entity type; the model of the product types has changed."""
    wanted = _phrases(spark, sf_dir)
    existing = wanted.filter("entity_type = 'brand' OR length(entity_id) % 2 = 0").withColumn("vector", F.array(F.lit(1.0))).withColumn("dimension", F.lit(1))
    kept, pending = index.reuse_vectors(wanted, existing)
    counts = kept.select("entity_type", F.lit(1).alias("present")).union(pending.select("entity_type", F.lit(0))).groupBy("entity_type").agg(F.count(F.lit(1)).alias("wanted"), F.sum("present").alias("present"))
    status = [(r["entity_type"], index.index_status({"model": "a"}, {"model": "b" if r["entity_type"] == "product_type" else "a"}, r["wanted"], r["present"])) for r in counts.collect()]
    return spark.createDataFrame(status, "entity_type string, status string")
