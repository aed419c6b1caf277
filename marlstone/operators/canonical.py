"""Snapshot and staged rows to the canonical catalogue; brand, type and attribute assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import VOLUME_UNITS, WEIGHT_UNITS, casefold, fold_yo, name_amount, slug
from marlstone.sources.tables import staged as staged_table

# Words that are no brands.
NO_BRANDS = (
    "гипсокартон", "саморезы", "саморез", "профиль", "уголок", "брусок", "доска", "фанера", "плинтус", "труба", "трубы",
    "фитинги", "кабель", "провод", "электрика", "сантехника", "крепеж", "метизы", "гидроизоляция", "утеплитель", "плитка",
    "ламинат", "линолеум", "обои", "инструмент", "краска", "грунтовка", "шпаклевка", "шпатлевка", "штукатурка", "лак",
    "затирка", "пена", "герметик", "малая упаковка", "сопутствующие материалы", "упаковка", "гладкая", "для камня", "белый",
    "бежевый", "черный", "серый", "синий", "красный", "зеленый", "прозрачный", "матовый", "глянцевый", "стальные", "чугунные",
    "термостойкие", "металлические", "пластиковые", "деревянные", "латунные", "оцинкованные", "медные", "алюминиевые",
    "строганный", "строганый", "строганая", "влагостойкий", "влагостойкая", "калиброванный", "калиброванная",
)

# Rules for product types in their order (pattern, type, display).
TYPE_RULES = (
    (r"опора.*брус|саморез|шуруп|дюбель|анкер|крепеж|метиз", "type:fastener", "крепеж"),
    (r"сайдинг", "type:siding", "сайдинг"),
    (r"\b(лак|лаки|лаков|лаком|лака|пропитка-лак)\b", "type:varnish", "лак"),
    (r"\b(грунт|грунтовк|праймер|бетоноконтакт)\w*", "type:primer", "грунтовка"),
    (r"\b(шпатлев|шпаклев|паста финиш)\w*", "type:putty", "шпаклёвка"),
    (r"\b(штукатур)\w*", "type:plaster", "штукатурка"),
    (r"\b(краск|эмаль|колер)\w*", "type:paint", "краска"),
    (r"\b(кист|кисточк|макловиц|флейц)\w*", "type:brush", "кисть"),
    (r"\b(валик|ролик)\w*", "type:roller", "валик"),
    (r"плиточн.*клей|клей.*плит", "type:tile_glue", "плиточный клей"),
    (r"\b(брус|брусок|рейка|вагонка|доска|пиломатериал)\w*", "type:brusok", "брусок"),
    (r"фанер|осб|osb|дсп|двп", "type:plywood", "фанера"),
    (r"гипсокартон|гкл", "type:gypsum_board", "гипсокартон"),
    (r"наливн.*пол|самонивелир", "type:self_leveling_floor", "наливной пол"),
    (r"стяжка|кладочн.*смесь|цемент", "type:cement_mix", "сухая смесь"),
    (r"пена.*монт|монт.*пена", "type:foam_mounting", "пена монтажная"),
    (r"герметик|силикон|акрил", "type:sealant", "герметик"),
    (r"затирка|фуга", "type:grout", "затирка"),
    (r"труб|фитинг|муфта|отвод|сифон|сантех", "type:plumbing", "сантехника"),
    (r"кабель|провод|розетк|выключат|автомат|электр", "type:electrical", "электрика"),
    (r"гидроизол", "type:waterproofing", "гидроизоляция"),
    (r"утеплител|минвата|пеноплэкс", "type:insulation", "утеплитель"),
    (r"плинтус|порог", "type:skirting", "плинтус"),
    (r"ламинат|линолеум|паркет", "type:flooring", "напольное покрытие"),
    (r"обои|стеклообои", "type:wallpaper", "обои"),
    (r"дрель|перфоратор|болгарка|ушм|шуруповерт|инструмент", "type:tool", "инструмент"),
)

# Types that are passed over in these categories.
PAINT_TYPES = ("type:paint", "type:varnish", "type:brush", "type:roller")
NO_PAINT_CATEGORIES = (
    "инженерная сантехника",
    "ревизионные люки",
    "климатическое оборудование",
    "электроинструмент и комплектующие",
    "ручной инструмент, спецодежда",
    "дача, сад, отдых",
    "крепеж и метизы",
    "сухие строительные смеси и гидроизоляция",
)

# Fixed value: words in a name that speak of paint though the product is none.
PAINT_TALK = r"(?U)покрыти\w*\s+(полимерн\w*\s+)?эмаль\w*|под\s+покраск\w*"


def brand_key(text: Column) -> Column:
    return F.trim(fold_yo(F.lower(text)))


def assign_brand(products: DataFrame, brands: DataFrame) -> DataFrame:
    """Add brand_id and brand_display: the first brand (``ord``) whose catalogue value or alias equals
    the product's; without one, null and the brand as given. ``brands``: id, display, catalog_value,
    aliases, ord."""
    keys = brands.select("id", "display", "ord", F.explode(F.array_union(F.array("catalog_value"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("k"))
    keys = keys.groupBy(brand_key(F.col("k")).alias("_key")).agg(F.min_by(F.struct("id", "display"), "ord").alias("_hit")).filter("_key <> ''")
    joined = products.withColumn("_key", brand_key(F.col("brand"))).join(keys, "_key", "left")
    shown = F.coalesce("_hit.display", F.nullif(F.col("brand"), F.lit("")))
    return joined.withColumn("brand_id", F.col("_hit.id")).withColumn("brand_display", shown).drop("_key", "_hit")


def type_by_alias(text: Column, types: list[tuple[str, list[str]]]) -> Column:
    """First type, in the dictionary's order, one of whose aliases stands in the text as words. The
    dictionary becomes a chain of conditions: one pass over the products and no join."""
    folded = fold_yo(F.lower(text))
    chain = F.lit(None).cast("string")
    for type_id, aliases in reversed(types):
        words = "|".join(r"\Q" + a.lower().replace("ё", "е") + r"\E" for a in aliases)
        chain = F.when(F.rlike(folded, F.lit(rf"(?U)\b(?:{words})\b")), F.lit(type_id)).otherwise(chain)
    return chain


def without_paint_talk(name: Column) -> Column:
    """A name in lower case without the words that speak of paint though the product is none."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), PAINT_TALK, "")


def type_by_rule(name: Column, subcategory: Column, category: Column, rules=TYPE_RULES) -> Column:
    """First rule that the product's texts meet; paint rules do not count in other trades'
    categories."""
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in (subcategory, category)]
    text = F.concat_ws(" ", low[0], low[1], without_paint_talk(name))
    guarded = low[0].isin(*NO_PAINT_CATEGORIES) | low[1].isin(*NO_PAINT_CATEGORIES)
    chain = F.lit(None).cast("string")
    for pattern, type_id, _ in reversed(rules):
        met = F.rlike(text, F.lit(f"(?U){pattern}"))
        chain = F.when(met & ~guarded if type_id in PAINT_TYPES else met, F.lit(type_id)).otherwise(chain)
    return chain


def is_brand(brand: Column, subcategory: Column | None = None, category: Column | None = None) -> Column:
    """Long enough, no known common word, and no part of the product's own category."""
    low = F.lower(F.trim(brand))
    ok = (F.length(low) >= 3) & ~low.isin(*NO_BRANDS)
    for c in (subcategory, category):
        if c is not None:
            ok = ok & ~F.lower(F.coalesce(c, F.lit(""))).contains(low)
    return F.coalesce(ok, F.lit(False))


def brand_dictionary(products: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seed brands that are brands, and every other brand of the catalogue as first written:
    id, catalog_value, display, aliases. ``products``: brand, subcategory, category, ord."""
    kept = seeds.filter(is_brand(F.col("catalog_value")) & is_brand(F.col("display"))).select("id", F.upper("catalog_value").alias("catalog_value"), "display", "aliases")
    named = products.withColumn("b", F.trim("brand")).filter(is_brand(F.col("b"), F.col("subcategory"), F.col("category")))
    first = named.groupBy(F.upper("b").alias("catalog_value")).agg(F.min_by("b", "ord").alias("display"))
    new = first.join(kept.select("catalog_value"), "catalog_value", "left_anti")
    own = slug(F.col("display"))
    made = new.select(
        F.concat(F.lit("brand:"), own).alias("id"),
        "catalog_value",
        "display",
        F.array_distinct(F.array(F.lower("display"), F.lower("catalog_value"), F.replace(own, F.lit("_"), F.lit("")))).alias("aliases"),
    )
    return kept.unionByName(made)


def type_aliases(existing: DataFrame, inflections: DataFrame, rules=TYPE_RULES) -> DataFrame:
    """(id, display, aliases): aliases of the rules' types, known ones and inflections (display,
    forms) together, sorted, without broken characters. Types without listed forms get simple plurals."""
    spark = existing.sparkSession
    ruled = spark.createDataFrame([(t, d) for _, t, d in rules], "id string, display string").dropDuplicates(["id"])
    none = F.array().cast("array<string>")
    plain = F.array("display", F.concat("display", F.lit("ы")), F.concat("display", F.lit("и")))
    joined = ruled.join(existing.select("id", F.col("aliases").alias("old")), "id", "left").join(inflections, "display", "left")
    every = F.array_union(F.coalesce("old", none), F.coalesce("forms", plain))
    return joined.select("id", "display", F.array_sort(F.filter(every, lambda a: (a != "") & ~a.contains("�"))).alias("aliases"))


def enrich_attributes(products: DataFrame, parsed: DataFrame) -> DataFrame:
    """Attributes parsed from a product's texts (query_id = id) over those it has."""
    new = parsed.select(F.col("query_id").alias("id"), F.col("attributes").alias("_new"))
    fields = [f.name for f in products.schema["attributes"].dataType.fields]
    merged = F.struct(*[F.coalesce(F.col(f"_new.{f}"), F.col(f"attributes.{f}")).alias(f) for f in fields])
    return products.join(new, "id", "left").withColumn("attributes", merged).drop("_new")


def name_attributes(name: Column) -> Column:
    return F.struct(name_amount(name, WEIGHT_UNITS).alias("weight_kg"), name_amount(name, VOLUME_UNITS).alias("volume_l"))


def synthetic_id(*keys: Column, source_id: str = "shop") -> Column:
    """Stable id of a staged row from its first key that is not empty, under the source's name."""
    key = F.coalesce(*[F.nullif(k, F.lit("")) for k in keys])
    return F.concat(F.lit(f"{source_id}:"), F.substring(F.sha2(key, 256), 1, 20))


def sku_key(sku: Column) -> Column:
    return F.nullif(casefold(F.trim(F.coalesce(sku, F.lit("")))), F.lit(""))


def url_key(url: Column) -> Column:
    return F.nullif(casefold(F.rtrim(F.coalesce(url, F.lit("")), F.lit("/"))), F.lit(""))


def not_known(staged: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Staged rows whose sku and url the snapshot does not have; empty keys match nothing."""
    skus = snapshot.select(sku_key(F.col("sku")).alias("_sku")).filter("_sku IS NOT NULL").distinct()
    urls = snapshot.select(url_key(F.col("url")).alias("_url")).filter("_url IS NOT NULL").distinct()
    rows = staged.withColumn("_sku", sku_key(F.col("sku"))).withColumn("_url", url_key(F.col("url")))
    return rows.join(skus, "_sku", "left_anti").join(urls, "_url", "left_anti").drop("_sku", "_url")


def first_of_each(staged: DataFrame, order: str = "ord") -> DataFrame:
    """Greedy de-duplication in row order: a row goes if a row that was kept before it has its sku or
    its url. Decided in rounds over all rows at once: a row is kept if it is the first undecided one
    of both its keys, and rows that share a key with a kept one go. Every round settles at least the
    first open row of each group that hangs together, so as many rounds as it takes end the work."""
    rows = staged.withColumn("_sku", sku_key(F.col("sku"))).withColumn("_url", url_key(F.col("url")))
    open_ = rows.select(order, "_sku", "_url")
    kept = open_.filter("_sku IS NULL AND _url IS NULL").select(order)
    open_ = open_.filter("_sku IS NOT NULL OR _url IS NOT NULL")
    while True:
        open_ = staged_table(open_, "undecided")
        if open_.isEmpty():
            break
        for k in ("_sku", "_url"):
            least = open_.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_m{k}"))
            open_ = open_.join(least, k, "left")
        chosen = staged_table(open_.filter(f"coalesce(_m_sku, {order}) = {order} AND coalesce(_m_url, {order}) = {order}").select(order, "_sku", "_url"), "chosen")
        kept = kept.union(chosen.select(order))
        left = open_.join(chosen.select(order), order, "left_anti")
        left = left.join(chosen.select("_sku").filter("_sku IS NOT NULL"), "_sku", "left_anti").join(chosen.select("_url").filter("_url IS NOT NULL"), "_url", "left_anti")
        open_ = left.select(order, "_sku", "_url")
    return rows.join(kept, order, "left_semi").drop("_sku", "_url")


def canonical_catalog(snapshot: DataFrame, staged: DataFrame, brands: DataFrame, types: list[tuple[str, list[str]]], source_id: str = "shop") -> DataFrame:
    """Canonical rows of snapshot and new staged products, in order: snapshot first, then staged.

    Both: name, brand, category, subcategory, sku, price, url, image, ord; the snapshot has id, staged
    rows source_product_key, retrieved_at and content_sha256.
    """
    old = snapshot.select(
        F.col("id").cast("string").alias("id"), *_FIELDS, "ord", F.lit("snapshot").alias("source"), F.lit(True).alias("immutable"),
        F.lit(None).cast("string").alias("source_product_key"), F.lit(None).cast("string").alias("retrieved_at"), F.lit(None).cast("string").alias("content_sha256"),
    )
    fresh = first_of_each(not_known(staged, snapshot)).select(
        synthetic_id(F.col("source_product_key"), F.col("url"), F.col("sku"), source_id=source_id).alias("id"), *_FIELDS, "ord", F.lit("staging").alias("source"), F.lit(False).alias("immutable"),
        "source_product_key", "retrieved_at", "content_sha256",
    )
    both = old.withColumn("_part", F.lit(0)).unionByName(fresh.withColumn("_part", F.lit(1)))
    both = both.withColumn("ord", F.col("_part") * F.lit(1 << 40) + F.col("ord")).drop("_part")
    text = F.concat_ws(" ", "name", F.coalesce("subcategory", F.lit("")), F.coalesce("category", F.lit("")))
    branded = assign_brand(both, brands)
    return branded.withColumn("product_type_id", type_by_alias(text, types)).withColumn("attributes", name_attributes(F.col("name")))


_FIELDS = ("name", "brand", "category", "subcategory", "sku", "price", "url", "image")


def coverage(products: DataFrame) -> DataFrame:
    """Counts and shares of products with a brand and with a type."""
    n = F.count(F.lit(1))
    share = lambda c: F.when(n == 0, F.lit(0.0)).otherwise(F.round(100 * F.count(c) / F.nullif(n, F.lit(0)), 2))
    return products.agg(
        n.alias("products"),
        F.count("brand_id").alias("with_brand"),
        share("brand_id").alias("brand_percent"),
        F.count("product_type_id").alias("with_type"),
        share("product_type_id").alias("type_percent"),
    )
