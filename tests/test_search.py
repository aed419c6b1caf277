"""Parser, search, graph, resolver, ingestion and chat on small Cyrillic fixtures."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import canonical, chat, graph, ingest, legacy, resolve, respond, search
from marlstone.operators import aliases, nearest
from marlstone.operators.aliases import ALIAS_SCHEMA, alias_dictionary
from marlstone.operators.parse import parse_queries
from marlstone.plans import data_queries, search_queries
from marlstone.plans.engine import Engine
from marlstone.sources import tables
from marlstone.streaming import ingest as streaming

ALIASES = [
    ("product_type", "type:paint", "краска", "краска", 1), ("product_type", "type:primer", "грунтовка", "грунтовка", 2), ("product_type", "type:varnish", "лак", "лак", 3),
    ("product_type", "type:putty", "шпаклёвка", "шпаклевка", 4), ("product_type", "type:brusok", "брусок", "брус", 5), ("product_type", "type:brusok", "брусок", "доска", 6),
    ("product_type", "type:gypsum_board", "гипсокартон", "гипсокартон", 7), ("product_type", "type:x", "x", "двойник", 8),
    ("brand", "brand:tikkurila", "Tikkurila", "тикурила", 1), ("brand", "brand:tikkurila", "Tikkurila", "tikkurila", 2), ("brand", "brand:dulux", "Dulux", "dulux", 3), ("brand", "brand:x", "X", "двойник", 4),
    ("attribute", "surface", "строганый", "строганный", 1), ("attribute", "surface", "строганый", "строганая", 2), ("attribute", "finish", "матовый", "матовая", 3),
    ("attribute", "color", "белый", "белая", 4), ("attribute", "properties", "влагостойкий", "влагостойкий", 5), ("attribute", "moisture", "сухой", "камерной сушки", 6),
]

GOLDEN = [
    ("краска тикурила", "brand:tikkurila", "type:paint", {}, []),
    ("тикурила краска", "brand:tikkurila", "type:paint", {}, []),
    ("грунтовка DULUX", "brand:dulux", "type:primer", {}, []),
    ("лак для дерева", None, "type:varnish", {}, ["для", "дерева"]),
    ("шпаклёвка 20 кг", None, "type:putty", {"weight_kg": 20.0}, []),
    ("краска неизвестныйбренд", None, "type:paint", {}, ["неизвестныйбренд"]),
    ("латексная краска", None, "type:paint", {}, ["латексная"]),
    ("строганный брус", None, "type:brusok", {"surface": "строганый"}, []),
    ("матовая краска белая 10л", None, "type:paint", {"finish": "матовый", "color": "белый", "volume_l": 10.0}, []),
    ("влагостойкий гипсокартон", None, "type:gypsum_board", {"properties": "влагостойкий"}, []),
    ("доска камерной сушки доска", None, "type:brusok", {"moisture": "сухой"}, []),
    ("двойник", "brand:x", None, {}, []),
    ("", None, None, {}, []),
    (None, None, None, {}, []),
]


@pytest.fixture(scope="module")
def dictionary(spark):
    return alias_dictionary(spark.createDataFrame(ALIASES, ALIAS_SCHEMA))


def parse(spark, dictionary, raws):
    rows = spark.createDataFrame(list(enumerate(raws)), "query_id long, raw string")
    return parse_queries(rows, dictionary)


def test_golden_slots(spark, dictionary):
    got = {r["query_id"]: r for r in parse(spark, dictionary, [g[0] for g in GOLDEN]).collect()}
    for i, (_, brand, kind, attributes, rest) in enumerate(GOLDEN):
        r = got[i]
        assert (r["brand_id"], r["product_type_id"], r["unparsed_tokens"]) == (brand, kind, rest), GOLDEN[i]
        assert {k: v for k, v in r["attributes"].asDict().items() if v is not None} == attributes


ITEMS = [
    ("1", 1, "Краска белая", "T", "brand:tikkurila", "Лакокрасочные", "краски", "type:paint", 9.0),
    ("2", 2, "Краска матовая", "T", "brand:tikkurila", "Лакокрасочные", "краски", "type:paint", None),
    ("3", 3, "Эмаль краска", "D", "brand:dulux", "Сантехника", "краски", "type:paint", 9.0),
    ("4", 4, "Грунт", "T", "brand:tikkurila", "Прочее", "грунт", "type:primer", 5.0),
    ("5", 5, "Лента", None, None, "Прочее", "Малярная лента", None, None),
]


@pytest.fixture(scope="module")
def catalog(spark):
    rows = spark.createDataFrame(ITEMS, "id string, ord long, name string, brand string, brand_id string, category string, subcategory string, product_type_id string, v double")
    none = F.lit(None).cast("string")
    attrs = F.struct(F.lit(None).cast("double").alias("weight_kg"), F.col("v").alias("volume_l"), *[none.alias(k) for k in ("surface", "moisture", "finish", "properties", "color")])
    return rows.withColumn("attributes", attrs).drop("v").withColumn("price", F.lit(10.0))


def found(spark, dictionary, catalog, raw, **options):
    out = search.search(parse(spark, dictionary, [raw]), catalog, **options).orderBy("rank").collect()
    return [r["c"]["id"] for r in out], out


def test_amount_passes_null_until_exact(spark, dictionary, catalog):
    assert found(spark, dictionary, catalog, "краска тикурила 9 л")[0] == ["1"]
    assert found(spark, dictionary, catalog, "краска тикурила 7 л")[0] == ["2"]


def test_relaxation(spark, dictionary, catalog):
    ids, rows = found(spark, dictionary, catalog, "грунтовка dulux")
    assert ids == ["3"] and rows[0]["tier"] == 2
    assert found(spark, dictionary, catalog, "грунтовка dulux", relax_on_empty=False)[0] == []
    ids, rows = found(spark, dictionary, catalog, "краска двойник")
    assert ids == ["1", "2", "3"] and rows[0]["tier"] == 3


def test_rank_by_category_and_stable_ties(spark, dictionary, catalog):
    assert found(spark, dictionary, catalog, "краска")[0] == ["1", "2", "3"]
    assert found(spark, dictionary, catalog, "краска мат")[0] == ["2", "1", "3"]


def test_partitions_do_not_matter(spark, dictionary, catalog):
    assert found(spark, dictionary, catalog.repartition(7), "краска")[0] == ["1", "2", "3"]


def test_complements(spark, catalog):
    edges = spark.createDataFrame(
        [("type:paint", "PREPARE_WITH", "type:primer", "r", "approved", 1), ("type:paint", "USE_WITH", "type:tape", "r", "approved", 2), ("type:paint", "FASTEN_WITH", "type:none", "r", "approved", 3), ("type:paint", "USE_WITH", "type:primer", "r", "rejected", 4)],
        "source string, relation string, target string, rationale string, review_status string, edge_ord int",
    )
    nodes = spark.createDataFrame([("type:primer", "грунтовка", ["грунт"]), ("type:tape", "лента", ["малярная"])], "id string, label string, contains_any array<string>")
    out = graph.complements(spark.createDataFrame([(1, "type:paint")], "query_id long, product_type_id string"), edges, nodes, catalog).orderBy("edge_ord").collect()
    assert [(r["products"], r["data_gap"], r["title"]) for r in out] == [(["4"], False, "Для подготовки: грунтовки"), (["5"], False, "Используется с: ленти"), ([], True, "Рекомендуется: type:noneы")]


def test_legacy(spark, catalog):
    q = spark.createDataFrame([(1, "матовая краска"), (2, "для и"), (3, None), (4, "zzz")], "query_id long, raw string")
    out = legacy.keyword_search(q, catalog).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"], r["score"]) for r in out][:1] == [(1, "2", 30)]
    assert {r["query_id"] for r in out} == {1}


@pytest.mark.parametrize(("score", "margin", "trusted", "kind", "status"), [(0.9, 0.1, True, "brand", "resolved"), (0.9, 0.01, True, "brand", "ambiguous"), (0.5, 0.4, True, "brand", "suggestion"), (0.95, 0.2, True, "product_name", "suggestion"), (0.9, 0.1, False, "brand", "suggestion")])
def test_decisions(spark, score, margin, trusted, kind, status):
    row = spark.createDataFrame([(kind, score, margin, trusted)], "entity_type string, score double, margin double, trusted boolean").join(resolve.policy_table(spark.range(1)), "entity_type")
    assert row.select(resolve.decide(*[F.col(c) for c in ("score", "margin", "trusted", "least_score", "least_margin", "alone")])[0]).first()[0] == status


SLOTS = "query_id string, brand_id string, brand_display string, product_type_id string, product_type_display string, unparsed_tokens array<string>"
RESOLVED = f"query_id string, text string, entity_type string, status string, entity_id string, display string, score double, reason string, candidates array<{resolve.CANDIDATE}>"
GOODS = "id string, name string, brand string, brand_id string, subcategory string, product_type_id string"


def _resolution(query, text, kind, status, entity=None, score=None, candidates=()):
    return (query, text, kind, status, entity, entity, score, "", [(e, e, s, None, c, None) for e, s, c in candidates])


def _routed(spark, queries, resolutions, goods, mode="apply"):
    parsed = spark.createDataFrame([(q, None, None, None, None, words) for q, words in queries], SLOTS)
    out = resolve.route(parsed, spark.createDataFrame(resolutions, RESOLVED), spark.createDataFrame(goods, GOODS), mode)
    return {r["query_id"]: r for r in out.collect()}


def test_routing(spark):
    goods = [("1", "x", "T", "brand:tikkurila", "краски", "type:paint")]
    words = ["краскк", "тикула", "краскк"]
    paint, near = _resolution("a", "краскк", "product_type", "resolved", "type:paint", 0.9), ("brand:gone", 0.9, 0.9)
    rows = [paint, _resolution("a", "тикула", "brand", "suggestion", None, 0.85, [near, ("brand:tikkurila", 0.85, 0.8)])]
    rows += [("b", *paint[1:]), _resolution("b", "тикула", "brand", "suggestion", None, 0.68, [("brand:tikkurila", 0.68, 0.9)])]
    rows += [_resolution("c", "тикула", "brand", "suggestion", None, 0.68, [near]), _resolution("c", "краскк", "product_type", "ambiguous", None, 0.7, [("type:none", 0.9, 0.9)])]
    queries = [(q, words) for q in "abcd"]
    got = _routed(spark, queries, rows, goods)
    assert (got["a"]["brand_id"], got["a"]["product_type_id"], got["a"]["unparsed_tokens"], got["a"]["resolver_status"]) == ("brand:tikkurila", "type:paint", [], "resolved+best_effort")
    assert (got["b"]["brand_id"], got["b"]["unparsed_tokens"], got["b"]["resolver_status"]) == (None, ["тикула"], "resolved")
    assert (got["c"]["product_type_id"], got["c"]["resolver_status"], got["d"]["resolver_status"]) == (None, "ambiguous", "not_needed")
    shadow = _routed(spark, queries, rows, goods, "shadow")
    assert shadow["a"]["brand_id"] is None and shadow["a"]["resolver_status"] == "resolved+best_effort+resolved"
    assert {r["resolver_status"] for r in _routed(spark, queries, rows, goods, "off").values()} == {"not_needed"}


def test_phrase_first(spark):
    goods = [("7", "Масло Терас", "V", "brand:v", "масла", "type:oil"), ("8", "x", None, None, None, None)]
    words = ["масло", "валти", "терас"]
    rows = [_resolution("a", " ".join(words), "product_name", "suggestion", None, 0.8, [("7", 0.8, 0.6)]), _resolution("a", "масло", "product_type", "resolved", "type:oil", 1.0)]
    rows += [_resolution("b", "масло", "product_name", "suggestion", None, 0.8, [("9", 0.9, 0.9), ("8", 0.8, 0.6)]), _resolution("b", "терас", "brand", "exact", "brand:v", 1.0)]
    got = _routed(spark, [("a", words), ("b", words)], rows, goods)
    assert tuple(got["a"][c] for c in ("product_id", "brand_id", "product_type_id", "product_type_display", "unparsed_tokens", "resolver_status")) == ("7", "brand:v", "type:oil", "масла", [], "best_effort")
    # a product without a brand takes no other brand than its own
    assert tuple(got["b"][c] for c in ("product_id", "brand_id", "unparsed_tokens")) == ("8", None, ["валти", "терас"])


def test_index_reasons():
    good = {"status": "building", "model": "m", "catalog_sha256": "c"}
    assert resolve.index_reason(True, good, {"model": "m", "catalog_sha256": "c"}) is None
    assert resolve.index_reason(False, good, {}) == "feature_disabled"
    assert resolve.index_reason(True, None, {}) == "index_missing"
    assert resolve.index_reason(True, good, {"model": "n"}) == "model_index_mismatch"
    assert resolve.index_reason(True, good, {"model": "m", "catalog_sha256": "d"}) == "stale_catalog_index"


def test_greedy_dedup_matches_a_loop(spark):
    rows = [(i, f"s{i * 7 % 5}" if i % 4 else "", f"u{i * 5 % 7}/") for i in range(40)]
    seen_s, seen_u, want = set(), set(), []
    for i, s, u in rows:
        if (s and s in seen_s) or u in seen_u:
            continue
        want.append(i)
        seen_s |= {s} if s else set()
        seen_u.add(u)
    got = canonical.first_of_each(spark.createDataFrame(rows, "ord long, sku string, url string")).select("ord").collect()
    assert sorted(r[0] for r in got) == want


def test_type_rules(spark):
    rows = [("Краска белая", "краски", "ЛКМ", "type:paint"), ("Труба покрытие эмаль", "трубы", "инженерная сантехника", "type:plumbing"), ("Валик", "инструмент", "ручной инструмент, спецодежда", "type:tool"), ("Саморез по брусу", "", "", "type:fastener"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "n string, s string, c string, want string")
    for r in df.select("want", canonical.type_by_rule(F.col("n"), F.col("s"), F.col("c")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_product_page(spark):
    html = '<meta itemprop="name" content="Краска &amp; лак"><meta itemprop="category" content="краски/фасад"><span class="vendorL">0112116</span><meta itemprop="price" content="306"><img itemprop="image" src="/i.jpg">'
    pages = spark.createDataFrame([("https://shop.example/catalog/a/b/", html), ("https://shop.example/catalog/", "<h1>категория</h1>"), ("x", None)], "url string, html string")
    rows = ingest.parse_products(pages).collect()
    assert [(r["name"], r["sku"], r["price"], r["category"], r["subcategory"], r["image"]) for r in rows] == [("Краска & лак", "0112116", 306.0, "Краски", "Фасад", "https://shop.example/i.jpg")]


def test_sitemap_and_leaves(spark):
    urls = ingest.sitemap_urls(spark.createDataFrame([("<urlset><url><loc>https://shop.example/catalog/a/</loc></url><broken>",)], "payload string"))
    assert [r["url"] for r in urls.collect()] == ["https://shop.example/catalog/a/"]
    paths = spark.createDataFrame([(i, f"https://x.example/{p}") for i, p in enumerate(["catalog/", "catalog/a/", "catalog/a/1", "catalog/ab", "catalog/a/1/"])], "ord long, url string")
    assert sorted(r["ord"] for r in ingest.leaf_urls(paths).collect()) == [2, 3, 4]


def test_chat_validation(spark):
    rows = [(1, 0, "user", "привет"), (2, 0, "system", "x"), (3, 0, "user", "a" * 401), (4, 0, "assistant", "x"), (5, 0, "user", " "), (6, 0, "user", None)]
    got = {r[0]: r[1] for r in chat.validate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: None, 2: "bad_role", 3: "user_text_too_long", 4: "no_user_message", 5: "no_user_message", 6: "bad_text"}


def test_reply_blocks(spark):
    items = [("1", "Краска А", "s-100"), ("2", "Лак Б", "s-200"), ("3", "Грунт", "ab"), ("4", None, None)]
    texts = {
        "a": "Возьмите Краска А: [id:1] и s-200. Потом [id:1] [id:9]",
        "b": "[compare:1|раз] [compare:2|  ] [compare:2|два] [compare:1|три] [compare_result: итог]",
        "c": "[compare_result: x]",
        "d": "Вот:\n\n[id:77] всё",
        "e": None,
        "f": "ГРУНТ и лак б",
    }
    replies = spark.createDataFrame([(m, t, items) for m, t in texts.items()], "msg_id string, text string, products array<struct<id:string,name:string,sku:string>>")
    got = {}
    for r in chat.content_blocks(replies).orderBy("msg_id", "block_no").collect():
        got.setdefault(r["msg_id"], []).append((r["type"], r["text"], r["product_id"]))
    assert got["a"] == [("text", "Возьмите", None), ("product", None, "1"), ("text", "и s-200", None), ("product", None, "2"), ("text", ". Потом", None)]
    assert got["b"] == [("comparison_item", "раз", "1"), ("comparison_item", "два", "2"), ("comparison_analysis", "итог", None)]
    assert got["d"] == [("text", "всё", None)] and "c" not in got and "e" not in got
    assert got["f"] == [("product", None, "3"), ("text", "и", None), ("product", None, "2")]
    few = chat.content_blocks(replies, 1).filter("msg_id = 'a' AND type = 'product'").collect()
    assert [r["product_id"] for r in few] == ["1"]


def test_page_versions_keep_their_stamps(spark):
    page = lambda price: f'<meta itemprop="name" content="A"><meta itemprop="category" content="x/y"><span class="vendorL">1</span><meta itemprop="price" content="{price}">'
    rows = [("https://s/1", page(10), "t1", 1), ("https://s/1", page(20), "t2", 2)]
    for order in (rows, rows[::-1]):
        staged = streaming.staged_products(spark.createDataFrame(order, streaming.PAGES), "s").collect()
        assert [(r["price"], r["seq"], r["retrieved_at"]) for r in staged] == [(20.0, 2, "t2")]


def test_long_phrases(spark):
    words = [f"w{i}" for i in range(12)]
    entries = aliases.alias_dictionary(spark.createDataFrame([("brand", "b", "B", " ".join(words), 1), ("brand", "c", "C", "w1 w2", 2)], aliases.ALIAS_SCHEMA))
    got = parse_queries(spark.createDataFrame([(1, "x " + " ".join(words) + " y")], "query_id long, raw string"), entries).first()
    assert (got["brand_id"], got["unparsed_tokens"]) == ("b", ["x", "y"])


def test_greedy_dedup_takes_as_many_rounds_as_needed(spark):
    rows = [(i, f"s{i // 2}", f"u{(i + 1) // 2}") for i in range(16)]
    kept = sorted(r["ord"] for r in canonical.first_of_each(spark.createDataFrame(rows, "ord long, sku string, url string")).collect())
    assert kept == list(range(0, 16, 2))


def test_safe_addresses(spark):
    rows = spark.createDataFrame([("https://shop.example/a",), ("http://shop.example/a",), ("https://evil.example/a",), (None,), ("not a url",)], "u string")
    assert [r[0] for r in rows.select(respond.safe_url(F.col("u"))).collect()] == ["https://shop.example/a", "", "", "", ""]
    prices = spark.createDataFrame([(306.0,), (0.5,), (None,)], "p double")
    assert [r[0] for r in prices.select(respond.shown_price(F.col("p"))).collect()] == ["306", "0.5", None]


def test_missing_json_is_empty(spark, tmp_path):
    assert tables.read_json(spark, f"file://{tmp_path}/none.json", "a long").count() == 0
    (tmp_path / "x.json").write_text('﻿[{"a": 1}, {"a": 2}]', encoding="utf-8")
    assert sorted(r[0] for r in tables.read_json(spark, f"file://{tmp_path}/x.json", "a long").collect()) == [1, 2]


def test_publish_keeps_a_whole_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.publish(spark.range(3), path)
    old = tables.read_published(spark, path)
    tables.publish(spark.range(5), path)
    assert old.count() == 3 and tables.read_published(spark, path).count() == 5


def test_engine(spark, dictionary, catalog):
    edges = spark.createDataFrame([("type:paint", "PREPARE_WITH", "type:primer", "r", "approved", 1)], "source string, relation string, target string, rationale string, review_status string, edge_ord int")
    nodes = spark.createDataFrame([("type:primer", "грунтовка", ["грунт"])], "id string, label string, contains_any array<string>")
    engine = Engine(catalog, dictionary, edges, nodes)
    out = engine.search_json(spark, "краска тикурила 9 л")
    assert [p["id"] for p in out["primary"]["products"]] == ["1"] and out["primary"]["title"] == "Найденные краски Tikkurila"
    assert [p["id"] for p in out["complements"][0]["products"]] == ["4"]
    assert not out["meta"]["fallback_used"]
    relaxed = engine.search_json(spark, "грунтовка dulux")
    assert [p["id"] for p in relaxed["primary"]["products"]] == ["3"] and relaxed["complements"] == []
    assert engine.search_json(spark, "лента")["meta"]["strategy"] == "legacy_fallback"
    forced = engine.search_json(spark, "краска", force_legacy=True)
    assert forced["meta"]["fallback_used"] and len(forced["primary"]["products"]) == 3


def test_engine_resolves_typos(spark, dictionary, catalog):
    names = [("brand", "brand:tikkurila", "Tikkurila", "тикурила", 1, [1.0, 0.0]), ("product_type", "type:paint", "краска", "краска", 1, [0.0, 1.0])]
    index = spark.createDataFrame(names, "entity_type string, entity_id string, display string, normalized_phrase string, trusted int, vector array<double>")
    embed = lambda spans: spans.withColumn("vector", F.when(F.col("text").startswith("тик"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    none = spark.createDataFrame([], "source string, relation string, target string, rationale string, review_status string, edge_ord int")
    nodes = spark.createDataFrame([], "id string, label string, contains_any array<string>")
    engine = Engine(catalog, dictionary, none, nodes, index, embed)
    query = spark.createDataFrame([(1, "тикурилла краскка")], "query_id long, raw string")
    row = engine.parse(query).first()
    assert (row["brand_id"], row["product_type_id"], row["unparsed_tokens"]) == ("brand:tikkurila", "type:paint", [])
    shadow = engine.parse(query, "shadow").first()
    assert shadow["brand_id"] is None and shadow["resolver_status"] != "not_needed"
    assert engine.parse(query, "off").first()["resolver_status"] == "not_needed"


SF = "/root/testdata/sf0.01"


def test_replies_hold_every_product(spark, tmp_path):
    spark.read.parquet(f"{SF}/part.parquet").filter("p_partkey <= 210").write.parquet(f"file://{tmp_path}/part.parquet")
    blocks = data_queries.h05_content_blocks(spark, f"file://{tmp_path}").collect()
    shown = [r["product_id"] for r in blocks if r["type"] == "product"]
    assert sorted(shown, key=int) == [str(i) for i in range(211)]
    assert {r["msg_id"] for r in blocks} == {str(i) for i in range(22)}
    grouped = data_queries.h06_grouped_blocks(spark, f"file://{tmp_path}").filter("type = 'product_group'").collect()
    assert sum(len(r["products"].split(",")) for r in grouped) == 211


def test_spans_are_searched_in_every_vector(spark):
    rows = search_queries.r07_resolve(spark, SF).collect()
    assert len(rows) == 25 and all(r["score"] >= resolve.WEIGHTS["embedding"] for r in rows)  # each finds at least itself


@pytest.mark.parametrize("blocks", [{}, {"PHRASES": 40, "SPANS": 16, "ROWS": 8, "FIRST": 4, "SIGNS": 6}])
def test_ranking_needs_few_pairs(spark, monkeypatch, blocks):
    for name, value in blocks.items():
        monkeypatch.setattr(nearest, name, value)
    # words with and without Cyrillic letters, vectors of two sizes, equal scores, gaps and no numbers
    word = "concat(elt(1 + id % 4, 'paint ', 'краска ', 'щит', 'v'), conv(id * 7919 % 4096, 10, 4))"
    vector = "CASE WHEN id % 97 = 5 THEN NULL WHEN id % 89 = 7 THEN array(DOUBLE('NaN'), 1D) WHEN id % 83 = 11 THEN array(NULL, 1D) WHEN id % 9 = 2 THEN array(0.6D, 0.8D, 0D) ELSE array(sin(id * id), cos(id * id)) END"
    kind = "elt(1 + id % 3, 'brand', 'product_type', 'product_name')"
    index = spark.sql(
        f"""SELECT {kind} AS entity_type, IF(id % 61 = 3, NULL, concat('e', id % 3 * 100 + id % 7)) AS entity_id, concat('d', id) AS display,
        IF(id % 71 = 4, NULL, {word}) AS normalized_phrase, 1 AS trusted, {vector} AS vector FROM range(900)"""
    ).localCheckpoint()
    spans = spark.sql(f"SELECT id AS span_id, {kind} AS entity_type, {word} AS phrase, {vector} AS vector FROM range(1000, 1120)").localCheckpoint()
    every = resolve.similarity(spans, index)
    few = resolve.blended(nearest.best_pairs(spans, index, 3))
    ranked = [sorted(map(str, resolve.rank_entities(resolve.best_per_entity(s), 3).collect())) for s in (every, few)]
    assert ranked[0] == ranked[1] and len(ranked[0]) > 100
    assert few.exceptAll(every).count() == 0
    assert blocks or few.count() < every.count() / 10
    assert nearest.best_pairs(spans.limit(0), index, 3).count() == 0 == nearest.best_pairs(spans, index.limit(0), 3).count()


def test_vectors_of_any_length(spark):
    """Bounds hold for long vectors, whose products are far from exact, and for endless ones."""
    big = [[3e9, 1.0, -3e9], [1e200, 1e200, 1.0], [float("inf"), 1.0, 0.0], [1e-9, 0.5, 1e-9], [0.0, 0.0, 0.0], []]
    index = spark.createDataFrame([("brand", f"e{i % 9}", f"d{i}", f"long phrase {i}", 1, big[i % 6]) for i in range(120)], "entity_type string, entity_id string, display string, normalized_phrase string, trusted int, vector array<double>")
    spans = spark.createDataFrame([(i, "brand", f"phrase {i * 3}", big[i % 6]) for i in range(12)], "span_id long, entity_type string, phrase string, vector array<double>")
    ranked = [sorted(map(str, resolve.rank_entities(resolve.best_per_entity(s)).collect())) for s in (resolve.similarity(spans, index), resolve.blended(nearest.best_pairs(spans, index, 5)))]
    assert ranked[0] == ranked[1] and ranked[0]


def test_resolver_shuffles_no_type_into_one_task(spark):
    """The search of r07 deals a type's pairs to many tasks."""
    index = spark.sql("SELECT 'brand' AS entity_type, concat('e', id % 5) AS entity_id, 'd' AS display, concat('v', id) AS normalized_phrase, 1 AS trusted, array(sin(id), cos(id)) AS vector FROM range(20000)")
    spans = spark.sql("SELECT id AS span_id, 'brand' AS entity_type, concat('q', id) AS phrase, array(sin(id + 0.5), cos(id + 0.5)) AS vector FROM range(1000)")
    assert nearest._blocks(spans, index) == {"brand": (8, 3)}
    pairs = nearest.best_pairs(spans, index, 5)
    used = pairs.withColumn("task", F.spark_partition_id()).agg(F.countDistinct("task")).first()[0]
    assert used > 8 and pairs.count() < 1000 * 20000 / 100


def test_route_finds_product_names(spark, monkeypatch):
    monkeypatch.setattr(search_queries, "_TYPED", ((1, "hott widgget thing"), (2, "gear")))
    rows = {r["query_id"]: r for r in search_queries.r17_route(spark, "/root/testdata/sf0.001").collect()}
    names = {str(r["p_partkey"]): r["p_name"] for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    assert names[rows["1"]["product_id"]].split()[1] == "widget" and rows["1"]["product_type_id"] == "type:widget"
    assert rows["1"]["residual"] == "" and rows["2"]["product_id"] is None
