"""Row operators: chat, quality, language, decontamination, sharding, licenses, mixing, pipeline."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marlstone.llm import chat, decontaminate, language, licenses, mixing, queries, quality, sharding

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(found.fetchall())


# chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<|\\im_startend>%a\n", max_size=30), st.text(alphabet="<|\\im_startend>%a\n ", max_size=60)), max_size=4))
def test_template_round_trip(turns):
    text, _ = chat.format_window(turns, 0)
    assert chat.parse(text) == turns


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=20), st.booleans(), st.integers(10, 80), st.integers(0, 40))
def test_windows_cover_turns_once(tokens, system, budget, history):
    plan = list(chat.plan_windows(tokens, system, budget, history))
    if system and len(tokens) == 1:
        assert plan == [(0, 0, 1)]
        return
    first = 1 if system else 0
    assert [i for _, at, end in plan for i in range(at, end)] == list(range(first, len(tokens)))
    for back, at, end in plan:
        assert first <= back <= at < end and sum(tokens[back:at]) <= history
        size = sum(tokens[back:end]) + (tokens[0] if system else 0)
        assert size <= budget or (end == at + 1 and back == at)


def test_chats_read_back(spark):
    rng = random.Random(1)
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 12)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant"])
            rows.append((c, t, role, rng.choice(["", None, "<|im_end|>", "a\\|b <\\|x", "long " * rng.randint(1, 400)])))
    rows += [(None, 0, "user", "x"), (50, 1, None, "y"), (51, 0, "assistant", "same"), (51, 0, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df, 200, 50)).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for k, _, r, t in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        said = "".join(t for r, t in turns if r == "assistant")
        g = got[c]
        assert (g["n_turns"], g["loss_chars"]) == (len(turns), len(said))
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert g["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(none)).count() == 0


# quality


def test_quality_edges(spark):
    good = "\n".join(" ".join(f"word{i}{c}" for c in "abcdefg") + ", and so it ends." for i in range(12))
    menu = "\n".join(["Home | About | Contact | Login | Search"] * 1 + ["Alpha%d | Beta | Gamma | Delta" % i for i in range(20)])
    rows = [(1, good), (2, None), (3, ""), (4, "a b c " * 100), (5, menu + "\nOne line of text."), (6, good + "\nAll rights reserved."), (7, "x\n\nx\n y"), (8, "\U0001d54f# é\x0b*"), (9, "w " * 60)]
    out = {r["doc_id"]: r for r in quality.clean_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))).collect()}
    assert out[1]["kept"] and out[1]["n_bad_lines"] == 0 and out[1]["clean_text"] == good
    for k in (2, 3):
        assert (out[k]["n_words"], out[k]["word_chars"], out[k]["n_dup_lines"], out[k]["base_failed"], out[k]["kept"]) == (0, 0, 0, True, False)
    marks = ["слово " * 16, "café word " + "word " * 14, "plain word " * 8]  # no mark in any script
    bars = "\n".join([f"abcdefghi{i} abcdefghij |abcdefghij, |abcdefghij x" for i in range(15)] + [good])
    more = [(i, good + "\n" + m) for i, m in enumerate([*marks, marks[0].strip() + "."])] + [(9, bars)]
    got = {r["doc_id"]: r["n_bad_lines"] for r in quality.clean_documents(spark.createDataFrame(more, "doc_id long, text string")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0, 9: 0}
    assert out[4]["n_repeat_words"] == 300 and out[4]["base_failed"]
    assert not out[5]["kept"] and out[5]["lost_too_much"]
    assert out[6]["kept"] and out[6]["n_bad_lines"] == 1 and out[6]["clean_text"] == good
    assert (out[7]["n_dup_lines"], out[7]["n_words"]) == (1, 3)
    assert (out[8]["word_chars"], out[8]["n_symbols"], out[8]["n_words"]) == (4, 2, 3)
    assert quality.clean_documents(spark.createDataFrame([], "text string")).count() == 0


def test_quality_of_odd_scripts_equals_sql(spark):
    rng = random.Random(11)
    parts = ["слово", "été", "word", "|", "»", " | ", "\t|", "-", ".", "!", "{", "\u00a0", "\u0085", "é", "١٢", "\n", "\n", "_", "x", "Home", "menu", "·"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice([" ", " ", "", "\t"]) for _ in range(rng.randint(0, 160)))) for i in range(150)]
    rows += [(900 + i, " ".join(rng.choice(["слово", "café", "word"]) for _ in range(60)) + rng.choice(["", ".", "»"])) for i in range(20)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.execute(quality.SQL)
    columns = [d[0] for d in found.description]
    got = quality.clean_documents(spark.createDataFrame(rows, "doc_id long, text string")).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c dd".split()), max_size=40), min_size=1, max_size=8))
def test_repeated_words(spark, docs):
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, d in enumerate(docs):
        grams = [tuple(d[k : k + 3]) for k in range(len(d) - 2)]
        assert got[i] == len({k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)})


# language


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    found = language.op4_byte_network(spark, SF).join(docs, "doc_id").filter("held_out").collect()
    assert len(found) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edges(spark):
    net = language.learn(spark.read.parquet(f"{SF}/documents.parquet"), texts=200)
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the and of " * 9000), (5, "é")]
    out = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")), net).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[1]["score"] == 0
    assert out[4]["lang_pred"] == "en" and out[5]["lang_pred"] in net.languages
    assert language.learn(spark.createDataFrame([], "doc_id long, text string, lang string")) is None
    nothing = language.identify(spark.createDataFrame(rows, "doc_id long, text string"), None)
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_languages_beyond_the_sample(spark):
    """More labels than rows are learned from: no error, and only learned ones are predicted."""
    rows = [(i, f"l{i}", "some words " * 9) for i in range(60)] + [(99, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    net = language.learn(docs, texts=20)
    assert 1 <= len(net.languages) <= 20
    assert {r["lang_pred"] for r in language.identify(docs, net).collect()} <= set(net.languages)


def test_stage_rejects_what_no_language_claims(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert language.language_stage(spark, docs, SMALL).count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
    monkeypatch.setattr(language, "OVER_CHANCE", 5)
    assert language.language_stage(spark, docs, SMALL).count() == 0


def test_step_follows_the_gradient():
    """One step of the training moves every weight against the slope that finite differences give."""
    rng = np.random.default_rng(3)
    windows, labels = rng.integers(97, 110, (6, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 0])
    languages = ["a", "b", "c"]
    start = language.ByteNet.start(languages, 5)
    weight = len(labels) / np.bincount(labels) / 3

    def loss(net):
        return -(np.log(net.probabilities(windows)[np.arange(6), labels]) * weight[labels]).mean()

    moved = language.train(windows, labels, languages, seed=5, epochs=1, batch=6, rate=1e-3)
    for name in ("embed", "filters", "shift", "out", "bias"):
        a, b = getattr(start, name), getattr(moved, name)
        step = (b - a).reshape(-1)
        places = np.argsort(-np.abs(step), kind="stable")[:200]
        checked = 0
        for i in rng.permutation(places)[:25]:
            slopes = []
            for h in (1e-3, 4e-3):
                ends = []
                for sign in (h, -h):
                    net = language.ByteNet.start(languages, 5)
                    for k in ("embed", "filters", "shift", "out", "bias"):
                        setattr(net, k, getattr(net, k).astype(np.float64))
                    getattr(net, name).reshape(-1)[i] += sign
                    ends.append(loss(net))
                slopes.append((ends[0] - ends[1]) / (2 * h))
            if min(abs(x) for x in slopes) > 1e-4 and slopes[0] * slopes[1] > 0:  # no kink of the maximum between
                assert np.sign(step[i]) == -np.sign(slopes[0]), (name, i)
                checked += 1
        assert checked >= min(3, len(step)), name


def test_training_separates():
    rng = np.random.default_rng(0)
    windows = rng.integers(97, 101, (60, language.WINDOW)).astype(np.uint8)
    labels = rng.integers(0, 2, 60)
    windows[labels == 1, 5:9] = 120
    net = language.train(windows, labels, ["a", "b"], epochs=30)
    assert (net.probabilities(windows).argmax(axis=1) == labels).mean() > 0.95


# decontamination


def brute_hits(docs, items, length=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), length)
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, met = set(), set()
        for i in range(len(w)):
            for n in {len(k) for k in windows}:
                if tuple(w[i : i + n]) in windows and i + n <= len(w):
                    hit |= set(range(i, i + n))
                    met |= windows[tuple(w[i : i + n])]
        out[doc] = (len(w), len(hit), sorted(met))
    return out


@pytest.mark.parametrize("bound", [10**6, 0])
def test_contamination(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", bound)
    rng = random.Random(2)
    vocabulary = ["a", "B", "c1", "é", "d"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 2, 3, 14, 20])))) for i in range(12)] + [(99, None), (10, "a, a; É")]
    docs = []
    for i in range(40):
        mixed = " ".join(rng.choice([*vocabulary, "x", "y", "z"]) for _ in range(rng.randint(0, 30)))
        docs.append((i, mixed + "... " + (rng.choice(items)[1] or "") + "!"))
    docs += [(100, None), (101, ""), (5, docs[5][1])]
    want = brute_hits(docs, items)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit(3))
    out = decontaminate.contamination(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(out) == len(docs)
    for r in out:
        assert (r["n_words"], r["n_hit"], list(r["item_ids"])) == want[r["doc_id"]], r["doc_id"]
    empty = decontaminate.contamination(table, spark.createDataFrame([], "item_id long, text string"))
    assert {r["n_hit"] for r in empty.collect()} == {0}


def test_span_removal(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, f"Before, {item.title()}; after."), (2, "clean text"), (3, None)], "doc_id long, text string")
    out = decontaminate.remove_spans(decontaminate.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")))
    got = {r["doc_id"]: r["clean_text"] for r in out.collect()}
    assert got[1].startswith("Before,") and got[1].endswith("; after.") and "three" not in got[1].lower()
    assert got[2] == "clean text" and got[3] is None


# sharding


def test_repeated_rows_get_slots(spark, monkeypatch):
    """A row that makes up most of the table: every copy has a slot, shards have no gaps."""
    df = spark.range(400).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("doc_id"), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    out = sharding.shard_records(df, weights=(1.0,) * 3, rows_per_bin=20, grown=True).collect()
    assert sorted(r["doc_id"] for r in out) == sorted([7] * 300 + list(range(300, 400)))
    for s in range(3):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert all(r["grown_shard"] in (r["shard"], 3) for r in out)


def test_rows_are_named_apart(spark):
    from marlstone.llm.windows import row_keys, row_names

    rows = spark.createDataFrame([("a", None), (None, "a"), (None, None), ("", ""), ("\x00null", ""), (None, "")], "x string, y string")
    for f in (lambda: row_names(rows), lambda: row_keys(F.col("x"), F.col("y"))):
        assert rows.select(*f()).distinct().count() == 6


def test_sharding(spark):
    out = sharding.op7_rendezvous_sharding(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(out) == docs
    for r in out:
        scores = [int(hashlib.md5(f"{r['doc_id']}:{s}".encode()).hexdigest()[:13], 16) for s in range(17)]
        assert r["shard"] == max(range(16), key=lambda s: scores[s]) and r["grown_shard"] == max(range(17), key=lambda s: scores[s])
    for s in range(16):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_weighted_and_odd_keys(spark):
    rows = spark.range(6000).select(sharding.rendezvous(F.col("id").cast("string"), (1.0, 2.0, 3.0)).alias("s")).groupBy("s").count().collect()
    share = {r["s"]: r["count"] / 6000 for r in rows}
    assert abs(share[0] - 1 / 6) < 0.03 and abs(share[2] - 1 / 2) < 0.03
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b"), (1, None)], "doc_id long, text string").withColumn("slot", F.lit(7))
    got = sharding.shard_records(odd).collect()
    assert len(got) == 5 and len({(r["shard"], r["slot"]) for r in got}) == 5
    assert sharding.shard_records(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="positive"):
        sharding.rendezvous(F.lit("x"), (1.0, 0.0))


# licenses


def test_license_phrases_and_passages(spark):
    mit, bsd = licenses.TEMPLATES[0][1], licenses.TEMPLATES[3][1]
    worn = bsd.replace("with or without modification", "with or without any modification").replace("source code", "source")
    rows = [
        (1, "Released Under the MIT License. under the mit license, and CC-BY-NC"), (2, "Apache License, Version 2.0"), (3, mit), (4, "x " * 500 + worn + " y" * 50), (5, "under the mit licenses apache license version 3"),
        (6, None), (7, ""), (8, " ".join(mit.split()[:10])), (1, "Released Under the MIT License. under the mit license, and CC-BY-NC"),
    ]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["labels"], got[1]["score"]) == (3, 1, 10, "cc-by-nc,mit", "cc-by-nc,mit", 1.0)
    assert (got[2]["n_base"], got[2]["base_labels"]) == (1, "apache-2")
    assert (got[3]["n_base"], got[3]["labels"], got[3]["score"]) == (0, "mit", 1.0)
    assert got[4]["labels"] == "bsd" and 0.6 <= got[4]["score"] < 1
    for k in (5, 6, 7, 8):
        assert (got[k]["n_base"], got[k]["labels"], got[k]["score"], got[k]["first_word"]) == (0, "", 0.0, None)


def test_base_places_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = "under the mit license apache version 2 cc by nc".split()
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 400)))) for i in range(60)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        w = t.split()
        places = [(k, label) for label, p in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert got[i]["n_base"] == len(places)
        assert got[i]["base_labels"] == ",".join(sorted({label for _, label in places}))
        if places:
            assert (got[i]["first_word"], got[i]["last_word"]) == (min(places)[0], max(places)[0])


# mixing


def test_water_fill():
    assert mixing.water_fill({"a": 100, "b": 100}, {"a": 5, "b": 1}, 200, 3) == pytest.approx({"a": 500 / 3, "b": 100 / 3})
    got = mixing.water_fill({"a": 10, "b": 100, "c": 90}, {"a": 5, "b": 2, "c": 1}, 200, 3)
    assert got["a"] == 30 and got["b"] == pytest.approx(170 * 2 / 3) and sum(got.values()) == pytest.approx(200)
    assert mixing.water_fill({"a": 0}, {"a": 1}, 0, 3) == {"a": 0}


def test_flow_is_cheapest():
    flow = mixing.cheapest_routes({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 10}, 3)
    assert sum(v for (_, s), v in flow.items() if s == "a") == 20 and sum(v for (_, s), v in flow.items() if s == "b") == 10
    assert all(sum(v for (p, _), v in flow.items() if p == q) <= 10 for q in (("a",), ("a", "b"), ("b",)))  # nothing is repeated where all can be met once


def test_flow_against_every_choice():
    """Small overlapping sources: as much as any choice of routes can bring, and no choice is cheaper."""
    rng = random.Random(9)
    sources = ["a", "b", "c"]
    every = [(s,) for s in sources] + [("a", "b"), ("b", "c"), ("a", "b", "c")]
    for _ in range(25):
        capacity = {p: rng.randint(1, 3) for p in rng.sample(every, 3)}
        quota = {s: rng.randint(0, 4) for s in sources}
        routes = [(p, s) for p in capacity for s in p]
        best = None

        def cost(used, capacity=capacity):
            return sum(sum(i // capacity[p] for i in range(n)) for p, n in used.items())

        def walk(i, left, used):
            nonlocal best
            if i == len(routes):
                got = (-sum(used.values()), cost(used))
                best = got if best is None else min(best, got)
                return
            p, s = routes[i]
            for n in range(min(left[s], 2 * capacity[p] - used[p]) + 1):
                walk(i + 1, left | {s: left[s] - n}, used | {p: used[p] + n})

        walk(0, dict(quota), dict.fromkeys(capacity, 0))
        for flow in (mixing.cheapest_routes(capacity, quota, 2), mixing.plan_flow(capacity, quota, 2)):
            used = {p: sum(v for (q, _), v in flow.items() if q == p) for p in capacity}
            assert all(sum(v for (_, t), v in flow.items() if t == s) <= quota[s] for s in sources)
            assert (-sum(used.values()), cost(used)) == best


def test_overlapping_sources_are_mixed(spark):
    """Documents that several sources share are met once for each token before any is met again."""
    rows = [(i, ["a"] if i < 40 else ["a", "b"] if i < 80 else ["b"], 10) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    out = mixing.mix_sources(df, F.col("size"), F.col("sources"), lambda names: [1.0] * len(names)).collect()
    assert sum(r["taken"] for r in out) == 1000 and {r["taken"] for r in out} == {10}
    assert {tuple(r["source_sizes"]) for r in out} == {(800.0,), (800.0, 600.0), (600.0,)}


def test_equal_rows_are_mixed_together(spark):
    df = spark.range(200).select(F.when(F.col("id") < 150, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 150, "b").otherwise("a").alias("source"), F.lit(3).alias("n"))
    out = mixing.mix_documents(df, F.col("n")).collect()
    assert len(out) == 200 and sum(r["doc_id"] is None for r in out) == 150
    for s in "ab":
        mine = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["source_targets"][0]) <= 3
    stage = mixing.mix_stage(spark, df.withColumn("text", F.lit("x y z")).drop("n"), "")
    assert abs(stage.filter("source = 'b'").count() * 3 - next(r for r in out if r["source"] == "b")["source_targets"][0]) <= 3


def test_mix_comes_near_its_targets(spark):
    got = mixing.op9_source_mixing(spark, SF).collect()
    again = mixing.op9_source_mixing(spark, SF).collect()
    key = lambda rows: sorted((r["doc_id"], r["taken"]) for r in rows)
    assert key(got) == key(again)
    docs = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        by.setdefault(docs[r["doc_id"]], []).append(r)
    for rows in by.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows)


def test_mix_edges(spark):
    rows = [(1, None, "a b c"), (2, "s", None), (3, "s", "x y"), (3, "s", "x y"), (4, "t", ""), (None, "t", "q")]
    out = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("taken", F.lit("x")), mixing.count_words()).collect()
    assert len(out) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in out)
    assert mixing.mix_documents(spark.createDataFrame([], "doc_id long, source string, text string"), mixing.count_words()).count() == 0


# pipeline


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = docs.count()
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert before * 0.5 < docs.count() <= before
    out = corpus_pipeline.run(spark, SMALL)
    assert {"shard", "slot", "doc_id", "text"} <= set(out.columns) and out.count() > 0
    assert entry.queries()["pipeline"] is corpus_pipeline.run


ODD = ["__x", "_k1", "_t", "_w", "size", "taken", "pattern", "shard", "slot", "score", "kept", "node", "k1", "hash", "start", "window", "n_words", "lang_pred", "spans", "items", "labels"]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_tables(spark, stage):
    """Nulls everywhere, repeated rows, empty and long texts, extra columns with names of results."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    long = "the quick of brown and fox is here " * 4000
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, long, None, "s", 5), (3, "der und die das ist", "de", None, 3), (3, "der und die das ist", "de", None, 3), (4, "the and of it is", "en", "t", 3), (None, "le la les", "fr", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, c in enumerate(ODD):
        docs = docs.withColumn(c, F.lit(i))
    name, function = corpus_pipeline.STAGES[stage]
    out = function(spark, docs, SMALL)
    rows_out = out.collect()
    if stage < 4:
        assert out.columns == docs.columns, name
        assert all(r[c] == i for r in rows_out for i, c in enumerate(ODD)), name
    else:
        assert len({(r["shard"], r["slot"]) for r in rows_out}) == len(rows) == len(rows_out)
    if stage in (0, 1, 2):
        assert any(r["doc_id"] == 4 for r in rows_out)
    empty = function(spark, docs.limit(0), SMALL)
    assert empty.count() == 0


def test_operators_replace_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over it " * 20), (None, None)], "doc_id long, text string")
    for i, c in enumerate(ODD):
        docs = docs.withColumn(c, F.lit(i))
    from marlstone.llm import minhash, substring_dedup, suffix_dedup

    for f in (quality.clean_documents, licenses.scan_licenses, substring_dedup.remove_repeats, suffix_dedup.remove_repeats, minhash.near_duplicates, sharding.shard_records):
        assert f(docs).count() == 2
    bench = spark.createDataFrame([(1, "quick brown fox"), (None, None)], "item_id long, text string").withColumn("length", F.lit(1))
    found = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
    assert found[1]["n_hit"] == 60 and found[None]["n_hit"] == 0
