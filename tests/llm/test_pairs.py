"""Repeats, near-duplicates and components against brute force on small fixtures."""

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from marlstone.llm import anchors, buffers, minhash, shared, substring_dedup, suffix_dedup
from marlstone.llm.components import components

SCHEMA = "doc_id long, text string, spans int, kept int"


def covered(sequences, length):
    """Flags of the symbols that a repeated window covers, by text."""
    seen = defaultdict(int)
    for s in sequences:
        for i in range(len(s) - length + 1):
            seen[tuple(s[i : i + length])] += 1
    out = []
    for s in sequences:
        flags = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length])] > 1:
                flags[i : i + length] = [True] * length
        out.append(flags)
    return out


def texts(seed, pieces, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice(pieces) for _ in range(rng.randint(10, 150))) for _ in range(8)]
    out = []
    for _ in range(n):
        k, b, c = rng.random(), rng.choice(base), rng.choice(base)
        at = rng.randrange(len(b))
        if k < 0.3:
            out.append(b)
        elif k < 0.6:
            out.append(b[:at] + rng.choice([" x ", "y", " "]) + b[at + rng.randint(0, 3) :])
        elif k < 0.8:
            out.append(b[at:] + c[: rng.randrange(len(c))])
        elif k < 0.9:
            out.append(rng.choice(pieces) * rng.randint(1, 90))
        else:
            out.append("".join(rng.choice(pieces) for _ in range(rng.randint(0, 90))))
    return [*out, None, "", " \n", out[0]]


@pytest.mark.parametrize(("length", "class_rows"), [(40, 1024), (9, 1024), (24, 3)])
def test_byte_repeats(spark, monkeypatch, length, class_rows):
    monkeypatch.setattr(anchors, "CLASS_ROWS", class_rows)
    monkeypatch.setattr(shared, "HOT_KEYS", class_rows * 4)  # few hot keys, or none that is not
    rows = [(i, t, 0, 0) for i, t in enumerate(texts(1, ["a", "b", "é", "cd", " "]))]
    rows += [(3, rows[3][1], 0, 0), (None, rows[0][1], 0, 0)]
    raw = [(r[1] or "").encode() for r in rows]
    want = sorted((str(r[0]), bytes(x for x, f in zip(b, flags, strict=True) if not f)) for r, b, flags in zip(rows, raw, covered(raw, length), strict=True))
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), length)
    got = out.collect()
    assert sorted((str(r["doc_id"]), bytes(r["kept"])) for r in got) == want
    assert all(a["end"] < b["begin"] for r in got for a, b in zip(r["spans"], r["spans"][1:], strict=False))


@pytest.mark.parametrize(("length", "class_rows"), [(12, 1024), (5, 1024), (8, 3)])
def test_word_repeats(spark, monkeypatch, length, class_rows):
    monkeypatch.setattr(anchors, "CLASS_ROWS", class_rows)
    rows = [(i, t, 0, 0) for i, t in enumerate(texts(2, ["ab ", "c ", "d\n", "é\t", "e\x0b"]))]
    words = [(r[1] or "").split() for r in rows]
    want = sorted((r[0], len(w), " ".join(x for x, f in zip(w, flags, strict=True) if not f)) for r, w, flags in zip(rows, words, covered(words, length), strict=True))
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), length)
    assert sorted((r["doc_id"], r["n_words"], r["kept"]) for r in out.collect()) == want


def morse(n, a, b):
    """Two different words of n characters that agree in every power sum of an odd base."""
    one = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(a if x else b for x in one), "".join(b if x else a for x in one)


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_polynomials_confuse(spark, n):
    a, b = morse(n, "a", "b")
    rest = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}")], "doc_id long, text string")
    assert [r["spans"] for r in substring_dedup.remove_repeats(docs).collect()] == [[], []]
    docs = spark.createDataFrame([(1, " ".join([a, b, a, a, b])), (2, " ".join([b, a, b, b, a]))], "doc_id long, text string")
    assert all(r["kept"] for r in minhash.near_duplicates(docs).collect())
    docs = spark.createDataFrame([(1, a + rest), (2, b + rest)], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix_dedup.remove_repeats(docs, n).collect()}
    assert got == {1: a + rest, 2: b + rest}


def test_equal_codes_of_unequal_words(monkeypatch):
    monkeypatch.setattr(substring_dedup, "word_codes", lambda buffer, starts, ends: (ends - starts).astype(np.uint64))
    buffer = np.frombuffer(b"ab cd ab x", np.uint8)
    ids, sigma = substring_dedup.word_numbers(buffer, np.array([0, 3, 6, 9]), np.array([2, 5, 8, 10]))
    assert ids.tolist() == [1, 2, 1, 3] and sigma == 4


@pytest.mark.parametrize(("piece", "most"), [("x", 500 + 64), ("long " * 100, 100)])
def test_shards_are_bounded(spark, monkeypatch, piece, most):
    """By rows and by bytes, however many rows come in one batch; every fragment is in one shard."""
    monkeypatch.setattr(anchors, "CLASS_ROWS", 64)
    monkeypatch.setattr(anchors, "SHARD_ROWS", 500)
    monkeypatch.setattr(anchors, "SHARD_BYTES", 20_000, raising=False)

    def index(pieces, core, least, most_x, times):
        assert len(pieces) <= most, f"{len(pieces)} fragments in a shard"
        return np.ones((len(pieces), 1), bool)

    rows = [(i // 2, i, i, 0, 0, 0, 1, False, piece.encode()) for i in range(6000)]
    out = anchors.by_shards(spark.createDataFrame(rows, anchors._PIECES).coalesce(1), index, 3).collect()
    assert sorted(r["k1"] for r in out) == list(range(6000)) and all((r["begin"], r["end"]) == (0, 3) for r in out)


def test_word_numbers_take_a_bounded_multiple(monkeypatch):
    """Places inside words are made for some of the bytes at a time, with the same numbers."""
    rng = np.random.default_rng(5)
    raw = b" ".join(b"%x" % x for x in (rng.integers(0, 1 << 40, 20_000) ** 3 % (1 << 62)).tolist() * 20)
    buffer = np.frombuffer(raw, np.uint8)
    starts, ends, _ = buffers.words(buffer, np.array([0, len(buffer)]))
    tracemalloc.start()
    ids, sigma = substring_dedup.word_numbers(buffer, starts, ends)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 * len(buffer), f"{most / len(buffer):.0f} bytes for one"
    assert sigma == len(set(raw.split())) + 1 and (ids.reshape(20, -1) == ids[:20_000]).all()
    codes = buffers.word_codes(buffer, starts, ends)
    for most in (1, 7, 1000):
        monkeypatch.setattr(buffers.runs_of_bytes, "__defaults__", (most,))
        assert (buffers.word_codes(buffer, starts[:900], ends[:900]) == codes[:900]).all()


@pytest.mark.parametrize("class_rows", [1024, 2])
def test_production_lengths(spark, monkeypatch, class_rows):
    """400 bytes and 35 words over whole documents, with and without halved classes."""
    monkeypatch.setattr(anchors, "CLASS_ROWS", class_rows)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    raw = [(r["text"] or "").encode() for r in rows]
    want = {r["doc_id"]: bytes(x for x, f in zip(b, flags, strict=True) if not f) for r, b, flags in zip(rows, raw, covered_long(raw, 400), strict=True)}
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(docs).collect()} == want
    words = [(r["text"] or "").split() for r in rows]
    want = {r["doc_id"]: " ".join(x for x, f in zip(w, flags, strict=True) if not f) for r, w, flags in zip(rows, words, covered(words, 35), strict=True)}
    assert {r["doc_id"]: r["kept"] for r in substring_dedup.remove_repeats(docs).collect()} == want


def covered_long(sequences, length):
    """As ``covered``, for bytes, by the windows themselves."""
    seen = defaultdict(int)
    for s in sequences:
        for i in range(len(s) - length + 1):
            seen[hash(s[i : i + length])] += 1
    out = []
    for s in sequences:
        flags, until = [False] * len(s), 0
        for i in range(len(s) - length + 1):
            if seen[hash(s[i : i + length])] > 1:
                for k in range(max(i, until), i + length):
                    flags[k] = True
                until = i + length
        out.append(flags)
    return out


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0


def test_transform_is_the_columns_in_suffix_order():
    rng = random.Random(3)
    strings = ["".join(rng.choice("ab") for _ in range(12)) for _ in range(40)]
    grid = np.array([list(s.encode()) for s in strings], np.uint8).T
    transform = suffix_dedup.ColumnTransform(np.zeros(40, int))
    for column in range(11, -1, -1):
        order, _ = transform.read()
        part = transform.insert(grid[column])
        assert bytes(part) == bytes(grid[column][order])
        order, common = transform.read()
        suffixes = [strings[i][column:] for i in order]
        assert suffixes == sorted(suffixes)
        for i in range(1, 40):
            a, b = suffixes[i - 1], suffixes[i]
            assert common[i] == next((k for k in range(len(a)) if a[k] != b[k]), len(a))


def test_wavelet_ranks_and_backward_search():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 13, 500)
    matrix = substring_dedup.WaveletMatrix(symbols, 13)
    low, high, wanted = rng.integers(0, 250, 60), rng.integers(250, 501, 60), rng.integers(0, 13, 60)
    a, b = matrix.ranks(wanted, low, high)
    assert [int((symbols[:x] == s).sum()) for x, s in zip(low, wanted, strict=True)] == a.tolist()
    assert [int((symbols[:x] == s).sum()) for x, s in zip(high, wanted, strict=True)] == b.tolist()
    texts_ = [rng.integers(1, 4, 30) for _ in range(5)]
    index = substring_dedup.FMIndex(texts_, 4)
    for pattern in ([1], [2, 3], [1, 1, 2], [3, 3, 3, 3]):
        lo, hi = np.zeros(1, np.int64), np.array([index.size])
        for s in reversed(pattern):
            lo, hi = index.extend(np.array([s]), lo, hi)
        count = sum(list(t[i : i + len(pattern)]) == pattern for t in texts_ for i in range(30))
        assert max(int(hi[0] - lo[0]), 0) == count


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


@pytest.mark.parametrize(("block", "names"), [(2048, False), (5, False), (2048, True)])
def test_near_duplicates(spark, monkeypatch, block, names):
    monkeypatch.setattr(minhash, "BLOCK_NODES", block)
    if names:  # first names that many sets share; the second ones still differ

        def by_size(hashes, firsts, full):
            return np.diff(firsts)[full].astype(np.int64) % 7, np.add.reduceat(hashes, firsts[:-1][full]).view(np.int64)

        monkeypatch.setattr(minhash, "node_names", by_size)
    rng = random.Random(5)
    base = [[rng.choice("aé b Cc dd e f g h".split()) + str(rng.randint(0, 40)) for _ in range(rng.randint(3, 120))] for _ in range(12)]
    rows = []
    for i in range(250):
        words = list(rng.choice(base[:3] if rng.random() < 0.5 else base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = "Z" + str(rng.randint(0, 9999))
        rows.append((i, " ".join(words)))
    rows += [(900, ""), (901, None), (902, " \n"), (5, rows[5][1]), (None, rows[7][1]), (903, "a b"), (904, "A B")]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    want = sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(6)
    least = minhash.least_matches(0.85, minhash.MISS)
    kept = 0
    for _ in range(300):
        a = rng.integers(0, 256, minhash.HASHES)
        b = np.where(rng.random(minhash.HASHES) < 0.85, a, rng.integers(0, 256, minhash.HASHES))
        kept += len(minhash.survivors(np.array([a, b], np.uint8), 0, np.array([1]), least))
    assert kept == 300
    far = [len(minhash.survivors(rng.integers(0, 256, (2, minhash.HASHES)).astype(np.uint8), 0, np.array([1]), least)) for _ in range(100)]
    assert sum(far) == 0


def test_stage_links_at_its_own_threshold(spark):
    words = [f"w{i}" for i in range(204)]
    near, apart = list(words), list(words)
    near[20::50] = ["x"] * len(near[20::50])
    apart[20::40] = ["y"] * len(apart[20::40])
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(apart))]
    sets = [shingles(t) for _, t in rows]
    likeness = [len(sets[0] & s) / len(sets[0] | s) for s in sets]
    assert 0.80 <= likeness[1] < 0.85 and likeness[2] < 0.80
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in minhash.dedup_stage(spark, docs, "").collect()} == {1, 3}
    assert all(r["kept"] for r in minhash.near_duplicates(docs).collect())


def test_stage_keeps_one_row_of_each_group(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(3, x, "a"), (5, x, "a"), (5, y, "a"), (7, z, "a"), (7, z, "b"), (7, z, "b"), (None, y + " more", "a"), (None, "n " + z, "a")]
    rows += [(None, "p q r s t u", "a"), (None, "p q r s t u", "a"), (None, "P q r s t u", "a"), (8, "", "a"), (8, "", "a"), (None, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [tuple(r) for r in minhash.dedup_stage(spark, docs, "").collect()]
    assert len(got) == 7
    assert sorted(r[:2] for r in got if r[0] is not None) == [(3, x), (5, y), (7, z), (8, ""), (8, "")]
    lone = [r[1] for r in got if r[0] is None]
    assert None in lone and len(lone) == 2 and {"p q r s t u"} == {t.lower() for t in lone if t}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 102), (101, 103), (7, 7), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 104)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digests(spark):
    out = suffix_dedup.op3_column_transform(spark, "/root/testdata/sf0.001").first()
    assert len(out["kept_sha256"]) == 64


def test_sieve_loses_no_member(spark):
    from marlstone.llm.shared import sieved

    rows = spark.sql("SELECT IF(id = 0, NULL, id) AS k, id AS v FROM range(2000)")
    members = rows.filter("v % 7 = 0").select("k")
    out = sieved(rows, ["k"], members)
    assert out.columns == ["k", "v", "__maybe"] and out.count() == 2000
    assert out.filter("v % 7 = 0 AND NOT __maybe").count() == 0
    assert out.filter("v % 7 <> 0 AND __maybe").count() < 20
    assert sieved(rows, ["k"], members.limit(0)).filter("__maybe").count() == 0


@pytest.mark.parametrize("hot_keys", [1, 4, 1 << 16])
def test_hot_keys_lose_no_row(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(shared, "HOT_KEYS", hot_keys)
    rows = [(k, i) for i, k in enumerate([1] * 300 + [2] * 200 + [3] * 40 + list(range(4, 60)))]
    table = shared.written(spark.createDataFrame(rows, "k int, i int"), "rows")
    counts = shared.written(table.groupBy("k").count().filter("k % 5 <> 2"), "counts")
    got = shared.met_by_count(table, counts, ["k"], "count")
    assert sorted((r["k"], r["i"]) for r in got.collect()) == sorted(r for r in rows if r[0] % 5 != 2)
    assert shared.met_by_count(table.limit(0), counts, ["k"], "count").count() == 0
