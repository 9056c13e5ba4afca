"""Operators on documents against brute force, on small fixtures with nulls, ties, repeats and long texts."""

import collections
import hashlib
import math
import random
import re
import struct

import duckdb
import hypothesis
import hypothesis.strategies as st
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from adslots.llm import common, decontaminate, lmscore, mixing, near, pii, quality, sharding, suffix
from adslots.llm.components import components
from adslots.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def mixed_rows():
    """Nulls in every column, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(1)
    base = [prose(rng, rng.randint(60, 220)) for _ in range(25)]
    passage = prose(rng, 120)
    rows = [(i, t, "en", "a") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "b") for i in range(4)]  # copies
    for i in range(8):  # near copies of one text, some near enough
        words = base[0].split()
        for _ in range(i):
            words[rng.randrange(len(words))] = f"x{rng.randrange(999)}"
        rows.append((200 + i, " ".join(words), "de", "b"))
    rows += [(300 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 20), "fr", None) for i in range(3)]
    rows += [(400, None, None, "a"), (401, "", "en", None), (402, "", "en", "a"), (None, "a b c", "en", "a"), (403, prose(rng, 6000, 3000), "en", "c"), (404, "é " * 700, "fr", "c")]
    rows += [(500, base[7], "en", "a"), (500, base[7], "en", "a")]  # a repeated row
    return rows


@pytest.fixture(scope="module")
def docs(spark, mixed_rows):
    """With an extra column whose name clashes with what operators use inside."""
    return documents(spark, mixed_rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 1 -----------------------------------------------------------------------------------------------------------


def _jaccard(rows):
    first, sets = {}, {}
    for i, t, *_ in rows:
        if t is None:
            continue
        key = (i is None, i)
        first[t] = min(first.get(t, key), key)
    for t in first:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[t] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    texts = list(first)
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    degree = collections.Counter()
    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[texts[a]], sets[texts[b]]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                degree[texts[a]] += 1
                degree[texts[b]] += 1
                root[find(texts[a])] = find(texts[b])
    classes = collections.defaultdict(list)
    for t in texts:
        classes[find(t)].append(first[t])
    return {(i, t): (i, 0) if t is None else (min(classes[find(t)])[1], degree[t]) for i, t, *_ in rows}


def test_jaccard_join_equals_brute_force(docs, mixed_rows):
    want = _jaccard(mixed_rows)
    key = {hashlib.md5(t.encode()).hexdigest(): t for _, t, *_ in mixed_rows if t is not None}
    got = near.classify(docs).collect()
    assert len(got) == len(mixed_rows)
    for r in got:
        assert (r["class_id"], r["n_links"]) == want[(r["doc_id"], key.get(r["text_key"]))]


def test_jaccard_join_of_one_large_group(spark):
    """More texts than a chunk holds, each near most others: counts stay exact, over several tiles."""
    rng = random.Random(4)
    base = prose(rng, 150).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"y{rng.randrange(9999)}"
        rows.append((i, " ".join(words), "en", "a"))
    want = _jaccard(rows)
    got = near.classify(documents(spark, rows)).collect()
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in got} == {(i, *want[(i, t)]) for i, t, *_ in rows}


def _chain(n, step=5):
    """Texts that slide over one long run of words: each is near its neighbours only, all in one family."""
    rng = random.Random(14)
    words = [f"c{rng.randrange(99999)}" for _ in range(n * step + 120)]
    return [(i, " ".join(words[i * step : i * step + 120]), "en", "a") for i in range(n)]


def test_chains_are_compared_along_their_bands(spark, monkeypatch):
    """One family of 300 texts in small chunks: counts are exact, and chunks far apart on the chain don't meet."""
    monkeypatch.setattr(near, "CHUNK_NODES", 6)
    rows = _chain(300)
    want = _jaccard(rows)
    d = documents(spark, rows)
    got = near.classify(d).collect()
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in got} == {(i, *want[(i, t)]) for i, t, *_ in rows}
    nodes = common.cut(near.sketch(d).withColumn("node", F.monotonically_increasing_id()))
    dealt, pairs = near.chunks(nodes)
    n = dealt.select("chunk").distinct().count()
    assert n > 30 and pairs.select("lo", "hi").distinct().count() < n * n / 8
    assert dealt.groupBy("chunk").count().agg(F.max("count")).first()[0] <= 7


def test_keep_one(docs, mixed_rows, none):
    odd = docs
    for name in ("_key", "_id", "_key2", "key", "row", "mark", "label", "text_key", "n", "node"):
        odd = odd.withColumn(name, F.lit(name))
    out = near.keep_one(odd)
    assert out.columns == odd.columns and {r["_key"] for r in out.select("_key").collect()} == {"_key"}
    want = {c for (i, t), (c, _) in _jaccard(mixed_rows).items() if t is not None}
    kept = [r["doc_id"] for r in out.where("text IS NOT NULL").collect()]
    assert sorted(map(str, kept)) == sorted(map(str, want))
    assert out.where("text IS NULL").count() == 1
    assert near.keep_one(none).count() == 0 and near.classify(none).count() == 0


def test_keep_one_of_rows_that_differ_elsewhere(spark):
    """Rows of one id and text: the same one stays in whatever order they come."""
    rows = [(1, "a b c d e f", lang, "s") for lang in ("en", "de", "fr", None)] * 3
    stays = [near.keep_one(documents(spark, x)).collect() for x in (rows, rows[::-1])]
    assert len(stays[0]) == 1 and stays[0] == stays[1]


def test_bayesian_pruning_keeps_true_pairs():
    least = near.least_matches()
    assert list(least) == list(range(near.STEP, near.BANDS * near.ROWS + 1, near.STEP))
    assert all(least[n] < 0.8 * n for n in least)
    assert least[near.BANDS * near.ROWS] > 0.5 * near.BANDS * near.ROWS


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 80)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    got = {(r["node"], r["label"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in list(root)}


# 4 -----------------------------------------------------------------------------------------------------------


def test_rendezvous_sharding(docs, mixed_rows, none):
    import zlib

    out = sharding.shard_documents(docs).collect()
    assert len(out) == len(mixed_rows)
    places = collections.defaultdict(list)
    for r in out:
        assert r["grown_shard"] in (r["shard"], 8)
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard_documents(none).count() == 0
    facts = {(r["doc_id"], r["size"], r["text_crc32"]) for r in out}
    assert facts == {(i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in mixed_rows}


def _best_shard(key, weights):
    """A second implementation of the scores: the hash chain of (key, shard), and the largest -w / ln(u)."""
    scores = []
    for s, w in enumerate(weights):
        h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        u = ((xxhash.xxh64_intdigest(struct.pack("<i", s), h) >> 11) + 0.5) / (1 << 53)
        scores.append((-w / math.log(u), s))
    return max(scores)[1]


def test_shards_equal_a_second_implementation(docs, spark):
    weights = [1.0, 2.0, 0.5]
    for r in sharding.shard_documents(docs, weights, 1.5).collect():
        assert r["shard"] == _best_shard(r["doc_id"], weights) and r["grown_shard"] == _best_shard(r["doc_id"], [*weights, 1.5])
    assert {_best_shard(i, [1.0] * 8) for i in range(100)} == set(range(8))


def test_repeated_rows_are_numbered_without_being_in_one_place(spark, monkeypatch):
    monkeypatch.setattr(common, "SPREAD_ROWS", 100)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 50)
    rows = [(7, "same", "en", "a")] * 3000 + [(None, None, "en", "a")] * 900 + [(i, str(i), "en", "a") for i in range(500)]
    d = documents(spark, rows).selectExpr("*", "1 AS _block", "2 AS n", "3 AS _row", "'x' AS shard", "'y' AS slot")
    out = sharding.shard_documents(d).collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(i for i, *_ in rows)
    places = collections.defaultdict(list)
    for r in out:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_weights_move_few_keys(spark):
    ids = spark.range(20000).select(F.col("id").alias("k"))
    even, double = sharding.rendezvous(F.col("k"), [1.0] * 4), sharding.rendezvous(F.col("k"), [1.0, 1.0, 1.0, 2.0])
    moved = ids.select(even.alias("a"), double.alias("b")).where("a <> b")
    assert moved.where("b <> 3").count() == 0
    share = ids.where(double == 3).count() / 20000
    assert abs(share - 0.4) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("k"), [])


# 5 -----------------------------------------------------------------------------------------------------------


def _leaks(rows, items, window=10):
    out = []
    for i, t, *_ in rows:
        words = decontaminate.words_of(t)
        hit, found = set(), set()
        for item, text in items:
            if item is None or text is None:
                continue
            w = decontaminate.words_of(text)
            n = min(window, len(w))
            wins = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if n else ()
            for a in range(len(words) - n + 1) if n else ():
                if tuple(words[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
                    found.add(str(item))
        out.append((i, len(words), len(hit), sorted(found)))
    return out


def _near(rows, items):
    out = []
    for i, t, *_ in rows:
        words, found = decontaminate.words_of(t), set()
        for item, text in items:
            terms = sorted(set(decontaminate.words_of(text)), key=lambda w: (-len(w), w))[:3]
            if item is None or len(terms) < 3:
                continue
            for p, w in enumerate(words):
                if w == terms[0] and set(terms) <= set(words[max(0, p - 10) : p + 11]):
                    found.add(str(item))
        out.append((i, sorted(found)))
    return out


@pytest.mark.parametrize("pass_words", [decontaminate.PASS_WORDS, 30])
def test_near_items_equal_brute_force(spark, docs, mixed_rows, pass_words):
    words = [t.split() for _, t, *_ in mixed_rows[:6]]
    items = [(k, " ".join(w[a : a + 4])) for k, w in enumerate(words) for a in (0, 30)] + [(20, "a b c"), (21, "a b"), (22, None), (None, "a b c"), (23, " ".join(words[2]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_leaks(docs, bench) if pass_words > 30 else decontaminate.phrase_matches(decontaminate.build_index(docs), bench, pass_words=pass_words)
    got = [(r["doc_id"], r["near"]) for r in out.collect()]
    want = _near(mixed_rows, items)
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(len(x) for _, x in want) > 6


def test_a_long_item_is_cut_into_pieces_that_hold_every_window(spark):
    words = [f"w{k}" for k in range(1000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "short one"), (3, ""), (4, " ".join(words[:10]))], "item_id long, text string")
    rows = decontaminate.pieces(bench, 10, 400).collect()
    assert max(len(r["words"].split()) for r in rows) == 50 and {r["item_id"] for r in rows} == {"1", "2", "4"}
    windows = [tuple(w[a : a + 10]) for r in rows if r["item_id"] == "1" for w in [r["words"].split()] for a in range(len(w) - 9)]
    assert sorted(windows) == sorted(tuple(words[a : a + 10]) for a in range(991))
    assert sum(r["near"] is not None for r in rows) == 2
    index = decontaminate.build_index(documents(spark, [(7, "x " + " ".join(words) + " y", "en", "s"), (8, " ".join(words[495:507]), "en", "s")]))
    out = {r["doc_id"]: r for r in decontaminate.phrase_matches(index, bench, pass_words=400).collect()}
    assert [tuple(s) for s in out[7]["spans"]] == [(1, 1001)] and [tuple(s) for s in out[8]["spans"]] == [(0, 12)]
    assert out[7]["items"] == ["1", "4"] and out[8]["items"] == ["1"]


@hypothesis.given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=40))
def test_joined_spans_are_the_union(given):
    spans = [(a, a + n) for a, n in given]
    covered = {p for a, b in spans for p in range(a, b)}
    out = decontaminate.joined(spans)
    assert [p for a, b in out for p in range(a, b)] == sorted(covered) and all(b < c for (_, b), (c, _) in zip(out, out[1:]))


@pytest.mark.parametrize("pass_words", [decontaminate.PASS_WORDS, 30])
def test_leaks_equal_brute_force(spark, docs, mixed_rows, pass_words):
    items = [(1, " ".join(mixed_rows[3][1].upper().split()[5:30])), (2, "W1, w2"), (10, mixed_rows[5][1][:200]), (None, "x y"), (3, None), (4, ""), (5, "a b c"), (5, "a b c"), (6, "é é é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.phrase_matches(decontaminate.build_index(docs), bench, pass_words=pass_words)
    mine = [(r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), sorted(r["items"])) for r in got.collect()]
    want = _leaks(mixed_rows, items)
    assert sorted(mine, key=repr) == sorted(want, key=repr)
    odd = docs.selectExpr("*", "'b' AS block", "1 AS ord", "2 AS spans", "3 AS items")
    kept = decontaminate.drop_leaks(odd, bench, pass_words=pass_words)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[2]), key=str)


def test_leaks_of_empty_tables(spark, docs, none):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.drop_leaks(none, bench).count() == 0
    out = decontaminate.find_leaks(docs, empty).collect()
    assert len(out) == docs.count() and not any(r["items"] or r["spans"] for r in out)
    assert decontaminate.drop_leaks(docs, empty).count() == docs.count()


def test_index_in_many_blocks(spark, docs, mixed_rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 50)
    p = decontaminate.Postings.of_texts([t for _, t, *_ in mixed_rows])
    terms, counts, deltas = p.row()
    again = decontaminate.Postings.of_row(terms, counts, deltas, p.lengths)
    assert (again.positions == p.positions).all() and again.terms == p.terms
    near_ = decontaminate.proximity_matches(decontaminate.build_index(docs), [["b", "a", "c"], ["a", "nowhere"]], within=3).collect()
    assert [(r["query"], r["doc_id"]) for r in near_] == [(0, None)]


@pytest.mark.parametrize("pass_words", [decontaminate.PASS_WORDS, 1])
def test_an_item_of_two_texts_is_listed_once(spark, pass_words):
    bench = spark.createDataFrame([(5, "a b c"), (5, "d e f"), (6, "c d")], "item_id long, text string")
    index = decontaminate.build_index(documents(spark, [(1, "a b c d e f", "en", "s")]))
    assert [r["items"] for r in decontaminate.phrase_matches(index, bench, pass_words=pass_words).collect()] == [["5", "6"]]


def test_proximity_does_not_depend_on_the_block():
    """b is rarest in the first block, a in the second; the same document gets the same answer."""
    text = "a x x b x x c"
    for others in (["a a a c c"], ["b b b c c"], []):
        p = decontaminate.Postings.of_texts([text, *others])
        assert 0 in p.near([b"b", b"a", b"c"], 3)
        assert 0 not in p.near([b"a", b"b", b"c"], 3)


# 6 -----------------------------------------------------------------------------------------------------------


def _counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + d for i in range(len(words) - 2) if wins[tuple(words[i : i + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    texts = ["", None, " \n\t", "a", "a b c a b c", "a a a a a", "x # y\nx # y\n\nx # y\n z|&", "é ü \x0b b\x0cc\rd", "one\ntwo\none\n one", "b " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", quality.statistics(F.col("t")).alias("s")).select("i", "s.*").orderBy("i").collect()
    for r, t in zip(out, texts, strict=True):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == _counts(t)


def test_binomial_tail(spark):
    df = spark.createDataFrame([(200, 1), (50, 0), (1000, 12), (1000, 19), (30000, 500), (5_000_000, 99_000), (5_000_000, 100_000)], "n long, k long").select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.02).alias("p"))
    for r in df.collect():
        want = sum(math.exp(math.lgamma(r["n"] + 1) - math.lgamma(j + 1) - math.lgamma(r["n"] - j + 1) + j * math.log(0.02) + (r["n"] - j) * math.log(0.98)) for j in range(r["k"] + 1))
        assert r["p"] == pytest.approx(want, rel=1e-6)


def test_cutoffs_control_false_rejection(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(3600):
        good = i % 3 > 0
        words = [f"v{rng.randrange(5000)}" for _ in range(80)]
        if not good or rng.random() < 0.001:
            words = [w + "#$" for w in words]
        rows.append((i, " ".join(words), "en" if i % 2 else None, "s"))
        labels.append((i, int(good), 0))
    rows.append((9999, "short", "xx", "s"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = documents(spark, rows)
    out = {r["doc_id"]: r for r in quality.judge_documents(d, lab).collect()}
    good = [i for i, q, _ in labels if q]
    for odd in (0, 1):  # in each stratum
        mine = [i for i in good if i % 2 == odd]
        assert sum(not out[i]["kept"] for i in mine) <= quality.ALPHA * len(mine)
    assert sum(not out[i]["kept"] for i, q, _ in labels if not q) > 0.9 * 1200
    assert not out[9999]["kept"] and out[9999]["base_failed"]
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["kept"]}


def test_quality_without_labels_or_rows(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.judge_documents(docs, empty).collect()
    assert len(out) == docs.count() and all(r["kept"] == (not r["base_failed"]) for r in out)
    assert quality.judge_documents(none, empty).count() == 0


# 7 -----------------------------------------------------------------------------------------------------------


def _repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        marks = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                marks[p : p + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if marks[i] and not (i and marks[i - 1]))
        out.append((len(b), sum(marks), runs, hashlib.sha256(bytes(x for x, m in zip(b, marks, strict=True) if not m)).hexdigest()))
    return out


def test_repeated_strings_equal_brute_force(docs, mixed_rows, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 700)  # several pieces in the longest texts
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup_documents(docs).collect()]
    want = [(i, *w) for (i, *_), w in zip(mixed_rows, _repeats([t for _, t, *_ in mixed_rows], 400), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 3000


def test_repeats_with_odd_edges(spark, none):
    rng = random.Random(9)
    shared = prose(rng, 400)
    texts = [prose(rng, 5) + shared[a:b] + prose(rng, 5) for a, b in ((0, 399), (0, 400), (3, 1200), (100, 501), (800, 1600), (795, 1300))] + ["ab" * 500, "z" * 401, "z" * 399, "z" * 400]
    d = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup_documents(d).collect()}
    assert got == dict(enumerate(_repeats(texts, 400)))
    assert suffix.dedup_documents(none).count() == 0


def test_repeated_rows_are_one_text(spark, monkeypatch):
    """3,000 equal rows: no group holds more parts than one text has, and all of it goes."""
    rng = random.Random(15)
    text, passage = prose(rng, 300), prose(rng, 150)
    rows = [(None, text, "en", "s")] * 3000 + [(k, prose(rng, 40) + passage + prose(rng, 40), "en", "s") for k in range(6)] + [(9, text[:900] + " end", "en", "s"), (10, "short", "en", "s"), (10, "short", "en", "s")]
    held = []
    plain = suffix._with_text
    monkeypatch.setattr(suffix, "_with_text", lambda *a: held.append(common.cut(plain(*a))) or held[-1])
    d = documents(spark, rows).selectExpr("*", "1 AS h1", "2 AS h2", "3 AS seed", "4 AS rows")
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup_documents(d).collect())
    texts = [t for _, t, *_ in rows[2990:]]  # ten of the equal rows tell as much as all
    want = collections.Counter((i, *w) for (i, *_), w in zip(rows[2990:], _repeats(texts, 400), strict=True))
    first = next(k for k in want if k[0] is None)
    want[first] = 3000
    assert got == want and first[2] == first[1] == len(text)
    assert max(h.select(F.size("parts").alias("k")).agg(F.max("k")).first()[0] or 0 for h in held) < 300


# 8 -----------------------------------------------------------------------------------------------------------


def test_pseudonyms(spark):
    import datetime
    import ipaddress

    text = 'a.b1@mail.example.com 129.38.82.176. 4532015112830366! 4532-0151-1283-0366 4532015112830367 +1 (017) 555-7713$ 123-45-6789 000-12-1234 2024-02-29 31.12.1999 30.02.2000 999.1.1.1 "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"'
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "same 129.38.82.176 and a.b1@mail.example.com"), (5, "no numbers here")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.pseudonymise(d, "k").collect()}
    new, old = out[1]["text"].split(" "), text.split(" ")
    assert len(new) == len(old)
    # a wrong check digit, an impossible area, date and address
    assert {"4532015112830367", "000-12-1234", "30.02.2000", "999.1.1.1"} <= set(new)
    for gone in ("a.b1@", "129.38.82.176", "4532015112830366", "123-45-6789", "2024-02-29", "31.12.1999", "555-7713", "9c8b4543"):
        assert gone not in out[1]["text"]
    ipaddress.ip_address(new[1].rstrip("."))
    datetime.date.fromisoformat(new[old.index("2024-02-29")])
    card = new[2].rstrip("!")
    total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(card)))
    assert len(card) == 16 and total % 10 == 0
    assert new[3].replace("-", "") == card  # the same number in another form
    assert new[1].rstrip(".") in out[4]["text"] and new[0] in out[4]["text"]
    assert re.fullmatch(r"[a-z]\.[a-z][0-9]@[a-z]{4}\.[a-z]{7}\.com", new[0])
    assert out[2]["text"] is None and out[3]["text"] == "" and out[5]["text"] == "no numbers here"
    assert pii.pseudonymise(d, "other").where("doc_id = 4").first()["text"] != out[4]["text"]


def _keyed(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def _feistel(x, a, b, kind, tweak):
    left, right = divmod(x, b)
    for i in range(pii.ROUNDS):
        if i % 2:
            right = (right + _keyed("k", kind, tweak, i, left)) % b
        else:
            left = (left + _keyed("k", kind, tweak, i, right)) % a
    return left * b + right


def _digits(d, kind):
    half = len(d) // 2
    return str(_feistel(int(d), 10 ** (len(d) - half), 10**half, kind, len(d))).zfill(len(d))


def _shifted(value, classes, kind, tweak):
    left, right = value[: len(value) // 2], value[len(value) // 2 :]

    def move(own, other, i):
        digest = hashlib.sha256(f"{i}|{tweak}|{other}".encode()).hexdigest()
        out = ""
        for at, c in enumerate(own):
            letters = next((x for x in classes if c in x), None)
            out += letters[(letters.index(c) + _keyed("k", kind, digest, at)) % len(letters)] if letters else c
        return out

    for i in range(4):
        left, right = (left, move(right, left, i)) if i % 2 else (move(left, right, i), right)
    return left + right


def _fill(form, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10


def _plain_pseudonym(kind, v):
    import datetime

    d = "".join(c for c in v if c.isdigit())
    if kind == "card":
        p = _digits(d[:-1], "card")
        return _fill(v, p + str(-_luhn(p + "0") % 10))
    if kind == "phone":
        keep = next(k for k in (1, 2, 3) if k == 3 or d[:k] in pii.CODES) if v[0] == "+" else 1 if v[0] == "0" and not re.fullmatch(r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}", v) else 0
        return _fill(v, d[:keep] + _digits(d[keep:], "phone"))
    if kind == "date":
        first, form = datetime.date(1800, 1, 1), "%Y-%m-%d" if v[4] == "-" else f"%d{v[2]}%m{v[2]}%Y"
        walk = False
        try:
            day = datetime.datetime.strptime(v, form).date()
        except ValueError:
            form, walk = f"%m{v[2]}%d{v[2]}%Y", True
            day = datetime.datetime.strptime(v, form).date()
        x = _feistel((day - first).days, 189, 773, "date", 0)
        while walk and (first + datetime.timedelta(x)).day <= 12:
            x = _feistel(x, 189, 773, "date", 0)
        return (first + datetime.timedelta(x)).strftime(form)
    if kind == "ip":
        a, b, c, e = map(int, v.split("."))
        x = _feistel(((a * 256 + b) * 256 + c) * 256 + e, 65536, 65536, "ip", 4)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ssn":
        a, g, n = (int(x) for x in v.split("-"))
        x = _feistel(((a - 2 if a > 666 else a - 1) * 99 + g - 1) * 9999 + n - 1, 898, 99 * 9999, "ssn", 0)
        a, g, n = x // (99 * 9999) + 1, x // 9999 % 99 + 1, x % 9999 + 1
        return f"{a + (a >= 666):03}-{g:02}-{n:04}"
    if kind == "email":
        name, host = v.split("@")
        top = host.rsplit(".", 1)[1]
        return _shifted(name, pii.LETTERS, "email", host) + "@" + _shifted(host[: -len(top)], pii.LETTERS, "domain", top) + top
    if kind == "iban":
        plain = v.replace(" ", "")
        bban = _shifted(plain[4:], pii.CAPITALS, "iban", plain[:2])
        check = 98 - int("".join(str(int(c, 36)) for c in bban + plain[:2] + "00")) % 97
        it = iter(f"{plain[:2]}{check:02}{bban}")
        return "".join(c if c == " " else next(it) for c in v)
    return _shifted(v, pii.HEX, kind, "")


VALUES = [
    ("email", "a@x.org"), ("email", "b@x.org"), ("email", "o" * 90 + ".k7@mail.some-host.co.uk"), ("email", "zoë.ÄB@example.com"),
    ("secret", "9c8b45435718dcc700c184a7e303cdc6"), ("secret", "0123456789ABCDEF" * 13), ("ip", "129.38.82.176"), ("ip", "0.0.0.0"),
    ("ipv6", "2001:db8:85a3:0:0:8a2e:370:7334"), ("ipv6", "fe80::1ff:fe23:4567:890a"), ("ipv6", "::ffff:1:2"),
    ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("date", "2024-02-29"), ("date", "31.12.1999"), ("date", "03/04/2001"),
    ("date", "12/31/1999"), ("date", "12-25-2020"), ("date", "01-02-2003"), ("ssn", "123-45-6789"), ("ssn", "899-99-9999"),
    ("card", "4532015112830366"), ("card", "4532-0151-1283-0366"), ("card", "3782 822463 10005"), ("phone", "+1 (017) 555-7713"), ("phone", "017-555-7713"),
    ("phone", "+49 30 1234567"), ("phone", "+33 1 23 45 67 89"), ("phone", "030-1234567"), ("phone", "+44 20 7946 0958"), ("phone", "+491701234567"), ("phone", "01 23 45 67 89"),
]


def test_pseudonyms_equal_a_second_implementation(spark):
    rows = [(k, f"see {v} there") for k, (_, v) in enumerate(VALUES)]
    for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect():
        kind, value = VALUES[r["doc_id"]]
        assert (r["text"], r[f"n_{kind}"]) == (f"see {_plain_pseudonym(kind, value)} there", 1), value
    assert mod_of("DE89 3704 0044 0532 0130 00") == 1


def test_numbers_stay_linked_in_every_spacing(spark):
    spellings = (["+1 415 555 0100", "+14155550100", "+1-415-555-0100", "+1 (415) 555.0100"], ["+49 30 1234567", "+49301234567", "+49 (30) 12 34 567"], ["+353 1 234 5678", "+35312345678"])
    rows = [(k, v) for k, group in enumerate(spellings) for v in group]
    found = collections.defaultdict(set)
    for r, (k, v) in zip(pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "k").orderBy("doc_id").collect(), rows):
        assert r["n_phone"] == 1, v
        found[r["doc_id"]].add(re.sub("[^0-9]", "", r["text"]))
    assert [len(x) for x in found.values()] == [1, 1, 1] and len(set.union(*found.values())) == 3


def test_dates_of_timestamps(spark):
    rows = [(1, "at 2020-12-25T10:00:00Z"), (2, "on 2020-12-25."), (3, "no 2020-12-25Txt")]
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    day = _plain_pseudonym("date", "2020-12-25")
    assert out == {1: f"at {day}T10:00:00Z", 2: f"on {day}.", 3: "no 2020-12-25Txt"}


def test_hosts_of_any_number_of_labels(spark):
    hosts = {10: "a." * 10 + "com", 2_000: "a." * 2_000 + "com", 200_000: "a." * 200_000 + "com"}
    rows = [(n, f"see x@{h} end") for n, h in hosts.items()] + [(1, "x@a.com.1.2 and x@a.com. and x@a.com.12, x@a.com..b.org x@1.2 x@a.b-c.de.")]
    out = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for n, h in hosts.items():
        assert out[n]["n_email"] == 1 and out[n]["text"] == f"see {_plain_pseudonym('email', 'x@' + h)} end"
    com, de = _plain_pseudonym("email", "x@a.com"), _plain_pseudonym("email", "x@a.b-c.de")
    assert out[1]["text"] == f"{com}.1.2 and {com}. and {com}.12, {com}..b.org x@1.2 {de}."


def mod_of(v):
    plain = v.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def test_cards_beside_other_numbers(spark):
    rows = [(1, "4111 1111 1111 1111 123"), (2, "12 4111 1111 1111 1111"), (3, "017-555-7713 12345"), (4, "4111 1111 1111 1112"), (5, "GB82 WEST 1234 5698 7654 33"), (6, "x " * 50_000 + "4111111111111111" + " y" * 50_000)]
    out = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    card = _plain_pseudonym("card", "4111 1111 1111 1111")
    assert out[1]["text"] == card + " 123" and out[2]["text"] == "12 " + card
    assert out[3]["text"] == _plain_pseudonym("phone", "017-555-7713") + " 12345"
    assert out[4]["text"] == rows[3][1] and out[5]["text"] == rows[4][1]
    assert out[6]["n_card"] == 1 and out[6]["text"][100_000:100_016] == card.replace(" ", "")


def test_pseudonyms_of_no_rows(none):
    out = pii.pseudonymise(none, "k")
    assert out.count() == 0 and out.columns == ["doc_id", "text", *(f"n_{k}" for k in pii.KINDS)]


def test_feistel_is_a_permutation(spark):
    long = lambda n: F.lit(n).cast("long")
    out = spark.range(189 * 7).select(pii.feistel(F.col("id"), long(189), long(7), "k", "t", F.lit(0)).alias("y"))
    assert sorted(r[0] for r in out.collect()) == list(range(189 * 7))


# 9 -----------------------------------------------------------------------------------------------------------


def test_scores_equal_a_plain_model(spark, docs, mixed_rows):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i == 4)) for i in range(20)] + [(0, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    good = {i for i in range(2, 20, 2) if i != 4}
    texts = [t for _, t, *_ in mixed_rows]
    counted = [i in good for i, *_ in mixed_rows]
    got = sorted(lmscore.score_documents(docs, labels).collect(), key=repr)
    n, word = lmscore.numbered(texts, {})
    pair = lmscore.pairs(n, word)[2]
    vocabulary, end = int(word.max()) + 1, np.cumsum(n)
    tables = np.zeros((2, vocabulary + len(pair)))
    for k in range(len(texts)):
        for w, p in zip(word[end[k] - n[k] : end[k]], pair[end[k] - n[k] : end[k]], strict=True):
            row = 0 if counted[k] else 1
            tables[row, w] += 1
            tables[row, vocabulary + p] += 1
    want = []
    for k, (i, *_) in enumerate(mixed_rows):
        losses = []
        for row, own in ((0, counted[k]), (1, not counted[k])):
            mine = collections.Counter()
            span = range(end[k] - n[k], end[k])
            if own:
                for j in span:
                    mine["w", word[j]] += 1
                    mine["p", pair[j]] += 1
            total, before, loss = tables[row, :vocabulary].sum() - (n[k] if own else 0), None, 0.0
            for j in span:
                cw = tables[row, word[j]] - mine["w", word[j]]
                cp = tables[row, vocabulary + pair[j]] - mine["p", pair[j]]
                cb = 0 if before is None else tables[row, before] - mine["w", before]
                single = (1 - lmscore.UNIFORM) * cw / total + lmscore.UNIFORM / vocabulary
                weight = lmscore.PAIR_WEIGHT if cb > 0 else 0.0
                loss -= np.log(weight * min(1.0, cp / max(cb, 1)) + (1 - weight) * single)
                before = word[j]
            losses.append(loss / n[k] if n[k] else None)
        want.append((i, int(n[k]), *losses))
    assert len(got) == len(want)
    by = collections.defaultdict(list)
    for w in want:
        by[w[:2]].append(w[2:])
    for r in got:
        options = by[(r["doc_id"], r["n_words"])]
        assert any((o[0] is None and r["target_loss"] is None) or (r["target_loss"] == pytest.approx(o[0], rel=1e-6) and r["background_loss"] == pytest.approx(o[1], rel=1e-6)) for o in options)


def test_every_word_and_pair_has_its_own_count(spark, monkeypatch):
    """More than 2^18 words and 2^19 pairs, in several blocks, against counts keyed by the words themselves."""
    monkeypatch.setattr(lmscore, "BLOCK_WORDS", 150_000, raising=False)
    rng = random.Random(10)
    rows = [(i, " ".join(f"w{min(rng.randrange(900_000), rng.randrange(900_000))}" for _ in range(6000)), "en", "s") for i in range(150)]
    rows += [(900, "only here", "en", "s"), (901, "w1 w2 w1 w2", "en", "s"), (901, "w1 w2", "en", "s"), (902, "w1 w2", "en", "s")]
    good = {*range(0, 150, 5), 901}
    labels = spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
    words, both = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for i, t, *_ in rows:
        w = t.split()
        for k in (0 if i in good else 1,):
            words[k].update(w)
            both[k].update(zip(w, w[1:]))
    vocabulary = len(words[0] + words[1])
    assert vocabulary > 1 << 18 and len(both[0] + both[1]) > 1 << 19
    want = []
    for i, t, *_ in rows:
        w, losses = t.split(), []
        for k in (0, 1):
            own = (i in good) == (k == 0)
            mine, mine2 = (collections.Counter(w), collections.Counter(zip(w, w[1:]))) if own else (collections.Counter(), collections.Counter())
            total, loss = sum(words[k].values()) - sum(mine.values()), 0.0
            for a, b in zip([None, *w], w):
                single = (1 - lmscore.UNIFORM) * (words[k][b] - mine[b]) / total + lmscore.UNIFORM / vocabulary
                c = words[k][a] - mine[a] if a else 0
                loss -= np.log(lmscore.PAIR_WEIGHT * (both[k][a, b] - mine2[a, b]) / c + (1 - lmscore.PAIR_WEIGHT) * single if c else single)
            losses.append(loss / len(w))
        want.append((i, len(w), *losses))
    got = sorted((r["doc_id"], r["n_words"], r["target_loss"], r["background_loss"]) for r in lmscore.score_documents(documents(spark, rows), labels).collect())
    assert [r[:2] for r in got] == [r[:2] for r in sorted(want)]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in sorted(want)], rtol=1e-9)


def test_probabilities_sum_to_one(spark, monkeypatch):
    """Of all words of the corpus, and of the text's end, before a word and at a text's start, in both models."""
    monkeypatch.setattr(lmscore, "BLOCK_WORDS", 60)
    rng = random.Random(12)
    texts = [" ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randint(1, 12))) for _ in range(60)]
    words = sorted({w for t in texts for w in t.split()} | {"w1", "never"})
    seen = {i: t for i, t in enumerate(texts)}
    # probes have their own model out of the way: the other one has not counted them
    probes = {1000 + k: w for k, w in enumerate(words)} | {2000 + k: f"w1 {w}" for k, w in enumerate(words)}
    for column, good in (("target_loss", set(seen)), ("background_loss", set(probes))):
        labels = spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
        rows = [(i, t, "en", "s") for i, t in (seen | probes).items()]
        loss = {r["doc_id"]: r[column] * r["n_words"] for r in lmscore.score_documents(documents(spark, rows), labels).collect()}
        start = {w: loss[1000 + k] for k, w in enumerate(words)}
        assert sum(math.exp(-x) for x in start.values()) == pytest.approx(1)
        ended = sum(t.split()[-1] == "w1" for t in texts) / sum(t.split().count("w1") for t in texts)
        assert sum(math.exp(start["w1"] - loss[2000 + k]) for k in range(len(words))) + lmscore.PAIR_WEIGHT * ended == pytest.approx(1)


def test_target_like_texts_score_lower(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"{'t' if i % 2 else 'b'}{min(rng.randrange(60), rng.randrange(60))}" for _ in range(100)), "en", "s") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["difference"] for r in lmscore.score_documents(documents(spark, rows), labels).collect()}
    held_out = [(out[i], i % 2) for i in range(100, 200)]
    assert max(d for d, y in held_out if y) < min(d for d, y in held_out if not y)


def test_scores_of_empty_tables_and_long_texts(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert lmscore.score_documents(none, labels).count() == 0
    uniform = math.log(len({w for r in docs.select("text").collect() for w in (r[0] or "").encode().split()}))
    for r in lmscore.score_documents(docs, empty).collect():
        assert r["target_loss"] is None if not r["n_words"] else r["target_loss"] == pytest.approx(uniform)
    out = lmscore.score_documents(documents(spark, [(1, "x y " * 400_000, "en", "s"), (2, "x y", "en", "s")]), labels).orderBy("doc_id").collect()
    assert [r["n_words"] for r in out] == [800_000, 2] and out[0]["target_loss"] == pytest.approx(math.log(2))
    assert out[1]["target_loss"] < out[1]["background_loss"]


# 10 ----------------------------------------------------------------------------------------------------------


def _targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    total = sum(sizes.values())
    target = {s: 0.0 for s in names}
    open_ = set(names)
    left = float(total)
    while open_:
        share = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / share > 3 * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weight[s] / share for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing_meets_targets(spark, docs, mixed_rows, none):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(1, 90)), "en", rng.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(1200)]
    rows += [(5000, None, "en", "a"), (5001, "", "en", "empty"), (5002, "w " * 300, "en", "b")]
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    out = mixing.mix_documents(documents(spark, rows)).collect()
    want = _targets(sizes)
    taken = collections.Counter()
    for r in out:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert len(out) == len(rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 60)
    again = mixing.mix_documents(documents(spark, rows[::-1])).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in out)
    assert mixing.mix_documents(none).count() == 0
    assert mixing.mix_documents(docs).count() == len(mixed_rows)


def test_equal_rows_are_rounded_as_one(spark, monkeypatch):
    """No block holds the rows of a hot document one by one; each row still gets its own copies."""
    rng = random.Random(13)
    rows = [(None, None, "en", "a")] * 1500 + [(7, "x y z", "en", "a")] * 1500 + [(i, prose(rng, 9), "en", "ab"[i % 2]) for i in range(1000, 2000)]
    held, plain = [], mixing.round_to_copies
    monkeypatch.setattr(mixing, "round_to_copies", lambda rated, *a: held.append(rated) or plain(rated, *a))
    monkeypatch.setattr(common, "SPREAD_ROWS", 100)
    out = mixing.mix_documents(documents(spark, rows)).collect()
    assert held[0].groupBy("source", "doc_id", "size").count().agg(F.max("count")).first()[0] == 1
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(i for i, *_ in rows)
    hot = [r["copies"] for r in out if r["doc_id"] == 7]
    assert max(hot) - min(hot) == 1 and sum(hot) / 1500 == pytest.approx(next(r["rate"] for r in out if r["doc_id"] == 7), abs=0.01)
    for s in "ab":
        mine = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 60


def _plain_dual(source, tokens, z, target, cap=3.0, ridge=mixing.RIDGE):
    """The dual by dense Newton steps with a line search, a multiplier for each free source and two moments."""
    free = [s for s in target if 0 < target[s] < cap * tokens[source == s].sum() * (1 - 1e-12)]
    place = {s: k for k, s in enumerate(free)}
    x = np.zeros((len(source), len(free) + 2))
    x[:, -2:] = z
    fixed = np.array([np.nan if s in place else (cap if target[s] > 0 else 0.0) for s in source])
    for i, s in enumerate(source):
        if s in place:
            x[i, place[s]] = 1
    goal, total, live = np.array([target[s] for s in free] + [0.0, 0.0]), sum(target.values()), np.isnan(fixed)
    goal[-2:] -= (tokens[~live] * fixed[~live]) @ z[~live]
    weight = np.array([0.0] * len(free) + [ridge * total] * 2)
    x, w, t = x[live], tokens[live], np.array([np.log(target[s] / tokens[source == s].sum()) for s in free] + [0.0, 0.0])
    value = lambda t: goal @ t - w @ np.where(x @ t < np.log(cap), np.exp(np.minimum(x @ t, np.log(cap))), cap * (1 + x @ t - np.log(cap))) - weight @ (t * t) / 2
    for _ in range(200):
        u = x @ t
        rate = np.exp(np.minimum(u, np.log(cap)))
        g = goal - (w * rate) @ x - weight * t
        h = (x * (w * rate * (u < np.log(cap)))[:, None]).T @ x + np.diag(weight + 1e-9)
        d, step = np.linalg.solve(h, g), 1.0
        while value(t + step * d) < value(t) - 1e-12 * abs(value(t)) and step > 1e-9:
            step /= 2
        t = t + step * d
    out = fixed.copy()
    out[live] = np.minimum(np.exp(x @ t), cap)
    return out


def test_rates_equal_a_plain_solver_of_the_dual(spark):
    """Sources of short and of long documents, one at its cap: the moments couple them and rates differ inside."""
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * max(1, int(rng.lognormvariate(2 + (i % 4) / 2, 0.7)))), "en", "abcd"[i % 4] if i % 9 else None) for i in range(700)]
    rows += [(1000 + i, "few words", "en", "0") for i in range(3)]
    out = mixing.mix_documents(documents(spark, rows)).collect()
    size = np.array([len(t.split()) for _, t, *_ in rows], float)
    source = np.array([src or "~" for *_, src in rows])
    x = np.log1p(size)
    mean = (x @ size) / size.sum()
    z1 = (x - mean) / np.sqrt((x * x) @ size / size.sum() - mean**2)
    z = np.stack([z1, z1 * z1 - 1], 1)
    target = {r["source"] or "~": r["target"] for r in out}
    want = dict(zip((i for i, *_ in rows), _plain_dual(source, size, z, target), strict=True))
    for r in out:
        assert r["rate"] == pytest.approx(want[r["doc_id"]], rel=1e-6, abs=1e-8)
    assert all(len({r["rate"] for r in out if r["source"] == s}) > 5 for s in "abcd")
    rate = np.array([want[i] for i, *_ in rows])
    for s, t in target.items():
        assert (rate * size)[source == s].sum() == pytest.approx(t, rel=1e-6)
    # the mix keeps the corpus' profile of lengths, which equal rates inside sources would not
    flat = np.array([target[s] / size[source == s].sum() for s in source])
    assert abs((rate * size) @ z1) < 0.2 * abs((flat * size) @ z1)


def test_copies_equal_a_plain_fold(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice([0, 1, 5, 9, 40]), rng.choice([1, 1, 3]), round(rng.random() * 3, 3), 300) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, source string, size long, n long, rate double, source_rows long")
    got = collections.Counter()
    for r in mixing.round_to_copies(d, 3, 1000).collect():
        got[r["doc_id"]] += r["copies"]
    for s in "ab":
        error = 0.0
        for i, _, size, n, rate, _ in sorted((r for r in rows if r[1] == s), key=lambda r: (-r[2], r[0])):
            wanted = rate * size * n + error
            copies = min(max(math.floor(wanted / size + 0.5), 0), 3 * n) if size else 0
            error = wanted - copies * size
            assert got[i] == copies


def test_running_sums_need_no_single_task(spark):
    rows = [(i * 7 % 101, float(i % 5)) for i in range(101)]
    d = spark.createDataFrame(rows, "k long, v double")
    got = {r["k"]: (r["position"], r["held"]) for r in common.running(d, [F.col("k").desc()], held=F.col("v")).collect()}
    held = 0.0
    for n, (k, v) in enumerate(sorted(rows, reverse=True)):
        assert got[k] == (n, held)
        held += v


def test_mixed_rows_keep_their_columns(spark, none):
    rng = random.Random(1)
    rows = [(i % 40, prose(rng, 20 + i % 7), "en", "ab"[i % 2]) for i in range(80)] + [(7, "same text", "en", "a")] * 3 + [(8, "hot", "en", "b")] * 3000
    d = documents(spark, rows)
    for name in ("_row", "_copies", "_id", "_mark", "_copy", "n", "rows", "row", "mark", "id"):
        d = d.withColumn(name, F.lit(name))
    out, slim = mixing.mixed(d), mixing.mix_documents(d.select("doc_id", "source", "text"))
    assert out.columns == d.columns
    want = {r["doc_id"]: r["c"] for r in slim.groupBy("doc_id").agg(F.sum("copies").alias("c")).collect() if r["c"]}
    got = collections.Counter(r["doc_id"] for r in out.select("doc_id", "_row", "_copies").collect())
    assert abs(sum(got.values()) - sum(want.values())) <= 30 and got[8] == pytest.approx(want[8], abs=30)
    assert mixing.mixed(none).count() == 0


# stored cuts -------------------------------------------------------------------------------------------------


def test_scopes_remove_what_they_wrote(spark):
    import os

    there = lambda df: os.path.isdir(df._cut_path.removeprefix("file://").removeprefix("file:"))
    with common.scratch(spark):
        with common.scratch(spark):
            inner, kept = common.cut(spark.range(5)), common.cut(spark.range(3), outer=True)
            assert there(inner) and there(kept)
        assert not there(inner) and kept.count() == 3
    assert not there(kept)
    alone = common.cut(spark.range(2))
    common.drop_cut(alone)
    assert not there(alone)


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(ValueError):
        common.shared_dir(Session)


# queries -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(name, spark, small):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    theirs = c.execute(ORACLES[name])
    columns = [x[0] for x in theirs.description]
    mine = QUERIES[name](spark, small)
    assert sorted(columns) == sorted(mine.columns)
    assert sorted(map(tuple, mine.select(*columns).collect())) == sorted(theirs.fetchall())
