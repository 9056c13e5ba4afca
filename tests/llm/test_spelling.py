"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from adslots.llm import spelling
from adslots.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(word, letters):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            out |= {word[:i] + word[i + 1 :]} | {word[:i] + c + word[i + 1 :] for c in letters}
    return out - {word}


def counted(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(rows):
    n = counted(rows)
    letters = set("".join(n))
    form, out = {}, {}
    for w in n:
        near = edits(w, letters) & n.keys() if len(w) < 200 else {v for v in n if v != w and abs(len(v) - len(w)) < 2 and _apart(v, w)}
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
        out[w] = len(near)
    root = {}
    for w in n:
        root[w] = w
        while form[root[w]]:
            root[w] = form[root[w]]
    return sorted((w, form[w], root[w], n[w], out[w], n[form[w]] if form[w] else None) for w in n)


def _apart(v, w):
    a, b = sorted((v, w), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b))) if len(a) < len(b) else sum(x != y for x, y in zip(a, b)) == 1


def mine(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdeéèæÿ") for _ in range(rng.randint(6, 11))) for _ in range(40)] + ["similar", "Similär", "tractor", "traktor", "listen", "silent", "enlist"]
    words = []
    for s in stems:
        for k in (300, 60, 12, 12, 5, 5):
            t = list(s)
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(t))
                t[i : i + 1] = rng.choice([[], [t[i], rng.choice("abé")], [rng.choice("abcdÀ")]])
            words += ["".join(t)] * k
    words += ["chainword"] * 400 + ["chainwords"] * 50 + ["chainwordes"] * 8
    rng.shuffle(words)
    out = [(i, rng.choice([" ", ", ", "\n", "×÷ "]).join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]
    out += [(9000, None), (9001, ""), (None, "nameless word " * 9), (9002, "12 34"), (9003, "x" * 3000 + " " + "x" * 2999 + "y"), (9003, "again again again again again again")]
    return out + [(9004 + i, "x" * 3000 + " " + "x" * 2999 + "y " + "x" * 2999) for i in range(6)]


def test_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string")
    theirs = brute(rows)
    assert mine(spelling.group_variants(docs)) == theirs
    assert sum(r[1] is not None for r in theirs) > 20 and any(r[2] not in (r[0], r[1]) for r in theirs)


def test_cells(spark, rows, monkeypatch):
    """The same with lengths cut into many cells."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(spelling, "CELL", 5)
    words = spelling.cut(spelling.count_words(docs))
    cells = spelling._cells(words)
    assert len(cells) >= 4 and all(len(t.leaves) >= 2 for t in cells.values())
    assert mine(spelling.group_variants(docs)) == brute(rows)


def test_few_cells_whatever_the_words(spark, rows, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 1)
    monkeypatch.setattr(spelling, "MOST_CELLS", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cells = spelling._cells(spelling.cut(spelling.count_words(docs)))
    assert sum(len(t.leaves) for t in cells.values()) <= 64
    assert mine(spelling.group_variants(docs)) == brute(rows)


def test_every_cell_near_enough_is_visited():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 3, (500, spelling.DIMS)).astype(np.int16)
    points[:, 6:] = 0
    tree = spelling.Tree(points, 8)
    for radius in (0, 1, 2):
        met = {(int(r), int(p)) for leaf, rows in tree.visit(points[:60], radius) for r in rows for p in tree.leaves[leaf]}
        near = np.argwhere(np.abs(points[:60, None] - points[None]).sum(2) <= radius)
        assert {tuple(map(int, x)) for x in near} <= met
        assert len(met) < 60 * 500


def test_roots(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(26)] + [("x", "w3")], "word string, form string")
    assert {r.root for r in spelling.roots(chain).collect()} == {"w26"}


def test_empty(spark):
    assert spelling.group_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert mine(QUERIES["op12_spelling_variants"](spark, small)) == brute(rows)
