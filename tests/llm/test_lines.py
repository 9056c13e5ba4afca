"""Line dedup against brute force."""

import collections
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from adslots.llm import lines
from adslots.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_length=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        gone = [len(k) >= min_length and len(held[k]) >= min_docs and i != max(held[k], key=lambda v: (v is not None, v or 0)) for k in map(key, every)]
        kept = "\n".join(line for line, g in zip(every, gone) if not g)
        out.append((i, len(every), sum(gone), kept))
    return sorted(out, key=repr)


def mine(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    shared = [f"A shared line number {k} of the whole corpus é" for k in range(30)]
    pad = lambda s: rng.choice(["", " ", "\t\r"]) + (s.upper() if rng.random() < 0.3 else s) + rng.choice(["", "  ", "\x0b"])
    out = [(i, "\n".join(pad(rng.choice(shared)) if rng.random() < 0.6 else f"own line {i} {j} of this text here" for j in range(rng.randint(1, 12)))) for i in range(60)]
    out += [(100 + i, "the line that a third of all rows hold\n" * 3) for i in range(40)]  # hot
    out += [(200, None), (201, ""), (202, "\n\n"), (None, "the line that a third of all rows hold\nand one more"), (None, shared[0]), (203, "short\nshort"), (204, "short"), (205, "short")]
    out += [(206, shared[1] + "\nx"), (206, shared[1] + "\nx"), (206, "y\n" + shared[1] + "\n" + shared[1]), (207, "exactly 20 code poin")]
    out += [(208, "exactly 20 code poin"), (209, "EXACTLY 20 CODE POIN "), (210, "only nineteen code p"[:19]), (211, "only nineteen code p"[:19]), (212, "only nineteen code p"[:19])]
    out += [(300, "\n".join(rng.choice(shared) if rng.random() < 0.01 else f"line {j} of a very long text of many lines" for j in range(20_000)))]
    return out


def test_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, 5, "w") for i, t in rows], "doc_id long, text string, pos long, words string")
    assert mine(lines.dedup_lines(docs)) == brute(rows)
    assert mine(lines.dedup_lines(docs, 10, 2)) == brute(rows, 10, 2)


def test_every_key_hot_or_none(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (1, 1 << 40):
        monkeypatch.setattr(lines, "HOT_SHARE", share)
        assert mine(lines.dedup_lines(docs)) == brute(rows)


def test_bitmaps(spark):
    docs = spark.createDataFrame([(i, "\n".join(["a line that all of them hold"] + ["-"] * 99 + ["another line that all hold"])) for i in range(3)], "doc_id long, text string")
    found = {r.doc_id: r for r in lines.keep_bitmaps(docs).collect()}
    assert set(found) == {0, 1}
    assert [(w.word, w.bits) for w in found[0].words] == [(0, 1), (1, 1 << (100 - 63))] and found[0].n_dropped == 2


def test_empty(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ranges_without_a_second_shuffle(spark, rows):
    """Windows use the ranges as they are."""
    plan = lines.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan


def test_sql(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op11_line_dedup"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = duck.execute(ORACLES["op11_line_dedup"]).fetchall()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(theirs, key=repr)
    assert sorted(theirs, key=repr) == sorted(((i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute(rows)), key=repr)
