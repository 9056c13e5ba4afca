"""The pipeline on a small corpus with planted cases, and its parts against brute force."""

import collections
import math
import random

import numpy as np
import pytest
import test_text_operators as plain

import corpus_pipeline
from adslots.llm import decontaminate, mixing, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, labels = [], []
    for i in range(400):
        rows.append((i, " ".join(word() for _ in range(rng.randint(60, 120))), "en", "abc"[i % 3]))
        labels.append((i, 1, 0))
    for i in range(400, 500):
        rows.append((i, " ".join(word() + "##" for _ in range(80)), "en", "a"))
        labels.append((i, 0, 0))
    leak = " ".join(word() for _ in range(30))
    rows += [(600 + i, rows[i][1], "en", "a") for i in range(10)]  # copies
    rows += [(700 + i, rows[i][1] + " tail", "en", "b") for i in range(10)]  # near copies
    rows += [(800 + i, rows[20 + i][1] + " " + leak + " end", "en", "b") for i in range(5)]
    rows += [(900, None, None, None), (901, "", "en", "a"), (902, "too short", "en", "a"), (0, rows[0][1], "en", "a")]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return f"file://{at}"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, folder))
        if name != "sharding":
            assert docs.columns == columns
        kept[name] = collections.Counter(r["doc_id"] for r in docs.collect())
    good = set(range(400))
    assert len(good - set(kept["quality rules"])) <= 8
    assert not set(kept["quality rules"]) & ({900, 901, 902} | set(range(400, 500)))
    after = kept["n-gram Jaccard join"]
    assert max(after.values()) == 1 and not set(after) & (set(range(600, 610)) | set(range(700, 710)))
    assert set(kept["benchmark decontamination"]) == set(after) - set(range(800, 805))
    mixed = kept["mixing sources to target weights"]
    assert set(mixed) <= set(kept["benchmark decontamination"]) and max(mixed.values()) <= mixing.MAX_COPIES
    assert kept["sharding"] == mixed


def test_run_equals_its_parts(spark, folder):
    """The query's rows against a plain composition: kept ids by the judge's decisions and brute force on sets and
    windows; copies by a plain solver of the dual and a plain fold; shards by a second implementation."""
    docs, labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    judged = {r["doc_id"] for r in quality.judge_documents(docs, labels).where("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in judged}
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    leak = [w.decode() for w in decontaminate.words_of(bench.first()["text"])]
    windows = {tuple(leak[a : a + 10]) for a in range(len(leak) - 9)}
    near, sets = [], {}
    for i in sorted(texts):
        w = texts[i].split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        if not any(len(s & t) >= 0.8 * len(s | t) for t in sets.values()):
            near.append(i)
        sets[i] = s
    clean = [i for i in near if not any(tuple(texts[i].split()[k : k + 10]) in windows for k in range(len(texts[i].split()) - 9))]
    size, source = np.array([len(texts[i].split()) for i in clean], float), np.array([sources[i] for i in clean])
    total = {x: size[source == x].sum() for x in set(source)}
    target, x = plain._targets(total), np.log1p(size)
    mean = (x @ size) / size.sum()
    z1 = (x - mean) / np.sqrt((x * x) @ size / size.sum() - mean**2)
    rates = plain._plain_dual(source, size, np.stack([z1, z1 * z1 - 1], 1), target)
    want = collections.Counter()
    for name in total:  # a source is one block here
        error = 0.0
        for n, i, rate in sorted((-size[k], clean[k], round(rates[k], 9)) for k in range(len(clean)) if source[k] == name):
            wanted = -rate * n + error
            want[i] = min(max(math.floor(wanted / -n + 0.5), 0), 3)
            error = wanted + want[i] * n
    rows = corpus_pipeline.run(spark, folder).collect()
    got = collections.Counter(r["doc_id"] for r in rows)
    assert set(got) <= set(clean) and not set(clean) & set(range(800, 805))
    assert got == +want
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["shard"] == plain._best_shard(r["doc_id"], [1.0] * 8) and r["grown_shard"] == plain._best_shard(r["doc_id"], [1.0] * 9)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_of_empty_tables_and_clashing_columns(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("s", "row", "key", "mark", "n", "stratum", "_key", "_id", "_copies", "_mark", "block", "shard", "kept", "label", "good"):
        docs = docs.withColumn(name, docs["lang"])
    with_more, none = docs, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        with_more, none = corpus_pipeline.cut(stage(spark, with_more, folder)), corpus_pipeline.cut(stage(spark, none, folder))
        assert none.count() == 0 and with_more.count() > 0
        if name != "sharding":
            assert with_more.columns == none.columns == docs.columns
            assert with_more.where("NOT (label <=> lang) OR NOT (_key <=> lang)").count() == 0
    at = str(tmp_path)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{at}").count() == 0
