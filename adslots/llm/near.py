"""N-gram Jaccard join with Bayesian candidate pruning.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

1. Every text gets MinHash values; equal texts become one node. Values are grouped in bands; nodes that share a
   band may be near. A link of exactly 0.8 shares no band with probability 2e-5.
2. Nodes are dealt into chunks: a family (the nodes tied by chains of shared bands) that fits one chunk is one; a larger
   one is cut by each node's home, the largest of its bands, and by CHUNK_NODES and CHUNK_SHINGLES. Only chunks that
   share a band meet, so work and shuffle follow the candidates, however long the chains are.
3. A pair of chunks is one group of work. MinHash values are compared a few at a time; with m of n equal, the
   posterior of the similarity (uniform prior) is a Beta(m+1, n-m+1), and a pair leaves once its probability of 0.8 or
   more is below TOLERANCE. Pairs that stay are verified exactly on their shingle sets.
4. A group reports, for each text, how many links it has, and a spanning forest of its links; never the pairs.
   The forests' components are the classes.

Defined cases: a null text is a class of its own; equal texts, empty ones too, are one class; a text of fewer
than five words has one shingle, of all its words, and one without words has none and is near nothing; repeated
rows are copies; a null doc_id counts as any id and comes last; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, running
from .components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 5
#: Pairs whose posterior probability of reaching the threshold is below this are dropped; hashes a step.
TOLERANCE, STEP = 1e-6, 14
#: A chunk holds about so many nodes, and shingles, at most (a longer text is a chunk by itself).
CHUNK_NODES, CHUNK_SHINGLES = 512, 1_000_000

_RNG = np.random.default_rng(20240101)
_MUL = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(1, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit fingerprints of the text's shingles."""
    words = (text or "").encode().split()  # splits at ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    s = np.full(n, min(len(h), WORDS), np.uint64)
    for j in range(min(WORDS, len(h))):
        s += h[j : j + n] * _PLACE[j]
    return np.unique(_mix(s))


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of fingerprints, in bounded memory."""
    out = np.full(len(_MUL), 1 << 32, np.uint64)
    for a in range(0, len(s), 2048):
        np.minimum(out, ((s[a : a + 2048, None] * _MUL + _ADD) >> np.uint64(32)).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    return _mix((sig.reshape(BANDS, ROWS) * _BAND[:, :ROWS]).sum(axis=1, dtype=np.uint64) + _BAND[:, ROWS]).view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP, hashes: int = BANDS * ROWS) -> dict[int, int]:
    """For each number of compared values, the least number of equal ones at which a pair stays."""
    x = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(step, hashes + 1, step):
        for m in range(n + 1):
            density = np.exp(m * np.log(x) + (n - m) * np.log1p(-x) - (m * math.log(max(m, 1e-9) / n) + (n - m) * math.log(max(n - m, 1e-9) / n)))
            if density[x >= threshold].sum() / density.sum() >= tolerance:
                out[n] = m
                break
    return out


_LEAST = least_matches()


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, bands) of docs(doc_id, text), stored, n the number of shingles; bands is null for texts
    without words."""

    def run(batches):
        for batch in batches:
            for a in range(0, max(batch.num_rows, 1), 500):
                b = batch.slice(a, 500)
                n, bands = [], []
                for t in b.column("text").to_pylist():
                    s = shingles(t)
                    n.append(len(s))
                    bands.append(band_keys(signature(s)) if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(run, "doc_id bigint, text_key string, n bigint, bands array<bigint>"))


def chunks(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, chunk), (chunk, lo, hi)): the chunk of each node of nodes(node, n, bands) that shares a band with
    another, stored, and, for chunks that meet others, the pairs of chunks to compare, with themselves among them."""
    banded = nodes.where("bands IS NOT NULL").select("node", F.explode("bands").alias("band"))
    leaders = cut(banded.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("held")).where("held > 1"))
    ties = cut(banded.join(leaders, "band"))
    family = components(ties.select(F.col("node").alias("a"), F.col("leader").alias("b"))).select("node", F.col("label").alias("family"))
    home = ties.groupBy("node").agg(F.max(F.struct("held", "leader"))["leader"].alias("home"))
    weight = F.greatest(F.lit(1 / CHUNK_NODES), F.col("n") / F.lit(float(CHUNK_SHINGLES)))
    member = family.join(home, "node").join(nodes.select("node", weight.alias("weight")), "node")
    placed = cut(running(member, [F.col(c).asc() for c in ("family", "home", "node")], held=F.col("weight")))
    large = cut(placed.groupBy("family").agg(F.sum("weight").alias("weight")).where("weight > 1").select("family", F.lit(True).alias("large")))
    piece = F.when(F.col("large"), F.xxhash64("home", F.floor("held"))).otherwise(F.xxhash64("family"))
    dealt = cut(placed.join(large, "family", "left").select("node", piece.alias("chunk"), F.coalesce("large", F.lit(False)).alias("large")))
    meets = cut(ties.select("node", "band").join(dealt.where("large"), "node").select("band", "chunk").distinct())
    several = cut(meets.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("band"))
    left = meets.join(several, "band").select("band", F.col("chunk").alias("lo"))
    pairs = left.join(left.select("band", F.col("lo").alias("hi")), "band").where("lo <= hi").select("lo", "hi").distinct()
    both = pairs.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("chunk"), "lo", "hi")
    return dealt.drop("large"), both


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """One pair of chunks: link counts of its nodes and a spanning forest of its links."""
    lo, hi = int(group["lo"].iloc[0]), int(group["hi"].iloc[0])
    group = group.sort_values(["chunk", "node"])
    node, n = group["node"].to_numpy(), len(group)
    left = np.flatnonzero(group["chunk"].to_numpy() == lo)
    right = np.flatnonzero(group["chunk"].to_numpy() == hi)
    sig = np.stack([np.frombuffer(x, np.uint16) for x in group["sig"]])
    i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    i, j = (i[i < j], j[i < j]) if lo == hi else (i, j)
    equal = np.zeros(len(i), np.int32)
    for k, need in _LEAST.items():
        equal += (sig[i, k - STEP : k] == sig[j, k - STEP : k]).sum(axis=1, dtype=np.int32)
        stay = equal >= need
        i, j, equal = i[stay], j[stay], equal[stay]
    counts = np.zeros(n, np.int64)
    edges = []
    if len(i):
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        used = np.unique(np.concatenate([i, j]))
        every, column = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
        bits = np.zeros((n, len(every)), np.uint8) if len(every) * n <= 64_000_000 else None
        sizes = np.array([len(s) for s in sets])
        if bits is not None:
            at = 0
            for u in used:
                bits[u, column[at : at + sizes[u]]] = 1
                at += sizes[u]
            packed = np.packbits(bits, axis=1)
            both = np.concatenate([np.bitwise_count(packed[i[a : a + 4096]] & packed[j[a : a + 4096]]).sum(axis=1, dtype=np.int64) for a in range(0, len(i), 4096)])
        else:
            both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
        linked = both >= THRESHOLD * (sizes[i] + sizes[j] - both) - 1e-9
        i, j = i[linked], j[linked]
        np.add.at(counts, i, 1)
        np.add.at(counts, j, 1)
        root = list(range(n))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                edges.append((a, b))
    has = np.flatnonzero(counts)
    return pd.DataFrame({
        "a": np.concatenate([node[has], node[[e[0] for e in edges]]]).astype(np.int64),
        "b": pd.array([None] * len(has) + node[[e[1] for e in edges]].tolist(), "Int64"),
        "n": pd.array(counts[has].tolist() + [None] * len(edges), "Int64"),
    })


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (a, null, n): n links of node a in one group of work, and (a, b, null): a link of its forest."""
    dealt, pairs = chunks(nodes)
    member = nodes.join(dealt, "node").select("node", "text_key", F.col("doc_id").alias("first_id"), "chunk")
    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), F.md5("text").alias("text_key"), F.col("text").cast("string").alias("text"))

    def prepare(batches):
        for batch in batches:
            for a in range(0, max(batch.num_rows, 1), 500):
                b = batch.slice(a, 500)
                sets = [shingles(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("node"), b.column("chunk"), pa.array([(signature(s) & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["node", "chunk", "sig", "shingles"],
                )

    # a repeated row has the same id and text: its node comes once for each repeat, which drop_duplicates undoes
    ready = (
        texts.join(member, (texts["text_key"] == member["text_key"]) & texts["first_id"].eqNullSafe(member["first_id"]))
        .select("node", "chunk", "text").mapInArrow(prepare, "node bigint, chunk bigint, sig binary, shingles binary")
    )
    # a chunk that meets no other is compared with itself
    sent = ready.join(pairs, "chunk", "left").select("node", "chunk", F.coalesce("lo", "chunk").alias("lo"), F.coalesce("hi", "chunk").alias("hi"), "sig", "shingles")
    return cut(sent.groupBy("lo", "hi").applyInPandas(lambda g: _compare(g.drop_duplicates("node")), "a bigint, b bigint, n bigint"))


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored sketch; (text_key, first_id, label, n_links) of every text; (label, class_id, text_key) of every
    class, the text the one of the least doc_id, of those the least key."""
    rows = sketch(docs)
    nodes = cut(
        rows.where("text_key IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    found = links(docs, nodes)
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    label = components(found.where("b IS NOT NULL").select("a", "b"))
    labelled = cut(
        nodes.select("node", "text_key", "doc_id").join(label, "node", "left").join(counts, "node", "left")
        .select("text_key", F.col("doc_id").alias("first_id"), F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    least = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "text_key")).alias("k")
    # stored, so that the join on a hot label is between plain shuffles
    classes = cut(labelled.groupBy("label").agg(least).select("label", F.col("k.first_id").alias("class_id"), F.col("k.text_key").alias("text_key")))
    return rows, labelled, classes


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, class_id, n_links, first_id for every row of docs(doc_id, text): the class is the least
    doc_id of all texts linked to each other, n_links the number of different texts the row's text is linked
    with, first_id the least doc_id of the rows with an equal text."""
    rows, labelled, classes = _labelled(docs)
    by_text = labelled.join(classes.select("label", "class_id"), "label").select("text_key", "class_id", "n_links", "first_id", "label")
    return rows.select("doc_id", "text_key").join(by_text, "text_key", "left").select(
        "doc_id", "text_key",
        F.when(F.col("text_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("text_key").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("first_id"),
        "label",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with their columns, less all but one of each class: the one with the least doc_id (of
    those the least text key; of rows of one id and text the one with the least fingerprint). Rows with a null text all
    stay. Rows are packed, so no column of `docs` can clash."""
    _, _, classes = _labelled(docs)
    key = lambda text_key, i: F.concat_ws("|", text_key, i.cast("long").cast("string"))
    packed = docs.where("text IS NOT NULL").select(F.struct(*docs.columns).alias("row"), key(F.md5("text"), F.col("doc_id")).alias("key"), F.xxhash64(*docs.columns).alias("mark"))
    # repeats are taken together before the shuffle, so a row that stands very often is one row of each task
    once = packed.groupBy("key").agg(F.min_by("row", "mark").alias("row"))
    kept = once.join(classes.select(key(F.col("text_key"), F.col("class_id")).alias("key")), "key", "left_semi").select("row.*")
    return kept.unionByName(docs.where("text IS NULL"))
