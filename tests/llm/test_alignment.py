"""Cross-tokenizer alignment against brute force, with the tokenizers' own libraries."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adslots.llm import alignment
from adslots.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH)


def brute(rows, tokenizers):
    a, b = tokenizers
    letters = alignment._byte_letters()
    done, docs_of = [], collections.defaultdict(set)
    for k, (i, text) in enumerate(rows):
        ia = ib = ()
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba = [bytes(letters[c] for c in a.id_to_token(t)) for t in ia]
            bb = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in ib]
            if not b"".join(ba) == b"".join(bb) == b" " + text.encode():
                ia = ib = ()
        links, groups, p, q, x, y = [], [[[], []]], 0, 0, 0, 0
        while x < len(ia):
            links.append((ia[x], ib[y]))
            ea, eb = p + len(ba[x]), q + len(bb[y])
            if ea <= eb:
                groups[-1][0].append(ia[x])
                p, x = ea, x + 1
            if eb <= ea:
                groups[-1][1].append(ib[y])
                q, y = eb, y + 1
            if ea == eb:
                groups.append([[], []])
        for link in links:
            docs_of[link].add(k)
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups[:-1])
        done.append((i, len(ia), len(ib), len(groups) - 1, links, hashlib.sha256(text.encode()).hexdigest() if ia else ""))
    best = collections.Counter()
    for (x, _), held in docs_of.items():
        best[x] = max(best[x], len(held))
    n = lambda link: len(docs_of[link])
    return sorted([(i, na, nb, g, len(ls), sum(n(v) == best[v[0]] for v in ls), sum(map(n, ls)), sha) for i, na, nb, g, ls, sha in done], key=repr)


def mine(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = "the The tokenizers' naïve café 12345 été 你好 😀 don't x1y2   ▁ <|endoftext|> <s> </s> <unk> <0x41> ﬁ ½ \t \n\n á \x00 \x7f".split(" ")
    out = [(i, "".join(rng.choice(words) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randint(1, 80)))) for i in range(150)]
    out += [(200 + i, "Equal texts count as often as they stand.") for i in range(30)]
    out += [(300, None), (301, ""), (None, "no name"), (302, " "), (303, "\n"), (304, " leading"), (305, "trailing "), (306, "a" * 5000), (307, " " * 5000), (308, "the " * 30_000), (306, "again")]
    return out


def test_brute_force(spark, rows, tokenizers):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, docs string").repartition(3)
    assert mine(alignment.align_documents(docs)) == brute(rows, tokenizers)


def test_blocks_of_every_size(spark, rows, tokenizers, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(alignment, "PIECE", 300)
    for entries in (1, 100):
        monkeypatch.setattr(alignment, "ENTRIES", entries)
        stored = alignment.postings(docs)
        assert stored.select("block").distinct().count() > 10
        assert mine(alignment.align_documents(docs)) == brute(rows, tokenizers)


def test_pair_counts(spark, rows, tokenizers):
    stored = alignment.postings(spark.createDataFrame(rows, "doc_id long, text string"))
    counts = alignment.pair_counts(stored)
    assert counts.agg(F.sum("n_links")).first()[0] == sum(r[4] for r in brute(rows, tokenizers))
    assert counts.agg(F.max("n_docs")).first()[0] <= len(rows)


def test_packed_round_trip():
    rng = np.random.default_rng(1)
    for n_docs in (1, 9, 700, 1 << 16):
        keys = np.unique(rng.integers(0, 40, 5000) ** 2 << 16 | rng.integers(0, n_docs, 5000))
        times = rng.geometric(0.6, len(keys))
        p = alignment.pack(keys, times, n_docs)
        row, doc, t = alignment.unpack(p["n_docs"].to_numpy(), p["docs"], p["planes"])
        pairs = p["a"].to_numpy().astype(np.int64) << 23 | p["b"].to_numpy()
        assert np.array_equal(pairs[row] << 16 | doc, keys) and np.array_equal(t, times)
        assert p["n_links"].to_numpy().sum() == times.sum()
        assert isinstance(p["docs"], pa.BinaryArray)


def test_ids_serve_as_ranks(tokenizers, rows):
    a = alignment.ByteLevel(alignment.read_file(alignment.A_PATH))
    assert a._ranked
    texts = [" " + t for _, t in rows if t]
    assert a.encode(texts) == [tokenizers[0].encode(t, add_special_tokens=False).ids for t in texts]


def test_very_long_runs():
    """Of one letter and of spaces, where the faster library's pattern would overflow."""
    a = alignment.ByteLevel(alignment.read_file(alignment.A_PATH))
    for text in (" " * 2_000_000, "a" * 1_000_000):
        assert b"".join(map(a.table.__getitem__, a.encode([text])[0])) == text.encode()


def test_empty(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, small, tokenizers):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert mine(QUERIES["op13_tokenizer_alignment"](spark, small)) == brute(rows, tokenizers)
