"""Alignment of two tokenizers over a corpus: which tokens of one cover the bytes of which of the other, and how often.

Both tokenizers cut the same bytes (a space and the text). Where tokens of both end at one byte, a group ends; a link is
a pair of token occurrences whose byte ranges overlap. The corpus-wide count of an id pair is the number of documents
that hold it linked, and links are scored by their pair's count.

* A task encodes documents and numbers them inside a block. A block ends at `ENTRIES` (document, pair) entries or 2^16
  documents, so its size doesn't depend on the corpus. From a block comes one posting for each id pair: a compressed
  bitmap of the block's documents (two bytes for each set bit, or one bit for each document, whichever is less) and
  multiplicity planes: plane k has, for each set document, bit k of its number of links less one. Postings are stored.
* Blocks hold different documents, so a pair's bitmaps are OR-merged by laying them side by side, and their popcounts add
  up to its document count; a plane's popcount counts 2^k links for each bit. Spark sums both by pair.
* Postings meet their pair's count and go back to their block, where each set bit adds its links' scores to its document.
  Nothing is ever a row for each link or for each document of a pair.

A row is a document: repeated rows and equal texts count each. Defined cases: null and empty texts, and texts whose
tokens' bytes joined aren't the space and the text, have no tokens, zeros and the empty string; a text of any length is
encoded whole; the strings of special tokens are plain text; a null doc_id is kept; among equally frequent pairs of an id
all are best; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: (document, pair) entries of a block, its documents, and bytes of text encoded at a time.
ENTRIES, DOCUMENTS, PIECE = 4_000_000, 1 << 16, 2 << 20
#: Bytes that a tokenizer's file may have, as it's sent to every executor.
LARGEST = 64 << 20
#: Code points from which on a text is encoded by the file's own library, as the faster one's pattern has a stack of 10^6.
LONG = 250_000
_ID_BITS, _DOC_BITS = 23, 16
#: The pre-tokenizer's pattern of the byte-level tokenizer, and the sign for a space in pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "▁"


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(LARGEST + 1)
    if len(data) > LARGEST:
        raise ValueError(f"{path} is too large to send to every executor")
    return data


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, other bytes follow at 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteLevel:
    """A byte-level BPE tokenizer from its JSON. The id of a merge's product grows with the merge's turn, so ids serve as
    ranks for a faster library; very long texts, and all where a file doesn't have that order, go to the file's own."""

    def __init__(self, data: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(data)
        model, letters = spec["model"], _byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        self.table = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if t not in special}
        turns = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self._ranked = turns == sorted(turns) and len(set(turns)) == len(turns) and len(turns) + 256 == len(self.table)
        self._fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks={v: k for k, v in self.table.items()}, special_tokens={})
        self._own = Tokenizer.from_str(data.decode())
        self._own.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        fast = [self._ranked and len(t) < LONG for t in texts]
        return [self._fast.encode_ordinary(t) if f else self._own.encode(t, add_special_tokens=False).ids for t, f in zip(texts, fast)]


class Pieces:
    """A piece tokenizer from its model; it puts the space before the text itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=data)
        piece = lambda i: bytes([int(own.id_to_piece(i)[1:-1], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace(SPACE, " ").encode()
        self.table = {i: piece(i) for i in range(own.get_piece_size())}
        self.encode = lambda texts: own.encode(texts, num_threads=1)


@cache
def _loaded(kind: type, data: bytes):
    return kind(data)


class Aligner:
    """Aligns texts in pieces of some megabytes."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.sides = [self._side(a.table, (b",", b"|")), self._side(b.table, (b",", b";"))]

    @staticmethod
    def _side(table: dict[int, bytes], marks: tuple[bytes, bytes]) -> tuple[list, np.ndarray, np.ndarray]:
        """Bytes and lengths by id, and the written form of an id inside and at the end of a group."""
        n = max(table) + 1
        every = [table.get(i, b"") for i in range(n)]
        return every, np.array([len(t) for t in every], np.int64), np.array([[b"%d" % i + m for m in marks] for i in range(n)], "S9")

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links) and the digest of each text's groups; and the document, id of A and id of B of
        every link, in order."""
        counts, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        ids, docs = ([], []), []
        for i, a, b in zip(some, self.a.encode([" " + texts[i] for i in some]), self.b.encode([texts[i] for i in some]), strict=True):
            data = b" " + texts[i].encode()
            if all(b"".join(map(side[0].__getitem__, own)) == data for side, own in zip(self.sides, (a, b))):
                ids[0].append(a)
                ids[1].append(b)
                docs.append(i)
        if not docs:
            return counts, digests, *(np.zeros(0, np.int64),) * 3
        flat = [np.concatenate([np.array(x, np.int64) for x in one]) for one in ids]
        ends = [np.cumsum(side[1][x]) for side, x in zip(self.sides, flat)]
        every = np.sort(np.concatenate(ends), kind="stable")  # of two runs in order
        twice = every[1:] == every[:-1]
        common, links = every[1:][twice], every[np.append(True, ~twice)]
        n = [np.array([len(x) for x in one]) for one in ids]
        tokens = [np.repeat(np.arange(len(docs)), k) for k in n]
        at = [np.searchsorted(e, links) for e in ends]
        link_doc = tokens[0][at[0]]
        n_links = np.bincount(link_doc, minlength=len(docs))
        counts[docs] = np.stack([n[0], n[1], n[0] + n[1] - n_links, n_links], 1)

        # in the written form, tokens of A are preceded by those of B in earlier groups, those of B by A's up to their own
        group = [np.searchsorted(common, e) for e in ends]
        before = np.append(0, np.searchsorted(ends[1], common, "right"))
        place = [np.arange(len(flat[0])) + before[group[0]], np.arange(len(flat[1])) + np.searchsorted(ends[0], common, "right")[group[1]]]
        written = np.empty(len(flat[0]) + len(flat[1]), "S9")
        for side, x, e, g, p in zip(self.sides, flat, ends, group, place):
            written[p] = side[2][x, (common[g] == e).astype(np.int8)]
        stop = np.cumsum(n[0] + n[1])
        for i, lo, hi in zip(docs, np.append(0, stop), stop):
            digests[i] = hashlib.sha256(written[lo:hi].tobytes().replace(b"\0", b"")[:-1]).hexdigest()
        return counts, digests, np.array(docs)[link_doc], flat[0][at[0]], flat[1][at[1]]


def pack(entries: np.ndarray, times: np.ndarray, n_docs: int) -> dict[str, pa.Array]:
    """Postings from entries (pair << 16 | document, in order) with their numbers of links."""
    pair, doc = entries >> _DOC_BITS, entries & ((1 << _DOC_BITS) - 1)
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    n = np.diff(np.append(first, len(pair)))
    row = np.repeat(np.arange(len(first)), n)
    rank = np.arange(len(pair)) - first[row]

    width = (n_docs + 7) // 8
    sparse = 2 * n <= width
    start = np.append(0, np.cumsum(np.where(sparse, 2 * n, width)))
    bits = np.zeros(start[-1], np.uint8)
    own = sparse[row]
    at = start[row[own]] + 2 * rank[own]
    bits[at], bits[at + 1] = doc[own] & 255, doc[own] >> 8
    _set(bits, start[row[~own]] * 8 + doc[~own])

    extra = times - 1
    high = np.maximum.reduceat(extra, first)
    planes = np.where(high > 0, np.floor(np.log2(np.maximum(high, 1))).astype(np.int64) + 1, 0)
    each = (n + 7) // 8
    begin = np.append(0, np.cumsum(planes * each))
    marks = np.zeros(begin[-1], np.uint8)
    for k in range(int(planes.max())):
        on = (extra >> k) & 1 == 1
        _set(marks, (begin[row[on]] + k * each[row[on]]) * 8 + rank[on])
    links = np.add.reduceat(times, first)
    binary = lambda ends, data: pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    return {
        "a": pa.array((pair[first] >> _ID_BITS).astype(np.int32)), "b": pa.array((pair[first] & ((1 << _ID_BITS) - 1)).astype(np.int32)),
        "n_docs": pa.array(n.astype(np.int64)), "n_links": pa.array(links.astype(np.int64)), "docs": binary(start, bits), "planes": binary(begin, marks),
    }


def _set(data: np.ndarray, bits: np.ndarray) -> None:
    """Sets bits, given in order, in zeroed bytes."""
    if len(bits):
        byte = bits >> 3
        first = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
        data[byte[first]] = np.bitwise_or.reduceat(np.left_shift(1, bits & 7).astype(np.uint8), first)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and bytes of a binary column."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def unpack(n: np.ndarray, docs: pa.Array, planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, document, times) of every set bit of some postings."""
    start, bits = _binary(docs)
    size = np.diff(start)
    sparse = size == 2 * n
    row = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    doc = np.empty(len(row), np.int64)
    own = sparse[row]
    at = start[row[own]] + 2 * rank[own]
    doc[own] = bits[at].astype(np.int64) | bits[at + 1].astype(np.int64) << 8
    dense = np.flatnonzero(~sparse)
    if len(dense):
        width = int(size[dense[0]])  # all of a block
        whole = np.unpackbits(bits[start[dense][:, None] + np.arange(width)], axis=1, bitorder="little")
        doc[~own] = np.nonzero(whole)[1]
    begin, marks = _binary(planes)
    each = (n + 7) // 8
    count = np.diff(begin) // each
    times = np.ones(len(row), np.int64)
    for k in range(int(count.max(initial=0))):
        has = count[row] > k
        at = begin[row[has]] + k * each[row[has]]
        times[has] += (marks[at + (rank[has] >> 3)].astype(np.int64) >> (rank[has] & 7) & 1) << k
    return row, doc, times


_PAIR = [("a", "int"), ("b", "int"), ("n_docs", "long"), ("n_links", "long"), ("docs", "binary"), ("planes", "binary")]
_DOC = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_doc_links", "long"), ("groups_sha256", "string")]


def postings(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """Stored rows of two kinds: documents (block, nth, doc_id, n_a, n_b, n_groups, n_doc_links, groups_sha256), and
    postings (block, a, b, n_docs, n_links, docs, planes), whose nth is null."""
    held = docs.sparkSession.sparkContext.broadcast((read_file(a_path), read_file(b_path)))
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("nth", T.IntegerType()), T.StructField("doc_id", id_type), *T._parse_datatype_string(", ".join(f"{c} {t}" for c, t in _DOC + _PAIR)).fields])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def rows(block: int, n: int, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
        columns["block"] = pa.array(np.full(n, block))
        whole = pa.table([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)
        yield from whole.to_batches(max_chunksize=20_000)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(_loaded(ByteLevel, held.value[0]), _loaded(Pieces, held.value[1]))
        block, n, entries = TaskContext.get().partitionId() << 32, 0, []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, n, entries, size
            if size:
                keys, times = (np.concatenate(x) for x in zip(*entries))
                order = np.argsort(keys, kind="stable")
                yield from rows(block, len(np.unique(keys >> _DOC_BITS)), **pack(keys[order], times[order], n))
            block, n, entries, size = block + 1, 0, [], 0

        def aligned(ids: pa.Array, texts: list) -> Iterator[pa.RecordBatch]:
            nonlocal n, size
            counts, digests, doc, a, b = aligner.align(texts)
            at = n
            keys, times = np.unique((a << _ID_BITS | b) << _DOC_BITS | (doc + at), return_counts=True)
            entries.append((keys, times))
            n, size = n + len(texts), size + len(keys)
            yield from rows(block, len(texts), nth=pa.array(np.arange(at, n)), doc_id=ids, **{c: pa.array(counts[:, k]) for k, (c, _) in enumerate(_DOC[:4])}, groups_sha256=pa.array(digests))
            if size >= ENTRIES:
                yield from flush()

        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            lo = weight = 0
            for hi, text in enumerate(texts, 1):
                weight += len(text or "")
                if weight >= PIECE or hi == len(texts) or n + hi - lo == DOCUMENTS:
                    yield from aligned(ids[lo:hi], texts[lo:hi])
                    lo, weight = hi, 0
                    if n == DOCUMENTS:
                        yield from flush()
        yield from flush()

    out = cut(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema))
    held.unpersist()
    return out


def pair_counts(stored: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links) of every id pair, from `postings`."""
    return stored.where("nth IS NULL").groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))


def _score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the scores of each document of a block over the block's postings, which come one after another."""
    now, sums = None, None

    def done() -> pa.RecordBatch:
        nth = np.flatnonzero(sums[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(nth), now)), pa.array(nth.astype(np.int32)), pa.array(sums[nth, 0]), pa.array(sums[nth, 1])], names=["block", "nth", "n_best", "count_sum"])

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        edges = np.append(np.append(0, np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(blocks))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if lo == hi:
                continue
            if blocks[lo] != now:
                if now is not None:
                    yield done()
                now, sums = blocks[lo], np.zeros((DOCUMENTS, 2), np.int64)
            part = batch.slice(lo, hi - lo)
            row, doc, times = unpack(part.column("n_docs").to_numpy(), part.column("docs"), part.column("planes"))
            scores = np.stack([part.column("best").to_numpy(zero_copy_only=False).astype(np.int64)[row] * times, part.column("count").to_numpy()[row] * times], 1)
            order = np.argsort(doc, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(doc[order]) > 0))
            sums[doc[order][first]] += np.add.reduceat(scores[order], first)
    if now is not None:
        yield done()


def align_documents(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    stored = postings(docs, a_path, b_path)
    of_pair = pair_counts(stored).select("a", "b", F.col("n_docs").alias("count"))
    scored = of_pair.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("a")))  # as many as B has ids
    met = stored.where("nth IS NULL").select("block", "a", "b", "n_docs", "docs", "planes").join(scored, ["a", "b"])
    back = met.drop("a", "b").repartition("block").sortWithinPartitions("block")
    sums = back.mapInArrow(_score, "block long, nth int, n_best long, count_sum long")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    found = stored.where("nth IS NOT NULL").join(sums, ["block", "nth"], "left")
    return found.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_doc_links").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
