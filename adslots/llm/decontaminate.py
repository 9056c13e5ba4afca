"""Benchmark decontamination on a distributed positional inverted index.

`build_index` stores the postings of every token of every document: documents are taken in blocks, and a row
holds one block with its terms and, for each term, the ascending positions (differences, one word numbering
for the whole block) at which it stands. `phrase_matches` looks up phrases block by block: the postings of a
phrase's rarest term in that block, shifted back by its offset, are the candidate starts, which are intersected
with the shifted postings of the next rarest term, and so on. Words themselves are compared, not hashes, so
matches are exact. `proximity_matches` asks for terms close to each other in any order; `phrase_matches` also asks it
for each item's NEAR_TERMS longest words, and names the items in whose reach a document comes without a phrase of theirs.

The phrases travel to all tasks; they are taken in passes of about PASS_WORDS words, so what the driver holds and
broadcasts at a time has a fixed bound. Tasks cut an item longer than an eighth of a pass into pieces, which overlap by
a window less one word, so that each window stands in one. A larger benchmark takes more passes over the index; the
matches of each are stored, and its broadcast released, before the next begins.

Defined cases: null texts have no words; benchmark rows without id or words have no windows; an item shorter
than a window is one window, and one of fewer than NEAR_TERMS different words is near nothing; repeated documents are reported one by one; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

WINDOW = 10
#: Words in a block of the index (a longer document is a block by itself), and of phrases in one pass.
BLOCK_WORDS, PASS_WORDS = 500_000, 500_000
#: A document is near an item if so many of the item's words, the longest different ones (of equally long ones the least
#: in code-point order), stand within so many words of the longest.
NEAR_TERMS, NEAR_WORDS = 3, 10

INDEX = "block string, doc_ids array<bigint>, n_words array<bigint>, terms binary, counts binary, deltas binary"
MATCHES = "block string, ord bigint, doc_id bigint, n_words bigint, spans array<struct<start: bigint, stop: bigint>>, items array<string>, near array<string>"

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # the word class of the contract, on UTF-8 after lower-casing A-Z


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode().lower()) if text else []


class Postings:
    """The postings of one block: for each term its ascending positions."""

    def __init__(self, terms: dict[bytes, int], lengths: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        self.terms, self.lengths, self.counts, self.positions = terms, lengths, counts, positions
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.doc_first = np.concatenate([[0], np.cumsum(lengths)])

    @classmethod
    def of_texts(cls, texts: list[str | None]) -> Postings:
        terms: dict[bytes, int] = {}
        ids, lengths = [], []
        for t in texts:
            words = words_of(t)
            lengths.append(len(words))
            ids.append(np.fromiter((terms.setdefault(w, len(terms)) for w in words), np.int32, len(words)))
        every = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return cls(terms, np.array(lengths, np.int64), np.bincount(every, minlength=len(terms)), np.argsort(every, kind="stable"))

    @classmethod
    def of_row(cls, terms: bytes, counts: bytes, deltas: bytes, lengths) -> Postings:
        counts_, steps = np.frombuffer(counts, np.uint32).astype(np.int64), np.frombuffer(deltas, np.uint32).astype(np.int64)
        ends = np.cumsum(counts_)
        running = np.cumsum(steps)
        before = np.where(ends - counts_ > 0, running[np.maximum(ends - counts_ - 1, 0)], 0) if len(counts_) else np.zeros(0, np.int64)
        words = terms.split(b" ") if terms else []
        return cls(dict(zip(words, range(len(words)), strict=True)), np.asarray(lengths, np.int64), counts_, running - np.repeat(before, counts_))

    def row(self) -> tuple[bytes, bytes, bytes]:
        steps = np.diff(self.positions, prepend=0)
        filled = self.counts > 0
        starts = self.first[:-1][filled]
        steps[starts] = self.positions[starts]
        return b" ".join(self.terms), self.counts.astype(np.uint32).tobytes(), steps.astype(np.uint32).tobytes()

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_first, position, side="right") - 1

    def phrases(self, vocabulary: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every occurrence; windows: equally long rows of vocabulary numbers."""
        local = np.fromiter((self.terms.get(w, -1) for w in vocabulary), np.int64, len(vocabulary))
        rows = local[windows]
        alive = np.flatnonzero((rows >= 0).all(axis=1))
        rows = rows[alive]
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        by_rarity = np.argsort(self.counts[rows], axis=1, kind="stable")
        span = int(self.doc_first[-1]) + 1
        keys = np.repeat(np.arange(len(self.counts)), self.counts) * span + self.positions  # ascending: (term, position)
        found_w, found_s = [], []
        # so many candidates at a time that memory stays bounded
        rarest = self.counts[np.take_along_axis(rows, by_rarity[:, :1], 1)[:, 0]]
        cuts = np.flatnonzero(np.diff(np.cumsum(rarest) // 2_000_000)) + 1
        for part in np.split(np.arange(len(rows)), cuts):
            term, offset = np.take_along_axis(rows[part], by_rarity[part, :1], 1)[:, 0], by_rarity[part, 0]
            n = self.counts[term]
            who = np.repeat(part, n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = self.positions[np.repeat(self.first[term], n) + inside] - np.repeat(offset, n)
            keep = (start >= 0) & (start + rows.shape[1] < span)
            who, start = who[keep], start[keep]
            for k in range(1, rows.shape[1]):
                if not len(who):
                    break
                offset = by_rarity[who, k]
                want = rows[who, offset] * span + start + offset
                at = np.searchsorted(keys, want)
                keep = keys[np.minimum(at, len(keys) - 1)] == want
                who, start = who[keep], start[keep]
            keep = self.document(start) == self.document(start + rows.shape[1] - 1)
            found_w.append(alive[who[keep]])
            found_s.append(start[keep])
        return np.concatenate(found_w), np.concatenate(found_s)

    def near(self, terms: list[bytes], within: int) -> np.ndarray:
        """Documents in which every term stands at most `within` words from one occurrence of the first."""
        ids = [self.terms.get(t, -1) for t in terms]
        if not ids or min(ids) < 0:
            return np.zeros(0, np.int64)
        centre = self.positions[self.first[ids[0]] : self.first[ids[0] + 1]]
        for i in sorted(ids[1:], key=lambda i: self.counts[i]):  # rarity is only the order
            held = self.positions[self.first[i] : self.first[i + 1]]
            at = np.searchsorted(held, centre)
            ok = np.zeros(len(centre), bool)
            for side in (np.maximum(at - 1, 0), np.minimum(at, len(held) - 1)):
                ok |= (np.abs(held[side] - centre) <= within) & (self.document(held[side]) == self.document(centre))
            centre = centre[ok]
        return np.unique(self.document(centre))


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs(doc_id, text); no shuffle."""

    def build(batches):
        from pyspark import TaskContext

        rows = ((i, t) for b in batches for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True))
        held_ids, held, size, n = [], [], 0, 0

        def out():
            p = Postings.of_texts(held)
            terms, counts, deltas = p.row()
            return pa.RecordBatch.from_pylist(
                [{"block": f"{TaskContext.get().partitionId()}-{n}", "doc_ids": held_ids, "n_words": p.lengths.tolist(), "terms": terms, "counts": counts, "deltas": deltas}],
                schema=pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.binary()), ("deltas", pa.binary())]),
            )

        for i, t in rows:
            held_ids.append(i)
            held.append(t)
            size += len(t or "") // 6 + 1
            if size >= BLOCK_WORDS:
                yield out()
                held_ids, held, size, n = [], [], 0, n + 1
        if held:
            yield out()

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(build, INDEX))


def pieces(benchmark: DataFrame, window: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """(item_id, words, near): an item's words, of a long item in several rows, and in its first row what is asked for
    in `near`."""
    length = max(window, pass_words // 8)

    def split(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                longest = sorted(set(words), key=lambda w: (-len(w), w))[:NEAR_TERMS]
                near = b" ".join(longest).decode() if len(longest) == NEAR_TERMS else None
                for at in range(0, max(len(words) - window + 1, min(len(words), 1)), length - window + 1):
                    out.append((item, b" ".join(words[at : at + length]).decode(), None if at else near))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(3)], names=["item_id", "words", "near"])

    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.distinct().mapInArrow(split, "item_id string, words string, near string")


class Phrases:
    """The windows of a pass: a vocabulary, by length the windows with their item, and what is asked for nearby."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW, near: list[tuple[str, list[bytes]]] = ()):
        number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        self.items = [i for i, _ in items]
        for k, (_, words) in enumerate(items):
            ids = [number.setdefault(w, len(number)) for w in words]
            length = min(window, len(ids))
            for s in range(len(ids) - length + 1) if length else ():
                by_length.setdefault(length, {}).setdefault(tuple(ids[s : s + length]), set()).add(k)
        self.near = list(near)
        self.vocabulary = list(number)
        self.windows = {n: (np.array(list(w), np.int64), [sorted(x) for x in w.values()]) for n, w in by_length.items()}

    def search(self, p: Postings) -> dict[int, tuple[list[tuple[int, int]], list[str]]]:
        """By document of the block with a match: its spans of words, joined, and its items."""
        marks = np.zeros(int(p.doc_first[-1]) + 1, np.int64)
        items: dict[int, set[int]] = {}
        for length, (windows, owners) in self.windows.items():
            which, start = p.phrases(self.vocabulary, windows)
            np.add.at(marks, start, 1)
            np.add.at(marks, start + length, -1)
            for d, w in set(zip(p.document(start).tolist(), which.tolist(), strict=True)):
                items.setdefault(d, set()).update(owners[w])
        hit = np.cumsum(marks)[:-1] > 0
        out = {}
        for d, found in items.items():
            a, b = int(p.doc_first[d]), int(p.doc_first[d + 1])
            edges = np.flatnonzero(np.diff(hit[a:b].astype(np.int8), prepend=0, append=0))
            out[d] = (list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), sorted({self.items[k] for k in found}))
        return out


    def close(self, p: Postings) -> dict[int, set[str]]:
        """By document of the block, the items that it is near."""
        out: dict[int, set[str]] = {}
        for item, terms in self.near:
            for d in p.near(terms, NEAR_WORDS).tolist():
                out.setdefault(d, set()).add(item)
        return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, ascending; those that touch are one."""
    if not spans:
        return []
    a, b = np.array(spans, np.int64)[np.argsort([s for s, _ in spans], kind="stable")].T
    b = np.maximum.accumulate(b)
    first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return list(zip(a[first].tolist(), b[np.append(first[1:], len(a)) - 1].tolist(), strict=True))


def passes(benchmark: DataFrame, window: int = WINDOW, pass_words: int = PASS_WORDS) -> Iterator[tuple[Broadcast, bool]]:
    """The benchmark's items, in passes of bounded size, each broadcast, and whether it is the only one. A pass that is
    not is released when the next is asked for."""
    rows = cut(pieces(benchmark, window, pass_words))
    chars = rows.agg(F.sum(F.length("words"))).first()[0] or 0
    n = max(1, -(-chars // (4 * pass_words)))
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == i)
        held = [(r[0], r[1].encode().split(), r[2]) for r in part.sort("item_id", "words").toLocalIterator()]
        phrases = Phrases([x[:2] for x in held], window, [(item, near.encode().split()) for item, _, near in held if near])
        sent = benchmark.sparkSession.sparkContext.broadcast(phrases)
        del phrases, held
        yield sent, n == 1
        if n > 1:
            sent.destroy()
    drop_cut(rows)


def phrase_matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """A row for every document: its words, the spans of words inside any window's occurrence, the items that have one,
    and the items that it is near. Stored."""

    def searcher(sent):
        def search(batches):
            phrases = sent.value
            for batch in batches:
                for r in batch.to_pylist():
                    p = Postings.of_row(r["terms"], r["counts"], r["deltas"], r["n_words"])
                    found = phrases.search(p)
                    n = len(r["doc_ids"])
                    at = [found.get(d, ((), ())) for d in range(n)]
                    close = phrases.close(p)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["block"]] * n), pa.array(range(n), pa.int64()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["n_words"], pa.int64()),
                         pa.array([[{"start": a, "stop": b} for a, b in s] for s, _ in at], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                         pa.array([sorted(i) for _, i in at], pa.list_(pa.string())), pa.array([sorted(close.get(d, ())) for d in range(n)], pa.list_(pa.string()))],
                        names=["block", "ord", "doc_id", "n_words", "spans", "items", "near"],
                    )

        return search

    def tidy(batches):
        for batch in batches:
            spans = pa.array([joined([(s["start"], s["stop"]) for s in row]) for row in batch.column("spans").to_pylist()], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield batch.set_column(batch.schema.get_field_index("spans"), "spans", spans)

    parts = []
    for sent, only in passes(benchmark, window, pass_words):
        parts.append(cut(index.mapInArrow(searcher(sent), MATCHES)))
        if only:
            sent.destroy()
            return parts[0]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    names = (F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near"))
    merged = both.groupBy("block", "ord", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), *names)
    return merged.mapInArrow(tidy, MATCHES)


def proximity_matches(index: DataFrame, queries: list[list[str]], within: int = 10) -> DataFrame:
    """(query, doc_id) for documents in which all words of a query stand within so many words of its first one."""
    asked = [[w.encode().lower() for w in q] for q in queries]

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                p = Postings.of_row(r["terms"], r["counts"], r["deltas"], r["n_words"])
                found = [(k, r["doc_ids"][d]) for k, q in enumerate(asked) for d in p.near(q, within)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([d for _, d in found], pa.int64())], names=["query", "doc_id"])

    return index.mapInArrow(search, "query bigint, doc_id bigint")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans, items, near of every document, through the stored index."""
    return phrase_matches(build_index(docs), benchmark, window).select("doc_id", "n_words", "spans", "items", "near")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """The rows of `docs`, with their columns, in which no window occurs: each batch of rows is indexed and
    searched in place, so texts are neither shuffled nor joined again."""
    texts = docs.columns.index("text")

    def keeper(sent):
        def keep(batches):
            phrases = sent.value
            for batch in batches:
                column = batch.column(texts).to_pylist()
                at = size = 0
                for end, t in enumerate(column, 1):
                    size += len(t or "") // 6 + 1
                    if size >= BLOCK_WORDS or end == len(column):
                        found = phrases.search(Postings.of_texts(column[at:end]))
                        yield batch.slice(at, end - at).filter(pa.array([d not in found for d in range(end - at)], pa.bool_()))
                        at, size = end, 0

        return keep

    out = docs
    for sent, only in passes(benchmark, window, pass_words):
        kept = out.mapInArrow(keeper(sent), docs.schema)
        if only:
            return kept
        before, out = out, cut(kept)
        if before is not docs:
            drop_cut(before)
    return out
