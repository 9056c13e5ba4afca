"""Spelling variants of a corpus' words: near words, the form each is a variant of, and the root of its forms.

Words are counted by Spark. Two words are near if one inserted, deleted or replaced letter makes one of the other. Such
an edit changes the vector of letter counts by at most two in L1 distance: by one between words of lengths L and L + 1,
by at most two between words of one length. So for each of these length pairs a range search in a k-d tree over the vectors
of the one length, with the vectors of the other as queries, finds all near words; what it finds is verified letter by letter.

* A length with many words is cut into cells by the upper levels of its tree. Only the places of the cuts come from a
  sample (at most `SAMPLE` words of a length, chosen by hash); all words are put into cells and all are queries. A
  word goes as a point to its own cell and as a query to the cells whose box is near enough. There are at most
  `MOST_CELLS` cells in all, so that their cuts are of bounded size; a cell has some `CELL` words, or an equal share.
* A task takes the points of a cell, builds the lower levels, and streams the cell's queries past it. It returns the number
  of near words and the best of them for each word, not the pairs.
* Accented letters share six dimensions and counts end at 255: neither makes a distance larger.
* A form is at least `TIMES` times as frequent, so a chain of forms has at most 27 steps; roots are found by doubling.

Defined cases: null and empty texts have no words; a null doc_id is the empty string in the hash; repeated rows count
again; a run of any length is one word; among near words of equal frequency the smallest is the form; an empty table
gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop_cut, lower_ascii

MIN_LENGTH, MIN_COUNT, TIMES = 6, 5, 5
#: Every so manyth word of a document, by hash, loses a letter.
SLIPS = 199
CELL, MOST_CELLS, SAMPLE = 4096, 4096, 4096
#: Points of a leaf of a task's tree, queries searched at a time, bytes compared at a time.
LEAF, QUERIES, COMPARED = 24, 4000, 8 << 20
#: Dimensions: a to z, then classes of the other letters.
DIMS = 32
_CLASS = np.array([b - 97 if 97 <= b <= 122 else 26 + b % 6 for b in range(256)], np.int64)


def vectors(words: list[bytes]) -> np.ndarray:
    """Letter counts of words in Latin-1."""
    size = np.array([len(w) for w in words], np.int64)
    letters = _CLASS[np.frombuffer(b"".join(words), np.uint8)]
    counts = np.bincount(np.repeat(np.arange(len(words)), size) * DIMS + letters, minlength=len(words) * DIMS)
    return np.minimum(counts, 255).reshape(-1, DIMS).astype(np.int16)


class Tree:
    """A k-d tree over letter counts; a leaf's box is what the cuts above it leave."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.cuts: list[tuple[int, int, int] | int] = []  # (dimension, largest value on the left, node on the right) or a leaf
        self.leaves: list[np.ndarray] = []
        todo = [(np.arange(len(points)), -1)]
        while todo:
            rows, parent = todo.pop()
            if parent >= 0:
                self.cuts[parent] = (*self.cuts[parent][:2], len(self.cuts))
            found = self._best(points[rows]) if len(rows) > leaf else None
            if found is None:
                self.cuts.append(len(self.leaves))
                self.leaves.append(rows)
                continue
            left = points[rows, found[0]] <= found[1]
            todo += [(rows[~left], len(self.cuts)), (rows[left], -1)]  # the left node comes next
            self.cuts.append((*found, 0))

    @staticmethod
    def _best(points: np.ndarray) -> tuple[int, int] | None:
        """The cut at or below a median that halves the points best."""
        middle = np.partition(points, len(points) // 2, axis=0)[len(points) // 2]
        best, place = 0, None
        for at in (middle, middle - 1):
            left = (points <= at).sum(0)
            least = np.minimum(left, len(points) - left)
            dim = int(least.argmax())
            if least[dim] > best:
                best, place = int(least[dim]), (dim, int(at[dim]))
        return place

    def visit(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the queries whose distance from the leaf's box is at most the radius."""
        n = len(queries)
        todo = [(0, np.arange(n), np.zeros(n, np.int16), np.zeros(DIMS, np.int16), np.full(DIMS, 256, np.int16))]
        while todo:
            node, rows, far, low, high = todo.pop()
            if isinstance(self.cuts[node], int):
                yield self.cuts[node], rows
                continue
            dim, at, right = self.cuts[node]
            q = queries[rows, dim]
            off = lambda lo, hi, q=q: np.maximum(lo - q, 0) + np.maximum(q - hi, 0)
            rest = far - off(low[dim], high[dim])
            for child, lo, hi in ((node + 1, low[dim], min(at, high[dim])), (right, max(at + 1, low[dim]), high[dim])):
                now = rest + off(lo, hi)
                near = now <= radius
                if near.any():
                    low2, high2 = low.copy(), high.copy()
                    low2[dim], high2[dim] = lo, hi
                    todo.append((child, rows[near], now[near], low2, high2))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters a, b(length as a's, or one more) are one edit apart."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(1) == 1
    same = np.logical_and.accumulate
    head = same(a == b[:, :n], axis=1).sum(1)
    tail = same((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= n


class Cell:
    """The points of a cell, in code-point order, and what is known of their near words that are one letter shorter."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words, self.n = [words[i] for i in order], n[order]
        self.vectors = vectors(self.words)
        self.letters = np.frombuffer(b"".join(self.words), np.uint8).reshape(len(words), -1)
        self.tree = Tree(self.vectors, LEAF)
        self.boxes = [(self.vectors[x].min(0), self.vectors[x].max(0)) for x in self.tree.leaves]
        self.found = [(0, 0, b"")] * len(words)  # number of near words, the best one's count and the best one

    def pairs(self, queries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) one edit apart; queries have the points' length or one letter less."""
        q = vectors(queries)
        letters = np.frombuffer(b"".join(queries), np.uint8).reshape(len(queries), -1)
        radius = 2 if letters.shape[1] == self.letters.shape[1] else 1
        out = [(np.zeros(0, np.int64),) * 2]
        for leaf, rows in self.tree.visit(q, radius):
            low, high = self.boxes[leaf]
            far = (np.maximum(low - q[rows], 0) + np.maximum(q[rows] - high, 0)).sum(1)
            rows, points = rows[far <= radius], self.tree.leaves[leaf]
            step = max(1, COMPARED // (2 * DIMS * len(points)))
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                for at in range(0, len(points), max(1, COMPARED // (2 * DIMS))):
                    here = points[at : at + max(1, COMPARED // (2 * DIMS))]
                    i, j = np.nonzero(np.abs(q[some][:, None] - self.vectors[here][None]).sum(2) <= radius)
                    i, j = some[i], here[j]
                    size = max(1, COMPARED // letters.shape[1])
                    for x in range(0, len(i), size):
                        a, b = i[x : x + size], j[x : x + size]
                        near = one_edit(letters[a], self.letters[b])
                        out.append((a[near], b[near]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def search(self, queries: list[bytes], n: np.ndarray) -> list[tuple[bytes, int, int, bytes]]:
        """(query, near words, the best one's count, the best one) for queries with near words here."""
        order = sorted(range(len(queries)), key=queries.__getitem__)
        queries, n = [queries[i] for i in order], n[order]
        a, b = self.pairs(queries)
        out = [(queries[i], k, int(self.n[j]), self.words[j]) for i, k, j in _best(a, b, self.n)]
        if len(queries[0]) < self.letters.shape[1]:
            for j, k, i in _best(b, a, n):
                had, best, word = self.found[j]
                best, word = min((-best, word), (-int(n[i]), queries[i])) if had else (-int(n[i]), queries[i])
                self.found[j] = (had + k, -best, word)
        return out

    def rest(self) -> list[tuple[bytes, int, int, bytes]]:
        return [(w, *f) for w, f in zip(self.words, self.found) if f[0]]


def _best(of: np.ndarray, near: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(word, near words, the best of them): the most frequent, then the first."""
    order = np.lexsort((near, -n[near], of))
    of, near = of[order], near[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    return zip(of[first].tolist(), np.diff(np.append(first, len(of))).tolist(), near[first].tolist())


def _slipped(doc_id: Column, run: Column) -> Column:
    """The run; by hash, without one of its letters."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SLIPS == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of all texts that are long and frequent enough."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}+"), F.lit(0))  # shorter ones only get shorter
    each = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", lower_ascii(F.col("run")).alias("run"))
    words = each.select(_slipped(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def _cells(words: DataFrame) -> dict[int, Tree]:
    """The upper levels of the trees of lengths with many words, cut where a sample says."""
    length = F.length("word")
    total = words.count()
    cell = max(CELL, -(-total // MOST_CELLS))
    large = words.groupBy(length.alias("size")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > cell)  # at most MOST_CELLS rows
    sizes = dict(map(tuple, large.collect()))
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for size, k in sizes.items() for x in (size, float(k))])[F.col("size")]
    of_large = words.select("word", length.alias("size")).where(F.col("size").isin(list(sizes)))
    # a word's number is fixed by its hash; a bound for each length keeps the sample small whatever the corpus
    by_hash = (F.shiftrightunsigned(F.xxhash64("word"), 11) / F.lit(float(1 << 53))).alias("u")
    some = of_large.select("word", "size", by_hash).where(F.col("u") * share <= 2 * SAMPLE)
    few = some.withColumn("nth", F.row_number().over(W.partitionBy("size").orderBy("u", "word"))).where(F.col("nth") <= SAMPLE)
    texts: dict[int, list[bytes]] = {}
    for word, size in few.select("word", "size").collect():
        texts.setdefault(size, []).append(word.encode("latin-1"))
    return {size: Tree(vectors(sorted(t)), max(1, len(t) * cell // sizes[size])) for size, t in texts.items()}


_PLACED = "size int, cell int, role int, word string, n long"
_FOUND = "word string, n_near long, best_n long, best string"


def _place(cells: dict[int, Tree]):
    """Words as points of their cell (role 0) and as queries of near cells: of their own length (1), of one more (2)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n = batch.column("word"), batch.column("n")
            words = [w.encode("latin-1") for w in text.to_pylist()]
            size = np.array([len(w) for w in words], np.int64)
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                q = vectors([words[i] for i in own])
                for role, of, radius in ((0, s, 0), (1, s, 2), (2, s + 1, 1)):
                    for cell, rows in cells[of].visit(q, radius) if of in cells else [(0, np.arange(len(own)))]:
                        take = pa.array(own[rows])
                        full = lambda v, k=len(rows): pa.array(np.full(k, v, np.int32))
                        yield pa.RecordBatch.from_arrays([full(of), full(cell), full(role), text.take(take), n.take(take)], names=["size", "cell", "role", "word", "n"])

    return run


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells come one after another, the points of each before its queries."""
    key = cell = None
    points: tuple[list, list] = ([], [])

    def told(rows: list) -> Iterator[pa.RecordBatch]:
        if rows:
            words, k, n, best = zip(*rows)
            text = lambda x: pa.array([w.decode("latin-1") for w in x])
            yield pa.RecordBatch.from_arrays([text(words), pa.array(k, pa.int64()), pa.array(n, pa.int64()), text(best)], names=["word", "n_near", "best_n", "best"])

    for batch in batches:
        ids = np.stack([batch.column(c).to_numpy() for c in ("size", "cell", "role")], 1)
        edges = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(1)))
        words, n = [w.encode("latin-1") for w in batch.column("word").to_pylist()], batch.column("n").to_numpy()
        for lo, hi in zip(edges, np.append(edges[1:], len(ids))):
            if (ids[lo, 0], ids[lo, 1]) != key:
                if cell:
                    yield from told(cell.rest())
                key, cell, points = (ids[lo, 0], ids[lo, 1]), None, ([], [])
            if ids[lo, 2] == 0:
                points[0].extend(words[lo:hi])
                points[1].append(n[lo:hi])
                continue
            if not points[0]:
                continue
            if cell is None:
                cell = Cell(points[0], np.concatenate(points[1]))
            for at in range(lo, hi, QUERIES):
                stop = min(at + QUERIES, hi)
                yield from told(cell.search(words[at:stop], n[at:stop]))
    if cell:
        yield from told(cell.rest())


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word(word, n) that has near ones; words stand once and in stored rows."""
    placed = words.mapInArrow(_place(_cells(words)), _PLACED)
    ordered = placed.repartition("size", "cell").sortWithinPartitions("size", "cell", "role")
    found = ordered.mapInArrow(_search, _FOUND).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct(-F.col("best_n"), "best")).alias("b"))
    return found.select("word", "n_near", (-F.col("b")["col1"]).alias("best_n"), F.col("b")["best"].alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every row of forms(word, form): the last of its forms. Steps double until none is left."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        (moved,) = step.agg(F.count_if("moved")).first()
        drop_cut(now)
        now = step
        if not moved:
            return now.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    words = cut(count_words(docs))
    often = F.col("best_n") >= TIMES * F.col("n")
    judged = cut(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("best")).alias("form"), F.when(often, F.col("best_n")).alias("form_n"),
    ))
    last = roots(judged.where("form IS NOT NULL"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
