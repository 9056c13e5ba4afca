"""Cross-entropy difference of a target and a background language model.

Both are interpolated bigram models over one vocabulary, with exact counts of every word and every pair of neighbouring
words; what they hold grows with the corpus. The target model counts the documents labelled good, the background model
all others, so no document is in both. They are matched: order, weights and the mass kept for words not seen are the same
in both whatever they count, so that a difference of losses doesn't come from their sizes. A document's score is its loss
for a word under the target model less that under the background model; low scores are near the target.

Texts are taken in blocks, stored as numbers of a block's own words. A block asks for the counts of each of its
words and pairs once: it sends its own counts, by ranges of the 56-bit hash of word or pair (names, unique up to
colliding hashes). A range sums what all blocks sent and answers each block in the order in which it asked, so
no frequent word is ever more than one number of a block, and neither model is ever in one place. The answers meet
the stored block, which scores its texts.

The vocabulary, all different words of the corpus, is counted once, exactly (by ranges of the words' 64-bit hashes), and
shared: both models spread UNIFORM of a word's share evenly over it. So the probabilities of all words, and of the
text's end, sum to one in either model, before every word.

A document has been counted by one of the models, so what it counted there is taken away again when it is scored by
it (leave one out). Its copies stay counted: a text that stands twice is scored by its twin.

Defined cases: a null text, or one without words, has zero words and null losses; a text's first word has no word
before it; of repeated labels the lowest counts; repeated rows are counted each; a model that has
counted nothing else is uniform; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Weight of the pair estimate, and in the word estimate that of the uniform part.
PAIR_WEIGHT, UNIFORM = 0.6, 0.01
#: Words in a block (a longer document is a block by itself).
BLOCK_WORDS = 1_000_000
#: Ranges of the hashes: at least so many, and one for so many words of the corpus.
RANGES, RANGE_WORDS = 1024, 2_000_000
#: The same of the vocabulary's count; a block has far fewer different words than words.
VOCABULARY_RANGES, VOCABULARY_RANGE_WORDS = 64, 20_000_000

BLOCKS = "block string, doc_ids array<bigint>, n_words array<bigint>, words binary, names binary"
REQUESTS = "part int, block string, names binary, target binary, background binary"
ANSWERS = "part int, block string, target binary, background binary"
#: Bits of a name. With 10^12 different words and pairs, one in 140,000 shares its name.
NAME_BITS = 56
_PAIR_MUL = np.uint64(0x9E3779B97F4A7C15)


def numbered(texts: list[str | None], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(words in each text, number of each word); new words are added to `number`."""
    n, ids = [], []
    for t in texts:
        words = (t or "").encode().split()
        n.append(len(words))
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    return np.array(n, np.int64), np.concatenate([np.zeros(0, np.int64), *ids])


def pairs(n: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word) of each different pair, and the pair of each word. A text's first word has -1 before it."""
    before = _before(n, word)
    size = int(word.max()) + 1 if len(word) else 1
    both, pair = np.unique((before + 1) * size + word, return_inverse=True)
    return both // size - 1, both % size, pair


def _before(n: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The word before each word, -1 at a text's start."""
    before = np.concatenate([[-1], word[:-1]]) if len(word) else word
    before[(np.cumsum(n) - n)[n > 0]] = -1
    return before


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type, the first bytes of all, then the second ones, and so on, compressed."""
    narrow = numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))
    planes = narrow.view(np.uint8).reshape(len(narrow), narrow.itemsize).T.tobytes()
    return np.array([len(narrow), narrow.itemsize], np.uint32).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes, kind=np.int64) -> np.ndarray:
    n, size = np.frombuffer(data, np.uint32, 2).tolist()
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(f"u{size}").ravel().astype(kind)


class Block:
    """The texts of a block: words and pairs numbered inside it, and their names in the order of requests."""

    def __init__(self, n_words, words: bytes, names: bytes):
        self.n = np.asarray(n_words, np.int64)
        self.word = _unpack(words)
        word_names = np.frombuffer(names, np.uint64)
        self.size = len(word_names)
        before, after, pair = pairs(self.n, self.word)
        real = before >= 0
        self.pair = np.where(real, np.cumsum(real) - 1, -1)[pair]  # -1 at a text's start
        self.n_pairs = int(real.sum())
        before, after = before[real], after[real]
        named = np.concatenate([word_names, (word_names[before] * _PAIR_MUL + word_names[after]) * _PAIR_MUL]) >> np.uint64(64 - NAME_BITS)
        self.order = np.argsort(named, kind="stable")
        self.names = named[self.order]
        self.doc = np.repeat(np.arange(len(self.n)), self.n)

    def flags(self, counted) -> np.ndarray:
        out = np.zeros(len(self.n), bool)
        out[np.asarray(counted or [], np.int64)] = True
        return out

    def counts(self, keep: np.ndarray) -> np.ndarray:
        """How often each name occurs, in the order of requests, in the words kept."""
        word, pair = self.word[keep], self.pair[keep]
        return np.concatenate([np.bincount(word, minlength=self.size), np.bincount(pair[pair >= 0], minlength=self.n_pairs)])[self.order]

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each word, and its pair, occurs in its text."""

        def mine(numbers: np.ndarray, size: int) -> np.ndarray:
            _, inverse, times = np.unique(self.doc * size + numbers, return_inverse=True, return_counts=True)
            return times[inverse]

        return mine(self.word, self.size), mine(self.pair + 1, self.n_pairs + 1)

    def losses(self, counts: np.ndarray, total: float, own: tuple[np.ndarray, np.ndarray], counted: np.ndarray, vocabulary: int) -> np.ndarray:
        """The mean loss of each text, in nats, under a model with these counts of the names asked for and so many
        different words; texts that were counted are left out for their own words."""
        placed = np.empty(len(counts), np.int64)
        placed[self.order] = counts
        words, pairs_ = placed[: self.size], np.append(placed[self.size :], 0)  # the last one for texts' starts
        left_out = counted[self.doc]
        held = np.where(counted, self.n, 0)[self.doc]
        c_word = words[self.word] - np.where(left_out, own[0], 0)
        c_pair = pairs_[self.pair] - np.where(left_out, own[1], 0)
        c_before = np.where(self.pair < 0, 0, np.concatenate([c_word[:1], c_word[:-1]]))
        others = total - held
        uniform = np.where(others > 0, UNIFORM, 1.0)
        single = (1 - uniform) * c_word / np.maximum(others, 1) + uniform / float(vocabulary)
        weight = np.where(c_before > 0, PAIR_WEIGHT, 0.0)
        loss = -np.log(weight * (c_pair / np.maximum(c_before, 1)) * (self.pair >= 0) + (1 - weight) * single)
        return np.where(self.n > 0, np.bincount(self.doc, weights=loss, minlength=len(self.n)) / np.maximum(self.n, 1), np.nan)


def build_blocks(docs: DataFrame) -> DataFrame:
    """The stored blocks of docs(doc_id, text); no shuffle."""

    def build(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        ids, n, words, number, size = [], [], [], {}, 0

        def out():
            names = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{k}"]), *(pa.array([x], pa.list_(pa.int64())) for x in (ids, n)), *(pa.array([x], pa.binary()) for x in (_pack(np.concatenate(words)), names.tobytes()))],
                names=["block", "doc_ids", "n_words", "words", "names"],
            )

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                word = numbered([t], number)[1]
                ids.append(i)
                n.append(len(word))
                words.append(word.astype(np.uint32))
                size += len(word) + 1
                if size >= BLOCK_WORDS:
                    yield out()
                    ids, n, words, number, size, k = [], [], [], {}, 0, k + 1
        if ids:
            yield out()

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(build, BLOCKS))


def count_vocabulary(blocks: DataFrame, ranges: int) -> int:
    """How many different words all blocks hold: each block sends its words' names, by ranges, and a range counts them."""

    def send(batches):
        for batch in batches:
            for held in batch.column("names").to_pylist():
                names = np.sort(np.frombuffer(held, np.uint64))
                part = ((names >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                used, first = np.unique(part, return_index=True)
                cuts = np.split(names, first[1:]) if len(used) else []
                packed = [_pack(np.diff(x, prepend=np.uint64(0))) for x in cuts]
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32), pa.int32()), pa.array(packed, pa.binary())], names=["part", "names"])

    def count(table: pa.Table) -> pa.Table:
        held = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in table.column("names").to_pylist()]
        return pa.table({"n": pa.array([len(np.unique(np.concatenate(held)))], pa.int64())})

    sent = blocks.select("names").mapInArrow(send, "part int, names binary")
    return int(sent.groupBy("part").applyInArrow(count, "n bigint").agg(F.sum("n")).first()[0] or 0)


def count_names(marked: DataFrame, ranges: int) -> DataFrame:
    """(part, block, target, background): the whole corpus' counts of the names of each block, range by range."""

    def ask(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                b = Block(r["n_words"], r["words"], r["names"])
                if not len(b.names):
                    continue
                mine = b.flags(r["counted"])[b.doc]
                target, background = b.counts(mine), b.counts(~mine)
                part = ((b.names >> np.uint64(NAME_BITS - 32)) * np.uint64(ranges)) >> np.uint64(32)
                used, first = np.unique(part, return_index=True)
                cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), pa.array([r["block"]] * len(used)), pa.array([_pack(np.diff(b.names[x:y], prepend=np.uint64(0))) for x, y in cuts], pa.binary()),
                     *(pa.array([_pack(c[x:y]) for x, y in cuts], pa.binary()) for c in (target, background))],
                    names=["part", "block", "names", "target", "background"],
                )

    def answer(table: pa.Table) -> pa.Table:
        asked = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in table.column("names").to_pylist()]
        ends = np.cumsum([len(x) for x in asked])
        different, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        out = []
        for c in ("target", "background"):
            sent = np.concatenate([_unpack(x) for x in table.column(c).to_pylist()])
            # sums are whole numbers far below 2^53
            sums = np.bincount(inverse, weights=sent, minlength=len(different)).astype(np.int64)[inverse]
            out.append(pa.array([_pack(x) for x in np.split(sums, ends[:-1])], pa.binary()))
        return pa.table([table.column("part"), table.column("block"), *out], names=["part", "block", "target", "background"])

    return marked.mapInArrow(ask, REQUESTS).groupBy("part").applyInArrow(answer, ANSWERS)


SCORES = "doc_id bigint, n_words bigint, target_loss double, background_loss double, difference double"


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, difference of every row of docs(doc_id, text)."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q > 0 AND t = 0").select("doc_id")
    blocks = build_blocks(docs)
    rows = blocks.select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("ord", "d")).select("block", "ord", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n"))
    # labels grow with the corpus, so they are merged in at every size
    targets = cut(rows.join(good.hint("merge"), "doc_id").groupBy("block").agg(F.collect_list("ord").alias("counted"), F.sum("n").alias("words")))
    every = float(rows.agg(F.sum("n")).first()[0] or 0)
    in_target = float(targets.agg(F.sum("words")).first()[0] or 0)
    marked = blocks.join(targets.select("block", "counted").hint("merge"), "block", "left")
    vocabulary = count_vocabulary(blocks, max(VOCABULARY_RANGES, int(every) // VOCABULARY_RANGE_WORDS))
    counts = count_names(marked, max(RANGES, int(every) // RANGE_WORDS))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        b = Block(r["n_words"], r["words"], r["names"])
        answers = right.sort_by("part")
        own, gone, losses, mine = b.own(), b.n == 0, [], b.flags(r["counted"])
        for column, total, counted in (("target", in_target, mine), ("background", every - in_target, ~mine)):
            got = [_unpack(x) for x in answers.column(column).to_pylist()]
            losses.append(b.losses(np.concatenate([np.zeros(0, np.int64), *got]), total, own, counted, vocabulary))
        return pa.table(
            [pa.array(r["doc_ids"], pa.int64()), pa.array(b.n), *(pa.array(x, mask=gone) for x in (losses[0], losses[1], losses[0] - losses[1]))],
            names=["doc_id", "n_words", "target_loss", "background_loss", "difference"],
        )

    return marked.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(score, SCORES)
