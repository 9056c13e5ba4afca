"""Removal of byte strings that occur more than once, by distributed prefix doubling.

A position's rank at a length is the name (64 bits) of the bytes that follow it. Rounds compare ever longer strings, of
64, 128, 256, 369 and 400 bytes, and only positions whose rank isn't unique go on. It differs from the textbook in that no
round sorts all positions or joins a position's rank with that of the position as far on, which can't be afforded (24 bytes
for each position and round): a round groups the pair of the rank before and the name of the next bytes, which is read from
the text where the survivors stand. So it is a cascade of names of growing strings, and positions are held as follows:

* Equal texts are one text, whose number says that all of it is repeated. A task names each of its texts once.
* Start (64 bytes): names of 8 bytes are doubled to 16, 32 and 64 in place. Each 400-byte string is represented by the
  least 64-byte name in it. Equal strings have the same representative at the same distance, so positions between
  two representatives travel together, as a range of distances; about one row for 169 bytes. Ranges whose rank is
  unique leave. Ranges equal as a whole to another are repeated, all of them; of each such class one member goes on as a
  partner for the others.
* Rounds of 128, 256 and 369 bytes: ranges are cut into 32 distances, whose strings share 369 bytes. They are ranked by
  the pairs (rank at 64, name of the first 128 shared bytes), (rank at 128, name of the next 128), (rank at 256, name of
  the rest); unique pairs leave in each round. A cut whose 431 bytes occur again is repeated as a whole.
* Round of 400 bytes: single positions, by the pair (rank at 369, name of the bytes around).

All rounds need the representative and its distance to agree as well, so two different strings would have to
share a 64-bit fingerprint of each of several lengths to be confused.

Defined cases: a null text is empty; texts under 400 bytes lose nothing; a repeated row is another place where
its text occurs; overlapping occurrences count; rows with a null doc_id are treated like any; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

LENGTH, SEED, CUT = 400, 64, 32
#: Bytes named at a time; a longer text is named in overlapping pieces. Rows in one Arrow batch of a result.
PIECE, BATCH = 1 << 20, 50_000
#: A text's key: two 64-bit fingerprints.
KEY = ["h1", "h2"]

_INDEX_BITS = np.uint64(24)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def seed_names(data: np.ndarray) -> np.ndarray:
    """Names of the 64 bytes from each position on, doubled from 8-byte words."""
    n = len(data) - 7
    h = np.ndarray((n,), "<u8", data, strides=(1,)) * _M1
    h ^= h >> np.uint64(32)
    for step in (8, 16, 32):
        h = h[:-step] * _M1 + h[step:] * _M2
        h ^= h >> np.uint64(29)
    h *= _M2
    return h ^ (h >> np.uint64(32))


def representatives(data: bytes, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document, seed position, first, last, name): ranges of string starts that share a representative.

    data: documents one after another, which end at `ends`. Positions are in `data`."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    begins = np.concatenate([[0], ends[:-1]])
    if len(data) < length or not (ends - begins >= length).any():
        return none
    names = seed_names(np.frombuffer(data, np.uint8).copy())
    width = length - SEED + 1
    packed = ((names >> _INDEX_BITS) << _INDEX_BITS) | np.arange(len(names), dtype=np.uint64)
    rows = -(-len(packed) // width)
    block = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    block[: len(packed)] = packed
    block = block.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(data) - length + 1
    seed = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    doc = np.searchsorted(ends, np.arange(starts), side="right")
    valid = np.arange(starts) + length <= ends[doc]
    change = np.ones(starts, bool)
    change[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    if not len(first):
        return none
    run = np.cumsum(change & valid)
    last = np.full(len(first), -1, np.int64)
    last[run[valid] - 1] = np.flatnonzero(valid)  # the last assignment of a run stays
    return doc[first], seed[first], first, last, names[seed[first]]


def _name(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*columns, F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))


def _schema(*longs: str, flags: tuple[str, ...] = ()) -> tuple[pa.Schema, str]:
    kinds = [(c, "long") for c in longs] + [(c, "boolean") for c in flags]
    return pa.schema([(c, pa.int64() if k == "long" else pa.bool_()) for c, k in kinds]), ", ".join(f"{c} {k}" for c, k in kinds)


def _batches(rows, schema: pa.Schema):
    """Arrow batches of bounded size from an iterator of tuples."""
    while held := list(itertools.islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _start(docs: DataFrame, length: int) -> DataFrame:
    """Round 0: (h1, h2, seed, whole, a, lo, hi) of every range of every text; a task names equal texts once."""

    def run(batches):
        def pieces():
            """(h1, h2, offset, bytes) so that every start of a string is in one piece with its whole string."""
            seen = set()
            for b in batches:
                for h1, h2, t in zip(b.column("h1").to_pylist(), b.column("h2").to_pylist(), b.column("text").to_pylist(), strict=True):
                    if (h1, h2) in seen:
                        continue
                    seen.add((h1, h2))
                    data = t.encode()
                    for at in range(0, max(len(data) - length + 1, 0), 8 * PIECE):
                        yield h1, h2, at, data[at : at + 8 * PIECE + length - 1]

        def named(held):
            data = b"".join(x[3] for x in held)
            doc, a, lo, hi, seed = representatives(data, np.cumsum([len(x[3]) for x in held]), length)
            begin = np.cumsum([0] + [len(x[3]) for x in held])[doc] - np.array([x[2] for x in held], np.int64)[doc]
            whole = [_name(data[p : q + length]) for p, q in zip(lo.tolist(), hi.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays(
                [*(pa.array(np.array([x[k] for x in held], np.int64)[doc]) for k in (0, 1)), pa.array(_signed(seed)), pa.array(whole, pa.int64()), pa.array(a - begin), pa.array(lo - begin), pa.array(hi - begin)],
                names=["h1", "h2", "seed", "whole", "a", "lo", "hi"],
            )

        held, size = [], 0
        for x in pieces():
            held.append(x)
            size += len(x[3])
            if size >= PIECE:
                yield named(held)
                held, size = [], 0
        if held:
            yield named(held)

    return cut(_keyed(docs).where(F.octet_length("text") >= length).mapInArrow(run, _schema("h1", "h2", "seed", "whole", "a", "lo", "hi")[1]))


def _several(place: tuple[str, ...]) -> tuple:
    """Aggregates by which a group has more than one place; a place may come more than once."""
    mark = F.xxhash64(*place)
    return F.min(mark).alias("_low"), F.max(mark).alias("_high")


def _survivors(rows: DataFrame, pair: list[str], place: tuple[str, ...], rank: Column | None = None) -> DataFrame:
    """The rows whose pair of ranks occurs at two places or more, with their next rank; stored. `rows`, a cut, is
    removed."""
    # what joins read is stored, so that both sides are plain shuffles, whose hot ranks Spark can split
    ranked = cut(rows.groupBy(*pair).agg(*_several(place)).where("_low <> _high").select(*pair))
    alive = rows.join(ranked, pair)
    alive = cut(alive if rank is None else alive.withColumn("rank", rank).drop(pair[-1]))
    for stored in (rows, ranked):
        drop_cut(stored)
    return alive


def _rerank(rows: DataFrame, rank: list[str], name: str, place: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """One round: (repeated, open) of rows whose `rank` occurs at two places or more. Repeated, as (h1, h2, lo, hi): the
    longer string `name` occurs again under the same rank. Open: the others, and one partner (`settled`) of each
    repeated string, where the rank holds more than one name."""
    ranked = cut(rows.groupBy(*rank).agg(*_several(place), F.min(name).alias("_least"), F.max(name).alias("_most")).where("_low <> _high").select(*rank, (F.col("_least") != F.col("_most")).alias("_mixed")))
    alive = cut(rows.join(ranked, rank))
    first = F.struct(*place, "lo")
    named = cut(alive.groupBy(*rank, name).agg(*_several(place), F.min(first).alias("_first")).select(*rank, name, (F.col("_low") != F.col("_high")).alias("_again"), "_first"))
    judged = alive.join(named, [*rank, name])
    settled = F.col("settled") if "settled" in rows.columns else F.lit(False)
    repeated = cut(judged.where(F.col("_again") & ~settled).select(*KEY, "lo", "hi"))
    going = judged.where(F.col("_mixed") & (~F.col("_again") | (first == F.col("_first")))).withColumn("settled", F.col("_again")).drop("_again", "_first", "_mixed", name)
    going = cut(going.distinct())
    for stored in (rows, ranked, alive, named):
        drop_cut(stored)
    return repeated, going


def _with_text(rows: DataFrame, texts: DataFrame, *fields: str) -> DataFrame:
    """(h1, h2, text, parts): each text once, with its rows, as many as its length allows."""
    return texts.join(rows.groupBy(*KEY).agg(F.collect_set(F.struct(*fields)).alias("parts")), KEY)


def _cuts(texts: DataFrame, going: DataFrame, length: int) -> DataFrame:
    """The cuts of 32 distances, with the names of their shared bytes' parts and of all their bytes."""
    schema, ddl = _schema(*KEY, "seed", "j", "n128", "n256", "n369", "hull", "a", "lo", "hi", flags=("settled",))
    parts = [(x * (length - CUT + 1) // 369, y * (length - CUT + 1) // 369) for x, y in ((0, 128), (128, 256), (256, 369))]

    def run(batches):
        def rows():
            for r in (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                data = r["text"].encode()
                # a range that two pieces of a text share is one place, not two
                found: dict[tuple[int, int, int], tuple[int, int, bool]] = {}
                for p in r["parts"]:
                    a = p["a"]
                    for j in range((a - p["hi"]) // CUT, (a - p["lo"]) // CUT + 1):
                        lo, hi, settled = max(a - CUT * j - CUT + 1, p["lo"]), min(a - CUT * j, p["hi"]), p["settled"]
                        was = found.get((p["seed"], a, j), (lo, hi, settled))
                        found[p["seed"], a, j] = (min(lo, was[0]), max(hi, was[1]), settled and was[2])
                for (seed, a, j), (lo, hi, settled) in found.items():
                    low, high = a - CUT * j - CUT + 1, a - CUT * j  # all starts in this cut
                    whole = low >= 0 and high + length <= len(data)
                    hull = _name(data[low : high + length]) if whole else _name(b"%d %d %d" % (r["h1"], r["h2"], a))
                    yield r["h1"], r["h2"], seed, j, *(_name(data[high + x : high + y]) for x, y in parts), hull, a, lo, hi, settled

        return _batches(rows(), schema)

    return _with_text(going, texts, "seed", "a", "lo", "hi", "settled").mapInArrow(run, ddl)


def _singles(texts: DataFrame, going: DataFrame, length: int) -> DataFrame:
    """Single starts: their cut's rank, and the name of the bytes that their string has beside the shared ones."""
    schema, ddl = _schema(*KEY, "rank", "d", "rest", "p", flags=("settled",))

    def run(batches):
        def rows():
            for r in (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                data = r["text"].encode()
                for x in r["parts"]:
                    high = x["a"] - CUT * x["j"]
                    for p in range(x["lo"], x["hi"] + 1):
                        rest = _name(data[p:high] + data[high + length - CUT + 1 : p + length])
                        yield r["h1"], r["h2"], x["rank"], x["a"] - p, rest, p, x["settled"]

        return _batches(rows(), schema)

    return _with_text(going, texts, "rank", "j", "a", "lo", "hi", "settled").mapInArrow(run, ddl)


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """((h1, h2, lo, hi, mask), texts): every start lo..hi, or lo + k for each bit k of a mask, of a string of `length`
    bytes that starts anywhere else, but for equal texts, and (h1, h2, text) of the texts that may hold one."""
    whole, going = _rerank(_start(docs, length), ["seed"], "whole", (*KEY, "a"))
    keys = whole.select(*KEY).union(going.select(*KEY)).distinct()
    # equal texts become one before the shuffle, in every task
    texts = cut(_keyed(docs).dropDuplicates(KEY).join(keys, KEY, "left_semi"))
    place = (*KEY, "a", "j")
    cuts = cut(_cuts(texts, going, length).withColumn("rank", F.xxhash64("seed", "j")).drop("seed"))
    for name in ("n128", "n256"):
        cuts = _survivors(cuts, ["rank", name], place, F.xxhash64("rank", name))
    some, going2 = _rerank(cuts, ["rank", "n369"], "hull", place)
    going2 = going2.withColumn("rank", F.xxhash64("rank", "n369"))
    singles = cut(_singles(texts, going2, length))
    one = _survivors(singles, ["rank", "d", "rest"], (*KEY, "p")).where("NOT settled")
    # 64 neighbouring starts are one row, however many parts of a long text are dealt to one task
    cell, bit = F.expr("p div 64").alias("cell"), F.expr("shiftleft(1L, cast(p % 64 as int))")
    cells = one.groupBy(*KEY, cell).agg(F.bit_or(bit).alias("mask")).select(*KEY, (F.col("cell") * 64).alias("lo"), F.lit(-1).cast("long").alias("hi"), "mask")
    ranges = whole.union(some).withColumn("mask", F.lit(0).cast("long"))
    return ranges.unionByName(cells), texts


def _ranges(parts: list[dict]) -> Iterator[tuple[int, int]]:
    """The starts of the parts as (first, last)."""
    for x in parts:
        if x["mask"] == 0:
            yield x["lo"], x["hi"]
            continue
        bits = np.flatnonzero(np.unpackbits(np.array([x["mask"]], np.int64).view(np.uint8), bitorder="little"))
        for run in np.split(bits, np.flatnonzero(np.diff(bits) > 1) + 1):
            yield x["lo"] + int(run[0]), x["lo"] + int(run[-1])


RESULT = "h1 bigint, h2 bigint, n_removed bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary"


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(h1, h2, n_removed, spans, kept) of the texts that lose bytes to other texts or within; spans are maximal byte
    ranges and kept is what is left, joined."""
    starts, texts = repeated_starts(docs, length)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(at, 64).to_pylist():
                    data, spans = r["text"].encode(), []
                    for lo, hi in sorted((a, b + length) for a, b in _ranges(r["parts"])):
                        if spans and lo <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], hi)
                        else:
                            spans.append([lo, hi])
                    edges = [0, *(x for s in spans for x in s), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((r["h1"], r["h2"], sum(b - a for a, b in spans), [{"start": a, "stop": b} for a, b in spans], kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _with_text(starts, texts, "lo", "hi", "mask").mapInArrow(run, RESULT)


def dedup_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs(doc_id, text)."""
    every = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", *KEY, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    copies = every.where(F.col("n_bytes") >= length).groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    less = removed(docs, length).select(*KEY, "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    facts = cut(less.join(copies, KEY, "full"))
    all_of_it = F.col("rows").isNotNull()
    zero = F.lit(0).cast("long")
    return every.join(facts, KEY, "left").select(
        "doc_id", "n_bytes", F.when(all_of_it, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(all_of_it, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(all_of_it, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
