"""Signals in blocks: F1, F7, F8, M3 and M5 over rows of many samples.

A block table (track_id, block, amps) holds `size` samples of a recording in a row, fewer in the last one; blocks are
numbered from 0 without gaps, so sample i is in block i div size. An hour at 44,100 samples a second is 2,423 rows.
Folds inside a row are vectorised, in Arrow batches of bounded size; between rows Spark moves only what crosses an edge: the
samples of frames that straddle one, the states of filters, the pieces of a mix that meet. No recording is in one task.

Results are rows of arrays as well: pieces (track_id, start, amps), in order and without gaps but of any lengths, or arrays
of levels; `unpack` makes a row of each value. Missing amplitudes count as 0; an empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import cut
from .frames import gated
from .splice import overlay_plan

SIZE = 65_536


def pack(samples: DataFrame, size: int = SIZE, key: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Blocks of samples(key, i, amp)."""
    rows = samples.groupBy(*key, F.expr(f"i div {size}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "amp"))).alias("s"))
    return rows.select(*key, "block", F.transform("s", lambda v: v["amp"]).alias("amps"))


def unpack(rows: DataFrame, start: str, values: str, i: str, value: str) -> DataFrame:
    """(track_id, i, value): a row for each of the values, numbered from `start` on."""
    return rows.select("track_id", start, F.posexplode(values).alias("_k", value)).select("track_id", (F.col(start) + F.col("_k")).alias(i), value)


Fold = Callable[[dict, np.ndarray], Iterable[tuple]]


def _mapped(df: DataFrame, fold: Fold, schema: str) -> DataFrame:
    """The rows that `fold` makes of each row's other columns and its amps."""
    kinds = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select([c for c in batch.schema.names if c != "amps"]).to_pylist()
            amps = batch.column("amps")
            ends, values = amps.offsets.to_numpy(), amps.values.fill_null(0.0).to_numpy()
            for lo in range(0, len(rows), 64):  # results are as large as their input
                made = [r for k in range(lo, min(lo + 64, len(rows))) for r in fold(rows[k], values[ends[k] : ends[k + 1]])]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

    return df.mapInArrow(run, kinds)


def frame_rms(blocks: DataFrame, frame: int = 2205, hop: int = 1102, size: int = SIZE) -> DataFrame:
    """(track_id, first, rms): the levels of the complete frames first, first + 1, ... of a recording, in pieces.

    A frame that ends in the next block is measured on the tail of the one and the head of the other: all that is
    shuffled. A recording shorter than a frame gives one frame, 0, without level. Blocks aren't shorter than frames."""
    if size < frame:
        raise ValueError("blocks must be as long as a frame")

    def levels(row: dict, amps: np.ndarray) -> Iterator[tuple]:
        first = -(-row["start"] // hop)
        own = amps[first * hop - row["start"] :]
        if len(own) >= frame:
            views = np.lib.stride_tricks.sliding_window_view(own, frame)[::hop]
            yield row["track_id"], first, np.sqrt(np.einsum("ij,ij->i", views, views) / frame)

    out = "track_id long, first long, rms array<double>"
    start = F.col("block") * size
    inside = _mapped(blocks.select("track_id", start.alias("start"), "amps"), levels, out)
    # the first frame that starts here and doesn't end here; only blocks of full size have a next one
    late = F.greatest(F.ceil(start / hop), F.floor((start + size - frame) / hop) + 1) * hop
    tail = F.when(F.size("amps") == size, F.slice("amps", (late - start + 1).cast("int"), F.lit(size)))
    ends = F.array(F.struct(F.col("block").alias("block"), late.alias("start"), tail.alias("tail"), F.lit(None).cast("array<double>").alias("head")),
                   F.struct((F.col("block") - 1).alias("block"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("array<double>").alias("tail"), F.slice("amps", 1, frame - 1).alias("head")))
    met = blocks.select("track_id", F.explode(ends).alias("e")).groupBy("track_id", "e.block").agg(F.max("e.start").alias("start"), F.first("e.tail", True).alias("tail"), F.first("e.head", True).alias("head"))
    across = _mapped(met.where("size(tail) > 0 AND size(head) > 0").select("track_id", "start", F.concat("tail", "head").alias("amps")), levels, out)
    short = blocks.where(F.col("block") == 0).where(F.size("amps") < frame).select("track_id", F.lit(0).cast("long").alias("first"), F.array(F.lit(None).cast("double")).alias("rms"))
    return inside.unionByName(across).unionByName(short)


def _lengths(blocks: DataFrame, size: int, name: str) -> DataFrame:
    return blocks.groupBy("track_id").agg(F.max(F.col("block") * size + F.size("amps")).alias(name))


def peak_envelope(blocks: DataFrame, n: int = 900, size: int = SIZE) -> DataFrame:
    """(track_id, peaks): n peaks for each recording, 0 where it's too short; the rest after n whole steps is left out."""
    steps = _lengths(blocks, size, "total").select("track_id", F.greatest(F.lit(1).cast("long"), F.expr(f"total div {n}")).alias("step"))

    def peaks(row: dict, amps: np.ndarray) -> Iterator[tuple]:
        start, step = row["block"] * size, row["step"]
        amps = amps[: max(0, n * step - start)]
        if len(amps):
            first = start // step
            edges = np.maximum(np.arange(first, (start + len(amps) - 1) // step + 1) * step - start, 0)
            for k, peak in enumerate(np.maximum.reduceat(np.abs(amps), edges)):
                yield row["track_id"], first + k, peak

    found = _mapped(blocks.join(steps, "track_id"), peaks, "track_id long, at long, peak double").groupBy("track_id", "at").agg(F.max("peak").alias("peak"))
    by_place = found.groupBy("track_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "peak"))).alias("found"))  # at most n
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda k: F.coalesce(F.try_element_at("found", k), F.lit(0.0)))
    return steps.join(by_place, "track_id", "left").select("track_id", every.alias("peaks"))


# F8 ----------------------------------------------------------------------------------------------------------

#: Gain, quality and frequency of the two filters in front of the meter, and the weights of channels.
SHELF, HIGH_PASS = (4.0, 1 / math.sqrt(2), 1500.0), (0.0, 0.5, 38.0)
CHANNELS = (1.0, 1.0, 1.0, 1.41, 1.41)
#: Parts of one signal that are chained in one row.
CHAINED = 1024


def shelf(gain: float, q: float, at: float, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a high shelf of second order."""
    a, w = 10 ** (gain / 40), 2 * math.pi * at / rate
    c, root = math.cos(w), math.sqrt(a) * math.sin(w) / q
    b = np.array([a * (a + 1 + (a - 1) * c + root), -2 * a * (a - 1 + (a + 1) * c), a * (a + 1 + (a - 1) * c - root)])
    d = np.array([a + 1 - (a - 1) * c + root, 2 * (a - 1 - (a + 1) * c), a + 1 - (a - 1) * c - root])
    return b / d[0], d / d[0]


def high_pass(gain: float, q: float, at: float, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a high pass of second order; its gain is none."""
    w = 2 * math.pi * at / rate
    c, alpha = math.cos(w), math.sin(w) / (2 * q)
    return np.array([1 + c, -2 * (1 + c), 1 + c]) / 2 / (1 + alpha), np.array([1 + alpha, -2 * c, 1 - alpha]) / (1 + alpha)


class Weighting:
    """Both filters as one linear system of four states: y = C s + D x, and s becomes A s + B x. So a part of a signal
    maps the state at its start to that at its end by s -> A^n s + f, and such maps compose."""

    #: Samples solved at a time.
    STEP = 256

    def __init__(self, rate: int):
        (b, a), (d, e) = shelf(*SHELF, rate), high_pass(*HIGH_PASS, rate)
        one = lambda b, a: (np.array([[-a[1], 1], [-a[2], 0]]), b[1:] - a[1:] * b[0], np.array([1.0, 0]), b[0])
        (a1, b1, c1, d1), (a2, b2, c2, d2) = one(b, a), one(d, e)
        self.A = np.block([[a1, np.zeros((2, 2))], [np.outer(b2, c1), a2]])
        self.B, self.C, self.D = np.append(b1, b2 * d1), np.append(d2 * c1, c2), d1 * d2
        powers = [np.eye(4)]
        for _ in range(self.STEP):
            powers.append(self.A @ powers[-1])
        self.powers = np.array(powers)
        self.seen = self.C @ self.powers[:-1]  # (STEP, 4): a state's share in the output k samples on
        pulse = np.append(self.D, self.seen[:-1] @ self.B)
        k = np.arange(self.STEP)
        self.response = np.where(k[:, None] >= k, pulse[np.maximum(k[:, None] - k, 0)], 0)
        self.kept = (self.powers[:-1] @ self.B)[::-1]  # (STEP, 4): a sample's share in the state at the end
        self._share = np.zeros((0, 4))
        self._power = cache(lambda n: np.linalg.matrix_power(self.A, n))

    def after(self, n: int, state: np.ndarray) -> np.ndarray:
        return self._power(n) @ state

    def filter(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The output from state 0, and the state at the end."""
        n, step = len(x), self.STEP
        rows = np.zeros((-(-n // step), step))
        rows.ravel()[:n] = x
        out, gains = rows @ self.response.T, rows @ self.kept
        states = np.zeros((len(rows) + 1, 4))
        for k, g in enumerate(gains):
            states[k + 1] = self.powers[step] @ states[k] + g
        out += states[:-1] @ self.seen.T
        rest = n - (len(rows) - 1) * step  # the last row's end is where the samples end
        last = self.powers[rest] @ states[len(rows) - 1] + rows[-1, :rest] @ self.kept[step - rest :]
        return out.ravel()[:n], last

    def of_state(self, n: int) -> np.ndarray:
        """(n, 4): a state's share in the next n samples; the longest one asked for is kept."""
        if n > len(self._share):
            out, at = np.zeros((n, 4)), np.eye(4)
            for k in range(0, n, self.STEP):
                part = self.seen[: n - k] @ at
                out[k : k + len(part)] = part
                at = self.powers[self.STEP] @ at
                if np.abs(at).max() < 1e-30:
                    break
            self._share = out
        return self._share[:n]


@cache
def weighting(rate: int) -> Weighting:
    return Weighting(rate)


def _states(parts: DataFrame, key: list[str], rate: int) -> DataFrame:
    """(key, part, state): the filter's state at the start of every part(key, part, n, gain) of a signal. Up to CHAINED parts
    are one map; the maps of a signal are chained, then the parts inside each."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select(*key).schema)
    chunk = F.expr(f"part div {CHAINED}").alias("chunk")
    listed = lambda df, by, c: df.groupBy(*key, *by).agg(F.sort_array(F.collect_list(F.struct(c, "n", "gain"))).alias("list"))
    chained = listed(parts, [chunk], "part")

    def through(rows: list[dict], state: np.ndarray) -> Iterator[np.ndarray]:
        for r in rows:
            yield state
            state = weighting(rate).after(r["n"], state) + r["gain"]
        yield state

    def run(make: Callable[[dict], Iterable[tuple]], schema: str):
        arrow = to_arrow_schema(T._parse_datatype_string(schema))

        def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [(*[row[c] for c in key], *m) for row in batch.to_pylist() for m in make(row)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

        return lambda df: df.mapInArrow(go, T._parse_datatype_string(schema))

    zero = np.zeros(4)
    whole = run(lambda r: [(r["chunk"], sum(p["n"] for p in r["list"]), list(through(r["list"], zero))[-1])], f"{kinds}, chunk long, n long, gain array<double>")
    starts = run(lambda r: [(c["chunk"], s) for c, s in zip(r["list"], through(r["list"], zero))], f"{kinds}, chunk long, state array<double>")
    inner = run(lambda r: [(p["part"], s) for p, s in zip(r["list"], through(r["list"], np.array(r["state"])))], f"{kinds}, part long, state array<double>")
    return inner(chained.join(starts(listed(whole(chained), [], "chunk")), [*key, "chunk"]))


def weighted_frames(parts: DataFrame, key: list[str], rate: int, frame: int) -> DataFrame:
    """(key, frame_idx, ms_power): the weighted mean square, summed over channels, of every whole frame of the signals
    parts(key, channel, part, start, amps); filters start at rest at sample 0.

    Each part is filtered from rest, once. The state s at its start adds O s to its output, so the sum of squares over
    a frame is p + 2 q s + s R s, where p, q = the sum of y O, and R = the sum of O O come from the part alone. Only these few
    numbers for each frame meet the states; samples don't move again."""
    of = [*key, "channel"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select(*of).schema)

    def solve(row: dict, x: np.ndarray) -> Iterator[tuple]:
        if not len(x):
            return
        w, start = weighting(rate), row["start"]
        y, gain = w.filter(x)
        share = w.of_state(len(x))
        first = np.arange(start // frame, (start + len(x) - 1) // frame + 1)
        edges = np.maximum(first * frame - start, 0)
        p, q = np.add.reduceat(y * y, edges), np.add.reduceat(y[:, None] * share, edges)
        r = np.add.reduceat((share[:, :, None] * share[:, None]).reshape(-1, 16), edges)
        n = np.diff(np.append(edges, len(x)))
        frames = [{"frame_idx": f, "n": m, "p": a, "q": b, "r": c} for f, m, a, b, c in zip(first.tolist(), n.tolist(), p.tolist(), q.tolist(), r.tolist())]
        yield (*[row[c] for c in of], row["part"], len(x), gain, frames)

    solved = cut(_mapped(parts, solve, f"{kinds}, part long, n long, gain array<double>, frames array<struct<frame_idx:long,n:long,p:double,q:array<double>,r:array<double>>>"))
    met = solved.join(_states(solved.select(*of, "part", "n", "gain"), of, rate), [*of, "part"])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    square = F.flatten(F.transform("state", lambda a: F.transform("state", lambda b: a * b)))
    each = met.select(*of, "state", square.alias("square"), F.explode("frames").alias("f"))
    power = F.col("f.p") + 2 * dot("state", "f.q") + dot("square", "f.r")
    of_channel = each.groupBy(*of, "f.frame_idx").agg(F.sum(power).alias("p"), F.sum("f.n").alias("n"))
    weight = F.coalesce(F.get(F.array(*map(F.lit, CHANNELS)), F.col("channel").cast("int")), F.lit(1.0))
    both = of_channel.groupBy(*key, "frame_idx").agg(F.sum(weight * F.col("p")).alias("p"), F.min("n").alias("n"))
    return both.where(F.col("n") == frame).select(*key, "frame_idx", (F.greatest(F.col("p"), F.lit(0.0)) / frame).alias("ms_power"))


def _gating_blocks(frames: DataFrame, key: list[str], n: int) -> DataFrame:
    """(key, power): the mean power of every n frames in a row. A frame goes to each of the n blocks it's in, so the
    blocks of one long recording are as many groups."""
    at = F.explode(F.sequence(F.col("frame_idx") - (n - 1), F.col("frame_idx"))).alias("_first")
    blocks = frames.select(*key, at, "ms_power").groupBy(*key, "_first").agg(F.avg("ms_power").alias("power"), F.count(F.lit(1)).alias("k"))
    return blocks.where(F.col("k") == n).select(*key, "power")


def context_loudness(blocks: DataFrame, slots: DataFrame, ads: DataFrame, rate: int = 44_100, window: int | None = None, frame: int | None = None, size: int = SIZE) -> DataFrame:
    """F8 from samples: slots(track_id, at) with target_lufs, the loudness of the recording up to `window` samples (4 s)
    before and after sample `at`; before_lufs, that of the track's ad; gain_db; and after_lufs, that of the ad with it.

    blocks and ads are blocks (track_id, channel, block, amps), of several channels. The part around a slot is cut out,
    weighted from its first sample on, measured in frames of 100 ms, four to a gating block, and gated at -70 and at 10
    below the mean. Without a block over the gates the loudness is -70. A slot is taken once, however often it stands."""
    window, frame = window or 4 * rate, frame or rate // 10
    key = ["track_id", "at"]
    low = F.greatest(F.lit(0).cast("long"), F.col("at") - window)
    asked = slots.select(*key).distinct().withColumn("low", low).withColumn("block", F.explode(F.sequence(F.expr(f"low div {size}"), F.expr(f"(at + {window} - 1) div {size}"))))
    start = F.greatest("low", F.col("block") * size)
    taken = F.slice("amps", (start - F.col("block") * size + 1).cast("int"), F.greatest(F.col("at") + window - start, F.lit(0)).cast("int"))
    near = asked.join(blocks, ["track_id", "block"]).select(*key, "channel", (F.col("block") - F.expr(f"low div {size}")).alias("part"), (start - F.col("low")).alias("start"), taken.alias("amps"))
    around = _gating_blocks(weighted_frames(near, key, rate, frame), key, 4)
    ad_parts = ads.select("track_id", "channel", F.col("block").alias("part"), (F.col("block") * size).alias("start"), "amps")
    spoken = cut(_gating_blocks(weighted_frames(ad_parts, ["track_id"], rate, frame), ["track_id"], 4))
    level = lambda c: F.coalesce(c, F.lit(-70.0)).alias(c)
    found = slots.join(gated(cut(around), key, "target_lufs"), key, "left").join(gated(spoken, ["track_id"], "before_lufs"), "track_id", "left")
    gained = cut(found.select(*slots.columns, level("target_lufs"), level("before_lufs")).withColumn("gain_db", F.col("target_lufs") - F.col("before_lufs")))
    louder = gained.select(*key, "gain_db").distinct().join(spoken, "track_id").select(*key, (F.col("power") * F.pow(F.lit(10.0), F.col("gain_db") / 10)).alias("power"))
    return gained.join(gated(louder, key, "after_lufs"), key, "left").withColumn("after_lufs", level("after_lufs"))


# M3, M5 ------------------------------------------------------------------------------------------------------


#: Samples worked on at a time, in whole rows.
AT_ONCE = 1 << 18


def _ramp(i: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """0 at i = 0, 1 from i = n on; 1 everywhere if n is 0."""
    return np.where(np.asarray(n) > 0, np.clip(i / np.maximum(n, 1), 0.0, 1.0), 1.0)


def _fall(i: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """1 down to 0 over n steps; none if n is 0."""
    return np.where(np.asarray(n) > 0, 1 - _ramp(i, n), 1.0)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _samples(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's samples begin, with the end of the last one's, and the samples."""
    amps = batch.column("amps")
    ends = amps.offsets.to_numpy()
    return ends - ends[0], amps.values.slice(ends[0], ends[-1] - ends[0]).fill_null(0.0).to_numpy()


_PARTS = "track_id long, part long, start long, amps array<double>"


def _placed(df: DataFrame, place: Callable[[Callable[[str], np.ndarray], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], size: int) -> DataFrame:
    """(track_id, part, start, amps): parts of `size` samples of the mix, from rows (track_id, start, amps, ...).

    `place` is given a function from a column's name to the value of each sample's row, the samples' numbers in their
    signal and the samples; it returns their numbers in the mix, -1 for those left out, and what they are there."""
    kinds = T._parse_datatype_string(_PARTS)
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: _column(batch, c) for c in batch.schema.names if c != "amps"}
            ends, values = _samples(batch)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + AT_ONCE, "right")) - 1)
                row = np.repeat(np.arange(lo, hi), np.diff(ends[lo : hi + 1]))
                i = columns["start"][row] + np.arange(ends[lo], ends[hi]) - ends[row]
                at, amps = place(lambda c: columns[c][row], i, values[ends[lo] : ends[hi]])  # noqa: B023
                kept = at >= 0
                row, at, amps = row[kept], at[kept], amps[kept]
                if len(at):
                    part = at // size
                    new = np.append(0, np.flatnonzero((np.diff(row) != 0) | (np.diff(at) != 1) | (np.diff(part) != 0)) + 1)
                    pieces = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)), pa.int32()), pa.array(amps))
                    yield pa.RecordBatch.from_arrays([pa.array(columns["track_id"][row[new]]), pa.array(part[new]), pa.array(at[new]), pieces.cast(arrow.field("amps").type)], schema=arrow)
                lo = hi

    return df.mapInArrow(run, kinds)


def _added(parts: DataFrame) -> DataFrame:
    """(track_id, start, amps): each part once, the sum of all that is laid there.

    Parts are sorted, and added as they stream by, all of a batch at once; the last one waits for the next batch. Groups of
    a few samples each, as here, would cost a call and an Arrow stream for every one of them."""
    kinds = T._parse_datatype_string("track_id long, start long, amps array<double>")
    arrow = to_arrow_schema(kinds)

    def total(batch: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        ends, values = _samples(batch)
        start, n = _column(batch, "start"), np.diff(ends)
        first = np.minimum.reduceat(start, new)
        length = np.maximum.reduceat(start + n, new) - first
        to = np.append(0, np.cumsum(length))
        group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(start))))
        where = np.repeat(to[group] + start - first[group] - ends[:-1], n) + np.arange(len(values))
        amps = pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(np.bincount(where, values, to[-1])))
        return pa.RecordBatch.from_arrays([batch.column("track_id").take(pa.array(new)), pa.array(first), amps.cast(arrow.field("amps").type)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            if not batch.num_rows:
                continue
            track, part = _column(batch, "track_id"), _column(batch, "part")
            new = np.append(0, np.flatnonzero((np.diff(track) != 0) | (np.diff(part) != 0)) + 1)
            if len(new) > 1:
                yield total(batch.slice(0, new[-1]), new[:-1])
            held = pa.concat_batches([batch.slice(new[-1])])
        if held is not None:
            yield total(held, np.array([0]))

    return parts.repartition("track_id", "part").sortWithinPartitions("track_id", "part", "start").mapInArrow(run, kinds)


def overlay_gain(blocks: DataFrame, promo: DataFrame, slots: DataFrame, duck_db: float = 0.0, crossfade: int = 11_025, fade: int = 8_820, duck_ramp: int = 4_410, size: int = SIZE) -> DataFrame:
    """M3: pieces of the mix of an ad, promo(track_id, block, amps), laid over the programme at slots(track_id, at);
    lengths are in samples, and all is as in the form with a row for each sample.

    Blocks that the ad and its crossfades don't touch keep their samples, later ones under an earlier start. Only touched
    blocks and the ad's become parts of `size` samples of the mix, which are sorted and added up. The plan, a row for a
    track, is stored, as three joins start from it; blocks and promo are read several times."""
    plan = cut(overlay_plan(_lengths(blocks, size, "n").join(_lengths(promo, size, "ad"), "track_id").join(slots.select("track_id", "at"), "track_id"), crossfade))
    start = F.col("block") * size
    planned = blocks.join(plan, "track_id", "left").withColumn("start", start)
    first = F.least(F.col("p") - F.col("c1"), F.col("m") - F.col("c2"))  # the second crossfade may begin before a short ad
    before, behind = F.col("start") + F.size("amps") <= first, F.col("start") >= F.col("p") + F.col("l") + F.col("c2")
    shift = F.when(behind, F.col("c1") + F.col("c2")).otherwise(0)
    same = F.col("p").isNull() | before | behind
    left = planned.where(same).select("track_id", (F.col("start") - shift).alias("start"), "amps")

    def programme(of: Callable[[str], np.ndarray], i: np.ndarray, amps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, length, c1, c2 = of("p"), of("l"), of("c1"), of("c2")
        j = i - p
        pre, post = j < 0, j >= length
        at = i - np.where(pre, 0, c1) - np.where(post, c2, 0)
        duck = 10 ** (-duck_db / 20) * _ramp(j, duck_ramp) * _ramp(length - 1 - j, duck_ramp) if duck_db > 0 else 1.0
        into = np.where(pre, _fall(j + c1, c1), np.where(post, _ramp(j - length, c2), duck))
        return at, amps * into * np.where(pre | post, 1.0, _ramp(j, c1)) * np.where(post, 1.0, _fall(at - (of("m") - c2), c2))

    def ad(of: Callable[[str], np.ndarray], a: np.ndarray, amps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c1, c2 = of("c1"), of("c2")
        at = of("p") - c1 + a
        gain = _ramp(a, fade) * _ramp(of("ad") - 1 - a, fade) * _ramp(a, c1) * _fall(at - (of("m") - c2), c2)
        return np.where(a < of("l"), at, -1), amps * gain

    needed = ["track_id", "start", "p", "l", "c1", "c2", "m", "amps"]
    under = _placed(planned.where(~same).select(*needed), programme, size)
    over = _placed(promo.join(plan, "track_id").withColumn("start", start).select(*needed, "ad"), ad, size)
    return left.unionByName(_added(under.unionByName(over)))


def room_tone_bed(blocks: DataFrame, promo: DataFrame, slots: DataFrame, tone: int = 26_460, gain_db: float = -26.0, podcasts_only: bool = True, size: int = SIZE) -> DataFrame:
    """M5: pieces of the ad with the last `tone` samples before the slot under it, repeated over its length; without any,
    the ad as it is. slots(track_id, mode, at), as in the form with a row for each sample. A track's bed is one row."""
    bedded = (slots.where("mode = 'podcast'") if podcasts_only else slots).select("track_id", "at")
    low = F.greatest(F.lit(0).cast("long"), F.col("at") - tone)
    asked = bedded.withColumn("low", low).where("at > low").withColumn("block", F.explode(F.sequence(F.expr(f"low div {size}"), F.expr(f"(at - 1) div {size}"))))
    start = F.greatest("low", F.col("block") * size)
    taken = F.slice("amps", (start - F.col("block") * size + 1).cast("int"), (F.col("at") - start).cast("int"))
    pieces = asked.join(blocks, ["track_id", "block"]).groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("block", taken.alias("amps")))).alias("s"))
    beds = pieces.select("track_id", F.flatten(F.transform("s", lambda v: v["amps"])).alias("bed")).where("size(bed) > 0")
    gain = 10 ** (gain_db / 20)

    def under(r: dict, amps: np.ndarray) -> Iterator[tuple]:
        at = r["block"] * size
        if r["bed"]:
            bed = np.array([b or 0.0 for b in r["bed"]])
            amps = amps + gain * bed[(at + np.arange(len(amps))) % len(bed)]
        yield r["track_id"], at, amps

    return _mapped(promo.join(beds, "track_id", "left"), under, "track_id long, start long, amps array<double>")
