"""Operators over sample blocks against plain loops and against the forms with a row for each sample."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adslots import queries
from adslots.fixtures import Catalogue
from adslots.operators import blocks as b
from adslots.operators import frames as f
from adslots.operators import splice as m
from adslots.storage import scratch


def table(spark, tracks, size):
    """Blocks of {track: samples} or {(track, channel): samples}."""
    rows = [(*(k if isinstance(k, tuple) else (k,)), i // size, [float(v) for v in x[i : i + size]]) for k, x in tracks.items() for i in range(0, len(x), size)]
    channel = "channel int, " if rows and len(rows[0]) == 4 else ""
    return spark.createDataFrame(rows, f"track_id long, {channel}block long, amps array<double>")


def noise(n, seed=0):
    return np.random.default_rng(seed).normal(0, 0.1, n)


def test_pack_and_unpack(spark):
    samples = spark.range(100).select((F.col("id") % 3).alias("track_id"), F.expr("id div 3").alias("i"), F.col("id").cast("double").alias("amp"))
    packed = b.pack(samples, 16)
    assert packed.count() == 9
    back = b.unpack(packed.select("track_id", (F.col("block") * 16).alias("start"), "amps"), "start", "amps", "i", "amp")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, samples.collect()))


@pytest.mark.parametrize(("frame", "hop", "size"), [(2205, 1102, 4096), (5, 2, 5), (7, 9, 16), (6, 3, 6)])
def test_frame_rms(spark, frame, hop, size):
    tracks = {1: noise(3 * size + frame // 2), 2: noise(size), 3: noise(frame - 1), 4: noise(2 * size + 1), 5: noise(frame)}
    out = b.unpack(b.frame_rms(table(spark, tracks, size), frame, hop, size), "first", "rms", "k", "rms").collect()
    want = {}
    for t, x in tracks.items():
        for k in range((len(x) - frame) // hop + 1 if len(x) >= frame else 0):
            want[t, k] = math.sqrt((x[k * hop : k * hop + frame] ** 2).mean())
        if len(x) < frame:
            want[t, 0] = None
    got = {(r.track_id, r.k): r.rms for r in out}
    assert got.keys() == want.keys() and len(out) == len(want)
    assert all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-12 for k in want)


def test_few_rows_for_an_hour(spark):
    """A quarter of an hour at 44,100 samples a second, made on the executors."""
    hour = spark.range(0, 44_100 * 900 // b.SIZE).select(F.lit(1).cast("long").alias("track_id"), F.col("id").alias("block"), F.array_repeat(F.lit(0.5), b.SIZE).alias("amps"))
    out = b.frame_rms(hour)
    sizes = out.select(F.size("rms").alias("n")).agg(F.count("n"), F.sum("n")).first()
    assert sizes[0] <= 2 * 605 and sizes[1] == (605 * b.SIZE - 2205) // 1102 + 1


@pytest.mark.parametrize("size", [3, 16, 64])
def test_peak_envelope(spark, size):
    rng = random.Random(2)
    samples = [(t, i, rng.uniform(-1, 1)) for t, n in ((1, 100), (2, 7), (3, 1), (4, 55)) for i in range(n)]
    rows = spark.createDataFrame(samples, "track_id long, i long, amp double")
    packed = b.pack(rows, size)
    got = packed and b.peak_envelope(packed, 10, size).select("track_id", F.posexplode("peaks").alias("block", "peak"))
    want = f.peak_envelope(rows, 10)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in want.select("track_id", "block", "peak").collect())


def plain_filter(x, rate):
    """Sample after sample, as the two filters are written."""
    for c, d in (b.shelf(*b.SHELF, rate), b.high_pass(*b.HIGH_PASS, rate)):
        y, s1, s2 = [], 0.0, 0.0
        for v in x:
            o = c[0] * v + s1
            s1, s2 = c[1] * v - d[1] * o + s2, c[2] * v - d[2] * o
            y.append(o)
        x = y
    return np.array(x)


def test_filters_are_near_those_of_the_standard():
    """At 48 kHz the standard prints its coefficients; the meter's own formulas come near them."""
    (c, d), (e, g) = b.shelf(*b.SHELF, 48_000), b.high_pass(*b.HIGH_PASS, 48_000)
    assert np.allclose(c, [1.53512485958697, -2.69169618940638, 1.19839281085285], atol=0.05) and np.allclose(d, [1, -1.69065929318241, 0.73248077421585], atol=0.05)
    assert np.allclose(e, [1, -2, 1], atol=0.01) and np.allclose(g, [1, -1.99004745483398, 0.99007225036621], atol=1e-3)


@pytest.mark.parametrize("n", [1, 255, 256, 257, 1000])
def test_filter_of_one_part(n):
    w, x = b.Weighting(44_100), noise(n)
    y, end = w.filter(x)
    assert np.abs(y - plain_filter(x, 44_100)).max() < 1e-12
    more = noise(300, 1)
    whole = plain_filter(np.append(x, more), 44_100)[n:]
    assert np.abs(w.filter(more)[0] + w.of_state(300) @ end - whole).max() < 1e-12


@pytest.mark.parametrize(("size", "chained"), [(100, 1024), (7, 4), (33, 1), (4096, 1024)])
def test_weighted_frames(spark, size, chained, monkeypatch):
    """Equal to the plain filter over block edges, with several channels, and with states chained over many chunks."""
    monkeypatch.setattr(b, "CHAINED", chained)
    x = {(1, 0): noise(2000), (1, 1): noise(2000, 1) + 0.2, (1, 3): noise(2000, 2), (2, 0): noise(90, 3), (3, 0): np.zeros(200)}
    parts = table(spark, x, size).select("track_id", "channel", F.col("block").alias("part"), (F.col("block") * size).alias("start"), "amps")
    got = {(r.track_id, r.frame_idx): r.ms_power for r in b.weighted_frames(parts, ["track_id"], 8000, 80).collect()}
    want = {}
    for (t, c), v in x.items():
        y = plain_filter(v, 8000) ** 2 * (1.41 if c == 3 else 1.0)
        for k in range(len(v) // 80):
            want[t, k] = want.get((t, k), 0.0) + y[k * 80 : k * 80 + 80].mean()
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12


def plain_loudness(channels, rate, gain_db=0.0):
    y = [plain_filter(x, rate) ** 2 * 10 ** (gain_db / 10) for x in channels]
    step = rate // 10
    blocks = [sum(v[k * step : k * step + 4 * step].mean() for v in y) for k in range(len(y[0]) // step - 3)]
    lufs = lambda p: -0.691 + 10 * math.log10(p)
    loud = [p for p in blocks if p > 0 and lufs(p) > -70]
    if not loud:
        return -70.0
    over = [p for p in loud if lufs(p) > lufs(np.mean(loud)) - 10]
    return lufs(np.mean(over))


def test_context_loudness(spark):
    """Windows cut inside blocks, at the beginning and past the end; an ad shorter than a gating block."""
    rate, size, w = 1000, 350, 2000
    x = {t: [noise(9000, t) * np.linspace(0.05, 1, 9000), noise(9000, t + 50) * 0.3] for t in (1, 2, 3, 4)}
    ads = {1: [noise(2500, 9), noise(2500, 8)], 2: [noise(399, 7), noise(399, 6)], 3: [np.zeros(1000), np.zeros(1000)]}
    slots = [(1, 4321), (1, 100), (2, 8999), (3, 4200), (4, 350), (4, 20_000), (5, 10)]
    of = lambda d: table(spark, {(t, c): v for t, both in d.items() for c, v in enumerate(both)}, size)
    out = b.context_loudness(of(x), spark.createDataFrame(slots, "track_id long, at long"), of(ads), rate=rate, window=w, size=size)
    got = {(r.track_id, r["at"]): r for r in out.collect()}
    assert set(got) == set(slots)
    for t, at in slots:
        target = plain_loudness([v[max(0, at - w) : at + w] for v in x[t]], rate) if t in x else -70.0
        before = plain_loudness(ads[t], rate) if t in ads else -70.0
        after = plain_loudness(ads[t], rate, target - before) if t in ads else -70.0
        r = got[t, at]
        assert max(abs(r.target_lufs - target), abs(r.before_lufs - before), abs(r.gain_db - target + before), abs(r.after_lufs - after)) < 1e-6, (t, at)


@pytest.mark.parametrize(("size", "crossfade", "duck"), [(4, 2, 6.0), (16, 5, 0.0), (5, 9, 3.0), (64, 0, 6.0)])
def test_overlay(spark, size, crossfade, duck):
    rng = random.Random(4)
    sig = lambda lengths: spark.createDataFrame([(t, i, rng.uniform(-1, 1)) for t, n in lengths.items() for i in range(n)], "track_id long, i long, amp double")
    main, promo = sig({1: 50, 2: 30, 3: 80, 4: 10, 5: 40, 6: 33, 7: 60}), sig({1: 12, 2: 40, 3: 1, 4: 3, 6: 9, 7: 2})
    slots = spark.createDataFrame([(1, 20), (2, 25), (3, 40), (4, 0), (5, 3), (6, 99), (7, 30)], "track_id long, at long")
    want = m.overlay_gain(main.withColumnRenamed("i", "frame_idx"), promo, slots, duck_db=duck, crossfade=crossfade, fade=3, duck_ramp=2)
    mix = b.overlay_gain(b.pack(main, size), b.pack(promo, size), slots, duck_db=duck, crossfade=crossfade, fade=3, duck_ramp=2, size=size)
    got = b.unpack(mix, "start", "amps", "out_idx", "amp")
    key = lambda df: {(r.track_id, r.out_idx): r.amp for r in df.collect()}
    have, should = key(got), key(want)
    assert got.count() == len(have) and have.keys() == should.keys()
    assert max(abs(have[k] - should[k]) for k in should) < 1e-12


def test_overlay_of_many_tracks(spark, small):
    """Batches of three rows, so parts of the mix that meet are in two of them; frames are numbered once, and no group of a few
    samples is a call of its own."""
    with scratch(spark):
        x = Catalogue(spark, small)
        want = {(r.track_id, r.out_idx): r.amp for r in queries.m3_overlay_gain(x).collect()}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        try:
            out = queries.m3_overlay_gain_blocks(Catalogue(spark, small))
            got = out.collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Window" not in plan
    assert len(got) == len(want) and all(abs(r.amp - want[r.track_id, r.out_idx]) < 2e-6 for r in got)


@pytest.mark.parametrize("size", [4, 16])
@pytest.mark.parametrize("only", [True, False])
def test_room_tone(spark, size, only):
    rng = random.Random(5)
    sig = lambda lengths: spark.createDataFrame([(t, i, rng.uniform(-1, 1)) for t, n in lengths.items() for i in range(n)], "track_id long, i long, amp double")
    main, promo = sig({1: 50, 2: 30, 3: 8, 4: 20}), sig({1: 12, 2: 40, 3: 5, 4: 6})
    slots = spark.createDataFrame([(1, "podcast", 20), (2, "song", 25), (3, "podcast", 3), (4, "podcast", 0)], "track_id long, mode string, at long")
    want = m.room_tone_bed(main.withColumnRenamed("i", "frame_idx"), promo, slots, podcasts_only=only)
    got = b.unpack(b.room_tone_bed(b.pack(main, size), b.pack(promo, size), slots, tone=6, podcasts_only=only, size=size), "start", "amps", "i", "amp")
    have, should = ({(r.track_id, r.i): r.amp for r in d.collect()} for d in (got, want))
    assert have.keys() == should.keys() and max(abs(have[k] - should[k]) for k in should) < 1e-12


def test_nothing(spark):
    none = table(spark, {}, 4).selectExpr("track_id", "block", "amps")
    stereo = none.withColumn("channel", F.lit(0))
    slots = spark.createDataFrame([], "track_id long, mode string, at long")
    for out in (b.frame_rms(none), b.peak_envelope(none), b.overlay_gain(none, none, slots), b.room_tone_bed(none, none, slots), b.context_loudness(stereo, slots.select("track_id", "at"), stereo)):
        assert out.collect() == []
