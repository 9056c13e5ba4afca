"""Scans over buckets against the forms that order a whole recording, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from adslots.operators import candidates as c
from adslots.operators import frames as f
from adslots.operators import scans
from adslots.operators import speakers as k
from adslots.operators import splice as m
from adslots.operators import transcript as t

#: Track 1 has most of all rows.
LENGTHS = {1: 700, 2: 40, 3: 1, 4: 16}


def same(a, b):
    assert sorted(map(tuple, a.select(*b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(1)
    rows = []
    for track, n in LENGTHS.items():
        quiet = False
        for i in range(n):
            quiet = quiet if rng.random() < 0.8 else not quiet
            if rng.random() > 0.03:  # some frames are missing
                rows.append((track, i, i * 100, 0.0 if quiet and rng.random() < 0.3 else 1e-6 if quiet else 1.0))
    return spark.createDataFrame(rows, "track_id long, frame_idx long, t_ms long, ms_power double").repartition(4)


@pytest.mark.parametrize("bucket", [1, 2, 8, 1000])
def test_quiet_runs(frames, bucket):
    level = f.quiet_threshold(frames)
    same(scans.quiet_runs(frames, level, 200, bucket=bucket), f.quiet_runs(frames, level, 200))


@pytest.mark.parametrize("bucket_ms", [1, 700, 10**9])
def test_snap_to_beat(spark, frames, bucket_ms):
    minima = f.quietest(frames.select("track_id", "frame_idx", F.sqrt("ms_power").alias("rms")), 60, hop=4410)
    beats = frames.where("frame_idx % 37 = 5 AND track_id <> 4").select("track_id", F.col("t_ms").alias("beat_ms"))
    same(scans.snap_to_beat(minima, beats, 40, bucket_ms), f.snap_to_beat(minima, beats, 40))


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_transcript_rollup(spark, bucket):
    rng = random.Random(2)
    rows = [(track, i, rng.choice(["", " ", "a word", "längere Wörter hier", "x" * 90])) for track, n in LENGTHS.items() for i in range(n)]
    segments = spark.createDataFrame(rows, "track_id long, seg_idx int, text string").repartition(4)
    for limit in (1, 100, 3000):
        same(scans.transcript_rollup(segments, limit, bucket), t.transcript_rollup(segments, limit))


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_sample_budget(spark, bucket):
    rng = random.Random(3)
    rows = [(track, i, rng.choice("AB"), i * 1000, i * 1000 + rng.choice([0, 300, 900])) for track, n in LENGTHS.items() for i in range(n)]
    turns = spark.createDataFrame(rows, "track_id long, turn_idx int, speaker string, start_ms long, end_ms long").repartition(4)
    for budget in (1, 5000, 10**7):
        same(scans.sample_budget(turns, budget, bucket), k.sample_budget(turns, budget))


@pytest.mark.parametrize("bucket_ms", [1, 500, 10**9])
def test_timeline(spark, bucket_ms):
    rng = random.Random(4)
    rows = [(track, i, rng.randint(0, 40) * 100, rng.randint(1, 9) * 1000) for track, n in LENGTHS.items() for i in range(n)]
    slots = spark.createDataFrame(rows, "track_id long, ord int, at_ms long, ad_ms long").repartition(4)
    lengths = spark.createDataFrame([(1, 10_000), (2, None), (3, 500)], "track_id long, duration_ms long")
    same(scans.timeline(slots, lengths, bucket_ms), m.timeline(slots, lengths))


def both_lists(spark, rng, n, spread):
    rows = [(track, i, rng.randint(0, max(1, int(m * spread))), rng.choice([0, 500, 600, 700, None]), rng.choice(["ends.", "not", "", None])) for track, m in n.items() for i in range(m)]
    schema = "track_id long, seq int, ms long, silence_ms long, snippet string"
    half = len(rows) // 2
    return spark.createDataFrame(rows[:half], schema).repartition(3), spark.createDataFrame(rows[half:] + [(9, 0, None, 1, "a"), (9, 1, None, 1, "a"), (9, 2, 10, 1, "a"), (1, 0, 5, 600, "ends."), (1, 0, 5, 600, "ends.")], schema)


@pytest.mark.parametrize("bucket_ms", [400, 1000, 10**9])
@pytest.mark.parametrize("spread", [20, 150, 500])
def test_collapse_near(spark, bucket_ms, spread):
    """Dense, linked and loose candidates."""
    base, extra = both_lists(spark, random.Random(spread), {1: 400, 2: 30, 3: 1, 4: 2, 5: 60}, spread)
    same(scans.collapse_near(base, extra, 400, bucket_ms), c.collapse_near(base, extra))


def test_one_island_of_a_million(spark):
    """300 ms from one candidate to the next: one island, in 84 buckets; kept are every second and where the pause is longer."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("track_id"), F.col("id").cast("int").alias("seq"), (F.col("id") * 300).alias("ms"), F.when(F.col("id") % 5 == 3, 900).otherwise(500).cast("long").alias("silence_ms"), F.lit("x").alias("snippet"))
    out = scans.collapse_near(rows, rows.limit(0))
    want, last = [], None
    for i in range(n):
        pause = 900 if i % 5 == 3 else 500
        if last is None or (i - last[0]) * 300 > 400:
            want.append(i)
            last = (i, pause)
        elif pause > last[1]:
            want[-1] = i
            last = (i, pause)
    sums = out.agg(F.count(F.lit(1)), F.sum("seq"), F.sum(F.col("seq").cast("long") * F.col("seq"))).first()
    assert tuple(sums) == (len(want), sum(want), sum(i * i for i in want))


def greedy(rows, sep, k):
    picks = []
    for r in sorted(rows, key=lambda r: (-r[3], r[2], r[4], r[1])):
        if len(picks) < k and all(abs(r[2] - p[2]) >= sep for p in picks):
            picks.append(r)
    return [(r[2], r[3]) for r in picks]


@pytest.mark.parametrize(("k", "bucket_ms"), [(1, 12_000), (3, 30_000), (200, 3_600_000), (10_000, 900_000)])
def test_select_separated(spark, k, bucket_ms):
    """A day-long track, a slope of scores, ties and repeated rows, against the plain greedy choice."""
    rng = random.Random(6)
    rows = [(1, i, rng.randint(0, 86_400_000), rng.choice([0.5, 0.6, round(rng.random(), 3)]), rng.choice([0, 1])) for i in range(3000)]
    rows += [(2, i, i * 3000, i / 100, 0) for i in range(60)] + [(3, 0, 5, 0.5, 0), (3, 0, 5, 0.5, 0), (3, 1, 5, 0.5, 0), (4, 0, 0, 0.1, 1)]
    scored = spark.createDataFrame(rows, "track_id long, seq int, ms long, score double, src int").selectExpr("*", "'song' AS mode", "1.0D AS duration_s", "1L AS silence_ms", "'s' AS snippet").repartition(4)
    out = {r.track_id: [(p.ms, p.score) for p in r.picks] for r in scans.select_separated(scored, 6000, k, bucket_ms).collect()}
    assert out == {t: greedy([r for r in rows if r[0] == t], 6000, k) for t in (1, 2, 3, 4)}
    if k == 3:
        same(scans.select_separated(scored, 6000, k, bucket_ms).select("track_id", "picks"), c.select_separated(scored, 6000, k).select("track_id", "picks"))


def test_nothing(spark, frames):
    none = frames.limit(0)
    assert scans.quiet_runs(none, f.quiet_threshold(none)).collect() == []
    cands = spark.createDataFrame([], "track_id long, seq int, ms long, silence_ms long, snippet string")
    assert scans.collapse_near(cands, cands).collect() == []
    assert scans.select_separated(cands.selectExpr("*", "0 AS src", "'song' AS mode", "1.0D AS duration_s", "0.5D AS score")).collect() == []
    assert scans.transcript_rollup(spark.createDataFrame([], "track_id long, seg_idx int, text string")).collect() == []


def test_one_recording_is_many_groups(spark, frames):
    """What is partitioned by recording alone are rows for each bucket, made by an aggregate."""
    frames.createOrReplaceTempView("scanned")
    stored = spark.table("scanned")
    plan = scans.carried(stored.select("track_id", "frame_idx", "t_ms"), ["track_id"], F.expr("frame_idx div 8"), [F.col("frame_idx")], s=("sum", F.col("t_ms")))
    rows = plan._jdf.queryExecution().executedPlan().toString().splitlines()
    windows = [r for r in rows if "Window [" in r]
    assert len(windows) == 2 and sum("_bucket" in r.split("windowspecdefinition(")[1].split(",")[1] for r in windows) == 2
    sizes = plan.groupBy("track_id", F.expr("frame_idx div 8").alias("b")).count().where("track_id = 1")
    assert sizes.count() == 88 and sizes.agg(F.max("count")).first()[0] <= 8
