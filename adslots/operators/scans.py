"""F4, F6, T3, K2, M2, C5 and C8 for recordings of any length: scans over buckets, with what is carried from one to the next.

The forms in the other modules order a recording in one window, so one recording is one task. Here rows are folded inside
(recording, bucket), each bucket leaves one row, these rows are scanned, and what was there before a bucket goes back to
it; runs that touch an edge are stitched. Only one row for each bucket is ever ordered over a whole recording. Results are
the same, row for row. A recording with half of all rows is as many groups as it has buckets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import by_track, ends_sentence, trimmed
from ..storage import cut, drop_cut
from . import frames as f
from . import speakers as k
from . import splice as m
from . import transcript as t

#: Frames, segments or turns of a bucket; milliseconds of one where rows are placed by time.
ROWS, SPAN_MS = 50_000, 3_600_000
#: Rows of a batch of results.
BATCH = 10_000


def carried(df: DataFrame, key: list[str], bucket: Column, order: list[Column], **values: tuple[str, Column]) -> DataFrame:
    """`df` with one column for each of the values (kind, column): the sum, max or min of the column over all rows of the
    key before the row; buckets never fall in `order`. A sum over nothing is 0."""
    kinds = {"sum": F.sum, "max": F.max, "min": F.min}
    kept = {name: kinds[kind] for name, (kind, _) in values.items()}
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
    rows = df.withColumn("_bucket", bucket)
    ahead = W.partitionBy(*key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*key, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*key, "_bucket").agg(*[kept[n](c).alias(n) for n, (_, c) in values.items()])
    starts = totals.select(*key, "_bucket", F.struct(*[kept[n](n).over(ahead).alias(n) for n in values]).alias("_start"))
    placed = rows.join(starts, [*key, "_bucket"])
    return placed.select(*df.columns, *[both[kind](kept[n](c).over(inside), F.col("_start")[n]).alias(n) for n, (kind, c) in values.items()])


def quiet_runs(frames: DataFrame, thresholds: DataFrame, min_ms: int = 500, frame_ms: int = 100, bucket: int = ROWS) -> DataFrame:
    """(track_id, start_ms, end_ms) of the longest runs of frames at or below the threshold. Runs are found in each
    bucket; only those that touch a bucket's edge, at most two for each, are ordered over the recording and joined."""
    quiet = f.quiet_frames(frames, thresholds).withColumn("_bucket", F.expr(f"frame_idx div {bucket}"))
    island = F.col("frame_idx") - F.row_number().over(W.partitionBy("track_id", "_bucket").orderBy("frame_idx"))
    runs = quiet.withColumn("_island", island).groupBy("track_id", "_bucket", "_island").agg(
        F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"), F.min("t_ms").alias("start_ms"), (F.max("t_ms") + frame_ms).alias("end_ms")
    )
    left, right = F.col("first") == F.col("_bucket") * bucket, F.col("last") == (F.col("_bucket") + 1) * bucket - 1
    edged = runs.where(left | right)
    new = F.coalesce(F.lag("last").over(by_track("first")) + 1 != F.col("first"), F.lit(True)).cast("int")
    chained = edged.withColumn("_new", new).withColumn("_chain", F.sum("_new").over(by_track("first")))
    whole = chained.groupBy("track_id", "_chain").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_chain")
    every = runs.where(~(left | right)).select("track_id", "start_ms", "end_ms").unionByName(whole)
    return every.where(F.col("end_ms") - F.col("start_ms") >= min_ms)


def snap_to_beat(minima: DataFrame, beats: DataFrame, max_n: int = 30, bucket_ms: int = SPAN_MS) -> DataFrame:
    """minima on their nearest beats. The last beat before a bucket and the first one after it are carried into it."""
    both = f.beats_and_minima(minima, beats).withColumn("_bucket", F.expr(f"ms div {bucket_ms}"))
    of_bucket = both.groupBy("track_id", "_bucket").agg(F.min("beat").alias("low"), F.max("beat").alias("high"))
    behind, ahead = (by_track(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc("_bucket"), F.desc("_bucket")))
    edges = of_bucket.select("track_id", "_bucket", F.max("high").over(behind).alias("_behind"), F.min("low").over(ahead).alias("_ahead"))
    inside = lambda o: W.partitionBy("track_id", "_bucket").orderBy(o).rangeBetween(W.unboundedPreceding, 0)
    found = both.join(edges, ["track_id", "_bucket"]).select(
        "track_id", "ms", "rank", F.coalesce(F.last("beat", ignorenulls=True).over(inside(F.asc("ms"))), F.col("_behind")).alias("before"),
        F.coalesce(F.last("beat", ignorenulls=True).over(inside(F.desc("ms"))), F.col("_ahead")).alias("after"),
    )
    return f.snapped(found, max_n)


def transcript_rollup(segments: DataFrame, limit: int = 3000, bucket: int = ROWS) -> DataFrame:
    """(track_id, transcript): the segments' texts joined by spaces, cut to `limit` characters."""
    texts = segments.withColumn("text", trimmed("text")).where("text <> ''")
    placed = carried(texts.select("track_id", "seg_idx", "text"), ["track_id"], F.expr(f"seg_idx div {bucket}"), [F.col("seg_idx")], _before=("sum", F.length("text") + 1))
    return t.joined_texts(placed.where(F.col("_before") <= limit), limit)


def sample_budget(speakers: DataFrame, max_ms: int = 30000, bucket: int = ROWS) -> DataFrame:
    """K2: (track_id, speaker, turn_idx, start_ms, take_ms): turns in order until the budget is used, the last cut."""
    length = F.col("end_ms") - F.col("start_ms")
    return k.within_budget(carried(speakers, ["track_id", "speaker"], F.expr(f"turn_idx div {bucket}"), [F.col("turn_idx")], used=("sum", length)), max_ms)


def timeline(slots: DataFrame, lengths: DataFrame, bucket_ms: int = SPAN_MS) -> DataFrame:
    """M2: the pieces of a track with all its ads, as by the other form."""
    order = [F.col("at_ms"), F.desc("ord")]
    placed = carried(slots, ["track_id"], F.expr(f"at_ms div {bucket_ms}"), order, _n=("sum", F.lit(1)), _from=("max", F.col("at_ms")), before=("sum", F.col("ad_ms")))
    zero = F.lit(0).cast("long")
    numbered = placed.select(*slots.columns, (F.col("_n") + 1).alias("k"), F.coalesce("_from", zero).alias("from_ms"), F.col("before").cast("long").alias("before"))
    return m.timeline_pieces(numbered, lengths)


def _groups(batches: Iterable[pa.RecordBatch], *key: str) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each key, which come one after another."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            of = tuple(row[c] for c in key)
            if of != now and held:
                yield now, held
                held = []
            now = of
            held.append(row)
    if held:
        yield now, held


def _batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _next(last: dict, own: list[dict], at: int, gap: int) -> tuple[int, bool]:
    """Who comes after `last` among the candidates from `at` on, and whether that one starts anew."""
    for j in range(at, len(own)):
        c = own[j]
        if c["ms"] - last["ms"] > gap:
            return j, True
        longer = c["silence_ms"] is not None and last["silence_ms"] is not None and c["silence_ms"] > last["silence_ms"]
        if longer or (c["ends"] and not last["ends"]):
            return j, False
    return len(own), False


def collapse_near(base: DataFrame, extra: DataFrame, gap: int = 400, bucket_ms: int = SPAN_MS) -> DataFrame:
    """Both lists in time order, where a candidate within `gap` of the last kept one replaces it if its pause is longer,
    or it alone ends a sentence; the same as by the other form, without a list of an island's candidates.

    What happens in a bucket depends on the last kept candidate before it, and only if that is within `gap`: so on one of
    the few candidates at the end of the bucket before. Each bucket tells which of its own is last for each of them
    and for none (paths that meet are walked once); these rows, one for each bucket, are chained over the recording;
    then each bucket, told its entry, gives out the candidates it keeps. Buckets are no shorter than `gap`. Candidates
    without a place are all kept. Snippets stay where they are and are joined to what is kept."""
    if bucket_ms < gap:
        raise ValueError("buckets must be as long as the gap")
    both = base.withColumn("src", F.lit(0)).unionByName(extra.withColumn("src", F.lit(1)))
    rows = cut(both.select("track_id", "ms", "silence_ms", "snippet", "src", "seq", F.monotonically_increasing_id().alias("uid")))
    slim = rows.where("ms IS NOT NULL").select("track_id", "ms", "src", "seq", "silence_ms", ends_sentence(F.col("snippet")).alias("ends"), "uid")
    own, late = F.expr(f"cast(floor(ms / {bucket_ms}) as long)"), F.expr(f"cast(floor((ms + {gap}) / {bucket_ms}) as long)")
    where = F.when(late > own, F.array(F.struct(own.alias("bucket"), F.lit(True).alias("own")), F.struct(late.alias("bucket"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(own.alias("bucket"), F.lit(True).alias("own"))))
    placed = slim.select("*", F.explode(where).alias("p")).select("*", "p.bucket", "p.own").drop("p")
    in_order = ["track_id", "bucket", "ms", "src", "seq", "uid"]
    dealt = lambda df: df.repartition("track_id", "bucket").sortWithinPartitions(*in_order)
    track = placed.schema["track_id"].dataType.simpleString()
    arrow_track = pa.int64() if track == "bigint" else pa.int32() if track == "int" else pa.string()

    told = pa.schema([("track_id", arrow_track), ("bucket", pa.int64()), ("before", pa.list_(pa.int64())), ("last", pa.list_(pa.int64()))])

    def summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for (of, bucket), held in _groups(batches, "track_id", "bucket"):
                inside, before = [r for r in held if r["own"]], [r for r in held if not r["own"]]
                if not inside:
                    continue
                ends: dict[int, int] = {}

                def last(j: int, inside: list[dict] = inside, ends: dict[int, int] = ends) -> int:
                    path = []
                    while j not in ends:
                        path.append(j)
                        following = _next(inside[j], inside, j + 1, gap)[0]
                        if following == len(inside):
                            ends[j] = j
                        else:
                            j = following
                    for k in path:
                        ends[k] = ends[j]
                    return ends[j]

                starts = [0, *(_next(e, inside, 0, gap)[0] for e in before)]
                # an entry that nothing here replaces stays the last one
                yield of, bucket, [e["uid"] for e in before], [e["uid"] if j == len(inside) else inside[last(j)]["uid"] for e, j in zip([None, *before], starts)]

        return _batched(each(), told)

    entered = pa.schema([("track_id", arrow_track), ("bucket", pa.int64()), ("entry", pa.int64())])

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The entry of each bucket; without a bucket, the last one kept of a recording."""

        def each() -> Iterator[tuple]:
            now, state = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if state is not None and r["track_id"] != now:
                        yield now, None, state
                        state = None
                    now = r["track_id"]
                    yield now, r["bucket"], state
                    state = r["last"][r["before"].index(state) + 1 if state in r["before"] else 0]
            if state is not None:
                yield now, None, state

        return _batched(each(), entered)

    kept_of = pa.schema([("uid", pa.int64())])

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for _, held in _groups(batches, "track_id", "bucket"):
                inside, entry = [r for r in held if r["own"]], held[0]["entry"]
                start = next((r for r in held if not r["own"] and r["uid"] == entry), None)
                if start is None and entry is not None:
                    yield (entry,)
                j, anew = _next(start, inside, 0, gap) if start else (0, False)
                if anew:
                    yield (start["uid"],)
                while j < len(inside):
                    following, anew = _next(inside[j], inside, j + 1, gap)
                    if anew:
                        yield (inside[j]["uid"],)
                    j = following

        return _batched(each(), kept_of)

    told_sql = f"track_id {track}, bucket long, before array<long>, last array<long>"
    one_by_one = dealt(placed).mapInArrow(summaries, told_sql).repartition("track_id").sortWithinPartitions("track_id", "bucket")
    entries = cut(one_by_one.mapInArrow(chain, f"track_id {track}, bucket long, entry long"))
    asked = placed.join(entries.where("bucket IS NOT NULL"), ["track_id", "bucket"])
    uids = dealt(asked).mapInArrow(kept, "uid long").unionByName(entries.where("bucket IS NULL").select(F.col("entry").alias("uid")))
    found = rows.where("ms IS NOT NULL").join(uids, "uid").unionByName(rows.where("ms IS NULL").select("uid", *[c for c in rows.columns if c != "uid"]))
    return found.select("track_id", "ms", "silence_ms", "snippet", "src", "seq")


def select_separated(scored: DataFrame, sep_ms: int = 6000, k: int = 3, bucket_ms: int = SPAN_MS) -> DataFrame:
    """C8 for any k: (track_id, mode, duration_s, picks), as by the other form, by rounds.

    In a round every candidate that is the best of those left within sep_ms is chosen at once, and those near it go.
    What ranks behind a track's k-th chosen one goes as well. Each round chooses at least the best that is left of a
    track, so there are k rounds at most, and usually few. A round is one shuffle: a bucket sees 2 * sep_ms on either side
    of it, as far as what is chosen there reaches. Candidates without a place aren't chosen."""
    if bucket_ms < 2 * sep_ms:
        raise ValueError("buckets must be as long as two separations")
    rows = cut(scored.where("ms IS NOT NULL").select("track_id", "mode", "duration_s", "ms", "src", "seq", "silence_ms", "snippet", "score", F.monotonically_increasing_id().alias("uid")))
    order = F.struct((-F.col("score")).alias("neg"), "ms", "src", "seq", "uid").alias("order")
    left = cut(rows.select("track_id", "ms", "uid", order))
    chosen = None
    own = F.expr(f"cast(floor(ms / {bucket_ms}) as long)")
    edge = lambda d: F.expr(f"cast(floor((ms + {d}) / {bucket_ms}) as long)")
    while True:
        placed = left.withColumn("bucket", F.explode(F.array_distinct(F.array(own, edge(2 * sep_ms), edge(-2 * sep_ms)))))
        near = W.partitionBy("track_id", "bucket").orderBy("ms").rangeBetween(1 - sep_ms, sep_ms - 1)
        best = placed.withColumn("best", F.min("order").over(near) == F.col("order"))
        judged = cut(best.withColumn("by", F.max("best").over(near)).where(F.col("bucket") == own).select("track_id", "ms", "uid", "order", "best", "by"))
        found = judged.where("best").select("track_id", "ms", "uid", "order")
        nth = F.row_number().over(by_track("order"))
        kept = cut((found if chosen is None else chosen.unionByName(found)).withColumn("nth", nth).where(F.col("nth") <= k).drop("nth"))
        last = kept.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.max("order").alias("last"))
        rest = cut(judged.where(~F.col("by")).join(last, "track_id", "left").where(F.col("n").isNull() | (F.col("n") < k) | (F.col("order") < F.col("last"))).select("track_id", "ms", "uid", "order"))
        for old in (left, judged, *([chosen] if chosen is not None else [])):
            drop_cut(old)
        left, chosen = rest, kept
        if left.isEmpty():
            break
    pick = F.struct("order", F.struct("ms", "silence_ms", "snippet", "score").alias("pick"))
    listed = rows.join(chosen.select("uid", "order"), "uid").groupBy("track_id").agg(F.first("mode").alias("mode"), F.first("duration_s").alias("duration_s"), F.sort_array(F.collect_list(pick)).alias("picks"))
    return listed.select("track_id", "mode", "duration_s", F.transform("picks", lambda x: x["pick"]).alias("picks"))
