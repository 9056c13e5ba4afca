"""One registered query for each operator, over the derived catalogue tables, with flat result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .sources import files, reports
from .storage import cut, scratch_path
from .fixtures import Catalogue
from .functions import by_track
from .operators import blocks as b
from .operators import candidates as c
from .operators import frames as f
from .operators import products as r
from .operators import scans
from .operators import slots as s
from .operators import speakers as k
from .operators import splice as m
from .operators import sponsors as sp
from .operators import transcript as t


def _joined(items: str | Column) -> Column:
    return F.array_join(items, "|")


def _ms(seconds: str | Column) -> Column:
    return F.round((F.col(seconds) if isinstance(seconds, str) else seconds) * 1000).cast("long")


def _6(col: str) -> Column:
    return F.round(col, 6).alias(col)


def _picks(df: DataFrame) -> DataFrame:
    return df.select("track_id", F.size("picks").alias("n"), _joined(F.transform("picks", lambda p: p["ms"].cast("string"))).alias("ms"), _joined(F.transform("picks", lambda p: F.round(p["score"] * 1000).cast("long").cast("string"))).alias("scores"))


def _details(x: Catalogue) -> DataFrame:
    """Details for the first slot of some tracks: whole, with two pros, and twice for one place."""
    first = x.slots().where("ord = 0").select("track_id", "insertion_ms")
    n = F.col("track_id")
    pros = F.when(n % 2 == 0, F.array(F.lit("p1"), F.lit("p2"), F.lit("p3"))).otherwise(F.array(F.lit("p1"), F.lit("p2")))
    rows = first.where("track_id % 3 <> 2").select("track_id", F.lit(0).alias("pos"), "insertion_ms", pros.alias("pros"), F.array(F.lit("c1"), F.lit("c2")).alias("cons"), F.when(n % 5 == 0, " ").otherwise(F.concat(F.lit(" why "), n.cast("string"))).alias("rationale"))
    again = rows.where("track_id % 4 = 0").select("track_id", F.lit(1).alias("pos"), "insertion_ms", F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("pros"), "cons", "rationale")
    return rows.unionByName(again)


def _report_text(x: Catalogue) -> DataFrame:
    """Report payloads: points as numbers with a list of confidences, or as objects."""
    rows = x.slots().groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("ord", "insertion_ms", "confidence_percent"))).alias("s"))
    numbers = F.concat(F.lit('{"points": ['), F.array_join(F.transform("s", lambda v: v["insertion_ms"].cast("string")), ", "), F.lit(', "x"], "confidences": [80, null]}'))
    objects = F.concat(F.lit('{"points": ['), F.array_join(F.transform("s", lambda v: F.concat(F.lit('{"time": '), v["insertion_ms"].cast("string"), F.lit(', "confidence": '), v["confidence_percent"].cast("string"), F.lit("}"))), ", "), F.lit(', {"time": "7"}]}'))
    return rows.select("track_id", F.when(F.col("track_id") % 2 == 0, numbers).otherwise(objects).alias("payload"))


def _ui(x: Catalogue) -> DataFrame:
    pairs = x.slots().select("track_id", F.col("ord").alias("pos"), F.col("insertion_time_seconds").alias("time"), F.col("confidence_percent").cast("double").alias("confidence"))
    return s.ui_slots(pairs, x.lengths())


def _manual(x: Catalogue) -> DataFrame:
    return x.episodes().where("track_id % 2 = 0").select("track_id", (F.col("track_id") % 4).alias("minutes"), (F.col("track_id") % 60).alias("seconds"))


def _ads(x: Catalogue) -> DataFrame:
    """Two or three ads on every track, two of them at one place on some."""
    base = x.slots().select("track_id", "ord", F.col("insertion_ms").alias("at_ms"), ((F.col("track_id") % 9 + 1) * 1000 + F.col("ord") * 100).alias("ad_ms"))
    first = F.min(F.when(F.col("ord") == 0, F.col("at_ms"))).over(by_track())
    return base.withColumn("at_ms", F.when((F.col("track_id") % 4 == 0) & (F.col("ord") == 1), first).otherwise(F.col("at_ms")))


def _rationale() -> Column:
    """The rationale; but for its number where that stands halfway between two, which engines print apart."""
    return F.when(F.col("insertion_ms") % 100 == 50, F.regexp_replace("rationale", "[0-9]+[.][0-9]s", "#")).otherwise(F.col("rationale")).alias("rationale")


def s1_episodes(x: Catalogue) -> DataFrame:
    return x.episodes().select("track_id", "mode", _ms("duration_s").alias("duration_ms"))


def s2_read_analysis(x: Catalogue) -> DataFrame:
    return sources.read_analysis(x.payloads(), x.lengths())


def s2_scan_payloads(x: Catalogue) -> DataFrame:
    """Files of up to 1 MB: what is read and what is not, with its place; a file by its number."""
    path = scratch_path(x.spark, "payloads")
    x.payload_lines().select("file", F.col("line").alias("value")).write.partitionBy("file").text(path)
    payloads, rejects = files.scan_payloads(x.spark, path, max_bytes=1_000_000, pattern="*.txt")
    number = F.regexp_extract("file", "/file=([0-9]+)/", 1).cast("int").alias("file")
    read = payloads.select(number, "track_id", "line_offset", F.octet_length("payload").cast("long").alias("n_bytes"), F.lit(None).cast("string").alias("reason"))
    return read.unionByName(rejects.select(number, F.lit(None).cast("long").alias("track_id"), "line_offset", "n_bytes", "reason"))


def _report(x: Catalogue) -> DataFrame:
    return sources.slot_report(x.slots(), x.lengths(), sources.analysis_source(x.payloads()), sp.sponsor_statements(x.sponsors()))


def s3_report_sink(x: Catalogue) -> DataFrame:
    """Read back after an older state, with other lengths and without some tracks, and the whole report twice."""
    path, report = scratch_path(x.spark, "report"), x._stored("report", lambda: _report(x))
    older = F.when(F.col("track_id") % 2 == 0, F.col("duration") + 1).otherwise(F.col("duration"))
    for state in (report.where("track_id % 3 <> 0").withColumn("duration", older), report, report):
        reports.write_report(state, path)
    return _told(reports.read_report(x.spark, path))


def s3_slot_report(x: Catalogue) -> DataFrame:
    return _told(_report(x))


def _told(report: DataFrame) -> DataFrame:
    said = lambda c: _joined(F.transform("sponsor_statements", lambda v: v[c]))
    return report.select(
        "track_id", _ms("duration").alias("duration_ms"), "source", F.size("slots").alias("n"), _joined(F.transform("points", lambda p: F.round(p * 1000).cast("long").cast("string"))).alias("points_ms"),
        _joined(F.transform("confidences", lambda p: p.cast("string"))).alias("confidences"), said("id").alias("sponsor_ids"), said("statement").alias("statements"),
    )


def s3_audit_record(x: Catalogue) -> DataFrame:
    contexts = _contexts(x)
    cands = x.silence_cands().where("seq <= 30")
    bounded = c.bound(cands, x.lengths())
    choices = t.parse_choice(x.choice_answers(), x.products())
    chosen = c.apply_choice(c.default_insertion(x.lengths(), bounded), bounded, choices, x.lengths())
    loudness = f.context_loudness(x.frames(), x.frame_slots(), _promo_frames(x), window_ms=1500)
    record = sources.audit_record(chosen, cands, bounded, x.with_tempo(), x.beats(), loudness, contexts, t.prompt_corpus(x.products(), contexts, header="H"), x.choice_answers())
    listed = lambda name: _joined(F.transform(name, lambda v: v.cast("string"))).alias(name)
    return record.select(
        "track_id", "chosen_ms", listed("candidates_ms"), listed("candidates_for_prompt_ms"), "mode", "tempo", listed("beat_times_ms"), "beat_times_count", "chosen_beat_index", _6("target_lufs"), _6("before_lufs"), _6("after_lufs"),
        "min_insert_ms", "end_buffer_ms", "transcript_before", "prompt", "raw_text",
    )


def f1_frame_rms(x: Catalogue) -> DataFrame:
    return f.frame_rms(x.samples(), 5, 2).select("track_id", "frame_idx", _6("rms"))


def f2_quietest(x: Catalogue) -> DataFrame:
    return f.quietest(x.frames().select("track_id", "frame_idx", F.sqrt("ms_power").alias("rms")))


def f3_quiet_threshold(x: Catalogue) -> DataFrame:
    return f.quiet_threshold(x.frames()).select("track_id", _6("threshold_db"))


def _runs(x: Catalogue) -> DataFrame:
    return f.quiet_runs(x.frames(), f.quiet_threshold(x.frames(), below_db=6.0), min_ms=200)


def f5_silence_candidates(x: Catalogue) -> DataFrame:
    return f.silence_candidates(x.silences(), 30)


def f5_distinct_middles(x: Catalogue) -> DataFrame:
    return f.distinct_middles(_runs(x))


def _minima(x: Catalogue) -> DataFrame:
    return f.quietest(x.frames().select("track_id", "frame_idx", F.sqrt("ms_power").alias("rms")), hop=4410)


def f6_snap_to_beat(x: Catalogue) -> DataFrame:
    return f.snap_to_beat(_minima(x), x.beats(), 8)


#: Rows and milliseconds of a bucket in the queries over buckets: few, as the derived tracks are short.
ROWS, SPAN_MS = 8, 1500


def f4_quiet_runs_scan(x: Catalogue) -> DataFrame:
    return scans.quiet_runs(x.frames(), f.quiet_threshold(x.frames(), below_db=6.0), min_ms=200, bucket=ROWS)


def f6_snap_to_beat_scan(x: Catalogue) -> DataFrame:
    return scans.snap_to_beat(_minima(x), x.beats(), 8, bucket_ms=SPAN_MS)


def k2_sample_budget_scan(x: Catalogue) -> DataFrame:
    return scans.sample_budget(k.top_speakers(x.turns()), 30000, bucket=ROWS)


def _promo_frames(x: Catalogue) -> DataFrame:
    return x.promo().select("track_id", F.col("i").alias("frame_idx"), (F.col("i") * 100).alias("t_ms"), (F.col("amp") * F.col("amp")).alias("ms_power"))


def f8_context_loudness(x: Catalogue) -> DataFrame:
    out = f.context_loudness(x.frames(), x.frame_slots().select("track_id", "ms"), _promo_frames(x), window_ms=1500)
    return out.select("track_id", "ms", _6("target_lufs"), _6("before_lufs"), _6("gain_db"), _6("after_lufs"))


def c1_bound(x: Catalogue) -> DataFrame:
    return c.bound(x.silence_cands(), x.lengths()).select("track_id", "seq", "ms")


def c3_apply_choice(x: Catalogue) -> DataFrame:
    cands = c.bound(x.silence_cands(), x.lengths())
    choices = t.parse_choice(x.choice_answers(), x.products())
    return c.apply_choice(c.default_insertion(x.lengths(), cands), cands, choices, x.lengths())


def c4_boundary_candidates(x: Catalogue) -> DataFrame:
    return x.boundaries()


def c11_slot_record(x: Catalogue) -> DataFrame:
    return s.slot_record(c.clamp_dedupe(c.top_up(c.select_separated(x.scored())))).select("track_id", "ord", "insertion_ms", "insertion_time_seconds", "confidence_percent", "band", "label", "silence_ms", "snippet")


def c12_pros_cons(x: Catalogue) -> DataFrame:
    return x.slots().select("track_id", "ord", "insertion_ms", _joined("pros").alias("pros"), _joined("cons").alias("cons"), _rationale())


def c13_override_details(x: Catalogue) -> DataFrame:
    return s.override_details(x.slots(), _details(x)).select("track_id", "ord", "insertion_ms", _joined("pros").alias("pros"), _joined("cons").alias("cons"), _rationale())


def c15_ui_slots(x: Catalogue) -> DataFrame:
    return _ui(x).select("track_id", "id", _6("time"), "confidence")


def c16_add_manual(x: Catalogue) -> DataFrame:
    return s.add_manual(_ui(x), _manual(x), x.lengths()).select("track_id", "pos", "id", _6("time"), "confidence")


def _contexts(x: Catalogue) -> DataFrame:
    said = x.transcripts()
    return t.context_before(x.silence_cands(), said)


def t1_context_before(x: Catalogue) -> DataFrame:
    return _contexts(x).select("track_id", "seq", "ms", "context")


def t2_prompt_corpus(x: Catalogue) -> DataFrame:
    return t.prompt_corpus(x.products(), _contexts(x), header="H")


def _script(x: Catalogue) -> DataFrame:
    return k.script_lines(x.script_answers(), x.products())


def k2_sample_budget(x: Catalogue) -> DataFrame:
    return k.sample_budget(k.top_speakers(x.turns()), 30000)


def k5_resolve_voice(x: Catalogue) -> DataFrame:
    wanted = x.turns().select("track_id", F.col("label").alias("speaker")).distinct().withColumn("explicit", F.when(F.col("track_id") % 4 == 0, F.concat(F.lit("v"), F.col("track_id").cast("string"))))
    settings = wanted.select("speaker").distinct().where("speaker = 'user'").select("speaker", F.concat(F.lit("voice-"), "speaker").alias("voice"))
    clones = wanted.where("track_id % 3 = 0").select("track_id", "speaker", F.concat(F.lit("clone-"), "speaker").alias("voice"))
    return k.resolve_voice(wanted, settings, clones)


def _statements(x: Catalogue) -> DataFrame:
    n = F.col("p_partkey")
    value = F.when(n % 4 == 0, F.concat(F.lit('[" '), "p_name", F.lit(' ", "", null, 7]'))).when(n % 4 == 1, F.concat(F.lit("  "), "p_name", F.lit(" "))).when(n % 4 == 2, "  ").otherwise(F.concat(F.lit("["), "p_name"))
    return sp.normalize_statements(x._table("part").select(n.alias("track_id"), value.alias("value")))


def k7_normalize_statements(x: Catalogue) -> DataFrame:
    return _statements(x).select("track_id", F.size("statements").alias("n"), _joined("statements").alias("statements"))


def k9_assign_sponsors(x: Catalogue) -> DataFrame:
    sponsors = sp.sponsor_statements(x.sponsors())
    slots = _ui(x).select("track_id", F.col("time").alias("pos"), "id")
    previous = sponsors.where("track_id % 2 = 0 AND ord = 2").select("track_id", F.lit("slot-1").alias("slot_id"), F.col("id").alias("sponsor_id"))
    gone = sponsors.where("ord = 0").select("track_id", F.lit("slot-2").alias("slot_id"), F.lit("gone").alias("sponsor_id"))
    return sp.assign_sponsors(slots, sponsors, previous.unionByName(gone))


def _m1(x: Catalogue) -> DataFrame:
    return _ads(x).join(x.lengths(), "track_id").select("track_id", F.col("ord").alias("slot"), F.col("at_ms").cast("long").alias("at_ms"), "duration_ms", "ad_ms")


def m3_overlay_gain(x: Catalogue) -> DataFrame:
    return m.overlay_gain(x.frames(), x.promo(), x.frame_slots().select("track_id", "at"), duck_db=6.0).select("track_id", "out_idx", _6("amp"))


def _audited(x: Catalogue) -> DataFrame:
    plan = x.lengths().select("track_id", (F.col("duration_s") / 2).alias("at_s"), "duration_s", F.lit(2.0).alias("ad_s"))
    actual = x.lengths().where("track_id % 5 <> 1").select("track_id", (F.col("duration_s") + 2 + F.when(F.col("track_id") % 3 == 0, 0.25).otherwise(0.05)).alias("actual_s"))
    return m.audit(plan, actual)


def m4_audit(x: Catalogue) -> DataFrame:
    return _audited(x).select("track_id", _6("expected_s"), _6("actual_s"), "match")


def m4_audit_preview(x: Catalogue) -> DataFrame:
    """Slots in the middle, or at 5 s where the length is unknown; previews of 3 s on both sides that were cut to 8 s."""
    plan = x.lengths().select("track_id", F.coalesce(F.col("duration_s") / 2, F.lit(5.0)).alias("at_s"), "duration_s", F.lit(2.0).alias("ad_s"))
    actual = x.lengths().where("track_id % 5 <> 1").select("track_id", (F.lit(8.0) + F.when(F.col("track_id") % 3 == 0, 0.25).otherwise(0.05)).alias("actual_s"))
    return m.audit(plan, actual, preview_s=3.0).select("track_id", _6("expected_s"), _6("actual_s"), "match")


def m5_room_tone_bed(x: Catalogue) -> DataFrame:
    return m.room_tone_bed(x.frames(), x.promo(), x.frame_slots()).select("track_id", "i", _6("amp"))


def m5_room_tone_two_speakers(x: Catalogue) -> DataFrame:
    return m.room_tone_bed(x.frames(), x.promo(), x.frame_slots(), podcasts_only=False).select("track_id", "i", _6("amp"))


#: Samples of a block in the queries over blocks: few, as the derived tracks are short.
BLOCK = 16


def _blocks(samples: DataFrame, *key: str) -> DataFrame:
    return b.pack(samples, BLOCK, ("track_id", *key))


def f1_frame_rms_blocks(x: Catalogue) -> DataFrame:
    return b.unpack(b.frame_rms(_blocks(x.samples()), 5, 2, BLOCK), "first", "rms", "frame_idx", "rms").select("track_id", "frame_idx", _6("rms"))


def f7_peak_envelope_blocks(x: Catalogue) -> DataFrame:
    return b.peak_envelope(_blocks(x.samples()), 10, BLOCK).select("track_id", F.posexplode("peaks").alias("block", "peak")).withColumn("block", F.col("block").cast("long"))


def f8_weighted_loudness(x: Catalogue) -> DataFrame:
    """Two channels at 8,000 samples a second, in frames of 5 samples, from 33 samples before a slot on."""
    of = lambda samples: _blocks(x.stereo(samples), "channel")
    out = b.context_loudness(of(x.samples()), x.frame_slots().select("track_id", "at"), of(x.promo()), rate=8000, window=33, frame=5, size=BLOCK)
    return out.select("track_id", "at", _6("target_lufs"), _6("before_lufs"), _6("gain_db"), _6("after_lufs"))


def m3_overlay_gain_blocks(x: Catalogue) -> DataFrame:
    x.store_frames()
    mix = b.overlay_gain(cut(_blocks(x.samples())), cut(_blocks(x.promo())), x.frame_slots(), duck_db=6.0, crossfade=2, fade=2, duck_ramp=1, size=BLOCK)
    return b.unpack(mix, "start", "amps", "out_idx", "amp").select("track_id", "out_idx", _6("amp"))


def m5_room_tone_bed_blocks(x: Catalogue) -> DataFrame:
    bed = b.room_tone_bed(_blocks(x.samples()), _blocks(x.promo()), x.frame_slots(), tone=6, size=BLOCK)
    return b.unpack(bed, "start", "amps", "i", "amp").select("track_id", "i", _6("amp"))


OVER_CATALOGUE: dict[str, Callable[[Catalogue], DataFrame]] = {
    "s1_episodes": s1_episodes,
    "s2_read_analysis": s2_read_analysis,
    "s2_scan_payloads": s2_scan_payloads,
    "s3_slot_report": s3_slot_report,
    "s3_report_sink": s3_report_sink,
    "s3_audit_record": s3_audit_record,
    "f1_frame_rms": f1_frame_rms,
    "f1_frame_rms_blocks": f1_frame_rms_blocks,
    "f2_quietest": f2_quietest,
    "f3_quiet_threshold": f3_quiet_threshold,
    "f4_quiet_runs": _runs,
    "f4_quiet_runs_scan": f4_quiet_runs_scan,
    "f5_silence_candidates": f5_silence_candidates,
    "f5_distinct_middles": f5_distinct_middles,
    "f6_snap_to_beat": f6_snap_to_beat,
    "f6_snap_to_beat_scan": f6_snap_to_beat_scan,
    "f7_peak_envelope": lambda x: f.peak_envelope(x.samples(), 10),
    "f7_peak_envelope_blocks": f7_peak_envelope_blocks,
    "f8_context_loudness": f8_context_loudness,
    "f8_weighted_loudness": f8_weighted_loudness,
    "c1_bound": c1_bound,
    "c2_default_insertion": lambda x: c.default_insertion(x.lengths(), c.bound(x.silence_cands(), x.lengths())),
    "c3_apply_choice": c3_apply_choice,
    "c4_boundary_candidates": c4_boundary_candidates,
    "c5_collapse_near": lambda x: x.merged(),
    "c5_collapse_near_scan": lambda x: scans.collapse_near(x.silence_cands(), x.boundaries(), bucket_ms=20 * SPAN_MS),
    "c6_fill_empty": lambda x: c.fill_empty(x.episodes(), x.merged()),
    "c7_score": lambda x: x.scored().select("track_id", "ms", "src", "seq", F.round(F.col("score") * 10000).cast("long").alias("score")),
    "c8_select_separated": lambda x: _picks(c.select_separated(x.scored())),
    "c8_select_separated_rounds": lambda x: _picks(scans.select_separated(x.scored(), bucket_ms=20 * SPAN_MS)),
    "c9_top_up": lambda x: _picks(c.top_up(c.select_separated(x.scored()))),
    "c10_clamp_dedupe": lambda x: c.clamp_dedupe(c.top_up(c.select_separated(x.scored()))).select("track_id", "ord", "ms"),
    "c11_slot_record": c11_slot_record,
    "c12_pros_cons": c12_pros_cons,
    "c13_override_details": c13_override_details,
    "c14_pair_suggestions": lambda x: s.pair_suggestions(_report_text(x)),
    "c15_ui_slots": c15_ui_slots,
    "c16_add_manual": c16_add_manual,
    "t1_context_before": t1_context_before,
    "t2_prompt_corpus": t2_prompt_corpus,
    "t2_script_prompts": lambda x: t.script_prompts(x.products(), header="H"),
    "t3_transcript_rollup": lambda x: t.transcript_rollup(x.segments()),
    "t3_transcript_rollup_scan": lambda x: scans.transcript_rollup(x.segments(), bucket=ROWS),
    "t4_parse_choice": lambda x: t.parse_choice(x.choice_answers(), x.products()),
    "k1_top_speakers": lambda x: k.top_speakers(x.turns()),
    "k2_sample_budget": k2_sample_budget,
    "k2_sample_budget_scan": k2_sample_budget_scan,
    "k3_script_lines": _script,
    "k4_lines_for_mode": lambda x: k.lines_for_mode(_script(x), x.products()),
    "k5_resolve_voice": k5_resolve_voice,
    "k6_block_layout": lambda x: k.block_layout(x.ad_parts()),
    "k7_normalize_statements": k7_normalize_statements,
    "k8_sponsor_statements": lambda x: sp.sponsor_statements(x.sponsors()),
    "k8_listed_statements": lambda x: sp.listed_statements(_statements(x)),
    "k9_assign_sponsors": k9_assign_sponsors,
    "m1_splice_pieces": lambda x: m.splice_pieces(_m1(x)),
    "m1_splice_preview": lambda x: m.splice_pieces(_m1(x), 3000),
    "m2_timeline": lambda x: m.timeline(_ads(x), x.lengths()),
    "m2_timeline_scan": lambda x: scans.timeline(_ads(x), x.lengths(), bucket_ms=20 * SPAN_MS),
    "m3_overlay_gain": m3_overlay_gain,
    "m3_overlay_gain_blocks": m3_overlay_gain_blocks,
    "m4_audit": m4_audit,
    "m4_audit_preview": m4_audit_preview,
    "m4_audit_summary": lambda x: m.audit_summary(_audited(x)).select("match", "n", _6("worst_s")),
    "m5_room_tone_bed": m5_room_tone_bed,
    "m5_room_tone_bed_blocks": m5_room_tone_bed_blocks,
    "m5_room_tone_two_speakers": m5_room_tone_two_speakers,
    "r1_extract_terms": lambda x: r.extract_terms(x.term_answers()),
    "r2_match_products": lambda x: r.match_products(r.extract_terms(x.term_answers()), x.catalogue()),
    "r2_match_long_titles": lambda x: r.match_products(x.long_terms(), x.long_titles()),
}


def _query(over: Callable[[Catalogue], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: over(Catalogue(spark, sf_dir))


QUERIES = {name: _query(over) for name, over in OVER_CATALOGUE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best separated slots of every track, with their explanations."""
    return Catalogue(spark, sf_dir).slots()
