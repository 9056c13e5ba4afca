"""Hand-made cases: ties, empty tracks, unknown lengths, junk, and random trials against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from adslots import sources
from adslots.functions import UNAVAILABLE, ends_sentence, unfenced
from adslots.operators import candidates as c
from adslots.operators import frames as f
from adslots.operators import products as r
from adslots.operators import slots as s
from adslots.operators import speakers as k
from adslots.operators import splice as m
from adslots.operators import sponsors as sp
from adslots.operators import transcript as t

CAND = "track_id long, seq int, ms long, silence_ms long, snippet string"
EPISODE = "track_id long, mode string, duration_s double"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_durations(spark):
    raw = spark.createDataFrame(
        [(1, " Song ", 12.5, 9000), (2, "x", float("nan"), 9000), (3, None, -1.0, 0), (4, "podcast", None, None), (5, "song", float("inf"), 4000)],
        "track_id long, mode string, probe_s double, analysis_ms long",
    )
    assert rows(sources.episodes(raw), "track_id") == [(1, "song", 12.5), (2, "podcast", 9.0), (3, "podcast", None), (4, "podcast", None), (5, "song", 4.0)]


def test_payload_keeps_good_elements(spark):
    payloads = spark.createDataFrame(
        [(1, '{"candidates": [{"mid_ms": "1000", "silence_ms": "x"}, {"ms": -5}, 7, {"time_ms": 2000.5, "silence_ms": 300}, {"mid_ms": 99000}], "snippets": {"1000": " hi. "}}'), (2, "{oops"), (3, None)],
        "track_id long, payload string",
    )
    lengths = spark.createDataFrame([(1, 50.0)], "track_id long, duration_s double")
    out = sources.read_analysis(payloads, lengths).select("track_id", "seq", "ms", "silence_ms", "snippet", "source")
    got = {r[:3] + (r[3], r[4], r[5]) for r in rows(out)}
    assert (1, 0, 1000, 0, "hi.", "heuristic") in got and (1, 3, 2001, 300, "", "heuristic") in got
    assert {g[0] for g in got if g[5] == "fallback"} == {2, 3}
    assert not any(g[2] == 99000 for g in got)


def test_sentence_ends(spark):
    texts = ["End.", 'Said "so."', "no", "What?) ", "comma,", "", None, "x.y"]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(ends_sentence(F.col("t")))
    assert [r[0] for r in df.collect()] == [True, True, False, True, False, False, False, False]


@pytest.mark.parametrize("n,frame,hop", [(23, 5, 2), (4, 5, 2), (12, 4, 2), (30, 7, 3)])
def test_frames_equal_direct_framing(spark, n, frame, hop):
    rng = random.Random(n)
    x = [rng.randint(-9, 9) for _ in range(n)]
    samples = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "track_id long, i long, amp double")
    got = rows(f.frame_rms(samples, frame, hop), "frame_idx")
    if n < frame:
        assert got == [(1, 0, None)]
        return
    want = [(sum(v * v for v in x[a : a + frame]) / frame) ** 0.5 for a in range(0, n - frame + 1, hop)]
    assert [r[1] for r in got] == list(range(len(want)))
    assert [r[2] for r in got] == pytest.approx(want)


def test_silent_track_has_floor_and_runs(spark):
    frames = spark.createDataFrame([(1, i, i * 100, 0.0) for i in range(8)], "track_id long, frame_idx long, t_ms long, ms_power double")
    thr = f.quiet_threshold(frames)
    assert rows(thr) == [(1, -40.0)]
    assert rows(f.quiet_runs(frames, thr)) == [(1, 0, 800)]


def test_nearest_beat_tie_goes_to_the_earlier(spark):
    minima = spark.createDataFrame([(1, 1, 150), (1, 2, 140), (1, 3, 390), (2, 1, 5), (2, 2, 5)], "track_id long, rank int, ms long")
    beats = spark.createDataFrame([(1, 100), (1, 200), (1, 400)], "track_id long, beat_ms long")
    assert rows(f.snap_to_beat(minima, beats), "track_id", "seq") == [(1, 1, 100), (1, 2, 400), (2, 1, 5)]


def test_bound_keeps_all_if_none_fits(spark):
    cands = spark.createDataFrame([(1, 1, 1000, 0, ""), (1, 2, 40000, 0, ""), (2, 1, 1000, 0, ""), (3, 1, 5, 0, "")], CAND)
    lengths = spark.createDataFrame([(1, 90000), (2, 90000), (3, 0)], "track_id long, duration_ms long")
    assert rows(c.bound(cands, lengths).select("track_id", "ms"), "track_id", "ms") == [(1, 40000), (2, 1000), (3, 5)]


def _fold(items):
    out = []
    for x in items:
        if not out or x[0] - out[-1][0] > 400:
            out.append(x)
        elif x[3] > out[-1][3] or (x[4] and not out[-1][4]):
            out[-1] = x
    return out


def test_collapse_equals_the_plain_fold(spark):
    rng = random.Random(3)
    base, extra, want = [], [], []
    for track in range(60):
        items = []
        for src, out in ((0, base), (1, extra)):
            for seq in range(rng.randint(0, 14)):
                ms, sil, text = rng.randint(0, 30) * 100, rng.choice([0, 300, 700]), rng.choice(["", "a.", "b"])
                out.append((track, seq, ms, sil, text))
                items.append((ms, src, seq, sil, text.endswith(".")))
        want += [(track, *x[:3]) for x in _fold(sorted(items))]
    out = c.collapse_near(spark.createDataFrame(base, CAND), spark.createDataFrame(extra, CAND))
    assert sorted(rows(out.select("track_id", "ms", "src", "seq"))) == sorted(want)


def test_collapse_of_one_long_island(spark, monkeypatch):
    """1,500 candidates without a step over the gap, folded in pieces of 7."""
    monkeypatch.setattr(c, "FOLD", 7)
    rng = random.Random(8)
    items, at = [], 0
    for seq in range(1500):
        at += rng.choice([50, 150, 300, 400])
        items.append((1, seq, at, rng.choice([0, 300, 700]), rng.choice(["", "a.", "b"])))
    want = _fold([(ms, 0, seq, sil, text.endswith(".")) for _, seq, ms, sil, text in items])
    out = c.collapse_near(spark.createDataFrame(items, CAND), spark.createDataFrame([], CAND))
    assert sorted(r[0] for r in out.select("seq").collect()) == [w[2] for w in want]


def test_empty_tracks_are_filled_and_others_kept(spark):
    episodes = spark.createDataFrame([(1, "podcast", 10.0), (2, "podcast", None), (3, "song", 8.0)], EPISODE)
    cands = spark.createDataFrame([(1, 500, 0, "x", 0, 4), (9, 700, 0, "y", 1, 5)], "track_id long, ms long, silence_ms long, snippet string, src int, seq int")
    got = rows(c.fill_empty(episodes, cands).select("track_id", "ms", "src", "seq"), "track_id", "ms")
    assert got == [(1, 500, 0, 4), (2, 12000, 2, 0), (2, 24000, 2, 1), (2, 36000, 2, 2), (3, 2000, 2, 0), (3, 4000, 2, 1), (3, 6000, 2, 2), (9, 700, 1, 5)]


def test_score_treats_both_missing_marks_alike(spark):
    cands = spark.createDataFrame([(1, i, 50000, 0, x) for i, x in enumerate(["", UNAVAILABLE, None, "said.", "said"])], CAND)
    eps = spark.createDataFrame([(1, "podcast", 100.0)], EPISODE)
    got = [round(r[0], 6) for r in c.score(cands, eps).orderBy("seq").select("score").collect()]
    assert got == [0.5, 0.5, 0.5, 0.8, 0.3]


def test_picks_are_separated_and_filled(spark):
    rng = random.Random(5)
    eps = [(i, "podcast", rng.choice([None, 3.0, 30.0, 120.0])) for i in range(40)]
    cands = [(i, n, rng.randint(0, 40) * 1000, rng.choice([0, 500, 900]), "") for i, _, _ in eps for n in range(rng.randint(0, 12))]
    episodes = spark.createDataFrame(eps, EPISODE)
    filled = c.fill_empty(episodes, spark.createDataFrame(cands, CAND).withColumn("src", F.lit(0)).select("track_id", "ms", "silence_ms", "snippet", "src", "seq"))
    chosen = c.select_separated(c.score(filled, episodes))
    for r in chosen.collect():
        ms = [p["ms"] for p in r["picks"]]
        assert all(abs(a - b) >= 6000 for i, a in enumerate(ms) for b in ms[:i])
    topped = c.top_up(chosen)
    assert all(len(r["picks"]) == 3 for r in topped.collect())
    for r in c.clamp_dedupe(topped).collect():
        assert r["duration_s"] is None or r["ms"] <= max(0, round(r["duration_s"] * 1000) - 200)


def test_details_replace_only_whole_parts(spark):
    slots = spark.createDataFrame([(1, 0, 5000, ["a", "b", "c"], ["d", "e"], "r")], "track_id long, ord int, insertion_ms long, pros array<string>, cons array<string>, rationale string")
    details = spark.createDataFrame([(1, 1, 5000, ["x", "y", "z"], ["u", "v"], "late"), (1, 0, 5000, ["x", "y"], ["u", "v"], " ")], "track_id long, pos int, insertion_ms long, pros array<string>, cons array<string>, rationale string")
    out = s.override_details(slots, details).select("pros", "cons", "rationale").first()
    assert tuple(out) == (["a", "b", "c"], ["u", "v"], "r")


def test_manual_slot_gets_a_free_id_and_is_refused_past_the_end(spark):
    slots = spark.createDataFrame([(1, "slot-1", 5.0, 90.0), (1, "slot-3", 9.0, 80.0), (2, "slot-1", 5.0, 90.0)], "track_id long, id string, time double, confidence double")
    manual = spark.createDataFrame([(1, 0, 7), (2, 9, 0)], "track_id long, minutes int, seconds int")
    lengths = spark.createDataFrame([(1, 60.0), (2, 60.0)], "track_id long, duration_s double")
    out = rows(s.add_manual(slots, manual, lengths).select("track_id", "pos", "id"), "track_id", "pos")
    assert out == [(1, 1, "slot-1"), (1, 2, "slot-4"), (1, 3, "slot-3"), (2, 1, "slot-1")]


def test_answers_are_read_leniently(spark):
    raw = ['```json\n{"promo_text": " p ", "chosen_index": 2}\n```', 'Well: {"chosen_index": 1.5, "rationale": "r"} ok', "nothing", None]
    responses = spark.createDataFrame(list(enumerate(raw)), "track_id long, raw_text string")
    products = spark.createDataFrame([(i, "name") for i in range(4)], "track_id long, name string")
    got = rows(t.parse_choice(responses, products), "track_id")
    assert [g[1] for g in got] == ["p", "name", "name", "name"]
    assert [g[2] for g in got] == [2, None, None, None]
    assert got[1][3] == "r" and got[2][3] == t.BROKEN


def test_unfenced_answers(spark):
    texts = ['```json\n{"a": 1}\n```', "```\n{}\n```  ", "well {x} and {y} end", "{open", "none", "", None, "``` {z} ```", '```\nso {"k": "}"} it is\n```', "} {"]
    out = spark.createDataFrame([(x,) for x in texts], "t string").select(unfenced(F.col("t")))
    assert [r[0] for r in out.collect()] == ['{"a": 1}', "{}", "{x} and {y}", "{open", "none", "", None, "{z}", '{"k": "}"}', "} {"]


def test_matches_equal_brute_force(spark):
    """Frequent words, ties, equal titles, and texts of more words than sets are made of."""
    rng = random.Random(21)
    word = lambda: rng.choice("red red red blue blue green lime navy pink".split())
    titles = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 9])))) for i in range(120)]
    asked = [(i, 1, " ".join(word() for _ in range(rng.choice([1, 2, 4, 12])))) for i in range(25)] + [(99, 1, "nothing"), (98, 1, "a b c d e f g red")]
    many = "a b c d e f g h i".split()
    titles += [(200 + i, " ".join(rng.sample(many, 8))) for i in range(5)]
    want = set()
    for i, o, term in asked:
        ranked = sorted((-len(set(term.split()) & set(t.split())), key, t) for key, t in titles)
        want |= {(i, o, term, n, key, t) for n, (k_, key, t) in enumerate(ranked[:3], 1) if k_ < 0}
    out = r.match_products(spark.createDataFrame(asked, "track_id long, ord int, term string"), spark.createDataFrame(titles, "key long, title string"))
    assert {tuple(x) for x in out.select("track_id", "ord", "term", "rank", "key", "title").collect()} == want


def test_long_titles_near_k_pairs_a_term(spark):
    """200 terms and 4,000 titles of eight words, all with one word in common: equal to brute force, without all pairs."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    titles = [(i, " ".join(["all", *rng.sample(words, 7)])) for i in range(4000)]
    asked = [(i, 1, " ".join(["all", *rng.sample(words, rng.choice([1, 2, 4, 7, 11]))])) for i in range(200)]
    want = set()
    for i, o, term in asked:
        ranked = sorted((-len(set(term.split()) & set(t.split())), key, t) for key, t in titles)
        want |= {(i, o, term, n, key, t) for n, (k_, key, t) in enumerate(ranked[:3], 1) if k_ < 0}
    out = r.match_products(spark.createDataFrame(asked, "track_id long, ord int, term string"), spark.createDataFrame(titles, "key long, title string"))
    assert {tuple(x) for x in out.select("track_id", "ord", "term", "rank", "key", "title").collect()} == want
    h = spark.createDataFrame([(i, t, t.split()) for i, t in titles], "key long, title string, hs array<string>")
    kept = r._by_set(h, spark.createDataFrame([(" all",), (" w1",), (" w1 w2",)], "s string"), 2, 3)
    assert kept.count() <= 9


def _matched(asked, titles, k=3):
    """By brute force: the k products that share most words with a term."""
    want = set()
    for i, o, term in asked:
        ranked = sorted((-len(set(term.split()) & set(t.split())), key, t) for key, t in titles)
        want |= {(i, o, term, n, key, t) for n, (c, key, t) in enumerate(ranked[:k], 1) if c < 0}
    return want


def test_long_terms_of_frequent_words_meet_few_products(spark, monkeypatch):
    """Terms of 9 to 16 words that a twelfth of all titles hold at least: equal to brute force, and terms of up to 12 words
    aren't met by word, as which they would meet most titles each."""
    rng = random.Random(4)
    titles = [(i, " ".join(["all", *(f"{c}{rng.randrange(n)}" for c, n in zip("abcdefgh", (2, 2, 3, 4, 5, 7, 11, 12)))])) for i in range(2000)]
    text = lambda i: " ".join(["all", "b0", "b1", "c0", *(f"{c}{rng.randrange(n)}" for c, n in zip("adefgh", (2, 4, 5, 7, 11, 12)))][: rng.choice([1, 3, 9, 10])])
    asked = [(i, 1, text(i)) for i in range(40)]
    more = [(100, 1, " ".join(f"{c}{n}" for c in "abcd" for n in range(2)) + " h1 h2 h3 g1 g2 g3 g4 f5")]
    met = []
    monkeypatch.setattr(r, "_longest", lambda t, h, k, f=r._longest: met.append(t.count()) or f(t, h, k))
    for terms in (asked, more):
        out = r.match_products(spark.createDataFrame(terms, "track_id long, ord int, term string"), spark.createDataFrame(titles, "key long, title string"))
        assert {tuple(x) for x in out.select("track_id", "ord", "term", "rank", "key", "title").collect()} == _matched(terms, titles)
        assert met == [] or terms is more
    assert met == [1]


def test_two_top_speakers(spark):
    turns = [(1, 0, "x", 0, 100), (1, 1, "y", 100, 300), (1, 2, "z", 300, 310), (1, 3, "x", 310, 410), (1, 4, "y", 410, 410)]
    out = k.top_speakers(spark.createDataFrame(turns, "track_id long, turn_idx int, label string, start_ms long, end_ms long"))
    assert rows(out.select("turn_idx", "speaker"), "turn_idx") == [(0, "A"), (1, "B"), (3, "A")]


def test_script_lines_keep_good_ones(spark):
    products = spark.createDataFrame([(1, "N", "b", "DUO"), (2, "N", "b", "B_ONLY")], "track_id long, name string, blurb string, ad_mode string")
    answers = spark.createDataFrame([(1, '{"segments": [5, {"speaker": " b", "text": " hey "}, {"speaker": "C", "text": "x"}]}'), (2, "?")], "track_id long, raw_text string")
    lines = k.script_lines(answers, products)
    assert rows(lines, "track_id", "line_idx") == [(1, 1, "B", "hey"), (2, 0, "B", "N b")]
    final = rows(k.lines_for_mode(lines, products), "track_id", "line_idx")
    assert final == [(1, 0, "A", "Quick shout-out to N."), (1, 1, "B", "b"), (2, 0, "B", "N b")]


def test_statements(spark):
    raw = spark.createDataFrame([(1, '[" a ", "", null, 3]'), (2, " one "), (3, "  "), (4, None), (5, "[broken")], "track_id long, value string")
    assert [r[1] for r in rows(sp.normalize_statements(raw), "track_id")] == [["a", "3"], ["one"], [], [], ["[broken"]]


def test_splice_lengths_of_the_fixture_rows(spark):
    """A 10 s programme, a 2 s ad; and parts of 1.2 s and 1.0 s with a pause, previewed at 3 s."""
    parts = spark.createDataFrame([(1, 0, 1200), (1, 1, 1000)], "track_id long, line_idx int, dur_ms long")
    assert k.block_layout(parts, pause_ms=150).first()["total_ms"] == 2350
    slot = spark.createDataFrame([(1, 0, 5000, 10000, 2350)], "track_id long, slot int, at_ms long, duration_ms long, ad_ms long")
    length = lambda df: sum(r["src_end_ms"] - r["src_start_ms"] for r in df.collect())
    assert length(m.splice_pieces(slot)) == 12350
    assert length(m.splice_pieces(slot, 3000)) == 8350
    assert length(m.splice_pieces(slot.withColumn("ad_ms", F.lit(2000).cast("long")))) == 12000


def test_timeline_is_gapless_and_as_long_as_its_parts(spark):
    ads = spark.createDataFrame([(1, 0, 5000, 1000), (1, 1, 5000, 700), (1, 2, 8000, 300)], "track_id long, ord int, at_ms long, ad_ms long")
    out = m.timeline(ads, spark.createDataFrame([(1, 10000)], "track_id long, duration_ms long")).orderBy("ord").collect()
    at = 0
    for r in out:
        assert r["out_start_ms"] == at
        at += r["src_end_ms"] - r["src_start_ms"]
    assert at == 12000
    assert [r["src_end_ms"] for r in out if r["kind"] == "ad"] == [700, 1000, 300]  # set in later, comes first


def test_overlay_without_ramps_is_a_sum(spark):
    frames = spark.createDataFrame([(1, i, 1.0) for i in range(10)], "track_id long, frame_idx long, amp double")
    promo = spark.createDataFrame([(1, i, 2.0) for i in range(4)], "track_id long, i long, amp double")
    slots = spark.createDataFrame([(1, 3)], "track_id long, at long")
    out = [r[0] for r in m.overlay_gain(frames, promo, slots, crossfade=0, fade=0).orderBy("out_idx").select("amp").collect()]
    assert out == [1.0] * 3 + [3.0] * 4 + [1.0] * 3
    assert m.overlay_gain(frames, promo, slots, crossfade=2).count() == 10 - 4


def test_tracks_without_an_ad_stay(spark):
    frames = spark.createDataFrame([(t_, i, 1.0) for t_ in (1, 2) for i in range(5)], "track_id long, frame_idx long, amp double")
    promo = spark.createDataFrame([(1, i, 2.0) for i in range(9)], "track_id long, i long, amp double")  # longer than the rest
    slots = spark.createDataFrame([(1, 2), (2, 2)], "track_id long, at long")
    out = rows(m.overlay_gain(frames, promo, slots, crossfade=0, fade=0), "track_id", "out_idx")
    assert out == [(1, 0, 1.0), (1, 1, 1.0), (1, 2, 3.0), (1, 3, 3.0), (1, 4, 3.0), (2, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0), (2, 3, 1.0), (2, 4, 1.0)]


def test_room_tone_is_for_podcasts_unless_two_speak(spark):
    frames = spark.createDataFrame([(t_, i, 4.0) for t_ in (1, 2) for i in range(5)], "track_id long, frame_idx long, amp double")
    promo = spark.createDataFrame([(t_, i, 1.0) for t_ in (1, 2) for i in range(2)], "track_id long, i long, amp double")
    slots = spark.createDataFrame([(1, "podcast", 3), (2, "song", 3)], "track_id long, mode string, at long")
    one = {(r_["track_id"], r_["amp"]) for r_ in m.room_tone_bed(frames, promo, slots, gain_db=0.0).collect()}
    two = {(r_["track_id"], r_["amp"]) for r_ in m.room_tone_bed(frames, promo, slots, gain_db=0.0, podcasts_only=False).collect()}
    assert one == {(1, 5.0), (2, 1.0)} and two == {(1, 5.0), (2, 5.0)}


def test_loudness_is_measured_again_after_the_gain(spark):
    """An ad with a quiet half under the gate: its gain lifts that half over the gate, so the loudness after isn't the
    target."""
    frame = "track_id long, frame_idx long, t_ms long, ms_power double"
    frames = spark.createDataFrame([(1, i, i * 100, 1.0) for i in range(40)], frame)
    ads = spark.createDataFrame([(1, i, i * 100, 1e-6 if i < 20 else 0.9e-7) for i in range(40)] + [(2, 0, 0, 1.0)], frame)
    slots = spark.createDataFrame([(1, 2000), (2, 50)], "track_id long, ms long")
    out = {r_["track_id"]: r_ for r_ in f.context_loudness(frames, slots, ads).collect()}
    assert out[1]["target_lufs"] == pytest.approx(-0.691) and out[1]["gain_db"] == pytest.approx(out[1]["target_lufs"] - out[1]["before_lufs"])
    assert out[1]["after_lufs"] < out[1]["target_lufs"] - 0.5
    assert out[2]["target_lufs"] == out[2]["before_lufs"] == out[2]["after_lufs"] == -70 and out[2]["gain_db"] == 0


def test_report_and_audit_of_a_bare_track(spark):
    chosen = spark.createDataFrame([(1, 30000), (2, 500)], "track_id long, chosen_ms long")
    cands = spark.createDataFrame([(2, 1, 900), (2, 0, 500)], "track_id long, seq int, ms long")
    beats = spark.createDataFrame([(2, 100), (2, 500), (1, 7)], "track_id long, beat_ms long")
    loud = spark.createDataFrame([(2, -20.0, -30.0, -20.0)], "track_id long, target_lufs double, before_lufs double, after_lufs double")
    contexts = spark.createDataFrame([(2, 500, "said"), (1, 30000, "")], "track_id long, ms long, context string")
    prompts = spark.createDataFrame([(2, "p" * 900)], "track_id long, prompt string")
    answers = spark.createDataFrame([(2, "raw")], "track_id long, raw_text string")
    out = {x["track_id"]: x for x in sources.audit_record(chosen, cands, cands.where("seq = 0"), spark.createDataFrame([(2, "song", 9.0)], EPISODE), beats, loud, contexts, prompts, answers).collect()}
    assert (out[2]["candidates_ms"], out[2]["candidates_for_prompt_ms"], out[2]["chosen_beat_index"], out[2]["beat_times_count"]) == ([500, 900], [500], 1, 2)
    assert out[2]["transcript_before"] == "said" and len(out[2]["prompt"]) == 500 and out[2]["raw_text"] == "raw" and out[2]["mode"] == "song"
    assert (out[1]["candidates_ms"], out[1]["chosen_beat_index"], out[1]["beat_times_count"], out[1]["transcript_before"]) == ([], None, 1, UNAVAILABLE)


def test_catalogue_reads_its_documents_once(spark, small, monkeypatch):
    """Segments, episodes and slots are stored: what is built on them doesn't read the documents again."""
    from adslots import fixtures, queries

    for name in ("s3_slot_report", "c13_override_details", "c16_add_manual", "k9_assign_sponsors", "m2_timeline"):
        read, plain = [], fixtures.table
        monkeypatch.setattr(fixtures, "table", lambda spark_, d, t_: read.append(t_) or plain(spark_, d, t_))
        queries.QUERIES[name](spark, small)
        assert read.count("documents") == 1
        monkeypatch.setattr(fixtures, "table", plain)


def test_audit(spark):
    plan = spark.createDataFrame([(1, 5.0, 10.0, 2.0), (2, 5.0, None, 2.0), (3, 5.0, 10.0, 2.0)], "track_id long, at_s double, duration_s double, ad_s double")
    actual = spark.createDataFrame([(1, 12.05), (2, 1.0), (3, 22.0)], "track_id long, actual_s double")
    assert [r[3] for r in rows(m.audit(plan, actual), "track_id")] == ["true", "unknown", "false"]
    assert m.audit(plan, actual, preview_s=3.0).where("track_id = 1").first()["expected_s"] == 8.0


def test_plans_shuffle_once_for_the_choice(spark):
    cands = spark.createDataFrame([(1, 0, 1000, 0, "")], CAND).withColumn("src", F.lit(0))
    eps = spark.createDataFrame([(1, "song", 9.0)], EPISODE).hint("merge")
    plan = c.select_separated(c.score(cands, eps))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\(track_id", plan)) <= 2
