"""DuckDB SQL for the registered queries, on the same general tables. Written apart from the DataFrame code:
recursive or joined forms where that uses windows or folds."""

from __future__ import annotations

import re

from .operators.blocks import HIGH_PASS, SHELF, high_pass, shelf

(_B, _A), (_D, _E) = ([[float(v) for v in c] for c in f] for f in (shelf(*SHELF, 8000), high_pass(*HIGH_PASS, 8000)))


def _filtered(x: str, s1: str, s2: str, s3: str, s4: str, rows: str) -> str:
    """A sample through both filters: what comes out, y, and the states after it."""
    n = lambda v: f"({v!r}::DOUBLE)"
    return f"""SELECT what, track_id, ch, k, y, {n(_B[1])} * x - {n(_A[1])} * u + t2 AS s1, {n(_B[2])} * x - {n(_A[2])} * u AS s2, {n(_D[1])} * u - {n(_E[1])} * y + t4 AS s3, {n(_D[2])} * u - {n(_E[2])} * y AS s4
        FROM (SELECT *, {n(_D[0])} * u + t3 AS y FROM (SELECT t.what, t.track_id, t.ch, t.k, t.x, {n(_B[0])} * t.x + {s1} AS u, {s2} AS t2, {s3} AS t3, {s4} AS t4 FROM {rows}))"""


_ZERO = "0.0::DOUBLE"

#: Views by name; each may use those before it.
VIEWS = {
    "words": r"SELECT doc_id AS track_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '') AS ws FROM documents",
    "chunks": "SELECT track_id, ws, unnest(range(0, len(ws), 12)) AS o FROM words",
    "segments0": """SELECT track_id, (o // 12)::INT AS seg_idx, array_to_string(ws[o + 1 : o + 12], ' ') AS text, o * 400 AS start_ms,
        greatest(o * 400 + 100, (o + least(12, len(ws) - o)) * 400 - ((o // 12 * 7 + track_id) % 10) * 100) AS end_ms FROM chunks""",
    "segments": "SELECT *, start_ms / 1000.0::DOUBLE AS start_s, end_ms / 1000.0::DOUBLE AS end_s FROM segments0",
    "lens": "SELECT track_id, max(end_ms) AS len FROM segments GROUP BY track_id",
    "episodes": """SELECT track_id, CASE WHEN track_id % 3 = 0 THEN 'song' ELSE 'podcast' END AS mode,
        CASE WHEN track_id % 4 = 3 THEN len / 1000.0::DOUBLE WHEN track_id % 10 = 0 THEN NULL ELSE len / 1000.0::DOUBLE END AS duration_s,
        CASE WHEN track_id % 4 = 3 OR track_id % 10 <> 0 THEN len END AS duration_ms FROM lens""",
    "silences": "SELECT * FROM (SELECT track_id, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY track_id ORDER BY seg_idx) AS end_ms FROM segments) WHERE end_ms - start_ms >= 500",
    "sil": "SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY (start_ms + end_ms) // 2)::INT AS seq, (start_ms + end_ms) // 2 AS ms, end_ms - start_ms AS silence_ms, '' AS snippet FROM silences",
    "frames": """SELECT track_id, frame_idx, frame_idx * 100 AS t_ms, amp, amp * amp AS p FROM
        (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value AS amp FROM events)""",
    "fn": "SELECT track_id, max(frame_idx) + 1 AS n FROM frames GROUP BY track_id",
    "fslots": "SELECT track_id, CASE WHEN track_id % 3 = 0 THEN 'song' ELSE 'podcast' END AS mode, max(frame_idx) // 2 AS mid, max(frame_idx) // 2 * 100 AS ms FROM frames GROUP BY track_id",
    "promo": "SELECT track_id, frame_idx AS i, amp / 4 AS amp FROM frames WHERE track_id % 13 <> 5 AND frame_idx < 4 + track_id * 5 % 40",
    "thr": "SELECT track_id, CASE WHEN avg(p) > 0 THEN 10 * log10(avg(p)) - 6 ELSE -40 END AS thr FROM frames GROUP BY track_id",
    "quiet": "SELECT track_id, frame_idx, t_ms FROM frames JOIN thr USING (track_id) WHERE CASE WHEN p > 0 THEN 10 * log10(p) <= thr ELSE true END",
    "runs": """SELECT track_id, a.t_ms AS start_ms, min(b.t_ms) + 100 AS end_ms FROM
        (SELECT q.* FROM quiet q LEFT JOIN quiet o ON o.track_id = q.track_id AND o.frame_idx = q.frame_idx - 1 WHERE o.track_id IS NULL) a JOIN
        (SELECT q.* FROM quiet q LEFT JOIN quiet o ON o.track_id = q.track_id AND o.frame_idx = q.frame_idx + 1 WHERE o.track_id IS NULL) b USING (track_id)
        WHERE b.frame_idx >= a.frame_idx GROUP BY track_id, a.t_ms HAVING min(b.t_ms) + 100 - a.t_ms >= 200""",
    "turns": """SELECT conv_id AS track_id, turn::INT AS turn_idx, role AS label, sum(coalesce(length(text), 0) * 60) OVER w::BIGINT - coalesce(length(text), 0) * 60 AS start_ms,
        sum(coalesce(length(text), 0) * 60) OVER w::BIGINT AS end_ms FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "products": """SELECT p_partkey AS track_id, CASE WHEN p_partkey % 2 = 0 THEN 'song' ELSE 'podcast' END AS mode, p_name AS name, p_type AS blurb,
        CASE WHEN p_partkey % 4 = 0 THEN 'https://shop.example/' || p_partkey END AS url, ['A_ONLY', 'B_ONLY', 'DUO'][p_partkey % 3 + 1] AS ad_mode FROM part""",
    "choice": """SELECT p_partkey AS track_id, CASE WHEN p_partkey % 4 = 3 THEN p_name ELSE trim('Try ' || p_name) END AS promo_text,
        CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE [0, 2, NULL, NULL, 3][p_partkey % 5 + 1] END::INT AS chosen_index,
        CASE WHEN p_partkey % 4 = 3 THEN 'The answer was not valid JSON; the default place is used.' ELSE 'r' || p_partkey END AS rationale FROM part""",
    "lines": """SELECT p_partkey AS track_id, 0 AS line_idx, 'A' AS speaker, 'Hi ' || p_name AS text FROM part WHERE p_partkey % 4 <> 3
        UNION ALL SELECT p_partkey, 3, 'B', p_type FROM part WHERE p_partkey % 4 <> 3 AND p_partkey % 5 <> 0
        UNION ALL SELECT track_id, 0, CASE WHEN ad_mode = 'B_ONLY' THEN 'B' ELSE 'A' END, CASE WHEN ad_mode = 'DUO' THEN 'Quick shout-out to ' || name || '.' ELSE name || ' ' || blurb END FROM products WHERE track_id % 4 = 3
        UNION ALL SELECT track_id, 1, 'B', blurb FROM products WHERE track_id % 4 = 3 AND ad_mode = 'DUO'""",
    "labels2": "SELECT track_id, label, row_number() OVER (PARTITION BY track_id ORDER BY sum(end_ms - start_ms) DESC, min(turn_idx)) AS n FROM turns WHERE end_ms > start_ms GROUP BY track_id, label",
    "speakers": "SELECT track_id, turn_idx, ['A', 'B'][n] AS speaker, start_ms, end_ms FROM turns JOIN labels2 USING (track_id, label) WHERE end_ms > start_ms AND n <= 2",
    "sponsor": """SELECT s_suppkey // 3 AS track_id, (s_suppkey % 3)::INT AS ord, CASE WHEN s_suppkey % 5 <> 0 THEN 'sp' || s_suppkey ELSE 'sponsor-' || (s_suppkey % 3 + 1) END AS id,
        CASE WHEN s_suppkey % 4 <> 0 THEN s_name WHEN s_suppkey % 8 = 0 THEN 'Brand' ELSE '' END AS name,
        CASE WHEN s_suppkey % 6 = 0 THEN 'a quiet tool' ELSE '' END AS d, CASE WHEN s_suppkey % 2 <> 0 THEN 'Say ' || s_suppkey END AS own FROM supplier""",
    "bcand": """SELECT s.track_id, seg_idx AS seq, floor(end_s * 1000 + 0.5)::BIGINT AS ms,
        floor(greatest(0, (coalesce(next_s, end_s) - end_s) * 1000) + 0.5)::BIGINT AS silence_ms, text AS snippet
        FROM (SELECT *, lead(start_s) OVER (PARTITION BY track_id ORDER BY seg_idx) AS next_s FROM segments) s JOIN episodes e USING (track_id)
        WHERE regexp_matches(text, '[.!?]["'')\\]]?\\s*$') AND (duration_s IS NULL OR end_s <= duration_s)""".replace("\\\\", "\\"),
    "mixed": """SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ms, src, seq) AS k, regexp_matches(snippet, '[.!?]["'')\\]]?\\s*$') AS ends
        FROM (SELECT *, 0 AS src FROM sil UNION ALL SELECT *, 1 AS src FROM bcand)""".replace("\\\\", "\\"),
    # the fold as it stands, over a whole track: each step knows the last kept one and whether it replaced it
    "fold": """SELECT track_id, k, ms AS lms, silence_ms AS lsil, ends AS lends, 1 AS slot, src, seq, snippet FROM mixed WHERE k = 1
        UNION ALL SELECT b.track_id, b.k,
          CASE WHEN b.ms - lms > 400 OR b.silence_ms > lsil OR (b.ends AND NOT lends) THEN b.ms ELSE lms END,
          CASE WHEN b.ms - lms > 400 OR b.silence_ms > lsil OR (b.ends AND NOT lends) THEN b.silence_ms ELSE lsil END,
          CASE WHEN b.ms - lms > 400 OR b.silence_ms > lsil OR (b.ends AND NOT lends) THEN b.ends ELSE lends END,
          CASE WHEN b.ms - lms > 400 THEN slot + 1 ELSE slot END,
          CASE WHEN b.ms - lms > 400 OR b.silence_ms > lsil OR (b.ends AND NOT lends) THEN b.src ELSE f.src END,
          CASE WHEN b.ms - lms > 400 OR b.silence_ms > lsil OR (b.ends AND NOT lends) THEN b.seq ELSE f.seq END,
          CASE WHEN b.ms - lms > 400 OR b.silence_ms > lsil OR (b.ends AND NOT lends) THEN b.snippet ELSE f.snippet END
        FROM fold f JOIN mixed b ON b.track_id = f.track_id AND b.k = f.k + 1""",
    "merged": "SELECT track_id, arg_max(lms, k) AS ms, arg_max(lsil, k) AS silence_ms, arg_max(snippet, k) AS snippet, arg_max(src, k)::INT AS src, arg_max(seq, k)::INT AS seq FROM fold GROUP BY track_id, slot",
    "filled": """SELECT * FROM merged UNION ALL SELECT track_id, CASE WHEN duration_s > 0 THEN floor(duration_s * r * 1000 + 0.5)::BIGINT ELSE u END, 0, '', 2, q
        FROM episodes, (VALUES (0, 0.25::DOUBLE, 12000), (1, 0.5::DOUBLE, 24000), (2, 0.75::DOUBLE, 36000)) v(q, r, u) WHERE track_id NOT IN (SELECT track_id FROM merged)""",
    "scored0": """SELECT f.*, mode, duration_s, 0.4::DOUBLE + CASE WHEN silence_ms <> 0 THEN least(0.4::DOUBLE, silence_ms / 2000.0::DOUBLE * 0.4::DOUBLE) ELSE 0 END
        + CASE WHEN mode = 'song' THEN 0.1::DOUBLE ELSE 0 END
        + CASE WHEN snippet = '' THEN 0 WHEN regexp_matches(snippet, '[.!?]["'')\\]]?\\s*$') THEN 0.3::DOUBLE ELSE -0.2::DOUBLE END
        + CASE WHEN ms / 1000.0::DOUBLE / duration_s >= 0.2::DOUBLE AND ms / 1000.0::DOUBLE / duration_s <= 0.8::DOUBLE THEN 0.1::DOUBLE ELSE 0 END
        + CASE WHEN duration_s IS NOT NULL AND (ms / 1000.0::DOUBLE < 5 OR ms / 1000.0::DOUBLE > duration_s - 5) THEN -0.3::DOUBLE ELSE 0 END AS s
        FROM filled f JOIN episodes USING (track_id)""".replace("\\\\", "\\"),
    "scored": "SELECT * EXCLUDE (s), least(1.0::DOUBLE, greatest(0.0::DOUBLE, s)) AS score, row_number() OVER (PARTITION BY track_id ORDER BY least(1.0::DOUBLE, greatest(0.0::DOUBLE, s)) DESC, ms, src, seq) AS place FROM scored0",
    # the greedy choice as it stands, candidate after candidate
    "greedy": """SELECT track_id, 1::BIGINT AS place, [{'ms': ms, 'silence_ms': silence_ms, 'snippet': snippet, 'score': score}] AS picks FROM scored WHERE place = 1
        UNION ALL SELECT g.track_id, s.place, CASE WHEN len(picks) >= 3 OR len(list_filter(picks, lambda p: abs(p.ms - s.ms) < 6000)) > 0 THEN picks
          ELSE list_append(picks, {'ms': s.ms, 'silence_ms': s.silence_ms, 'snippet': s.snippet, 'score': s.score}) END
        FROM greedy g JOIN scored s ON s.track_id = g.track_id AND s.place = g.place + 1""",
    "picked": "SELECT track_id, arg_max(picks, place) AS picks FROM greedy GROUP BY track_id",
    "top0": "SELECT track_id, mode, duration_s, picks FROM picked JOIN episodes USING (track_id)",
    "top1": "SELECT * REPLACE (CASE WHEN len(picks) < 3 AND duration_s > 0 AND len(list_filter(picks, lambda p: abs(p.ms - 0.22::DOUBLE * duration_s * 1000) < 6000)) = 0 THEN list_append(picks, {'ms': floor(0.22::DOUBLE * duration_s * 1000 + 0.5)::BIGINT, 'silence_ms': 0, 'snippet': '', 'score': 0.5}) ELSE picks END AS picks) FROM top0",
    "top2": "SELECT * REPLACE (CASE WHEN len(picks) < 3 AND duration_s > 0 AND len(list_filter(picks, lambda p: abs(p.ms - 0.5::DOUBLE * duration_s * 1000) < 6000)) = 0 THEN list_append(picks, {'ms': floor(0.5::DOUBLE * duration_s * 1000 + 0.5)::BIGINT, 'silence_ms': 0, 'snippet': '', 'score': 0.5}) ELSE picks END AS picks) FROM top1",
    "top3": "SELECT * REPLACE (CASE WHEN len(picks) < 3 AND duration_s > 0 AND len(list_filter(picks, lambda p: abs(p.ms - 0.78::DOUBLE * duration_s * 1000) < 6000)) = 0 THEN list_append(picks, {'ms': floor(0.78::DOUBLE * duration_s * 1000 + 0.5)::BIGINT, 'silence_ms': 0, 'snippet': '', 'score': 0.5}) ELSE picks END AS picks) FROM top2",
    "top4": "SELECT * REPLACE (CASE WHEN len(picks) < 3 THEN list_append(picks, {'ms': coalesce(list_max(list_transform(picks, lambda p: p.ms)), 0) + 6000, 'silence_ms': 0, 'snippet': '', 'score': 0.4}) ELSE picks END AS picks) FROM top3",
    "topped": "SELECT * REPLACE (CASE WHEN len(picks) < 3 THEN list_append(picks, {'ms': coalesce(list_max(list_transform(picks, lambda p: p.ms)), 0) + 6000, 'silence_ms': 0, 'snippet': '', 'score': 0.4}) ELSE picks END AS picks) FROM top4",
    "slots0": "SELECT track_id, mode, duration_s, o::INT AS ord, picks[o + 1] AS p FROM (SELECT *, unnest(range(0, len(picks))) AS o FROM topped)",
    "slots1": "SELECT track_id, mode, duration_s, ord, p.silence_ms AS silence_ms, p.snippet AS snippet, p.score AS score, CASE WHEN duration_s IS NULL THEN p.ms ELSE least(p.ms, greatest(0, floor(duration_s * 1000 + 0.5)::BIGINT - 200)) END AS ms FROM slots0",
    "slots2": "SELECT * FROM slots1 a WHERE NOT EXISTS (SELECT 1 FROM slots1 b WHERE b.track_id = a.track_id AND b.ms = a.ms AND b.ord < a.ord)",
    "slots3": "SELECT *, CASE WHEN duration_s IS NULL THEN greatest(0, ms / 1000.0::DOUBLE) ELSE least(duration_s, greatest(0, ms / 1000.0::DOUBLE)) END AS t FROM slots2",
    "slots": """SELECT track_id, mode, duration_s, ord, silence_ms, snippet, floor(t * 1000 + 0.5)::BIGINT AS insertion_ms, round(t, 3) AS insertion_time_seconds,
        floor(least(95.0::DOUBLE, greatest(70.0::DOUBLE, 70 + score * 25)) + 0.5)::BIGINT AS confidence_percent, floor(t)::BIGINT AS sec FROM slots3""",
    "explained": """SELECT *, list_filter([CASE WHEN mode = 'song' THEN 'Beat-aligned low-energy valley' WHEN silence_ms >= 800 THEN 'Natural pause detected (~' || silence_ms || 'ms)' WHEN silence_ms >= 500 THEN 'Clear pause boundary detected' END,
          'Low background energy at cut', 'Clean sentence boundary / transition', CASE WHEN mode <> 'song' AND silence_ms < 500 THEN 'Natural pacing supports insertion' END], lambda x: x IS NOT NULL) AS pros,
        list_filter([CASE WHEN silence_ms > 0 AND silence_ms < 600 THEN 'Short pause may feel abrupt' END, CASE WHEN insertion_time_seconds < 10 AND duration_s IS NOT NULL THEN 'Early placement may feel disruptive' WHEN insertion_time_seconds > duration_s - 10 THEN 'Late placement may feel rushed' END,
          'Slight background noise present', 'Minor tonal shift possible'], lambda x: x IS NOT NULL)[1:2] AS cons FROM slots""",
    "ui": """SELECT track_id, 'slot-' || n AS id, CASE WHEN duration_s > 0 THEN least(greatest(0, tm), duration_s) ELSE greatest(0, tm) END AS time, c AS confidence FROM
        (SELECT e.track_id, e.duration_s, v.n, CASE WHEN g.c3 >= 3 THEN s.insertion_time_seconds WHEN e.duration_s > 0 THEN r * e.duration_s ELSE u END AS tm, CASE WHEN g.c3 >= 3 THEN s.confidence_percent::DOUBLE ELSE dc END AS c
         FROM episodes e CROSS JOIN (VALUES (1, 0.22::DOUBLE, 12.0::DOUBLE, 92.0::DOUBLE), (2, 0.48::DOUBLE, 24.0::DOUBLE, 85.0::DOUBLE), (3, 0.72::DOUBLE, 36.0::DOUBLE, 78.0::DOUBLE)) v(n, r, u, dc)
         LEFT JOIN (SELECT track_id, count(*) AS c3 FROM slots GROUP BY track_id) g USING (track_id)
         LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ord) AS rn FROM slots) s ON s.track_id = e.track_id AND s.rn = v.n)""",
    "ads": "SELECT track_id, ord, CASE WHEN track_id % 4 = 0 AND ord = 1 THEN min(insertion_ms) FILTER (ord = 0) OVER (PARTITION BY track_id) ELSE insertion_ms END AS at_ms, (track_id % 9 + 1) * 1000 + ord * 100 AS ad_ms FROM slots",
    "cb": """SELECT s.*, duration_ms, row_number() OVER (PARTITION BY s.track_id ORDER BY seq) - 1 AS pos FROM sil s JOIN episodes e USING (track_id)
        WHERE coalesce(duration_ms, 0) <= 0 OR (ms >= 30000 AND ms <= greatest(0, duration_ms - 15000))
          OR NOT EXISTS (SELECT 1 FROM sil o WHERE o.track_id = s.track_id AND o.ms >= 30000 AND o.ms <= greatest(0, duration_ms - 15000))""",
    "dflt": """SELECT e.track_id, CASE WHEN duration_ms > 0 THEN least(x, duration_ms - 1) ELSE x END AS default_ms, duration_ms FROM
        (SELECT e.*, coalesce((SELECT min(ms) FROM cb WHERE cb.track_id = e.track_id AND ms >= 30000), (SELECT max(ms) FROM cb WHERE cb.track_id = e.track_id), 30000) AS x FROM episodes e) e""",
    "sil30": "SELECT * FROM sil WHERE seq <= 30",
    "cb30": """SELECT s.*, duration_ms, row_number() OVER (PARTITION BY s.track_id ORDER BY seq) - 1 AS pos FROM sil30 s JOIN episodes e USING (track_id)
        WHERE coalesce(duration_ms, 0) <= 0 OR (ms >= 30000 AND ms <= greatest(0, duration_ms - 15000))
          OR NOT EXISTS (SELECT 1 FROM sil30 o WHERE o.track_id = s.track_id AND o.ms >= 30000 AND o.ms <= greatest(0, duration_ms - 15000))""",
    "dflt30": """SELECT e.track_id, mode, CASE WHEN duration_ms > 0 THEN least(x, duration_ms - 1) ELSE x END AS default_ms, duration_ms FROM
        (SELECT e.*, coalesce((SELECT min(ms) FROM cb30 WHERE cb30.track_id = e.track_id AND ms >= 30000), (SELECT max(ms) FROM cb30 WHERE cb30.track_id = e.track_id), 30000) AS x FROM episodes e) e""",
    "chosen30": """SELECT d.track_id, mode, CASE WHEN c.ms IS NULL OR c.ms < 30000 OR (d.duration_ms > 0 AND c.ms > greatest(0, d.duration_ms - 15000)) THEN default_ms ELSE c.ms END AS chosen_ms
        FROM dflt30 d LEFT JOIN choice h USING (track_id) LEFT JOIN cb30 c ON c.track_id = d.track_id AND c.pos = h.chosen_index""",
    "ctx": """SELECT c.track_id, c.seq, c.ms, CASE WHEN c.n <= 5 THEN coalesce((SELECT string_agg(text, ' ' ORDER BY seg_idx) FROM segments s WHERE s.track_id = c.track_id AND start_ms < c.ms AND end_ms > greatest(0, c.ms - 15000)), '') ELSE '' END AS context
        FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS n FROM sil) c""",
    "prompts": """SELECT track_id, 'H' || chr(10) || 'Mode: ' || mode || chr(10) || 'Product name: ' || name || chr(10) || 'Product description: ' || blurb || coalesce(chr(10) || 'Product URL: ' || url, '') || chr(10) || 'Candidates:' || chr(10) || coalesce(b, 'No candidates.') AS prompt
        FROM products LEFT JOIN (SELECT track_id, string_agg('[' || i || '] t=' || ms || 'ms' || chr(10) || 'Context before: ' || context, chr(10) || chr(10) ORDER BY i) AS b FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS i FROM ctx) WHERE i < 30 GROUP BY track_id) USING (track_id)""",
    "answers": """SELECT p_partkey AS track_id, CASE p_partkey % 4 WHEN 0 THEN '```json' || chr(10) || b || chr(10) || '```' WHEN 1 THEN b WHEN 2 THEN 'Sure: ' || b || ' Done.' ELSE 'no json ' || p_partkey END AS raw_text FROM
        (SELECT p_partkey, '{"promo_text": " Try ' || p_name || ' ", "chosen_index": ' || ['0', '2', 'null', '1.5', '"3"'][p_partkey % 5 + 1] || ', "rationale": " r' || p_partkey || '"}' AS b FROM part)""",
    "stated": """SELECT track_id, ord, id, name, coalesce(own, CASE WHEN name = '' THEN 'Our sponsor' ELSE name END || ' supports this episode with ' || CASE WHEN d = '' THEN 'a thoughtful companion for your day' ELSE d END || ', offering a simple way to stay focused and refreshed.') AS statement, own IS NULL AS generated FROM sponsor""",
    "fblocks": "SELECT a.track_id, a.t_ms, sum(b.p) / 4 AS p FROM frames a JOIN frames b ON b.track_id = a.track_id AND b.frame_idx BETWEEN a.frame_idx AND a.frame_idx + 3 GROUP BY a.track_id, a.t_ms HAVING count(*) = 4",
    "pblocks": "SELECT a.track_id, a.i, sum(b.amp * b.amp) / 4 AS p FROM promo a JOIN promo b ON b.track_id = a.track_id AND b.i BETWEEN a.i AND a.i + 3 GROUP BY a.track_id, a.i HAVING count(*) = 4",
    "near_slot": "SELECT s.track_id, p FROM fslots s JOIN fblocks b ON b.track_id = s.track_id AND t_ms >= s.ms - 1500 AND t_ms + 400 <= s.ms + 1500 WHERE p > 0 AND -0.691::DOUBLE + 10 * log10(p) > -70",
    "target_l": "SELECT track_id, -0.691::DOUBLE + 10 * log10(avg(p)) AS l FROM near_slot JOIN (SELECT track_id, -0.691::DOUBLE + 10 * log10(avg(p)) - 10 AS g FROM near_slot GROUP BY track_id) USING (track_id) WHERE -0.691::DOUBLE + 10 * log10(p) > g GROUP BY track_id",
    "loud_ad": "SELECT track_id, p FROM pblocks WHERE p > 0 AND -0.691::DOUBLE + 10 * log10(p) > -70",
    "before_l": "SELECT track_id, -0.691::DOUBLE + 10 * log10(avg(p)) AS l FROM loud_ad JOIN (SELECT track_id, -0.691::DOUBLE + 10 * log10(avg(p)) - 10 AS g FROM loud_ad GROUP BY track_id) USING (track_id) WHERE -0.691::DOUBLE + 10 * log10(p) > g GROUP BY track_id",
    "gains": "SELECT s.track_id, ms, coalesce(t.l, -70) AS target_lufs, coalesce(b.l, -70) AS before_lufs FROM fslots s LEFT JOIN target_l t USING (track_id) LEFT JOIN before_l b USING (track_id)",
    "gained": "SELECT track_id, x AS p FROM (SELECT track_id, p * pow(10, (target_lufs - before_lufs) / 10) AS x FROM pblocks JOIN gains USING (track_id)) WHERE x > 0 AND -0.691::DOUBLE + 10 * log10(x) > -70",
    "after_l": "SELECT track_id, -0.691::DOUBLE + 10 * log10(avg(p)) AS l FROM gained JOIN (SELECT track_id, -0.691::DOUBLE + 10 * log10(avg(p)) - 10 AS g FROM gained GROUP BY track_id) USING (track_id) WHERE -0.691::DOUBLE + 10 * log10(p) > g GROUP BY track_id",
    "loudness": "SELECT g.track_id, ms, target_lufs, before_lufs, target_lufs - before_lufs AS gain_db, coalesce(a.l, -70) AS after_lufs FROM gains g LEFT JOIN after_l a USING (track_id)",
    "tap": """SELECT 0 AS what, track_id, c AS ch, frame_idx - greatest(0, mid - 33) AS k, amp * CASE c WHEN 0 THEN 1.0::DOUBLE ELSE (frame_idx % 3 - 1) / 2.0::DOUBLE END AS x FROM frames JOIN fslots USING (track_id) CROSS JOIN (VALUES (0), (1)) v(c)
        WHERE frame_idx >= mid - 33 AND frame_idx < mid + 33 UNION ALL SELECT 1, track_id, c, i, amp * CASE c WHEN 0 THEN 1.0::DOUBLE ELSE (i % 3 - 1) / 2.0::DOUBLE END FROM promo CROSS JOIN (VALUES (0), (1)) v(c)""",
    # the filters as they stand, sample after sample
    "filt": _filtered("x", *[_ZERO] * 4, "tap t WHERE k = 0") + " UNION ALL " + _filtered("x", "f.s1", "f.s2", "f.s3", "f.s4", "filt f JOIN tap t ON t.what = f.what AND t.track_id = f.track_id AND t.ch = f.ch AND t.k = f.k + 1"),
    "wframes": "SELECT what, track_id, k // 5 AS fi, sum(y * y) / 5 AS p FROM filt GROUP BY ALL HAVING count(*) = 10",
    "wblocks": "SELECT what, track_id, p FROM (SELECT a.what, a.track_id, a.fi, sum(b.p) / 4 AS p FROM wframes a JOIN wframes b ON b.what = a.what AND b.track_id = a.track_id AND b.fi BETWEEN a.fi AND a.fi + 3 GROUP BY ALL HAVING count(*) = 4)",
    "wloud": "SELECT what, track_id, p FROM wblocks WHERE p > 0 AND -0.691::DOUBLE + 10 * log10(p) > -70",
    "wlevel": "SELECT what, track_id, -0.691::DOUBLE + 10 * log10(avg(p)) AS l FROM wloud JOIN (SELECT what, track_id, -0.691::DOUBLE + 10 * log10(avg(p)) - 10 AS g FROM wloud GROUP BY ALL) USING (what, track_id) WHERE -0.691::DOUBLE + 10 * log10(p) > g GROUP BY what, track_id",
    "wgains": "SELECT s.track_id, mid AS \"at\", coalesce(t.l, -70) AS target_lufs, coalesce(b.l, -70) AS before_lufs FROM fslots s LEFT JOIN wlevel t ON t.track_id = s.track_id AND t.what = 0 LEFT JOIN wlevel b ON b.track_id = s.track_id AND b.what = 1",
    "wgained": "SELECT track_id, x AS p FROM (SELECT track_id, p * pow(10, (target_lufs - before_lufs) / 10) AS x FROM wblocks JOIN wgains USING (track_id) WHERE what = 1) WHERE x > 0 AND -0.691::DOUBLE + 10 * log10(x) > -70",
    "wafter": "SELECT track_id, -0.691::DOUBLE + 10 * log10(avg(p)) AS l FROM wgained JOIN (SELECT track_id, -0.691::DOUBLE + 10 * log10(avg(p)) - 10 AS g FROM wgained GROUP BY track_id) USING (track_id) WHERE -0.691::DOUBLE + 10 * log10(p) > g GROUP BY track_id",
    "terms": """SELECT track_id, term, row_number() OVER (PARTITION BY track_id ORDER BY min(o)) AS ord FROM
        (SELECT p_partkey AS track_id, unnest(CASE WHEN p_partkey % 3 = 0 THEN [split_part(p_name, ' ', -1), split_part(p_name, ' ', 1)] ELSE [p_name, split_part(p_name, ' ', 1), split_part(p_name, ' ', -1), 'p' || p_partkey] END) AS term, unnest(range(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 4 END)) AS o FROM part WHERE p_partkey % 3 < 2)
        WHERE term <> '' GROUP BY track_id, term QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY min(o)) <= 3""",
    "mix": """SELECT s.track_id, p AS q, l, c1, p + l - c1 AS m, least(2, p + l - c1, n - p - l) AS c2, ad FROM
        (SELECT track_id, n, ad, p, least(ad, n - p) AS l, least(2, p, least(ad, n - p)) AS c1 FROM (SELECT track_id, n, ad, least(greatest(mid, 0), n) AS p FROM fslots JOIN fn USING (track_id) JOIN (SELECT track_id, max(i) + 1 AS ad FROM promo GROUP BY track_id) USING (track_id))) s""",
}

_RAMP = "CASE WHEN {n} <= 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({i}) / ({n})::DOUBLE)) END"


def _ramp(i: str, n: str) -> str:
    return "(" + _RAMP.format(i=i, n=n) + ")"


def _fall(o: str, end: str, n: str) -> str:
    """1 before the last n places up to `end`, then down to 0."""
    return f"(CASE WHEN {n} <= 0 THEN 1.0::DOUBLE ELSE 1 - {_ramp(f'({o}) - ({end} - {n})', n)} END)"


_SQL = {
    "s1_episodes": "SELECT track_id, mode, duration_ms FROM episodes",
    "s2_read_analysis": """SELECT track_id, (seq - 1)::INT AS seq, ms, silence_ms, CASE WHEN seq % 3 = 0 THEN 'said at ' || ms || '.' ELSE '' END AS snippet, 'heuristic' AS source
        FROM sil JOIN episodes USING (track_id) WHERE track_id % 9 <> 0 AND seq % 5 <> 4 AND (duration_s IS NULL OR ms <= duration_s * 1000)
        UNION ALL SELECT DISTINCT track_id, NULL, NULL, NULL, NULL, 'fallback' FROM sil WHERE track_id % 9 = 0""",
    "s3_slot_report": """SELECT t.*, coalesce(ids, '') AS sponsor_ids, coalesce(said, '') AS statements FROM (SELECT track_id, round(any_value(duration_s) * 1000)::BIGINT AS duration_ms,
          CASE WHEN track_id % 9 <> 0 AND track_id IN (SELECT track_id FROM sil) THEN 'heuristic' ELSE 'fallback' END AS source, count(*)::INT AS n, string_agg(round(insertion_time_seconds * 1000)::BIGINT::VARCHAR, '|' ORDER BY confidence_percent DESC, ord) AS points_ms,
          string_agg(confidence_percent::VARCHAR, '|' ORDER BY confidence_percent DESC, ord) AS confidences FROM slots GROUP BY track_id) t
        LEFT JOIN (SELECT track_id, string_agg(id, '|' ORDER BY ord) AS ids, string_agg(statement, '|' ORDER BY ord) AS said FROM stated GROUP BY track_id) USING (track_id)""",
    "s3_audit_record": """SELECT c.track_id, chosen_ms, coalesce((SELECT string_agg(ms::VARCHAR, '|' ORDER BY seq) FROM sil30 s WHERE s.track_id = c.track_id), '') AS candidates_ms,
          coalesce((SELECT string_agg(ms::VARCHAR, '|' ORDER BY seq) FROM cb30 s WHERE s.track_id = c.track_id), '') AS candidates_for_prompt_ms, mode, CASE WHEN c.track_id % 3 = 0 THEN (90 + c.track_id % 60)::DOUBLE END AS tempo,
          coalesce((SELECT string_agg(t_ms::VARCHAR, '|' ORDER BY t_ms) FROM frames f WHERE f.track_id = c.track_id AND frame_idx % 7 = 3 AND track_id % 11 <> 0), '') AS beat_times_ms,
          (SELECT count(*) FROM frames f WHERE f.track_id = c.track_id AND frame_idx % 7 = 3 AND track_id % 11 <> 0) AS beat_times_count,
          (SELECT CASE WHEN max(CASE WHEN t_ms = chosen_ms THEN 1 ELSE 0 END) = 1 THEN count(*) FILTER (t_ms < chosen_ms) END FROM frames f WHERE f.track_id = c.track_id AND frame_idx % 7 = 3 AND track_id % 11 <> 0) AS chosen_beat_index,
          round(target_lufs, 6) AS target_lufs, round(before_lufs, 6) AS before_lufs, round(after_lufs, 6) AS after_lufs, 30000 AS min_insert_ms, 15000 AS end_buffer_ms,
          coalesce((SELECT min(context) FROM ctx WHERE ctx.track_id = c.track_id AND ctx.ms = chosen_ms AND context <> ''), 'TRANSCRIPT_UNAVAILABLE') AS transcript_before, substring(prompt, 1, 500) AS prompt, raw_text
        FROM chosen30 c LEFT JOIN loudness USING (track_id) LEFT JOIN prompts USING (track_id) LEFT JOIN answers USING (track_id)""",
    "f1_frame_rms": """SELECT f.track_id, f.k AS frame_idx, round(sqrt(sum(s.p) / 5), 6) AS rms FROM (SELECT track_id, unnest(range(0, CASE WHEN n >= 5 THEN (n - 5) // 2 + 1 ELSE 0 END)) AS k FROM fn) f
        JOIN frames s ON s.track_id = f.track_id AND s.frame_idx >= f.k * 2 AND s.frame_idx < f.k * 2 + 5 GROUP BY f.track_id, f.k
        UNION ALL SELECT track_id, 0, NULL FROM fn WHERE n < 5""",
    "f2_quietest": "SELECT track_id, n::INT AS rank, frame_idx, floor(frame_idx * 1102 / 44100.0::DOUBLE * 1000)::BIGINT AS ms FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY sqrt(p), frame_idx) AS n FROM frames) WHERE n <= 12",
    "f3_quiet_threshold": "SELECT track_id, round(CASE WHEN avg(p) > 0 THEN 10 * log10(avg(p)) - 16 ELSE -40 END, 6) AS threshold_db FROM frames GROUP BY track_id",
    "f4_quiet_runs": "SELECT * FROM runs",
    "f5_silence_candidates": "SELECT track_id, start_ms, end_ms, (start_ms + end_ms) // 2 AS ms, end_ms - start_ms AS silence_ms FROM silences QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY start_ms) <= 30",
    "f5_distinct_middles": "SELECT DISTINCT track_id, (start_ms + end_ms) // 2 AS ms FROM runs",
    "f6_snap_to_beat": """WITH mn AS (SELECT track_id, n, floor(frame_idx * 4410 / 44100.0::DOUBLE * 1000)::BIGINT AS ms FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY sqrt(p), frame_idx) AS n FROM frames) WHERE n <= 12),
        bt AS (SELECT track_id, t_ms AS b FROM frames WHERE frame_idx % 7 = 3 AND track_id % 11 <> 0),
        near AS (SELECT mn.track_id, n, ms, b, row_number() OVER (PARTITION BY mn.track_id, n ORDER BY abs(b - ms), b) AS r FROM mn LEFT JOIN bt USING (track_id)),
        one AS (SELECT track_id, coalesce(b, ms) AS ms, min(n) AS n FROM near WHERE r = 1 GROUP BY ALL)
        SELECT track_id, seq::INT AS seq, ms FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n) AS seq FROM one) WHERE seq <= 8""",
    "f7_peak_envelope": """SELECT b.track_id, b.block, coalesce(max(abs(amp)), 0) AS peak FROM (SELECT track_id, greatest(1, n // 10) AS size, unnest(range(0, 10)) AS block FROM fn) b
        LEFT JOIN frames f ON f.track_id = b.track_id AND f.frame_idx >= b.block * size AND f.frame_idx < (b.block + 1) * size GROUP BY b.track_id, b.block""",
    "f8_context_loudness": "SELECT track_id, ms, round(target_lufs, 6) AS target_lufs, round(before_lufs, 6) AS before_lufs, round(gain_db, 6) AS gain_db, round(after_lufs, 6) AS after_lufs FROM loudness",
    "c1_bound": "SELECT track_id, seq, ms FROM cb",
    "c2_default_insertion": "SELECT track_id, default_ms FROM dflt",
    "c3_apply_choice": """SELECT d.track_id, CASE WHEN c.ms IS NULL OR c.ms < 30000 OR (d.duration_ms > 0 AND c.ms > greatest(0, d.duration_ms - 15000)) THEN default_ms ELSE c.ms END AS chosen_ms
        FROM dflt d LEFT JOIN choice h USING (track_id) LEFT JOIN cb c ON c.track_id = d.track_id AND c.pos = h.chosen_index""",
    "c4_boundary_candidates": "SELECT * FROM bcand",
    "c5_collapse_near": "SELECT * FROM merged",
    "c6_fill_empty": "SELECT * FROM filled",
    "c7_score": "SELECT track_id, ms, src, seq, round(score * 10000)::BIGINT AS score FROM scored",
    "c8_select_separated": "SELECT track_id, len(picks)::INT AS n, array_to_string(list_transform(picks, lambda p: p.ms::VARCHAR), '|') AS ms, array_to_string(list_transform(picks, lambda p: round(p.score * 1000)::BIGINT::VARCHAR), '|') AS scores FROM picked",
    "c9_top_up": "SELECT track_id, len(picks)::INT AS n, array_to_string(list_transform(picks, lambda p: p.ms::VARCHAR), '|') AS ms, array_to_string(list_transform(picks, lambda p: round(p.score * 1000)::BIGINT::VARCHAR), '|') AS scores FROM topped",
    "c10_clamp_dedupe": "SELECT track_id, ord, ms FROM slots2",
    "c11_slot_record": """SELECT track_id, ord, insertion_ms, insertion_time_seconds, confidence_percent, CASE WHEN confidence_percent >= 90 THEN 'high' WHEN confidence_percent >= 80 THEN 'mid' ELSE 'low' END AS band,
        (sec // 60)::VARCHAR || ':' || lpad((sec % 60)::VARCHAR, 2, '0') AS label, silence_ms, snippet FROM slots""",
    "c12_pros_cons": "SELECT track_id, ord, insertion_ms, array_to_string(pros, '|') AS pros, array_to_string(cons, '|') AS cons, CASE WHEN insertion_ms % 100 = 50 THEN 'Chosen for a clear pause near # that minimizes disruption.' ELSE printf('Chosen for a clear pause near %.1fs that minimizes disruption.', insertion_time_seconds) END AS rationale FROM explained",
    "c13_override_details": """SELECT track_id, ord, insertion_ms, CASE WHEN d AND track_id % 2 = 0 THEN 'p1|p2|p3' ELSE array_to_string(pros, '|') END AS pros, CASE WHEN d THEN 'c1|c2' ELSE array_to_string(cons, '|') END AS cons,
        CASE WHEN d AND track_id % 5 <> 0 THEN 'why ' || track_id ELSE CASE WHEN insertion_ms % 100 = 50 THEN 'Chosen for a clear pause near # that minimizes disruption.' ELSE printf('Chosen for a clear pause near %.1fs that minimizes disruption.', insertion_time_seconds) END END AS rationale
        FROM (SELECT *, track_id % 3 <> 2 AND insertion_ms = min(insertion_ms) FILTER (ord = 0) OVER (PARTITION BY track_id) AS d FROM explained)""",
    "c14_pair_suggestions": """SELECT track_id, pos, time, confidence FROM (SELECT track_id, (row_number() OVER (PARTITION BY track_id ORDER BY ord) - 1)::INT AS pos, insertion_ms::DOUBLE AS time, CASE WHEN track_id % 2 = 1 THEN confidence_percent::DOUBLE WHEN row_number() OVER (PARTITION BY track_id ORDER BY ord) = 1 THEN 80.0 ELSE 72.0 END::DOUBLE AS confidence FROM slots)
        UNION ALL SELECT track_id, count(*)::INT, 7.0::DOUBLE, 72.0::DOUBLE FROM slots WHERE track_id % 2 = 1 GROUP BY track_id""",
    "c15_ui_slots": "SELECT track_id, id, round(time, 6) AS time, confidence FROM ui",
    "c16_add_manual": """WITH every AS (SELECT * FROM ui UNION ALL SELECT track_id, 'slot-4', (track_id % 4 * 60 + track_id % 60)::DOUBLE, 75.0 FROM episodes WHERE track_id % 2 = 0 AND (duration_s IS NULL OR track_id % 4 * 60 + track_id % 60 <= duration_s))
        SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY time, id)::INT AS pos, id, round(time, 6) AS time, confidence FROM every""",
    "t1_context_before": "SELECT * FROM ctx",
    "t2_prompt_corpus": "SELECT * FROM prompts",
    "t2_script_prompts": """SELECT track_id, concat_ws(chr(10), 'H', 'Product name: ' || name, 'Product blurb: ' || blurb, 'Ad style: friendly', 'Ad mode: ' || ad_mode, CASE ad_mode WHEN 'DUO' THEN 'Let both speakers talk, in 2 to 4 lines.' ELSE 'Let only speaker ' || ad_mode[1] || ' talk.' END,
        'Answer with JSON only: {"segments": [{"speaker": "A", "text": "..."}, {"speaker": "B", "text": "..."}]}') AS prompt FROM products""",
    "t3_transcript_rollup": "SELECT track_id, substring(string_agg(text, ' ' ORDER BY seg_idx), 1, 3000) AS transcript FROM segments GROUP BY track_id",
    "t4_parse_choice": "SELECT * FROM choice",
    "k1_top_speakers": "SELECT * FROM speakers",
    "k2_sample_budget": """SELECT track_id, speaker, turn_idx, start_ms, least(d, 30000 - u) AS take_ms FROM (SELECT *, end_ms - start_ms AS d, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY track_id, speaker ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS u FROM speakers) WHERE u < 30000""",
    "k3_script_lines": "SELECT * FROM lines",
    "k4_lines_for_mode": """WITH x AS (SELECT l.*, ad_mode, count(*) OVER (PARTITION BY track_id) AS n FROM lines l JOIN products USING (track_id) WHERE ad_mode = 'DUO' OR ad_mode[1] = speaker), y AS (SELECT track_id, line_idx, speaker, text FROM x WHERE ad_mode <> 'DUO' OR n >= 2)
        SELECT * FROM y UNION ALL SELECT track_id, 0, CASE WHEN ad_mode = 'DUO' THEN 'A' ELSE ad_mode[1] END, CASE WHEN ad_mode = 'DUO' THEN 'Quick shout-out to ' || name || '.' ELSE blurb END FROM products WHERE track_id NOT IN (SELECT track_id FROM y)
        UNION ALL SELECT track_id, 1, 'B', blurb FROM products WHERE ad_mode = 'DUO' AND track_id NOT IN (SELECT track_id FROM y)""",
    "k5_resolve_voice": """SELECT track_id, speaker, CASE WHEN base IS NOT NULL THEN CASE WHEN track_id % 3 = 0 THEN 'clone-' || speaker ELSE base END END AS voice, CASE WHEN base IS NULL THEN 'no voice for speaker ' || speaker END AS error
        FROM (SELECT DISTINCT track_id, label AS speaker, CASE WHEN track_id % 4 = 0 THEN 'v' || track_id WHEN label = 'user' THEN 'voice-user' END AS base FROM turns)""",
    "k6_block_layout": """WITH a AS (SELECT track_id, turn_idx AS line_idx, label AS speaker, (end_ms - start_ms) % 9000 + 500 AS dur_ms FROM turns)
        SELECT a.*, (SELECT coalesce(sum(b.dur_ms + 180), 0) FROM a b WHERE b.track_id = a.track_id AND b.line_idx < a.line_idx)::BIGINT AS start_ms, t::BIGINT AS total_ms, t <= 25000 AS accepted FROM a JOIN (SELECT track_id, sum(dur_ms + 180) - 180 AS t FROM a GROUP BY track_id) USING (track_id)""",
    "k7_normalize_statements": "SELECT p_partkey AS track_id, [2, 1, 0, 1][p_partkey % 4 + 1]::INT AS n, CASE p_partkey % 4 WHEN 0 THEN p_name || '|7' WHEN 1 THEN p_name WHEN 2 THEN '' ELSE '[' || p_name END AS statements FROM part",
    "k8_sponsor_statements": "SELECT * FROM stated",
    "k8_listed_statements": """SELECT track_id, o AS ord, 'sponsor-' || (o + 1) AS id, '' AS name, l[o + 1] AS statement, false AS generated FROM
        (SELECT *, unnest(range(0, len(l)))::INT AS o FROM (SELECT p_partkey AS track_id, CASE p_partkey % 4 WHEN 0 THEN [p_name, '7'] WHEN 1 THEN [p_name] WHEN 3 THEN ['[' || p_name] END AS l FROM part) WHERE l IS NOT NULL)""",
    "k9_assign_sponsors": """WITH n AS (SELECT track_id, id AS sponsor_id, ord, row_number() OVER (PARTITION BY track_id ORDER BY ord) AS p, count(*) OVER (PARTITION BY track_id) AS c FROM sponsor),
        u AS (SELECT track_id, id, row_number() OVER (PARTITION BY track_id ORDER BY time) AS p FROM ui)
        SELECT u.track_id, u.id AS slot_id, coalesce(k.sponsor_id, n.sponsor_id) AS sponsor_id FROM u JOIN n ON n.track_id = u.track_id AND n.p = least(u.p, n.c) LEFT JOIN n k ON k.track_id = u.track_id AND u.track_id % 2 = 0 AND k.ord = 2 AND u.id = 'slot-1'""",
    "m1_splice_pieces": """SELECT track_id, slot, o AS ord, CASE o WHEN 1 THEN 'ad' ELSE 'main' END AS kind, CASE o WHEN 2 THEN at_ms ELSE 0 END AS src_start_ms, CASE o WHEN 0 THEN at_ms WHEN 1 THEN ad_ms ELSE duration_ms END AS src_end_ms
        FROM (SELECT track_id, ord AS slot, greatest(0, least(at_ms, coalesce(duration_ms, at_ms))) AS at_ms, ad_ms, duration_ms FROM ads JOIN episodes USING (track_id)), range(0, 3) r(o)""",
    "m1_splice_preview": """SELECT track_id, slot, o AS ord, CASE o WHEN 1 THEN 'ad' ELSE 'main' END AS kind, CASE o WHEN 0 THEN greatest(0, at_ms - 3000) WHEN 1 THEN 0 ELSE at_ms END AS src_start_ms, CASE o WHEN 0 THEN at_ms WHEN 1 THEN ad_ms ELSE least(coalesce(duration_ms, at_ms + 3000), at_ms + 3000) END AS src_end_ms
        FROM (SELECT track_id, ord AS slot, greatest(0, least(at_ms, coalesce(duration_ms, at_ms))) AS at_ms, ad_ms, duration_ms FROM ads JOIN episodes USING (track_id)), range(0, 3) r(o)""",
    "m2_timeline": """WITH a AS (SELECT ads.*, duration_ms, row_number() OVER (PARTITION BY track_id ORDER BY at_ms, ord DESC) AS k FROM ads JOIN episodes USING (track_id)),
        b AS (SELECT a.*, coalesce((SELECT sum(ad_ms) FROM a x WHERE x.track_id = a.track_id AND x.k < a.k), 0)::BIGINT AS pre, coalesce((SELECT max(at_ms) FROM a x WHERE x.track_id = a.track_id AND x.k < a.k), 0) AS prev FROM a)
        SELECT track_id, (2 * k - 2)::INT AS ord, 'main' AS kind, prev AS src_start_ms, at_ms AS src_end_ms, prev + pre AS out_start_ms FROM b
        UNION ALL SELECT track_id, (2 * k - 1)::INT, 'ad', 0, ad_ms, at_ms + pre FROM b
        UNION ALL SELECT track_id, (2 * max(k))::INT, 'main', max(at_ms), any_value(duration_ms), (max(at_ms) + sum(ad_ms))::BIGINT FROM b GROUP BY track_id""",
    "m3_overlay_gain": f"""WITH x AS (
        SELECT track_id, frame_idx AS o, amp * {_fall('frame_idx', 'q', 'c1')} * {_fall('frame_idx', 'm', 'c2')} AS amp FROM frames JOIN mix USING (track_id) WHERE frame_idx < q
        UNION ALL SELECT track_id, q - c1 + j, amp * pow(10, -6 / 20.0::DOUBLE) * {_ramp('j', '1')} * {_ramp('l - 1 - j', '1')} * {_ramp('j', 'c1')} * {_fall('q - c1 + j', 'm', 'c2')} FROM (SELECT *, frame_idx - q AS j FROM frames JOIN mix USING (track_id)) WHERE j >= 0 AND j < l
        UNION ALL SELECT track_id, m - c2 + k, amp * {_ramp('k', 'c2')} FROM (SELECT *, frame_idx - q - l AS k FROM frames JOIN mix USING (track_id)) WHERE k >= 0
        UNION ALL SELECT track_id, q - c1 + i, amp * {_ramp('i', '2')} * {_ramp('ad - 1 - i', '2')} * {_ramp('i', 'c1')} * {_fall('q - c1 + i', 'm', 'c2')} FROM promo JOIN mix USING (track_id) WHERE i < l)
        SELECT track_id, o AS out_idx, round(sum(amp), 6) AS amp FROM x GROUP BY track_id, o
        UNION ALL SELECT track_id, frame_idx, round(amp, 6) FROM frames WHERE track_id NOT IN (SELECT track_id FROM mix)""",
    "m4_audit": """SELECT track_id, round(duration_s + 2, 6) AS expected_s, CASE WHEN track_id % 5 <> 1 THEN round(duration_s + 2 + CASE WHEN track_id % 3 = 0 THEN 0.25 ELSE 0.05 END, 6) END AS actual_s,
        CASE WHEN duration_s IS NULL OR track_id % 5 = 1 THEN 'unknown' WHEN track_id % 3 = 0 THEN 'false' ELSE 'true' END AS match FROM episodes""",
    "m4_audit_preview": """SELECT track_id, round(e, 6) AS expected_s, round(a, 6) AS actual_s, CASE WHEN a IS NULL THEN 'unknown' WHEN abs(a - e) < 0.1::DOUBLE THEN 'true' ELSE 'false' END AS match FROM
        (SELECT track_id, greatest(0.0::DOUBLE, least(coalesce(duration_s, 8.0::DOUBLE), mid + 3) - greatest(0.0::DOUBLE, mid - 3)) + 2 AS e, CASE WHEN track_id % 5 <> 1 THEN 8 + CASE WHEN track_id % 3 = 0 THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END END AS a
         FROM (SELECT *, coalesce(duration_s / 2, 5.0::DOUBLE) AS mid FROM episodes))""",
    "m4_audit_summary": """SELECT match, count(*) AS n, round(max(d), 6) AS worst_s FROM (SELECT CASE WHEN duration_s IS NULL OR track_id % 5 = 1 THEN 'unknown' WHEN track_id % 3 = 0 THEN 'false' ELSE 'true' END AS match,
        CASE WHEN duration_s IS NULL OR track_id % 5 = 1 THEN NULL WHEN track_id % 3 = 0 THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END AS d FROM episodes) GROUP BY match""",
    "m5_room_tone_bed": """WITH b AS (SELECT track_id, amp, row_number() OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS k, count(*) OVER (PARTITION BY track_id) AS n FROM frames JOIN fslots USING (track_id) WHERE mode = 'podcast' AND frame_idx < mid AND frame_idx >= mid - 6)
        SELECT track_id, i, round(q.amp + coalesce((SELECT b.amp FROM b WHERE b.track_id = q.track_id AND b.k = q.i % b.n) * pow(10, -26 / 20.0::DOUBLE), 0), 6) AS amp FROM promo q""",
    "m5_room_tone_two_speakers": """WITH b AS (SELECT track_id, amp, row_number() OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS k, count(*) OVER (PARTITION BY track_id) AS n FROM frames JOIN fslots USING (track_id) WHERE frame_idx < mid AND frame_idx >= mid - 6)
        SELECT track_id, i, round(q.amp + coalesce((SELECT b.amp FROM b WHERE b.track_id = q.track_id AND b.k = q.i % b.n) * pow(10, -26 / 20.0::DOUBLE), 0), 6) AS amp FROM promo q""",
    "r1_extract_terms": "SELECT track_id, ord::INT AS ord, term FROM terms",
    "r2_match_products": r"""WITH a AS (SELECT DISTINCT term, unnest(list_distinct(string_split(lower(term), ' '))) AS w FROM terms), h AS (SELECT p_partkey AS key, p_name AS title, unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part),
        o AS (SELECT term, key, title, count(*) AS n FROM a JOIN h USING (w) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, key) AS rank FROM o)
        SELECT track_id, ord::INT AS ord, term, rank::INT AS rank, key, title FROM terms JOIN k USING (term) WHERE rank <= 3""",
}


def _with_views(sql: str) -> str:
    """`sql` with the views it needs, and those they need, before it."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                need(VIEWS[name])

    need(sql)
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    rest = re.match(r"WITH (.*)", sql, re.S)
    if not views:
        return sql
    return f"WITH RECURSIVE {views}{', ' + rest[1] if rest else ' ' + sql}"


_TAIL = " || ' '".join(f" || '{c}' || {{k}} % {n}" for c, n in (("s", 7), ("c", 11), ("d", 13), ("e", 17), ("f", 19), ("g", 101)))

_SQL |= {
    "s2_scan_payloads": """WITH b AS (SELECT p_partkey AS k, (p_partkey % 16)::INT AS file, CASE WHEN p_partkey % 11 = 0 THEN '{' ELSE '{"track_id": ' || p_partkey || ', ' END || '"mode": "' || p_name || CASE WHEN p_partkey % 16 = 3 THEN repeat('x', 20000) ELSE '' END || '"}' AS body FROM part),
        l AS (SELECT k, file, CASE WHEN k % 13 = 0 THEN '' WHEN k % 7 = 0 THEN substring(body, 1, 20) ELSE body END AS line FROM b),
        o AS (SELECT *, strlen(line) AS n, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY file ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at, (sum(strlen(line) + 1) OVER (PARTITION BY file))::BIGINT AS whole FROM l)
        SELECT DISTINCT file, NULL::BIGINT AS track_id, 0::BIGINT AS line_offset, whole AS n_bytes, 'over the size limit' AS reason FROM o WHERE whole > 1000000
        UNION ALL SELECT file, CASE WHEN ends_with(line, '"}') AND k % 11 <> 0 THEN k END, "at", n, CASE WHEN NOT ends_with(line, '"}') THEN 'not JSON' WHEN k % 11 = 0 THEN 'no track_id' END FROM o WHERE whole <= 1000000 AND line <> ''""".replace(" AS at,", ' AS "at",'),
    "s3_report_sink": _SQL["s3_slot_report"],
    "c8_select_separated_rounds": _SQL["c8_select_separated"],
    "r2_match_long_titles": rf"""WITH q AS (SELECT s_suppkey AS track_id, CASE s_suppkey % 3 WHEN 0 THEN 'small red economy the lot ' {_TAIL.format(k="s_suppkey")} WHEN 1 THEN 'lot c' || s_suppkey % 11 ELSE 'the lot ' {_TAIL.format(k="s_suppkey")} END AS term FROM supplier),
        c AS (SELECT p_partkey AS key, p_name || ' ' || p_type || ' the lot ' {_TAIL.format(k="p_partkey")} AS title FROM part),
        a AS (SELECT DISTINCT term, unnest(list_distinct(string_split(lower(term), ' '))) AS w FROM q), h AS (SELECT key, title, unnest(list_distinct(string_split(lower(title), ' '))) AS w FROM c),
        o AS (SELECT term, key, title, count(*) AS n FROM a JOIN h USING (w) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, key) AS rank FROM o)
        SELECT track_id, 1 AS ord, term, rank::INT AS rank, key, title FROM q JOIN k USING (term) WHERE rank <= 3""",
    "f8_weighted_loudness": "SELECT g.track_id, \"at\", round(target_lufs, 6) AS target_lufs, round(before_lufs, 6) AS before_lufs, round(target_lufs - before_lufs, 6) AS gain_db, round(coalesce(a.l, -70), 6) AS after_lufs FROM wgains g LEFT JOIN wafter a USING (track_id)",
    # other forms of operators above
    **{name: _SQL[of] for name, of in (("f1_frame_rms_blocks", "f1_frame_rms"), ("f7_peak_envelope_blocks", "f7_peak_envelope"), ("m3_overlay_gain_blocks", "m3_overlay_gain"), ("m5_room_tone_bed_blocks", "m5_room_tone_bed"),
                                       *((f"{of}_scan", of) for of in ("c5_collapse_near", "f4_quiet_runs", "f6_snap_to_beat", "t3_transcript_rollup", "k2_sample_budget", "m2_timeline")))},
}

ORACLES = {name: _with_views(sql) for name, sql in _SQL.items()}
