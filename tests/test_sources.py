"""Files in and reports out."""

import json
import re

import pytest
from pyspark.sql import functions as F

from adslots.fixtures import Catalogue
from adslots import sources, storage
from adslots.sources import files, reports


def test_scan(spark, tmp_path):
    good = {"track_id": 1, "candidates": [{"ms": 1500, "silence_ms": 600}], "snippets": {"1500": "é said."}}
    (tmp_path / "a.json").write_text(json.dumps(good, ensure_ascii=False) + "\n")
    second = ['{"track_id": 2, "candidates": []}', "", '{"track_id": 3, "candid', '{"mode": "song"}', "é", "   ", '{"track_id": 4}\r', '{"track_id": "x"}']
    (tmp_path / "b.jsonl").write_text("\n".join(second))
    (tmp_path / "c.json").write_bytes(b'{"track_id": 5, "x": "\xff\xfe"}')
    (tmp_path / "d.json").write_text('{"track_id": 6, "x": "' + "y" * 5000 + '"}')
    (tmp_path / "e.json").write_text("")
    sub = tmp_path / "more"
    sub.mkdir()
    (sub / "f.json").write_text('{"track_id": 7}')
    payloads, rejects = files.scan_payloads(spark, f"file://{tmp_path}", max_bytes=4000)
    read = {r.track_id: (r.file.rsplit("/", 1)[1], r.line_offset) for r in payloads.collect()}
    raw = "\n".join(second).encode()
    assert read == {1: ("a.json", 0), 2: ("b.jsonl", 0), 4: ("b.jsonl", raw.index(b'{"track_id": 4}')), 7: ("f.json", 0)}
    bad = {(r.file.rsplit("/", 1)[1], r.line_offset): (r.n_bytes, r.reason) for r in rejects.collect()}
    assert bad == {
        ("b.jsonl", raw.index(b'{"track_id": 3')): (len(second[2]), files.NOT_JSON), ("b.jsonl", raw.index(b'{"mode"')): (len(second[3]), files.NO_TRACK),
        ("b.jsonl", raw.index("é".encode())): (2, files.NOT_JSON), ("b.jsonl", raw.index(b'{"track_id": "x"}')): (len(second[7]), files.NO_TRACK),
        ("c.json", 0): ((tmp_path / "c.json").stat().st_size, files.NOT_TEXT), ("d.json", 0): ((tmp_path / "d.json").stat().st_size, files.OVERSIZED),
    }
    lengths = spark.createDataFrame([(1, 9.0)], "track_id long, duration_s double")
    found = sources.read_analysis(payloads.select("track_id", "payload"), lengths).collect()
    assert [(r.track_id, r.ms, r.silence_ms, r.snippet) for r in found] == [(1, 1500, 600, "é said.")]


def test_scan_of_nothing(spark, tmp_path):
    (tmp_path / "x.json").write_text("")
    payloads, rejects = files.scan_payloads(spark, f"file://{tmp_path}")
    assert payloads.collect() == [] and rejects.collect() == []


SCHEMA = "track_id long, duration double, slots array<struct<ms:long,label:string>>, said array<string>"


def state(spark, rows):
    return spark.createDataFrame([(k, d, [(k * 10, "a"), (k * 20, None)], ["é", ""]) for k, d in rows.items()], SCHEMA)


def back(spark, path):
    return sorted(map(tuple, reports.read_report(spark, path).select("track_id", "duration", "slots", "said").collect()))


def of(df):
    return sorted(map(tuple, df.collect()))


def test_sink(spark, tmp_path):
    """Written twice, changed, interrupted, changed again: always what was written last as a whole."""
    path = f"file://{tmp_path}/sink"
    with pytest.raises(FileNotFoundError):
        reports.read_report(spark, path)
    one = state(spark, {1: 1.0, 2: 2.5, 3: None})
    assert reports.write_report(one, path) == 3 and back(spark, path) == of(one)
    assert reports.write_report(one, path) == 0 and back(spark, path) == of(one)
    two = state(spark, {1: 1.0, 2: 9.0, 4: 4.0})  # one stays, one changes, one goes, one comes
    assert reports.write_report(two, path) == 3 and back(spark, path) == of(two)
    assert len(list((tmp_path / "sink" / "manifests").glob("*.json"))) == 2
    again = state(spark, {1: 1.0, 2: 9.0, 3: None, 4: 4.0})  # the one that was gone is back
    assert reports.write_report(again, path) == 1 and back(spark, path) == of(again)
    assert reports.write_report(state(spark, {}), path) == 4 and back(spark, path) == []
    with pytest.raises(ValueError):
        reports.write_report(one.drop("said"), path)


def test_sink_interrupted(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/sink"
    one, two = state(spark, {1: 1.0, 2: 2.5}), state(spark, {1: 7.0, 5: 5.0})
    reports.write_report(one, path)

    def fail(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(reports, "_commit", fail)
        with pytest.raises(KeyboardInterrupt):
            reports.write_report(two, path)
    assert back(spark, path) == of(one)
    assert len(list((tmp_path / "sink" / "segments").iterdir())) == 2
    assert reports.write_report(two, path) == 3 and back(spark, path) == of(two)
    assert len(list((tmp_path / "sink" / "segments").iterdir())) == 2  # what the interrupted write left is gone


def test_sink_of_two_writers(spark, tmp_path):
    """The second finds the number taken."""
    path = f"file://{tmp_path}/sink"
    reports.write_report(state(spark, {1: 1.0}), path)
    with pytest.raises(FileExistsError):
        reports._commit(reports.Folder(spark, path), 1, {})
    assert back(spark, path) == of(state(spark, {1: 1.0}))


def test_sink_compacts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reports, "COMPACT", 3)
    path = f"file://{tmp_path}/sink"
    for k in range(5):
        now = state(spark, {1: float(k), 2: 2.0})
        reports.write_report(now, path)
        assert back(spark, path) == of(now)
    assert len(reports._manifest(reports.Folder(spark, path))[1]["segments"]) == 2


def test_scopes_of_threads(spark):
    """A scope removes what its own thread stored, not what another did meanwhile."""
    import threading

    held, go, done = [], threading.Event(), threading.Event()

    def other():
        with storage.scratch(spark):
            held.append(storage.cut(spark.range(5)))
            go.set()
            done.wait(60)
            held.append(held[0].count())

    thread = threading.Thread(target=other)
    thread.start()
    with storage.scratch(spark):
        go.wait(60)
        storage.cut(spark.range(3))
    done.set()
    thread.join()
    assert held[1] == 5


def test_long_lines_are_made_after_the_sort(spark, small):
    """A task sorts the numbers and names of a file's lines, not lines of 20,000 characters."""
    plan = Catalogue(spark, small).payload_lines()._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("substring(") < plan.find("Sort [") < plan.find("Exchange")


def test_segments_are_cut_without_lists_of_words(spark, tmp_path):
    """Twelve words a segment, whatever stands between them; the plan makes no list of a text's words."""
    texts = ["", None, " \n ", "a", " a\tb\n\nc ", " ".join(f"w{i}" for i in range(24)), "\r\n".join(f"w{i}" for i in range(25)), "é\u00a0x y  z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for doc, text in enumerate(texts):
        words = [w for w in re.split("[ \t\n\r]+", text or "") if w]
        for o in range(0, len(words), 12):
            part = words[o : o + 12]
            want.add((doc, o // 12, " ".join(part), o * 400, max(o * 400 + 100, (o + len(part)) * 400 - (o // 12 * 7 + doc) % 10 * 100)))
    rows = Catalogue(spark, str(tmp_path)).segments()
    assert {tuple(r) for r in rows.select("track_id", "seg_idx", "text", "start_ms", "end_ms").collect()} == want
    assert "split(" not in rows._jdf.queryExecution().optimizedPlan().toString()
