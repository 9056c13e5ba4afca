"""Catalogue tables derived from general tables, so that every operator has input at any scale.

There is no audio among the given tables. Transcripts come from documents (12-word chunks, 400 ms a word), frames
from events, speaker turns from conversations, products and model answers from parts, sponsors from suppliers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import by_track, ends_sentence
from .operators import candidates as c
from .operators import frames as f
from .plans import analyse_slots
from .sources import episodes as resolve
from .storage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Catalogue:
    """The derived tables of one folder; each is a plan that nothing runs until it's used, but for three that others
    start from: the marks of the transcripts, the episodes and the slots are stored at their first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._held: dict[str, DataFrame] = {}

    def _stored(self, name: str, df: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._held:
            self._held[name] = cut(df())
        return self._held[name]

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def segments(self) -> DataFrame:
        # a match is twelve words with what stands between them, so words aren't split and joined one by one
        chunks = F.regexp_extract_all("text", F.lit("[^ \t\n\r]+(?:[ \t\n\r]+[^ \t\n\r]+){0,11}"), F.lit(0))
        rows = self._table("documents").select(F.col("doc_id").alias("track_id"), F.posexplode(chunks).alias("seg_idx", "said"))
        said = F.when(F.col("said").rlike("  |[\t\n\r]"), F.regexp_replace("said", "[ \t\n\r]+", " ")).otherwise(F.col("said"))
        rows = rows.select("track_id", "seg_idx", said.alias("text"), (F.col("seg_idx").cast("long") * 12).alias("o"))
        n = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
        rows = rows.select("track_id", "seg_idx", "text", (F.col("o") * 400).alias("start_ms"), F.greatest(F.col("o") * 400 + 100, (F.col("o") + n) * 400 - ((F.col("seg_idx") * 7 + F.col("track_id")) % 10) * 100).alias("end_ms"))
        return rows.select("*", (F.col("start_ms") / F.lit(1000.0)).alias("start_s"), (F.col("end_ms") / F.lit(1000.0)).alias("end_s"))

    def transcripts(self) -> DataFrame:
        """All segments with their texts, stored; taken for the marks too by a query that needs both."""
        return self._stored("transcripts", self.segments)

    def marks(self) -> DataFrame:
        """All segments, but with the texts of only those that end a sentence: what placing an ad needs of them."""
        if "transcripts" in self._held:
            return self._held["transcripts"]
        return self._stored("marks", lambda: self.segments().withColumn("text", F.when(ends_sentence(F.col("text")), F.col("text"))))

    def raw_episodes(self) -> DataFrame:
        length = self.marks().groupBy("track_id").agg(F.max("end_ms").alias("len"))
        t = F.col("track_id")
        return length.select(
            "track_id", F.when(t % 3 == 0, " SONG ").otherwise("talk").alias("mode"),
            F.when(t % 4 == 1, -1.0).when(t % 4 == 2, float("nan")).when(t % 4 == 3, F.col("len") / F.lit(1000.0)).alias("probe_s"),
            F.when(t % 10 != 0, F.col("len")).alias("analysis_ms"),
        )

    def with_tempo(self) -> DataFrame:
        """Episodes with the tempo that an analysis finds in songs."""
        t = F.col("track_id")
        return self.episodes().withColumn("tempo", F.when(t % 3 == 0, (90 + t % 60).cast("double")))

    def episodes(self) -> DataFrame:
        return self._stored("episodes", lambda: resolve(self.raw_episodes()))

    def lengths(self) -> DataFrame:
        return self.episodes().select("track_id", "duration_s", F.round(F.col("duration_s") * 1000).cast("long").alias("duration_ms"))

    def silences(self) -> DataFrame:
        ahead = F.lead("start_ms").over(by_track("seg_idx"))
        return self.marks().select("track_id", F.col("end_ms").alias("start_ms"), ahead.alias("end_ms")).where("end_ms - start_ms >= 500")

    def silence_cands(self) -> DataFrame:
        c = f.silence_candidates(self.silences(), None)
        return c.select("track_id", F.row_number().over(by_track("ms")).alias("seq"), "ms", "silence_ms", F.lit("").alias("snippet"))

    def boundaries(self) -> DataFrame:
        return c.boundary_candidates(self.marks(), self.episodes())

    def merged(self) -> DataFrame:
        return c.collapse_near(self.silence_cands(), self.boundaries())

    def scored(self) -> DataFrame:
        return c.score(c.fill_empty(self.episodes(), self.merged()), self.episodes())

    def slots(self) -> DataFrame:
        return self._stored("slots", lambda: analyse_slots(self.episodes(), self.silence_cands(), self.marks()))

    def numbered(self) -> DataFrame:
        at = F.row_number().over(by_track("ts", "event_id")).cast("long") - 1
        e = self._table("events").select(F.col("user_id").alias("track_id"), "ts", "event_id", "value")
        return e.select("track_id", at.alias("frame_idx"), F.col("value").alias("amp"))

    def store_frames(self) -> None:
        """For a query that starts from the frames several times: they are numbered once and stored."""
        self._stored("frames", self.numbered)

    def frames(self) -> DataFrame:
        rows = self._held["frames"] if "frames" in self._held else self.numbered()
        return rows.select("track_id", "frame_idx", (F.col("frame_idx") * 100).alias("t_ms"), "amp", (F.col("amp") * F.col("amp")).alias("ms_power"))

    def samples(self) -> DataFrame:
        return self.frames().select("track_id", F.col("frame_idx").alias("i"), "amp")

    def stereo(self, mono: DataFrame) -> DataFrame:
        """samples(track_id, i, amp) and a second channel at another level, whose every third sample is silent."""
        second = (F.col("i") % 3 - 1) / F.lit(2.0)
        return mono.select("track_id", "i", F.posexplode(F.array("amp", F.col("amp") * second)).alias("channel", "amp"))

    def beats(self) -> DataFrame:
        return self.frames().where("frame_idx % 7 = 3 AND track_id % 11 <> 0").select("track_id", F.col("t_ms").alias("beat_ms"))

    def frame_slots(self) -> DataFrame:
        """One slot in the middle of every frame track."""
        mode = F.when(F.col("track_id") % 3 == 0, "song").otherwise("podcast")
        return self.frames().groupBy("track_id").agg(F.expr("max(frame_idx) div 2").alias("at")).select("track_id", mode.alias("mode"), "at", (F.col("at") * 100).alias("ms"))

    def promo(self) -> DataFrame:
        """An ad for every track but each thirteenth, on the level of its own first frames: of 4 to 43 frames, so it may
        reach past the track's end."""
        none = F.col("track_id") % 13 == 5
        return self.samples().where(~none & (F.col("i") < 4 + F.col("track_id") * 5 % 40)).select("track_id", "i", (F.col("amp") / 4).alias("amp"))

    def turns(self) -> DataFrame:
        dur = F.coalesce(F.length("text"), F.lit(0)).cast("long") * 60
        t = self._table("conversations").select(F.col("conv_id").alias("track_id"), F.col("turn").cast("int").alias("turn_idx"), F.col("role").alias("label"), dur.alias("dur"))
        end = F.sum("dur").over(by_track("turn_idx"))
        return t.select("track_id", "turn_idx", "label", (end - F.col("dur")).alias("start_ms"), end.alias("end_ms"))

    def products(self) -> DataFrame:
        k = F.col("p_partkey")
        return self._table("part").select(
            k.alias("track_id"), F.when(k % 2 == 0, "song").otherwise("podcast").alias("mode"), F.col("p_name").alias("name"), F.col("p_type").alias("blurb"),
            F.when(k % 4 == 0, F.concat(F.lit("https://shop.example/"), k.cast("string"))).alias("url"),
            F.when(k % 3 == 0, "A_ONLY").when(k % 3 == 1, "B_ONLY").otherwise("DUO").alias("ad_mode"),
        )

    def _wrapped(self, body: Column) -> Column:
        k = F.col("p_partkey")
        return (
            F.when(k % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 4 == 1, body)
            .when(k % 4 == 2, F.concat(F.lit("Sure: "), body, F.lit(" Done."))).otherwise(F.concat(F.lit("no json "), k.cast("string")))
        )

    def choice_answers(self) -> DataFrame:
        k = F.col("p_partkey")
        index = F.element_at(F.array(*map(F.lit, ("0", "2", "null", "1.5", '"3"'))), (k % 5 + 1).cast("int"))
        body = F.concat(F.lit('{"promo_text": " Try '), "p_name", F.lit(' ", "chosen_index": '), index, F.lit(', "rationale": " r'), k.cast("string"), F.lit('"}'))
        return self._table("part").select(k.alias("track_id"), self._wrapped(body).alias("raw_text"))

    def script_answers(self) -> DataFrame:
        k = F.col("p_partkey")
        last = F.when(k % 5 == 0, " ").otherwise(F.col("p_type"))
        body = F.concat(F.lit('{"segments": [{"speaker": " a ", "text": "Hi '), "p_name", F.lit('"}, 5, {"speaker": "C", "text": "x"}, {"speaker": "B", "text": "'), last, F.lit('"}]}'))
        return self._table("part").select(k.alias("track_id"), self._wrapped(body).alias("raw_text"))

    def term_answers(self) -> DataFrame:
        k = F.col("p_partkey")
        first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
        products = F.concat(F.lit('{"products": [{"term": "'), second, F.lit('"}, {"term": ""}, {"term": "'), first, F.lit('"}, {"term": "'), second, F.lit('"}]}'))
        terms = F.concat(F.lit('{"terms": ["'), "p_name", F.lit('", "", "'), first, F.lit('", "'), second, F.lit('", "p'), k.cast("string"), F.lit('"]}'))
        return self._table("part").select(k.alias("track_id"), F.when(k % 3 == 0, products).when(k % 3 == 1, terms).otherwise("{broken").alias("raw_text"))

    def sponsors(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self._table("supplier").select(
            F.expr("s_suppkey div 3").alias("track_id"), (k % 3).cast("int").alias("ord"), F.when(k % 5 != 0, F.concat(F.lit("sp"), k.cast("string"))).alias("id"),
            F.when(k % 4 != 0, F.col("s_name")).alias("name"), F.when(k % 8 == 0, F.lit(" Brand ")).alias("brand"),
            F.when(k % 6 == 0, F.lit("a quiet tool")).alias("product_desc"), F.when(k % 2 != 0, F.concat(F.lit(" Say "), k.cast("string"), F.lit(" "))).alias("statement"),
        )

    def ad_parts(self) -> DataFrame:
        return self.turns().select("track_id", F.col("turn_idx").alias("line_idx"), F.col("label").alias("speaker"), ((F.col("end_ms") - F.col("start_ms")) % 9000 + 500).alias("dur_ms"))

    def catalogue(self) -> DataFrame:
        return self._table("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("source"))

    @staticmethod
    def _long(*first: Column | str, k: Column) -> Column:
        """A text of eleven words or so: what all have, what many share, what few share."""
        return F.concat_ws(" ", *first, F.lit("the lot"), *[F.concat(F.lit(c), (k % n).cast("string")) for c, n in (("s", 7), ("c", 11), ("d", 13), ("e", 17), ("f", 19), ("g", 101))])

    def long_terms(self) -> DataFrame:
        """A short, a middle and a long term for each supplier."""
        k = F.col("s_suppkey")
        text = F.when(k % 3 == 0, self._long(F.lit("small red economy"), k=k)).when(k % 3 == 1, F.concat(F.lit("lot c"), (k % 11).cast("string"))).otherwise(self._long(k=k))
        return self._table("supplier").select(k.alias("track_id"), F.lit(1).alias("ord"), text.alias("term"))

    def long_titles(self) -> DataFrame:
        return self._table("part").select(F.col("p_partkey").alias("key"), self._long("p_name", "p_type", k=F.col("p_partkey")).alias("title"))

    def payload_lines(self) -> DataFrame:
        """Lines of 16 files: payloads, lines cut short, lines without a track, blank ones; one file has very long lines.

        A file's lines are in one task, in order; they are made after the sort, which holds only their numbers and names."""
        k, file = F.col("p_partkey"), F.col("file")
        light = self._table("part").select((k % 16).cast("int").alias("file"), "p_partkey", "p_name").repartition(16, "file").sortWithinPartitions("file", "p_partkey")
        body = F.concat(F.when(k % 11 == 0, F.lit("{")).otherwise(F.concat(F.lit('{"track_id": '), k.cast("string"), F.lit(", "))), F.lit('"mode": "'), "p_name", F.when(file == 3, F.repeat(F.lit("x"), F.lit(20_000))).otherwise(""), F.lit('"}'))
        line = F.when(k % 13 == 0, "").when(k % 7 == 0, F.substring(body, 1, 20)).otherwise(body)
        return light.select("file", k.alias("n"), line.alias("line"))

    def payloads(self) -> DataFrame:
        """Analysis payloads: numbers as numbers and as strings, other names of the place, bad elements, broken JSON."""
        c = self.silence_cands()
        ms, n = F.col("ms").cast("string"), F.col("seq")
        place = (
            F.when(n % 5 == 0, F.concat(F.lit('{"mid_ms": "'), ms, F.lit('"'))).when(n % 5 == 1, F.concat(F.lit('{"ms": '), ms))
            .when(n % 5 == 2, F.concat(F.lit('{"time_ms": '), ms, F.lit(".4"))).when(n % 5 == 3, F.concat(F.lit('{"mid_ms": '), ms)).otherwise(F.lit('{"mid_ms": "x"'))
        )
        item = F.concat(place, F.lit(', "silence_ms": '), F.col("silence_ms").cast("string"), F.lit("}"))
        snippet = F.when(n % 3 == 0, F.concat(F.lit('"'), ms, F.lit('": " said at '), ms, F.lit('. "')))
        joined = lambda col: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(col.isNotNull(), F.struct(n.alias("n"), col.alias("x"))))), lambda s: s["x"]), ", ")
        whole = c.groupBy("track_id").agg(joined(item).alias("items"), joined(snippet).alias("texts"))
        text = F.concat(F.lit('{"mode": "podcast", "candidates": ['), "items", F.lit('], "snippets": {'), "texts", F.lit("}}"))
        return whole.select("track_id", F.when(F.col("track_id") % 9 == 0, F.substring(text, 1, 40)).otherwise(text).alias("payload"))
