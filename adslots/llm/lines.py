"""Removal of lines that many documents share, as keep bitmaps.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least `min_length` code points
that stand in at least `min_docs` documents lose all their lines but those of the largest doc_id that holds one.

Every line with a long enough key becomes a row of fixed size (two hashes of the key, 96 bits; doc_id; a hash of the
text; position), stored once. Rows are ranged by hash and sorted inside each range by document, the largest first, and
position, so that a window streams over each key: its first row is the occurrence that stays, a change of document
counts one. Rows that go come back to their documents as bitmaps: words of 63 lines, of which only those with a bit set
are kept. The texts themselves are shuffled once, to meet their bitmaps, and not at all by `keep_bitmaps`.

A key with more than one in `HOT_SHARE` of all rows (so there are at most `HOT_SHARE` of them, whatever the input) would
make one range too long. Such keys are found by exact counts, first of hash buckets, then of the keys in full buckets;
their counts and largest documents come from aggregates that are combined before they are shuffled, and their rows are
decided where they are, against a broadcast of at most `HOT_SHARE` rows.

Defined cases: a null or empty text is one empty line; a document is a doc_id, so rows that repeat one count once and
keep their lines together, each with a bitmap of its own if their texts differ; a null doc_id is a document and comes
before all others; the lines of a key that stands several times in the document that keeps it all stay; an empty
table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, lower_ascii

MIN_LENGTH, MIN_DOCS = 20, 3
#: Fixed value: the white space that a key has none of at its ends.
SPACES = " \t\n\x0b\x0c\r"
#: Hot keys have more than one in so many of all rows. Buckets in which rows are counted to find them.
HOT_SHARE, BUCKETS = 10_000, 1 << 16
#: Lines in a word of a bitmap: one bit less than a long has, so that no word is negative.
WORD = 63

_KEY = ["h1", "h2"]
_TEXT = ["doc_id", "text_hash"]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def line_rows(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(h1, h2, doc_id, text_hash, pos) of every line whose key is long enough."""
    lines = docs.select("doc_id", F.xxhash64(_text()).alias("text_hash"), F.posexplode(F.split(_text(), "\n")).alias("pos", "line"))
    keys = lines.select(*_TEXT, "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_length)
    return keys.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), *_TEXT, "pos")


def _hot(rows: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, top): the documents of the hot keys, and the largest; at most HOT_SHARE rows, stored."""
    bucket = F.pmod("h1", F.lit(BUCKETS))
    (total,) = rows.agg(F.count(F.lit(1))).first()
    many = F.col("n") * HOT_SHARE > total
    full = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where(many)
    suspects = rows.join(F.broadcast(full), bucket == F.col("bucket"), "left_semi")
    keys = suspects.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where(many).select(*_KEY)
    found = rows.join(F.broadcast(cut(keys)), _KEY, "left_semi").groupBy(*_KEY, "doc_id").agg(F.lit(1).alias("one"))
    return cut(found.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top")))


def dropped_lines(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, pos) of the lines that go."""
    rows = cut(line_rows(docs, min_length))
    hot = F.broadcast(_hot(rows))
    goes = (F.col("n_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("top"))
    of_hot = rows.join(hot, _KEY).where(goes)

    by_document = [F.col("doc_id").desc_nulls_last()]
    ranged = rows.join(hot, _KEY, "left_anti").repartitionByRange(*_KEY).sortWithinPartitions(*_KEY, *by_document, "pos")
    of_key = W.partitionBy(*_KEY)
    streamed = ranged.withColumn("nth", F.dense_rank().over(of_key.orderBy(*by_document)))
    counted = streamed.withColumn("n_docs", F.max("nth").over(of_key))
    return of_hot.select(*_TEXT, "pos").unionByName(counted.where((F.col("n_docs") >= min_docs) & (F.col("nth") > 1)).select(*_TEXT, "pos"))


def keep_bitmaps(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, n_dropped, words) of every text that loses lines: of the bitmap's words of WORD lines, in
    order, those with lines that go, as (word, bits); a line stays if its word isn't there or its bit is 0."""
    bit = F.expr(f"shiftleft(1L, cast(pos % {WORD} as int))")
    gone = dropped_lines(docs, min_length, min_docs).select(*_TEXT, F.expr(f"cast(pos div {WORD} as int)").alias("word"), bit.alias("bit")).repartition(*_TEXT)
    words = gone.groupBy(*_TEXT, "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy(*_TEXT).agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def _kept(words: Column, lines: Column) -> Column:
    """The lines whose bit isn't set. The words that were left out are put back first, so that each line looks its word up
    by its place."""
    before = lambda i: F.coalesce(F.get(words, i - 1)["word"], F.lit(-1))
    whole = F.flatten(F.transform(words, lambda w, i: F.concat(F.array_repeat(F.lit(0).cast("long"), w["word"] - before(i) - 1), F.array(w["bits"]))))

    def stays(bits: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            return F.getbit(F.coalesce(F.get(bits, F.floor(i / WORD).cast("int")), F.lit(0).cast("long")), i % WORD) == 0

        return F.filter(lines, one)

    return F.get(F.transform(F.array(whole), stays), F.lit(0))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, kept_text) of every document."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(_text()).alias("text_hash")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.text_hash") == F.col("b.text_hash"))
    met = own.join(bitmaps.alias("b"), same, "left")
    text = F.coalesce(F.col("d.text"), F.lit(""))
    return met.select(
        "d.doc_id", "d.text", (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long").alias("n_lines"), F.coalesce("b.n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("b.n_dropped").isNull(), text).otherwise(F.array_join(_kept(F.col("b.words"), F.split(text, "\n")), "\n")).alias("kept_text"),
    )


def dedup_lines(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, kept_text) of every document."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_length, min_docs))
