"""Related products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import by_track, field, trimmed
from ..storage import cut, drop_cut


def extract_terms(responses: DataFrame, k: int = 3) -> DataFrame:
    """(track_id, ord, term): the first k different terms of an answer's `products` list, else its `terms`."""
    v = responses.select("track_id", F.try_parse_json(trimmed("raw_text")).alias("v"))
    products, terms = F.try_variant_get("v", "$.products", "array<variant>"), F.try_variant_get("v", "$.terms", "array<variant>")
    listed = F.when(products.isNotNull(), F.transform(products, lambda p: field(p, "$.term"))).otherwise(F.transform(terms, lambda t: field(t, "$")))
    rows = v.select("track_id", F.posexplode(listed).alias("pos", "term")).where("term IS NOT NULL AND term <> ''")
    first = rows.groupBy("track_id", "term").agg(F.min("pos").alias("pos"))
    return first.withColumn("ord", F.row_number().over(by_track("pos"))).where(F.col("ord") <= k).select("track_id", "ord", "term")


#: Most sets of words of one size that a term is matched by.
MAX_SETS = 1000

#: Words of a longer term, its most common ones, whose sets are matched if no better product is found.
SET_WORDS = 8

#: Products of a set of words that terms meet one by one; sets with more grow by a word.
FEW = 256


def _sets(words: Column) -> Column:
    """All non-empty sets of the words, each as one text, in the words' order."""
    start = F.array(F.lit(""))
    return F.filter(F.aggregate(words, start, lambda acc, w: F.concat(acc, F.transform(acc, lambda x: F.concat(x, F.lit(" "), w)))), lambda x: x != "")


def _by_set(held: DataFrame, asked: DataFrame, levels: int, k: int) -> DataFrame:
    """(s, key, title, hs): for each of the asked sets of words, the k products of least key that hold all of it.

    Sets grow by one word at a time, and only into asked ones. Words come from the rarest to the most common, so what
    a frequent word could grow by is few. Of a set, each task passes on its k products."""
    sets = [held.limit(0).select(F.lit("").alias("s"), "key", "title", "hs")]
    grown = held.select("key", "title", "hs", F.posexplode("hs").alias("i", "w")).select("key", "title", "hs", "i", F.concat(F.lit(" "), "w").alias("s"))
    for level in range(levels):
        now = cut(grown.join(asked, "s", "left_semi"))
        nth = F.row_number().over(W.partitionBy("s").orderBy("key", "title"))
        sets.append(now.withColumn("nth", nth).where(F.col("nth") <= k).select("s", "key", "title", "hs"))
        after = now.where(F.col("i") < F.size("hs") - 1).withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.size("hs") - 1)))
        grown = after.select("key", "title", "hs", F.col("j").alias("i"), F.concat("s", F.lit(" "), F.get("hs", F.col("j"))).alias("s"))
    return cut(reduce(DataFrame.unionByName, sets))


def _sets_of_size(m: Column, d: Column) -> Column:
    """How many sets m words have without d of them."""
    return F.round(F.aggregate(F.sequence(F.lit(1), F.greatest(d, F.lit(1))), F.lit(1.0), lambda x, i: F.when(i > d, x).otherwise(x * (m - d + i) / i)))


def _round(t: DataFrame, h: DataFrame, k: int) -> list[DataFrame]:
    """Pairs (term, key, nth, overlap): of t(term, ws, d), the k best products that hold all of its m words but d, and others.

    Sets of words grow by one word at a time, from the rarest on, on both sides: a term's into sets that lack at most d
    of its words, a product's only into those. Where few products hold a set, its terms meet them, and nothing grows
    on; a whole set that many hold passes on its k products of least key."""
    pairs, old = [], []
    open_ = F.col("i") + F.col("skips") < F.size("ws") - 1
    asked = t.select("term", "ws", F.col("d").alias("skips"), F.lit("").alias("s"), F.lit(-1).alias("i"))
    held = h.select("key", "nth", "hs", F.posexplode("hs").alias("i", "w")).select("key", "nth", "hs", "i", F.concat(F.lit(" "), "w").alias("s"))
    while True:
        wider = asked.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("i") + 1 + F.col("skips"))))
        asked = wider.select("term", "ws", (F.col("skips") - (F.col("j") - F.col("i") - 1)).alias("skips"), F.concat("s", F.lit(" "), F.get("ws", F.col("j"))).alias("s"), F.col("j").alias("i"))
        now = cut(held.join(asked.select("s").distinct(), "s", "left_semi"))
        known = cut(asked.join(now.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "s"))
        few, products = F.col("n") <= FEW, now.select("s", "key", "nth", "hs")
        place = F.row_number().over(W.partitionBy("s").orderBy("key", "nth"))
        most = products.join(known.where(~few & ~open_).select("s").distinct(), "s", "left_semi").withColumn("place", place).where(F.col("place") <= k).drop("place")
        met = known.where(few).join(products, "s").unionByName(known.where(~few & ~open_).join(most, "s"))
        pairs.append(cut(met.select("term", "key", "nth", F.size(F.array_intersect("ws", "hs")).alias("overlap")).distinct()))
        asked = known.where(~few & open_).drop("n")
        grown = now.join(asked.select("s").distinct(), "s", "left_semi").where(F.col("i") < F.size("hs") - 1).withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.size("hs") - 1)))
        held = grown.select("key", "nth", "hs", F.col("j").alias("i"), F.concat("s", F.lit(" "), F.get("hs", F.col("j"))).alias("s"))
        for x in old:
            drop_cut(x)
        old = [now, known]
        if asked.isEmpty():
            for x in old:
                drop_cut(x)
            return pairs


def _best(t: DataFrame, h: DataFrame, k: int) -> tuple[list[DataFrame], DataFrame]:
    """Pairs (term, key, nth, overlap) with, for the terms of t(term, ws), the k products that hold most of the
    words, then of least key; and the terms that have too many sets for this.

    First all words are asked for, then all but one, all but three and so on, of the terms that haven't k products yet.
    Of the products that a term has met, the k best tell how many words are enough."""
    found: list[DataFrame] = []
    m = F.size("ws")
    left, long = t.withColumn("d", F.lit(0)), []
    for step in range(32):
        fits = _sets_of_size(m, F.col("d")) <= MAX_SETS
        long.append(left.where(~fits).select("term", "ws"))
        now = left.where(fits)
        if now.isEmpty():
            break
        found += _round(now, h, k)
        nth = F.row_number().over(W.partitionBy("term").orderBy(F.desc("overlap")))
        kth = reduce(DataFrame.unionByName, found).distinct().withColumn("n", nth).where(F.col("n") == k).select("term", F.col("overlap").alias("enough"))
        lacks = m - F.coalesce("enough", F.lit(1))
        left = cut(now.join(kth, "term", "left").where(lacks > F.col("d")).select("term", "ws", F.least(lacks, F.lit(2 ** (step + 1) - 1)).alias("d")))
    return found, cut(reduce(DataFrame.unionByName, long))


def _longest(t: DataFrame, h: DataFrame, k: int) -> list[DataFrame]:
    """Pairs (term, key, nth, overlap) for terms with too many sets: products that hold one of a term's rarest words, all
    but the last SET_WORDS, are met by word, and all others by the sets of the rest."""
    common = F.slice("ws", F.greatest(F.size("ws") - SET_WORDS, F.lit(0)) + 1, F.lit(SET_WORDS))
    rare = F.slice("ws", F.lit(1), F.greatest(F.size("ws") - SET_WORDS, F.lit(0)))
    sets = t.select("term", "ws", F.explode(_sets(common)).alias("s"))
    best = _by_set(h.withColumnRenamed("nth", "title"), sets.select("s").distinct(), SET_WORDS, k)
    size = F.size(F.split(F.ltrim("s"), " "))
    full = best.groupBy("s").agg((F.count(F.lit(1)) >= k).alias("full"))
    least = F.coalesce(F.max(F.when(F.col("full"), size)).over(W.partitionBy("term")), F.lit(0))
    by_set = sets.join(full, "s").withColumn("least", least).where(size >= F.col("least")).join(best, "s")
    by_set = by_set.withColumnRenamed("title", "nth")
    by_word = t.select("term", "ws", F.explode(rare).alias("w")).join(h.withColumn("w", F.explode("hs")), "w")
    overlap = F.size(F.array_intersect("ws", "hs")).alias("overlap")
    return [x.select("term", "key", "nth", overlap).distinct() for x in (by_set, by_word)]


def match_products(terms: DataFrame, catalogue: DataFrame, k: int = 3) -> DataFrame:
    """R2: (track_id, ord, term, rank, key, title): the k products that share most words with a term, then the
    least key. Different terms are matched once.

    A product among a term's best k, which shares the words S with it, is among the k of least key that hold S: k such
    products of less key would share as much or more, and rank before it. Where k products share all but d words, the best
    k share as many at least, and smaller sets are left out. So terms meet few products, however frequent a word is and
    however long a title.

    A term with too many sets (of more than 12 words, and without k products that share nearly all of them) meets the
    products that hold one of its rarest words by word."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    asked = terms.select("term").distinct().select("term", F.explode(F.array_distinct(words(F.col("term")))).alias("w"))
    held = catalogue.select("key", "title").distinct().select("key", "title", F.explode(F.array_distinct(words(F.col("title")))).alias("w"))
    often = cut(held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).join(asked.select("w").distinct(), "w"))
    rarest_first = F.transform(F.sort_array(F.collect_list(F.struct("n", "w"))), lambda x: x["w"])
    t = cut(asked.join(often, "w").groupBy("term").agg(rarest_first.alias("ws")))
    h = cut(held.join(often, "w").groupBy("key", "title").agg(rarest_first.alias("hs")))

    # rows that grow carry a product's key and its title's number among those of the key, not the title
    named = cut(h.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("title"))))
    found, long = _best(t, named.drop("title"), k)
    if not long.isEmpty():
        found += _longest(long, named.drop("title"), k)
    if not found:
        return terms.limit(0).join(h.limit(0), F.lit(True)).select("track_id", "ord", "term", F.lit(0).alias("rank"), "key", "title")
    pairs = reduce(DataFrame.unionByName, found).distinct()
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("term").orderBy(F.desc("overlap"), "key", "nth"))).where(F.col("rank") <= k)
    return terms.join(ranked, "term").join(named, ["key", "nth"]).select("track_id", "ord", "term", "rank", "key", "title")
