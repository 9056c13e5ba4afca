"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose statistic lies above a cutoff, a step of a grid. Cutoffs are chosen per stratum
(language) so that in no stratum all rules together reject more than the share ALPHA of the good documents, with
confidence 1 - DELTA over all strata:

* the labelled documents are split in two by a hash of their id. On one half, each rule takes the cutoff with the largest
  gain, the share of bad documents rejected less the share of good ones, among those that reject at most ALPHA of the
  good ones; ties go to the more lenient. A rule without gain rejects nothing.
* the other half certifies all rules of a stratum at once: they are loosened by t steps together, t from STEPS down,
  and t passes if of the n good documents the rules reject k with an exact binomial tail P(Bin(n, ALPHA) <= k) of
  at most DELTA / strata (Bonferroni over strata). Testing stops at the first t that fails, so neither the number of
  steps nor that of rules needs a correction (fixed-sequence testing). The last t that passed is added to all cutoffs; a
  stratum where none passed, such as one of few labels, rejects nothing but by the base rules.

Everything is DataFrame functions: a text's statistics are computed inside its row, the labelled counts are
aggregated to one row for each stratum, rule and grid step. Windows of words are compared by 64-bit hashes inside a
text.

Defined cases: a null text has no words and fails the base rules; a null language is a stratum of its own;
of repeated labels of a document the lowest counts; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_WORD, cut

#: Fixed values of the contract: white space, symbols, least words, largest percentage of repeated words.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: At most this share of a stratum's good documents may be rejected by the rules together; confidence is 1 - DELTA.
ALPHA, DELTA = 0.02, 0.05
#: Grid steps of every rule.
STEPS = 100


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def _rules(s: Column) -> dict[str, tuple[Column, float]]:
    """name: (statistic, width of a grid step). A document is rejected if its statistic is above step * width."""
    return {
        "symbols": (_share(s["n_symbols"], s["word_chars"]), 0.01),
        "dup_lines": (_share(s["n_dup_lines"], s["n_lines"]), 0.01),
        "repeats": (_share(s["n_repeat_words"], s["n_words"]), 0.01),
        "long_words": (_share(s["word_chars"], s["n_words"]), 0.25),
        "short_words": (_share(s["n_words"], s["word_chars"]), 0.01),
    }


def statistics(text: Column) -> Column:
    """A struct of the counts of one text, built in one pass of array functions.

    Windows are sorted with their positions; a window equal to a neighbour is repeated; the words covered by
    repeated windows are the sum of steps, at most 3, between their sorted positions."""
    body = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        windows = F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
        )
        return F.struct(F.size(words).cast("long").alias("n_words"), F.sort_array(windows).alias("windows"))

    def of_windows(x: Column) -> Column:
        starts = F.array_compact(F.transform(x["windows"], lambda s, k: F.when((F.get(x["windows"], k - 1)["w"] == s["w"]) | (F.get(x["windows"], k + 1)["w"] == s["w"]), s["i"])))
        return F.struct(x["n_words"].alias("n_words"), F.sort_array(starts).alias("starts"))

    def of_starts(x: Column) -> Column:
        covered = F.aggregate(x["starts"], F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"].cast("long"))
        return F.struct(x["n_words"].alias("n_words"), covered.alias("n_repeat_words"))

    def let(value: Column, body_of) -> Column:  # the value is computed once, then used as a lambda's variable
        return F.get(F.transform(F.array(value), body_of), F.lit(0))

    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(SPACE_WORD))
    counted = let(let(let(F.regexp_extract_all(body, F.lit(SPACE_WORD), F.lit(0)), of_words), of_windows), of_starts)
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return let(
        F.struct(counted.alias("w"), of_lines.alias("l")),
        lambda x: F.struct(
            x["w"]["n_words"].alias("n_words"),
            F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            x["l"]["n_dup_lines"].alias("n_dup_lines"),
            x["w"]["n_repeat_words"].alias("n_repeat_words"),
            x["l"]["n_lines"].alias("n_lines"),
        ),
    )


def with_statistics(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """`columns` of docs and the statistics `s` of its text. Generated rows keep the optimiser from copying the
    expression into every filter that reads a count, which would compute it again for each."""
    return docs.select(*columns, F.explode(F.array(statistics(F.col("text")))).alias("s"))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def _stratum(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(""))


def _steps_above(s: Column) -> dict[str, Column]:
    """For each rule the number of grid cutoffs below the statistic."""
    return {name: F.least(F.ceil(x / F.lit(width)), F.lit(STEPS)).cast("int") for name, (x, width) in _rules(s).items()}


def _log_factorial(n: Column) -> Column:
    """ln n!: from a short table, or by Stirling's series, which is exact to double precision beyond it."""
    small = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(21)])
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    return F.when(n <= 20, F.get(small, F.least(n, F.lit(20)).cast("int"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k up to n * p, summed from its largest term down. Terms more than 13 standard deviations
    below vanish in double precision, so there are as many as the root of n * p asks for, not k."""
    first = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.lit(math.log(p)) + (n - k) * F.lit(math.log1p(-p))
    terms = F.least(k, F.ceil(13 * F.sqrt(n * F.lit(p))) + 40)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a: Column, j: Column) -> Column:  # from the term of k - j + 1 to that of k - j
        term = a["term"] * (k - j + 1) / (n - k + j).cast("double") * F.lit((1 - p) / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    tail = F.when(terms >= 1, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1)).cast("long")), start, add, lambda a: a["sum"])).otherwise(F.lit(1.0))
    return F.exp(first + F.log(tail))


def _in_first_half(doc_id: Column) -> Column:
    return F.md5(doc_id.cast("string")) < F.lit("8")


def certified_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one column of grid steps for each rule) from labelled(doc_id, stratum, good, s).

    The table holds one row for each stratum that has a certified cutoff for some rule; the others' rules reject
    nothing. A null step rejects nothing."""
    names = list(_rules(F.col("s")))
    used = cut(labelled.where(~base_failed(F.col("s"))).select("stratum", "good", _in_first_half(F.col("doc_id")).alias("chooses"), *[c.alias(name) for name, c in _steps_above(F.col("s")).items()]))
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.col(name).alias("above")) for i, name in enumerate(names)])
    counts = (
        used.where("chooses").select("stratum", "good", F.explode(rules).alias("r"))
        .groupBy("stratum", F.col("r.rule").alias("rule"), F.col("r.above").alias("above"))
        .agg(F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good"), 0).otherwise(1)).alias("bad"))
    )
    # lists of at most one entry for each grid step
    grid = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), F.sum("bad").alias("n_bad"), F.collect_list(F.struct("above", "good", "bad")).alias("at"))
    over = lambda what: F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + F.when(x["above"] > F.col("step"), x[what]).otherwise(F.lit(0)))
    tried = (
        grid.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))
        .select("stratum", "rule", "step", "n", "n_bad", over("good").alias("k"), over("bad").alias("hit"))
        .withColumn("gain", F.col("hit") / F.greatest(F.col("n_bad"), F.lit(1)) - F.col("k") / F.greatest(F.col("n"), F.lit(1)))
        .where((F.col("gain") > 0) & (F.col("k") <= F.col("n") * F.lit(alpha)))
    )
    best = tried.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "step"))["step"].alias("step"))
    chosen = cut(best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == i, F.col("step"))).alias(f"cut_{name}") for i, name in enumerate(names)]))
    strata = chosen.count()
    beyond = F.greatest(*[F.col(name) - F.col(f"cut_{name}") for name in names])
    held = used.where("good AND NOT chooses").join(F.broadcast(chosen) if strata <= 10_000 else chosen, "stratum").groupBy("stratum", beyond.alias("beyond")).agg(F.count(F.lit(1)).alias("good"))
    rejected = F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + F.when(x["beyond"] > F.col("t"), x["good"]).otherwise(F.lit(0)))
    loosened = (
        held.groupBy("stratum").agg(F.sum("good").alias("n"), F.collect_list(F.struct("beyond", "good")).alias("at"))
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(STEPS)))).select("stratum", "t", "n", rejected.alias("k"))
        .withColumn("passes", F.when(F.col("k") > F.col("n") * F.lit(alpha), False).otherwise(binomial_tail(F.col("n"), F.col("k"), alpha) <= F.lit(delta / max(strata, 1))))
        .withColumn("passes", F.min("passes").over(W.partitionBy("stratum").orderBy(F.desc("t"))))
    )
    slack = loosened.where("passes").groupBy("stratum").agg(F.min("t").alias("t"))
    return chosen.join(slack, "stratum").select("stratum", *[(F.col(f"cut_{name}") + F.col("t")).alias(name) for name in names])


def judge(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """rows(stratum, s, ...) with base_failed and kept. Cutoffs are broadcast up to 10,000 strata, else joined."""
    cutoffs = cut(cutoffs)
    small = cutoffs.count() <= 10_000
    joined = rows.join(F.broadcast(cutoffs) if small else cutoffs, "stratum", "left")
    above = _steps_above(F.col("s"))
    rejected = None
    for name, c in above.items():
        fires = F.coalesce(c > F.col(name), F.lit(False))
        rejected = fires if rejected is None else rejected | fires
    failed = F.col("base_failed")
    return joined.withColumn("base_failed", base_failed(F.col("s"))).withColumn("kept", ~failed & ~rejected).drop(*above)


def _labels(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))


def judge_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of docs(doc_id, text, lang). Texts are read once."""
    rows = cut(with_statistics(docs, "doc_id", _stratum(F.col("lang")).alias("stratum")))
    labelled = rows.join(_labels(labels), "doc_id").select("doc_id", "stratum", "good", "s")
    return judge(rows, certified_cutoffs(labelled, alpha, delta)).select("doc_id", "s.*", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of `docs` that are kept, with their columns. Rows are stored with their statistics, which are computed
    once; texts are neither shuffled nor joined."""
    rows = cut(with_statistics(docs, F.struct(*docs.columns).alias("row"), _stratum(F.col("lang")).alias("stratum")))
    labelled = rows.select(F.col("row.doc_id").alias("doc_id"), "stratum", "s").join(_labels(labels), "doc_id").select("doc_id", "stratum", "good", "s")
    return judge(rows, certified_cutoffs(labelled, alpha, delta)).where("kept").select("row.*")
