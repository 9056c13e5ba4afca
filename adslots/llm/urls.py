"""URL filters: explicit rules, and templates learned from labelled URLs.

Per host, paths form a tree of segments, to each path's full depth, which is generalised level by level: what stands
below branches that were merged is one set of branches at the next level. Segments that vary become wildcards: numbers and long
hexadecimal strings at once, names seen fewer than MIN_SUPPORT times at their place, and names whose branch is
statistically similar to its siblings of the same kind, which are merged into one. A branch is of one kind if half of its
URLs or more go on with a number, of the other if not. Similar means that neither that share nor the share of bad
labels differs from that of the siblings of the kind together (chi-square test of a 2x2 table, CHI2); a branch without
labels gives no evidence of a difference, so it joins siblings that are built alike and shares their labels. A path's segments, so generalised, are its template. A template is rejected if its share of bad
labels, smoothed towards its host's and that towards all hosts' with a weight of SMOOTH labels, is PURITY or more, on
at least MIN_LABELLED labels that are at least COVERAGE of its URLs.

DataFrame functions only. URLs are first aggregated to distinct (host, shape of path) pairs; the tree is built on
that table, a round for each level that branches (what all paths of a set begin with is passed over at once), and joined
back. Sums over branches and siblings are aggregated and joined, so a
host or directory with very many entries is never in one task. A path leaves the rounds where fewer than MIN_SUPPORT URLs
share what it's generalised to so far: all its names below are wildcards.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is allowed; an
empty table gives an empty result; repeated rows are judged alike and counted each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, lower_ascii

#: Fixed values of the contract: verdict, host and path prefix.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
MIN_SUPPORT, MIN_LABELLED, COVERAGE = 3, 5, 0.5
CHI2, SMOOTH, PURITY = 6.63, 4.0, 0.8


def with_parts(urls: DataFrame) -> DataFrame:
    """`urls` with host and path."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    whole = F.coalesce(rest, F.lit(""))
    return urls.withColumn("host", lower_ascii(F.regexp_extract(whole, "^[^/?#]*", 0))).withColumn("path", F.regexp_extract(whole, "^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. The rules are an expression: a short list."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest comes last and wins
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(say)).otherwise(verdict)
    return found, verdict


def shape(segment: Column) -> Column:
    return (
        F.when(segment.rlike("^[0-9]+$"), F.lit("#"))
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z]+$"), F.concat(F.lit("#"), F.regexp_extract(segment, r"\.[A-Za-z]+$", 0)))
        .when(segment.rlike("^[0-9a-fA-F-]{8,}$"), F.lit("#x"))
        .otherwise(segment)
    )


def shapes(path: Column) -> Column:
    """The shapes of the path's segments, joined again."""
    return F.array_join(F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape), "/")


def _share(bad: Column, labelled: Column, above: Column) -> Column:
    return (bad + F.lit(SMOOTH) * above) / (labelled + F.lit(SMOOTH))


def _differs(part: Column, whole: Column, all_parts: Column, all_wholes: Column) -> Column:
    """Whether a branch's share differs from that of its siblings, in the chi-square test of a 2x2 table."""
    a, b = part.cast("double"), (whole - part).cast("double")
    c, d = (all_parts - part).cast("double"), (all_wholes - whole - all_parts + part).cast("double")
    stat = (a + b + c + d) * (a * d - b * c) * (a * d - b * c) / F.nullif((a + b) * (c + d) * (a + c) * (b + d), F.lit(0.0))
    return F.coalesce(stat > F.lit(CHI2), F.lit(False))


def _names(branches: DataFrame) -> DataFrame:
    """(host, at, part, name) of the branches(host, at, part, n, lab, bad, m) of a level; at is what stands before it."""
    place = ["host", "at"]
    siblings = branches.where(~F.col("part").startswith("#")).groupBy(*place, "kind").agg(F.count(F.lit(1)).alias("k_all"), *[F.sum(c).alias(f"{c}_all") for c in ("n", "lab", "bad", "m")])
    own = _differs(F.col("m"), F.col("n"), F.col("m_all"), F.col("n_all")) | _differs(F.col("bad"), F.col("lab"), F.col("bad_all"), F.col("lab_all"))
    merged = (F.col("n") < MIN_SUPPORT) | ((F.col("k_all") > 1) & ~own)
    return branches.join(siblings, [*place, "kind"], "left").select(*place, "part", F.when(F.col("part").startswith("#"), F.col("part")).when(merged, F.lit("*")).otherwise(F.col("part")).alias("name"))


def _generalised(paths: DataFrame) -> DataFrame:
    """(id, template) of the paths(id, host, shape, n, lab, bad) that have segments, by rounds over the levels that branch."""
    joined = lambda at, parts: F.concat(at, F.array_join(F.transform(parts, lambda p: F.concat(F.lit("/"), p)), ""))
    counts, place = ["n", "lab", "bad"], ["host", "at"]
    now = cut(paths.where("shape <> ''").select("id", "host", *counts, F.split("shape", "/").alias("parts"), F.lit("").alias("at")))
    done = []
    while True:
        # what the first and the last path of a set have in common at their beginning, all of them have
        same = F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y))
        common = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")
        sets = now.groupBy(*place).agg(F.min("parts").alias("low"), F.max("parts").alias("high"), (F.sum("n") < MIN_SUPPORT).alias("few")).select(*place, "few", common.alias("common"))
        rest = F.transform("parts", lambda p: F.when(p.startswith("#"), p).otherwise(F.lit("*")))
        head, tail = F.slice("parts", F.lit(1), F.col("common")), F.slice("parts", F.col("common") + 1, F.size("parts"))
        split = cut(now.join(sets, place).select("id", "host", *counts, F.when(F.col("few"), joined("at", rest)).otherwise(joined("at", head)).alias("at"), F.when(F.col("few"), F.array().cast("array<string>")).otherwise(tail).alias("parts")))
        done.append(split.where(F.size("parts") == 0).select("id", F.col("at").alias("template")))
        part, number = F.get("parts", F.lit(0)), F.coalesce(F.get("parts", F.lit(1)).startswith("#"), F.lit(False))
        left = split.where(F.size("parts") > 0)
        branches = cut(
            left.groupBy(*place, part.alias("part")).agg(*[F.sum(c).alias(c) for c in counts], F.sum(F.when(number, F.col("n")).otherwise(0)).alias("m"))
            .withColumn("kind", 2 * F.col("m") >= F.col("n"))
        )
        named = cut(_names(branches))
        met = cut(left.withColumn("part", part).join(named, [*place, "part"]).select("id", "host", *counts, F.slice("parts", F.lit(2), F.size("parts")).alias("parts"), F.concat("at", F.lit("/"), "name").alias("at")))
        done.append(met.where(F.size("parts") == 0).select("id", F.col("at").alias("template")))
        after = cut(met.where(F.size("parts") > 0))
        for old in (now, branches, named):
            drop_cut(old)
        now = after
        if now.isEmpty():
            return reduce(DataFrame.unionByName, done)


def templates(labelled: DataFrame) -> DataFrame:
    """(host, shape, template, purity, labelled, rejected) from labelled(host, path, bad), bad null if unlabelled."""
    paths = cut(
        labelled.groupBy("host", shapes(F.col("path")).alias("shape"))
        .agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("lab"), F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("bad"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    p = cut(paths.join(_generalised(paths), "id", "left").withColumn("template", F.coalesce("template", F.lit(""))))
    leaf = p.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "lab", "bad")])
    host = leaf.groupBy("host").agg(F.sum("lab").alias("lab_h"), F.sum("bad").alias("bad_h"))
    lab, bad = host.agg(F.sum("lab_h"), F.sum("bad_h")).first()
    world = ((bad or 0) + 1) / ((lab or 0) + 2)
    levels = (
        leaf.join(host, "host").withColumn("purity", _share(F.col("bad"), F.col("lab"), _share(F.col("bad_h"), F.col("lab_h"), F.lit(world))))
        .withColumn("rejected", (F.col("purity") >= PURITY) & (F.col("lab") >= MIN_LABELLED) & (F.col("lab") >= F.lit(COVERAGE) * F.col("n")))
    )
    judged = levels.select("host", "template", "purity", F.col("lab").alias("labelled"), "rejected")
    return p.select("host", "shape", "template").join(judged, ["host", "template"])


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every row of pages(page_id, url).

    URLs that fit a rule are the labelled ones: its verdict is their label."""
    parts = with_parts(pages.select("page_id", "url"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = parts.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"))
    found = cut(templates(rows.select("host", "path", (F.col("said") == "block").alias("bad"))))
    keyed = rows.withColumn("shape", shapes(F.col("path")))
    return keyed.join(found, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("said", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template",
    )
