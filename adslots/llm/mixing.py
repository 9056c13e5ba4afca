"""Mixing sources to target weights by entropy balancing.

Document rates are the ones closest to equal rates (in relative entropy, weighted by tokens) under token
constraints: each source's tokens are its target, and over the whole mix the token-weighted first and second moments of
log length stay those of the corpus, so that raising a source of long documents doesn't make the mix one of long
documents. The solution is an exponential tilt, ``rate = min(max_copies, exp(a[source] + b1 * z1 + b2 * z2))``, with
z1 the standardised log length and z2 = z1^2 - 1. The sources' constraints are exact. The moments are common to all
sources and couple them; they hold up to RIDGE * b, a ridge on the dual that gives a solution even where the targets
leave them no room (a source at its cap has one rate, max_copies).

The multipliers maximise a concave dual by Newton steps. Documents of one source and size have one rate, so they are
first counted into cells; a step is one aggregation over the cells, grouped by source. The Hessian is an arrow: the
sources' part is diagonal and stays a table, and only the five sums of its Schur complement come to the driver. Rates
are then rounded to whole copies inside small blocks of a source, largest documents first, carrying each document's
rounding error to the next one.

Defined cases: null text has size 0; a null source is a source of its own, last; sources without words get
target 0; a document of size 0 is taken 0 words; an empty table gives an empty result; repeated rows are mixed
as documents of their own (equal rows are kept once with their number, which is spread out again at the end).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORD, cut, drop_cut, running, spread

MAX_COPIES = 3
#: Documents rounded together, in one array.
BLOCK_ROWS = 512
#: Newton stops when every source's tokens, and the moments, are met to this share, or after STEPS steps; no step moves
#: a moment's multiplier by more than REACH.
TOLERANCE, STEPS, REACH = 1e-9, 25, 1.0
#: Weight of the ridge on the moments' multipliers, as a share of the mix's tokens.
RIDGE = 1e-3


def source_targets(totals: DataFrame, weights: Sequence[float], max_ratio: float) -> DataFrame:
    """Targets of a table (source, source_size): weights repeat over the sources in code-point order, null last;
    a target stops at max_ratio times the source's size and the excess is reshared by weight.

    With the sources ordered by cap / weight, the first ones are at their caps and the rest share what is left
    by weight, so one ordered pass finds the level."""
    by_name = [F.col("source").asc_nulls_last()]
    named = running(totals, by_name)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("position"), F.lit(len(weights))) + 1).cast("int"))
    weighted = named.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_ratio))).alias("cap"))
    roomed = running(weighted.withColumn("room", F.col("cap") / F.col("weight")), [F.col("room").asc(), *by_name], caps=F.col("cap"), shares=F.col("weight"))
    levels = cut(roomed)
    size, shares = levels.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(size or 0)) - F.col("caps")) / (F.lit(float(shares or 0)) - F.col("shares"))
    found = levels.where(level <= F.col("room")).agg(F.min(F.struct("room", level.alias("level")))["level"]).first()[0]
    target = F.col("cap") if found is None else F.least(F.col("cap"), F.col("weight") * F.lit(float(found)))
    return levels.select("source", "source_size", target.alias("target"))


def newton_multipliers(cells: DataFrame, targets: DataFrame, max_copies: float = MAX_COPIES, ridge: float = RIDGE, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[float]]:
    """((source, source_size, target, a), [b1, b2]): the dual's solution for cells(source, tokens, z1, z2); a is null
    for a source whose rate is fixed, at max_copies or, without a target, at 0.

    Dual: ``sum_s a_s * T_s - sum tokens * exp(a_s + b.z) - ridge * T / 2 * |b|^2``, with the rates above max_copies
    left out of the curvature. At most 10,000 sources are broadcast; more are joined."""
    free = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(max_copies * (1 - 1e-12)))
    state = cut(targets.withColumn("a", F.when(free, F.log(F.col("target") / F.col("source_size")))))
    few = state.count() <= 10_000
    goal = state.agg(F.sum("target")).first()[0] or 0.0
    b, stored = [0.0, 0.0], [state]
    for _ in range(steps):
        rates = F.coalesce(F.exp(F.col("a") + F.lit(b[0]) * F.col("z1") + F.lit(b[1]) * F.col("z2")), F.when(F.col("target") > 0, F.lit(float(max_copies))).otherwise(0.0))
        capped = (rates >= F.lit(float(max_copies))) | F.col("a").isNull()
        mass = F.col("tokens") * F.least(rates, F.lit(float(max_copies)))
        open_ = F.when(capped, F.lit(0.0)).otherwise(mass)
        terms = {"m0": mass, "m1": mass * F.col("z1"), "m2": mass * F.col("z2"), "c0": open_, "c1": open_ * F.col("z1"), "c2": open_ * F.col("z2"),
                 "c11": open_ * F.col("z1") * F.col("z1"), "c12": open_ * F.col("z1") * F.col("z2"), "c22": open_ * F.col("z2") * F.col("z2")}
        joined = cells.alias("d").join(F.broadcast(state.alias("p")) if few else state.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        sums = joined.select("p.source", "source_size", "target", "a", *[c.alias(k) for k, c in terms.items()]).groupBy("source", "source_size", "target", "a").agg(*[F.sum(k).alias(k) for k in terms])
        moments = cut(sums)
        stored.append(moments)
        # gap: what a source still needs, by log where the rates that aren't capped can take it
        gap = F.when(F.col("a").isNull() | (F.col("c0") <= 0), F.lit(0.0)).otherwise(
            F.when(F.col("target") > F.col("m0") - F.col("c0"), F.log((F.col("target") - F.col("m0") + F.col("c0")) / F.col("c0"))).otherwise(F.lit(-0.5)))
        over = F.when(F.col("c0") > 0, 1 / F.col("c0")).otherwise(F.lit(0.0))
        m1, m2, l1, l2, s11, s12, s22, worst = moments.agg(
            F.sum("m1"), F.sum("m2"), F.sum(F.col("c1") * gap), F.sum(F.col("c2") * gap),
            F.sum(F.col("c11") - F.col("c1") * F.col("c1") * over), F.sum(F.col("c12") - F.col("c1") * F.col("c2") * over), F.sum(F.col("c22") - F.col("c2") * F.col("c2") * over),
            F.max(F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(F.abs(F.col("m0") - F.col("target")) / F.col("target"))),
        ).first()
        if m1 is None:
            break
        g = [-m1 - ridge * goal * b[0], -m2 - ridge * goal * b[1]]
        if max(worst, *(abs(x) / max(goal, 1.0) for x in g)) <= tolerance:
            break
        r1, r2 = g[0] - l1, g[1] - l2
        h11, h22 = s11 + ridge * goal, s22 + ridge * goal
        det = h11 * h22 - s12 * s12
        d = [(r1 * h22 - r2 * s12) / det, (r2 * h11 - r1 * s12) / det] if det > 0 else [0.0, 0.0]
        scale = min(1.0, REACH / max(abs(d[0]), abs(d[1]), 1e-300))
        d = [x * scale for x in d]
        b = [b[0] + d[0], b[1] + d[1]]
        step = F.col("a") + F.greatest(F.least(gap - (F.lit(d[0]) * F.col("c1") + F.lit(d[1]) * F.col("c2")) * over, F.lit(4.0)), F.lit(-4.0))
        state = moments.select("source", "source_size", "target", step.alias("a"))
        if len(stored) > 2:
            drop_cut(stored.pop(0))
    return state, b


def tilt(cells: DataFrame) -> tuple[Column, Column]:
    """(z1, z2) as expressions of a size, standardised by the tokens of cells(size, tokens)."""
    x = F.log1p(F.col("size").cast("double"))
    mean, square = cells.agg(F.sum(x * F.col("tokens")) / F.nullif(F.sum("tokens"), F.lit(0)), F.sum(x * x * F.col("tokens")) / F.nullif(F.sum("tokens"), F.lit(0))).first()
    mean, square = mean or 0.0, square or 0.0
    spread_ = max(square - mean * mean, 0.0) ** 0.5
    z1 = (x - F.lit(mean)) / F.lit(spread_) if spread_ > 1e-9 else F.lit(0.0)
    return z1, (z1 * z1 - 1 if spread_ > 1e-9 else F.lit(0.0))


def round_to_copies(rated: DataFrame, max_copies: int = MAX_COPIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rated(doc_id, source, size, n, rate, source_rows, ...) with whole `copies`, at most max_copies. A row stands
    for n equal documents, and source_rows counts such rows; the result has a row for each document.

    A source is cut into hash blocks of about block_rows documents. In a block, from the largest document to the
    smallest, a document gets the copies that bring the block's tokens nearest to what its rates ask for so far;
    the error left at the end is about half a smallest document. The copies of equal documents are rounded
    together and dealt out evenly by number."""
    blocks = F.ceil(F.col("source_rows") / F.lit(float(block_rows)))
    doc = F.struct((-F.col("size")).alias("neg"), "doc_id", "rate", *[c for c in rated.columns if c not in ("doc_id", "source", "rate", "source_rows")])
    packed = (
        rated.withColumn("_block", F.pmod(F.xxhash64("doc_id", "size"), F.greatest(blocks, F.lit(1))))
        .groupBy("source", "_block").agg(F.sort_array(F.collect_list(doc)).alias("docs"))
    )

    def step(state, d):
        wanted = d["rate"] * d["size"] * d["n"] + state["error"]
        copies = F.least(F.greatest(F.round(wanted / d["size"]), F.lit(0.0)), F.lit(float(max_copies)) * d["n"])
        copies = F.when(d["size"] > 0, copies).otherwise(F.lit(0.0))
        return F.struct((wanted - copies * d["size"]).alias("error"), copies.alias("copies"))

    # the running state of every document, by one fold that appends to a list
    start = F.struct(F.lit(0.0).alias("error"), F.lit(0.0).alias("copies"))
    states = F.aggregate(
        "docs", F.array(start), lambda acc, d: F.concat(acc, F.array(step(F.element_at(acc, -1), d)))
    )
    out = packed.select("source", F.explode(F.arrays_zip(F.col("docs").alias("doc"), F.slice(states, F.lit(2), F.size("docs")).alias("state"))).alias("z"))
    groups = out.select("source", "z.doc.*", F.col("z.state.copies").cast("long").alias("_all")).drop("neg")
    each = F.expr("_all div n") + F.when(F.col("_row") < F.col("_all") % F.col("n"), 1).otherwise(0)
    return spread(groups, "source", "doc_id", "size").withColumn("copies", each.cast("int")).drop("n", "_all", "_row")


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), max_copies: int = MAX_COPIES) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for every row of docs(doc_id, source, text)."""
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"))
    rows = cut(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    cells = cut(rows.groupBy("source", "size").agg((F.sum("n") * F.col("size")).alias("tokens"), F.count(F.lit(1)).alias("rows")))
    totals = cut(cells.groupBy("source").agg(F.sum("tokens").alias("source_size"), F.sum("rows").alias("source_rows")))
    z1, z2 = tilt(cells)
    solved, b = newton_multipliers(cells.where("tokens > 0").select("source", "tokens", z1.alias("z1"), z2.alias("z2")), source_targets(totals.select("source", "source_size"), weights, max_copies), float(max_copies))
    per_source = solved.alias("p").join(totals.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")), "right").select("t.source", "p.target", "p.a", "t.source_size", "t.source_rows")
    rate = F.least(F.exp(F.col("a") + F.lit(b[0]) * z1 + F.lit(b[1]) * z2), F.lit(float(max_copies)))
    target = F.coalesce("target", F.lit(0.0))
    # rounded, so that sums taken in another order can't change a rerun's copies
    rated = (
        rows.alias("d").join(per_source.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select(
            "d.doc_id", "d.source", "d.size", "d.n", "p.source_size", target.alias("target"), "p.source_rows",
            F.round(F.when(target <= 0, F.lit(0.0)).otherwise(F.coalesce(rate, F.lit(float(max_copies)))), 9).alias("rate"),
        )
    )
    return round_to_copies(rated, max_copies).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), max_copies: int = MAX_COPIES) -> DataFrame:
    """The rows of `docs`, with their columns, each as often as its copies. Copies are decided on slim rows and
    joined back by doc_id and a fingerprint of the whole row; equal rows are kept once and share the sum of their
    copies. Rows are packed, so no column of `docs` can clash."""
    mark = F.xxhash64(*[F.col(c) for c in docs.columns])
    slim = docs.select(F.struct("doc_id", mark.alias("mark")).alias("doc_id"), "source", "text")
    copies = (
        mix_documents(slim, weights, max_copies).groupBy(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.mark").alias("mark"))
        .agg(F.sum("copies").cast("long").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 0")
    )
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), mark.alias("mark")).alias("d")
    both = packed.join(copies.alias("c"), (F.col("d.mark") == F.col("c.mark")) & F.col("d.id").eqNullSafe(F.col("c.id"))).select("row", "d.id", "d.mark", "n", "rows")
    single = both.where("rows = 1").select("row", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("row")
    several = spread(both.where("rows > 1").dropDuplicates(["id", "mark"]), "id", "mark").select("row")
    return single.unionByName(several).select("row.*")
