"""Mixing sources to target token counts by entropy balancing, with DataFrame operations only.

For each source the rates r of its documents minimise the entropy sum(r log r - r) under the token constraint
sum(size * r) = target and 0 <= r <= CAP. The solution is an exponential tilt by size, r = min(CAP,
exp(l * size / scale)), where l solves a convex one-dimensional dual. Newton steps, kept inside a bracket, run
for all sources at once. The first ones run inside one expression over a histogram of each source, whose bins grow by
a twentieth of e, so that a source has some hundred at most; the last ones over the exact counts per (source, size):
a step is one join with the multipliers and one sum. A dual that is not solved in STEPS steps is an error.
Rates become whole copies by rounding their running sum over the documents of a source in order of size, so
that what one document gains its neighbour in size gives back.

Defined results: null texts have size 0, which gets no copies; a null source is a source of its own, last in
order; a source of size 0 has target 0; repeated rows are mixed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tables import free_names, running_before, small, stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
TOLERANCE = 1e-9
#: Steps over the exact counts, and over the histograms before them.
STEPS, ROUGH_STEPS = 60, 60
BINS = 20


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size); ``sizes`` has a row for each source.

    The share is dealt by weight; a source over its cap stops there, and the excess goes to the others by weight.
    Ordered by cap per weight, the capped sources are a prefix, which two running sums find without a loop.
    """
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int"))
    one = F.lit(0)  # one row a source
    s = sizes.withColumn("i", F.row_number().over(W.partitionBy(one).orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1)
    s = s.withColumn("w", cycle).withColumn("cap", cap * F.col("source_size"))
    all_ = W.partitionBy(one)
    before = all_.orderBy(F.col("cap") / F.col("w"), "i").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("goal", share * F.sum("source_size").over(all_))
    s = s.withColumn("left", F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("fits", (F.col("w") * F.col("left") / F.col("open") <= F.col("cap")).cast("int"))
    # from the first source that fits on, all share what is left there
    s = s.withColumn("rate", F.max(F.when(F.col("fits") == 1, F.struct(-F.col("cap") / F.col("w"), -F.col("i"), F.col("left") / F.col("open")))).over(all_)["col3"])
    return s.select("source", "source_size", F.when(F.col("rate").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("rate"))).alias("target"))


def _rate(size: Column, cap: float) -> Column:
    return F.when(F.col("full"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(F.col("l") * size / F.col("scale"))))


def _step(l: Column, lo: Column, hi: Column, off: Column, slope: Column) -> Column:
    """Newton's next place, or the middle of the bracket where that lies outside."""
    to = l - F.try_divide(off, slope)
    return F.when((slope > 0) & (to > lo) & (to < hi), to).otherwise((lo + hi) / 2)


def _rough(counts: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """``state`` with ``l`` near the solution, found over the histograms of the sources."""
    bins = counts.groupBy("source", F.floor(F.log("size") * BINS).alias("bin")).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("m"), F.sum("n").cast("double").alias("k"))
    bins = bins.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("m", "k"))).alias("bins"))
    j = state.alias("t").join(bins.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source"))).select("t.*", "bins")

    def step(at: Column, _: Column) -> Column:
        def add(total: Column, x: Column) -> Column:
            r = F.least(F.lit(cap), F.exp(at.l * x.m / F.col("scale")))
            words = x.m * x.k * r
            return F.struct((total.got + words).alias("got"), (total.slope + F.when(r < cap, words * x.m / F.col("scale")).otherwise(0.0)).alias("slope"))

        def moved(sums: Column) -> Column:
            off = sums.got - F.col("target")
            lo, hi = F.when(off < 0, at.l).otherwise(at.lo), F.when(off > 0, at.l).otherwise(at.hi)
            return F.struct(F.when(off == 0, at.l).otherwise(_step(at.l, lo, hi, off, sums.slope)).alias("l"), lo.alias("lo"), hi.alias("hi"))

        sums = F.aggregate("bins", F.struct(F.lit(0.0).alias("got"), F.lit(0.0).alias("slope")), add)
        return F.element_at(F.transform(F.array(sums), moved), 1)

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(ROUGH_STEPS)), F.struct(F.col("l"), F.col("lo"), F.col("hi")), step)["l"]
    return j.withColumn("l", F.when(F.col("done"), F.col("l")).otherwise(F.greatest("lo", F.least("hi", solved)))).drop("bins")


def tilts(counts: DataFrame, goals: DataFrame, cap: float = CAP, steps: int = STEPS) -> DataFrame:
    """(source, full, scale, l): the multipliers of the dual. counts: (source, size, n), sizes above 0."""
    scale = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"), F.min("size").alias("least"))
    same = F.col("g.source").eqNullSafe(F.col("s.source"))
    state = goals.alias("g").join(scale.alias("s"), same).select("g.source", "g.target", "scale", (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)).alias("full"), F.lit(0.0).alias("l"), (-60 * F.col("scale") / F.col("least")).alias("lo"), (F.log(F.lit(cap)) * F.col("scale") / F.col("least")).alias("hi"), (F.col("target") <= 0).alias("done"))
    state = state.withColumn("done", F.col("done") | F.col("full"))
    state = stage(_rough(counts, state, cap), "tilt")
    for _ in range(steps):
        if not state.filter(~F.col("done")).limit(1).count():
            return state
        at = counts.alias("c").join(small(state).alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
        r = _rate(F.col("c.size"), cap)
        words = F.col("c.size") * F.col("c.n")
        slope = F.when(r < cap, words * r * F.col("c.size") / F.col("scale")).otherwise(0.0)
        sums = at.filter(~F.col("done")).groupBy("t.source").agg(F.sum(words * r).alias("got"), F.sum(slope).alias("slope"))
        j = state.alias("t").join(sums.alias("u"), F.col("t.source").eqNullSafe(F.col("u.source")), "left").select("t.*", "got", "slope")
        off = F.col("got") - F.col("target")
        j = j.withColumn("lo", F.when(off < 0, F.col("l")).otherwise(F.col("lo"))).withColumn("hi", F.when(off > 0, F.col("l")).otherwise(F.col("hi")))
        step = _step(F.col("l"), F.col("lo"), F.col("hi"), off, F.col("slope"))
        settled = F.abs(off) <= TOLERANCE * F.col("target")
        stuck = F.abs(step - F.col("l")) <= 1e-15 * F.greatest(F.abs("l"), F.lit(1.0))
        state = stage(j.select("source", "target", "scale", "full", F.when(F.col("done") | settled, F.col("l")).otherwise(step).alias("l"), "lo", "hi", (F.col("done") | F.coalesce(settled | stuck, F.lit(True))).alias("done")), "tilt")
    if state.filter(~F.col("done")).limit(1).count():
        raise RuntimeError(f"the dual was not solved in {steps} steps")
    return state


def mix(sized: DataFrame, doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sized`` (a staged table with doc_id, source, size and what else to carry) with source_size, target, rate, copies, taken."""
    counts = stage(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = stage(targets(sizes, weights, share, cap), "targets")
    tilt = tilts(counts.filter("size > 0"), goals, cap)
    rule = goals.alias("g").join(tilt.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source")), "left").select("g.*", "full", "scale", "l")
    rule = stage(rule, "rule")
    j = sized.alias("d").join(small(rule).alias("r"), F.col("d.source").eqNullSafe(F.col("r.source"))).select("d.*", "source_size", "target", "full", "scale", "l")
    # whole millionths, so that sums do not depend on their order
    rate = F.when((F.col("size") <= 0) | (F.col("target") <= 0), F.lit(0.0)).otherwise(_rate(F.col("size"), cap))
    j = j.withColumn("rate", rate).drop("full", "scale", "l").withColumn("_u", F.round(F.col("rate") * 1_000_000).cast("long"))
    j = j.withColumn("_h", F.xxhash64(doc_id))
    j = running_before(j, "_u", ["size", "_h", doc_id], ["source"], "_before")
    upto = lambda x: F.floor((x + 500_000) / 1_000_000)
    copies = (upto(F.col("_before") + F.col("_u")) - upto(F.col("_before"))).cast("long")
    j = stage(j.withColumn("copies", copies).withColumn("_row", F.monotonically_increasing_id()).drop("_u", "_before"), "copies")
    return _settle(j, cap).withColumn("taken", F.col("copies") * F.col("size")).drop("_h", "_row")


def _settle(j: DataFrame, cap: float, passes: int = 3) -> DataFrame:
    """Add or take away a copy of one document a pass in each source, the one whose size is nearest to what is off."""
    for _ in range(passes):
        got = j.groupBy("source").agg(F.max("target").alias("_t"), F.sum(F.col("size") * F.col("copies")).alias("_g"))
        off = stage(got.select(F.col("source").alias("_s"), (F.col("_t") - F.col("_g")).alias("_off")), "off")
        d = j.join(small(off), F.col("source").eqNullSafe(F.col("_s")))
        may = F.when(F.col("_off") > 0, F.col("copies") + 1 <= cap).otherwise(F.col("copies") > 0)
        gap = F.abs(F.col("size") - F.abs("_off"))
        pick = d.filter(may & (gap < F.abs("_off")) & (F.col("size") > 0)).groupBy("source").agg(F.min(F.struct(gap.alias("gap"), F.col("_h"), F.col("_row"), F.signum("_off").cast("long").alias("by"))).alias("p"))
        pick = stage(pick.select(F.col("p._row").alias("_r"), F.col("p.by").alias("_by")), "picked")
        j = j.join(small(pick), F.col("_row") == F.col("_r"), "left").withColumn("copies", F.col("copies") + F.coalesce("_by", F.lit(0))).drop("_r", "_by")
    return j


def op_mix(docs: DataFrame) -> DataFrame:
    slim = stage(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    return mix(slim).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; the rows are shuffled once to their copies, at every size."""
    doc, of, size, copies, rows, words, place, mine, again = free_names(docs, "id", "source", "size", "copies", "rows", "n", "k", "mine", "again")
    slim = stage(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    # rows that agree in id, source and size share their copies: the first of them get one more where they differ
    taken = mix(slim).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    taken = stage(taken.withColumnsRenamed({"doc_id": doc, "source": of, "size": size}), "taken")
    many = taken.filter(F.col(rows) > 1).limit(1).count() > 0
    on = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(of)) & (F.col(words) == F.col(size))
    j = docs.withColumn(words, word_count()).join(taken.hint("merge"), on)
    if many:
        j = j.withColumn(place, F.row_number().over(W.partitionBy(doc, of, size).orderBy(F.xxhash64(*docs.columns))))
    else:
        j = j.withColumn(place, F.lit(1))
    share = lambda k: F.floor(F.col(copies) * k / F.col(rows))
    j = j.withColumn(mine, (share(F.col(place)) - share(F.col(place) - 1)).cast("int")).filter(F.col(mine) > 0)
    return j.withColumn(again, F.explode(F.array_repeat(F.lit(1), F.col(mine)))).select(*docs.columns)
