"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every source gets a token target; the document rates closest to 1 in Kullback-Leibler divergence that meet it, within
0..cap, are r = min(cap, exp(lambda * size / mean size of the source)). The dual in lambda is convex; safeguarded Newton
steps run on the histogram (source, size, count), since a rate depends on nothing else.

Rates are rounded into whole copies for every document alike: r + hash(doc_id) + shift, rounded down. The shift of a
source is the one of three nested grids that brings its tokens nearest to the target. What is still missing, a document
or less, is closed in up to FIXES steps, each giving one document of the source one copy more or less, the one whose
size fits the gap best. A step that brings the source no nearer (several rows under one doc_id) is taken back.

Defined results: null text has size 0 and takes 0; a null source is a source of its own, ordered last; repeated rows
are mixed each for itself; an empty table gives an empty result; a source whose documents admit no sum near its target
(a lone document) ends at the nearest sum the steps find; other columns pass through `mix_documents` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, as_long, cut, table

WEIGHTS = (5, 2, 1)
CAP = 3
NEWTON_STEPS = 60
TOLERANCE = 1e-9
#: Points of a grid on either side of its middle, and the nested grids.
GRID, GRIDS = 16, 3
#: Documents of a source that may get a copy more or less after rounding, and the miss of a target that needs none.
FIXES, NEAR = 4, 1e-3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target for the rows (source, size).

    Weights go by the code-point order of the sources (null last), repeating; targets share the total of all sizes and
    stop at cap times the source's size, the excess going to the others by weight. That fixed point is min(cap * size,
    weight * level): sources fill up in the order of cap * size / weight. One row for each source passes the windows.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    t = by_source.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rest = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the level holds at the first source whose cap lies above it
    free = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    t = t.withColumn("level", F.max(F.when(free.isNotNull(), F.struct(-F.col("most") / F.col("weight"), F.col("level").alias("at")))).over(every)["at"])
    return t.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("level"), F.col("most"))).alias("target"))


def solve_duals(hist: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, target, mean, lam: safeguarded Newton on every source's dual at once, over (source, size, n)."""
    means = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum(F.when(F.col("size") > 0, F.col("n"))), F.lit(1))).alias("mean"))
    state = targets.alias("t").join(means.alias("m"), F.col("t.source").eqNullSafe(F.col("m.source"))).select(
        "t.source", "t.source_size", "t.target", "m.mean", F.lit(0.0).alias("lam"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"), F.lit(1.0).alias("miss")
    )
    state = cut(state, "mix-dual")
    for _ in range(NEWTON_STEPS):
        x = F.col("h.size") / F.col("s.mean")
        tilt = F.exp(F.least(F.col("s.lam") * x, F.lit(50.0)))
        tokens = F.col("h.size") * F.col("h.n")
        at = hist.alias("h").join(state.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))).where("h.size > 0").groupBy(F.col("s.source").alias("g_source")).agg(
            F.sum(tokens * F.least(F.lit(float(cap)), tilt)).alias("got"), F.sum(F.when(tilt < cap, tokens * x * tilt).otherwise(0.0)).alias("slope")
        )
        s = state.alias("s").join(at.alias("a"), F.col("s.source").eqNullSafe(F.col("a.g_source")), "left")
        gap = F.col("a.got") - F.col("s.target")
        lo = F.when(gap <= 0, F.col("s.lam")).otherwise(F.col("s.lo"))
        hi = F.when(gap >= 0, F.col("s.lam")).otherwise(F.col("s.hi"))
        newton = F.when(F.col("a.slope") > 0, F.col("s.lam") - gap / F.col("a.slope"))
        # outside the bracket, or no slope left: bisect on the signed square root, which spans many magnitudes
        wide = F.when((lo < -1e8) | (hi > 1e8), F.when(gap < 0, F.greatest(F.lit(1.0), F.col("s.lam") * 4, F.col("s.lam") / 4)).otherwise(F.least(F.lit(-1.0), F.col("s.lam") * 4, F.col("s.lam") / 4)))
        middle = F.coalesce(wide, (lo + hi) / 2)
        # clipping at the cap bends the curve: a step is also held within a factor of the bracket
        nxt = F.when(newton.isNotNull() & (newton > lo) & (newton < hi), newton).otherwise(middle)
        full = (F.col("s.target") >= cap * F.col("s.source_size") * (1 - 1e-12)) | F.col("a.got").isNull()
        miss = F.when(full, 0.0).otherwise(F.abs(gap) / F.greatest(F.col("s.target"), F.lit(1e-300)))
        lam = F.when(full, F.lit(1e9)).when(miss <= TOLERANCE, F.col("s.lam")).otherwise(nxt)
        state = cut(s.select("s.source", "s.source_size", "s.target", "s.mean", lam.alias("lam"), lo.alias("lo"), hi.alias("hi"), miss.alias("miss")), "mix-dual")
        worst = state.agg(F.max("miss")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    return state


def plan_sources(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The few numbers of every source that fix all its documents' copies: source, source_size, target, mean, lam, shift, taken, fixes."""
    sized = cut(sized.select("doc_id", "source", "size"), "mix-sizes")
    hist = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-hist")
    fix = "array<struct<doc_id:bigint,size:bigint,add:int>>"
    plan = solve_duals(hist, source_targets(sized, weights, cap), cap).drop("lo", "hi", "miss").withColumns({"shift": F.lit(0.0), "taken": F.lit(0).cast("long"), "fixes": F.array().cast(fix)})
    for level in range(GRIDS):
        tries = [k / GRID / (2 * GRID) ** level for k in range(-GRID, GRID + 1)]
        got = [F.sum(F.col("_m.size") * copies(cap, F.lit(t))).alias(f"t{i}") for i, t in enumerate(tries)]
        sums = with_rates(sized, plan, cap).groupBy(F.col("_m.source").alias("g_source")).agg(F.first("_m.target").alias("g_target"), *got)
        best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{i}") - F.col("g_target")).alias("miss"), F.lit(abs(t)).alias("far"), F.lit(t).alias("add"), F.col(f"t{i}").alias("got")) for i, t in enumerate(tries)]))
        picked = sums.select("g_source", best.alias("best"))
        plan = cut(_beside(plan, picked, {"shift": F.col("s.shift") + F.coalesce(F.col("p.best.add"), F.lit(0.0)), "taken": F.coalesce(F.col("p.best.got"), F.lit(0)).cast("long")}), "mix-shift")
    gap = F.col("target") - F.col("taken")
    for _ in range(FIXES):
        if plan.where(F.abs(gap) > F.lit(NEAR) * F.col("target")).isEmpty():
            break
        plan = _fixed(sized, plan, cap)
    return plan


def _beside(plan: DataFrame, other: DataFrame, new: dict[str, Column]) -> DataFrame:
    """plan with new columns, from the row of other for the same source if there is one."""
    j = plan.alias("s").join(other.alias("p"), F.col("s.source").eqNullSafe(F.col("p.g_source")), "left")
    return j.select(*[new[c].alias(c) if c in new else F.col(f"s.{c}") for c in plan.columns])


def _fixed(sized: DataFrame, plan: DataFrame, cap: int) -> DataFrame:
    """plan with one more document that gets a copy more or less in every source that comes nearer to its target by it."""
    m = F.col("_m")
    miss = m["target"] - m["taken"]
    add = F.when(miss > 0, 1).otherwise(-1)
    may = (m["size"] > 0) & F.when(miss > 0, copies(cap) < cap).otherwise(copies(cap) > 0) & (m["size"] < 2 * F.abs(miss))
    order = F.struct(F.abs(F.abs(miss) - m["size"]), F.col("doc_id"))
    chosen = with_rates(sized, plan, cap).where(may).groupBy(F.col("_m.source").alias("g_source")).agg(F.min_by(F.struct("doc_id", "size", add.cast("int").alias("add")), order).alias("one"))
    tried = cut(_beside(plan, chosen, {"fixes": F.when(F.col("p.one").isNull(), F.col("s.fixes")).otherwise(F.concat(F.col("s.fixes"), F.array("p.one")))}), "mix-fix")
    sums = with_rates(sized, tried, cap).groupBy(F.col("_m.source").alias("g_source")).agg(F.sum(m["size"] * copies(cap)).alias("got"))
    nearer = F.abs(F.col("s.target") - F.col("p.got")) < F.abs(F.col("s.target") - F.col("s.taken"))
    last = F.when(F.size("s.fixes") > 0, F.slice(F.col("s.fixes"), F.lit(1), F.size("s.fixes") - 1)).otherwise(F.col("s.fixes"))
    # where nothing was tried, the sum is the one before and the last fix has to stay
    same = F.col("p.got").isNull() | (F.col("p.got") == F.col("s.taken"))
    return cut(_beside(tried, sums, {"taken": F.when(nearer, F.col("p.got")).otherwise(F.col("s.taken")), "fixes": F.when(nearer | same, F.col("s.fixes")).otherwise(last)}), "mix-fix")


def with_rates(rows: DataFrame, plan: DataFrame, cap: int) -> DataFrame:
    """rows (doc_id, source, size and whatever else) with a struct _m of their rate and their source's numbers; the join is on the source, whose side is a row for each."""
    j = rows.alias("d").join(plan.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    size = F.col("d.size")
    rate = F.when(size == 0, 0.0).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("s.lam") * size / F.col("s.mean"), F.lit(50.0)))))
    unit = F.xxhash64(F.col("d.doc_id"), F.lit(7)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    fix = F.col("s.fixes")
    mine = [F.when(F.get(fix, F.lit(i))["doc_id"].eqNullSafe(F.col("d.doc_id")) & (F.get(fix, F.lit(i))["size"] == size), F.get(fix, F.lit(i))["add"]).otherwise(0) for i in range(FIXES)]
    return j.select("d.*", F.struct("s.source", "s.source_size", "s.target", "s.shift", "s.taken", rate.alias("rate"), unit.alias("unit"), sum(mine[1:], mine[0]).alias("fix"), size.alias("size")).alias("_m"))


def copies(cap: int, further: Column | float = 0.0) -> Column:
    """Whole copies taken of a row of with_rates, with a further shift."""
    m = F.col("_m")
    rounded = F.least(F.lit(cap), F.greatest(F.lit(0), F.floor(m["rate"] + m["unit"] + m["shift"] + further)))
    return F.when(m["size"] > 0, F.least(F.lit(cap), F.greatest(F.lit(0), rounded + m["fix"]))).otherwise(0).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, rate, copies, taken."""
    sized = cut(docs.select(as_long("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    rows = with_rates(sized, plan_sources(sized, weights, cap), cap).withColumn("copies", copies(cap))
    return rows.select("doc_id", "source", "size", "_m.source_size", "_m.target", "_m.rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus: every row of docs as often as the mix takes it, all columns kept."""
    rows = docs.select(as_long("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.struct("*").alias("row"))
    rows = with_rates(rows, plan_sources(rows, weights, cap), cap).select("row", copies(cap).cast("int").alias("n")).where("n > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def op7_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: doc_id, size, source_size, target, taken, and the rate and copies behind them."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
