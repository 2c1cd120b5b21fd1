"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

WEIGHTS = (3.0, 1.0, 2.0)
#: Documents of one class that are ranked in one task.
ROWS_PER_CELL = 5_000
#: Rounds that shrink what rounding leaves; each at least halves it.
FIXES = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null, and in code-point order with null last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def targets(classes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(src, source_size, docs, target): the weights repeat over the sources by code point; excess over cap is reshared.

    Resharing until none is above is filling with water: target = min(cap * size, weight * level). The sources, ordered
    by cap * size / weight, fill up one after the other, so the level follows from running sums over the source table.
    """
    everything = Window.orderBy("ratio", "src")
    by_name = Window.orderBy("src")
    s = classes.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    total = s.agg((F.sum("source_size") * share).alias("total"))
    run = s.crossJoin(F.broadcast(total)).select(  # total is one row
        "*", F.coalesce(F.sum("most").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(everything.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
    ).withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    level = run.where("ratio >= level").agg(F.min_by("level", F.struct("ratio", "src")).alias("water"))
    return s.crossJoin(F.broadcast(level)).select("src", "source_size", "docs", F.coalesce(F.least("most", F.col("weight") * F.col("water")), F.col("most")).alias("target"))


def rates(classes: DataFrame, goals: DataFrame, cap: float = 2.0, tolerance: float = 1e-9, most_steps: int = 60) -> DataFrame:
    """classes with rate: the copies a document of this source and size is expected to get.

    Entropy balancing: of all rates, those nearest to one copy each (in relative entropy, at most cap) that meet, for
    each source, its token target and the document count in proportion. The second constraint keeps the length profile:
    with tokens alone the tilt would prefer long or short documents. The solution is exp(a + b * size / mean size),
    capped; (a, b) solve the convex dual by damped Newton steps: a step of d in the exponent is shortened to ln(1 + d),
    which keeps it from overshooting into the cap and is a plain Newton step near the solution. Each is one grouped
    aggregation over the classes (documents of equal source and size count as one row, with their number), and a closed
    2 x 2 solution per source.
    A source that wants all of cap has no interior solution: its rate is cap. Fails if the steps don't converge.
    """
    x = F.coalesce(F.try_divide("size", "mean"), F.lit(0.0))
    r = F.least(F.lit(cap), F.exp(F.least(F.col("a") + F.col("b") * x, F.lit(50.0))))
    goal = goals.select("src", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("part"), (F.col("source_size") / F.col("docs")).alias("mean"), "docs")
    open_ = (F.col("part") > 0) & (F.col("part") < cap * (1 - 1e-12))
    state = goal.select("*", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.when(open_, 1.0).otherwise(0.0).alias("off"))
    for step in range(most_steps):
        state = staged(state, "dual")
        if (state.agg(F.max("off")).first()[0] or 0) < tolerance:
            break
        sums = classes.join(state.where(open_), "src").groupBy("src").agg(
            *(F.sum(F.col("n") * r * v).alias(k) for k, v in (("h00", F.lit(1.0)), ("h01", x), ("h11", x * x))), *(F.first(k).alias(k) for k in ("part", "docs")),
        )
        g0, g1 = F.col("h00") - F.col("part") * F.col("docs"), F.col("h01") - F.col("part") * F.col("docs")
        h00, h01, h11 = F.col("h00") * (1 + 1e-9), F.col("h01"), F.col("h11") * (1 + 1e-9)
        det = h00 * h11 - h01 * h01
        singular = det <= 1e-7 * h00 * h11  # all documents have one size
        da = F.when(singular, g0 / h00).otherwise((h11 * g0 - h01 * g1) / det)
        db = F.when(singular, 0.0).otherwise((h00 * g1 - h01 * g0) / det)
        off = F.greatest(F.abs(g0), F.abs(g1)) / (F.col("part") * F.col("docs"))
        d = F.greatest(F.lit(-0.95), -F.col("da"))
        damp = F.when(F.abs(d) < 1e-6, 1.0).otherwise(F.ln(1 + d) / d)
        steps = sums.select("src", da.alias("da"), db.alias("db"), off.alias("now")).select("src", (F.col("da") * damp).alias("da"), (F.col("db") * damp).alias("db"), "now")
        state = state.join(steps, "src", "left").select(
            "src", "part", "mean", "docs", (F.col("a") - F.coalesce("da", F.lit(0.0))).alias("a"), (F.col("b") - F.coalesce("db", F.lit(0.0))).alias("b"), F.coalesce("now", F.lit(0.0)).alias("off"),
        )
    else:
        raise RuntimeError(f"the dual has not converged in {most_steps} steps")
    rate = F.when(F.col("part") >= cap * (1 - 1e-12), F.lit(cap)).when(F.col("part") > 0, r).otherwise(F.lit(0.0))
    return classes.join(state, "src").select("src", "size", "n", rate.alias("rate"))


def copies_by_class(rated: DataFrame, goals: DataFrame, cap: int = 2) -> DataFrame:
    """(src, size, n, copies): whole copies for each class; a source's tokens come as near its target as its small documents allow.

    Largest sizes first, the running sum of rates is rounded. What that leaves (under one largest document) is then
    made up by whole documents, the largest that fit first; each round at least halves the rest.
    """
    whole, down = Window.partitionBy("src"), Window.partitionBy("src").orderBy(F.desc("size"))
    upto, before = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)
    t = rated.join(goals.select("src", "target"), "src").withColumn("run", F.sum(F.col("n") * F.col("rate")).over(upto))
    t = t.withColumn("k", F.floor(F.col("run") + 0.5) - F.floor(F.coalesce(F.lag("run").over(down), F.lit(0.0)) + 0.5))
    t = t.withColumn("k", F.greatest(F.lit(0), F.least("k", F.col("n") * cap)).cast("long"))
    for _ in range(FIXES):
        t = t.withColumn("rest", F.round(F.col("target") - F.sum(F.col("k") * F.col("size")).over(whole)).cast("long"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("rest"))
        t = t.withColumn("room", F.when(~fits, 0).when(F.col("rest") > 0, F.col("n") * cap - F.col("k")).otherwise(F.col("k")))
        used = F.coalesce(F.sum(F.col("room") * F.col("size")).over(before), F.lit(0))
        x = F.when(fits, F.greatest(F.lit(0), F.least("room", F.floor((F.abs("rest") - F.col("used")) / F.col("size"))))).otherwise(0)
        t = t.withColumn("used", used).withColumn("k", (F.col("k") + F.signum(F.col("rest").cast("double")).cast("long") * x).cast("long"))
    return t.select("src", "size", "n", F.col("k").alias("copies"))


def order_key(id_col: Column) -> Column:
    """A non-negative hash that orders the documents of a class; the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(id_col), 1)


def cuts(sized: DataFrame, classes: DataFrame) -> DataFrame:
    """(src, size, base, cut): each document gets base copies, and one more if its order key is at most cut.

    The cut is the m-th smallest key of the class. Keys are split by their leading bits into cells of bounded size;
    counts of the cells tell in which one the cut lies, and only that one is ranked.
    """
    c = classes.withColumn("base", F.floor(F.col("copies") / F.col("n")).cast("long")).withColumn("m", F.col("copies") % F.col("n"))
    c = c.withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / ROWS_PER_CELL))).cast("int"))
    part = sized.join(c.where("m > 0").select("src", "size", "m", "bits"), ["src", "size"]).withColumn("cell", F.expr("if(bits > 0, shiftright(key, 63 - bits), 0L)"))
    run = Window.partitionBy("src", "size").orderBy("cell")
    counted = part.groupBy("src", "size", "cell").agg(F.count("*").alias("rows"), F.first("m").alias("m"))
    counted = counted.withColumn("upto", F.sum("rows").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    lies = counted.where("upto >= m and upto - rows < m").select("src", "size", "cell", (F.col("m") - F.col("upto") + F.col("rows")).alias("nth"))
    nth = F.row_number().over(Window.partitionBy("src", "size", "cell").orderBy("key"))
    cut = part.select("src", "size", "cell", "key").join(lies, ["src", "size", "cell"]).withColumn("at", nth).where("at = nth").select("src", "size", F.col("key").alias("cut"))
    return c.select("src", "size", "base").join(cut, ["src", "size"], "left")


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> tuple[DataFrame, DataFrame]:
    """Of (src, size, key): the class table (src, size, base, cut) and the source table (src, source_size, docs, target)."""
    classes = staged(sized.groupBy("src", "size").agg(F.count("*").alias("n")), "classes")
    goals = staged(targets(classes, weights, share, float(cap)), "targets")
    return staged(cuts(sized, staged(copies_by_class(rates(classes, goals, float(cap)), goals, cap), "copies")), "cuts"), goals


def copies() -> Column:
    return (F.col("base") + F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of docs, without its text: doc_id, src, size, source_size, target, copies, taken (copies * size).

    Null texts have size 0, null sources are a source of their own. Rows of one id and size share their decision. Empty
    table: no rows. Other columns are ignored. Only hashes of ids decide between equals, so reruns agree.
    """
    sized = staged(docs.select(F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("src"), word_count(F.col(text_col)).alias("size"), order_key(F.col(id_col)).alias("key")), "words")
    by_class, goals = plan(sized, weights, share, cap)
    out = sized.join(by_class.join(goals, "src"), ["src", "size"]).withColumn("copies", copies())
    return out.select("doc_id", "src", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs with all their columns, each as often as it has copies. Cases as in mix()."""
    own = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    of = lambda c: F.col("row")[c]
    own = own.select("row", source_key(of(source_col)).alias("src"), word_count(of(text_col)).alias("size"), order_key(of(id_col)).alias("key"))
    by_class, _ = plan(staged(own.select("src", "size", "key"), "words"), weights, share, cap)
    return own.join(by_class, ["src", "size"]).withColumn("i", F.explode(F.expr("array_repeat(0, cast(base + if(key <= cut, 1, 0) as int))"))).select("row.*")
