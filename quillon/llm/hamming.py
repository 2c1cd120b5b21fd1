"""Exact top-k by Hamming distance over binary codes: incremental multi-index hashing."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SEGMENTS, BITS = 4, 16
#: Codes against which all queries are first compared; their k-th distance is an upper bound of the true one.
PIVOTS = 512


def code(vector: Column) -> Column:
    """64 signs of a vector as one integer: bit i is set if component i is above 0; missing components count as 0."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(F.slice(vector, 1, SEGMENTS * BITS), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def segment(c: Column | str, s: int) -> Column:
    return F.shiftrightunsigned(c, s * BITS).bitwiseAND(F.lit(2**BITS - 1)).cast("int")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbor_id, distance): for each query the k other rows nearest by (distance, id), exactly.

    Equal codes are one entry of the index with their k + 1 smallest ids (a result needs no more of them) - a vector
    that a third of the rows repeat is one entry. Each entry is listed under its four 16-bit segments. A query probes
    segment values at radius 0, then 1, 2, ...: after radius r in all segments, every code within 4 (r + 1) - 1 bits has
    been met. Where a segment has fewer values than the radius has masks, those values are looked through instead, of
    which there are 2 ** BITS at most. A query ends when its k-th verified distance is covered so. Candidates above the
    upper bound that is known so far are dropped within the join, and each is reported by the first of its segments that
    meets it only.

    Null vectors have no code: as rows they are never neighbours, as queries they have no result. Ties go to the smaller
    id; repeated ids count as one row for each code. Fewer than k other rows: all of them. Other columns are ignored.
    """
    coded = lambda d: d.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), code(F.col(vector_col)).alias("code"))
    rows = staged(coded(vectors).distinct(), "codes")
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    few = rows.withColumn("at", F.row_number().over(Window.partitionBy("code", salt).orderBy("id"))).where(F.col("at") <= k + 1)
    entries = staged(few.select("code", "id").withColumn("at", place).where(F.col("at") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    asked = staged(coded(queries).distinct().select(F.col("id").alias("query_id"), F.col("code").alias("asked")), "asked")
    apart = F.bit_count(F.col("code").bitwiseXOR(F.col("asked"))).cast("int")

    def best(found: DataFrame) -> DataFrame:
        """The k best of (query_id, asked, distance, ids), ids opened and the query itself left out."""
        one = found.select("query_id", "asked", "distance", F.explode("ids").alias("neighbor_id")).where(~F.col("neighbor_id").eqNullSafe(F.col("query_id")))
        order = Window.partitionBy("query_id", "asked").orderBy("distance", "neighbor_id")
        return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    pivots = entries.orderBy(F.xxhash64("code")).limit(PIVOTS)
    bound = best(asked.crossJoin(F.broadcast(pivots)).withColumn("distance", apart))  # PIVOTS rows
    bound = bound.where(F.col("rank") == k).select("query_id", "asked", F.col("distance").alias("bound"))
    open_ = staged(asked.join(bound, ["query_id", "asked"], "left").withColumn("bound", F.coalesce("bound", F.lit(SEGMENTS * BITS))), "open")
    listed = staged(entries.select("code", "ids", F.posexplode(F.array(*(segment("code", s) for s in range(SEGMENTS)))).alias("seg", "value")), "index")
    values = staged(listed.select(F.col("seg").alias("of"), "value").distinct(), "values")  # SEGMENTS * 2 ** BITS at most
    most = values.groupBy("of").count().agg(F.max("count")).first()[0] or 0
    met_at: list[DataFrame] = []
    done = None
    for radius in range(BITS + 1):
        probes = open_.select("query_id", "asked", "bound", F.posexplode(F.array(*(segment("asked", s) for s in range(SEGMENTS)))).alias("seg", "own"))
        if comb(BITS, radius) <= most:
            masks = [sum(1 << i for i in c) for c in combinations(range(BITS), radius)]
            probes = probes.withColumn("mask", F.explode(F.lit(masks).cast("array<int>") if len(masks) > 1 else F.array(F.lit(masks[0])))).select("*", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        else:  # fewer values than masks: those that lie at this radius
            probes = probes.join(F.broadcast(values), (F.col("seg") == F.col("of")) & (F.bit_count(F.col("own").bitwiseXOR(F.col("value"))) == radius))
        # The pair's other segments: earlier ones must lie beyond this radius, later ones not within the last.
        first = F.lit(True)
        for s in range(SEGMENTS):
            d = F.bit_count(segment("code", s).bitwiseXOR(segment("asked", s)))
            first = first & F.when(F.col("p.seg") > s, d > radius).when(F.col("p.seg") < s, d >= radius).otherwise(True)
        # Merged, not broadcast: the size of exploded masks is unknown to the planner.
        p, x = probes.hint("merge").alias("p"), listed.alias("x")
        met = p.join(x, (F.col("p.seg") == F.col("x.seg")) & (F.col("p.value") == F.col("x.value")) & (apart <= F.col("bound")) & first)
        met_at.append(staged(met.select("query_id", "asked", apart.alias("distance"), "ids"), "met"))
        kept = reduce(DataFrame.unionByName, met_at).join(open_, ["query_id", "asked"]).where("distance <= bound").select("query_id", "asked", "distance", "ids")
        covered = SEGMENTS * (radius + 1) - 1
        ranked = best(kept)
        kth = ranked.where(F.col("rank") == k).select("query_id", "asked", F.col("distance").alias("kth"))
        state = staged(open_.join(kth, ["query_id", "asked"], "left").withColumn("bound", F.least("bound", F.coalesce("kth", "bound"))), "bounds")
        ended = state.where((F.col("bound") <= covered) if radius < BITS else F.lit(True)).select("query_id", "asked")
        out = staged(ranked.join(ended, ["query_id", "asked"], "left_semi"), "answers")
        done = out if done is None else done.unionByName(out)
        open_ = state.where(F.col("bound") > covered).select("query_id", "asked", "bound")
        if radius == BITS or open_.isEmpty():
            return done.select("query_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", "distance")
    raise AssertionError("the last radius covers all codes")
