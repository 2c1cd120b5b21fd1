"""Sharding by longest-processing-time scheduling: groups that must stay together go, largest first, to the least-loaded shard."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Items that the driver schedules for each shard; with it, what is collected and broadcast is bounded at any input size.
ITEMS_PER_SHARD = 256
#: Rows of one shard that are numbered in one task.
ROWS_PER_CELL = 50_000


def lpt(items: list[tuple[int, object]], n_shards: int) -> dict[object, int]:
    """The shard of each (size, key): the largest first, always to the least-loaded shard, ties to the lower key and shard."""
    heap, out = [(0, s) for s in range(n_shards)], {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        out[key] = s
        heapq.heappush(heap, (load + size, s))
    return out


def _text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def _schedule(rows: DataFrame, n_shards: int) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Of (size, grp): the shard of each bundle, the shard of each large group, and how many rows each shard gets."""
    spark, n_bundles = rows.sparkSession, n_shards * ITEMS_PER_SHARD
    rows = rows.withColumn("bundle", _bundle(n_shards))
    load = {b: (s, n) for b, s, n in rows.groupBy("bundle").agg(F.sum("size"), F.count("*")).collect()}
    mean = sum(s for s, _ in load.values()) / n_bundles
    heavy = [b for b, (s, _) in load.items() if s > 2 * mean]
    large: list[tuple[int, int, int, int]] = []
    if heavy:
        few = spark.createDataFrame([(b,) for b in heavy], "bundle int")
        groups = rows.join(F.broadcast(few), "bundle").groupBy("grp", "bundle").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        large = [tuple(x) for x in groups.where(F.col("size") > mean).select("grp", "bundle", "size", "n").collect()]
    rest = {b: list(x) for b, x in load.items()}
    for _, b, s, n in large:
        rest[b][0] -= s
        rest[b][1] -= n
    at = lpt([(s, (0, b)) for b, (s, _) in rest.items()] + [(s, (1, g)) for g, _, s, _ in large], n_shards)
    of_bundle = spark.createDataFrame([(b, at[0, b]) for b in rest], "bundle int, bundle_shard int")
    of_group = spark.createDataFrame([(g, at[1, g]) for g, *_ in large], "grp long, group_shard int")
    count = dict.fromkeys(range(n_shards), 0)
    for k, n in [((0, b), n) for b, (_, n) in rest.items()] + [((1, g), n) for g, _, _, n in large]:
        count[at[k]] += n
    return of_bundle, of_group, count


def _bundle(n_shards: int) -> Column:
    return F.pmod("grp", F.lit(n_shards * ITEMS_PER_SHARD)).cast("int")


def shard(docs: DataFrame, n_shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its size, text_crc32, law ("bytes"), shard, slot and grown_shard (null under this law).

    Equal texts are a group and stay in one shard, so the sizes of shards are near equal as far as no group is larger than
    a shard. Groups hash into n_shards * ITEMS_PER_SHARD bundles; a group larger than a mean bundle is taken out of its
    bundle (there are fewer of those than bundles, by arithmetic). Bundles and large groups are the items of the schedule,
    so the driver's heap and the broadcast tables have a fixed bound. Slots run from 0 without gaps: rows are numbered
    within cells of ROWS_PER_CELL rows or so, as many as the rows of the shard ask for, so that neither a group with a
    third of all rows nor a row that repeats as often is numbered in one task.

    Null texts: size 16, CRC of the empty text, one group. Empty table: no rows. Repeated rows each get their own slot.
    Other columns of docs, of any name, are ignored. Equal sizes are ordered by bundle or group hash, so reruns agree.
    """
    spark, text = docs.sparkSession, F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), _text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.xxhash64(text).alias("grp"))
    rows = staged(rows.withColumn("seq", F.monotonically_increasing_id()), "sized")  # fixed by being written
    of_bundle, of_group, count = _schedule(rows, n_shards)
    cells = spark.createDataFrame([(s, -(-n // ROWS_PER_CELL) or 1) for s, n in count.items()], "shard int, cells int")
    rows = (
        rows.withColumn("bundle", _bundle(n_shards)).join(F.broadcast(of_bundle), "bundle").join(F.broadcast(of_group), "grp", "left").withColumn("shard", F.coalesce("group_shard", "bundle_shard"))
        .join(F.broadcast(cells), "shard").select("doc_id", "size", "text_crc32", "seq", "shard", F.pmod(F.xxhash64("seq"), F.col("cells")).cast("int").alias("cell"))
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32", "seq"))
    return rows.join(first, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + within - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(docs: DataFrame, n_shards: int = 40, *, text_col: str = "text") -> DataFrame:
    """The rows of docs with all their columns, and the shard that shard() gives them; a column of that name is replaced.

    Cases as in shard(). The texts aren't shuffled: every task looks its rows' shards up in tables of bounded size.
    """
    text = lambda d: d[f"`{text_col}`"]
    of_bundle, of_group, _ = _schedule(staged(docs.select(_text_size(text(docs)).alias("size"), F.xxhash64(text(docs)).alias("grp")), "sized"), n_shards)
    own = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns if c.lower() != "shard")).alias("row"), F.xxhash64(text(docs)).alias("grp")).withColumn("bundle", _bundle(n_shards))
    own = own.join(F.broadcast(of_bundle), "bundle").join(F.broadcast(of_group), "grp", "left")
    return own.select("row.*", F.coalesce("group_shard", "bundle_shard").alias("shard"))
