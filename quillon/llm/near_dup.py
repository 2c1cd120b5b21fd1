"""Near-duplicates by Order MinHash, verified by banded alignment of five-word shingles."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, labelled, mix, shingles, staged, text_batches

WORDS, SIMILARITY = 5, 0.8
#: Sketches of two ordered minima each; BAND of them make a bucket key. At a similarity of 0.8 a sketch agrees with
#: a chance of about 0.8 ** 2, a band with that to the third power, one of 24 bands with 0.999.
BANDS, BAND = 24, 3
SKETCHES = BANDS * BAND
#: Sketches of SKETCHES that a pair must share to be aligned where a bucket is compared beyond its leader: of 46
#: expected at a similarity of 0.8, with a deviation of 4, so a pair falls below with a chance of about 1e-5.
AGREE = 28
#: Shingles that a text is compared by where a bucket is compared beyond its leader: all, and from twice SAMPLE on those
#: whose hashes fall under a power of 1/2 that leaves SAMPLE to 2 * SAMPLE. Then the similarity is estimated, with a
#: deviation of at most 0.0125, so MARGIN is seven deviations.
SAMPLE, MARGIN = 1024, 0.09
_rng = np.random.default_rng(20240917)
_XOR = _rng.integers(0, 2**63, SKETCHES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = np.uint64(2**64 - 1)


def sketch(labels: np.ndarray) -> np.ndarray:
    """SKETCHES hashes, each of the two labelled shingles that come first under its own random order, in text order."""
    out, n = np.empty(SKETCHES, np.uint64), len(labels)
    step = max(1, 400_000 // n)
    for k in range(0, SKETCHES, step):
        v = (labels[None, :] ^ _XOR[k : k + step, None]) * _MUL[k : k + step, None]
        row = np.arange(len(v))
        i = v.argmin(1)
        v[row, i] = _TOP
        j = v.argmin(1) if n > 1 else i
        out[k : k + step] = mix(labels[np.minimum(i, j)] * np.uint64(3) + mix(labels[np.maximum(i, j)]))
    return out


def bands(sketches: np.ndarray) -> np.ndarray:
    s = sketches.reshape(BANDS, BAND)
    out = np.arange(BANDS).astype(np.uint64)
    for j in range(BAND):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + s[:, j])
    return out.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Common labelled shingles in the same order, over all of both: at least the least similarity, or else 0.

    With that similarity, at most d = (1 - least) / (1 + least) of both lengths are unmatched, so matching places lie
    in a band of that width. Labels occur once in a text, so the longest common subsequence within the band is the
    longest increasing run of places.
    """
    total = len(a) + len(b)
    need = least / (1 + least) * total
    if not total or min(len(a), len(b)) < need - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    keep = np.abs(i - j) <= total - 2 * need + 1
    i, j = i[keep], j[keep]
    if len(i) < need - 1e-9:
        return 0.0
    places = j[np.argsort(i)]
    if np.all(places[1:] > places[:-1]):
        m = len(places)
    else:
        ends: list[int] = []
        for p in places.tolist():
            at = bisect_left(ends, p)
            ends[at : at + 1] = [p]
        m = len(ends)
    found = m / (total - m)
    return found if found >= least - 1e-9 else 0.0


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, nodes, n, b, s = [], [], [], [], []
        for i, node, text in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = labelled(shingles(text.as_py() or "", WORDS))
            ids.append(i.as_py())
            nodes.append(node)
            n.append(len(words))
            found = sketch(words) if len(words) else None
            b.append([] if found is None else bands(found))
            s.append([] if found is None else (found & np.uint64(0x7FFFFFFF)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(nodes, pa.binary()), pa.array(n, pa.int64()), pa.array(b, pa.list_(pa.int64())), pa.array(s, pa.list_(pa.int32()))], ["doc_id", "node", "n", "bands", "sketch"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: dict = {}

    def of(node: bytes, text: str) -> np.ndarray:
        if node not in last:
            if len(last) > 64:
                last.clear()
            last[node] = labelled(shingles(text, WORDS))
        return last[node]

    for batch in batches:
        a, b, ta, tb = batch.columns
        ok = [bool(aligned(labelled(shingles(x.as_py(), WORDS)), of(n.as_py(), y.as_py()))) for x, n, y in zip(ta, b, tb, strict=True)]
        yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        levels, samples = [], []
        for t in batch.column(1):
            h = mix(labelled(shingles(t.as_py(), WORDS)) + np.uint64(1)) >> np.uint64(2)
            levels.append(max(0, (len(h) // SAMPLE).bit_length() - 1))
            samples.append(h[h < np.uint64(2**62 >> levels[-1])].astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels, pa.int32()), pa.array(samples, pa.list_(pa.int64()))], ["node", "level", "sample"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_node: bool = False) -> DataFrame:
    """(doc_id, class_id, is_kept) of every row of docs: texts linked by an ordered five-word similarity of 0.8 or more,
    directly or by way of others, are one class, named by its smallest doc_id; is_kept marks that document.

    1. Equal texts become one node at once (grouped by digest), so copies cost nothing further.
    2. Nodes meet in the buckets of their bands. A bucket's leader is the node whose buckets are the fullest in all -
       among copies of one text with small edits, the text itself. Every other member is aligned with the leader.
    3. Members that the leader's class did not take are compared with the members of other classes in their buckets, by
       sketches and then by samples of labelled shingles - whole ones for texts of up to 2,047 - within the join, which
       reports only those that have the similarity. Nothing is capped, and a bucket that its leader resolved makes no
       comparisons at all.
    4. Those are aligned too. Verified links become classes by alternating stars.

    Null texts are no one's copies: each row is a class of its own. Texts without words are only linked to equal texts;
    texts of 1 to 4 words are one shingle. Ties go to the smaller id. Repeated rows share a class; all rows of the
    smallest id are marked as kept. Empty table: no rows. Other columns are ignored.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("node"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = staged(rows.mapInArrow(_sketches, f"doc_id {kind}, node binary, n long, bands array<long>, sketch array<int>"), "sketches")
    nodes = made.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    banded = nodes.select("node", "doc_id", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    buckets = staged(banded.join(shared, "band"), "buckets")
    central = buckets.groupBy("node").agg(F.sum("members").alias("central"))
    leaders = buckets.join(central, "node").groupBy("band").agg(F.max(F.struct("central", "n", "node")).alias("x")).select("band", F.col("x.node").alias("leader"), F.col("x.n").alias("leader_n"))
    buckets = staged(buckets.join(leaders, "band"), "led")
    near_leader = F.least("n", "leader_n") >= SIMILARITY * F.greatest("n", "leader_n") - 1e-9
    first = staged(buckets.where(near_leader & (F.col("node") != F.col("leader"))).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    some = buckets.select(F.col("node").alias("own"), F.col("doc_id").alias("own_id")).distinct()
    texts = rows.join(some, (F.col("node") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("own_id")))  # rows without an id too
    texts = staged(texts.dropDuplicates(["node"]).select("node", "text"), "texts")

    def tested(pairs: DataFrame) -> DataFrame:
        a, b = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
        return staged(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a binary, b binary"), "tested")

    links = tested(first)
    of = buckets.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lead = of.where("node = leader").select("band", F.col("root").alias("lead_root"))
    of = of.join(lead, "band").withColumn("is_rest", F.col("root") != F.col("lead_root"))
    of = staged(of.join(of.where("is_rest").select("band").distinct(), "band", "left_semi"), "open")
    some = of.select("node").distinct()
    samples = texts.join(some, "node", "left_semi").mapInArrow(_samples, "node binary, level int, sample array<long>")
    sketches = made.where("node is not null").select("node", "sketch").join(some, "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch"))
    wanted = staged(sketches.join(samples, "node"), "wanted")
    side = lambda d, x: d.join(wanted, "node").select("band", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "root", "leader", "is_rest", "sketch", "level", "sample")))
    agree = F.size(F.filter(F.zip_with("sketch_x", "sketch_y", lambda p, q: p == q), lambda p: p))
    level = F.greatest("level_x", "level_y")
    own = lambda x: F.when(F.col(f"level_{x}") == level, F.col(f"sample_{x}")).otherwise(F.filter(f"sample_{x}", lambda h: h < F.call_function("shiftright", F.lit(2**62), level)))
    both, all_ = F.size(F.array_intersect(own("x"), own("y"))), F.size(own("x")) + F.size(own("y"))
    similar = both >= F.when(level == 0, SIMILARITY - 1e-9).otherwise(SIMILARITY - MARGIN) * (all_ - both)
    apart = (
        (F.col("root_x") != F.col("root_y")) & (F.col("node_y") != F.col("leader_y")) & (~F.col("is_rest_y") | (F.col("node_x") < F.col("node_y")))
        & (F.least("n_x", "n_y") >= SIMILARITY * F.greatest("n_x", "n_y") - 1e-9) & (agree >= AGREE) & similar
    )
    x, y = side(of.where("is_rest"), "x"), side(of, "y")
    second = staged(x.join(y, (x["band"] == y["band"]) & apart).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct(), "pairs")
    classes = components(links.union(tested(second)))
    named = classes.join(nodes.select("node", "doc_id"), "node")
    names = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    alone = nodes.join(classes, "node", "left_anti").select("node", F.col("doc_id").alias("class_id"), F.col("node").alias("root"))
    named = named.join(names, "root").select("node", "class_id", "root").unionByName(alone)
    out = made.select("doc_id", "node").join(named, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), *["node", "root"] * with_node)
    return out.withColumn("is_kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which each class keeps one: that of its smallest id. Cases as in
    near_duplicates().

    Of rows that repeat id and text one stays. Classes are told apart by their texts, so ids that repeat with unlike
    texts, or are null, lose no class.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, with_node=True)
    kept = found.where("is_kept and node is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("x"))
    kept = kept.select(F.col("x.doc_id").alias("_kept_id"), F.col("x.node").alias("_kept_node"))
    row = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    own = row.select("row", F.col("row")[id_col].alias("_id"), F.unhex(F.md5(F.col("row")[text_col].cast("binary"))).alias("_node"))
    some = own.where("_node is not null").join(kept, (F.col("_id").eqNullSafe(F.col("_kept_id"))) & (F.col("_node") == F.col("_kept_node")), "left_semi")
    return some.dropDuplicates(["_id", "_node"]).select("row.*").unionByName(own.where("_node is null").select("row.*"))
