"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, mix, own_folder, put, staged, text_batches

#: Code points that a key has at least.
LEAST_KEY = 10
SLOTS = 4
#: Shared keys of one shard when its filter is made. The filter has room for twice as many, 2 MB at most.
KEYS_PER_SHARD = 250_000
#: Lines that one task asks a shard's filter about; more of them are more tasks, each with the filter.
LINES_PER_CELL = 300_000
#: Keys that have more than 1 / HOT of all references to shared keys are joined by themselves: HOT keys at most, by arithmetic.
HOT = 1_000
#: Change tables that are read together before they are written as one.
MOST_CHANGES = 8
_LAST = 2**63 - 1


class Cuckoo:
    """A cuckoo filter of 64-bit hashes: 16-bit fingerprints in buckets of four, and a stash for what finds no room.

    Whole arrays are inserted, looked up and deleted at once. A fingerprint and either of its buckets give the other, so
    deleting takes out what was inserted, or its equal in all respects.
    """

    def __init__(self, most: int) -> None:
        """With room for `most` hashes at a load of three quarters; more are stashed."""
        self.table = np.zeros((2 ** max(4, int(np.ceil(np.log2(max(1, most) / (SLOTS * 0.75))))), SLOTS), np.uint16)
        self.stash = np.zeros((0, 2), np.int64)  # fingerprint and the smaller of its buckets

    def _of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = ((h >> np.uint64(48)) % np.uint64(0xFFFF) + np.uint64(1)).astype(np.uint16)
        i = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return fp, i, self._other(i, fp)

    def _other(self, i: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return i ^ (mix(fp.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _place(self, fp: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of their buckets; which ones found room."""
        order = np.argsort(i, kind="stable")
        b = i[order]
        start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
        rank = np.arange(len(b)) - np.repeat(start, np.diff(np.r_[start, len(b)]))
        free = self.table[b] == 0
        fits = rank < free.sum(1)
        slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(b)), np.minimum(rank, SLOTS - 1)]
        self.table[b[fits], slot[fits]] = fp[order][fits]
        ok = np.zeros(len(b), bool)
        ok[order[fits]] = True
        return ok

    def insert(self, h: np.ndarray) -> None:
        fp, i, j = self._of(h)
        ok = self._place(fp, i)
        fp, i = fp[~ok], j[~ok]
        rng = np.random.default_rng(len(h))
        for _ in range(200):
            if not len(fp):
                return
            ok = self._place(fp, i)
            fp, i = fp[~ok], i[~ok]
            if len(fp):  # in each bucket one takes the place of another, which moves on
                first = np.unique(i, return_index=True)[1]
                slot = rng.integers(0, SLOTS, len(first))
                out = self.table[i[first], slot]
                self.table[i[first], slot] = fp[first]
                fp[first] = out
                i[first] = self._other(i[first], out)
        self.stash = np.concatenate([self.stash, np.c_[fp, np.minimum(i, self._other(i, fp))].astype(np.int64)])

    def _stashed(self, fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Each as one number."""
        return fp.astype(np.int64) << 40 | np.minimum(i, j)

    def holds(self, h: np.ndarray) -> np.ndarray:
        fp, i, j = self._of(h)
        out = (self.table[i] == fp[:, None]).any(1) | (self.table[j] == fp[:, None]).any(1)
        return out | np.isin(self._stashed(fp, i, j), self.stash[:, 0] << 40 | self.stash[:, 1]) if len(self.stash) else out

    def delete(self, h: np.ndarray) -> None:
        """Takes one fingerprint of each out; only what was inserted may be deleted."""
        fp, i, j = self._of(h)
        flat = self.table.reshape(-1)
        while len(fp):
            in_i, in_j = self.table[i] == fp[:, None], self.table[j] == fp[:, None]
            own = in_i.any(1)
            hit, place = np.where(own[:, None], in_i, in_j), np.where(own, i, j)
            at = place * SLOTS + hit.argmax(1)
            can = np.flatnonzero(hit.any(1))
            done = can[np.unique(at[can], return_index=True)[1]]  # two that mean the same slot: one now, one in the next turn
            if not len(done):
                break
            flat[at[done]] = 0
            left = np.ones(len(fp), bool)
            left[done] = False
            fp, i, j = fp[left], i[left], j[left]
        if len(fp) and len(self.stash):
            own = self.stash[:, 0] << 40 | self.stash[:, 1]
            order, want = np.argsort(own, kind="stable"), np.sort(self._stashed(fp, i, j))
            nth = np.arange(len(want)) - np.searchsorted(want, want)
            at = np.searchsorted(own[order], want) + nth
            there = at < len(own)
            there[there] = own[order][at[there]] == want[there]
            self.stash = np.delete(self.stash, order[at[there]], axis=0)

    def to_bytes(self) -> bytes:
        return np.array([len(self.table)], np.int64).tobytes() + self.table.tobytes() + self.stash.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        out = cls(1)
        out.table = np.frombuffer(data, np.uint16, n * SLOTS, 8).reshape(n, SLOTS).copy()
        out.stash = np.frombuffer(data, np.int64, offset=8 + 2 * n * SLOTS).reshape(-1, 2).copy()
        return out


def key_of(line: str) -> bytes | None:
    """The digest of a line's key, or None where the key is too short to count."""
    key = line.strip(SPACES)
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest() if len(key) >= LEAST_KEY else None


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ids and texts, the distinct keys of each text with its id."""
    for b in batches:
        ids, keys = [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = {k for x in (t.as_py() or "").split("\n") if (k := key_of(x))}
            ids += [i] * len(own)
            keys += own
        h, g = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(ids, pa.int64())], ["h", "g", b.schema.names[0]])


def _shard(shards: int) -> Column:
    """The shard of a key, by the first half of its digest; its other bits place it in the filter."""
    return F.pmod(F.shiftrightunsigned("h", 20).bitwiseAND(F.lit(2**27 - 1)), F.lit(shards)).cast("int")


_REFS, _COUNTS, _FILTERS = "h long, g long, doc_id long, batch int", "h long, g long, batch int, n long, first long", "shard int, filter binary"
_KEY = ["h", "g"]


class LineStore:
    """Which lines which documents hold, kept in a folder that all machines share; insertions and deletions are exact.

    A key is two longs, h and g: the halves of its digest.
    refs: a row for each document and distinct key, by batch; gone: deleted ids, by batch. A reference lives unless its
    document was deleted in a later batch, so deleting a document brings back the lines that it kept others from keeping.
    counts: for each key the number of documents that hold it and the smallest of their ids, by batch; the last batch
    holds. A change writes the keys that it touches only; MOST_CHANGES of such tables are written as one.
    filters: for each shard of the key space a cuckoo filter of the keys of two or more documents, changed by what enters
    and leaves them. Shards are as many as KEYS_PER_SHARD asks for; when the keys have doubled, all are made anew.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        """In path, or in a folder of its own that goes with what is staged."""
        self.spark, self.path, self.batch, self.shards, self.most = spark, path or own_folder(spark, "lines"), 0, 1, 0
        self._refs: list[str] = []
        self._gone: list[str] = []
        self._counts: list[str] = []
        self._filters: str | None = None

    def _write(self, df: DataFrame, name: str) -> str:
        out = f"{self.path}/{name}-{self.batch}"
        put(df, out)
        return out

    def _read(self, paths: list[str] | str | None, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*([paths] if isinstance(paths, str) else paths)) if paths else self.spark.createDataFrame([], schema)

    def references(self) -> DataFrame:
        """(h, g, doc_id) that live now."""
        refs = self._read(self._refs, _REFS)
        if self._gone:
            gone = self._read(self._gone, "doc_id long, batch int").groupBy("doc_id").agg(F.max("batch").alias("until"))
            refs = refs.join(gone, (refs["doc_id"] == gone["doc_id"]) & (refs["batch"] < gone["until"]), "left_anti")
        return refs.select("h", "g", "doc_id")

    def counts(self) -> DataFrame:
        """(h, g, n, first) of every key that a document holds: how many do, and the smallest of their ids."""
        rows = self._read(self._counts, _COUNTS)
        if len(self._counts) > 1:
            rows = rows.groupBy(*_KEY).agg(F.max(F.struct("batch", "n", "first")).alias("x")).select(*_KEY, "x.n", "x.first")
        return rows.select(*_KEY, "n", "first").where("n > 0")

    def shared(self) -> DataFrame:
        """(h, g, n, first) of the keys that two or more documents hold."""
        return self.counts().where("n > 1")

    def filters(self) -> DataFrame:
        return self._read(self._filters, _FILTERS)

    def insert(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds documents. A null id counts as the largest."""
        text_batches(self.spark)
        self.batch += 1
        rows = docs.select(F.coalesce(F.col(id_col), F.lit(_LAST)).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        refs = rows.mapInArrow(_lines, "h long, g long, doc_id long").withColumn("batch", F.lit(self.batch))
        self._refs.append(self._write(refs, "refs"))
        self._update(self._read(self._refs[-1], _REFS) if len(self._refs) > 1 else None)

    def delete(self, ids: DataFrame, *, id_col: str = "doc_id") -> None:
        """Takes documents out again; ids that aren't there change nothing."""
        self.batch += 1
        gone = ids.select(F.coalesce(F.col(id_col), F.lit(_LAST)).cast("long").alias("doc_id")).distinct()
        touched = self._read(self._write(self.references().join(gone, "doc_id", "left_semi").select("h", "g"), "touched"), "h long, g long")
        self._gone.append(self._write(gone.withColumn("batch", F.lit(self.batch)), "gone"))
        self._update(touched)

    def _update(self, touched: DataFrame | None) -> None:
        """Counts the touched keys anew, all where None, and changes the filters by the keys that became shared or no longer are."""
        refs = self.references()
        count = lambda d: d.groupBy(*_KEY).agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("first"))
        if touched is None:
            self._counts = [self._write(count(refs).select(*_KEY, F.lit(self.batch).alias("batch"), "n", "first"), "counts")]
            return self._make_filters()
        keys = touched.select(*_KEY).distinct()
        now = keys.join(count(refs.join(keys, _KEY, "left_semi")), _KEY, "left").select(*_KEY, F.lit(self.batch).alias("batch"), F.coalesce("n", F.lit(0)).alias("n"), "first")
        now = self._read(self._write(now, "counts"), _COUNTS)
        before = self.counts().join(now.select(*_KEY), _KEY, "left_semi").select(*_KEY, F.col("n").alias("old"))
        change = now.join(before, _KEY, "left").select("h", (F.col("n") > 1).alias("is"), (F.coalesce("old", F.lit(0)) > 1).alias("was")).where("is <> was")
        change = self._read(self._write(change.select(_shard(self.shards).alias("shard"), "h", F.col("is").alias("enters")), "change"), "shard int, h long, enters boolean")
        self._counts.append(f"{self.path}/counts-{self.batch}")
        if len(self._counts) > MOST_CHANGES:
            self._counts = [self._write(self.counts().select(*_KEY, F.lit(self.batch).alias("batch"), "n", "first"), "counts-whole")]
        if self.shared().count() > self.most:
            return self._make_filters()

        def change_filter(shard: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            f = Cuckoo.from_bytes(old["filter"].iloc[0])
            for enters, act in ((False, f.delete), (True, f.insert)):
                act(new["h"][new["enters"] == enters].to_numpy(np.int64).view(np.uint64))
            return pd.DataFrame({"shard": [shard[0]], "filter": [f.to_bytes()]})

        made = self.filters().groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(change_filter, _FILTERS)
        self._filters = self._write(made, "filters")

    def _make_filters(self) -> None:
        """All filters anew, each of KEYS_PER_SHARD keys or so, with room for twice as many."""
        shared = self.shared()
        n = shared.count()
        self.shards = shards = -(-n // KEYS_PER_SHARD) or 1
        self.most = 2 * max(n, 1_000)
        room = 2 * (-(-max(n, 1_000) // shards))

        def fill(shard: tuple, _: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            f = Cuckoo(room)
            f.insert(keys["h"].to_numpy(np.int64).view(np.uint64))
            return pd.DataFrame({"shard": [shard[0]], "filter": [f.to_bytes()]})

        every = self.spark.range(shards).select(F.col("id").cast("int").alias("shard")).groupBy("shard")
        own = shared.select(_shard(shards).alias("shard"), "h").groupBy("shard")
        self._filters = self._write(every.cogroup(own).applyInPandas(fill, _FILTERS), f"filters-{shards}")

    def held(self, asked: DataFrame) -> DataFrame:
        """The rows of (h, g, id) whose key the filter of its shard holds.

        Lines go to their shard, dealt out over cells by id, and each cell gets the filter ahead of its lines. Within a
        task the rows are a stream sorted by cell, so that one filter is held at a time.
        """
        shards = self.shards
        cells = -(-asked.count() // (shards * LINES_PER_CELL)) or 1
        filters = self.filters().select("shard", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), "filter", *(F.lit(None).cast("long").alias(c) for c in ("h", "g", "id")))
        lines = asked.select(_shard(shards).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int").alias("cell"), F.lit(None).cast("binary").alias("filter"), "h", "g", "id")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now: Cuckoo | None = None
            for b in batches:
                new, keep = b.column("filter"), np.zeros(b.num_rows, bool)
                ends = [*np.flatnonzero(np.asarray(new.is_valid())).tolist(), b.num_rows]
                h = np.asarray(b.column("h").fill_null(0)).view(np.uint64)
                start = 0
                for end in ends:
                    if end > start and now is not None:
                        keep[start:end] = now.holds(h[start:end])
                    if end < b.num_rows:
                        now = Cuckoo.from_bytes(new[end].as_py())
                    start = end + 1
                yield b.select(["h", "g", "id"]).filter(pa.array(keep))

        dealt = filters.unionByName(lines).repartition(shards * cells, "shard", "cell") if shards * cells > 1 else filters.unionByName(lines).coalesce(1)
        return dealt.sortWithinPartitions("shard", "cell", F.col("filter").isNull()).mapInArrow(probe, "h long, g long, id long")

    def dedup(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_lines, n_dropped, text) of every row of docs: without the lines that a document of smaller id holds.

        The filters leave out most lines that no other document holds; the rest are joined with the exact counts, and
        what is to be dropped with the texts. Keys that very many lines have are joined by broadcast.
        Null and empty texts are one empty line. Repeated rows of one id are one document. Other columns are ignored.
        """
        rows = docs.select(F.coalesce(F.col(id_col), F.lit(_LAST)).cast("long").alias("id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        text_batches(self.spark)
        asked = rows.select("id", "text").mapInArrow(_lines, "h long, g long, id long")
        return self._without(rows, staged(asked, "asked"))

    def _without(self, rows: DataFrame, asked: DataFrame) -> DataFrame:
        hits = staged(self.held(asked), "hits")
        exact = staged(self.shared(), "shared")
        hot = exact.where(F.col("n") > (exact.agg(F.sum("n")).first()[0] or 0) / HOT)
        common, others = hits.join(F.broadcast(hot), _KEY), hits.join(F.broadcast(hot.select(*_KEY)), _KEY, "left_anti")
        drops = common.select("id", *_KEY, "first").unionByName(others.join(exact, _KEY).select("id", *_KEY, "first"))
        drops = drops.where(F.col("first") != F.col("id")).groupBy("id").agg(F.collect_set(F.struct(*_KEY)).alias("drop"))

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lines, n, texts = [], [], []
                for t, d in zip(b.column(1), b.column(2), strict=True):
                    text = t.as_py() or ""
                    gone = {np.array([k["h"], k["g"]]).tobytes() for k in d.as_py() or ()}
                    all_ = text.split("\n")
                    own = [x for x in all_ if key_of(x) not in gone] if gone else all_
                    lines.append(len(all_))
                    n.append(len(all_) - len(own))
                    texts.append("\n".join(own) if gone else text)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lines, pa.int64()), pa.array(n, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

        return rows.join(staged(drops, "drops"), "id", "left").select("doc_id", "text", "drop").mapInArrow(kept, "doc_id long, n_lines long, n_dropped long, text string")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """LineStore.dedup() of docs among themselves."""
    store = LineStore(docs.sparkSession)
    store.insert(docs, id_col=id_col, text_col=text_col)
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(_LAST)).cast("long").alias("id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return store._without(rows, store.references().select("h", "g", F.col("doc_id").alias("id")))
