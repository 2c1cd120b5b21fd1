"""Benchmark decontamination by latent semantic retrieval, verified by longest common subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import staged, text_batches

_words = re.compile(r"\w+")
#: Words of a passage of the term statistics and of the decomposition.
PASSAGE = 64
#: Latent dimensions, and more of them that the randomised decomposition carries.
RANK, MORE, POWER_STEPS, RESIDUAL, SEED = 24, 8, 1, 48, 7
#: Least cosine of a candidate; least share of an item's words, and of its answer's if it has one, in common order.
COSINE, COMMON, ANSWER = 0.5, 0.6, 0.5
#: Benchmark rows, and bytes of their texts, that are searched at once; with them, what is broadcast is bounded. More rows are
#: further blocks, and a row of more bytes is a block by itself.
BLOCK, BLOCK_BYTES = 2_000, 4 << 20
#: Words of an item beyond which it is split, so that a long item is found by its parts. They overlap by half at least, and the last one ends the item.
PART = 256


@dataclass
class Items:
    """A block of benchmark items: parts as term numbers, with their answers."""

    vocabulary: dict[str, int]
    terms: list[np.ndarray]
    answers: list[np.ndarray]
    ids: list
    sizes: np.ndarray  # the window size of each part
    places: list[dict[int, int]]
    answer_places: list[dict[int, int]]


def words(text: str | None) -> list[str]:
    return _words.findall((text or "").lower())


def window_size(n: int) -> int:
    size = 8
    while size * 1.5 < n:
        size *= 2
    return size


def items_of(rows: list[tuple]) -> Items:
    """Of (id, text, answer or None). An item without an answer is asked for none."""
    vocabulary: dict[str, int] = {}
    number = lambda ws: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64)
    terms, answers, ids = [], [], []
    for i, text, answer in rows:
        ws = words(text)
        for k in (*range(0, len(ws) - PART, PART // 2), max(0, len(ws) - PART)) if ws else ():
            part = ws[k : k + PART]
            terms.append(number(part))
            answers.append(number(words(answer)))
            ids.append(i)
    return Items(vocabulary, terms, answers, ids, np.array([window_size(len(t)) for t in terms], int), [places_of(t) for t in terms], [places_of(t) for t in answers])


def numbered(text: str | None, vocabulary: dict[str, int]) -> np.ndarray:
    """The term number of each word of the whole text, -1 for words that no item has."""
    ws = words(text)
    return np.fromiter((vocabulary.get(w, -1) for w in ws), np.int32, len(ws))


def _passages(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each known word its passage and its term."""
    at = np.flatnonzero(ids >= 0)
    return at // PASSAGE, ids[at].astype(np.int64)


def _summed(parts: DataFrame, n: int, width: int) -> np.ndarray:
    """The sum over all rows of (term, values) as a matrix of n x width."""
    out = np.zeros((n, width))
    total = parts.groupBy("term").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(width))).alias("v")).toArrow()
    for t, v in zip(total.column("term").to_pylist(), total.column("v").to_pylist(), strict=True):
        out[t] = v
    return out


def document_frequencies(ids: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Of each term the number of passages that hold it, and the number of passages; over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, all_ = np.zeros(n + 1), 0
        for b in batches:
            for x in b.column(0):
                own = np.frombuffer(x.as_buffer(), np.int32)
                p, t = _passages(own)
                df[:n] += np.bincount(np.unique(p * n + t) % n, minlength=n)
                all_ += -(-len(own) // PASSAGE)
        df[n] = all_
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at][:, None].tolist(), pa.list_(pa.float64()))], ["term", "v"])

    got = _summed(ids.mapInArrow(count, "term long, v array<double>"), n + 1, 1)[:, 0]
    return got[:n], int(got[n])


def gram_times(ids: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A' A q for the matrix A of all TF-IDF passages, in one pass over the documents; passages have equal numbers of words."""
    n, width = q.shape

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, weighted = np.zeros((n, width)), (idf[:, None] * q).astype(np.float32)

        def add(passage: np.ndarray, t: np.ndarray) -> None:
            start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
            y = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(passage)]))
            sums, order = np.add.reduceat(weighted[t], start), np.argsort(t.astype(np.int16) if n < 2**15 else t, kind="stable")
            first = np.flatnonzero(np.r_[True, t[order][1:] != t[order][:-1]])
            out[t[order][first]] += np.add.reduceat(sums[y[order]], first)

        for b in batches:
            passages, found, base, held = [], [], 0, 0
            for x in b.column(0):
                p, t = _passages(np.frombuffer(x.as_buffer(), np.int32))
                if len(t):
                    passages.append(p + base)
                    found.append(t)
                    base, held = base + int(p[-1]) + 1, held + len(t)
                if held > 5_000:  # what stays in a cache
                    add(np.concatenate(passages), np.concatenate(found))
                    passages, found, base, held = [], [], 0, 0
            if held:
                add(np.concatenate(passages), np.concatenate(found))
        out *= idf[:, None]
        at = np.flatnonzero(np.abs(out).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out[at].tolist(), pa.list_(pa.float64()))], ["term", "v"])

    return _summed(ids.mapInArrow(multiply, "term long, v array<double>"), n, width)


def latent_terms(ids: DataFrame, n: int, rank: int = RANK) -> np.ndarray:
    """A vector for each term, so that sums over a text are latent vectors: idf times its row of the leading right
    singular vectors of all passages, and of the residual's projection.

    Randomised SVD: a random start is multiplied by A' A (one pass over the documents each time) and made orthonormal;
    the small matrix Q' A' A Q gives the directions within. What these leave out - above all the words of items that
    few passages hold, whose directions are too weak to lead - is kept by a random projection in RESIDUAL dimensions.
    """
    df, passages = document_frequencies(ids, n)
    idf = np.log((passages + 1) / (df + 1)) + 0.05
    rank = min(rank, n)
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, min(n, rank + MORE))))[0]
    for _ in range(1 + POWER_STEPS):
        z = gram_times(ids, idf, q)
        small = q.T @ z
        basis = q
        q = np.linalg.qr(z + 1e-9 * q)[0]
    _, u = np.linalg.eigh((small + small.T) / 2)
    lead = basis @ u[:, ::-1][:, :rank]
    rest = np.random.default_rng(SEED + 1).standard_normal((n, RESIDUAL)) / np.sqrt(RESIDUAL)
    return (idf[:, None] * np.c_[lead, rest - lead @ (lead.T @ rest)]).astype(np.float32)


def places_of(a: np.ndarray) -> dict[int, int]:
    """Of each term the bits of its places."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def common_length(masks: dict[int, int], n: int, b: list[int]) -> int:
    """The length of the longest common subsequence of b and the n terms whose places are given, by bits of one integer."""
    v = full = (1 << n) - 1
    for y in b:
        if m := masks.get(y):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


#: Words of texts, and windows, that are searched in one go.
TOGETHER, WINDOWS = 8_000, 4_096


def find(texts: list[np.ndarray], items: Items, terms: np.ndarray, targets: np.ndarray) -> list[dict]:
    """For each numbered text, of each item found: (common share, cosine, first word, last word) of its best place.

    Latent vectors of windows are differences of running sums over blocks of words; no window reaches over the end of a
    text. Of neighbouring windows the one with the largest cosine is verified, over a place of three times its size: an item has at most one and a half.
    """
    out: list[dict] = [{} for _ in texts]
    known = np.r_[terms, np.zeros((1, terms.shape[1]), np.float32)]  # -1, of unknown words, is the last
    k = 0
    while k < len(texts) and len(items.ids):
        end, held = k, 0
        while end < len(texts) and (end == k or held + len(texts[end]) <= TOGETHER):
            held += len(texts[end])
            end += 1
        _find(texts[k:end], out[k:end], items, known, targets)
        k = end
    return out


def _find(texts: list[np.ndarray], out: list[dict], items: Items, known: np.ndarray, targets: np.ndarray) -> None:
    block = max(2, int(items.sizes.min()) // 4)
    n = np.array([-(-len(t) // block) for t in texts])
    base = np.r_[0, np.cumsum(n)]
    total = int(base[-1])
    flat = np.full(total * block, -1, np.int32)
    for t, b in zip(texts, base.tolist(), strict=False):
        flat[b * block : b * block + len(t)] = t
    if not total:
        return
    doc = np.repeat(np.arange(len(texts)), n)
    first, last, index = base[doc], base[doc + 1], np.arange(total)
    sums = known[flat[::block]]
    for j in range(1, block):
        sums += known[flat[j::block]]
    run = np.zeros((total + 1, known.shape[1]))
    np.cumsum(sums, axis=0, out=run[1:])
    for size in np.unique(items.sizes):
        own, wide = np.flatnonzero(items.sizes == size), max(1, int(size) // block)
        stride = max(1, wide // 4)
        windows = np.flatnonzero(((index - first) % stride == 0) & ((index == first) | (index + wide < last + stride)))
        aims = targets[own].T
        for k in range(0, len(windows), WINDOWS):
            lo = max(0, k - 1)
            s = windows[lo : k + WINDOWS + 1]  # one more on either side, to see where the maxima are
            z = (run[np.minimum(s + wide, last[s])] - run[s]).astype(np.float32)
            z /= np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-12)[:, None]
            cos = z @ aims
            if cos.max() < COSINE:
                continue
            near = (doc[s[1:]] == doc[s[:-1]])[:, None]
            hit = cos >= COSINE
            hit[1:] &= ~near | (cos[1:] >= cos[:-1])
            hit[:-1] &= ~near | (cos[:-1] > cos[1:])
            for w, i in zip(*np.nonzero(hit), strict=True):
                if not k <= lo + w < k + WINDOWS:
                    continue
                _verify(out[doc[s[w]]], items, int(own[i]), float(cos[w, i]), texts[doc[s[w]]], int(s[w] - first[s[w]]) * block, wide * block, int(size))


def _verify(found: dict, items: Items, item: int, cosine: float, text: np.ndarray, at: int, wide: int, size: int) -> None:
    best = found.get(items.ids[item])
    if best and best[0] >= 1:
        return
    lo, hi = max(0, at - size), min(len(text), at + wide + size)
    place = text[lo:hi].tolist()
    share = common_length(items.places[item], len(items.terms[item]), place) / len(items.terms[item])
    if share < COMMON or best and best[0] >= share:
        return
    answer = items.answers[item]
    if not len(answer) or common_length(items.answer_places[item], len(answer), place) >= ANSWER * len(answer):
        found[items.ids[item]] = (share, cosine, lo, hi)


def _after(row) -> Column:
    """The rows behind a row in the order of (i, t, a), nulls first."""
    out = F.lit(False)
    for c in reversed(row.__fields__):
        v = row[c]
        behind = F.col(c).isNotNull() if v is None else F.col(c) > F.lit(v)
        out = behind | (F.col(c).eqNullSafe(F.lit(v)) & out)
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None) -> Iterator[Items]:
    """The benchmark in blocks of BLOCK distinct rows, or of BLOCK_BYTES if that is less, by id, text and answer; the driver
    holds one block at a time. A block may end within an id."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("a")).distinct()
    last = None
    while True:
        rest = (rows if last is None else rows.where(_after(last))).orderBy("i", "t", "a")
        sizes = [r.n for r in rest.limit(BLOCK).select((F.octet_length("t") + F.coalesce(F.octet_length("a"), F.lit(0))).alias("n")).collect()]
        if not sizes:
            return
        block = rest.limit(max(1, int(np.searchsorted(np.cumsum(sizes), BLOCK_BYTES, side="right")))).collect()
        last = block[-1]
        yield items_of([tuple(r) for r in block])


def _merged(hits: Column) -> Column:
    """Of the hits of all blocks the best of each item, by id: an item whose rows lie in several blocks may have several."""
    ranked = F.array_sort(F.transform(hits, lambda h, n: F.struct(h["item_id"].alias("id"), (-h["common"]).alias("order"), n.alias("n"), h.alias("hit"))))
    best = lambda r: F.filter(r, lambda x, n: (n == 0) | ~x["id"].eqNullSafe(F.get(r, n - 1)["id"]))
    return F.transform(F.element_at(F.transform(F.array(ranked), best), 1), lambda x: x["hit"])


def searches(docs: DataFrame, benchmark: DataFrame, *, id_col: str | None = None, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> Iterator:
    """For each block of items (ids, hits): a table of doc_id and numbered text, with the ids of id_col, and a function
    from a column, of texts or of numbered texts, to its hits: array<struct<item_id, common, cosine, first, last>>."""
    text_batches(docs.sparkSession)
    kind = benchmark.schema[item_id].dataType.simpleString()
    item_kind = to_arrow_type(benchmark.schema[item_id].dataType)
    for items in _blocks(benchmark, item_id, item_text, answer_col):
        vocabulary = items.vocabulary

        def number(batches: Iterator[pa.RecordBatch], vocabulary=vocabulary) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([numbered(t.as_py(), vocabulary).tobytes() for t in b.column(1)], pa.binary())], ["doc_id", "ids"])

        if not vocabulary:
            continue
        named = docs.select((F.col(id_col) if id_col else F.lit(None).cast("long")).alias("doc_id"), F.col(text_col).alias("text"))
        ids = staged(named.mapInArrow(number, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, ids binary"), "terms")
        terms = latent_terms(ids.select("ids"), len(vocabulary))
        targets = np.array([terms[t].sum(0) for t in items.terms], np.float32)
        targets /= np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-12)

        def hits(text: Column, is_numbered: bool = False, items=items, terms=terms, targets=targets) -> Column:
            @F.arrow_udf(f"array<struct<item_id: {kind}, common: double, cosine: double, first: int, last: int>>")
            def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for texts in batches:
                    numbers = [np.frombuffer(t.as_buffer(), np.int32) if is_numbered else numbered(t.as_py(), items.vocabulary) for t in texts]
                    ends, flat = [0], []
                    for g in find(numbers, items, terms, targets):
                        flat += [(i, *g[i]) for i in sorted(g, key=lambda i: (i is not None, i))]
                        ends.append(len(flat))
                    columns = list(zip(*flat, strict=True)) or [()] * 5
                    kinds = (item_kind, pa.float64(), pa.float64(), pa.int32(), pa.int32())
                    own = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item_id", "common", "cosine", "first", "last"])
                    yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own)

            return found(text)

        yield ids, hits


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """(doc_id, contaminated 0 or 1, n_items, item_ids, common, cosine, hits) of every row of docs.

    Windows over the whole text, of the sizes that the items have, with a quarter's stride, are candidates where their
    latent cosine with an item is at least COSINE; an item is found where a place has COMMON of its words in order, and
    where the benchmark has an answer_col, ANSWER of its answer's. Hits carry word positions.

    Null and empty texts have no hits, nor do items of null text. Rows of one item_id are one item, those without an id
    too, whose id is null. Repeated rows get equal results. An empty benchmark finds nothing; an empty table gives no
    rows. Other columns are ignored. Any number of items, and of rows of one item, is searched, in blocks.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = list(searches(docs, benchmark, id_col=id_col, text_col=text_col, **names))
    if not parts:
        return own.select("doc_id", F.lit(0).alias("contaminated"), F.lit(0).alias("n_items"), F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("common"), F.lit(0.0).alias("cosine"), F.array().cast("array<struct<item_id: long, common: double, cosine: double, first: int, last: int>>").alias("hits"))
    if len(parts) == 1:
        out = parts[0][0].select("doc_id", parts[0][1](F.col("ids"), True).alias("hits"))
    else:
        out = own.select("doc_id", _merged(F.concat(*(h(F.col("text")) for _, h in parts))).alias("hits"))
    top = lambda c: F.coalesce(F.array_max(F.transform("hits", lambda h: h[c])), F.lit(0.0))
    return out.select("doc_id", (F.size("hits") > 0).cast("int").alias("contaminated"), F.size("hits").alias("n_items"), F.col("hits.item_id").alias("item_ids"), top("common").alias("common"), top("cosine").alias("cosine"), "hits")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **names) -> DataFrame:
    """The rows of docs, with all their columns, in which no item of the benchmark is found."""
    out = docs
    for _, h in searches(docs, benchmark, text_col=text_col, **names):
        out = out.where(F.size(h(docs[f"`{text_col}`"])) == 0)
    return out
