"""Linear text models: hashed words chosen by chi-square, logistic regression by Newton steps, out-of-fold predictions."""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: Labelled rows that a model is fitted on at most: those whose ids and texts hash lowest. Everything else reads all rows.
MAX_TRAIN = 12_000
#: Words of one model, and the chi-square that each must reach (by chance: one word in a thousand).
MAX_WORDS, LEAST_CHI2 = 256, 10.83
FOLDS = 5
#: Rows that a Newton step takes at a time.
ROWS = 1_024
_words, _upper, _marks = re.compile(r"\w+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\w\s]+")


def features(text: str | None) -> tuple[set[int], list[float]]:
    """Hashes of the distinct lower-cased words of the whole text, and figures of its form."""
    text = text or ""
    found = _words.findall(text.lower())
    distinct, n, chars = set(found), len(found) or 1, len(text) or 1
    upper, marks = chars - len(_upper.sub("", text)), chars - len(_marks.sub("", text))
    lines = text.split("\n")
    form = [
        np.log1p(len(found)), sum(map(len, found)) / n, len(distinct) / n, upper / chars, marks / chars,
        1 - len(set(lines)) / len(lines), np.log1p(len(lines)), (text.count("!!") + text.count("|") + text.count("%%") + text.count("$$")) / n,
    ]
    return {zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in distinct}, form


N_FORM = len(features("")[1])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [features(t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays(
            [b.column(1), b.column(2), pa.array([zlib.crc32((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(0)], pa.int64()), pa.array([np.fromiter(w, np.int64, len(w)) for w, _ in got], pa.list_(pa.int64())), pa.array([f for _, f in got], pa.list_(pa.float64()))], ["y", "h", "text", "words", "form"]
        )


@dataclass
class Sample:
    words: list[np.ndarray]
    form: np.ndarray
    y: np.ndarray  # a column for each label
    texts: np.ndarray  # a hash of each text


_SAMPLE = "y array<int>, h long, text long, words array<long>, form array<double>"


def _sampled(docs: DataFrame, labels: DataFrame, ys: list, id_col: str, text_col: str, most: int) -> DataFrame:
    text_batches(docs.sparkSession)
    few = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.array(*(y.cast("int") for y in ys)).alias("y")).where(~F.exists("y", F.isnull))
    few = few.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "label_id")
    rows = rows.select("text", "y", F.xxhash64("label_id", "text").alias("h"))
    return rows.mapInArrow(_featured, _SAMPLE).orderBy("h", "y").limit(most)


def _as_sample(got: pa.Table, n: int) -> Sample:
    """The sample of n labels that a table holds."""
    words = got.column("words").combine_chunks()
    flat, ends = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
    return Sample(
        [flat[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.array(got.column("form").to_pylist(), float).reshape(-1, N_FORM), np.array(got.column("y").to_pylist(), int).reshape(-1, n),
        np.array(got.column("text").to_pylist(), np.int64),
    )


def sample(docs: DataFrame, labels: DataFrame, ys: list, *, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> Sample:
    """Features of at most `most` labelled rows, made on the executors; ys are columns of labels, 0 or 1.

    Where rows or labels repeat an id, each pair of a row and a label is a labelled row, and the bound holds for those:
    they are ordered by a hash of id and text, and each task hands on `most` of them at most.
    """
    return _as_sample(_sampled(docs, labels, ys, id_col, text_col, most).toArrow(), len(ys))


def fit_sample(make: Callable[[Sample], list[Model]], docs: DataFrame, labels: DataFrame, ys: list, *, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> list[Model]:
    """The models that make fits on sample(), made in a task: the driver gets neither the rows nor what the fit takes."""
    n, empty = len(ys), pa.schema([("y", pa.list_(pa.int32())), ("h", pa.int64()), ("text", pa.int64()), ("words", pa.list_(pa.int64())), ("form", pa.list_(pa.float64()))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        models = make(_as_sample(pa.Table.from_batches(own) if own else empty.empty_table(), n))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(models)], pa.binary())], ["models"])

    got = _sampled(docs, labels, ys, id_col, text_col, most).mapInArrow(made, "models binary").collect()
    return pickle.loads(got[0].models) if got else make(_as_sample(empty.empty_table(), n))  # a table known to be empty has no task


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 12) -> np.ndarray:
    """Weights, the bias last: ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    if y.min(initial=1) == y.max(initial=0):
        return w
    for _ in range(steps):
        curve, slope = np.diag(ridge), ridge * w
        for k in range(0, len(y), ROWS):  # so that no second matrix is made
            own = np.c_[x[k : k + ROWS], np.ones(len(y[k : k + ROWS]))]
            p = _sigmoid(own @ w)
            curve += (own * (p * (1 - p))[:, None]).T @ own
            slope += own.T @ (p - y[k : k + ROWS])
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


@dataclass
class Model:
    """One linear model: chosen words, scaled form figures, and the probabilities of earlier models of a chain."""

    words: dict[int, int] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def matrix(self, words: list, form: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        x = np.zeros((len(words), len(self.words)))
        for i, own in enumerate(words):
            for h in own:
                if (j := self.words.get(int(h))) is not None:
                    x[i, j] = 1
        return np.c_[x, (form - self.mean) / self.scale, 2 * earlier - 1]

    def predict(self, words: list, form: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        x = self.matrix(words, form, earlier)
        return _sigmoid(x @ self.weights[:-1] + self.weights[-1])


def features_of(texts, models: list[Model]) -> tuple[list[list[set[int]]], np.ndarray]:
    """For each model the words that it knows of each text, and the figures of form; text by text, so little is held."""
    words: list[list[set[int]]] = [[] for _ in models]
    form = []
    for t in texts:
        w, f = features(t)
        form.append(f)
        for own, m in zip(words, models, strict=True):
            own.append(m.words.keys() & w)
    return words, np.array(form, float).reshape(-1, N_FORM)


def fit(words: list, form: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Model:
    all_, yes = Counter(), Counter()
    for own, v in zip(words, y, strict=True):
        all_.update(own.tolist())
        if v:
            yes.update(own.tolist())
    n, p = len(y), int(y.sum())
    rank = []
    for h, a in all_.items():
        if a >= 3 and p and n - p:
            b = yes[h]
            d = b * n - a * p
            if a < n and (chi2 := n * d * d / (a * (n - a) * p * (n - p))) >= LEAST_CHI2:
                rank.append((chi2, h))
    model = Model({h: j for j, (_, h) in enumerate(sorted(rank, key=lambda x: (-x[0], x[1]))[:MAX_WORDS])})
    model.mean, model.scale = (form.mean(0), form.std(0) + 1e-9) if n else (np.zeros(N_FORM), np.ones(N_FORM))
    model.weights = fit_logistic(model.matrix(words, form, earlier), y.astype(float))
    return model


def out_of_fold(words: list, form: np.ndarray, earlier: np.ndarray, y: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each row the probability by a model that hasn't seen its text: equal texts lie in one fold, by their hash."""
    fold, out = texts % FOLDS, np.full(len(y), y.mean() if len(y) else 0.0)
    for f in range(FOLDS):
        own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        if len(own) and len(rest):
            out[own] = fit([words[i] for i in rest], form[rest], earlier[rest], y[rest]).predict([words[i] for i in own], form[own], earlier[own])
    return out
