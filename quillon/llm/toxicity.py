"""Toxicity by a classifier chain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import MAX_TRAIN, Model, Sample, features_of, fit, fit_sample, out_of_fold

#: The chain, in order: each later model also sees the earlier probabilities. The labels give two categories, of which
#: the first, low quality, is no kind of toxicity but goes with it; other labels make another chain.
CHAIN = {"low_quality": lambda: F.lit(1) - F.col("quality"), "toxic": lambda: F.col("toxic")}
#: Chosen on held-out labelled rows, where it gave no false alarm.
REJECT_AT = 0.3
#: Texts whose words are weighed together.
TOGETHER = 512


def _fitted(rows: Sample) -> list[Model]:
    earlier, models = np.zeros((len(rows.y), 0)), []
    for c in range(rows.y.shape[1]):
        y = rows.y[:, c]
        models.append(fit(rows.words, rows.form, earlier, y))
        if c + 1 < rows.y.shape[1]:
            earlier = np.c_[earlier, out_of_fold(rows.words, rows.form, earlier, y, rows.texts)]
    return models


def fit_chain(docs: DataFrame, labels: DataFrame, chain: dict = CHAIN, *, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> list[Model]:
    """A model for each category. Later models are trained with out-of-fold predictions of the earlier ones, so they
    learn to trust them as far as they hold on unseen rows. Fitted on at most `most` labelled rows, in a task."""
    return fit_sample(_fitted, docs, labels, [y() for y in chain.values()], id_col=id_col, text_col=text_col, most=most)


def predict_chain(models: list[Model], texts) -> np.ndarray:
    """A row for each text, a column for each category. Of a text's words only those that a model knows are kept."""
    words, form = features_of(texts, models)
    out = np.zeros((len(form), 0))
    for m, own in zip(models, words, strict=True):
        out = np.c_[out, m.predict(own, form, out)]
    return out


def probabilities(models: list[Model], text: Column, chain: dict = CHAIN) -> Column:
    """A struct with the probability of each category, of every whole text. The models have MAX_WORDS words each at most."""

    @F.arrow_udf(", ".join(f"{c} double" for c in chain))
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            p = np.concatenate([predict_chain(models, (t.as_py() for t in texts[k : k + TOGETHER])) for k in range(0, len(texts), TOGETHER)] or [np.zeros((0, len(chain)))])
            yield pa.StructArray.from_arrays([pa.array(p[:, i], pa.float64()) for i in range(len(chain))], list(chain))

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, chain: dict = CHAIN, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category> of each category, toxic 0 or 1 by the last one) of every row of docs.

    Null texts count as empty and get the probabilities of an empty text. Labels that are null, without a document or of
    one kind only are tolerated: without any, every probability is the share of that label (0.5 if there is none).
    Repeated rows get equal results. Empty table: no rows. Other columns are ignored.
    """
    models = fit_chain(docs, labels, chain, id_col=id_col, text_col=text_col)
    p = docs.select(F.col(id_col).alias("doc_id"), probabilities(models, F.col(text_col), chain).alias("p"))
    return p.select("doc_id", *(F.col(f"p.{c}").alias(f"p_{c}") for c in chain), (F.col(f"p.{list(chain)[-1]}") > REJECT_AT).cast("int").alias("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, chain: dict = CHAIN, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the last category doesn't reject."""
    models = fit_chain(docs, labels, chain, id_col=id_col, text_col=text_col)
    return docs.where(probabilities(models, docs[f"`{text_col}`"], chain)[list(chain)[-1]] <= REJECT_AT)
