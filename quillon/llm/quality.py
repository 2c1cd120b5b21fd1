"""Quality by hierarchical empirical Bayes: evidence of the document, its path and its host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import MAX_TRAIN, Model, Sample, features_of, fit, fit_sample
from .common import staged

KEEP_AT = 0.5
#: Prior strengths, in documents, are held within these.
LEAST, MOST = 1.0, 10_000.0


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(q / (1 - q))


def strength(groups: DataFrame) -> float:
    """The strength of the prior above groups of (n, total, squares, above), by the method of moments.

    Groups vary around the mean above them more than their documents' own variance explains; that excess is the
    variance of a beta prior. Many alike sites give a strong prior, differing ones a weak one.
    """
    mean, n = F.col("total") / F.col("n"), F.col("n")
    within = F.greatest(F.lit(0.0), F.col("squares") / n - mean * mean) / n
    r = groups.agg(F.sum(n * (mean - F.col("above")) ** 2).alias("between"), F.sum(n * within).alias("within"), F.sum(n).alias("n"), F.sum(n * F.col("above") * (1 - F.col("above"))).alias("top")).first()
    if not r.n:
        return MOST
    spread = (r.between - r.within) / r.n
    return float(min(MOST, max(LEAST, r.top / r.n / spread - 1))) if spread > 1e-12 else MOST


def posteriors(rows: DataFrame) -> DataFrame:
    """rows of (doc_id, host, path, p) with p_host, p_path and score.

    The document classifier's p is the evidence. A host's mean shrinks to the global mean, a path's mean to its host's,
    by prior strengths that are learnt from all groups; sparse sites so stay near what is known above them. A document's
    own evidence is left out of its site's means. The score adds, in log-odds, the document's evidence and how far its
    path lies from the global mean. All is grouped aggregation and joins on the site.
    """
    p = F.col("p")
    sums = lambda d, *by: d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(p).alias("total"), F.sum(p * p).alias("squares"))
    paths = staged(sums(rows, "host", "path"), "paths")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")))
    top = hosts.agg(F.sum("total") / F.sum("n")).first()[0]
    mu = float(top) if top is not None else 0.5
    k_host = strength(hosts.withColumn("above", F.lit(mu)))
    hosts = staged(hosts.withColumn("above_host", (F.col("total") + k_host * mu) / (F.col("n") + k_host)), "hosts")
    k_path = strength(paths.join(hosts.select("host", F.col("above_host").alias("above")), "host"))
    sites = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("total").alias("host_total")), "host")
    out = rows.join(sites.select("host", "path", "n", "total", "host_n", "host_total"), ["host", "path"])
    out = out.withColumn("p_host", (F.col("host_total") - p + k_host * mu) / (F.col("host_n") - 1 + k_host))
    out = out.withColumn("p_path", (F.col("total") - p + k_path * F.col("p_host")) / (F.col("n") - 1 + k_path))
    z = logit(p) + logit(F.col("p_path")) - logit(F.lit(mu))
    return out.withColumn("score", 1 / (1 + F.exp(-z)))


def _fitted(rows: Sample) -> list[Model]:
    return [fit(rows.words, rows.form, np.zeros((len(rows.y), 0)), rows.y[:, 0])]


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", most: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, p_doc, p_host, p_path, score, quality 0 or 1) of every row of docs; 1 is kept.

    The document classifier is fitted on at most `most` labelled rows, by linear.sample(); every row counts in the site statistics. Null
    hosts or paths are sites of their own. Null texts count as empty. Without labels each p is 0.5. Repeated rows all
    count. Empty table: no rows. Other columns are ignored.
    """
    (model,) = fit_sample(_fitted, docs, labels, [F.col(label_col)], id_col=id_col, text_col=text_col, most=most)

    @F.arrow_udf("double")
    def evidence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            (words,), form = features_of((t.as_py() for t in texts), [model])
            yield pa.array(model.predict(words, form, np.zeros((len(form), 0))), pa.float64())

    site = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    scored = staged(docs.select(F.col(id_col).alias("doc_id"), site(host_col).alias("host"), site(path_col).alias("path"), evidence(text_col).alias("p")), "evidence")
    return posteriors(scored).select("doc_id", F.col("p").alias("p_doc"), "p_host", "p_path", "score", (F.col("score") >= KEEP_AT).cast("int").alias("quality"))
