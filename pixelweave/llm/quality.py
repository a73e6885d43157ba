"""Quality by hierarchical empirical Bayes: a document's own evidence under the posteriors of its host and path.

A logistic classifier over the shape of a whole text gives a document's log-likelihood ratio. What its site adds is the
share of good documents there, of the others: the host's from the mean of its documents, shrunk toward the global one, and
the path's from its own documents, shrunk toward the host's. A document's own evidence is left out of all three, so it
counts once. How much a sparse site is shrunk follows from how much sites differ, by moments: hosts around the global mean,
paths around their host's. All of this is grouped aggregation with partial sums, so a host of any size is no burden.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_small, row_udf
from .labelled import held_out, sample

RIDGE, NEWTON, KEEP = 1.0, 30, 0.5

#: Bounds of the documents that a prior counts as, and of a document's log-likelihood ratio.
LEAST, MOST, EVIDENCE = 5.0, 1e6, 12.0

#: Kinds of characters: lower case, upper case, digit, white space, bar, exclamation mark, other symbols.
LOWER, UPPER, DIGIT, SPACE, BAR, MARK, SYMBOL, OTHER = range(8)


def _kinds() -> np.ndarray:
    out = np.full(1 << 16, OTHER, np.uint8)
    for c in range(1 << 16):
        s = chr(c)
        if s.isupper():
            out[c] = UPPER
        elif s.isalpha():
            out[c] = LOWER
        elif s.isdigit():
            out[c] = DIGIT
        elif s.isspace():
            out[c] = SPACE
        elif s in "|":
            out[c] = BAR
        elif s in "!":
            out[c] = MARK
        elif s in "%*$#&@^~<>=+\\_{}[]":
            out[c] = SYMBOL
    return out


_table: list[np.ndarray] = []

#: Code points that are counted at once.
BLOCK = 1 << 20


def shape(text: str | None) -> list[float]:
    """What a whole text looks like; all of it finite, for an empty text too."""
    if not _table:
        _table.append(_kinds())
    text = text or ""
    n = max(len(text), 1)
    count = np.zeros(8)
    for at in range(0, len(text), BLOCK):
        code = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        count += np.bincount(_table[0][np.minimum(code, 0xFFFF)], minlength=8)
    words = text.split()
    k = max(len(words), 1)
    lines = text.split("\n")
    letters = max(count[LOWER] + count[UPPER], 1)
    return [
        count[UPPER] / letters,
        (count[BAR] + count[MARK] + count[SYMBOL] + count[OTHER]) / n,
        count[BAR] / k,
        count[MARK] / k,
        count[SYMBOL] / k,
        count[DIGIT] / n,
        len(set(words)) / k,
        float(np.log1p(len(words))),
        sum(map(str.__eq__, words, words[1:])) / k,
        len(set(lines)) / len(lines),
        min(n / k, 50.0),
        float(np.log1p(k / len(lines))),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the constant
    prior: float  # log odds of the sample that it was fitted to

    def evidence(self, texts: list) -> list[float]:
        """Log-likelihood ratios of good against bad."""
        if not texts:
            return []
        z = np.clip((np.array([shape(t) for t in texts]) - self.mean) / self.scale, -10, 10)
        return np.clip(z @ self.weights[:-1] + self.weights[-1] - self.prior, -EVIDENCE, EVIDENCE).tolist()


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Ridge logistic regression by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[np.clip((x - mean) / scale, -10, 10), np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), RIDGE * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(NEWTON):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, scale, w, float(np.log(y.mean() / (1 - y.mean()))))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from a bounded sample of labelled rows (labelled.SAMPLE of each class); without both classes None."""
    shapes = row_udf(lambda texts: [shape(t) for t in texts], "array<double>")  # on the executors: the driver gets no text
    rows = sample(docs, labels, "quality").select("label", shapes(F.col("text")).alias("x")).collect()
    y = np.array([r["label"] for r in rows], float)
    return train(np.array([r["x"] for r in rows]), y) if len(set(y)) == 2 else None


def evidence(text: Column, model: Model | None) -> Column:
    """The log-likelihood ratio of each whole text; without a model 0."""
    return F.lit(0.0) if model is None else row_udf(model.evidence, "double")(text.cast("string"))


def _probability(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _log_odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, by: list[str]) -> float:
    """Documents that a prior counts as, for groups (n, s: the sum of their probabilities) within what they have in common:
    by how much their means differ beyond what their sizes explain."""
    n, s = F.col("n"), F.col("s")
    per = groups.groupBy(*by).agg(F.sum(n).alias("all"), F.sum(s).alias("sum"), F.count(F.lit(1)).alias("k"), F.sum(s * s / n).alias("q"), F.sum(n * n).alias("n2"))
    rate = F.col("sum") / F.col("all")
    noise = rate * (1 - rate)
    got = per.agg(F.sum(F.col("q") - rate * F.col("sum")), F.sum((F.col("k") - 1) * noise), F.sum(F.col("all") - F.col("n2") / F.col("all")), F.sum(F.col("all") * noise), F.sum("all"), F.max("k")).first()
    if not got[4] or got[5] < 2:
        return MOST
    spread, common = (got[0] - got[1]) / max(got[2], 1e-9), got[3] / got[4]
    return float(min(max(common / spread - 1, LEAST), MOST)) if spread > 0 else MOST


@dataclass
class Sites:
    """The sums of each path and of its host, one row per host and path, and those of all documents."""

    table: DataFrame
    rows: int
    rate: float  # the global share of good documents to begin with
    total: float
    good: float
    strengths: tuple[float, float]  # of the global prior for hosts, of a host's for paths


def _own(rate: float) -> Column:
    """A document's probability by its own evidence."""
    return _probability(F.col("llr") + float(np.log(rate / (1 - rate))))


def sites(rows: DataFrame, rate: float) -> Sites:
    """What posteriors need, from (host, path, llr) of all documents."""
    paths = checkpoint(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(_own(rate)).alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    n, total, good = paths.agg(F.count(F.lit(1)), F.sum("n"), F.sum("s")).first()
    strengths = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s")), []), _strength(paths, ["host"])
    table = join_small(paths, hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")), n)
    return Sites(checkpoint(table.select("h", F.col("path").alias("p"), "n", "s", "host_n", "host_s")), n, rate, float(total or 0), float(good or 0), strengths)


def _combined(rows: DataFrame, by: Sites) -> DataFrame:
    """rows (host, path, llr and more) with host_posterior, path_posterior and score, the row's own evidence counted once."""
    a, b = by.strengths
    own = _own(by.rate)
    every = (by.good - own + by.rate) / by.total if by.total else F.lit(by.rate)
    every = F.least(F.greatest(every, F.lit(1e-3)), F.lit(1 - 1e-3))
    out = join_small(rows, by.table, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), by.rows)
    out = out.withColumn("host_posterior", (F.col("host_s") - own + a * every) / (F.col("host_n") - 1 + a))
    out = out.withColumn("path_posterior", (F.col("s") - own + b * F.col("host_posterior")) / (F.col("n") - 1 + b))
    return out.drop("h", "p", "n", "s", "host_n", "host_s").withColumn("score", _probability(F.col("llr") + _log_odds(F.col("path_posterior"))))


def _prior(labels: DataFrame) -> float:
    """The share of good ones among the labels that are not held out."""
    got = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg("quality")).first()[0]
    return 0.5 if got is None else min(max(float(got), 0.01), 0.99)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, llr, host_posterior, path_posterior, score and keep (score of KEEP or more) for each row of docs.

    The source is the host and the language the path below it. Null sources and languages are sites of their own. Null
    and empty texts have the evidence of an empty shape. Repeated rows count and are scored each on its own. Empty
    table: no rows. Of docs only doc_id, text, source and lang are read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("path"))
    model = fit(docs, labels)
    rows = checkpoint(docs.select("doc_id", "host", "path", evidence(F.col("text"), model).alias("llr")))
    out = _combined(rows, sites(rows, _prior(labels)))
    return out.select("doc_id", "llr", "host_posterior", "path_posterior", "score", (F.col("score") >= KEEP).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that classify() keeps; nulls, repeated rows and empty tables as there.

    The texts are read twice, and shuffled only where there are more than common.BROADCAST_ROWS sites.
    """
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("path"))
    model = fit(plain, labels)
    by = sites(plain.select("host", "path", evidence(F.col("text"), model).alias("llr")), _prior(labels))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("path"), evidence(F.col("text"), model).alias("llr"))
    return _combined(rows, by).where(F.col("score") >= KEEP).select("row.*")
