"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the mean of those of its hashed parts: the word itself, its starts and its ends. Filters over one,
two and three words are followed by max pooling over the whole text and a logistic layer. Texts are scored whole, in
blocks of words. The language is no input; thresholds by language are calibrated on rows that the weights have not seen.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, row_udf
from .labelled import CHARS, held_out, sample
from .tokens import Chunks, Memory

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 8, 6, (1, 2, 3)
EPOCHS, STEPS, BATCH, STEP, DECAY, SEED = 5, 400, 64, 0.02, 1e-4, 11  # at least so many epochs and steps

#: Words that are convolved at once, and characters of the texts that are numbered at once.
BLOCK, CHARACTERS = 1 << 16, 1_000_000

#: The parts of a word: it, its starts and its ends of these lengths. Padded to one number of parts.
STARTS, ENDS = (3, 4, 5, 6), (3, 4)
PARTS = 1 + len(STARTS) + len(ENDS)

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def parts(word: str) -> list[int]:
    """Buckets of a word's parts, bucket 0 where it is too short for one; all 0 for the empty word of an empty text."""
    if not word:
        return [0] * PARTS
    w = word.lower().strip(_EDGE)
    keys = ["=" + w, *("<" + w[:n] if len(w) > n else "" for n in STARTS), *(">" + w[-n:] if len(w) > n else "" for n in ENDS)]
    return [zlib.crc32(k.encode()) % (BUCKETS - 1) + 1 if k else 0 for k in keys]


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS x DIM, row 0 zero
    filters: list  # for each width: width x DIM x FILTERS
    bias: np.ndarray  # a number for each filter of each width
    weights: np.ndarray
    offset: float
    thresholds: dict  # by language; None: for all

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        """Embeddings of words from the buckets of their parts."""
        n = np.maximum((buckets > 0).sum(axis=1, keepdims=True), 1)
        return self.embedding[buckets].sum(axis=1) / n

    def projections(self, vectors: np.ndarray) -> list[np.ndarray]:
        """What a word adds to the filters of each width at each place."""
        return [vectors @ f[k] for f in self.filters for k in range(len(f))]


class Scorer:
    """Scores texts by a model; the distinct words of some hundred texts are projected once."""

    def __init__(self, model: Model):
        self.model = model
        self.parts = Memory(lambda w: np.array(parts(w), np.int32).tobytes(), 60_000)

    def scores(self, texts: list[str | None]) -> list[float]:
        out: list[float] = []
        part: list[str] = []
        size = 0
        for t in texts:
            if part and size + len(t or "") > CHARACTERS:
                out += self._some(part)
                part, size = [], 0
            part.append(t or "")
            size += len(t or "")
        return out + (self._some(part) if part else [])

    def _some(self, texts: list[str]) -> list[float]:
        m = self.model
        chunks = Chunks.of(pa.array(texts, pa.large_string()))
        table = np.frombuffer(b"".join([self.parts[w] for w in chunks.distinct]) or bytes(4 * PARTS), np.int32).reshape(-1, PARTS)
        # row 0 is the blank that fills texts up to the widest filter
        projected = [np.vstack([np.zeros((1, FILTERS), np.float32), p.astype(np.float32)]) for p in m.projections(m.vectors(table))]
        which, bounds = chunks.which.to_numpy() + 1, chunks.bounds
        pooled = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        pad = max(WIDTHS) - 1
        lengths = np.maximum(bounds[1:] - bounds[:-1], 1)
        starts = np.concatenate([[0], np.cumsum(lengths + pad)])
        stream = np.zeros(starts[-1], np.int64)
        real = np.repeat(starts[:-1] - bounds[:-1], bounds[1:] - bounds[:-1]) + np.arange(bounds[0], bounds[-1])
        stream[real] = which[bounds[0] : bounds[-1]]
        ends = starts[:-1] + lengths  # windows start at a word, or at the blank of a text without words
        for at in range(0, len(stream), BLOCK):
            to = min(at + BLOCK, len(stream) - pad)
            if to <= at:
                break
            lo, hi = np.maximum(starts[:-1], at), np.minimum(ends, to)
            docs = np.flatnonzero(lo < hi)
            if not len(docs):
                continue
            edges = np.stack([lo[docs], hi[docs]], 1).reshape(-1) - at
            k = 0
            for i, width in enumerate(WIDTHS):
                z = projected[k][stream[at:to]]
                for j in range(1, width):
                    z = z + projected[k + j][stream[at + j : to + j]]
                k += width
                best = np.maximum.reduceat(np.vstack([z, np.full((1, FILTERS), -np.inf, np.float32)]), edges, axis=0)[::2]
                column = slice(i * FILTERS, (i + 1) * FILTERS)
                pooled[docs, column] = np.maximum(pooled[docs, column], best)
        x = np.maximum(pooled + m.bias, 0) @ m.weights + m.offset
        return (1 / (1 + np.exp(-np.clip(x.astype(np.float64), -30, 30)))).tolist()


def gradients(m: Model, table: np.ndarray, streams: list[np.ndarray], y: np.ndarray) -> tuple[float, list]:
    """The mean logistic loss with DECAY of the weights, and its gradients: embedding, filters, bias, weights, offset.

    A stream numbers a text's words by the rows of table, the buckets of their parts, and ends in blanks for the filters.
    """
    pad = max(WIDTHS) - 1
    words, inverse = np.unique(np.concatenate(streams), return_inverse=True)
    vec = m.vectors(table[words])
    proj = m.projections(vec)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    pooled, where, k = [], [], 0
    for f in m.filters:
        z = proj[k][inverse].copy()
        for j in range(1, len(f)):
            z[:-j] += proj[k + j][inverse[j:]]
        k += len(f)
        at_max = np.array([a + z[a : b - pad].argmax(axis=0) for a, b in zip(bounds, bounds[1:])])
        where.append(at_max)
        pooled.append(z[at_max, np.arange(FILTERS)])
    h = np.concatenate(pooled, 1) + m.bias
    r = np.maximum(h, 0)
    x = np.clip(r @ m.weights + m.offset, -30, 30)
    loss = float(np.mean(np.logaddexp(0, x) - y * x) + DECAY / 2 * (m.weights**2).sum())
    g = (1 / (1 + np.exp(-x)) - y) / len(y)
    gh = np.outer(g, m.weights) * (h > 0)
    ge, gf = np.zeros(m.embedding.shape), [np.zeros_like(f) for f in m.filters]
    for i, f in enumerate(m.filters):
        gz = gh[:, i * FILTERS : (i + 1) * FILTERS]
        for j in range(len(f)):
            w = inverse[where[i] + j]  # texts x FILTERS: the word under place j of the best window
            gf[i][j] = np.einsum("bfd,bf->df", vec[w], gz)
            buckets = table[words[w]]
            share = gz[:, :, None] * f[j].T[None] / np.maximum((buckets > 0).sum(-1), 1)[..., None]
            for q in range(PARTS):
                np.add.at(ge, buckets[:, :, q], share)
    ge[0] = 0
    return loss, [ge, *gf, gh.sum(0), r.T @ g + DECAY * m.weights, g.sum()]


def train(texts: list[str], y: np.ndarray, seed: int = SEED) -> Model:
    """Fit by Adam on the logistic loss; a gradient reaches the words at which a filter has its maximum.

    The first dimension starts as the log odds of a part between the classes, so that the maxima start at telling words.
    """
    rng = np.random.default_rng(seed)
    chunks = Chunks.of(pa.array(texts, pa.large_string()))
    table = np.array([[0] * PARTS, *(parts(w) for w in chunks.distinct)], np.int32)
    pad = max(WIDTHS) - 1
    streams = [np.concatenate([chunks.which.to_numpy()[a:b] + 1 if b > a else [0], np.zeros(pad, np.int64)]).astype(np.int32) for a, b in zip(chunks.bounds, chunks.bounds[1:])]
    seen = np.full((2, BUCKETS), 0.5)
    for s, c in zip(streams, y):
        seen[int(c), np.unique(table[np.unique(s)])] += 1
    odds = np.log(seen[1] / (y.sum() + 1)) - np.log(seen[0] / (len(y) - y.sum() + 1))
    e = rng.normal(0, 0.05, (BUCKETS, DIM))
    e[:, 0] = np.clip(odds, -3, 3) / 3
    e[0] = 0
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.5
    m = Model(e, filters, np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.1, len(WIDTHS) * FILTERS), 0.0, {})
    for i in range(len(WIDTHS)):
        m.weights[i * FILTERS : i * FILTERS + FILTERS // 2] = 0.5
    values = [m.embedding, *m.filters, m.bias, m.weights]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    offset = [0.0, 0.0, 0.0]
    step = 0
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(texts)))):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            _, (ge, *rest, gb0) = gradients(m, table, [streams[i] for i in batch], y[batch])
            step += 1
            rate = STEP * min(1.0, step / 20)
            for v, (a, b), grad in zip(values, moments, [ge, *rest]):
                a *= 0.9
                a += 0.1 * grad
                b *= 0.999
                b += 0.001 * grad * grad
                v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6)
            offset[1] = 0.9 * offset[1] + 0.1 * gb0
            offset[2] = 0.999 * offset[2] + 0.001 * gb0 * gb0
            m.offset -= rate * (offset[1] / (1 - 0.9**step)) / (np.sqrt(offset[2] / (1 - 0.999**step)) + 1e-6)
    m.embedding = m.embedding.astype(np.float32)
    return m


def best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The threshold of least errors, in the middle of the gap where it lies."""
    order = np.argsort(scores)
    s, c = scores[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(c)]) + np.concatenate([[0], np.cumsum(1 - c)])[-1] - np.concatenate([[0], np.cumsum(1 - c)])
    edges = np.concatenate([[0.0], (s[1:] + s[:-1]) / 2, [1.0]])
    best = np.flatnonzero(wrong == wrong.min())
    return float(edges[best[len(best) // 2]])


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from a bounded sample of labelled rows (labelled.SAMPLE and labelled.CHARS of each class), none held out.

    A quarter of the sample is left for calibration: the offset is moved so that 0.5 is the threshold for all languages
    together, and each language with enough rows of both classes gets its own. Without rows of both classes: None.
    """
    rows = sample(docs, labels, "toxic", ["lang"], chars=CHARS).collect()
    y = np.array([r["label"] for r in rows], float)
    if len(set(y)) < 2:
        return None
    kept = np.random.default_rng(SEED).permutation(len(rows))
    cut = max(1, len(rows) // 4)
    rest, own = kept[:cut], kept[cut:]
    m = train([rows[i]["text"] or "" for i in own], y[own])
    s = np.array(Scorer(m).scores([rows[i]["text"] for i in rest]))
    if len(set(y[rest])) == 2:
        t = min(max(best_cut(s, y[rest]), 1e-6), 1 - 1e-6)
        m.offset -= float(np.log(t / (1 - t)))
        s = np.array(Scorer(m).scores([rows[i]["text"] for i in rest]))
    give_back()
    m.thresholds = {None: 0.5}
    langs = np.array([rows[i]["lang"] or "" for i in rest])
    for lang in set(langs):
        here = langs == lang
        if min((y[rest][here] == c).sum() for c in (0, 1)) >= 20:
            m.thresholds[lang] = min(max(best_cut(s[here], y[rest][here]), 0.05), 0.95)
    return m


def scores(text: Column, model: Model | None) -> Column:
    """The score of each whole text; without a model 0."""
    if model is None:
        return F.lit(0.0)
    made: list[Scorer] = []

    def work(texts: list) -> list[float]:
        if not made:
            made.append(Scorer(model))
        return made[0].scores(texts)

    return row_udf(work, "double", 1000, made)(text.cast("string"))


def flagged(score: Column, lang: Column, model: Model | None) -> Column:
    """True from the threshold of the row's language on, or that for all where it has none."""
    out = F.lit(0.5)
    for name, t in (model.thresholds if model else {}).items():
        if name is not None:
            out = F.when(F.coalesce(lang.cast("string"), F.lit("")) == name, F.lit(float(t))).otherwise(out)
    return score >= out


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and flagged (by language) for each row of docs.

    Null and empty texts are scored as a blank. Repeated rows are scored each on its own. Empty table: no rows. Of docs
    only doc_id, text and lang are read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(docs, labels)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scores(F.col("text"), model).alias("score"), "lang")
    return rows.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), flagged(F.col("score"), F.col("lang"), model).alias("flagged"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are not flagged; nulls and empty tables as in classify()."""
    model = fit(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), labels)
    return docs.where(~flagged(scores(F.col("text"), model), F.col("lang"), model))
