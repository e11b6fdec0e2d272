"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 not toxic, 1 toxic, 2 severely toxic. Labels say toxic or
not; of the toxic ones the half with more of the features that mark toxic labels
counts as severe. One weight vector serves all thresholds:
``P(grade > k) = sigmoid(w . x - threshold_k)`` with rising thresholds. Features
are the presence of words and of their first bytes (hashed), kept where they tell
toxic labels apart. The
output is the probability of each grade and the expected severity.

The fit reads at most ``sample`` labelled documents that have a text (those with the
smallest id hashes, but at least ``samples.LEAST_EACH`` of either label if there are
so many) and gets at most ``limit`` word hashes of them; a document that does not
fit is passed over. Of more than ``longest`` hashes of a document the fit gets that
many, evenly spread over the hash values. Scoring reads everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.samples import demand_both, fitting, labelled, one_row_each, spread
from pulseloom.llm.words import Texts, prefixes, slices, words
from pulseloom.session import checkpointed

SAMPLE, LIMIT, LONGEST = 8000, 12_000_000, 120_000
FEATURES = 1024
GRADES = 3
PREFIXES = (5, 6, 7)
_PLAIN = np.ones(256, bool)
_PLAIN[33:128] = [chr(c).isalnum() for c in range(33, 128)]


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every feature occurrence: words without the marks around them, and their first bytes."""
    data = texts.data.copy()
    data[~_PLAIN[data]] = 32
    bare = texts._replace(data=data)
    found = words(bare)
    parts = [(found.doc, found.hash), *prefixes(bare, found, PREFIXES)]
    return np.concatenate([d for d, _ in parts]), np.concatenate([h for _, h in parts])


class Ordinal:
    """Sorted feature hashes, their shared weights, and rising thresholds."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.thresholds = features, weights, thresholds

    def margin(self, doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        """Weights of the distinct features of each of ``n`` documents, added up."""
        at = np.minimum(np.searchsorted(self.features, hashes), max(0, len(self.features) - 1))
        hit = self.features[at] == hashes if len(self.features) else np.zeros(len(hashes), bool)
        pair = np.unique(doc[hit] * max(1, len(self.features)) + at[hit])
        size = max(1, len(self.features))
        return np.bincount(pair // size, weights=self.weights[pair % size], minlength=n) if len(pair) else np.zeros(n)

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return _sigmoid(margin[:, None] - self.thresholds)


def fit_ordinal(x_doc: np.ndarray, x_feature: np.ndarray, grade: np.ndarray, n_features: int, steps: int = 600, rate: float = 0.1, decay: float = 3e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the likelihood of ``grade``; the pairs (x_doc, x_feature) are the features present."""
    n, w = len(grade), np.zeros(n_features)
    base = np.array([np.clip((grade > k).mean(), 1e-3, 1 - 1e-3) for k in range(GRADES - 1)])
    theta = -np.log(base / (1 - base))
    # Gaps stay positive: theta_k = theta_0 + sum of exp(gap).
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 0.1))])
    m, v = np.zeros(n_features + len(free)), np.zeros(n_features + len(free))
    for step in range(1, steps + 1):
        theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        score = np.bincount(x_doc, weights=w[x_feature], minlength=n)
        cum = np.column_stack([np.ones(n), _sigmoid(score[:, None] - theta), np.zeros(n)])
        slope = cum * (1 - cum)
        row = np.arange(n)
        prob = np.maximum(cum[row, grade] - cum[row, grade + 1], 1e-12)
        d_score = (slope[row, grade + 1] - slope[row, grade]) / prob / n
        d_theta = np.zeros(GRADES + 1)
        np.add.at(d_theta, grade, slope[row, grade] / prob / n)
        np.add.at(d_theta, grade + 1, -slope[row, grade + 1] / prob / n)
        d_theta = d_theta[1:GRADES]
        d_free = np.concatenate([[d_theta.sum()], np.exp(free[1:]) * np.cumsum(d_theta[::-1])[::-1][1:]])
        grad = np.concatenate([np.bincount(x_feature, weights=d_score[x_doc], minlength=n_features) + decay * w, d_free])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, free = w - move[:n_features], free - move[n_features:]
    return w, np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])


def held_out():
    """True where crc32 of the id as text leaves 2 modulo 4: never used to fit."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: int = LIMIT, longest: int = LONGEST) -> Ordinal | None:
    """The model of ``labels`` (doc_id, toxic 0 or 1), or None without labelled texts of both kinds.

    Labels that are null or anything else are not used; of contradicting labels
    of a document toxic counts. A doc_id on several rows is one document, with one
    of its texts. Spark finds the words; the driver gets at most ``limit`` hashes.
    If there are labelled texts of both kinds, but the sample has only one, this
    raises ValueError.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = one_row_each(docs, labelled(docs, usable, "toxic", sample), "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                doc, hashes = features(part)
                order = np.argsort(doc, kind="stable")
                bounds = np.searchsorted(doc[order], np.arange(part.hi - part.lo + 1))
                rows = [np.unique(hashes[order[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                rows = [h[spread(len(h), longest)] for h in rows]
                span = slice(part.lo, part.hi)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[span], batch.column(2)[span].cast(pa.int32()), pa.array([len(h) for h in rows], pa.int64()),
                        pa.array([h.tobytes() for h in rows], pa.binary()),
                    ],
                    names=["doc_id", "toxic", "n", "words"],
                )

    made = checkpointed(texts.mapInArrow(run, "doc_id long, toxic int, n long, words binary"))
    rows = fitting(made, limit).toArrow().sort_by("doc_id")
    toxic = rows["toxic"].to_numpy()
    if len(set(toxic)) < 2:
        demand_both(docs, usable, "toxic")
        return None
    n = rows["n"].to_numpy()
    doc = np.repeat(np.arange(len(n)), n)
    hashes = np.concatenate([np.frombuffer(v.as_buffer(), np.uint64) for c in rows["words"].chunks for v in c])
    distinct, at = np.unique(hashes, return_inverse=True)
    bad = np.bincount(at, weights=toxic[doc], minlength=len(distinct))
    seen = np.bincount(at, minlength=len(distinct))
    share = toxic.mean()
    # How far the toxic share among a word's documents lies from the overall share, in standard deviations.
    z = (bad - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    order = np.argsort(-np.abs(z) * (seen >= 3), kind="stable")[:FEATURES]
    order = np.sort(order[(np.abs(z[order]) > 4) & (seen[order] >= 3)])
    marks = np.isin(np.arange(len(distinct)), order) & (z > 4) & (bad > 0.5 * seen)
    hits = np.bincount(doc, weights=marks[at], minlength=len(n))
    grade = np.where(toxic == 1, np.where(hits > np.median(hits[toxic == 1]), 2, 1), 0)
    place = np.full(len(distinct), -1)
    place[order] = np.arange(len(order))
    used = place[at] >= 0
    weights, thresholds = fit_ordinal(doc[used], place[at][used], grade, max(1, len(order)))
    return Ordinal(distinct[order], weights[: len(order)] if len(order) else np.zeros(1), thresholds)


def grade(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """doc_id, p_toxic, p_severe, expected_severity (0 to 2), severity (likeliest grade) and toxic (boolean) of every row.

    Null and empty texts have no features. Without a model everything is grade 0.
    Repeated rows get equal grades; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                n = part.hi - part.lo
                if model is None:
                    above = np.zeros((n, GRADES - 1))
                else:
                    above = model.above(model.margin(*features(part), n))
                each = np.column_stack([1 - above[:, 0], above[:, 0] - above[:, 1], above[:, 1]])
                arrays = [batch.column(0)[part.lo : part.hi], pa.array(above[:, 0]), pa.array(above[:, 1]), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1), pa.int32()), pa.array(above[:, 0] >= 0.5)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "p_toxic", "p_severe", "expected_severity", "severity", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, p_toxic double, p_severe double, expected_severity double, severity int, toxic boolean")
