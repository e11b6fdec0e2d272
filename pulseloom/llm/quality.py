"""Quality classifier: gated attention over passages, learned from labels of whole documents.

A document is a bag of passages of PASSAGE words. A passage is encoded from its
bytes and words alone (no label, language, source or id): how often one class of
character follows another, how many of its words are new, how many repeat a
recent word. A tanh layer encodes it; ``softmax(w . (tanh(V h) * sigmoid(U h)))``
weighs the passages, and a logistic unit scores their weighted mean. Only a few
bad passages in a long document can therefore decide.

The fit uses at most ``sample`` labelled documents that have a text, of at most
``limit`` passages in all (the ones with the smallest id hashes, but at least
``samples.LEAST_EACH`` of either label if there are so many; one that does not fit is
passed over). A document of more than ``longest`` passages gives the fit that many, evenly
spread over it, so at least ``limit / longest`` documents fit. Scoring reads every
passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.samples import demand_both, fitting, labelled, one_row_each, spread
from pulseloom.llm.words import Texts, slices, words
from pulseloom.session import checkpointed

PASSAGE = 48
SAMPLE, PASSAGES, LONGEST = 4000, 40_000, 400
HIDDEN, GATE, STEPS = 24, 12, 150

# Classes of bytes: other, lower, upper, digit, blank, line end, sentence end, comma, dash and quote, bar, symbol, above ASCII.
_KIND = np.zeros(256, np.int64)
for _i, _set in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".?", b",;:", b"-'\"()", b"|<>/\\[]{}_=", b"!@#$%^&*+~`"], 1):
    _KIND[list(_set)] = _i
_KIND[128:] = 11
_KINDS = 12
WIDTH = _KINDS * _KINDS + 6


def passages(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and the text (from 0) each belongs to; a text without words is one passage of zeros."""
    n_docs = texts.hi - texts.lo
    found = words(texts)
    per_doc = np.bincount(found.doc, minlength=n_docs)
    count = np.maximum(1, -(-per_doc // PASSAGE))
    base = np.concatenate([[0], np.cumsum(count)])
    first_word = np.concatenate([[0], np.cumsum(per_doc)])[:-1]
    total = int(base[-1])
    owner = np.repeat(np.arange(n_docs), count)
    x = np.zeros((total, WIDTH), np.float32)
    if not len(found.hash):
        return x, owner
    of_word = base[found.doc] + (np.arange(len(found.doc)) - first_word[found.doc]) // PASSAGE
    # Bytes belong to the passage of the last word begun before them.
    begun = np.zeros(len(texts.data), np.int64)
    begun[found.start] = 1
    word_at = np.maximum(np.cumsum(begun) - 1, 0)
    place = of_word[word_at]
    kind = _KIND[texts.data]
    pair = place[1:] * (_KINDS * _KINDS) + kind[:-1] * _KINDS + kind[1:]
    grams = np.bincount(pair, minlength=total * _KINDS * _KINDS).reshape(total, -1)
    n_words = np.maximum(np.bincount(of_word, minlength=total), 1)
    x[:, : _KINDS * _KINDS] = grams / np.maximum(grams.sum(axis=1, keepdims=True), 1) * 10
    length = found.end - found.start
    col = _KINDS * _KINDS
    order = np.lexsort((found.hash, of_word))
    h, p = found.hash[order], of_word[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    x[:, col] = np.bincount(p[new], minlength=total) / n_words
    for lag in (1, 2):
        same = np.zeros(len(h))
        same[lag:] = (found.hash[lag:] == found.hash[:-lag]) & (of_word[lag:] == of_word[:-lag])
        x[:, col + lag] = np.bincount(of_word, weights=same, minlength=total) / n_words
    mean = np.bincount(of_word, weights=length, minlength=total) / n_words
    x[:, col + 3] = np.minimum(mean, 40) / 10
    x[:, col + 4] = np.bincount(of_word, weights=length > 20, minlength=total) / n_words
    x[:, col + 5] = np.minimum(n_words, PASSAGE) / PASSAGE
    return x, owner


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Attention:
    """The model: passage encoder, gated attention, logistic unit. ``fit`` is plain Adam with its own gradients."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 1):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        self.p = {
            "E": init(len(mean), HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE),
            "w": init(GATE) * 0.1, "c": init(HIDDEN), "b": np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> dict:
        """``x`` in units of the model (:meth:`scaled`)."""
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        s = np.exp(s - np.maximum.reduceat(s, starts)[owner])
        a = s / np.add.reduceat(s, starts)[owner]
        bag = np.add.reduceat(h * a[:, None], starts)
        return {"h": h, "t": t, "g": g, "a": a, "bag": bag, "y": _sigmoid(bag @ p["c"] + p["b"])}

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def score(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        return self.forward(self.scaled(x), starts, np.cumsum(np.r_[False, owner[1:] != owner[:-1]]))["y"]

    def fit(self, x: np.ndarray, owner: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = 0.02, decay: float = 1e-3) -> None:
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        of = np.cumsum(np.r_[False, owner[1:] != owner[:-1]])
        x = self.scaled(x)
        p, m, v = self.p, {k: 0 for k in self.p}, {k: 0 for k in self.p}
        for step in range(1, steps + 1):
            f = self.forward(x, starts, of)
            err = (f["y"] - labels) / len(labels)
            bag = err[:, None] * p["c"]
            h = bag[of] * f["a"][:, None]
            da = (bag[of] * f["h"]).sum(axis=1)
            ds = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[of])
            gate = ds[:, None] * p["w"]
            dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
            h = (h + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
            grad = {"E": x.T @ h, "e": h.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["bag"].T @ err, "b": err.sum(keepdims=True)}
            for k, g in grad.items():
                g = g + decay * p[k] / 10
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def held_out(column: str = "doc_id", parts: int = 4):
    """True where crc32 of the id as text leaves 2: never used to fit. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: int = PASSAGES, longest: int = LONGEST) -> Attention | None:
    """The model of ``labels`` (doc_id, quality 0 or 1), or None without labelled texts of both kinds.

    Labels that are null or anything else are not used; of contradicting labels
    of a document the lower counts. A doc_id on several rows is one document, with
    one of its texts. Features are made by Spark; the driver gets at most ``limit``
    passages. If there are labelled texts of both kinds, but the sample has only
    one, this raises ValueError.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = one_row_each(docs, labelled(docs, usable, "quality", sample), "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                x, owner = passages(part)
                bounds = np.searchsorted(owner, np.arange(part.hi - part.lo + 1))
                taken = [a + spread(b - a, longest) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                rows = [x[at].astype(np.float16).tobytes() for at in taken]
                span = slice(part.lo, part.hi)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[span], batch.column(2)[span].cast(pa.int32()), pa.array([len(at) for at in taken], pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "quality", "n", "x"]
                )

    made = checkpointed(texts.mapInArrow(run, "doc_id long, quality int, n long, x binary"))
    rows = fitting(made, limit).select("doc_id", "quality", "x").toArrow()
    rows = rows.sort_by("doc_id")
    y = rows["quality"].to_numpy().astype(np.float32)
    if len(set(y)) < 2:
        demand_both(docs, usable, "quality")
        return None
    parts = [np.frombuffer(v.as_buffer(), np.float16).reshape(-1, WIDTH) for c in rows["x"].chunks for v in c]
    x = np.concatenate(parts).astype(np.float32)
    owner = np.repeat(np.arange(len(parts)), [len(q) for q in parts])
    model = Attention(x.mean(axis=0), x.std(axis=0) + 0.05)
    model.fit(x, owner, y)
    return model


def score(docs: DataFrame, model: Attention | None, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on); every other column stays as it is.

    Null and empty texts are scored as one empty passage. Without a model every
    score is 1: nothing is known against a document. Columns named ``score`` or
    ``predicted`` are replaced. Repeated rows get equal scores.
    """
    kept = docs.drop("score", "predicted")
    names, at = [*kept.columns, "score", "predicted"], kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(at), 1 << 20):
                y = np.ones(part.hi - part.lo) if model is None else model.score(*passages(part)).astype(np.float64)
                span = batch.slice(part.lo, part.hi - part.lo)
                yield pa.RecordBatch.from_arrays([*span.columns, pa.array(y), pa.array((y >= threshold).astype(np.int32))], names=names)

    schema = ", ".join(f"`{name}` {kind}" for name, kind in kept.dtypes)
    return kept.mapInArrow(run, f"{schema}, score double, predicted int")
