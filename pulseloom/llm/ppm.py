"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts of up to ORDER bytes, counted over all
training texts. A symbol that the longest context has seen costs its share there;
otherwise the escape estimate of method D is paid and the next shorter context
asked, without the symbols the longer one has seen (exclusion), down to a uniform
choice. Each text starts in a context of zero bytes and ends with a zero byte, so
the probabilities of all texts add up to one.

Nothing of the trie is held whole. Texts are cut into blocks; a block lists its
distinct (context, symbol) keys with their training counts, the counts of all
blocks are added up by key, keys that share the two nearest context bytes meet in
one group where code lengths are computed, and each block gets back the code
lengths of its own keys. What a task holds is bounded by its own block. The word
counts of the base score travel the same way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.words import LOWER, Texts, mix, slices, words
from pulseloom.session import checkpointed

ORDER = 4
BLOCK_BYTES = 32 << 20


def symbols(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The (context, symbol) key of every symbol, and where each text's symbols begin; A-Z count as a-z."""
    n = texts.hi - texts.lo
    length = np.diff(texts.offsets)
    wide = np.zeros(len(texts.data) + (ORDER + 1) * n, np.uint8)
    symbol = np.ones(len(wide), bool)
    starts = texts.offsets[:-1] + (ORDER + 1) * np.arange(n)
    for i in range(ORDER):
        symbol[starts + i] = False
    inner = symbol.copy()
    inner[starts + ORDER + length] = False
    wide[inner] = LOWER[texts.data]
    key = wide.astype(np.uint64)
    for i in range(1, ORDER + 1):
        key[i:] |= wide[:-i].astype(np.uint64) << np.uint64(8 * i)
    return key[symbol], texts.offsets[:-1] + np.arange(n)


def _add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)


def _counted(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the number of their training occurrences (0 for keys of held-out texts alone)."""
    seen, count = np.unique(keys[training], return_counts=True)
    rest = np.unique(keys[~training])
    return _add_up([(seen, count), (rest, np.zeros(len(rest), np.int64))])


def is_held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text leaves 2 modulo 7; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


_BLOCKS = "kind int, block long, key long, n long, ids array<long>, sizes array<long>, texts binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0 (texts, compressed), 1 (context keys) and 2 (word keys) of every block of a partition."""
    part, number, held = TaskContext.get().partitionId() << 24, 0, 0
    grams, tokens = [], []
    press = zstandard.ZstdCompressor(level=3)

    def batch(kind, keys, counts, ids=None, sizes=None, texts=None):
        n = len(keys)
        none = lambda t: pa.nulls(n, t)
        lists = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, kind), pa.int32()), pa.array(np.full(n, part + number), pa.int64()), pa.array(keys.view(np.int64), pa.int64()), pa.array(counts, pa.int64()),
                none(lists) if ids is None else pa.array([ids], lists), none(lists) if sizes is None else pa.array([sizes], lists), none(pa.binary()) if texts is None else pa.array([texts], pa.binary()),
            ],
            names=["kind", "block", "key", "n", "ids", "sizes", "texts"],
        )

    def close():
        for kind, parts in ((1, grams), (2, tokens)):
            keys, counts = _add_up(parts)
            for lo in range(0, len(keys), 100_000):
                yield batch(kind, keys[lo : lo + 100_000], counts[lo : lo + 100_000])
            parts.clear()

    for rows in batches:
        for texts in slices(rows.column(1)):
            ids = rows.column(0)[texts.lo : texts.hi].to_pylist()
            training = np.array([not is_held_out(i) for i in ids])
            key, starts = symbols(texts)
            grams.append(_counted(key, np.repeat(training, np.diff(np.append(starts, len(key))))))
            found = words(texts)
            tokens.append(_counted(found.hash, training[found.doc]))
            yield batch(0, np.zeros(1, np.int64), np.zeros(1, np.int64), ids, np.diff(texts.offsets).tolist(), press.compress(texts.data.tobytes()))
            held += len(texts.data)
            if held >= BLOCK_BYTES:
                yield from close()
                number, held = number + 1, 0
    yield from close()


def code_lengths(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of each key's symbol after its context.

    ``keys`` are all distinct keys that share their two nearest context bytes,
    ``counts`` their training counts; ``pairs[b, s]`` counts symbol s after byte b
    over all training texts.
    """
    symbol = (keys & np.uint64(255)).astype(np.int64)
    near = int((keys[0] >> np.uint64(8)) & np.uint64(255)) if len(keys) else 0
    c, n, d, taken = {}, {}, {}, {}
    single = pairs.sum(axis=0)
    c[1], n[1], d[1] = pairs[near][symbol], pairs[near].sum(), np.count_nonzero(pairs[near])
    c[0], n[0], d[0] = single[symbol], single.sum(), np.count_nonzero(single)
    taken[0] = single[pairs[near] > 0].sum()
    for k in range(2, ORDER + 1):
        entry = keys & np.uint64((1 << 8 * (k + 1)) - 1)
        entries, of = np.unique(entry, return_inverse=True)
        count = np.bincount(of, weights=counts, minlength=len(entries)).astype(np.int64)
        contexts, at = np.unique(entries >> np.uint64(8), return_inverse=True)
        total = np.bincount(at, weights=count, minlength=len(contexts)).astype(np.int64)
        kinds = np.bincount(at, weights=count > 0, minlength=len(contexts)).astype(np.int64)
        c[k], n[k], d[k] = count[of], total[at][of], kinds[at][of]
        # What the next shorter context counts for the symbols this one has seen.
        shorter = np.zeros(len(entries), np.int64)
        shorter[of] = c[k - 1] if k > 2 else pairs[near][symbol]
        seen = np.bincount(at, weights=shorter * (count > 0), minlength=len(contexts)).astype(np.int64)
        taken[k - 1] = seen[at][of]
    log = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    above = np.zeros(len(keys), bool)  # does the longer context exist
    for k in range(ORDER, -1, -1):
        own_n, own_d = np.broadcast_to(n[k], len(keys)), np.broadcast_to(d[k], len(keys))
        longer = np.broadcast_to(d[k + 1], len(keys)) if k < ORDER else 0
        left = own_n - np.where(above, taken.get(k, 0), 0)
        new = own_d - np.where(above, longer, 0)
        hit = open_ & (c[k] > 0)
        log[hit] += np.log10((2 * c[k][hit] - 1) / (2 * left[hit]))
        open_ &= ~hit
        escape = open_ & (new > 0)
        log[escape] += np.log10(new[escape] / (2 * left[escape]))
        above = own_n > 0
    rest = 256 - int(d[0])
    log[open_] -= np.log10(max(1, rest))
    return log


class _Table:
    """Values by 64-bit key: one look into a hashed table, a binary search where two keys share a place."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        self.slot_key = np.zeros(1 << (64 - int(self.shift)), np.uint64)
        self.slot_value = np.full(len(self.slot_key), np.nan)
        at = self._at(self.keys)
        self.slot_key[at], self.slot_value[at] = self.keys, self.values

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        out = self.slot_value[at]
        other = np.flatnonzero((self.slot_key[at] != keys) | np.isnan(out))
        out[other] = self.values[np.searchsorted(self.keys, keys[other])]
        return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    ``score`` is the model's log10 probability of the whole text, ``base_score``
    that of its tokens under smoothed word counts. Null and empty texts have the
    one token that ends a text. Rows that repeat an id are scored, and learned
    from, each for itself; a null id counts as the empty text when the fold is
    chosen. An empty table gives an empty result. Other columns are not read.
    """
    table = checkpointed(docs.select("doc_id", "text").mapInArrow(_blocks, _BLOCKS))
    keys = table.where("kind > 0").select("kind", "block", "key", "n")
    grams = keys.where("kind = 1")
    counts = checkpointed(grams.groupBy("key").agg(F.sum("n").alias("n")))
    near = F.col("key").bitwiseAND(0xFFFF)
    # At most 65,536 rows whatever the corpus: bytes after single bytes.
    by_pair = counts.groupBy(near.alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(1 << 16, np.int64)
    flat[by_pair["pair"].to_numpy()] = by_pair["n"].to_numpy()
    pairs = flat.reshape(256, 256)

    def lengths(group: pa.Table) -> pa.Table:
        own = group["key"].to_numpy()
        return pa.table({"key": pa.array(own, pa.int64()), "value": pa.array(code_lengths(own.view(np.uint64), group["n"].to_numpy(), pairs))})

    context = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    costs = counts.withColumn("context", context).groupBy("context").applyInArrow(lambda t: lengths(t.select(["key", "n"])), "key long, value double")
    gram_values = grams.select("kind", "block", "key").join(costs, "key").select("kind", "block", "key", "value")
    by_block = keys.where("kind = 2")
    in_all = checkpointed(by_block.groupBy("key").agg(F.sum("n").alias("n")))
    word_values = by_block.select("kind", "block", "key").join(in_all, "key").select("kind", "block", "key", F.col("n").cast("double").alias("value"))
    texts = table.where("kind = 0").select("block", "ids", "sizes", "texts")
    training = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2).count()
    known = in_all.where("n > 0").agg(F.sum("n"), F.count(F.lit(1))).first()
    total = int(known[0] or 0) + training
    distinct = int(known[1]) + (training > 0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        kind = right["kind"].to_numpy()
        key, value = right["key"].to_numpy().view(np.uint64), right["value"].to_numpy()
        cost, count = _Table(key[kind == 1], value[kind == 1]), _Table(key[kind == 2], value[kind == 2])
        out = []
        for ids, sizes, pressed in zip(left["ids"], left["sizes"], left["texts"], strict=True):
            ids = ids.as_py()
            size = np.array(sizes.as_py(), np.int64)
            data = np.frombuffer(unpack.decompress(pressed.as_py(), max_output_size=max(1, int(size.sum()))), np.uint8) if size.sum() else np.zeros(0, np.uint8)
            own = Texts(0, len(ids), data, np.concatenate([[0], np.cumsum(size)]))
            symbol, starts = symbols(own)
            model = np.add.reduceat(cost(symbol), starts)
            found = words(own)
            c = count(found.hash) if len(found.hash) else np.zeros(0)
            n_words = np.bincount(found.doc, minlength=len(ids))
            n_known = np.bincount(found.doc, weights=c > 0, minlength=len(ids)) + (training > 0)
            base = np.bincount(found.doc, weights=np.log10(c + 1), minlength=len(ids)) + np.log10(training + 1)
            base -= (n_words + 1) * np.log10(total + distinct + 1)
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([is_held_out(i) for i in ids]), "n_tokens": pa.array(n_words + 1, pa.int64()), "n_known": pa.array(n_known.astype(np.int64)),
                        "train_tokens": pa.array(np.full(len(ids), total), pa.int64()), "base_score": pa.array(base), "score": pa.array(model),
                    }
                )
            )
        return pa.concat_tables(out) if out else _EMPTY

    values = gram_values.unionByName(word_values).withColumn("of_block", F.col("block") + 0).drop("block")
    return texts.groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(run, _RESULT)


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_EMPTY = pa.table(
    {"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())}
)
