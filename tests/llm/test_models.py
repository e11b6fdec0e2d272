"""Language-model scores, classifiers and token counts."""

import math
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.llm import ppm, quality, samples, tokens, toxicity


class Trie:
    """PPM with method D escapes and exclusion, symbol by symbol."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for text in texts:
            data = b"\0" * ppm.ORDER + text + b"\0"
            for p in range(ppm.ORDER, len(data)):
                for k in range(ppm.ORDER + 1):
                    self.seen[data[p - k : p]][data[p]] += 1

    def log10(self, context, symbol):
        out, gone = 0.0, set()
        for k in range(ppm.ORDER, -1, -1):
            left = {s: c for s, c in self.seen.get(context[len(context) - k :], {}).items() if s not in gone}
            n, new = sum(left.values()), len(left)
            if not left:
                continue
            if symbol in left:
                return out + math.log10((2 * left[symbol] - 1) / (2 * n))
            out += math.log10(new / (2 * n))
            gone |= left.keys()
        return out - math.log10(256 - len(gone))

    def score(self, text):
        data = b"\0" * ppm.ORDER + text + b"\0"
        return sum(self.log10(data[p - ppm.ORDER : p], data[p]) for p in range(ppm.ORDER, len(data)))


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


@pytest.mark.parametrize("block", [1 << 25, 2000])
def test_scores_equal_a_plain_trie(docs, corpus, no_docs, monkeypatch, block):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", block)
    rows = {r[0]: lower(r[1]) for r in corpus}
    train = [t for i, t in rows.items() if not ppm.is_held_out(i)]
    trie, count = Trie(train), Counter(w for t in train for w in [*t.split(), None])
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in ppm.score(docs.withColumnRenamed("lang", "key").withColumnRenamed("n_chars", "score")).collect()}
    assert got.keys() == rows.keys() and any(r.held_out for r in got.values())
    for i, text in rows.items():
        own = [*text.split(), None]
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (ppm.is_held_out(i), len(own), sum(count[w] > 0 for w in own), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own))
        assert got[i].score == pytest.approx(trie.score(text))
    assert ppm.score(no_docs).count() == 0
    total = sum(10 ** trie.log10(b"xkol", s) for s in range(256))
    assert total == pytest.approx(1)


def labelled(spark):
    r = np.random.default_rng(0)
    words = ["ba", "kori", "mipe", "tuva", "resa", "lonu", "de", "sim"]
    rows, marks = [], []
    for i in range(240):
        good = " ".join(r.choice(words, 60))
        bad = i % 4 == 0
        text = good + "\n" + " | ".join(r.choice(words, 50)) if bad else good
        toxic = i % 5 == 0
        rows.append((i, text + (" you scoundrel" if toxic else ""), "x"))
        marks.append((i, int(not bad), int(toxic)))
    rows += [(900, None, "x"), (901, "", "x"), (902, "kori " * 30000, "x"), (None, "ba kori", "x"), (5, rows[5][1], "x")]
    marks += [(900, None, None), (903, 1, 0), (None, 0, 1), (6, 7, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, predicted string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_documents(spark, no_docs):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    got = quality.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and got.count() == docs.count()
    held = got.join(labels.where("quality in (0, 1)"), "doc_id").where(quality.held_out()).collect()
    assert len(held) > 30 and sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.collect())
    assert quality.score(no_docs, model).count() == 0
    assert quality.fit(no_docs, labels) is None and quality.score(docs, None).where("predicted = 1").count() == docs.count()


def test_a_bad_passage_outweighs_good_ones(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    mixed = spark.createDataFrame([(1, "ba kori mipe tuva resa lonu de sim " * 30 + "\n" + "ba | kori | mipe | tuva | " * 20)], "doc_id long, text string")
    assert quality.score(mixed, model).first().predicted == 0


def test_toxicity_on_held_out_documents(spark, no_docs):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.grade(docs, model)
    held = got.join(labels.where("toxic in (0, 1)").withColumnRenamed("toxic", "label"), "doc_id").where(toxicity.held_out()).collect()
    assert len(held) > 30 and all(r.toxic == bool(r.label) for r in held)
    rows = got.collect()
    assert len(rows) == docs.count() and all(r.p_toxic >= r.p_severe and abs(r.expected_severity - r.p_toxic - r.p_severe) < 1e-9 for r in rows)
    assert toxicity.grade(no_docs, model).count() == 0
    assert toxicity.fit(no_docs, labels) is None and toxicity.grade(docs, None).where("toxic").count() == 0


def with_first(spark, label, text, copies=1):
    """The labelled documents and one more, the first in hash order, on ``copies`` rows."""
    docs, labels = labelled(spark)
    ids = spark.range(1000, 9000).withColumnRenamed("id", "doc_id").where(~quality.held_out())
    first = ids.orderBy(F.xxhash64("doc_id")).first().doc_id
    more = spark.createDataFrame([(first, f"{text} {i}", "x") for i in range(copies)], docs.schema)
    return docs.union(more), labels.union(spark.createDataFrame([(first, *label)], labels.schema))


def test_a_huge_labelled_document_does_not_end_the_sample(spark):
    docs, labels = with_first(spark, (1, 0), " ".join(f"kori{i}" for i in range(30000)))
    for model in (quality.fit(docs, labels, limit=500), quality.fit(docs, labels, limit=500, longest=1 << 20)):
        got = quality.score(docs, model).join(labels.where("quality in (0, 1)"), "doc_id").where(quality.held_out()).collect()
        assert len(got) > 30 and sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    assert toxicity.fit(docs, labels, limit=20_000, longest=1 << 20) is not None
    assert toxicity.fit(docs, labels, limit=20_000, longest=1000) is not None


def test_a_labelled_document_on_many_rows_counts_once(spark, monkeypatch):
    docs, labels = with_first(spark, (1, 0), "ba kori mipe " * 300, copies=300)
    held = []
    monkeypatch.setattr(quality.Attention, "fit", lambda self, x, owner, y: held.append((len(x), len(y))))
    quality.fit(docs, labels, limit=400)
    assert held[0][0] <= 400 and held[0][1] > 100


def test_a_sample_without_both_kinds_fails(spark):
    docs, labels = labelled(spark)
    with pytest.raises(ValueError, match="quality"):
        quality.fit(docs, labels, limit=1)
    with pytest.raises(ValueError, match="toxic"):
        toxicity.fit(docs, labels, sample=1)
    same = labels.where("quality = 1").unionByName(labels.where("quality = 1").withColumn("toxic", F.lit(5)))
    assert quality.fit(docs, same) is None


def test_thresholds_rise_and_grades_follow_the_score():
    grade = np.array([0] * 50 + [1] * 20 + [2] * 20)
    doc = np.concatenate([np.arange(50, 90), np.arange(70, 90)])
    feature = np.concatenate([np.zeros(40, int), np.ones(20, int)])
    weights, thresholds = toxicity.fit_ordinal(doc, feature, grade, 2)
    assert thresholds[0] < thresholds[1] and (weights > 0).all()
    model = toxicity.Ordinal(np.array([3, 9], np.uint64), weights, thresholds)
    above = model.above(model.margin(np.array([1, 2, 2]), np.array([3, 3, 9], np.uint64), 3))
    assert (above[0] < 0.5).all() and above[1][0] > 0.5 > above[1][1] and (above[2] > 0.5).all()


def test_token_counts_equal_direct_counts(docs, corpus, no_docs, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 64)
    monkeypatch.setattr(tokens, "GROUP", 4)
    encode = tokens._encoding(tokens.RANKS).encode_ordinary
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs.withColumnRenamed("lang", "stream")).collect()}
    assert got == {r[0]: len(encode(r[1] or "")) for r in corpus}
    assert tokens.token_counts(no_docs).count() == 0


def test_scan_stitches_blocks(spark, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP", 2)
    r = np.random.default_rng(8)
    rows, want = [], []
    for stream in range(3):
        ids = r.choice([7, 8, tokens.END], 300, p=[0.6, 0.3, 0.1]).tolist() + [9] * (0 if stream else 40)
        number, size = 0, 0
        for i in ids:
            if i == tokens.END:
                want.append((stream, number, size))
                number, size = number + 1, 0
            else:
                size += 1
        want += [(stream, number, size)] if size else []
        cuts = [0, 1, 1, 5, 6, 90, 91, 200, len(ids)]
        rows += [(stream, b, bytearray(struct.pack(f"<{y - x}H", *ids[x:y]))) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    rows.append((9, 0, None))
    got = tokens.scan(spark.createDataFrame(rows, "stream long, block long, data binary").repartition(5))
    assert sorted((r.stream, r.number, r.n_tokens) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("split", [None, "64", "7"])
def test_flat_files_on_disk(spark, tmp_path, monkeypatch, split):
    """Files of any bytes, cut anywhere: blocks are the file's own bytes, and counts those of the whole files."""
    monkeypatch.setattr(tokens, "BLOCK", 10)
    r = np.random.default_rng(3)
    files = {
        "a": [1, 2, tokens.END, *range(100, 133), tokens.END, 5],
        "b": [0xBBEF, 0xBF, tokens.END, 0x5050, 0xC450, 0x50C4],  # begins like a byte order mark
        "c": r.choice([0x50, 0x5000, 0x0A0D, 0x5050, 0xC4, tokens.END], 400).tolist(),
        "d": [tokens.END],
        "e": [7] * 90,
        "f": [],
        "g": [3, 0x5001],  # the last byte is the mark
    }
    for name, ids in files.items():
        (tmp_path / name).write_bytes(struct.pack(f"<{len(ids)}H", *ids))
    if split:
        for key, value in (("spark.sql.files.maxPartitionBytes", split), ("spark.sql.files.openCostInBytes", "0"), ("spark.sql.files.minPartitionNum", "1")):
            spark.conf.set(key, value)
    try:
        blocks = tokens.read_files(spark, str(tmp_path))
        got = {}
        for row in blocks.orderBy("stream", "block").collect():
            got[row.stream] = got.get(row.stream, b"") + bytes(row.data)
            assert len(row.data) <= 20
        assert sorted(got.values()) == sorted(struct.pack(f"<{len(ids)}H", *ids) for ids in files.values() if ids)
        counts = sorted((n.stream, n.number, n.n_tokens) for n in tokens.scan(blocks).collect())
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
            spark.conf.unset(key)
    want = []
    for stream, data in got.items():
        ids, size, number = struct.unpack(f"<{len(data) // 2}H", data), 0, 0
        for i in ids:
            if i == tokens.END:
                want.append((stream, number, size))
                number, size = number + 1, 0
            else:
                size += 1
        want += [(stream, number, size)] if size else []
    assert counts == sorted(want)


def test_long_runs_are_tokenised():
    """Two million of one class in a row; short runs beside the whole pattern."""
    plain = tokens._encoding(tokens.RANKS)
    for text in (" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "x" * 2_000_000, "7" * 2_000_000, "\u3000" * 700_000 + "é", "!" * 2_000_000 + "  ", " \t" * 1_000_000 + " word"):
        ids = tokens.encode(text)
        assert plain.decode(ids) == text


def test_cut_blanks_change_no_token(monkeypatch):
    import random
    import re

    monkeypatch.setattr(tokens, "_LONG_BLANKS", re.compile(tokens._LONG_BLANKS.pattern.replace("10000", "2")))
    plain, r = tokens._encoding(tokens.RANKS).encode_ordinary, random.Random(4)
    for _ in range(300):
        text = "".join(r.choice([" ", "  ", "\n", "\t", "\u00a0", "\x1c", "a", "Bc", "9", "!", "é", "'s"]) for _ in range(r.randint(0, 40)))
        assert tokens.encode(text) == plain(text)


def test_the_sample_is_drawn_from_labelled_texts(spark):
    """Labels without a text take no place, and the rarer label gets its rows."""
    docs, labels = labelled(spark)
    strangers = spark.range(10_000, 30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    many = labels.unionByName(strangers)
    drawn = samples.labelled(docs, many.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality"), "quality", 150)
    assert drawn.count() == 150 and drawn.where("doc_id >= 240").count() == 0
    few = docs.where("doc_id < 240").dropDuplicates(["doc_id"]).select("doc_id", F.when(F.col("doc_id") % 24 == 0, 1).otherwise(0).alias("toxic"))
    counts = {r.toxic: r["count"] for r in samples.labelled(docs, few, "toxic", 40, least=8).groupBy("toxic").count().collect()}
    assert counts == {0: 32, 1: 8}
    counts = {r.toxic: r["count"] for r in samples.labelled(docs, few, "toxic", 1000, least=8).groupBy("toxic").count().collect()}
    assert counts == {0: 230, 1: 10}
    model = quality.fit(docs, many, sample=200)
    held = quality.score(docs, model).join(labels.where("quality in (0, 1)"), "doc_id").where(quality.held_out()).collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def plain_attention(model, x):
    """One document at a time, one passage at a time, in doubles."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    hidden = [np.tanh(((row - model.mean) / model.scale) @ p["E"] + p["e"]) for row in x.astype(float)]
    logit = [float((np.tanh(h @ p["V"]) * (1 / (1 + np.exp(-(h @ p["U"]))))) @ p["w"]) for h in hidden]
    weight = [math.exp(s - max(logit)) for s in logit]
    bag = sum(w * h for w, h in zip(weight, hidden, strict=True)) / sum(weight)
    return float(1 / (1 + np.exp(-(bag @ p["c"] + p["b"][0]))))


def test_attention_equals_a_plain_forward_pass_and_its_gradient():
    r = np.random.default_rng(6)
    sizes = [1, 4, 2, 7, 3]
    owner = np.repeat(np.arange(5), sizes)
    x = r.normal(size=(17, quality.WIDTH)).astype(np.float32)
    y = np.array([0, 1, 1, 0, 1], np.float32)
    model = quality.Attention(x.mean(axis=0), x.std(axis=0) + 0.05)
    for k in model.p:
        model.p[k] = r.normal(size=model.p[k].shape).astype(np.float32) * 0.3
    assert model.score(x, owner) == pytest.approx([plain_attention(model, x[owner == i]) for i in range(5)], abs=1e-4)

    def loss():
        s = [plain_attention(model, x[owner == i]) for i in range(5)]
        return -sum(math.log(p if label else 1 - p) for p, label in zip(s, y, strict=True)) / 5

    # The first step of Adam moves every weight by the rate, against the sign of its gradient.
    before = {k: v.copy() for k, v in model.p.items()}
    trained = quality.Attention(model.mean, model.scale)
    trained.p = {k: v.copy() for k, v in before.items()}
    trained.fit(x, owner, y, steps=1, rate=0.02, decay=0.0)
    for k in before:
        flat = before[k].ravel()
        for i in r.choice(flat.size, min(6, flat.size), replace=False):
            values = []
            for step in (1e-3, -1e-3):
                model.p = {n: v.astype(float).copy() for n, v in before.items()}
                model.p[k].ravel()[i] += step
                values.append(loss())
            slope = (values[0] - values[1]) / 2e-3
            if abs(slope) > 1e-4:
                assert np.sign(flat[i] - trained.p[k].ravel()[i]) == np.sign(slope), (k, i)


def test_ordinal_weights_are_a_minimum_of_the_plain_likelihood():
    r = np.random.default_rng(2)
    x = r.random((120, 5)) < 0.4
    grade = np.clip((x @ np.array([1.0, 2, 0, -1, 0.5]) + r.normal(size=120)).round(), 0, 2).astype(int)
    doc, feature = np.nonzero(x)
    decay = 1e-3
    w, theta = toxicity.fit_ordinal(doc, feature, grade, 5, steps=4000, decay=decay)

    def loss(w, theta):
        total = 0.0
        for row, g in zip(x, grade, strict=True):
            above = [1.0, *(1 / (1 + math.exp(t - row @ w)) for t in theta), 0.0]
            total -= math.log(above[g] - above[g + 1])
        return total / len(x) + decay / 2 * float(w @ w)

    for i in range(7):
        step = np.zeros(7)
        step[i] = 1e-4
        slope = (loss(w + step[:5], theta + step[5:]) - loss(w - step[:5], theta - step[5:])) / 2e-4
        assert abs(slope) < 2e-3
