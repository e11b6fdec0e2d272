import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulseloom.llm import ngram_join, words
from tests.llm.test_minhash import brute_force, shingles


def components_of(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


@pytest.mark.parametrize(("width", "percent", "block", "grams"), [(4, 85, 1024, 1 << 21), (4, 85, 4, 300), (5, 60, 3, 1000), (2, 100, 1024, 1 << 21)])
def test_components_equal_brute_force(docs, corpus, monkeypatch, width, percent, block, grams):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "GRAMS", grams)
    monkeypatch.setattr(ngram_join, "BUCKET", 500)
    clash = docs.withColumnRenamed("n_chars", "component").withColumnRenamed("lang", "sid").withColumn("key", F.lit(1))
    want = {i: v[:2] for i, v in brute_force([(r[0], r[1]) for r in corpus], width, percent).items()}
    assert components_of(ngram_join.jaccard_join(clash, width, percent)) == want


def test_chains_of_near_texts(spark, monkeypatch):
    """Texts that differ step by step: linked along the chain, not end to end; strangers share a frequent passage."""
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    r = random.Random(8)
    word = lambda: f"w{r.randrange(10**6)}"
    rows, text = [], [word() for _ in range(120)]
    for i in range(40):
        rows.append((i, " ".join(text)))
        text = list(text)
        text[r.randrange(120)] = word()
    passage = [word() for _ in range(30)]
    rows += [(100 + i, " ".join([word() for _ in range(r.randint(5, 60))] + passage)) for i in range(40)]
    rows += [(200 + i, " ".join(passage + [str(i)])) for i in range(12)]
    r.shuffle(rows)
    want = {i: v[:2] for i, v in brute_force(rows, 4, 85).items()}
    assert len({c for _, c in want.values()}) < 60
    assert components_of(ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == want


def test_empty_null_and_repeated_ids(spark, no_docs):
    assert ngram_join.jaccard_join(no_docs).count() == 0
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (None, "a b c d e f"), (3, None), (4, " "), (5, "one"), (6, "ONE"), (5, "one")]
    rows += [(7, "p q r s t"), (7, "p q r s t")]
    got = sorted((tuple(r) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 2, 7), (7, 2, 7), (None, 0, None)]
    assert got == sorted(want, key=str)


def test_filters_keep_every_link(spark):
    """The entry filters on random sets, and what they and the prefixes leave."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        text = list(base[: r.randint(40, 60)])
        for _ in range(r.randint(0, 6)):
            text[r.randrange(len(text))] = f"x{r.randrange(30)}"
        rows.append((i, " ".join(text)))
    for percent in (50, 75, 85, 93):
        want = {i: v[:2] for i, v in brute_force(rows, 1, percent).items()}
        assert components_of(ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent)) == want


def test_lone_grams_are_counted_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GRAMS", 5)
    monkeypatch.setattr(ngram_join, "BUCKET", 2)
    rows = [(1, "a b c d e"), (2, "c d e f g"), (3, "q r s t u v")]
    seen = ngram_join.sizes_and_lone_grams(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2).collect()
    assert {r.doc_id: (r.n, r.lone) for r in seen} == {1: (4, 2), 2: (4, 2), 3: (5, 5)}


def test_long_texts_in_pieces(monkeypatch):
    r = random.Random(1)
    text = " ".join("y" * r.choice((1, 3, 9, 400)) + str(i % 50) for i in range(400)) + " " + "Z" * 5000 + "\t end"
    data = np.frombuffer(text.encode(), np.uint8)
    whole = words.words(next(words.slices(pa.array([text])))).hash
    for size in (1, 7, 64, 1000):
        assert (words.word_hashes(data, size) == whole).all()
    plain = next(ngram_join.gram_sets(next(words.slices(pa.array([text]))), 4))
    monkeypatch.setattr(ngram_join, "SLICE_BYTES", 100)
    assert (next(ngram_join.gram_sets(next(words.slices(pa.array([text]))), 4)) == plain).all()
    assert len(plain) == len(shingles(text, 4))
