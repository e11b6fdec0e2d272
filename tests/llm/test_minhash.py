import math
import re

import pyarrow as pa
import pytest

from pulseloom.llm import minhash, words
from pulseloom.llm.components import components


def shingles(text, width):
    found = re.findall(rb"[^ \t\n\x0b\f\r]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if len(found) < width:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def brute_force(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 1024), (5, 80, 1024), (3, 85, 8)])
def test_components_equal_brute_force(docs, corpus, monkeypatch, width, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "MEMBERS", 4)
    clash = docs.withColumnRenamed("n_chars", "component").withColumnRenamed("lang", "bands")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(clash, width, percent).collect()}
    assert got == brute_force([(r[0], r[1]) for r in corpus], width, percent)


def test_pairs_at_the_threshold_are_hardly_ever_lost():
    for percent, bands in ((85, 20), (80, 28), (100, 20)):
        p, size = percent / 100, bands * minhash.ROWS
        assert minhash.bands_for(percent) == bands and (1 - p**minhash.ROWS) ** bands <= 4e-7
        least = minhash.least_matches(percent, size)
        assert sum(math.comb(size, m) * p**m * (1 - p) ** (size - m) for m in range(least)) <= 4e-8


def test_empty_null_and_repeated_ids(spark, no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (None, "a b c d e f"), (3, None)]
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_one_document_of_each_group_stays(docs, corpus):
    kept = {r.doc_id for r in minhash.drop_near_duplicates(docs).collect()}
    assert kept == {i for i, v in brute_force([(r[0], r[1]) for r in corpus], 5, 80).items() if v[2]}


def test_only_near_equal_texts_of_an_id_fold(spark):
    long = "a b c d e f g h"
    rows = [(1, None), (1, long), (2, "u v w x y z"), (2, "m n o p q r"), (3, long), (None, "k k l l m m"), (None, "k k l l m m"), (None, "u v w x y z"), (4, "s t"), (4, "s t")]
    docs = spark.createDataFrame([(*row, "l", "s", 0) for row in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in minhash.drop_near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, None), (1, long), (2, "u v w x y z"), (2, "m n o p q r"), (None, "k k l l m m"), (4, "s t")], key=str)


def test_a_huge_component_meets_only_the_others_of_its_bucket(spark):
    big = spark.range(100_000).selectExpr("0 as band", "7L as key", "id as doc_id", "0L as component")
    strangers = spark.range(100_000, 100_100).selectExpr("0 as band", "7L as key", "id as doc_id", "id as component")
    row = minhash.in_blocks(big.unionByName(strangers), 1024).selectExpr("count(*) as n", "count(distinct doc_id) as docs", "max(j) as last").first()
    # Members once each, strangers once for each of 98 blocks and once among themselves.
    assert (row.n, row.docs, row.last) == (100_000 + 100 * 99, 100_100, 98)


def test_every_pair_of_components_meets_in_one_cell(spark):
    for sizes in ([30, 1, 1, 9], [5, 5], [1] * 40, [12, 12, 12], [1, 1]):
        rows = [(0, 1, 100 * c + n, c) for c, size in enumerate(sizes) for n in range(size)]
        placed = minhash.in_blocks(spark.createDataFrame(rows, "band int, key long, doc_id long, component long"), 8).collect()
        of = {r.doc_id: r.component for r in placed}
        met = {}
        for a in placed:
            for b in placed:
                if a.doc_id < b.doc_id and (a.i, a.j) == (b.i, b.j) and (a.i == a.j or a.block != b.block):
                    met[a.doc_id, b.doc_id] = met.get((a.doc_id, b.doc_id), 0) + 1
        apart = {(a, b) for a in of for b in of if a < b and of[a] != of[b]}
        assert len(of) == sum(sizes) and {p for p in met if of[p[0]] != of[p[1]]} == apart and set(met.values()) == {1}


def test_a_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.doc_id: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_words_equal_plain_splitting():
    texts = ["Ab  cD\te", "", None, " x", "éÀ Z q", "y" * 50]
    column = pa.array(texts, pa.string())
    for size in (1, 10, 1000):
        seen = []
        for part in words.slices(column, size):
            found = words.words(part)
            seen += [(part.lo + d, h) for d, h in zip(found.doc.tolist(), found.hash.tolist(), strict=True)]
        plain = [(i, words.word_hash(w)) for i, t in enumerate(texts) for w in re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()).split()]
        assert seen == plain
