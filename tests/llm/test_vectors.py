import math
from fractions import Fraction

import numpy as np
import pytest

from pulseloom.llm import mtree, onebit, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(2)
    centre = r.normal(size=(6, 24))
    v = (centre[r.integers(0, 6, 700)] + 0.4 * r.normal(size=(700, 24))).astype(np.float32) / 5
    v[100:130] = v[100]  # ties
    v[200] = 0
    out = [(i, x.tolist(), 0, "clash") for i, x in enumerate(v)]
    bad = [(1000, None, 0, ""), (1050, [float("nan")] * 24, 0, ""), (1100, [1.0, None] * 12, 0, ""), (1150, [float("inf")] * 24, 0, ""), (None, v[0].tolist(), 0, ""), (2000, [0.5, 0.25], 0, "")]
    return out + bad + [out[50]]


def plain(rows, every, k, whole):
    usable = {i: np.array(x, float) for i, x, *_ in rows if i is not None and x is not None and None not in x and np.isfinite(x).all() and (whole or any(x))}
    if whole:
        usable = {i: np.floor(256 * x) for i, x in usable.items()}
    out = {}
    for q, a in usable.items():
        if q % every == 0:
            score = sorted(((-float((a * b).sum()), i) for i, b in usable.items() if i != q and len(b) == len(a)))[:k]
            out[q] = [(i, -s) for s, i in score]
    return out


@pytest.mark.parametrize(("block", "page"), [(16_384, 384), (100, 8)])
def test_mtree_is_exact(spark, rows, monkeypatch, block, page):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CHUNK", block // 12)
    monkeypatch.setattr(mtree, "PAGE", page)
    got = {}
    for r in mtree.top_inner_products(spark.createDataFrame(rows, SCHEMA)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: v for q, v in plain(rows, 50, 5, True).items() if v}


def test_pages_of_small_trees_rule_pages_out():
    r = np.random.default_rng(1)
    block = np.floor(256 * (np.repeat(r.normal(size=(8, 6)) * 4, 500, axis=0) + 0.01 * r.normal(size=(4000, 6))))
    seen = []
    plain_best = mtree.best
    mtree.best = lambda ids, *rest: seen.append(len(ids)) or plain_best(ids, *rest)
    try:
        list(mtree._in_block(5)(np.arange(4000), block / 256, np.array([0]), block[:1] / 256))
    finally:
        mtree.best = plain_best
    assert sum(seen) < 2000


def test_huge_components_stay_exact(spark):
    rows = [(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [1e4, 5.0])]
    got = mtree.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (2, 768000000000 * 2560000 + 256 * 1280)]


@pytest.mark.parametrize("huge", [1e160, 1e307, -1.7e308])
def test_one_huge_component_loses_nothing(spark, huge):
    r = np.random.default_rng(9)
    rows = [(i, r.normal(size=8).tolist()) for i in range(300)]
    rows[70][1][3] = huge
    rows[100][1][3] = huge / 3
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(x) * 256 if abs(x) >= 2**53 else math.floor(x * 256) for x in v] for i, v in rows}
    got = {}
    for row in mtree.top_inner_products(frame).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    for q in range(0, 300, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in whole.items() if i != q)[:5]
        assert got[q] == [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in best]
    found = {}
    for row in onebit.nearest(frame).orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.vec_id, row.score))
    hits = 0
    for q in range(0, 300, 20):
        product = {i: sum(Fraction(a) * Fraction(b) for a, b in zip(rows[q][1], v, strict=True)) for i, v in rows if i != q}
        assert len(found[q]) == 20
        hits += len({i for i, _ in found[q]} & set(sorted(product, key=lambda i: (-product[i], i))[:20]))
        assert not any(math.isnan(s) for _, s in found[q])
    assert hits >= 0.9 * 20 * 15


def test_one_bit_codes_find_the_nearest(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 300)
    got = {}
    for r in onebit.nearest(spark.createDataFrame(rows, SCHEMA)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {q: v for q, v in plain(rows, 20, 20, False).items() if v}
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(s == sorted(s, key=lambda x: (-x[1], x[0])) for s in got.values())


def test_estimates_keep_their_bounds():
    block = np.random.default_rng(4).normal(size=(500, 64))
    guess, error = onebit.Codes(block).estimate(block[:20])
    assert (np.abs(guess - block[:20] @ block.T) <= error).mean() > 0.95


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mtree.top_inner_products(none).count() == 0 and onebit.nearest(none).count() == 0
