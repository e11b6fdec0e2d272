import hashlib
import math
import random

import numpy as np
import pytest

from pulseloom.llm import gnat

SCHEMA = "vec_id long, embedding array<double>, label int, code string, vector int"


def plain(rows, parts=8, entries=16, rounds=6):
    """The same codes by whole searches in Python's integers."""
    kept = [(i, [math.floor(x * 4096) if abs(x) < 2**53 else int(x) * 4096 for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    kept = [(i, v + [0] * (size - len(v)), label) for i, v, label in kept]
    w = size // parts
    cut = [(i, [v[m * w : (m + 1) * w] for m in range(parts)], label) for i, v, label in kept]
    ids = sorted({i for i, _, _ in cut if i is not None})[:entries]
    first = [min(v for j, v, _ in kept if j == i) for i in ids]
    books = [[v[m * w : (m + 1) * w] for v in first] for m in range(parts)]

    def nearest(m, q):
        return min((sum((a - b) ** 2 for a, b in zip(q, e, strict=True)), n) for n, e in enumerate(books[m]))

    for _ in range(rounds):
        taken = [[[] for _ in books[0]] for _ in books]
        for _, v, _ in cut:
            for m, q in enumerate(v):
                taken[m][nearest(m, q)[1]].append(q)
        books = [[[sum(c) // len(t) for c in zip(*t, strict=True)] if t else old for t, old in zip(ts, book, strict=True)] for ts, book in zip(taken, books, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, label in cut:
        found = [nearest(m, q) for m, q in enumerate(v)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + min(error, 2**63 - 1)
        out.append((i, "".join(f"{e:02x}" for _, e in found), min(error, 2**63 - 1), label))
    return sorted(((i, c, e, min(by_label[label], 2**63 - 1), sha) for i, c, e, label in out), key=str)


def got(spark, rows, schema=SCHEMA, **settings):
    made = gnat.compress(spark.createDataFrame(rows, schema).repartition(3), **settings)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in made.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    centre = r.normal(size=(5, 24))
    out = [(i, (centre[i % 5] + 0.3 * r.normal(size=24)).tolist(), [0, 0, 0, 1, None][i % 5], "clash", 0) for i in range(240)]
    out += [(300 + i, out[7][1], 0, None, 1) for i in range(30)]  # equal vectors: ties everywhere
    out += [(400, None, 0, "", 0), (401, [float("nan")] * 24, 0, "", 0), (402, [1.0, None] * 12, 1, "", 0), (403, [float("-inf")] * 24, 0, "", 0)]
    return out + [out[3], (None, out[4][1], None, "", 0)]


def test_codes_equal_plain_search(spark, rows):
    assert got(spark, rows) == plain(rows)


def test_ties_go_to_the_lower_entry(spark):
    r = random.Random(2)
    rows = [(i, [r.randint(-1, 1) / 4096 for _ in range(16)], i % 3, "", 0) for i in range(120)]
    assert got(spark, rows) == plain(rows)


def test_huge_and_short_vectors(spark):
    r = random.Random(3)
    rows = [(i, [r.choice((1e160, -3e7, 0.5, 1e307, -1.7e308)) * r.random() for _ in range(r.choice((0, 5, 9)))], 0, "", 0) for i in range(40)]
    assert got(spark, rows) == plain(rows)


def test_few_rows_and_none(spark):
    assert got(spark, []) == []
    few = [(9, [0.25] * 8, None, "", 0), (2, [-0.25] * 8, None, "", 0)]
    assert got(spark, few) == plain(few)
    only_nulls = [(None, [0.5] * 8, 1, "", 0)]
    assert [r[1:4] for r in got(spark, only_nulls)] == [("00" * 8, 0, 0)]


def test_other_shapes(spark, rows):
    assert got(spark, rows, parts=3, entries=40, rounds=2) == plain(rows, 3, 40, 2)


@pytest.mark.parametrize("size", [1, 6, 90])
def test_the_tree_finds_what_a_whole_search_finds(size):
    r = np.random.default_rng(size)
    for width, times in ((1, 1), (3, 1), (8, 10**40)):
        book = r.integers(-9, 9, (size, width))
        rows = r.integers(-12, 12, (300, width))
        book, rows = (book, rows) if times == 1 else (book.astype(object) * times, rows.astype(object) * times)
        found = gnat.nearest(gnat.build(book), rows)
        whole = np.stack([gnat.squared(rows, entry) for entry in book], axis=1)
        want = [min(range(size), key=lambda e: (row[e], e)) for row in whole.tolist()]
        assert found.entry.tolist() == want
        assert found.square.tolist() == [row[e] for row, e in zip(whole.tolist(), want, strict=True)]


def test_subtrees_are_ruled_out():
    r = np.random.default_rng(1)
    book = np.concatenate([c + r.integers(-20, 20, (32, 4)) for c in ([0] * 4, [9000] * 4, [-9000] * 4, [0, 9000, 0, 9000])])
    rows = book[r.integers(0, len(book), 2000)] + r.integers(-5, 5, (2000, 4))
    assert gnat.nearest(gnat.build(book), rows).asked < 0.5 * len(book) * len(rows)


def test_sums_survive_their_limbs():
    for value in (0, -1, 5, 2**32, -(2**32), -(2**32) - 1, 2**200 + 17, -(3**150)):
        assert sum(limb << (gnat.LIMB * number) for number, limb in gnat._limbs(value)) == value
        assert all(abs(limb) <= 1 << gnat.LIMB for _, limb in gnat._limbs(value))
