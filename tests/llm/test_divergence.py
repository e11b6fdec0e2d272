import random
import re

import numpy as np
import pytest

from pulseloom.llm import divergence
from tests.llm.conftest import DOCS

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least=10, top=10):
    """The audit by dense loops over Python's integers."""
    counts, docs, groups = {}, {}, set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        for t in found:
            counts[lang, source, t] = counts.get((lang, source, t), 0) + 1
        for t in set(found):
            docs[lang, t] = docs.get((lang, t), 0) + 1
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for (g, t), n in docs.items() if g == lang and n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        n = {s: sum(counts.get((lang, s, t), 0) for t in kept) for s in sources}
        share = lambda c, total: 1 + 10**9 * (c + 2) // (total + 2 * len(kept))  # noqa: B023, E731
        p = {s: [share(counts.get((lang, s, t), 0), n[s]) for t in kept] for s in sources}
        whole = [share(sum(counts.get((lang, s, t), 0) for s in sources), sum(n.values())) for t in kept]
        for s in sources:
            pair = [(sum((a - b) ** 2 // (a + b) for a, b in zip(p[s], p[o], strict=True)), o) for o in sources if o != s]
            term = [((a - b) ** 2 // (a + b), t) for a, b, t in zip(p[s], whole, kept, strict=True) if counts.get((lang, s, t), 0) and a > b]
            for part, values, most in (("pair", pair, len(pair)), ("term", term, top)):
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def got(frame):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in frame.collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    words = [f"{a}{b}" for a in ("ab", "Éc", "ñ", "x日", "Qu") for b in ("a", "o", "ß", "Z")] + ["i", "ÀB", "\x80x"]
    out = []
    for i in range(300):
        some = r.sample(words, 8)
        text = " ".join(r.choice(some) + r.choice((" ", ", ", "1", "_", "\x00")) for _ in range(r.randint(0, 40)))
        out.append((i, text, r.choice(("en", "en", "de", None)), "hot" if i % 3 == 0 else f"s{i % 5}", 0))
    out += [(i, None, "en", "silent", 0) for i in range(3)] + [(400, "", "fr", None, 0), (401, "alone", "pt", "s1", 0), (401, "alone", "pt", "s1", 0), (None, "x" * 50, "fr", "", 0)]
    return out


@pytest.mark.parametrize(("postings", "step", "held", "piece"), [(1 << 16, 1 << 20, 1 << 19, 1 << 21), (7, 5, 20, 16)])
def test_audit_equals_dense_loops(spark, rows, monkeypatch, postings, step, held, piece):
    monkeypatch.setattr(divergence, "POSTINGS", postings)
    monkeypatch.setattr(divergence, "MOST_POSTINGS", postings)
    monkeypatch.setattr(divergence, "STEP", step)
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "SLICE_BYTES", piece)
    frame = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"n_chars": "count"}).repartition(4)
    assert got(divergence.audit(frame)) == plain(rows)


def test_few_documents_keep_every_term(spark, rows):
    frame = spark.createDataFrame(rows[:40], DOCS)
    assert got(divergence.audit(frame, least=1, top=3)) == plain(rows[:40], 1, 3)


def test_no_documents_and_no_terms(spark, no_docs):
    assert divergence.audit(no_docs).count() == 0
    rows = [(1, "a b", "en", "x", 0), (2, None, "en", "y", 0), (3, "", None, None, 0)]
    assert got(divergence.audit(spark.createDataFrame(rows, DOCS))) == plain(rows) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_one_long_text_is_one_document(spark):
    text = " ".join(f"w{chr(97 + i % 26)}" for i in range(300_000))
    assert len(text) < divergence.SLICE_BYTES
    counted = divergence.term_counts(spark.createDataFrame([(1, text * 3, "en", "s", 0)], DOCS)).collect()
    assert {r.docs for r in counted} == {1} and sum(r["count"] for r in counted) == 3 * 300_000 - 2


def test_huge_counts_stay_exact():
    count = np.array([10**13, 5, 10**12], np.int64)
    n = np.array([3 * 10**13, 7, 10**12 + 1], np.int64)
    assert divergence._share(count, n, 4).tolist() == [1 + 10**9 * (int(c) + 2) // (int(m) + 8) for c, m in zip(count, n, strict=True)]
