"""Personal data, mixing and packing against plain Python."""

import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pulseloom.llm import mixing, packing, pii

PII_TEXTS = [
    None, "", "none here", "Mail a.b+c@x-y.example.co.uk, d@e.f_g@h.i and q@w", "card 4111 1111 1111 1111 or 4111-1111-1111-1112.", "ip 10.0.0.255 10.0.0.256 1.2.3.4.5.6.7.8 001.2.3.4",
    "+1 (988) 555-2485 +12 +49 (0) 30-123456789.", "naïve 😀 x@y.zz +44 20 7946 0958 😀 8.8.8.8", "iban GB82WEST12345698765432 and GB82WEST12345698765433", "call 555-123-4567 now; " + "filler " * 9 + "555-123-4568",
    "ssn 123-45-6789", "1" * 40 + " " + "12 " * 30, "a" * 5000 + "@", "x@" + "a." * 3000 + "z", "4111111111111111@a.b",
]


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    text, out = text or "", []
    plain = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
    ]
    for rank, (kind, pattern, holds) in enumerate(plain):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if holds(m[0])]
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_equal_plain_patterns(spark):
    rows = [(i, t, "clash") for i, t in enumerate(PII_TEXTS)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans string"))
    got = {r.doc_id: r for r in found.select("doc_id", pii.digest(F.col("base_spans")).alias("base"), pii.digest(F.col("spans")).alias("every")).collect()}
    assert {i: r.base for i, r in got.items()} == {i: base_spans(t) for i, t in enumerate(PII_TEXTS)}
    assert got[8].every == "iban:5:27" and got[9].every == "local_phone:5:17" and got[10].every == "ssn:4:15"
    assert "Python" not in found._jdf.queryExecution().toString()


def test_context_words_after_a_span_count(spark):
    texts = ["123-45-6789 (SSN)", "555-123-4567 is my mobile", "555-123-4567" + " x" * 30 + " phone", "social 123-45-6789 security", "555-123-4567 \U0001f600 phone 123-45-6789"]
    found = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = [r.spans for r in found.orderBy("doc_id").select(pii.digest(F.col("spans")).alias("spans")).collect()]
    assert got == ["ssn:0:11", "local_phone:0:12", "", "", "local_phone:0:12"]
    assert pii.mask_personal_data(found.drop("spans")).orderBy("doc_id").first().text == "[SSN] (SSN)"


def test_a_long_text_full_of_spans(spark):
    """A megabyte with tens of thousands of spans, some next to each other, some overlapping; chunks end anywhere."""
    import random

    r = random.Random(7)
    parts = [lambda: f"u{r.randrange(10**4)}@ex-{r.randrange(99)}.com", lambda: f"10.{r.randrange(300)}.0.{r.randrange(256)}", lambda: "+1 (555) 123-4567", lambda: "4111 1111 1111 1111", lambda: "call 555-123-4567,", lambda: "4111111111111111@a.bc", lambda: "é😀 word" * r.randrange(9), lambda: "\n"]
    text = "".join(r.choice(parts)() + r.choice((" ", ",", ", and ")) for _ in range(60_000))
    frame = spark.createDataFrame([(1, text, 0), (2, text[:700], 0)], "doc_id long, text string, n_chars long")
    found = pii.find_personal_data(frame).orderBy("doc_id").select("spans", pii.digest(F.col("base_spans")).alias("base")).collect()
    assert [x.base for x in found] == [base_spans(text), base_spans(text[:700])]
    masked = [x.text for x in pii.mask_personal_data(frame).orderBy("doc_id").collect()]
    for whole, out, row in zip((text, text[:700]), masked, found, strict=True):
        spans, plain, at, k = [(x.start, x.end, x.kind) for x in row.spans], [], 0, 0
        while k < len(spans):
            start, end, kind = spans[k]
            while k + 1 < len(spans) and spans[k + 1][0] < end:
                k += 1
                end = max(end, spans[k][1])
            plain += [whole[at:start], f"[{kind.upper()}]"]
            at, k = end, k + 1
        assert out == "".join(plain) + whole[at:]
        base = [x for x in spans if x[2] in pii.BASE]
        more = [x for x in spans if x[2] not in pii.BASE]
        assert not any(b[0] < m[1] and m[0] < b[1] for m in more[:200] for b in base)
    assert len(found[0].spans) > 30_000 and any(x.kind == "local_phone" for x in found[0].spans)


def test_masking_keeps_rows_and_columns(spark):
    rows = [(1, "mail a@b.cc or +1 (988) 555-2485!", 0), (2, None, None), (3, "4111111111111111@a.b", 0)]
    got = pii.mask_personal_data(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, "mail [EMAIL] or [PHONE]!", 24), (2, None, None), (3, "[EMAIL]", 7)]


def fill(sizes):
    """Water filling by repeated resharing."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > 2 * sizes[s]}
        if not over:
            return goal | {s: weight[s] * share for s in open_}
        for s in over:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
        open_ -= over
    return goal


def test_mix_meets_its_targets(docs, corpus, no_docs):
    clash = docs.withColumn("taken", F.lit("x")).withColumn("bucket", F.lit(1))
    rows = mixing.mix(clash).collect()
    assert len(rows) == len(corpus) and mixing.mix_sizes(no_docs).count() == 0 and mixing.draw(no_docs).count() == 0
    sizes, taken, longest, goal = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in rows:
        size = len((r.text or "").encode().split())
        assert r.size == size and r.taken in (0, size, 2 * size)
        sizes[r.source] += size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], size)
        goal[r.source] = r.target
    assert {r.source: r.source_size for r in rows} == dict(sizes)
    assert goal == pytest.approx(fill(dict(sizes)))
    assert all(abs(taken[s] - goal[s]) <= longest[s] for s in goal)
    narrow = {r.doc_id: r.taken for r in mixing.mix_sizes(docs).collect()}
    assert narrow == {r.doc_id: r.taken for r in rows}
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in drawn.collect()) >= sum(taken.values()) * 0.99


def test_mix_orders_by_exponential_keys(spark):
    rows = [(i, "word " * (5 + i % 9), "a", None) for i in range(300)] + [(1000, "word " * 2000, "b", None)]
    got = mixing.mix_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    keyed = got.join(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").drop("lang"), "doc_id")
    key = mixing.exponential_key(F.col("doc_id"), mixing.quality_weight(F.col("text"), F.col("size")))
    some = keyed.where("source = 'a'").select("size", "taken", key.alias("key")).orderBy("key").collect()
    times = [r.taken // r.size for r in some]
    assert times == sorted(times, reverse=True) and math.isclose(sum(r.taken for r in some), keyed.where("source = 'a'").first().target, rel_tol=0.02)


def test_packing_is_best_fit_without_conflicts(docs, corpus, no_docs):
    rows = packing.pack(docs, capacity=100).collect()
    assert packing.pack(no_docs).count() == 0
    source, text = {r[0]: r[3] for r in corpus}, {r[0]: r[1] or "" for r in corpus}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for i, t in text.items():
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in own] == [100 * k for k in range(len(own))] and sum(r.tokens for r in own) == len(t.encode().split())
        assert (own[0].bin_id is None) == (not t.encode().split())
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in own] == [sum(x.tokens for x in own[:k]) for k in range(len(own))]
        assert sum(r.tokens for r in own) <= 100
        assert len({source[r.doc_id] for r in own}) == len(own) == len({text[r.doc_id] for r in own})


def test_packing_keeps_ids_beside_null_ids(spark):
    big = 2**60
    rows = [(big + 1, "a b c", "x", 1), (None, "d e f", "y", None), (big + 2, "g h", "x", 2**62 + 1), (None, "i", None, 2**62 + 2), (big + 3, None, "x", 2**62 + 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, group long")
    for cluster in (None, "group"):
        got = packing.pack(frame, capacity=8, cluster=cluster).collect()
        assert sorted((r.doc_id or 0, r.tokens) for r in got) == [(0, 1), (0, 3), (big + 1, 3), (big + 2, 2), (big + 3, 0)]


def test_best_fit_equals_a_full_search():
    import random

    r = random.Random(5)
    sizes = sorted((r.randint(1, 50) for _ in range(400)), reverse=True)
    sources, clusters = [r.choice([-1, 0, 0, 1, 2, 70]) for _ in sizes], [r.choice([-1, -1, 3, 4]) for _ in sizes]
    bins, _ = packing.best_fit(sizes, sources, clusters, 64)
    state, plain = [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(left, b) for b, (left, ss, cs) in enumerate(state) if left >= size and s not in ss and c not in cs]
        b = min(fits)[1] if fits else len(state)
        if not fits:
            state.append((64, set(), set()))
        left, ss, cs = state[b]
        state[b] = (left - size, ss | {s} - {-1}, cs | {c} - {-1})
        plain.append(b)
    assert bins == plain
