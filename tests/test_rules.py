"""Rule evaluation and the whole correlation against plain Python loops."""

import datetime as dt
import random

import pytest

from pulseloom.functions.regex import to_jvm_regex
from pulseloom.operators import rules as ru
from pulseloom.schemas import PATTERNS, RULES, SIGNALS

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
FALLBACK = "insufficient deterministic evidence"


def rule(id_, match_type="single", priority=50, enabled=True, text=None, advice=("do",), age=0):
    when = T0 - dt.timedelta(days=age)
    return (id_, id_, "", 0.5, priority, enabled, match_type, text or f"because {id_}", list(advice), 1, when, when)


def pattern(id_, rule_id, kind="contains", text="x", event="log", source="svc", env="prod", conditions=(), severity=0, age=0):
    when = T0 - dt.timedelta(days=age)
    regex = to_jvm_regex(text) if kind == "regex" else None
    return (id_, rule_id, event, source, env, severity, kind, text, list(conditions), {}, when, when, regex)


def signal(id_, message, payload="{}", event="log", source="svc", env="prod", at=0, severity=5):
    return (id_, event, source, env, T0 + dt.timedelta(seconds=at), severity, message, payload, {})


def analyze(spark, signals, rules, patterns, **options):
    frames = (spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(rules, RULES), spark.createDataFrame(patterns, PATTERNS))
    return ru.analyze_sessions(*frames, **options).orderBy("source", "session_start").collect()


EVIDENCE = [signal("1", "db timeout", '{"durationMs":650.0}'), signal("2", "retry succeeded", '{"attempt":2}', at=1)]


@pytest.mark.parametrize(
    ("match_type", "texts", "hit"),
    [
        ("single", ["timeout"], True),
        ("correlation", ["timeout", "retry"], True),
        ("correlation", ["timeout", "cpu spike"], False),
        ("single", ["timeout", "cpu spike"], True),
        ("ALL", ["timeout", "cpu spike"], False),
        ("ALL", ["retry"], True),
    ],
)
def test_any_and_all(spark, match_type, texts, hit):
    patterns = [pattern(f"p{i}", "r", text=t) for i, t in enumerate(texts)]
    row = analyze(spark, EVIDENCE, [rule("r", match_type)], patterns)[0]
    assert (row.analysis_summary == "because r") is hit
    assert row.analysis_source == ("rule-based" if hit else "hybrid")


def test_required_literals_are_in_every_match():
    import re

    from pulseloom.functions.literals import required_literals

    rng = random.Random(11)
    parts = ["ab", "c", "x?", "y*", "z+", "d{0,2}", "(ef)?", "(gh)", "[ij]", "[^k]", r"\.", r"\d", r"\s+", ".", "^", "$", " lm", r"\?", "n+?"]
    letters = "abcdefghijklmnxyz .?5 k"
    seen = 0
    for _ in range(3_000):
        regex = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        for _ in range(12):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 8)))
            if re.search(regex, text):
                seen += 1
                assert all(literal in text for literal in required_literals(regex)), (regex, text)
    assert seen > 1_000
    assert required_literals("timeout after [0-9]+ms") == ["timeout after ", "ms"]
    assert required_literals(r"a|b") == required_literals("(?i)abc") == required_literals(r"\x41bc") == []


def test_indexed_hits_equal_plain_hits(spark):
    rng = random.Random(12)
    words = ["time", "timeout", "error 5", "é日本", "a", "", "conn", " pool", "x.y"]
    signals = [signal(str(n), " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) if n else None, source=f"s{n % 3}", env=rng.choice(["prod", " prod "]), severity=n % 6) for n in range(300)]
    kinds = ("contains", "exact", "regex", "other")
    patterns = [pattern(f"p{n}", "r", rng.choice(kinds), rng.choice([*words, "time.*5", "(conn|pool)", "^a", "error [0-9]", "日本?"]), source=f"s{n % 4}", severity=n % 4) for n in range(80)]
    frames = spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(patterns, PATTERNS)
    index = ru.literal_index(frames[1])
    assert index.count() == 80 and 0 < index.where("gram is null").count() < 60
    for enforce in (False, True):
        plain = ru.pattern_hits(*frames, enforce).where("pattern_id is not null").select("id", "pattern_id")
        found = ru.indexed_pattern_hits(*frames, index, enforce)
        assert sorted(map(tuple, found.where("pattern_id is not null").select("id", "pattern_id").collect())) == sorted(map(tuple, plain.collect()))
        assert found.select("id").distinct().count() == 300
    evidence = [ru.session_evidence(frames[0], frames[1], index=i).selectExpr("source", "env", "session_start", "session_end", "max_severity", "array_sort(event_types)", "array_sort(hit_patterns)") for i in (None, index)]
    assert sorted(map(repr, evidence[0].collect())) == sorted(map(repr, evidence[1].collect()))


def test_event_type_selects_for_the_session_not_the_signal(spark):
    signals = [signal("1", "nothing", event="queue"), signal("2", "boom x", event="log", at=1)]
    hit = analyze(spark, signals, [rule("r")], [pattern("p", "r", event="queue")])[0]
    assert hit.analysis_summary == "because r"
    miss = analyze(spark, signals, [rule("r")], [pattern("p", "r", event="health")])[0]
    assert miss.analysis_summary == FALLBACK


def test_all_means_all_candidates(spark):
    patterns = [pattern("p1", "r", text="timeout"), pattern("p2", "r", text="absent", source="other")]
    assert analyze(spark, EVIDENCE, [rule("r", "correlation")], patterns)[0].analysis_summary == "because r"


def test_severity_min_is_ignored_unless_enforced(spark):
    patterns = [pattern("p", "r", text="timeout", severity=99)]
    assert analyze(spark, EVIDENCE, [rule("r")], patterns)[0].analysis_summary == "because r"
    assert analyze(spark, EVIDENCE, [rule("r")], patterns, enforce_severity_min=True)[0].analysis_summary == FALLBACK


def test_conditions_and_message_belong_to_one_signal(spark):
    condition = ("attempt", "equals", "2")
    assert analyze(spark, EVIDENCE, [rule("r")], [pattern("p", "r", text="timeout", conditions=[condition])])[0].analysis_summary == FALLBACK
    assert analyze(spark, EVIDENCE, [rule("r")], [pattern("p", "r", text="retry", conditions=[condition])])[0].analysis_summary == "because r"


def test_disabled_rules_and_refused_regex_never_match(spark):
    rules = [rule("r1", enabled=False), rule("r2")]
    patterns = [pattern("p1", "r1", text="timeout"), pattern("p2", "r2", kind="regex", text="[")]
    assert analyze(spark, EVIDENCE, rules, patterns)[0].analysis_summary == FALLBACK


def test_order_dedupe_and_scores(spark):
    rules = [
        rule("a", priority=10, advice=("one", "two")),
        rule("b", priority=90, text="same", advice=("two",)),
        rule("c", priority=50, text="same", advice=("three",), age=5),
        rule("d", priority=50, advice=("four",), age=1),
    ]
    patterns = [pattern(f"p{r}", r, text="") for r in "abcd"]
    row = analyze(spark, EVIDENCE, rules, patterns)[0]
    assert row.analysis_summary == "same; because d; because a"
    assert row.recommendations == ["two", "four", "three", "one"]
    assert [round(c, 2) for c in row.confidence] == [0.83, 0.76, 0.69, 0.62]


def test_source_and_environment_are_trimmed_for_the_lookup_only(spark):
    rows = analyze(spark, [signal("1", "x", source=" svc ")], [rule("r")], [pattern("p", "r")])
    assert (rows[0].source, rows[0].analysis_summary) == (" svc ", "because r")


def test_patterns_with_missing_parts_are_reported(spark):
    rows = [pattern("p", "r"), (*pattern("q", "r")[:6], None, None, *pattern("q", "r")[8:])]
    assert [r.id for r in ru.unusable_patterns(spark.createDataFrame(rows, PATTERNS)).collect()] == ["q"]


def brute_force(signals, rules, patterns, window):
    """Sessions, candidates and verdicts by plain loops."""
    keys = {}
    for s in signals:
        keys.setdefault((s[2], s[3]), []).append(s)
    out = {}
    for (source, env), items in keys.items():
        items.sort(key=lambda s: (s[4], s[0]))
        groups = [[items[0]]]
        for s in items[1:]:
            if (s[4] - groups[-1][-1][4]).total_seconds() > window:
                groups.append([])
            groups[-1].append(s)
        for group in groups:
            types = {s[1] for s in group}
            texts = []
            for r in sorted(rules, key=lambda r: (-r[4], r[0])):
                mine = [p for p in patterns if p[1] == r[0] and p[3] == source and p[4] == env and p[2] in types]
                if not mine or not r[5]:
                    continue
                hits = [any(p[7] in s[6] for s in group) for p in mine]
                if (any if r[6] == "single" else all)(hits):
                    texts.append(r[7])
            out[source, env, group[0][4]] = "; ".join(dict.fromkeys(texts)) or FALLBACK
    return out


def test_random_rules_agree_with_loops(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta"]
    signals = [
        signal(f"s{n}", rng.choice(words), event=rng.choice(["log", "queue"]), source="hot" if n % 3 else f"v{n % 4}",
               env=rng.choice(["prod", "dev"]), at=rng.uniform(0, 40_000), severity=rng.randrange(6))
        for n in range(1_500)
    ]
    rules = [rule(f"r{n}", rng.choice(["single", "correlation", "ALL"]), rng.randrange(5), rng.random() > 0.2) for n in range(12)]
    patterns = [
        pattern(f"p{n:02d}", f"r{rng.randrange(12)}", text=rng.choice(words), event=rng.choice(["log", "queue"]),
                source=rng.choice(["hot", "v1", "v2"]), env=rng.choice(["prod", "dev"]))
        for n in range(40)
    ]
    rows = analyze(spark, signals, rules, patterns)
    found = {(r.source, r.env, T0 + dt.timedelta(microseconds=r.session_start - int(T0.timestamp() * 1e6))): r.analysis_summary for r in rows}
    assert found == brute_force(signals, rules, patterns, 60)
    assert len(set(found.values())) > 5


def test_input_order_does_not_matter(spark):
    signals = [signal(f"s{n}", "x" if n % 7 == 0 else "y", at=n * 40 % 5_000, source=f"svc{n % 2}") for n in range(300)]
    shuffled = random.Random(1).sample(signals, len(signals))
    rules, patterns = [rule("r")], [pattern("p", "r", source="svc1")]
    assert analyze(spark, signals, rules, patterns) == analyze(spark, shuffled, rules, patterns)


def test_patterns_that_ask_the_same_are_tested_once(spark):
    signals = [signal("1", "disk 7 full"), signal("2", "disk 8"), signal("3", None)]
    patterns = [pattern(f"p{n}", "r", "regex", "[f]ull") for n in range(40)] + [pattern(f"q{n}", "r", "contains", "disk 8") for n in range(30)]
    frames = spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(patterns, PATTERNS)
    found = ru.indexed_pattern_hits(*frames, ru.literal_index(frames[1]))
    rows = sorted((r.id, r.pattern_id) for r in found.where("pattern_id is not null").collect())
    assert rows == sorted([("1", f"p{n}") for n in range(40)] + [("2", f"q{n}") for n in range(30)])
    assert found.select("id").distinct().count() == 3
    # The join that tests messages holds one row for each test, not for each pattern.
    kept = []
    ru.broadcast_if_small, small = lambda df, **options: kept.append(df.count()) or small(df, **options), ru.broadcast_if_small
    try:
        ru.indexed_pattern_hits(*frames, ru.literal_index(frames[1]))
    finally:
        ru.broadcast_if_small = small
    assert kept == [2, 70]


def test_hits_of_many_ids_pack_well_and_lose_nothing(spark, tmp_path, monkeypatch):
    signals = [signal(str(n), f"disk {n % 7} full" if n % 5 else None, source=f"s{n % 2}") for n in range(500)]
    many = [pattern(f"p{n:05d}", "r", "regex", "[f]ull", source="s0") for n in range(12_000)]
    few = [pattern(f"q{n}", "r", "contains", f"disk {n}", source="s1") for n in (1, 1, 2, 3)]
    frames = spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(many + few, PATTERNS)
    found = ru.indexed_pattern_hits(*frames, ru.literal_index(frames[1])).select("id", "pattern_id")
    found.where("pattern_id is not null").write.parquet(out := str(tmp_path / "hits"))
    hits = spark.read.parquet(out)
    full = {str(n) for n in range(0, 500, 2) if n % 5}
    of_many = hits.where("startswith(pattern_id, 'p')").groupBy("id").agg({"pattern_id": "count", "*": "count"}).collect()
    assert {r.id: tuple(r[1:]) for r in of_many} == {i: (12_000, 12_000) for i in full}
    assert hits.distinct().where("startswith(pattern_id, 'p')").count() == 12_000 * len(full)
    # Signals times patterns: two bytes a row if each signal's ids follow one another, all 12,000 of them.
    assert sum(f.stat().st_size for f in (tmp_path / "hits").glob("*.parquet")) < 0.6 * hits.count()
    monkeypatch.setattr(ru, "ID_GROUP", 8)
    patterns = spark.createDataFrame(many[:100] + many[:9] + few, PATTERNS)
    plain, grouped = ru.pattern_hits(frames[0], patterns), ru.indexed_pattern_hits(frames[0], patterns, ru.literal_index(patterns))
    pairs = [sorted((r.id, r.pattern_id) for r in f.where("pattern_id is not null").collect()) for f in (plain, grouped)]
    assert pairs[0] == pairs[1] and len(pairs[1]) > 109 * len(full)
    assert grouped.select("id").distinct().count() == 500 and grouped.columns == [*frames[0].columns, "pattern_id"]
