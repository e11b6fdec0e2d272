import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.operators import incidents as inc
from pulseloom.plans.correlate import correlate, suggested_analysis
from pulseloom.schemas import INCIDENTS, PATTERNS, RULES
from tests.test_rules import signal

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
BASE_US = int(T0.timestamp() * 1_000_000)
SESSIONS = "source string, env string, session_start long, session_end long"
SECOND = 1_000_000


def as_of():
    return F.lit(T0 + dt.timedelta(days=9))


def incident(id_, at=0.0, services=("svc",), envs=("prod",), status="new", severity=1, advice=("old",)):
    when = T0 + dt.timedelta(seconds=at)
    return (id_, "t", status, severity, list(services), list(envs), "s", list(advice), when, when)


def frames(spark, sessions, incidents):
    return spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame(incidents, INCIDENTS)


def greedy(sessions, incidents, window):
    """Keys in order, sessions in order, each takes its first available incident."""
    taken, out = set(), {}
    for source, env in sorted({s[:2] for s in sessions}):
        for s in sorted(x for x in sessions if x[:2] == (source, env)):
            fits = [
                (i[9], i[0])
                for i in incidents
                if i[2].lower() not in ("resolved", "closed", "in-progress") and source in i[4] and env in i[5]
                and i[0] not in taken and s[3] - (BASE_US + round((i[9] - T0).total_seconds() * SECOND)) <= window
            ]
            if fits:
                out[s[:3]] = min(fits)[1]
                taken.add(out[s[:3]])
    return out


def random_case(seed, shared):
    rng = random.Random(seed)
    sessions, incidents = [], []
    for key in range(6):
        source, env = ("hot", "prod") if key < 2 else (f"v{key}", rng.choice(["prod", "dev"]))
        at = 0
        if (source, env) in {s[:2] for s in sessions}:
            continue
        for _ in range(60 if source == "hot" else 12):
            at += rng.randrange(61, 40_000)
            end = at + rng.randrange(0, 50)
            sessions.append((source, env, BASE_US + at * SECOND, BASE_US + end * SECOND))
            at = end
    sources = sorted({s[0] for s in sessions})
    for n in range(150):
        services = rng.sample(sources, rng.randrange(1, 4)) if shared else [rng.choice(sources)]
        envs = ["prod", "dev"] if shared and rng.random() < 0.3 else [rng.choice(["prod", "dev"])]
        at = rng.choice([rng.randrange(0, 900_000), rng.randrange(0, 20) * 40_000])
        incidents.append(incident(f"i{n:03d}", at, services, envs, rng.choice(["new", "Open", "Resolved", "new"])))
    return sessions, incidents


def test_claims_agree_with_the_greedy_loop(spark):
    for seed in range(3):
        sessions, incidents = random_case(seed, shared=False)
        found = inc.claim_incidents(*frames(spark, sessions, incidents), 60 * SECOND).collect()
        assert {(r.source, r.env, r.session_start): r.incident_id for r in found} == greedy(sessions, incidents, 60 * SECOND)


def test_claims_of_shared_incidents_agree_with_the_greedy_loop(spark):
    sessions, incidents = random_case(5, shared=True)
    found = inc.claim_incidents(*frames(spark, sessions, incidents), 60 * SECOND).collect()
    want = greedy(sessions, incidents, 60 * SECOND)
    assert {(r.source, r.env, r.session_start): r.incident_id for r in found} == want
    assert len(set(want.values())) == len(want)


def test_only_parts_that_still_change_are_claimed_again(spark, monkeypatch):
    """Two chains of keys of unlike length and a crowd of keys that share nothing."""
    sessions, incidents = [], []
    for part, length in (("a", 5), ("b", 2)):
        for k in range(length):
            sessions += [(f"{part}{k}", "prod", BASE_US + (n * 100 + k) * SECOND, BASE_US + (n * 100 + k + 1) * SECOND) for n in range(4)]
        for k in range(length - 1):
            incidents += [incident(f"{part}{k}-{n}", n * 90, (f"{part}{k}", f"{part}{k + 1}"), ("prod",)) for n in range(5)]
    for k in range(30):
        sessions.append((f"c{k}", "prod", BASE_US, BASE_US + SECOND))
        incidents.append(incident(f"c{k}", 5, (f"c{k}",), ("prod",)))
    places = inc.open_places(spark.createDataFrame(incidents, INCIDENTS))
    assert sorted((r.source, r.part) for r in inc.dependent_keys(places).collect() if r.source[0] == "a") == [(f"a{k}", '{"source":"a0","env":"prod"}') for k in range(5)]
    asked = []
    plain = inc._claims
    monkeypatch.setattr(inc, "_claims", lambda s, *rest: asked.append({r.source[0] for r in s.collect()}) or plain(s, *rest))
    found = inc.claim_incidents(*frames(spark, sessions, incidents), 60 * SECOND).collect()
    assert {(r.source, r.env, r.session_start): r.incident_id for r in found} == greedy(sessions, incidents, 60 * SECOND)
    assert asked[0] == {"c"} and asked[1] == {"a", "b"} and asked[-1] == {"a"}


def test_related_agrees_with_a_plain_search(spark):
    sessions, incidents = random_case(8, shared=True)
    for bucket in (3_600 * SECOND, inc.BUCKET_US):
        found = inc.related_incident(*frames(spark, sessions, incidents), 60 * SECOND, bucket_us=bucket).collect()
        for r in found:
            alone = greedy([(r.source, r.env, r.session_start, r.session_end)], incidents, 60 * SECOND)
            assert r.incident_id == next(iter(alone.values()), None)
        assert len(found) == len(sessions)


def test_an_incident_updated_later_always_qualifies_unless_two_sided(spark):
    sessions, incidents = [("svc", "prod", BASE_US, BASE_US)], [incident("later", 10_000)]
    assert inc.related_incident(*frames(spark, sessions, incidents)).first().incident_id == "later"
    assert inc.related_incident(*frames(spark, sessions, incidents), two_sided=True).first().incident_id is None


SIGNALS = (
    "id string, event_type string, source string, env string, timestamp timestamp, severity int, message string, payload string, "
    "metadata map<string,string>"
)


def run(spark, signals, incidents):
    signals = spark.createDataFrame(signals, SIGNALS)
    return correlate(signals, spark.createDataFrame(incidents, INCIDENTS), spark.createDataFrame([], RULES),
                     spark.createDataFrame([], PATTERNS), as_of())


def test_high_session_without_incident_creates_one(spark):
    result = run(spark, [signal("1", "m", severity=5), signal("2", "m", severity=4, at=5)], [])
    row = result.created.first()
    assert (row.status, row.severity, row.impacted_services, row.environments) == ("resolved", 5, ["svc"], ["prod"])
    assert row.analysis_summary == "insufficient deterministic evidence"
    assert {(r.incident_id, r.signal_id) for r in result.links.collect()} == {(row.id, "1"), (row.id, "2")}
    assert result.merged.count() == 0


def test_sessions_merge_into_open_incidents(spark):
    signals = [signal("1", "m", severity=5), signal("2", "m", severity=1, at=500), signal("3", "m", severity=1, at=5_000)]
    result = run(spark, signals, [incident("a", 0, severity=2), incident("b", 480, severity=3), incident("c", 4_000, status="closed")])
    merged = {r.id: r for r in result.merged.collect()}
    assert {k: (r.severity, r.status) for k, r in merged.items()} == {"a": (5, "resolved"), "b": (3, "resolved")}
    assert merged["a"].recommendations[0] == "old" and len(merged["a"].recommendations) == 3
    assert result.created.count() == 0  # the last session is low and has no incident: dropped
    assert {r.signal_id for r in result.links.collect()} == {"1", "2"}


def test_upsert_keeps_created_at_and_repeats_safely(spark):
    old = spark.createDataFrame([incident("a"), incident("b")], INCIDENTS)
    new = spark.createDataFrame([incident("b", 500, severity=4), (None, *incident("x", 700)[1:])], INCIDENTS)
    once = inc.upsert_incidents(old, new, as_of())
    rows = {r.id: r for r in once.collect()}
    assert len(rows) == 3 and rows["b"].severity == 4
    assert rows["b"].created_at == rows["a"].created_at and rows["b"].updated_at > rows["a"].updated_at
    assert sorted(map(repr, inc.upsert_incidents(once, new, as_of()).collect())) == sorted(map(repr, once.collect()))


def test_the_last_request_for_an_id_wins(spark):
    incidents = spark.createDataFrame([incident("a"), incident("b")], INCIDENTS)
    updates = spark.createDataFrame([("a", "open", 2), ("a", "resolved", 5), ("a", "", 9), ("b", "x", 1)], "id string, status string, pos int")
    assert sorted((r.id, r.status) for r in inc.set_status(incidents, updates, as_of()).collect()) == [("a", "resolved"), ("b", "x")]
    new = spark.createDataFrame([(*incident("b", severity=4), 1), (*incident("b", severity=2), 3)], T.StructType([*INCIDENTS.fields, T.StructField("pos", T.IntegerType())]))
    assert sorted((r.id, r.severity) for r in inc.upsert_incidents(incidents, new, as_of()).collect()) == [("a", 1), ("b", 2)]


def test_set_status(spark):
    incidents = spark.createDataFrame([incident("a"), incident("b")], INCIDENTS)
    updates = spark.createDataFrame([("a", "resolved"), ("", "x"), ("b", ""), ("zz", "x")], "id string, status string")
    assert {r.id: r.status for r in inc.set_status(incidents, updates, as_of()).collect()} == {"a": "resolved", "b": "new"}
    errors = {r.id: r.error for r in inc.status_errors(incidents, updates).collect()}
    assert errors == {"": "incident id is required", "b": "incident status is required", "zz": "not found"}


def test_correlate_with_a_suggester_and_known_links(spark):
    signals = spark.createDataFrame([signal("1", "m", severity=5), signal("2", "m", severity=4, at=5)], SIGNALS)
    rules, patterns, none = spark.createDataFrame([], RULES), spark.createDataFrame([], PATTERNS), spark.createDataFrame([], INCIDENTS)

    def suggester(prompts):
        return [('{"hypothesisTemplate":"%d lines","recommendations":["look"]}' % p.count("\n- #"), None) for p in prompts]

    analyzer = suggested_analysis(suggester, as_of(), page_rows=1)
    first = correlate(signals, none, rules, patterns, as_of(), analyzer=analyzer)
    row = first.created.first()
    assert (row.analysis_summary, row.recommendations) == ("2 lines", ["look"])
    known = first.links.filter("signal_id = '1'").select("incident_id", "signal_id")
    again = correlate(signals, none, rules, patterns, as_of(), analyzer=analyzer, known_links=known)
    assert [(r.incident_id, r.signal_id) for r in again.links.collect()] == [(row.id, "2")]


def test_prompts_are_whole_when_joins_by_id_turn_into_broadcasts(spark):
    from pulseloom.operators import suggest as su

    known = spark.createDataFrame([(f"i{n}", "t", "s", 1, ["a"], ["e"], "", []) for n in range(40)], "id string, title string, status string, severity int, impacted_services array<string>, environments array<string>, analysis_summary string, recommendations array<string>")
    lines = spark.createDataFrame([(f"i{n}", f"e{n}-{k}", "log", "a", "e", 1, "m") for n in range(40) for k in range(5)], "incident_id string, signal_id string, event_type string, source string, env string, severity int, message string")
    parts = su.prompt_parts(known, lines.withColumn("timestamp", as_of()), 2)

    def whole(prompts):
        return [(f"{p.count('- id: ')} {p.count('- #')}", None) for p in prompts]

    def by_pages(_, pages):
        return whole(["".join(pages)])[0]

    for ask, suggester in ((su.ask_suggester, whole), (su.ask_by_pages, by_pages)):
        asked = ask(parts, suggester)
        # A shuffle of its own, whatever the joins below deal by.
        assert "Exchange hashpartitioning(xxhash64(id" in asked._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.id, r.answer) for r in asked.collect()) == sorted((f"i{n}", "1 5") for n in range(40))
