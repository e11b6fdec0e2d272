import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pulseloom.operators import delivery as dl
from pulseloom.operators import retention as rt
from pulseloom.operators import rule_tables as tables
from pulseloom.operators import suggest as su
from pulseloom.operators import transactions
from pulseloom.schemas import DELIVERY_LOG, INCIDENTS, PAYLOAD_FILTERS
from pulseloom.session import checkpointed
from tests.test_incidents import T0, as_of, incident
from tests.test_rules import signal

RULE = ("pos int, id string, name string, description string, confidence double, priority int, enabled boolean, match_type string, "
        "hypothesis_template string, recommendations array<string>, version int")


def request(pos=0, id_="", name="Backlog", confidence=0.5, priority=None, enabled=None, match_type="single", text="slow", version=None):
    return (pos, id_, name, "d", confidence, priority, enabled, match_type, text, ["a"], version)


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({}, None),
        ({"name": " \t"}, "name is required"),
        ({"text": ""}, "hypothesisTemplate is required"),
        ({"match_type": None}, "The matchType value must be either SINGLE or CORRELATION."),
        ({"match_type": " CORRELATION "}, None),
        ({"version": 0}, "The version must be at least 1"),
        ({"confidence": 1.5}, "The confidence value must be between 0 and 1"),
        ({"priority": 999}, None),
    ],
)
def test_rule_requests(spark, change, error):
    row = tables.validate_rules(spark.createDataFrame([request(**change)], RULE)).first()
    assert row.error == error
    assert (row.priority, row.enabled, row.version if error is None else 1) == (100, True, 1)


def test_rules_insert_once_and_answer_with_their_id(spark):
    requests = tables.validate_rules(spark.createDataFrame([request(1, "x"), request(2, "y"), request(3, "z", name="Other")], RULE))
    empty = requests.limit(0).drop("pos", "error")
    answers, rows = tables.insert_rules_if_absent(empty, requests.drop("error"))
    assert {tuple(r) for r in answers.collect()} == {(1, "x", True), (2, "x", False), (3, "z", True)}
    again, more = tables.insert_rules_if_absent(rows.drop("pos"), requests.drop("error"))
    assert {tuple(r) for r in again.collect()} == {(1, "x", False), (2, "x", False), (3, "z", False)}
    assert more.count() == 0


PATTERN = ("pos int, id string, rule_id string, event_type string, source string, environment string, severity_min int, "
           "message_match_type string, message_pattern string, payload_conditions array<struct<field:string,operator:string,value:string>>, "
           "variable_mappings map<string,string>")


def pattern_request(pos=0, id_="", rule_id="r", event="log", source="svc", env="prod", severity=0, kind="EXACT", text="x", conditions=None, mappings=None):
    return (pos, id_, rule_id, event, source, env, severity, kind, text, conditions, mappings)


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({}, None),
        ({"rule_id": " "}, "ruleId is required"),
        ({"kind": ""}, "messageMatchType and messagePattern must be provided together"),
        ({"event": "", "source": ""}, "The EventType value is required"),
        ({"source": None}, "The source value is required"),
        ({"env": ""}, "The Environment value is required"),
        ({"env": "QA"}, "invalid environment: qa"),
        ({"severity": None}, "The SeverityMin value is required"),
        ({"severity": 101}, "The SeverityMin value must be between 0 and 100"),
        ({"kind": "prefix"}, "The MessageMatchType value must be either EXACT, CONTAINS, or REGEX"),
        ({"kind": "", "text": ""}, "The MessageMatchType value must be either EXACT, CONTAINS, or REGEX"),
        ({"event": "authentication"}, None),
    ],
)
def test_pattern_requests(spark, change, error):
    assert tables.validate_patterns(spark.createDataFrame([pattern_request(**change)], PATTERN)).first().error == error


def test_patterns_compare_json_values_and_need_their_rule(spark):
    one, two = [("k", "equals", "1")], [("k", "equals", "1.0")]
    rows = [
        pattern_request(1, "a", conditions=one, mappings={"x": "1", "y": "2"}),
        pattern_request(2, "b", conditions=two, mappings={"y": "2", "x": "1"}),
        pattern_request(3, "c", conditions=[("k", "equals", '"1"')], mappings={"x": "1", "y": "2"}),
        pattern_request(4, "d", rule_id="unknown"),
    ]
    requests = tables.validate_patterns(spark.createDataFrame(rows, PATTERN)).drop("error")
    rules = spark.createDataFrame([("r",)], "id string")
    answers, _ = tables.insert_patterns_if_absent(requests.limit(0).drop("pos"), requests, rules)
    assert {tuple(r) for r in answers.collect()} == {(1, "a", True), (2, "a", False), (3, "c", True)}
    assert [r.id for r in tables.unknown_rules(requests, rules).collect()] == ["d"]


def test_condition_lists(spark):
    frame = spark.createDataFrame(
        [(0, '[{"field":"a","operator":"equals","value":{"b":1}}]'), (1, '[{"field":"a"},{"path":"p"}]'), (2, "{"), (3, None)],
        "n int, conditions_json string",
    )
    rows = {r.n: r for r in tables.parse_conditions(frame).collect()}
    assert [tuple(c) for c in rows[0].payload_conditions] == [("a", "equals", '{"b":1}')]
    assert "unknown field" in rows[1].condition_error and rows[1].payload_conditions is None
    assert rows[2].condition_error is not None
    assert rows[3].condition_error is None


def test_message_regex_is_derived_on_save(spark):
    rows = [pattern_request(1, kind="regex", text="a+$"), pattern_request(2, kind="regex", text="["), pattern_request(3, text="a+")]
    saved = tables.with_message_regex(tables.validate_patterns(spark.createDataFrame(rows, PATTERN)))
    assert {r.pos: r.message_regex for r in saved.collect()} == {1: r"a+\z", 2: None, 3: None}


def sequential(stored, requests):
    keys, failed = set(stored), []
    for id_, env, payloads in sorted(requests):
        wanted = {(env, p) for p in payloads}
        if wanted & keys:
            failed.append(id_)
        else:
            keys |= wanted
    return keys - set(stored), failed


def test_allow_list_requests_are_transactions_in_order(spark):
    rng = random.Random(2)
    stored = [("production", "k1"), ("staging", "k2")]
    for _ in range(2):
        requests = [(n, rng.choice(["production", "staging"]), rng.sample([f"k{i}" for i in range(14)], rng.randrange(1, 4))) for n in range(16)]
        filters = spark.createDataFrame([(*s, T0) for s in stored], PAYLOAD_FILTERS)
        asked = spark.createDataFrame(requests, "request_id int, environment string, payloads array<string>")
        rows, conflicts = tables.add_allow_keys(filters, asked, as_of())
        added, failed = sequential(stored, requests)
        assert {(r.environment, r.allow_payload) for r in rows.collect()} == added
        assert {r.request_id for r in conflicts.collect()} == set(failed)


def test_failed_requests_name_all_keys_in_their_way_and_requests_without_id_wait_for_ever(spark):
    filters = spark.createDataFrame([("production", "old", T0)], PAYLOAD_FILTERS)
    requests = [(1, "prod", ["a", "b"]), (2, "prod", ["b", "c"]), (3, "prod", ["c", "old", "a"]), (4, "prod", ["c", "c"]), (None, "prod", ["z"])]
    asked = spark.createDataFrame(requests, "request_id int, environment string, payloads array<string>")
    rows, conflicts = tables.add_allow_keys(filters, asked, as_of())
    assert sorted(r.allow_payload for r in rows.collect()) == ["a", "b", "c"]
    assert sorted((r.request_id, r.allow_payload) for r in conflicts.collect()) == [(2, "b"), (3, "a"), (3, "old")]
    none, _ = tables.add_allow_keys(filters, asked.limit(0), as_of())
    assert none.count() == 0


def wanted_rows(spark, requests):
    return spark.createDataFrame([(n, k) for n, keys in requests for k in keys], "request_id long, key string")


def test_requests_settle_alike_by_scan_and_by_chains(spark):
    rng = random.Random(5)
    for keys in (6, 40):
        requests = [(n, rng.sample([f"k{i}" for i in range(keys)], rng.randrange(1, 4))) for n in range(60)]
        added, failed = sequential([], [(n, None, ks) for n, ks in requests])
        won = {n for n, _ in requests} - set(failed)
        for scan_rows in (0, 10, 1_000):
            rows = transactions.accepted_requests(wanted_rows(spark, requests), ["key"], scan_rows).collect()
            assert {r.request_id for r in rows} == won and {(None, r.key) for r in rows} == added


def test_a_chain_of_ten_thousand_requests_takes_log_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(transactions, "checkpointed", lambda df: written.append(1) or checkpointed(df))
    chain = spark.range(10_000).selectExpr("id as request_id", "explode(array(id, id + 1)) as key")
    row = transactions.accepted_requests(chain, ["key"], scan_rows=0).agg(F.count_distinct("request_id").alias("n"), F.max(F.col("request_id") % 2).alias("odd")).first()
    assert tuple(row) == (5_000, 0)
    assert len(written) < 30


def test_one_key_that_everybody_wants(spark):
    asked = spark.range(50_000).selectExpr("id as request_id", "explode(array('hot', concat('own', id))) as key")
    rows = transactions.accepted_requests(asked, ["key"]).collect()
    assert sorted((r.request_id, r.key) for r in rows) == [(0, "hot"), (0, "own0")]


def test_allow_list_removal_counts(spark):
    filters = spark.createDataFrame([("production", k, T0) for k in ("traceId", "sessionId", "requestId")], PAYLOAD_FILTERS)
    asked = spark.createDataFrame([(1, "prod", [" traceId ", "traceId", "sessionId"])], "request_id int, environment string, payloads array<string>")
    left, removed = tables.remove_allow_keys(filters, asked)
    assert (left.count(), removed.count()) == (1, 2)
    assert [r.allow_payload for r in tables.allow_list(filters, "production").collect()] == ["requestId", "sessionId", "traceId"]


def test_delete_rules_cascades(spark):
    rules = spark.createDataFrame([("r1",), ("r2",)], "id string")
    patterns = spark.createDataFrame([("p1", "r1"), ("p2", "r2")], "id string, rule_id string")
    left, kept = tables.delete_rules(rules, patterns, rules.filter("id = 'r1'"))
    assert [r.id for r in left.collect()] == ["r2"] and [r.id for r in kept.collect()] == ["p2"]


# -- delivery ---------------------------------------------------------------


def stats(spark, log, now, **options):
    return dl.delivery_stats(dl.delivery_outcomes(spark.createDataFrame(log, DELIVERY_LOG), F.lit(now), **options)).first()


def test_two_nacks_of_two_go_to_the_dead_letters(spark):
    log = [(1, 1, "deliver", 0), (1, 1, "nack", 1), (1, 2, "deliver", 2), (1, 2, "nack", 3)]
    row = stats(spark, log, 10, max_attempts=2)
    assert (row.dead_letter_count, row.retry_count, row.queue_depth, row.last_processed_us) == (1, 2, 0, 3)


def test_expiry_counts_as_retry_at_its_very_instant(spark):
    log = [(1, 1, "deliver", 0)]
    assert stats(spark, log, 14, timeout_us=15).retry_count == 0
    row = stats(spark, log, 15, timeout_us=15)
    assert (row.retry_count, row.queue_depth, row.dead_letter_count) == (1, 1, 0)
    again = stats(spark, [*log, (1, 2, "deliver", 20)], 21, timeout_us=15)
    assert (again.retry_count, again.queue_depth) == (1, 1)
    assert stats(spark, [(1, 1, "enqueue", 0)], 5).queue_depth == 1


def test_acks_and_nacks_of_past_attempts_do_not_count(spark):
    twice = [(1, 1, "deliver", 0), (1, 2, "deliver", 20)]
    row = stats(spark, [*twice, (1, 1, "ack", 21)], 25, timeout_us=15)
    assert (row.queue_depth, row.retry_count, row.last_processed_us) == (1, 1, None)
    row = stats(spark, [*twice, (1, 1, "nack", 21), (1, 2, "ack", 23)], 25, timeout_us=15)
    assert (row.queue_depth, row.retry_count, row.last_processed_us) == (0, 1, 23)


def test_empty_log_and_health(spark):
    empty = dl.delivery_outcomes(spark.createDataFrame([], DELIVERY_LOG), F.lit(0))
    row = dl.health_snapshot(empty, spark.createDataFrame([incident("a")], INCIDENTS)).first()
    assert (row.queue_depth, row.retry_count, row.incidents, row.last_processed_us) == (0, 0, 1, None)


# -- retention --------------------------------------------------------------


def test_retention_is_strict_and_keeps_missing_times(spark):
    limit = rt.signal_cutoff(F.lit("prod"), F.lit(T0 + dt.timedelta(days=30)))
    frame = spark.createDataFrame([("at", T0), ("old", T0 - dt.timedelta(microseconds=1)), ("none", None)], "id string, timestamp timestamp")
    assert {r.id for r in rt.keep_signals(frame, limit).collect()} == {"at", "none"}
    assert [r.id for r in rt.oldest_expired(frame, rt.signal_expired(limit), "timestamp", 5).collect()] == ["old"]
    assert rt.expired_count(frame, rt.signal_expired(limit)).first().deleted == 1


# -- suggestions ------------------------------------------------------------


def suggestion(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(su.parse_suggestion(F.col("t")).alias("p")).first().p


@pytest.mark.parametrize(
    ("text", "error"),
    [
        (None, su.NO_RESPONSE),
        ("", su.EMPTY_RESPONSE),
        ("not-json", su.BAD_JSON),
        ('{"hypothesisTemplate":"a","recommendations":"x"}', su.BAD_JSON),
        ('{"hypothesisTemplate":"  ","recommendations":["step"]}', su.NO_HYPOTHESIS),
        ('{"hypothesisTemplate":"something","recommendations":["","  "]}', su.NO_RECOMMENDATIONS),
        ('{"hypothesisTemplate":"something"}', su.NO_RECOMMENDATIONS),
    ],
)
def test_unusable_answers(spark, text, error):
    assert suggestion(spark, text).error == error


def test_fenced_answer_and_blank_recommendations(spark):
    good = suggestion(spark, '```json\n{"hypothesisTemplate": " Pool exhausted ", "recommendations": ["  grow ", "", " "]}\n```')
    assert (good.hypothesis, good.recommendations, good.error) == ("Pool exhausted", ["grow"], None)


def test_prompts_and_suggester(spark):
    incidents = spark.createDataFrame([incident("a", advice=()), incident("b", advice=("x", "y")), incident("c")], INCIDENTS)
    lines = [("a", *signal(str(n), f"m{n} ", at=n)) for n in range(2)] + [("b", *signal(str(n), "m", at=n)) for n in range(5)]
    evidence = spark.createDataFrame(
        lines, "incident_id string, signal_id string, event_type string, source string, env string, timestamp timestamp, severity int, "
        "message string, payload string, metadata map<string,string>",
    )
    parts = su.prompt_parts(incidents, evidence, page_rows=3)
    texts = {}
    for r in parts.orderBy("id", "part").collect():
        texts[r.id] = texts.get(r.id, "") + r.text
    assert texts["a"].endswith(
        "- existingRecommendations: none\n\nEvidence (2):\n"
        "- #1 id=0 eventType=log source=svc env=prod severity=5 timestamp=2024-01-01T00:00:00Z message=m0 \n"
        "- #2 id=1 eventType=log source=svc env=prod severity=5 timestamp=2024-01-01T00:00:01Z message=m1"
    )
    assert texts["a"].startswith("Incident:\n- id: a\n- title: t\n- status: new\n- severity: 1\n- impactedServices: svc\n")
    assert texts["b"].count("\n- #") == 5 and "existingRecommendations: x, y" in texts["b"]
    assert texts["c"].endswith("Evidence (0):\n- none")

    def suggester(prompts):
        whole = '{"hypothesisTemplate":"h","recommendations":["%d lines"]}'
        return [(None, "429") if "- id: c" in p else (whole % p.count("\n- #"), None) for p in prompts]

    answers = su.ask_suggester(parts, suggester)
    rows = {r.id: r for r in su.attach_suggestions(incidents, answers).collect()}
    assert (rows["a"].hypotheses, rows["a"].recommendations) == (["h"], ["2 lines"])
    assert rows["b"].recommendations == ["5 lines"]  # two pages, asked as one prompt
    assert rows["c"].recommendations[-1].startswith("OpenAI rate limit reached")


def test_prompts_as_page_streams(spark):
    """One prompt of 300 MB: the task sees it piece by piece, in order, and others may stop early."""
    body = "x" * 1_000_000
    long = spark.range(300).selectExpr("'long' as id", "id as part", f"concat(lpad(id, 3, '0'), '{body}') as text")
    short = spark.createDataFrame([("a", 1, "2"), ("a", 0, "1"), ("b", 0, None), ("c", 0, "1"), ("c", 1, "2")], "id string, part long, text string")

    def suggester(id_, pages):
        import resource

        head = next(pages)
        if id_ == "c":
            return None, "429"
        if id_ != "long":
            return head + "".join(pages), None
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        numbers = [int(page[:3]) for page in pages]
        grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
        return f"{numbers == list(range(300))} {grown < 200_000}", None

    rows = su.ask_by_pages(long.unionByName(short), suggester, "go:").collect()
    assert sorted(tuple(r) for r in rows) == sorted([("a", "go:12", None), ("b", "go:", None), ("c", None, "429"), ("long", "True True", None)], key=lambda r: r[0])
    assert su.ask_by_pages(short.limit(0), suggester).count() == 0


def test_settling_requests_broadcasts_nothing(spark, monkeypatch):
    from pulseloom.operators import groups

    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpointed(df)

    monkeypatch.setattr(transactions, "checkpointed", noted)
    monkeypatch.setattr(groups, "checkpointed", noted)
    chain = spark.range(60).selectExpr("id as request_id", "explode(array(id, id + 1)) as key")
    for scan_rows in (0, 1_000):
        assert transactions.accepted_requests(chain, ["key"], scan_rows).count() == 60
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
