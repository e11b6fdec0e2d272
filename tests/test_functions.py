"""Scalar functions against literal cases and, for regular expressions, RE2 in DuckDB."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulseloom.catalog.base import sql_mask
from pulseloom.functions import analysis as an
from pulseloom.functions import text as tx
from pulseloom.functions.payload import (
    condition_error,
    keys_error,
    normalize_keys,
    redact_payload,
    typed_conditions,
    typed_conditions_hold,
)
from pulseloom.functions.regex import jvm_regex, to_jvm_regex
from pulseloom.operators.rules import message_matches


def one(spark, column, **values):
    names = {k: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>") for k, v in values.items()}
    return spark.range(1).select(*[c.alias(k) for k, c in names.items()], F.lit(0).alias("_")).select(column.alias("v")).first()["v"]


def test_mask_agrees_with_re2_on_hostile_texts(spark):
    texts = [
        "password=hunter2, token : 'a b' secret:\"x y\" api-key=1;",
        "étoken=1 xtoken=2 token_=3 token=4",
        "Authorization: bearer  abc.def== BEARER x~y/z",
        "mail a.b+c@d-e.co.uk,x@y.z1 q@w.ee.f@g.hh .x@y.de",
        "a@b.com.x@y.de",
        "ACCESS_TOKEN=1 refreshtoken:\n2 paſſwd=3 toKen=4 ſecret=5 xſecret=6",
        "password =\t\x0bvalue",
        "",
        "no secrets at all",
        "token==x token=\"unterminated",
        "user@example.com password=user@example.com",
        "Bearer abc Bearer\nabc xBearer abc",
        "-@b.co a-@b.co é@b.co éa@b.coé",
        "key:=v passwd:'it''s'",
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    mine = {r.i: r.v for r in frame.select("i", tx.sanitize_message(F.col("t")).alias("v")).collect()}
    con = duckdb.connect()
    for i, text in enumerate(texts):
        want = con.execute(f"select {sql_mask('t')} from (select ? as t)", [text]).fetchall()[0][0]
        assert mine[i] == want, text
    again = frame.select("i", tx.sanitize_message(tx.sanitize_message(F.col("t"))).alias("v")).collect()
    assert {r.i: r.v for r in again if r.i < 4} == {i: v for i, v in mine.items() if i < 4}


PATTERNS = [
    r"timeout after \d+ms", "[", "a**", "a{2}", "a{2,1}", "a{,3}", "(?i)ERROR", "(?P<x>ab)+", "[[:alpha:]]+$", r"\bfoo\b",
    "^a|b$", "(?=a)", "a.c", "(?s)a.c", "(?m)^b$", r"\pL+", r"[^\d\s]+", "[]a]", "[^]a]", "a||b", "(|a)", "x*?", "(?U)x+",
    "(a", "a)", r"\Qa.b\E+", r"\x41", r"\101", r"\1", "[a-\\d]", "[z-a]", "*a", "(?i:k)s", "é+", "a&&b", "[a&&b]", "[[a]",
    "\\", "a{1001}", "^*", "$", "", "[a-]", "[-a]", r"[\-\]]", r"\Z", r"\p{Greek}", r"[\w.]+@[\w.]+", "(?i)[a-c]+x", "{",
    "a{", "}", r"[\^a]", "#x y", "(?i", "(?z)a", "(?-i)a", "(?i-)a", r"\pX", "[[:nope:]]", r"(?:a|b)*c", r"\Ba",
    r"(?i)\bs", r"(?i)\w+", r"(?i)[k]\b", "^*a", r"\A*b", "(?i)é", r"(?i)\x6b", "(?i)1", "(?s).{3}", r"a\b*",
]
TEXTS = [
    "timeout after 12ms", "ERROR\n", "abab", "a\nb", "b", "é x", "foo bar", "xfooy", "éfoo", "a.b.b", "A", "k", "K",
    "αβ", "a]", "&", "", "a\n", "x y #x y", "me@x.y", "a{", "{", "[a", "BAX", "bax", "aac", "\r\n", "ba", "ſs", "É", "ſ", "1k",
]


def test_regex_rewriter_agrees_with_re2(spark):
    con = duckdb.connect()
    compile_ = spark._jvm.java.util.regex.Pattern.compile
    for pattern in PATTERNS:
        try:
            want = [con.execute("select regexp_matches(?, ?)", [t, pattern]).fetchall()[0][0] for t in TEXTS]
        except duckdb.Error:
            want = None
        mine = to_jvm_regex(pattern)
        assert (mine is None) == (want is None), pattern
        if mine is not None:
            matcher = compile_(mine)
            assert [matcher.matcher(t).find() for t in TEXTS] == want, pattern


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab.*+?()[]{}|^$\\d1,-:é", max_size=8))
def test_regex_rewriter_accepts_what_re2_accepts(pattern):
    try:
        duckdb.execute("select regexp_matches('a', ?)", [pattern]).fetchall()
        legal = True
    except duckdb.Error:
        legal = False
    assert (to_jvm_regex(pattern) is not None) == legal


def test_regex_column_form(spark):
    frame = spark.createDataFrame([("a+",), ("[",), (None,)], "p string")
    assert [r.v for r in frame.select(jvm_regex(F.col("p")).alias("v")).collect()] == ["a+", None, None]


@pytest.mark.parametrize(
    ("kind", "pattern", "message", "hit"),
    [
        ("exact", "disk full", "disk full", True),
        ("exact", "disk", "disk full", False),
        ("contains", "nearly", "disk nearly full", True),
        ("contains", "", "anything", True),
        ("contains", "%", "100", False),
        ("regex", r"timeout after \d+ms", "timeout after 120ms", True),
        ("regex", "[", "[", False),
        ("unknown", "disk", "disk", False),
        ("contains", "x", None, False),
    ],
)
def test_message_match(spark, kind, pattern, message, hit):
    regex = F.lit(to_jvm_regex(pattern) if kind == "regex" else None).cast("string")
    column = message_matches(F.lit(message).cast("string"), F.lit(kind), F.lit(pattern), regex)
    assert one(spark, column) is hit


PAYLOAD = '{"service": "checkout-api", "durationMs": 480.0, "attempt": 2, "none": null, "flag": true, "list": [1], "db.host": "h"}'


@pytest.mark.parametrize(
    ("field", "operator", "value", "holds"),
    [
        ("service", "equals", '"checkout-api"', True),
        ("service", "contains", '"checkout"', True),
        ("durationMs", "greater_than", "400", True),
        ("durationMs", "less_than", "500", True),
        ("durationMs", "greater_than_equal", "480", True),
        ("attempt", "less_than_equal", "2.0", True),
        ("durationMs", "greater_than", "500", False),
        ("missing", "equals", '"x"', False),
        ("service", "greater_than", "1", False),
        ("attempt", "eq", "2", False),
        ("attempt", "equals", "2.0", True),
        ("attempt", "equals", '"2"', False),
        ("none", "equals", "null", True),
        ("missing", "equals", "null", False),
        ("flag", "equals", "true", True),
        ("flag", "equals", '"true"', False),
        ("list", "equals", "[1]", False),
        ("db.host", "equals", '"h"', True),
        ("attempt", "contains", '"2"', False),
        ("none", "equals", None, True),
    ],
)
def test_payload_conditions(spark, field, operator, value, holds):
    row = spark.createDataFrame(
        [(PAYLOAD, [(field, operator, value)])], "payload string, c array<struct<field:string,operator:string,value:string>>"
    )
    typed = row.withColumn("c", typed_conditions("c"))
    assert typed.select(typed_conditions_hold("payload", "c").alias("v")).first()["v"] is holds


def test_no_conditions_hold_even_without_payload(spark):
    row = spark.createDataFrame([(None, [])], "payload string, c array<struct<field:string,operator:string,value:string>>")
    typed = row.withColumn("c", typed_conditions("c"))
    assert typed.select(typed_conditions_hold("payload", "c").alias("v")).first()["v"] is True


def test_condition_objects(spark):
    assert one(spark, condition_error(F.lit('{"field":"a","operator":"equals","value":1}'))) is None
    assert "unknown field" in one(spark, condition_error(F.lit('{"path":"a","operator":"equals"}')))


def test_redaction_and_keys(spark):
    text = '{"a":1,"b":"x","c":null}'
    assert one(spark, redact_payload(F.lit(text), F.col("k")), k=["a", "c"]) == '{"a":1,"c":null}'
    assert one(spark, redact_payload(F.lit(text), F.col("k")), k=[]) == text
    assert one(spark, redact_payload(F.lit(None).cast("string"), F.col("k")), k=["a"]) is None
    assert one(spark, normalize_keys(F.col("k")), k=["requestId", " traceId ", "requestId", " \t"]) == ["requestId", "traceId"]
    assert one(spark, keys_error(F.col("k")), k=[" ", ""]) == "payloads must contain at least one key"


@pytest.mark.parametrize(
    ("given_", "name", "error"),
    [
        (" PROD ", "production", None),
        ("stage", "staging", None),
        ("\tDev\n", "development", None),
        (" staging　", "staging", None),
        ("qa", "qa", "invalid environment: qa"),
        (None, "", "invalid environment: "),
    ],
)
def test_environment(spark, given_, name, error):
    column = F.lit(given_).cast("string")
    assert one(spark, tx.normalize_environment(column)) == name
    assert one(spark, tx.environment_error(column)) == error


@pytest.mark.parametrize(
    ("text", "micros"),
    [
        ("2024-01-01T00:00:00Z", 1_704_067_200_000_000),
        ("2024-01-01T00:00:00.1234569Z", 1_704_067_200_123_456),
        ("2024-01-01T05:30:00+05:30", 1_704_067_200_000_000),
        ("2024-01-01T0:00:00,5Z", 1_704_067_200_500_000),
        ("2024-01-02T00:30:00+24:30", 1_704_067_200_000_000),
        ("2024-02-30T00:00:00Z", None),
        ("2024-01-01 00:00:00Z", None),
        ("2024-01-01T00:00:00", None),
        ("2024-01-01T00:00:00Z\n", None),
        ("2024-01-01T24:00:00Z", None),
        ("2024-01-01T00:00:60Z", None),
        ("2024", None),
        ("not-a-time", None),
    ],
)
def test_rfc3339(spark, text, micros):
    assert one(spark, F.unix_micros(tx.parse_rfc3339(F.lit(text)))) == micros


def test_confidence_and_lists(spark):
    def rounded(n, source):
        values = one(spark, an.confidence_scores(F.lit(n), F.lit(source)))
        return values and [round(v, 2) for v in values]

    assert rounded(8, "rule-based") == [0.83, 0.76, 0.69, 0.62, 0.55, 0.48, 0.41, 0.4]
    assert rounded(2, "hybrid") == [0.62, 0.55]
    assert rounded(0, "hybrid") is None
    assert one(spark, an.dedupe_strings(F.col("v")), v=["a", "b", "a", "c", "b"]) == ["a", "b", "c"]
    assert one(spark, an.dedupe_strings(F.col("v")), v=[]) is None
    assert one(spark, an.union_signal_ids(F.col("a"), F.col("b")), a=["x", "x"], b=["y", "x", "y"]) == ["x", "x", "y"]
    assert one(spark, an.append_recommendations(F.col("a"), F.col("b")), a=["x"], b=["x"]) == ["x", "x"]
    assert one(spark, an.retention_profile(F.lit("prod")))["raw_days"] == 30
    assert one(spark, an.retention_profile(F.lit(" Stage")))["incident_days"] == 90
    assert one(spark, an.retention_profile(F.lit(None).cast("string")))["raw_days"] == 7


def test_every_script_compiles_and_nested_counts_are_bounded(spark):
    from pulseloom.functions.regex import SCRIPTS, to_jvm_regex

    found = spark.range(1).select(*[F.col("id").cast("string").rlike(to_jvm_regex(rf"\p{{{script}}}")).alias(script) for script in SCRIPTS])
    assert [script for script, hit in found.first().asDict().items() if hit] == ["Common"]
    assert spark.range(1).filter(F.lit("\u03e2").rlike(to_jvm_regex(r"\p{Coptic}"))).count() == 1
    assert to_jvm_regex("(a{1000}){1000}") is None and to_jvm_regex("((a{10})+b){100}") is not None


def test_conditions_on_a_payload_decoded_once(spark):
    from pulseloom.functions import payload as pl

    payloads = ['{"k":42,"s":"a7","t":"7","b":true,"n":null,"l":[1],"k":1,"d":2.0}', "{}", "oops", None]
    values = ["42", "2", '"a7"', '"7"', '"a"', "true", "null", "[1]", "7"]
    operators = ["equals", "contains", "greater_than", "less_than_equal", "eq"]
    tests = [(f, o, v) for f in "kstbnldz" for o in operators for v in values]
    rows = spark.createDataFrame([(p, [t]) for p in payloads for t in [*tests]], "payload string, c array<struct<field:string,operator:string,value:string>>")
    typed = rows.select("payload", pl.typed_conditions("c").alias("c")).withColumn("typed", pl.typed_payload("payload"))
    both = typed.select(pl.typed_conditions_hold("payload", "c").alias("a"), pl.typed_payload_holds("typed", "c").alias("b"))
    assert both.where("not (a <=> b)").isEmpty() and both.where("a").count() > 10
    from pulseloom import catalog

    plan = catalog.queries()["payload_conditions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 or plan.count("jsontostructs") == 1
