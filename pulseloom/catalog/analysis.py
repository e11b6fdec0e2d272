"""Rule matching, analysis and suggestion queries."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from pulseloom.catalog.base import (
    ANALYSIS_CTES,
    ANALYZED,
    AS_OF_US,
    CANDIDATES,
    FALLBACK_ADVICE,
    HOUR,
    MINUTE,
    RULES,
    SCORES,
    SIGNALS,
    as_of,
    joined,
    query,
    scores,
    sessions_sql,
    sql_mask,
    sql_text,
)
from pulseloom.functions import analysis as an
from pulseloom.functions.payload import condition_error, typed_conditions, typed_payload, typed_payload_holds
from pulseloom.functions.regex import to_jvm_regex
from pulseloom.functions.text import sanitize_message
from pulseloom.operators import rules as ru
from pulseloom.operators import suggest as su
from pulseloom.operators.incidents import create_incidents, session_incident_id
from pulseloom.operators.sessions import add_position, session_members, session_summary
from pulseloom.plans.correlate import suggested_analysis as ask_for_analysis
from pulseloom.session import checkpointed
from pulseloom.sources.tables import sample_patterns, sample_rules, signals, table

KEYS = ("source", "env", "session_start")


def tables_of(spark):
    return sample_rules(spark), sample_patterns(spark)


def evidence(spark, sf_dir, window_us=HOUR):
    rules, patterns = tables_of(spark)
    return ru.session_evidence(signals(spark, sf_dir), ru.active_patterns(rules, patterns), window_us)


def analyzed(spark, sf_dir, window_us=HOUR, **options):
    rules, patterns = tables_of(spark)
    return ru.analyze_sessions(signals(spark, sf_dir), rules, patterns, window_us, **options)


def verdicts(spark, sf_dir):
    rules, patterns = tables_of(spark)
    return ru.rule_verdicts(ru.candidate_rules(evidence(spark, sf_dir), rules, patterns))


@query(
    "flagship_incidents",
    f"""with {ANALYSIS_CTES}
    select sha256(source || '|' || env || '|' || session_start || '|{AS_OF_US}') as id, source, env, session_start, session_end,
      max_severity as severity, analysis_summary, recommendations, analysis_source, {SCORES} as confidence
    from analyzed where max_severity >= 4""",
)
def flagship_incidents(spark, sf_dir):
    rows = analyzed(spark, sf_dir, high_only=True)
    return rows.select(
        session_incident_id(as_of()).alias("id"),
        *KEYS,
        "session_end",
        F.col("max_severity").alias("severity"),
        "analysis_summary",
        joined("recommendations").alias("recommendations"),
        "analysis_source",
        scores("confidence").alias("confidence"),
    )


@query(
    "analyze_incidents",
    f"""with {SIGNALS}, {sessions_sql(10 * MINUTE)}, {RULES}, {CANDIDATES}, {ANALYZED}
    select source, env, session_start, session_end, max_severity, analysis_summary, recommendations, analysis_source,
      {SCORES} as confidence from analyzed""",
)
def analyze_incidents(spark, sf_dir):
    return analyzed(spark, sf_dir, 10 * MINUTE).select(
        *KEYS, "session_end", "max_severity", "analysis_summary", joined("recommendations").alias("recommendations"),
        "analysis_source", scores("confidence").alias("confidence"),
    )


# A second rule set: ties in priority, repeated texts, a disabled rule, a refused
# regex, an unknown match type and a source no signal has.
_MORE_RULES = [
    ("a1", 70, "single", "Shared cause", "One|Two|One"),
    ("a2", 70, "correlation", "Shared cause", "Two|Three"),
    ("a3", 10, "ALL", "Rare cause", "Four"),
    ("a4", 99, "single", "Never: refused regex", "Five"),
    ("a5", 99, "single", "Never: unknown match type", "Six"),
    ("a6", 99, "single", "Never: absent source", "Seven"),
]
_MORE_PATTERNS = [
    ("b1", "a1", "log", "svc-2", "development", "contains", "", None, None),
    ("b2", "a2", "health", "svc-2", "development", "regex", "^(timeout|too)", None, None),
    ("b3", "a2", "log", "svc-2", "development", "regex", "connections$|ms$", "k", "10"),
    ("b4", "a3", "queue", "svc-3", "staging", "exact", "", None, None),
    ("b5", "a4", "log", "svc-2", "development", "regex", "[", None, None),
    ("b6", "a5", "log", "svc-2", "development", "prefix", "time", None, None),
    ("b7", "a6", "log", "svc-77", "development", "contains", "time", None, None),
]
_MORE_CTES = f"""{SIGNALS}, {sessions_sql(HOUR)},
rules(rule_id, priority, match_type, hypothesis, advice) as (values {', '.join("('" + "', '".join(str(v) for v in r) + "')" for r in _MORE_RULES)}),
patterns(pattern_id, rule_id, event_type, source, env, match_type, pattern, field, bound) as (values {', '.join(
    "(" + ", ".join('null' if v is None else sql_text(v if (r[0], v) != ('b5', '[') else '$a') for v in r) + ")" for r in _MORE_PATTERNS)}),
{CANDIDATES}"""


@query(
    "analyze_more_rules",
    f"""with {_MORE_CTES},
    first_seen as (select source, env, session_start, hypothesis, min(o) as o from (
        select *, row_number() over (partition by source, env, session_start order by cast(priority as integer) desc, rule_id) as o
        from judged where matched) group by 1, 2, 3, 4),
    summary as (select source, env, session_start, string_agg(hypothesis, '; ' order by o) as analysis_summary
      from first_seen group by 1, 2, 3),
    counts as (select source, env, session_start, count(*) as n from judged where matched group by 1, 2, 3)
    select s.source, s.env, s.session_start, coalesce(f.analysis_summary, '{an.FALLBACK_HYPOTHESIS}') as analysis_summary,
      cast(coalesce(c.n, 1) as integer) as scores
    from sessions s left join summary f using (source, env, session_start) left join counts c using (source, env, session_start)""",
)
def analyze_more_rules(spark, sf_dir):
    rules, patterns = sample_rules(spark, _MORE_RULES), sample_patterns(spark, _MORE_PATTERNS)
    rows = ru.analyze_sessions(signals(spark, sf_dir), rules, patterns, HOUR)
    return rows.select(*KEYS, "analysis_summary", F.size("confidence").alias("scores"))


# -- single steps -----------------------------------------------------------


@query(
    "enabled_rules",
    """select p_partkey as id, p_name as name from part where p_size > 10""",
)
def enabled_rules(spark, sf_dir):
    rules = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") > 10).alias("enabled")
    )
    return ru.enabled_rules(rules).drop("enabled")


# Patterns tried on every document and event message.
_TEXT_TESTS = [
    # output column, match type, pattern
    ("exact_hit", "exact", "retry succeeded"),
    ("contains_hit", "contains", "an"),
    ("contains_empty", "contains", ""),
    ("contains_percent", "contains", "%"),
    ("regex_word", "regex", r"(?i)\bthe\b"),
    ("regex_end", "regex", r"[a-z]\.$"),
    ("regex_dot", "regex", r"\n.\n"),
    ("regex_digits", "regex", r"\d{3}-\d{4}"),
    ("regex_unicode", "regex", r"\p{Lu}\p{Ll}+é"),
    ("regex_posix", "regex", r"^[[:alpha:]]+ [[:^alpha:]]"),
    ("regex_named", "regex", r"(?P<user>[a-z]+)@(?P<host>[a-z.]+)"),
]


@query(
    "message_match",
    "select doc_id, "
    + ", ".join(
        {
            "exact": f"text = {sql_text(p)}",
            "contains": f"contains(text, {sql_text(p)})",
            "regex": f"regexp_matches(text, {sql_text(p)})",
        }[kind]
        + f" as {name}"
        for name, kind, p in _TEXT_TESTS
    )
    + ", false as refused_regex, false as unknown_type from documents",
)
def message_match(spark, sf_dir):
    text = F.col("text")

    def hit(kind: str, pattern: str):
        regex = to_jvm_regex(pattern) if kind == "regex" else None
        return ru.message_matches(text, F.lit(kind), F.lit(pattern), F.lit(regex).cast("string"))

    columns = [hit(kind, pattern).alias(name) for name, kind, pattern in _TEXT_TESTS]
    columns += [hit("regex", "[").alias("refused_regex"), hit("prefix", "a").alias("unknown_type")]
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


_RICH_SPARK = """concat('{"k":', get_json_object(props, '$.k'), ',"half":', get_json_object(props, '$.k'), '.5,"svc":"s', user_id % 5,
  '","num_text":"', get_json_object(props, '$.k'), '","ok":', case when event_id % 2 = 0 then 'true' else 'false' end,
  ',"none":null,"db.host":"h', event_id % 10, '","list":[1],"obj":{"a":1}', case when event_id % 3 = 0 then ',"extra":2.0' else '' end, '}')"""
_K = "cast(json_extract_string(props, '$.k') as bigint)"
_CONDITION_TESTS = [
    # output column, field, operator, JSON value, SQL for the expected truth
    ("eq_number", "k", "equals", "42", f"{_K} = 42"),
    ("eq_number_spelled", "extra", "equals", "2", "event_id % 3 = 0"),
    ("eq_text", "svc", "equals", '"s3"', "user_id % 5 = 3"),
    ("eq_text_number", "num_text", "equals", "42", "false"),
    ("eq_bool", "ok", "equals", "true", "event_id % 2 = 0"),
    ("eq_null", "none", "equals", "null", "true"),
    ("eq_null_absent", "absent", "equals", "null", "false"),
    ("eq_list", "list", "equals", "[1]", "false"),
    ("eq_object", "obj", "equals", '{"a":1}', "false"),
    ("dotted_key", "db.host", "equals", '"h7"', "event_id % 10 = 7"),
    ("has_text", "svc", "contains", '"4"', "user_id % 5 = 4"),
    ("has_number", "k", "contains", '"4"', "false"),
    ("gt", "k", "greater_than", "50.5", f"{_K} > 50.5"),
    ("ge", "half", "greater_than_equal", "50.5", f"{_K} + 0.5 >= 50.5"),
    ("lt", "k", "less_than", "10", f"{_K} < 10"),
    ("le", "k", "less_than_equal", "10", f"{_K} <= 10"),
    ("gt_text", "num_text", "greater_than", "1", "false"),
    ("unknown_operator", "k", "eq", "42", "false"),
]


@query(
    "payload_conditions",
    "select event_id, "
    + ", ".join(f"{sql} as {name}" for name, _, _, _, sql in _CONDITION_TESTS)
    + f", true as no_conditions, ({_K} > 20 and user_id % 5 = 3) as both_hold from events",
)
def payload_conditions(spark, sf_dir):
    def literal(*items):
        structs = [
            F.struct(F.lit(f).alias("field"), F.lit(o).alias("operator"), F.lit(v).alias("value")) for f, o, v in items
        ]
        return F.array(*structs).cast("array<struct<field:string,operator:string,value:string>>")

    tests = {name: literal((f, o, v)) for name, f, o, v, _ in _CONDITION_TESTS}
    tests["no_conditions"] = literal()
    tests["both_hold"] = literal(("k", "greater_than", "20"), ("svc", "equals", '"s3"'))
    # Conditions are decoded once, in a row of their own, and payloads once per row.
    one = spark.range(1).select(*[conditions.alias(f"c_{name}") for name, conditions in tests.items()])
    typed = checkpointed(one.select(*[typed_conditions(f"c_{name}").alias(f"c_{name}") for name in tests]))
    rich = table(spark, sf_dir, "events").selectExpr("event_id", f"{_RICH_SPARK} as payload")
    decoded = rich.select("event_id", typed_payload("payload").alias("typed"))
    return decoded.crossJoin(F.broadcast(typed)).select("event_id", *[typed_payload_holds("typed", f"c_{name}").alias(name) for name in tests])


@query(
    "parse_conditions",
    """select event_id, case when event_id % 4 = 0 then 'invalid payload condition: json: unknown field "path"'
      when event_id % 4 = 1 then 'invalid payload condition: not an object' end as error from events""",
)
def parse_conditions(spark, sf_dir):
    texts = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """case event_id % 4 when 0 then concat('{"path":"k","operator":"equals","value":', user_id, '}') when 1 then '7'
           when 2 then concat('{"field":"k","operator":"equals","value":', user_id, '}') else '{"field":"k"}' end as c""",
    )
    return texts.select("event_id", condition_error(F.col("c")).alias("error"))


@query(
    "candidate_rules",
    f"""with {ANALYSIS_CTES} select source, env, session_start, rule_id, pattern_ids, match_type, priority from judged""",
)
def candidate_rules(spark, sf_dir):
    rules, patterns = tables_of(spark)
    rows = ru.candidate_rules(evidence(spark, sf_dir), rules, patterns)
    return rows.select(*KEYS, "rule_id", F.array_join("pattern_ids", ",").alias("pattern_ids"), "match_type", "priority")


@query(
    "match_patterns",
    f"with {ANALYSIS_CTES} select source, env, session_start, pattern_id, hit from candidates",
)
def match_patterns(spark, sf_dir):
    rules, patterns = tables_of(spark)
    return ru.candidate_patterns(evidence(spark, sf_dir), ru.active_patterns(rules, patterns)).select(*KEYS, "pattern_id", "hit")


@query(
    "pattern_hits",
    f"""with {SIGNALS}, {RULES} select s.id, p.pattern_id from signals s join patterns p on p.source = s.source and p.env = s.env
      where case p.match_type when 'exact' then s.message = p.pattern when 'contains' then contains(s.message, p.pattern)
        else regexp_matches(s.message, p.pattern) end
        and (p.field is null or cast(json_extract(s.payload, '$.' || p.field) as double) > cast(p.bound as double))""",
)
def pattern_hits(spark, sf_dir):
    rules, patterns = tables_of(spark)
    hits = ru.pattern_hits(signals(spark, sf_dir), ru.active_patterns(rules, patterns))
    return hits.filter("pattern_id is not null").select("id", "pattern_id")


# As many patterns as there are parts, of every kind, some too short to be indexed.
_PART_PATTERNS = """select concat('q', p_partkey) as id, concat('svc-', p_partkey % 5) as source,
    case p_partkey % 3 when 0 then 'production' when 1 then 'staging' else 'development' end as environment,
    case p_partkey % 4 when 1 then 'exact' when 2 then 'regex' else 'contains' end as message_match_type,
    case when p_partkey % 40 = 3 then '' when p_partkey % 4 = 0 then concat('item ', p_partkey % 700)
      when p_partkey % 4 = 1 then concat('retry succeeded item ', p_partkey % 700)
      when p_partkey % 4 = 2 then concat('it[e]m [0-9]*', p_partkey % 10, ',? ?$') else concat('m ', p_partkey % 70) end as message_pattern"""


@query(
    "indexed_pattern_hits",
    f"""with {SIGNALS}, many as ({_PART_PATTERNS} from part),
    said as (select id, source, env, concat(message, ' item ', cast(substr(id, 5) as bigint) % 700) as message from signals)
    select s.id, p.id as pattern_id from said s join many p on p.source = s.source and p.environment = s.env
      where case p.message_match_type when 'exact' then s.message = p.message_pattern when 'contains' then contains(s.message, p.message_pattern)
        else regexp_matches(s.message, p.message_pattern) end""",
)
def indexed_pattern_hits(spark, sf_dir):
    """Every signal against thousands of patterns through the index of their required texts."""
    expressions = _PART_PATTERNS.removeprefix("select ")
    many = spark.sql(f"select {expressions} from {{parts}}", parts=table(spark, sf_dir, "part")).select(
        "*",
        F.when(F.col("message_match_type") == "regex", F.col("message_pattern")).alias("message_regex"),
        F.array().cast("array<struct<field:string,operator:string,value:string>>").alias("payload_conditions"),
        F.lit(0).alias("severity_min"),
    )
    said = signals(spark, sf_dir).withColumn("message", F.concat("message", F.lit(" item "), F.substring("id", 5, 20).cast("long") % 700))
    found = ru.indexed_pattern_hits(said, many, ru.literal_index(many))
    return found.where("pattern_id is not null").select("id", "pattern_id")


@query(
    "rule_any",
    f"with {ANALYSIS_CTES} select source, env, session_start, rule_id, any_hit as matched from judged where match_type = 'single'",
)
def rule_any(spark, sf_dir):
    return verdicts(spark, sf_dir).filter("match_type = 'single'").select(*KEYS, "rule_id", "matched")


@query(
    "rule_all",
    f"with {ANALYSIS_CTES} select source, env, session_start, rule_id, all_hit as matched from judged where match_type <> 'single'",
)
def rule_all(spark, sf_dir):
    return verdicts(spark, sf_dir).filter("match_type <> 'single'").select(*KEYS, "rule_id", "matched")


@query(
    "nest_rules",
    f"""with {ANALYSIS_CTES} select source, env, session_start, rule_id, pattern_count, pattern_ids from judged""",
)
def nest_rules(spark, sf_dir):
    rules, patterns = tables_of(spark)
    return ru.candidate_rules(evidence(spark, sf_dir), rules, patterns).select(
        *KEYS, "rule_id", F.size("pattern_ids").cast("bigint").alias("pattern_count"),
        F.array_join("pattern_ids", ",").alias("pattern_ids"),
    )


@query(
    "hypotheses",
    f"""with {ANALYSIS_CTES} select source, env, session_start, summary as hypotheses from folded""",
)
def hypotheses(spark, sf_dir):
    folded = ru.fold_verdicts(verdicts(spark, sf_dir)).filter(F.size("hypotheses") > 0)
    return folded.select(*KEYS, an.analysis_summary(an.dedupe_strings(F.col("hypotheses"))).alias("hypotheses"))


@query(
    "recommendations",
    f"""with {ANALYSIS_CTES} select source, env, session_start, advice as recommendations from advice_text""",
)
def recommendations(spark, sf_dir):
    folded = ru.fold_verdicts(verdicts(spark, sf_dir)).filter(F.size("hypotheses") > 0)
    return folded.select(*KEYS, joined(an.dedupe_strings(F.col("advice"))).alias("recommendations"))


@query(
    "attach_fallback",
    f"""with {ANALYSIS_CTES} select source, env, session_start, recommendations, {SCORES} as confidence
      from analyzed where analysis_source = 'hybrid'""",
)
def attach_fallback(spark, sf_dir):
    rows = analyzed(spark, sf_dir).filter("analysis_source = 'hybrid'")
    return rows.select(*KEYS, joined("recommendations").alias("recommendations"), scores("confidence").alias("confidence"))


@query(
    "rule_order",
    """select p_partkey, p_brand, row_number() over (partition by p_brand order by p_size desc, p_retailprice desc, p_partkey) - 1
      as position from part""",
)
def rule_order(spark, sf_dir):
    """Parts as rules: size is the priority, the price (in cents) the creation time."""
    created = F.timestamp_micros(F.round(F.col("p_retailprice") * 100).cast("long"))
    key = ru.rule_order(
        F.col("p_size"), created, F.timestamp_micros(F.lit(0)), F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", key.alias("key"))
    return add_position(rows, ["p_brand"], ["key"]).select("p_partkey", "p_brand", "position")


@query(
    "confidence_scores",
    f"""with {SIGNALS}, {sessions_sql(HOUR)},
    counted as (select source, env, session_start, signal_count % 9 as n,
      case when max_severity >= 3 then 'rule-based' else 'hybrid' end as analysis_source from sessions)
    select source, env, session_start, case when n > 0 then {SCORES} end as confidence from counted""",
)
def confidence_scores(spark, sf_dir):
    rows = session_summary(signals(spark, sf_dir), HOUR)
    source = F.when(F.col("max_severity") >= 3, F.lit(an.RULE_BASED)).otherwise(F.lit(an.HYBRID))
    counted = rows.withColumn("c", an.confidence_scores(F.col("signal_count") % 9, source))
    return counted.select(*KEYS, scores("c").alias("confidence"))


@query(
    "dedupe_strings",
    """with w as (select doc_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as i from documents),
    f as (select doc_id, w, min(i) as i from w group by 1, 2)
    select doc_id, string_agg(w, ' ' order by i) as words from f group by doc_id""",
)
def dedupe_strings(spark, sf_dir):
    words = an.dedupe_strings(F.split("text", " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, " ").alias("words"))


# -- prompts and answers ----------------------------------------------------

_PAGE = 3


@query(
    "build_prompt",
    f"""with {ANALYSIS_CTES},
    inc as (select *, sha256(source || '|' || env || '|' || session_start || '|{AS_OF_US}') as id from analyzed where max_severity >= 4),
    lines as (
      select i.id, m.ts_us, m.id as signal_id, row_number() over (partition by i.id order by m.ts_us, m.id) as n,
        m.event_type, m.source, m.env, m.severity, {sql_mask('m.message')} as message
      from inc i join members m using (source, env, session_start)),
    texts as (select id, n - 1 as position, '- #' || n || ' id=' || signal_id || ' eventType=' || event_type || ' source=' || source
        || ' env=' || env || ' severity=' || severity || ' timestamp=' || strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%SZ')
        || ' message=' || message as line from lines),
    counts as (select id, count(*) as n from texts group by 1),
    pages as (select id, cast(floor(position / {_PAGE}) as bigint) as page, string_agg(line, chr(10) order by position) as body
      from texts group by 1, 2)
    select i.id, cast(0 as bigint) as part, 'Incident:' || chr(10) || '- id: ' || i.id || chr(10) || '- title: Auto-generated incident'
        || chr(10) || '- status: in-progress' || chr(10) || '- severity: ' || max_severity || chr(10) || '- impactedServices: ' || source
        || chr(10) || '- environments: ' || env || chr(10) || '- existingAnalysisSummary: ' || chr(10)
        || '- existingRecommendations: none' || chr(10) || chr(10) || 'Evidence (' || c.n || '):' || chr(10) as text
      from inc i join counts c using (id)
    union all
    select id, page + 1, case when page > 0 then chr(10) else '' end
        || case when (page + 1) * {_PAGE} >= c.n then rtrim(body, ' ' || chr(10)) else body end
      from pages join counts c using (id)""",
)
def build_prompt(spark, sf_dir):
    rows = checkpointed(analyzed(spark, sf_dir, high_only=True))
    incidents = create_incidents(rows, as_of()).withColumns(
        {
            "status": F.lit("in-progress"),
            "analysis_summary": F.lit(""),
            "recommendations": F.array().cast("array<string>"),
        }
    )
    owners = rows.select(*KEYS, session_incident_id(as_of()).alias("incident_id"))
    members = session_members(signals(spark, sf_dir), HOUR).join(owners, list(KEYS)).select(
        "incident_id", F.col("id").alias("signal_id"), "event_type", "source", "env", "severity", "timestamp",
        sanitize_message(F.col("message")).alias("message"),
    )
    return su.prompt_parts(incidents, members, _PAGE).select("id", "part", "text")


_ANSWER_SPARK = """case (conv_id + turn) % 9
  when 0 then concat('```json\n', to_json(named_struct('hypothesisTemplate', text, 'recommendations', array('  do it ', '', text))), '\n```')
  when 1 then to_json(named_struct('hypothesisTemplate', concat(' ', text, ' '), 'recommendations', array('a', ' ')))
  when 2 then 'not-json' when 3 then '' when 4 then null
  when 5 then '{"hypothesisTemplate":"  ","recommendations":["step"]}'
  when 6 then to_json(named_struct('hypothesisTemplate', text, 'recommendations', array('', '  ')))
  when 7 then concat('```', to_json(named_struct('hypothesisTemplate', 'h', 'recommendations', array(role))), '```')
  else concat('  ', to_json(named_struct('hypothesisTemplate', 'h')), '  ') end"""
_TRIM = "' ' || chr(9) || chr(10) || chr(13)"


@query(
    "parse_suggestion",
    f"""with c as (select conv_id, turn, (conv_id + turn) % 9 as k, role, text from conversations)
    select conv_id, turn,
      case when k in (0, 1) then trim(text, {_TRIM}) when k = 7 then 'h' end as hypothesis,
      case k when 0 then 'do it|' || trim(text, {_TRIM}) when 1 then 'a' when 7 then role end as recommendations,
      case k when 2 then '{su.BAD_JSON}' when 3 then '{su.EMPTY_RESPONSE}' when 4 then '{su.NO_RESPONSE}'
        when 5 then '{su.NO_HYPOTHESIS}' when 6 then '{su.NO_RECOMMENDATIONS}' when 8 then '{su.NO_RECOMMENDATIONS}' end as error
    from c""",
)
def parse_suggestion(spark, sf_dir):
    answers = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_ANSWER_SPARK} as answer")
    parsed = answers.withColumn("p", su.parse_suggestion(F.col("answer")))
    return parsed.select(
        "conv_id", "turn", F.col("p.hypothesis").alias("hypothesis"), joined("p.recommendations").alias("recommendations"),
        F.col("p.error").alias("error"),
    )


_ERROR = """case event_id % 5 when 0 then concat('status 429 for user ', user_id) when 1 then 'code: insufficient_quota (429)'
  when 2 then 'HTTP 401' when 3 then 'connection reset' else null end"""


@query(
    "classify_provider_error",
    f"""select event_id, case event_id % 5 when 0 then {sql_text(su.PROVIDER_ERRORS[1][1])} when 1 then {sql_text(su.PROVIDER_ERRORS[0][1])}
      when 2 then {sql_text(su.PROVIDER_ERRORS[2][1])} when 3 then 'connection reset' end as error from events""",
)
def classify_provider_error(spark, sf_dir):
    texts = table(spark, sf_dir, "events").selectExpr("event_id", f"{_ERROR} as message")
    return texts.select("event_id", su.classify_provider_error(F.col("message")).alias("error"))


def told_by_evidence(prompts):
    """A suggester that answers from the whole prompt: how many lines, the first and the last id."""
    answers = []
    for prompt in prompts:
        ids = re.findall(r"^- #\d+ id=(\S+) ", prompt, re.M)
        first, last = (ids[0], ids[-1]) if ids else (None, None)
        answers.append((json.dumps({"hypothesisTemplate": f"saw {len(ids)} signals", "recommendations": [f"first {first}", f"last {last}"]}), None))
    return answers


_SUGGESTED = f"""with {ANALYSIS_CTES},
    told as (select source, env, session_start, count(*) as lines, array_agg(id order by ts_us, id) as ids from members group by 1, 2, 3)
    select source, env, session_start, case when analysis_source = 'hybrid' then 'saw ' || lines || ' signals' end as hypotheses,
      case when analysis_source = 'hybrid' then 'first ' || ids[1] || '|last ' || ids[-1] end as recommendations
    from analyzed join told using (source, env, session_start)"""


def _suggested(spark, sf_dir, suggester, **options):
    rules, patterns = tables_of(spark)
    rows = ask_for_analysis(suggester, as_of(), page_rows=_PAGE, **options)(signals(spark, sf_dir), rules, patterns, HOUR)
    told = F.col("analysis_source") == an.HYBRID
    return rows.select(*KEYS, F.when(told, joined("hypotheses")).alias("hypotheses"), F.when(told, joined("recommendations")).alias("recommendations"))


@query("suggested_analysis", _SUGGESTED)
def suggested_analysis(spark, sf_dir):
    """Every session; those without a rule match show what the suggester made of their whole prompt of many pages."""
    return _suggested(spark, sf_dir, told_by_evidence)


def told_by_pages(_, pages):
    """The answer of told_by_evidence, from one page after the other."""
    lines, first, last = 0, None, None
    for page in pages:
        for found in re.finditer(r"^- #\d+ id=(\S+) ", page, re.M):
            lines, first, last = lines + 1, first or found[1], found[1]
    return json.dumps({"hypothesisTemplate": f"saw {lines} signals", "recommendations": [f"first {first}", f"last {last}"]}), None


@query("suggested_analysis_pages", _SUGGESTED)
def suggested_analysis_pages(spark, sf_dir):
    """As suggested_analysis, but the suggester reads each prompt as a stream of pages."""
    return _suggested(spark, sf_dir, told_by_pages, ask=su.ask_by_pages)


@query(
    "fallback_analysis",
    f"""with {ANALYSIS_CTES} select source, env, session_start, '{an.FALLBACK_HYPOTHESIS}' as hypotheses,
      '{FALLBACK_ADVICE}|no provider' as recommendations from analyzed where analysis_source = 'hybrid'""",
)
def fallback_analysis(spark, sf_dir):
    """Every unmatched session through the suggester hook, with a provider that always fails."""
    rows = analyzed(spark, sf_dir).filter("analysis_source = 'hybrid'").withColumn("id", F.concat_ws("|", *KEYS))
    asked = su.ask_suggester(rows.select("id", F.lit(0).alias("part"), F.col("id").alias("text")), lambda texts: [(None, "no provider") for _ in texts])
    answered = su.attach_suggestions(rows, asked)
    return rows.select("id", *KEYS).join(answered, "id").select(
        *KEYS, joined("hypotheses").alias("hypotheses"), joined("recommendations").alias("recommendations")
    )
