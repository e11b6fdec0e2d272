"""Rule, pattern and allow-list table queries.

Rule requests come from ``part``, pattern requests from ``customer`` and
allow-list requests from ``customer`` and ``supplier``: whole tables, with the
bad values that requests have.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom.catalog.base import AS_OF_US, as_of, joined, query, sql_environment
from pulseloom.operators import rule_tables as rt
from pulseloom.sources.tables import table

# -- rules ------------------------------------------------------------------

# Requests with blank, missing and out-of-range values. Texts repeat, so that
# many requests share a natural key.
_RULE_FIELDS = [
    "case when p_partkey % 4 = 0 then '' else concat(' rule-', p_partkey, ' ') end as id",
    "case when p_partkey % 41 = 0 then '  ' else concat(' ', p_name) end as name",
    "p_type as description",
    "case when p_partkey % 43 = 0 then 1.5e0 when p_partkey % 3 = 0 then null else (p_size % 2) / 2.0e0 end "
    "as confidence",
    "case when p_size % 7 = 0 then null when p_size % 7 = 1 then 500 when p_size % 7 = 2 then -1 else p_size "
    "% 4 end as priority",
    "case when p_size % 5 = 0 then null else p_size % 5 > 1 end as enabled",
    "case when p_partkey % 37 = 0 then 'ALL' when p_size % 3 = 0 then ' SINGLE ' when p_size % 3 = 1 then "
    "'Correlation' else 'single' end as match_type",
    "case when p_partkey % 53 = 0 then '' else concat(p_type, ' ') end as hypothesis_template",
    "case when p_partkey % 47 = 0 then 0 when p_size % 2 = 0 then null else 1 end as version",
]

_RULES_SQL = f"""requests as (
  select p_partkey as pos, {', '.join(_RULE_FIELDS)}, p_name || '|' || p_type as advice, p_size from part),
validated as (
  select pos, p_size,
    case when trim(name) = '' then 'name is required' when trim(hypothesis_template) = '' then 'hypothesisTemplate is required'
      when lower(trim(match_type)) not in ('single', 'correlation') then 'The matchType value must be either SINGLE or CORRELATION.'
      when version < 1 then 'The version must be at least 1'
      when coalesce(confidence, 0) not between 0 and 1 then 'The confidence value must be between 0 and 1' end as error,
    trim(id) as id, trim(name) as name, description, cast(coalesce(confidence, 0) as double) as confidence,
    cast(case when priority between 0 and 100 then priority else 100 end as integer) as priority, coalesce(enabled, true) as enabled,
    lower(trim(match_type)) as match_type, trim(hypothesis_template) as hypothesis_template, advice,
    cast(coalesce(version, 1) as integer) as version
  from requests)"""
_RULE_KEY = "name, description, confidence, priority, enabled, match_type, hypothesis_template, advice, version"
# Stored: the valid rules of the smaller parts, one per natural key.
_STORED_RULES_SQL = f"""{_RULES_SQL},
valid as (select * from validated where error is null),
stored as (select 'old-' || lpad(cast(min(pos) as varchar), 12, '0') as id, {_RULE_KEY} from valid where p_size <= 25 group by all)"""


def rule_requests(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    fields = part.selectExpr(
        "p_partkey as pos", *_RULE_FIELDS, "array(p_name, p_type) as recommendations", "p_size"
    )
    return fields.withColumns({"priority": F.col("priority").cast("int"), "version": F.col("version").cast("int")})


def valid_rules(spark, sf_dir):
    return rt.validate_rules(rule_requests(spark, sf_dir)).filter("error is null").drop("error")


def stored_rules(spark, sf_dir):
    return (
        valid_rules(spark, sf_dir)
        .filter("p_size <= 25")
        .groupBy(*rt.RULE_KEY)
        .agg(F.min("pos").alias("pos"))
        .select(
            F.concat(F.lit("old-"), F.lpad(F.col("pos").cast("string"), 12, "0")).alias("id"),
            *rt.RULE_KEY,
            F.timestamp_micros(F.lit(0)).alias("created_at"),
            F.timestamp_micros(F.lit(0)).alias("updated_at"),
        )
    )


@query(
    "validate_rules",
    f"""with {_RULES_SQL} select pos, error, id, name, description, confidence, priority, enabled, match_type, hypothesis_template,
      advice as recommendations, version from validated""",
)
def validate_rules(spark, sf_dir):
    rows = rt.validate_rules(rule_requests(spark, sf_dir)).drop("p_size")
    return rows.withColumn("recommendations", joined("recommendations"))


@query(
    "find_existing_rule",
    f"""with {_STORED_RULES_SQL} select v.pos, s.id as existing_id from valid v left join stored s using ({_RULE_KEY})""",
)
def find_existing_rule(spark, sf_dir):
    return rt.find_existing(stored_rules(spark, sf_dir), valid_rules(spark, sf_dir), rt.RULE_KEY).select("pos", "existing_id")


# Ids of new rules whose request had none are hashes; the SQL names them by
# their key, so the check compares them as one text.
@query(
    "insert_rules_if_absent",
    f"""with {_STORED_RULES_SQL},
    found as (select v.*, s.id as existing_id, min(pos) over (partition by {', '.join('v.' + c.strip() for c in _RULE_KEY.split(','))}) as first_pos
      from valid v left join stored s using ({_RULE_KEY})),
    firsts as (select pos as first_pos, id as first_id from valid)
    select f.pos, coalesce(f.existing_id, case when r.first_id = '' then 'hash' else r.first_id end) as id,
      f.existing_id is null and f.pos = f.first_pos as created
    from found f join firsts r using (first_pos)""",
)
def insert_rules_if_absent(spark, sf_dir):
    answers, _ = rt.insert_rules_if_absent(stored_rules(spark, sf_dir), valid_rules(spark, sf_dir).drop("p_size"))
    shown = F.when(F.length("id") == 64, F.lit("hash")).otherwise(F.col("id"))
    return answers.select("pos", shown.alias("id"), "created")


_UPDATES_SQL = "updates as (select 'old-' || lpad(cast(p_partkey as varchar), 12, '0') as id, p_brand from part where p_retailprice < 1000)"


def rule_updates(spark, sf_dir):
    """Cheap parts rename the rule of their number; many name a rule that is not stored."""
    return table(spark, sf_dir, "part").filter("p_retailprice < 1000").select(
        F.concat(F.lit("old-"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("id"),
        F.col("p_brand").alias("name"),
        F.lit("updated").alias("description"),
        F.lit(0.25).alias("confidence"),
        F.lit(7).alias("priority"),
        F.lit(False).alias("enabled"),
        F.lit("single").alias("match_type"),
        F.col("p_brand").alias("hypothesis_template"),
        F.array("p_brand").alias("recommendations"),
        F.lit(2).alias("version"),
    )


@query(
    "update_rules",
    f"""with {_STORED_RULES_SQL}, {_UPDATES_SQL} select s.id, coalesce(u.p_brand, s.name) as name,
      case when u.id is null then s.description else 'updated' end as description,
      case when u.id is null then s.priority else 7 end as priority, case when u.id is null then s.advice else u.p_brand end as recommendations,
      case when u.id is null then 0 else {AS_OF_US} end as updated_us from stored s left join updates u using (id)""",
)
def update_rules(spark, sf_dir):
    last = rule_updates(spark, sf_dir)
    earlier = last.withColumn("description", F.lit("overruled")).withColumn("pos", F.lit(0))
    rows = rt.update_rules(stored_rules(spark, sf_dir), earlier.unionByName(last.withColumn("pos", F.lit(1))), as_of())
    return rows.select(
        "id", "name", "description", "priority", joined("recommendations").alias("recommendations"),
        F.unix_micros("updated_at").alias("updated_us"),
    )


@query(
    "update_rules_not_found",
    f"with {_STORED_RULES_SQL}, {_UPDATES_SQL} select id from updates where id not in (select id from stored)",
)
def update_rules_not_found(spark, sf_dir):
    return rt.not_found(stored_rules(spark, sf_dir), rule_updates(spark, sf_dir)).select("id")


@query(
    "backfill_match_type",
    "select p_partkey, coalesce(case when p_size > 25 then p_brand end, 'ALL') as match_type from part",
)
def backfill_match_type(spark, sf_dir):
    rules = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("match_type"))
    return rt.backfill_match_type(rules)


# -- patterns ---------------------------------------------------------------

_PATTERN_FIELDS = [
    "case when c_custkey % 3 = 0 then '' else concat('pat-', c_custkey) end as id",
    "case when c_custkey % 61 = 0 then ' ' else concat('rule-', c_nationkey, ' ') end as rule_id",
    "case when c_custkey % 59 = 0 then '' else ' log' end as event_type",
    "case when c_custkey % 67 = 0 then null else concat('svc-', c_nationkey % 5) end as source",
    "case when c_custkey % 53 = 0 then '' when c_custkey % 47 = 0 then 'QA ' when c_nationkey % 2 = 0 then "
    "'Prod' else 'stage' end as environment",
    "case when c_custkey % 43 = 0 then null when c_custkey % 41 = 0 then 101 else c_nationkey % 3 end as "
    "severity_min",
    "case when c_custkey % 37 = 0 then '' when c_custkey % 31 = 0 then 'prefix' when c_nationkey % 3 = 0 then "
    "'EXACT' when c_nationkey % 3 = 1 then ' Contains' else 'regex' end as message_match_type",
    "case when c_custkey % 29 = 0 then ' ' else concat(' ', c_mktsegment) end as message_pattern",
]
_PATTERN_ENV = sql_environment("environment")
_PATTERNS_SQL = f"""requests as (
  select c_custkey as pos, {', '.join(_PATTERN_FIELDS)}, case when c_custkey % 2 = 0 then 1 else 0 end as conditions, c_acctbal from customer),
validated as (
  select pos, c_acctbal,
    case when trim(rule_id) = '' then 'ruleId is required'
      when (trim(message_match_type) = '') <> (trim(message_pattern) = '') then 'messageMatchType and messagePattern must be provided together'
      when trim(event_type) = '' then 'The EventType value is required'
      when coalesce(trim(source), '') = '' then 'The source value is required'
      when trim(environment) = '' then 'The Environment value is required'
      when {_PATTERN_ENV} not in ('production', 'staging', 'development') then 'invalid environment: ' || lower(trim(environment))
      when severity_min is null then 'The SeverityMin value is required'
      when severity_min not between 0 and 100 then 'The SeverityMin value must be between 0 and 100'
      when lower(trim(message_match_type)) not in ('exact', 'regex', 'contains')
        then 'The MessageMatchType value must be either EXACT, CONTAINS, or REGEX'
      when trim(message_pattern) = '' then 'The MessagePattern value is required' end as error,
    id, trim(rule_id) as rule_id, trim(event_type) as event_type, coalesce(trim(source), '') as source, {_PATTERN_ENV} as environment,
    cast(severity_min as integer) as severity_min, lower(trim(message_match_type)) as message_match_type,
    trim(message_pattern) as message_pattern, conditions
  from requests)"""
_PATTERN_KEY = "rule_id, event_type, source, environment, severity_min, message_match_type, message_pattern, conditions"
_STORED_PATTERNS_SQL = f"""{_PATTERNS_SQL},
valid as (select * from validated where error is null),
stored as (select 'old-' || min(pos) as id, {_PATTERN_KEY} from valid where c_acctbal < 2000 group by all)"""
# Rules exist for the nations of the three last regions only.
_KNOWN_RULES_SQL = "known as (select 'rule-' || n_nationkey as rule_id from nation where n_regionkey >= 2)"


def pattern_requests(spark, sf_dir):
    fields = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as pos",
        *_PATTERN_FIELDS,
        # Equal as JSON values although spelled in two ways.
        """case when c_custkey % 2 = 0 then array(named_struct('field', 'k', 'operator', 'equals',
           'value', case when c_custkey % 4 = 0 then '1.0' else '1' end)) end as payload_conditions""",
        "map('service', 'x', 'zone', 'y') as variable_mappings",
        "c_acctbal",
    )
    return fields.withColumn("severity_min", F.col("severity_min").cast("int"))


def valid_patterns(spark, sf_dir):
    return rt.validate_patterns(pattern_requests(spark, sf_dir)).filter("error is null").drop("error")


def stored_patterns(spark, sf_dir):
    """One row per natural key, made by inserting into an empty table."""
    small = valid_patterns(spark, sf_dir).filter("c_acctbal < 2000").withColumn("_key", rt.natural_key(rt.PATTERN_KEY))
    row = F.struct(*rt.PATTERN_KEY)
    firsts = small.groupBy("_key").agg(F.min("pos").alias("pos"), F.min_by(row, "pos").alias("row"))
    return firsts.select(F.concat(F.lit("old-"), F.col("pos").cast("string")).alias("id"), "row.*")


def known_rules(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").filter("n_regionkey >= 2")
    return nations.select(F.concat(F.lit("rule-"), F.col("n_nationkey").cast("string")).alias("id"))


@query(
    "validate_patterns",
    f"""with {_PATTERNS_SQL} select pos, error, id, rule_id, event_type, source, environment, severity_min, message_match_type,
      message_pattern, conditions from validated""",
)
def validate_patterns(spark, sf_dir):
    rows = rt.validate_patterns(pattern_requests(spark, sf_dir))
    return rows.withColumn("conditions", F.size("payload_conditions")).drop("payload_conditions", "variable_mappings", "c_acctbal")


@query(
    "find_existing_pattern",
    f"with {_STORED_PATTERNS_SQL} select v.pos, s.id as existing_id from valid v left join stored s using ({_PATTERN_KEY})",
)
def find_existing_pattern(spark, sf_dir):
    found = rt.find_existing(stored_patterns(spark, sf_dir), valid_patterns(spark, sf_dir), rt.PATTERN_KEY)
    return found.select("pos", "existing_id")


@query(
    "insert_patterns_if_absent",
    f"""with {_STORED_PATTERNS_SQL}, {_KNOWN_RULES_SQL},
    found as (select v.*, s.id as existing_id, min(pos) over (partition by {', '.join('v.' + c.strip() for c in _PATTERN_KEY.split(','))}) as first_pos
      from valid v join known using (rule_id) left join stored s using ({_PATTERN_KEY})),
    firsts as (select pos as first_pos, id as first_id from valid)
    select f.pos, coalesce(f.existing_id, case when r.first_id = '' then 'hash' else r.first_id end) as id,
      f.existing_id is null and f.pos = f.first_pos as created from found f join firsts r using (first_pos)""",
)
def insert_patterns_if_absent(spark, sf_dir):
    answers, _ = rt.insert_patterns_if_absent(
        stored_patterns(spark, sf_dir), valid_patterns(spark, sf_dir).drop("c_acctbal"), known_rules(spark, sf_dir)
    )
    shown = F.when(F.length("id") == 64, F.lit("hash")).otherwise(F.col("id"))
    return answers.select("pos", shown.alias("id"), "created")


@query(
    "unknown_rules",
    f"""with {_STORED_PATTERNS_SQL}, {_KNOWN_RULES_SQL} select pos, rule_id from valid where rule_id not in (select rule_id from known)""",
)
def unknown_rules(spark, sf_dir):
    return rt.unknown_rules(valid_patterns(spark, sf_dir), known_rules(spark, sf_dir)).select("pos", "rule_id")


@query(
    "update_patterns",
    f"""with {_STORED_PATTERNS_SQL} select s.id, case when c.c_custkey is null then s.source else 'svc-new' end as source,
      case when c.c_custkey is null then s.message_pattern else nullif(c.c_mktsegment, 'BUILDING') end as message_pattern,
      case when c.c_custkey is null then 0 else {AS_OF_US} end as updated_us
    from stored s left join customer c on s.id = 'old-' || c.c_custkey and c.c_acctbal < 1000""",
)
def update_patterns(spark, sf_dir):
    patterns = stored_patterns(spark, sf_dir).withColumns(
        {"message_regex": F.lit(None).cast("string"), "updated_at": F.timestamp_micros(F.lit(0))}
    )
    updates = table(spark, sf_dir, "customer").filter("c_acctbal < 1000").select(
        F.concat(F.lit("old-"), F.col("c_custkey").cast("string")).alias("id"),
        F.lit("rule-1").alias("rule_id"),
        F.lit("queue").alias("event_type"),
        F.lit("svc-new").alias("source"),
        F.lit("staging").alias("environment"),
        F.lit(1).alias("severity_min"),
        F.lit("contains").alias("message_match_type"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(F.col("c_mktsegment")).alias("message_pattern"),
        F.array().cast("array<struct<field:string,operator:string,value:string>>").alias("payload_conditions"),
        F.create_map().cast("map<string,string>").alias("variable_mappings"),
        F.lit(None).cast("string").alias("message_regex"),
    )
    earlier = updates.withColumn("source", F.lit("overruled")).withColumn("pos", F.lit(0))
    rows = rt.update_patterns(patterns, earlier.unionByName(updates.withColumn("pos", F.lit(1))), as_of())
    return rows.select("id", "source", "message_pattern", F.unix_micros("updated_at").alias("updated_us"))


@query(
    "delete_patterns",
    f"with {_STORED_PATTERNS_SQL} select id from stored where id not in (select 'old-' || c_custkey from customer where c_acctbal < 500)",
)
def delete_patterns(spark, sf_dir):
    poor = table(spark, sf_dir, "customer").filter("c_acctbal < 500")
    ids = poor.select(F.concat(F.lit("old-"), F.col("c_custkey").cast("string")).alias("id"))
    return rt.delete_by_id(stored_patterns(spark, sf_dir), ids).select("id")


@query(
    "delete_rules_cascade",
    f"""with {_STORED_PATTERNS_SQL} select 'rule' as kind, 'rule-' || n_nationkey as id from nation where n_regionkey >= 2
      and 'rule-' || n_nationkey not in (select 'rule-' || s_nationkey from supplier where s_acctbal < 3000)
    union all select 'pattern', id from stored
      where rule_id not in (select 'rule-' || s_nationkey from supplier where s_acctbal < 3000)""",
)
def delete_rules_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "supplier").filter("s_acctbal < 3000").select(
        F.concat(F.lit("rule-"), F.col("s_nationkey").cast("string")).alias("id")
    )
    rules, patterns = rt.delete_rules(known_rules(spark, sf_dir), stored_patterns(spark, sf_dir), gone)
    return rules.select(F.lit("rule").alias("kind"), "id").unionByName(patterns.select(F.lit("pattern").alias("kind"), "id"))


# -- allow-list -------------------------------------------------------------

_CUSTOMER_ENV = "case c_nationkey % 3 when 0 then 'production' when 1 then 'staging' else 'development' end"
_FILTERS_SQL = f"""filters as (
  select {_CUSTOMER_ENV} as environment, lower(c_mktsegment) || '-' || c_nationkey as allow_payload from customer group by 1, 2)"""
_ENV_SPELLED = "case s_nationkey % 3 when 0 then ' PROD ' when 1 then 'stage' else 'dev' end"
_ENV_LONG = "case s_nationkey % 3 when 0 then 'production' when 1 then 'staging' else 'development' end"
# A supplier asks for one key, spelled twice, and a blank one.
_KEY = "case when s_acctbal < 4000 then concat('building-', s_nationkey) else concat('fresh-', s_nationkey) end"


def filters(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        f"{_CUSTOMER_ENV} as environment",
        "concat(lower(c_mktsegment), '-', c_nationkey) as allow_payload",
    ).distinct().withColumn("updated_at", F.timestamp_micros(F.lit(0)))


def key_requests(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as request_id",
        f"{_ENV_SPELLED} as environment",
        f"array({_KEY}, concat(' ', {_KEY}, chr(9)), ' ') as payloads",
    )


_ADDED_SQL = f"""{_FILTERS_SQL},
asked as (select s_suppkey as request_id, {_ENV_LONG} as environment, {_KEY} as allow_payload from supplier),
fresh as (select a.* from asked a left join filters f using (environment, allow_payload) where f.environment is null)"""


@query(
    "scan_allow_list",
    f"with {_FILTERS_SQL} select allow_payload from filters where environment = 'production' order by 1",
)
def scan_allow_list(spark, sf_dir):
    return rt.allow_list(filters(spark, sf_dir), "production")


@query("add_allow_keys", f"with {_ADDED_SQL} select distinct environment, allow_payload from fresh")
def add_allow_keys(spark, sf_dir):
    rows, _ = rt.add_allow_keys(filters(spark, sf_dir), key_requests(spark, sf_dir), as_of())
    return rows.select("environment", "allow_payload")


@query(
    "add_allow_keys_conflicts",
    f"""with {_ADDED_SQL} select a.request_id from asked a left join (
      select environment, allow_payload, min(request_id) as first from fresh group by 1, 2) f using (environment, allow_payload)
    where f.first is null or a.request_id <> f.first""",
)
def add_allow_keys_conflicts(spark, sf_dir):
    _, conflicts = rt.add_allow_keys(filters(spark, sf_dir), key_requests(spark, sf_dir), as_of())
    return conflicts.select("request_id")


# Every customer asks for its own key and the next one's; some keys are stored already. Between
# two that fail for a stored key, every second request is in the way of the next.
_CHAIN_SQL = """able as (
  select c_custkey as k from customer
  where c_acctbal >= -990 and c_custkey + 1 not in (select c_custkey from customer where c_acctbal < -990)),
run as (select k, k - row_number() over (order by k) as island from able),
placed as (select k, row_number() over (partition by island order by k) % 2 = 1 as won from run)"""


def chained_requests(spark, sf_dir):
    key = "concat('customer-', {})".format
    customers = table(spark, sf_dir, "customer")
    stored = customers.where("c_acctbal < -990").selectExpr("'production' as environment", f"{key('c_custkey')} as allow_payload")
    asked = customers.selectExpr(
        "c_custkey as request_id", "'prod' as environment", f"array({key('c_custkey')}, {key('c_custkey + 1')}) as payloads"
    )
    return rt.add_allow_keys(stored, asked, as_of())


@query(
    "add_allow_keys_chain",
    f"""with {_CHAIN_SQL}
    select 'customer-' || k as allow_payload from placed where won
    union all select 'customer-' || (k + 1) from placed where won""",
)
def add_allow_keys_chain(spark, sf_dir):
    return chained_requests(spark, sf_dir)[0].select("allow_payload")


@query(
    "add_allow_keys_chain_conflicts",
    f"""with {_CHAIN_SQL}, there as (
      select c_custkey as k, 0 as since from customer where c_acctbal < -990
      union all select k, k from placed where won
      union all select k + 1, k from placed where won),
    asked as (select c_custkey as request_id, c_custkey as k from customer union all select c_custkey, c_custkey + 1 from customer)
    select a.request_id, 'customer-' || a.k as allow_payload from asked a join there t on a.k = t.k and t.since < a.request_id""",
)
def add_allow_keys_chain_conflicts(spark, sf_dir):
    return chained_requests(spark, sf_dir)[1].select("request_id", "allow_payload")


@query(
    "add_allow_keys_ignore",
    f"with {_ADDED_SQL} select distinct environment, allow_payload from fresh",
)
def add_allow_keys_ignore(spark, sf_dir):
    rows, _ = rt.add_allow_keys(filters(spark, sf_dir), key_requests(spark, sf_dir), as_of(), on_conflict="ignore")
    return rows.select("environment", "allow_payload")


@query(
    "remove_allow_keys",
    f"""with {_ADDED_SQL} select count(*) as rows_left,
      (select count(*) from filters where (environment, allow_payload) in (select environment, allow_payload from asked)) as removed
    from filters where (environment, allow_payload) not in (select environment, allow_payload from asked)""",
)
def remove_allow_keys(spark, sf_dir):
    left, removed = rt.remove_allow_keys(filters(spark, sf_dir), key_requests(spark, sf_dir))
    both = left.select(F.lit(1).alias("kept")).unionByName(removed.select(F.lit(0).alias("kept")))
    return both.agg(F.count_if(F.col("kept") == 1).alias("rows_left"), F.count_if(F.col("kept") == 0).alias("removed"))
