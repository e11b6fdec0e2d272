"""Payload redaction and the payload condition language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseloom.functions.text import strip

PAYLOAD_MAP = "map<string,variant>"

# The keys a condition object may have, and the operators that
# can ever match. Any other operator is stored and never matches.
CONDITION_KEYS = ("field", "operator", "value")
NUMERIC_OPERATORS = ("greater_than", "less_than", "greater_than_equal", "less_than_equal")


def payload_map(payload: Column) -> Column:
    return F.from_json(payload, PAYLOAD_MAP)


def redact_payload(payload: Column, allowed: Column) -> Column:
    """Keep the allow-listed top-level keys; an empty list keeps everything."""
    kept = F.to_json(F.map_filter(payload_map(payload), lambda key, _: F.array_contains(allowed, key)))
    return F.when(F.coalesce(F.size(allowed), F.lit(0)) <= 0, payload).otherwise(kept)


def normalize_keys(keys: Column) -> Column:
    """Trimmed, non-blank, distinct keys in first-seen order."""
    return F.array_distinct(F.filter(F.transform(keys, strip), lambda key: key != ""))


def keys_error(keys: Column) -> Column:
    empty = F.coalesce(F.size(normalize_keys(keys)), F.lit(0)) <= 0
    return F.when(empty, F.lit("payloads must contain at least one key"))


def _typed(value: str) -> str:
    """SQL for a JSON value as (kind, num, txt); the kind of an absent value is null.

    Only the form its kind is compared by is decoded: a cast that fails costs more than all the rest.
    """
    return f"""element_at(transform(transform(transform(array({value}),
        v -> named_struct('v', v, 's', schema_of_variant(v))),
        w -> named_struct('v', w.v, 'kind', case when w.v is null then null
                     when w.s = 'STRING' then 'string'
                     when startswith(w.s, 'BIGINT') or startswith(w.s, 'DOUBLE') or startswith(w.s, 'DECIMAL') then 'number'
                     when w.s = 'BOOLEAN' then 'boolean'
                     when w.s = 'VOID' then 'null'
                     else 'other' end)),
        t -> named_struct('kind', t.kind,
             'num', case when t.kind = 'number' then try_variant_get(t.v, '$', 'double') end,
             'txt', case when t.kind in ('string', 'boolean') then try_variant_get(t.v, '$', 'string') end)), 1)"""


def typed_payload(payload: str) -> Column:
    """A payload's top-level keys with their values as (kind, num, txt), decoded once for any number of conditions."""
    return F.expr(f"transform_values(from_json(coalesce({payload}, '{{}}'), '{PAYLOAD_MAP}'), (_, value) -> {_typed('value')})")


def typed_conditions(conditions: str) -> Column:
    """Conditions with their value decoded: done once per pattern, not per signal."""
    wanted = _typed("try_parse_json(coalesce(c.value, 'null'))")
    return F.expr(f"transform({conditions}, c -> named_struct('field', c.field, 'operator', c.operator, 'want', {wanted}))")


def comparable_conditions(conditions: str) -> Column:
    """Conditions in a form that is equal when the stored JSON is: 2 is 2.0, key order is free."""
    value = "try_parse_json(coalesce(c.value, 'null'))"
    return F.expr(f"""transform({conditions}, c -> element_at(transform(array({_typed(value)}), t -> named_struct(
        'f', c.field, 'o', c.operator, 'k', t.kind, 'n', case when t.kind = 'number' then t.num end,
        'j', case when t.kind <> 'number' then to_json({value}) end)), 1))""")


# Truth of one condition, given p.have and p.want of the same kind or not.
_HOLDS = """coalesce(case p.operator
    when 'equals' then p.have.kind = p.want.kind and case p.have.kind
        when 'null' then true when 'number' then p.have.num = p.want.num
        when 'other' then false else p.have.txt = p.want.txt end
    when 'contains' then p.have.kind = 'string' and p.want.kind = 'string' and contains(p.have.txt, p.want.txt)
    when 'greater_than' then p.have.kind = 'number' and p.want.kind = 'number' and p.have.num > p.want.num
    when 'less_than' then p.have.kind = 'number' and p.want.kind = 'number' and p.have.num < p.want.num
    when 'greater_than_equal' then p.have.kind = 'number' and p.want.kind = 'number' and p.have.num >= p.want.num
    when 'less_than_equal' then p.have.kind = 'number' and p.want.kind = 'number' and p.have.num <= p.want.num
    else false end, false)"""


def typed_conditions_hold(payload: str, conditions: str) -> Column:
    """True when every typed condition holds for the payload; none is true.

    Comparison is strict on the JSON type; a field is a literal top-level key;
    an absent field or an unknown operator is false. The payload is parsed once
    per row, and only if there is a condition; for several lists of conditions
    on one payload see :func:`typed_payload`.
    """
    parsed = f"from_json(coalesce({payload}, '{{}}'), '{PAYLOAD_MAP}')"
    return F.expr(_all_hold(parsed, conditions, _typed("try_element_at(m, c.field)")))


def typed_payload_holds(typed: str, conditions: str) -> Column:
    """:func:`typed_conditions_hold` for a column of :func:`typed_payload`."""
    return F.expr(_all_hold(typed, conditions, "try_element_at(m, c.field)"))


def _all_hold(values: str, conditions: str, have: str) -> str:
    return f"""case when coalesce(size({conditions}), 0) <= 0 then true
        else exists(array({values}), m -> forall({conditions}, c ->
            exists(array(named_struct('operator', c.operator, 'want', c.want, 'have', {have})), p -> {_HOLDS}))) end"""


def condition_error(condition_json: Column) -> Column:
    """Error text of a condition object with a key that is not defined."""
    keys = F.json_object_keys(condition_json)
    unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in CONDITION_KEYS])))
    return F.when(keys.isNull(), F.lit("invalid payload condition: not an object")).when(
        F.size(unknown) > 0,
        F.concat(F.lit('invalid payload condition: json: unknown field "'), F.element_at(unknown, 1), F.lit('"')),
    )
