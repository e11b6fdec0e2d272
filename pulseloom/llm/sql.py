"""DuckDB twins: the plain statement of what a query returns, without regard to scale."""

INNER_PRODUCT_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256.0::double * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

MIXING_SQL = """
with d as (
  select doc_id, source, coalesce(text, '') as t,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size
  from documents),
w as (
  select doc_id, source, size,
    case when size > 0 then size / (size + 50.0) * case when length(t) >= size * 3 and length(t) <= size * 15 then 1.0::double else 0.25::double end
         else 0.001::double end as weight
  from d),
k as (
  select doc_id, source, size,
    -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5::double) / 4503599627370496.0::double) / weight::double as key
  from w),
s as (
  select source, sum(size)::bigint as source_size,
    [5.0, 2.0, 1.0][((row_number() over (order by source nulls last)) - 1) % 3 + 1]::double as weight
  from k group by source),
r as (select *, source_size * 2.0::double as most, source_size * 2.0::double / weight as ratio from s),
l as (
  select *, (sum(source_size) over () * 1.5::double
      - coalesce(sum(most) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level
  from r),
g as (
  select source, source_size,
    least(most, weight * (select arg_min(level, ratio) from l where level <= ratio)) as target
  from l),
e as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from g)
select k.doc_id, k.size::bigint as size, e.source_size, e.target,
  (k.size * (e.epochs + case when sum(k.size) over (partition by k.source order by k.key, k.doc_id rows between unbounded preceding and current row)
      - k.size + k.size / 2.0::double <= e.target - e.epochs * e.source_size then 1 else 0 end))::bigint as taken
from k join e on k.source is not distinct from e.source
"""


def _near_sql(width: int, percent: int, columns: str) -> str:
    """Components of documents whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` or more."""
    return f"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words
  from documents),
s as (
  select distinct doc_id, case when len(words) < {width} then array_to_string(words, ' ') else array_to_string(words[i:i + {width - 1}], ' ') end as shingle
  from (select doc_id, words, unnest(range(1, greatest(len(words) - {width - 2}, 2))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
rare as (select shingle from s group by shingle having count(*) > 1),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as common
  from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id semi join rare on a.shingle = rare.shingle
  group by a.doc_id, b.doc_id),
l as (
  select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b
  where 100 * p.common >= {percent} * (x.n + y.n - p.common)),
e as (select a, b from l union all select b, a from l),
reach(doc_id, root) as (
  select doc_id, doc_id from documents union select e.b, reach.root from reach join e on e.a = reach.doc_id and e.b > reach.root)
select {columns}
from documents d join (select doc_id, min(root) as component_id from reach group by doc_id) m on m.doc_id = d.doc_id
left join n on n.doc_id = d.doc_id
"""


MINHASH_SQL = _near_sql(3, 85, "d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id, d.doc_id = m.component_id as kept")
NGRAM_SQL = _near_sql(4, 85, "d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id")


DIVERGENCE_SQL = """
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents),
w as (select id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
c as materialized (select lang, source, term, count(*) as c, count(distinct id) as docs from w group by lang, source, term),
k as materialized (select lang, term, sum(c) as c from c group by lang, term having sum(docs) >= 10),
l as (select lang, count(*) as v, sum(c) as n from k group by lang),
g as materialized (
  select d.lang, d.source, coalesce(any_value(l.v), 0) as v, coalesce(any_value(l.n), 0) as n_lang, coalesce(any_value(s.n), 0) as n
  from (select distinct lang, source from d) d left join l on l.lang = d.lang
  left join (select c.lang, c.source, sum(c.c) as n from c semi join k on k.lang = c.lang and k.term = c.term group by c.lang, c.source) s on s.lang = d.lang and s.source = d.source
  group by d.lang, d.source),
p as materialized (
  select g.lang, g.source, k.term, coalesce(c.c, 0) as c, (1 + (1000000000::hugeint * (coalesce(c.c, 0) + 2)) // (g.n + 2 * g.v))::bigint as p,
    (1 + (1000000000::hugeint * (k.c + 2)) // (g.n_lang + 2 * g.v))::bigint as q
  from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
f as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by a.lang, a.source, b.source),
r as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
  from g a join g b on b.lang = a.lang and b.source <> a.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p where c > 0 and p > q)
select * from (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from r)
where part = 'pair' or rank <= 10
"""


def _kind(name: str, pattern: str, rank: int, holds: str) -> str:
    return f"""
{name} as (
  select doc_id, {rank} as rank, '{name}' as kind, hits[i] as hit,
    (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::bigint as start
  from (select doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) as i
    from (select doc_id, string_split_regex(t, '{pattern}') as gaps, regexp_extract_all(t, '{pattern}') as hits from d))
  where {holds})"""


_DIGITS = "regexp_replace(hits[i], '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) between 14 and 19 and list_sum(list_transform(range(0, length({_DIGITS})), lambda j:
    case when j % 2 = 1 then 2 * substr({_DIGITS}, length({_DIGITS}) - j::bigint, 1)::int - case when substr({_DIGITS}, length({_DIGITS}) - j::bigint, 1)::int > 4 then 9 else 0 end
         else substr({_DIGITS}, length({_DIGITS}) - j::bigint, 1)::int end)) % 10 = 0"""
_SMALL = "len(list_filter(string_split(hits[i], '.'), lambda x: length(ltrim(x, '0')) > 3 or coalesce(try_cast(ltrim(x, '0') as int), 0) > 255)) = 0"

PII_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
{_kind("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", 0, "true")},
{_kind("ip", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", 1, _SMALL)},
{_kind("card", "[0-9](?:[ -]?[0-9])+", 2, _LUHN)},
{_kind("phone", "[+][0-9][ ().0-9-]+[0-9]", 3, f"length({_DIGITS}) between 10 and 15")},
a as (select * from email union all select * from ip union all select * from card union all select * from phone),
g as (
  select doc_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card,
    count(*) filter (kind = 'phone') as n_phone, string_agg(kind || ':' || start || ':' || (start + length(hit)), ',' order by start, rank) as spans
  from a group by doc_id)
select d.doc_id, coalesce(n_email, 0)::bigint as n_email, coalesce(n_ip, 0)::bigint as n_ip, coalesce(n_card, 0)::bigint as n_card,
  coalesce(n_phone, 0)::bigint as n_phone, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g on g.doc_id = d.doc_id
"""


def _codes_sql(rounds: int) -> str:
    """Product codes: the assignment to every round's codebooks, written out."""
    parts = [
        """
with k as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(4096.0::double * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, label, m, v[m * (len(v) // 8) + 1:(m + 1) * (len(v) // 8)] as q from k, unnest(range(0, 8)) as t(m)),
b0 as materialized (
  select m, (row_number() over (partition by m order by vec_id)) - 1 as e, q from p
  qualify row_number() over (partition by m order by vec_id) <= 16)"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} as materialized (
  select vec_id, label, m, q, arg_min(e, s * 16 + e) as e, min(s) as s
  from (select p.*, b.e, list_sum(list_transform(range(1, len(p.q) + 1), lambda i: (p.q[i] - b.q[i]) * (p.q[i] - b.q[i])))::bigint as s from p join b{r} b on b.m = p.m)
  group by vec_id, label, m, q)""")
        if r < rounds:
            parts.append(f"""
s{r} as materialized (
  select m, e, list(x order by i) as q
  from (select m, e, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as x
    from (select m, e, unnest(q) as x, unnest(range(1, len(q) + 1)) as i from a{r}) group by m, e, i)
  group by m, e),
b{r + 1} as materialized (select b.m, b.e, coalesce(s.q, b.q) as q from b{r} b left join s{r} s on s.m = b.m and s.e = b.e)""")
    return ",".join(parts) + f"""
select vec_id, string_agg(printf('%02x', e), '' order by m) as code, sum(s)::bigint as error,
  (sum(sum(s)) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(x::varchar, ',' order by m, e, i)) from (select m, e, unnest(q) as x, unnest(range(1, len(q) + 1)) as i from b{rounds})) as codebooks_sha256
from a{rounds} group by vec_id, label
"""


CODES_SQL = _codes_sql(6)
