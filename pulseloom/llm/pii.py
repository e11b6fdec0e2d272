"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Everything is a column expression, so nothing leaves the scan stage. A kind is a
pattern, a check on the matched text, a score and context words that raise it;
spans from ``least`` on are reported. E-mail addresses, IP addresses, cards and
international phone numbers are reported whenever pattern and check hold; account
numbers need the mod-97 check, national phone and security numbers a context word.
Positions count code points, ends exclusive. Matches of a kind are leftmost and do
not overlap; a match that fails its check is dropped and not tried again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 48  # characters before and after a span in which context words count
BOOST, LEAST = 0.3, 0.5
CHUNK = 512  # characters of a text that are met at once
STEP = 256  # numbers of an array that are added up at once


class Kind(NamedTuple):
    name: str
    pattern: str
    hint: str  # a cheaper pattern every match implies; plain text if it has one character
    score: float
    context: str


# Possessive loops and the looks behind keep matching linear in the text; they start and end where the plain patterns do.
_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|e-mail|email|contact"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", 0.6, "ip|host|server|address"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", r"[0-9](?:[ -]?[0-9]){13}", 0.7, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", 0.6, "iban|account|bank"),
    Kind("local_phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[ .-][0-9]{4}", 0.3, "phone|tel|call|mobile|fax"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, "ssn|social security"),
)
BASE = ("email", "ip", "card", "phone")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks leaves 1 modulo 97, its first four characters moved to the end."""
    turned = F.concat(F.substring(account, 5, 1000), F.substring(account, 1, 4))

    def add(rest, c):
        value = F.ascii(c)
        return F.when(value > 64, rest * 100 + value - 55).otherwise(rest * 10 + value - 48) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def _holds(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(hit, r"\."), small)
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(hit, " ", ""))
    return F.lit(True)


SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, join: Callable[[Column, Column], Column], least: int) -> Column:
    """Running sums, maxima or the like of an array: in parts of STEP, whose last values are carried on."""
    start = F.lit(least).cast("long")

    def scan(rows: Column, of: Callable[[Column], Column], first: Column) -> Column:
        return F.aggregate(rows, first, lambda done, x: F.concat(done, F.array(join(F.coalesce(F.try_element_at(done, F.lit(-1)), start), of(x)))))

    def whole(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda i: scan(F.slice(v, i * STEP + 1, STEP), lambda x: x.cast("long"), F.array().cast("array<long>")))
        carried = lambda ps: scan(ps, lambda p: F.element_at(p, -1), F.array(start))
        return _let(parts, lambda ps: _let(carried(ps), lambda c: F.flatten(F.transform(ps, lambda p, i: F.transform(p, lambda x: join(c[i], x))))))

    return _let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<long>")))


_SUM = lambda a, b: a + b


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of the text in ``chunks`` of CHUNK characters; reads only the chunks they lie in."""
    first = F.floor(start / CHUNK).cast("int")
    held = F.array_join(F.slice(chunks, first + 1, F.floor(end / CHUNK).cast("int") - first + 1), "")
    return F.substring(held, (start - first * CHUNK + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def _hinted(text: Column, kind: Kind) -> Column:
    return F.contains(text, F.lit(kind.hint)) if len(kind.hint) == 1 else text.rlike(kind.hint)


def _spans(text: Column, rank: int, kind: Kind) -> Column:
    """Confirmed spans of one kind in text order; in time linear in the text."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    size, chunks = F.col("_size").cast("long"), F.col("_chunks")

    def place(found: Column) -> Column:
        def one(hit: Column, i: Column, ends: Column) -> Column:
            end = ends[i]
            start = end - F.length(hit)
            before = _cut(chunks, F.greatest(start - NEAR, F.lit(0)), start)
            # The line end stands for the span: no context word reaches over it.
            near = F.lower(F.concat(before, F.lit("\n"), _cut(chunks, end, F.least(end + NEAR, size))))
            score = F.lit(kind.score) + F.when(near.rlike(rf"\b(?:{kind.context})\b"), BOOST).otherwise(0.0)
            sure = F.lit(True) if kind.name in BASE else score >= LEAST
            return F.when(_holds(kind.name, hit) & sure, F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), F.lit(kind.name).alias("kind"), F.least(score, F.lit(1.0)).alias("score")))

        widths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, h: F.length(g) + F.length(h))
        return _let(_running(widths, _SUM, 0), lambda ends: F.array_compact(F.transform(found, lambda hit, i: one(hit, i, ends))))

    return F.when(F.col(f"_{kind.name}_hint"), _let(hits, place)).otherwise(F.array()).cast(SPAN)


def _clear(base: Column, more: Column) -> Column:
    """Base spans and those of ``more`` that touch none of them, in order.

    In the order of their starts a span touches a base span if one before it ends
    behind its start, or the next one begins before its end.
    """
    far = 2**62
    is_base = lambda s: F.col("_ranks")[s["rank"]]

    def merged(spans: Column) -> Column:
        ended = _running(F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(F.lit(-1))), F.greatest, -1)
        begins = F.reverse(_running(F.transform(F.reverse(spans), lambda s: F.when(is_base(s), s["start"].cast("long")).otherwise(F.lit(far))), F.least, far))
        keep = lambda s, i, e, b: is_base(s) | ((e[i] <= s["start"]) & (b[i] >= s["end"]))
        return _let(ended, lambda e: _let(begins, lambda b: F.filter(spans, lambda s, i: keep(s, i, e, b))))

    return F.when(F.size(more) == 0, base).otherwise(_let(F.array_sort(F.concat(base, more)), merged))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, rank, end, kind, score), by start, then kind as listed.

    Null texts are empty texts and have no spans. A span of the further kinds
    that touches a base span is left out. Columns of these names are replaced;
    every other column and every row stays. Time and memory are linear in the text,
    whatever the number of spans.
    """
    return _found(docs).drop("_chunks", "_size")


def _found(docs: DataFrame) -> DataFrame:
    """:func:`find_personal_data` with the text in chunks (null without a hint of a span) and its length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hints = [_hinted(text, kind).alias(f"_{kind.name}_hint") for kind in KINDS]
    any_hint = reduce(Column.__or__, [F.col(f"_{kind.name}_hint") for kind in KINDS])
    hinted = docs.drop("base_spans", "spans").select("*", *hints)
    chunks = F.when(any_hint, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    cut = hinted.withColumns({"_chunks": chunks, "_size": F.length(text), "_ranks": F.array(*[F.lit(k.name in BASE) for k in KINDS])})
    found = cut.withColumns({f"_{kind.name}": _spans(text, i, kind) for i, kind in enumerate(KINDS)})
    base = F.array_sort(F.concat(*[F.col(f"_{k}") for k in BASE]))
    more = F.concat(*[F.col(f"_{k.name}") for k in KINDS if k.name not in BASE])
    found = found.withColumns({"base_spans": base, "_more": more}).withColumn("spans", _clear(F.col("base_spans"), F.col("_more")))
    return found.drop("_more", "_ranks", *[f"_{k.name}" for k in KINDS], *[f"_{k.name}_hint" for k in KINDS])


def digest(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets, such as ``[EMAIL]``.

    Spans that overlap become one mask, named after the first. ``n_chars``, if
    there is one, is the new length. Null texts stay null; no row is dropped.
    """
    # The row travels as one struct, so no name of its columns can clash with those used here.
    found = _found(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    chunks, spans = F.col("_chunks"), F.col("spans")

    def apart(reach: Column) -> Column:
        """Start, end and kind of every run of overlapping spans; ``reach`` is the running maximum of the ends."""
        marked = F.transform(spans, lambda s, i: F.struct(i.alias("at"), s["start"].alias("start"), s["kind"].alias("kind"), (F.coalesce(F.get(reach, i - 1), F.lit(0).cast("long")) <= s["start"]).alias("new")))
        upto = lambda firsts, k: F.coalesce(F.get(reach, F.get(firsts, k + 1)["at"] - 1), F.element_at(reach, -1))
        return _let(F.filter(marked, lambda m: m["new"]), lambda firsts: F.transform(firsts, lambda f, k: F.struct(f["start"].cast("long").alias("start"), upto(firsts, k).alias("end"), f["kind"].alias("kind"))))

    def write(runs: Column) -> Column:
        ended = lambda k: F.coalesce(F.get(runs, k - 1)["end"], F.lit(0).cast("long"))
        pieces = F.transform(runs, lambda r, k: F.concat(_cut(chunks, ended(k), r["start"]), F.lit("["), F.upper(r["kind"]), F.lit("]")))
        return F.concat(F.array_join(pieces, ""), _cut(chunks, F.element_at(runs, -1)["end"], F.col("_size").cast("long")))

    ends = _running(F.transform(spans, lambda s: s["end"]), F.greatest, 0)
    masked = _let(_let(ends, apart), write)
    out = found.withColumn("text", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
