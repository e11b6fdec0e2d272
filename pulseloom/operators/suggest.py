"""Texts for an external suggester, and its answers.

A prompt is a header and numbered evidence lines. It is built in parts (the
header, then pages of lines), so a session of any size stays splittable; the
parts of an incident in order are its prompt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.analysis import fallback_hypotheses, fallback_recommendations
from pulseloom.functions.strict import not_text, one_value
from pulseloom.functions.text import WHITE_SPACE, ZERO_TIME_US, strip
from pulseloom.operators.sessions import PAGE_ROWS, add_position, paged_lists

# Error texts of the answer parser and of provider failures.
NO_RESPONSE = "no AI response returned"
EMPTY_RESPONSE = "AI response content is empty"
BAD_JSON = "failed to parse AI response JSON"
NO_HYPOTHESIS = "AI response missing hypothesisTemplate"
NO_RECOMMENDATIONS = "AI response missing recommendations"
PROVIDER_ERRORS = (
    # text in the provider's message, text shown; the first hit counts
    ("insufficient_quota", "OpenAI quota exceeded: please add credits at https://platform.openai.com/settings/billing"),
    ("429", "OpenAI rate limit reached: too many requests, please try again later"),
    ("401", "OpenAI authentication failed: the API key is invalid or expired"),
)

# Instructions put before the incident text; the keys are what parse_suggestion reads.
DEFAULT_INSTRUCTIONS = (
    "Explain the incident below using only what it states. Answer with JSON alone, "
    'shaped as {"hypothesisTemplate": "string", "recommendations": ["string"]}: the most likely root cause, '
    "then next steps by priority. Say so if the evidence is thin.\n\n"
)


def list_or_none(items: Column) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(items, ", ")).otherwise(F.lit("none"))


# The layout of header and evidence lines.
def prompt_header(evidence_count: Column) -> Column:
    """Incident section of a prompt, up to the evidence lines (fixed layout)."""
    c = F.col
    return F.concat(
        F.lit("Incident:\n- id: "), c("id"),
        F.lit("\n- title: "), c("title"),
        F.lit("\n- status: "), c("status"),
        F.lit("\n- severity: "), c("severity").cast("string"),
        F.lit("\n- impactedServices: "), list_or_none(c("impacted_services")),
        F.lit("\n- environments: "), list_or_none(c("environments")),
        F.lit("\n- existingAnalysisSummary: "), strip(F.coalesce(c("analysis_summary"), F.lit(""))),
        F.lit("\n- existingRecommendations: "), list_or_none(c("recommendations")),
        F.lit("\n\nEvidence ("), evidence_count.cast("string"), F.lit("):\n"),
    )


def evidence_line(number: Column) -> Column:
    c = F.col
    unset = c("timestamp").isNull() | (F.unix_micros("timestamp") == F.lit(ZERO_TIME_US))
    time = F.when(unset, F.lit("unknown")).otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.concat(
        F.lit("- #"), number.cast("string"),
        F.lit(" id="), c("signal_id"),
        F.lit(" eventType="), c("event_type"),
        F.lit(" source="), c("source"),
        F.lit(" env="), c("env"),
        F.lit(" severity="), c("severity").cast("string"),
        F.lit(" timestamp="), time,
        F.lit(" message="), c("message"),
    )


def prompt_parts(incidents: DataFrame, evidence: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """(id, part, text, parts): part 0 is the header, part n the nth evidence page.

    ``evidence`` has incident_id, signal_id, event_type, source, env, severity,
    timestamp, message. Hand it sanitised messages: prompts leave the cluster.
    """
    ordered = add_position(evidence.withColumn("ts_us", F.unix_micros("timestamp")), ["incident_id"], ["ts_us", "signal_id"])
    lines = ordered.select("incident_id", "position", evidence_line(F.col("position") + 1).alias("line"))
    counts = lines.groupBy("incident_id").agg(F.count(F.lit(1)).alias("_n"))
    total = F.coalesce("_n", F.lit(0).cast("long"))
    pages_of = F.greatest(F.ceil(total / F.lit(page_rows)).cast("long"), F.lit(1))
    sized = incidents.join(counts.withColumnRenamed("incident_id", "id"), "id", "left").withColumn("parts", pages_of + 1)
    headers = sized.select(
        "id", F.lit(0).cast("long").alias("part"), "parts",
        F.concat(prompt_header(total), F.when(total == 0, F.lit("- none")).otherwise(F.lit(""))).alias("text"),
    )
    pages = paged_lists(lines, ["incident_id"], "line", page_rows).join(
        sized.select(F.col("id").alias("incident_id"), "parts"), "incident_id"
    )
    body = F.concat(F.when(F.col("page") > 0, F.lit("\n")).otherwise(F.lit("")), F.array_join("values", "\n"))
    text = F.when(F.col("page") + 2 == F.col("parts"), F.rtrim(body, F.lit(WHITE_SPACE))).otherwise(body)
    return headers.unionByName(
        pages.select(F.col("incident_id").alias("id"), (F.col("page") + 1).alias("part"), "parts", text.alias("text"))
    )


def clean_answer(text: Column) -> Column:
    """The answer without its code fence."""
    trimmed = strip(text)
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(trimmed, r"\A```json", ""), r"\A```", ""), r"```\z", "")
    return F.when(F.startswith(trimmed, F.lit("```")), strip(inner)).otherwise(trimmed)


def parse_suggestion(text: Column) -> Column:
    """struct(hypothesis, recommendations, error); ``error`` null means usable."""
    clean = clean_answer(text)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_json(clean, "hypothesisTemplate variant, recommendations array<variant>, _corrupt string", options)
    hypothesis = strip(F.coalesce(parsed["hypothesisTemplate"].cast("string"), F.lit("")))
    advice = F.filter(F.transform(parsed["recommendations"], lambda r: strip(F.coalesce(r.cast("string"), F.lit("")))), lambda r: r != "")
    wrong = not_text(parsed["hypothesisTemplate"]) | F.coalesce(F.exists(parsed["recommendations"], not_text), F.lit(False))
    broken = ~one_value(clean) | F.try_parse_json(clean).isNull() | parsed["_corrupt"].isNotNull() | wrong
    error = (
        F.when(text.isNull(), F.lit(NO_RESPONSE))
        .when(text == "", F.lit(EMPTY_RESPONSE))
        .when(broken, F.lit(BAD_JSON))
        .when(hypothesis == "", F.lit(NO_HYPOTHESIS))
        .when(F.coalesce(F.size(advice), F.lit(0)) <= 0, F.lit(NO_RECOMMENDATIONS))
    )
    return F.struct(
        F.when(error.isNull(), hypothesis).alias("hypothesis"),
        F.when(error.isNull(), advice).alias("recommendations"),
        error.alias("error"),
    )


def classify_provider_error(message: Column) -> Column:
    shown = message
    for found, text in reversed(PROVIDER_ERRORS):
        shown = F.when(F.contains(message, F.lit(found)), F.lit(text)).otherwise(shown)
    return shown


Suggester = Callable[[Sequence[str]], Sequence[tuple[str | None, str | None]]]

ASK_ROWS = 16  # prompts handed over at a time


def _in_order(parts: DataFrame) -> DataFrame:
    """The parts of each prompt in one partition, in order.

    Dealt by a hash of the id. By the id itself Spark may leave this shuffle out, as
    headers and pages come from joins by id; but those may still turn into broadcast
    joins while the query runs, and a header then lies apart from its pages.
    """
    return parts.select("id", "part", "text").repartition(F.xxhash64("id")).sortWithinPartitions("id", "part")


def ask_suggester(parts: DataFrame, suggester: Suggester, instructions: str = DEFAULT_INSTRUCTIONS) -> DataFrame:
    """Run a user function over the whole prompts of ``parts`` (id, part, text): (answer, error) for each id.

    Parts of an incident stream past in order and are joined in the task, so a
    prompt of any number of pages is asked whole and no stored row grows. Only
    sessions without a rule match should come here.
    """
    ordered = _in_order(parts)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str]]:
        current, texts = None, []
        for batch in batches:
            for id_, text in zip(batch["id"], batch["text"], strict=True):
                if texts and id_ != current:
                    yield current, "".join(texts)
                    texts = []
                current = id_
                texts.append(text or "")
        if texts:
            yield current, "".join(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(held):
            pairs = list(suggester([instructions + text for _, text in held]))
            return pd.DataFrame({"id": [i for i, _ in held], "answer": [a for a, _ in pairs], "provider_error": [e for _, e in pairs]})

        held = []
        for one in whole(batches):
            held.append(one)
            if len(held) == ASK_ROWS:
                yield ask(held)
                held = []
        if held:
            yield ask(held)

    return ordered.mapInPandas(run, "id string, answer string, provider_error string")


# Gets an incident's id and its prompt piece by piece; need not read it to the end.
PageSuggester = Callable[[str, Iterator[str]], tuple[str | None, str | None]]


def ask_by_pages(parts: DataFrame, suggester: PageSuggester, instructions: str = DEFAULT_INSTRUCTIONS) -> DataFrame:
    """As :func:`ask_suggester`, for prompts too long to lie in memory: (answer, error) for each id.

    The suggester reads the prompt from an iterator (the instructions, the header,
    then pages) over the Arrow batches of a sorted partition. A task holds one
    batch, whatever the length of a prompt; pages the suggester leaves unread are
    passed over. Joined, the pieces are the prompt :func:`ask_suggester` hands over.
    """
    ordered = _in_order(parts).drop("part")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None]]:
        for batch in batches:
            ids, texts = batch.columns
            for at in range(batch.num_rows):
                yield ids[at].as_py(), texts[at].as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id_, own in groupby(rows(batches), key=lambda row: row[0]):
            answer, error = suggester(id_, chain([instructions], (text or "" for _, text in own)))
            columns = [pa.array([value], pa.string()) for value in (id_, answer, error)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "answer", "provider_error"])

    return ordered.mapInArrow(run, "id string, answer string, provider_error string")


def attach_suggestions(unmatched: DataFrame, answers: DataFrame) -> DataFrame:
    """Hypotheses and recommendations of unmatched incidents from parsed answers.

    Incidents that were not asked get the plain fallback; with a provider error
    or an unusable answer the error text is its last recommendation.
    """
    parsed = answers.select(
        "id",
        classify_provider_error(F.col("provider_error")).alias("_provider"),
        parse_suggestion(F.col("answer")).alias("_parsed"),
        F.lit(True).alias("_asked"),
    )
    joined = unmatched.select("id").join(parsed, "id", "left")
    error = F.coalesce("_provider", F.col("_parsed.error"))
    usable = F.col("_asked").isNotNull() & error.isNull()
    return joined.select(
        "id",
        F.when(usable, F.array("_parsed.hypothesis")).otherwise(fallback_hypotheses()).alias("hypotheses"),
        F.when(usable, F.array_distinct("_parsed.recommendations"))
        .otherwise(F.array_distinct(fallback_recommendations(error)))
        .alias("recommendations"),
    )
