"""Label every unit as rule-bearing or plumbing, with a confidence and a reason."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import NL

# Labels, and the two reasons of the fallback label.
BUSINESS = "business_logic"
PIPELINE = "pipeline_code"
NO_MATCH = "No clear patterns matched, defaulting to pipeline_code"
BAD_ANSWER = "AI classification failed, defaulting to pipeline_code"

RESULT = ("classification", "confidence", "reason")


def _result(label: str, confidence: str | Column, reason: Column) -> Column:
    sure = F.lit(confidence) if isinstance(confidence, str) else confidence
    return F.struct(
        F.lit(label).alias("classification"), sure.alias("confidence"), reason.alias("reason")
    )


def scores(units: DataFrame) -> DataFrame:
    """Add ``business_score`` and ``pipeline_score``.

    The folded text is its own projection, so it is built once per row.
    """
    text = scoring.unit_text(F.col("name"), F.col("source_code"), F.col("description"))
    folded = F.col("__folded")
    return (
        units.withColumn("__folded", scoring.fold(text))
        .withColumn("business_score", scoring.score(folded, scoring.BUSINESS_PATTERNS))
        .withColumn("pipeline_score", scoring.score(folded, scoring.PIPELINE_PATTERNS))
        .drop("__folded")
    )


def _verdict() -> Column:
    """The decision ladder; null where neither side wins."""
    markers, b, p = F.col("markers"), F.col("business_score"), F.col("pipeline_score")

    def sure(n: Column) -> Column:
        return F.when(n >= 2, F.lit("high")).otherwise(F.lit("medium"))

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    return (
        F.when(
            F.size(markers) > 0,
            _result(
                BUSINESS,
                "high",
                text("Contains BUSINESS_RULE markers: ", F.array_join(markers, ", ")),
            ),
        )
        .when(
            (b > 0) & (p == 0),
            _result(BUSINESS, sure(b), text("Matches ", b, " business logic patterns")),
        )
        .when(
            (p > 0) & (b == 0),
            _result(PIPELINE, sure(p), text("Matches ", p, " pipeline code patterns")),
        )
        .when(
            b > p,
            _result(
                BUSINESS,
                "medium",
                text("Matches ", b, " business logic patterns vs ", p, " pipeline patterns"),
            ),
        )
        .when(
            p > b,
            _result(
                PIPELINE,
                "medium",
                text("Matches ", p, " pipeline patterns vs ", b, " business logic patterns"),
            ),
        )
    )


def _scored(units: DataFrame) -> DataFrame:
    """Scores only where they can decide: a marked unit needs none."""
    text = scoring.unit_text(F.col("name"), F.col("source_code"), F.col("description"))
    folded = F.col("__folded")
    return (
        units.withColumn("__folded", F.when(F.size("markers") == 0, scoring.fold(text)))
        .withColumn("business_score", scoring.score(folded, scoring.BUSINESS_PATTERNS))
        .withColumn("pipeline_score", scoring.score(folded, scoring.PIPELINE_PATTERNS))
        .withColumn("__verdict", _verdict())
        .drop("__folded", "business_score", "pipeline_score")
    )


def _default(reason: str = NO_MATCH) -> Column:
    return _result(PIPELINE, "low", F.lit(reason))


def request_text(limit: int | None = None) -> Column:
    """Question about one unit for an external classifier.

    The whole source is shown; ``limit`` cuts it after that many characters, for a
    classifier that takes no more.
    """
    shown = source = F.col("source_code")
    if limit is not None:
        shown = F.when(
            F.length(source) > limit,
            F.concat(F.substring(source, 1, limit), F.lit(f"{NL}... (truncated)")),
        ).otherwise(source)
    description = F.nullif(F.col("description"), F.lit(""))
    return F.concat_ws(
        NL,
        F.lit("Decide whether this code unit is 'business_logic' or 'pipeline_code'."),
        F.lit("business_logic: rules, thresholds, validation, scores and status values."),
        F.lit("pipeline_code: reading, writing or moving data, connections and set-up."),
        F.lit(""),
        F.concat(F.lit("Function: "), F.col("name")),
        F.concat(F.lit("Description: "), description),
        F.lit(""),
        F.lit("Source Code:"),
        F.lit("```"),
        shown,
        F.lit("```"),
        F.lit(""),
        F.lit("Answer with JSON only, in this form:"),
        F.lit(
            '{"classification": "business_logic" or "pipeline_code", "reason": "brief explanation"}'
        ),
    )


def ambiguous_requests(units: DataFrame, limit: int | None = None) -> DataFrame:
    """Units that neither markers nor scores decide, with the question to ask."""
    # an explode, not a filter: a filter would be pushed below the scores and
    # evaluate all of them again
    undecided = F.when(F.col("__verdict").isNull(), F.array(request_text(limit)))
    return _scored(units).select(*units.columns, F.explode(undecided).alias("request"))


def answer_result(response: Column) -> Column:
    """Result of one answer text; null answer (a failed call) gives the plain default."""
    found = F.regexp_extract(response, r"\{[\s\S]*\}", 0)
    # inside an array the parser has to reach the end of the text, so text after
    # a closed object makes the answer invalid
    parsed = F.get(
        F.from_json(
            F.concat(F.lit("["), found, F.lit("]")),
            "array<struct<classification:string,reason:string>>",
            {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"},
        ),
        F.lit(0),
    )
    reason = F.concat(F.lit("AI: "), F.coalesce(parsed["reason"], F.lit("undefined")))
    return (
        F.when(response.isNull(), _default())
        .when(parsed["classification"] == BUSINESS, _result(BUSINESS, "medium", reason))
        .when(parsed["classification"] == PIPELINE, _result(PIPELINE, "medium", reason))
        .otherwise(_default(BAD_ANSWER))
    )


def parse_answers(answers: DataFrame, response: str = "response") -> DataFrame:
    """Add label, confidence and reason read from answer texts."""
    return (
        answers.withColumn("__result", answer_result(F.col(response)))
        .select("*", *[F.col(f"__result.{c}") for c in RESULT])
        .drop("__result")
    )


def _asker(ask: Callable[[str], str]):
    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(request: str | None) -> str | None:
            if request is None:
                return None
            try:
                return ask(request)
            except Exception:  # a failed call must not fail the run
                return None

        for batch in batches:
            yield batch.map(one, na_action="ignore").astype("object")

    return answers.asNondeterministic()


def classify(
    units: DataFrame,
    ambiguous: Callable[[str], str] | None = None,
    partitions: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Add ``classification``, ``confidence`` and ``reason`` to every unit.

    ``ambiguous`` is asked about undecided units only: it gets the request text
    and returns the answer text. Other rows send a null to the Python worker, so
    the corpus is read once. ``partitions`` bounds the number of calls at a time,
    ``limit`` the characters of source in a request (the whole source without it).
    Keep the result in a table before using it twice, or calls are repeated.
    """
    verdict = F.col("__verdict")
    scored = _scored(units)
    if ambiguous is None:
        result = F.coalesce(verdict, _default())
    else:
        if partitions is not None:
            scored = scored.repartition(partitions)
        request = F.when(verdict.isNull(), request_text(limit))
        scored = scored.withColumn("__answer", _asker(ambiguous)(request))
        result = F.coalesce(verdict, answer_result(F.col("__answer")))
    # inline of one element instead of struct fields: a later filter on the label
    # stays above it and does not drag copies of the scores below
    return scored.select(*units.columns, F.inline(F.array(result)))


def label_counts(units: DataFrame) -> DataFrame:
    """Number of units per kind and label."""
    return units.groupBy("kind", "classification").agg(F.count("*").alias("n"))
