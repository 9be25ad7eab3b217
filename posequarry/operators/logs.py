"""Classification of run logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequarry.fixed_values import ENGINE_RULES, LOG_RULES
from posequarry.functions.text import last_word

Rules = Mapping[str, Sequence[str]]


def classify_jobs(
    lines: DataFrame, rules: Rules = LOG_RULES, union: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """One boolean per rule and job: does any line hold one of its phrases?

    ``union`` adds classes made of several rules.  Booleans combine map-side, so
    a job with very many lines costs no more shuffle than a small one.
    """
    union = {"engine_error": ENGINE_RULES} if union is None else union
    line = F.col("line")
    flags = [
        F.bool_or(reduce(lambda a, b: a | b, [line.contains(p) for p in phrases])).alias(name)
        for name, phrases in rules.items()
    ]
    jobs = lines.groupBy("job").agg(*flags)
    return jobs.withColumns(
        {name: reduce(lambda a, b: a | b, [F.col(p) for p in parts]) for name, parts in union.items()}
    )


def class_totals(jobs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Jobs per class, jobs in any class, and all jobs."""
    return jobs.agg(
        *[F.count_if(F.col(c)).alias(c) for c in classes],
        F.count_if(_in_any(classes)).alias("classified"),
        F.count(F.lit(1)).alias("jobs"),
    )


def _in_any(classes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c) for c in classes])


def jobs_in(jobs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Set union of classes; jobs are unique, so one filter is enough."""
    return jobs.where(_in_any(classes)).select("job")


def unclassified_jobs(jobs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Set difference: every job minus the classified ones."""
    return jobs.where(~_in_any(classes)).select("job")


def first_match(lines: DataFrame, phrase: str, order: Sequence[str] = ("line_no",)) -> DataFrame:
    """(job, token): last word of the first line holding the phrase.

    Every job is listed; one without a match has no token.
    """
    matching = lines.where(F.col("line").contains(phrase))
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    found = matching.groupBy("job").agg(F.min_by(last_word(F.col("line")), position).alias("token"))
    return lines.select("job").distinct().join(found, "job", "left")
