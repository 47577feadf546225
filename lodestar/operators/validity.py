"""Temporal validity, exceptions and their reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestar.functions.dates import age_days, fractional_days

#: Statuses that mean open and closed.
OPEN, CLOSED = ("aberta",), ("encerrada", "resultado_divulgado", "fechada", "closed", "finished")
CONFLICT, BASELESS, MISSING = "temporal_status_conflict", "temporal_status_without_basis", "critical_fact_missing"


def evaluate(deadline: Column, status: Column, as_of: Column, continuous: Column) -> Column:
    """Struct (mode, validity, issue) of a deadline, a status and evidence of continuous flow.

    Conflicts come first; a deadline decides next, then evidence, then status.
    """
    said = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    is_open, is_closed = said.isin(*OPEN), said.isin(*CLOSED)
    dated, flows = deadline.isNotNull(), F.coalesce(continuous, F.lit(False))
    future, past = dated & (deadline >= as_of), dated & (deadline < as_of)
    out = lambda mode, validity, issue=None: F.struct(F.lit(mode).alias("mode"), F.lit(validity).alias("validity"), F.lit(issue).cast("string").alias("issue"))
    return (
        F.when(dated & flows, out("unknown", "needs_review", CONFLICT))
        .when(is_closed & flows, out("unknown", "needs_review", CONFLICT))
        .when(future & is_closed, out("fixed", "needs_review", CONFLICT))
        .when(past & is_open, out("fixed", "needs_review", CONFLICT))
        .when(future, out("fixed", "active"))
        .when(past, out("fixed", "closed"))
        .when(flows, out("continuous", "active"))
        .when(is_closed, out("unknown", "closed"))
        .when(is_open, out("unknown", "needs_review", BASELESS))
        .otherwise(out("unknown", "needs_review", MISSING))
    )


def fingerprint(deadline: Column, status: Column, *more: Column) -> Column:
    """SHA-256 of the inputs of an evaluation; null and empty differ."""
    return F.sha2(F.to_json(F.struct(F.coalesce(deadline.cast("string"), F.lit("~")).alias("deadline"), F.coalesce(F.concat(F.lit("="), status), F.lit("~")).alias("status"), *more)), 256)


def exceptions_of(subjects: DataFrame, as_of: Column) -> DataFrame:
    """Rows (subject_id, issue, input_fingerprint) of subjects (subject_id, deadline, status, continuous) whose evaluation has an issue."""
    told = subjects.withColumn("e", evaluate(F.col("deadline"), F.col("status"), as_of, F.col("continuous")))
    return told.where("e.issue is not null").select("subject_id", F.col("e.issue").alias("issue"), fingerprint(F.col("deadline"), F.col("status")).alias("input_fingerprint"))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key in an order that is total."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[o.desc_nulls_last() for o in order]))).where("_n = 1").drop("_n")


def read_models(subjects: DataFrame, exceptions: DataFrame, reviews: DataFrame, as_of: Column) -> DataFrame:
    """Public validity of subjects: rows (subject_id, mode, validity, origin).

    Without a standing exception of the same inputs the evaluation holds; a
    resolved one with a review takes the review; others need review.
    exceptions: (exception_id, subject_id, input_fingerprint, status,
    last_observed); reviews: (review_id, exception_id, decision, value,
    created).
    """
    told = subjects.withColumns({"e": evaluate(F.col("deadline"), F.col("status"), as_of, F.col("continuous")), "fp": fingerprint(F.col("deadline"), F.col("status"))})
    standing = latest(exceptions.where("status <> 'superseded'"), ["subject_id", "input_fingerprint"], F.col("last_observed"), F.col("exception_id"))
    standing = standing.select("exception_id", F.col("subject_id").alias("s"), F.col("input_fingerprint").alias("f"), F.col("status").alias("exception_status"))
    last = latest(reviews, ["exception_id"], F.col("created"), F.col("review_id")).select("exception_id", "decision", "value")
    joined = told.join(standing, (told.subject_id == standing.s) & (told.fp == standing.f), "left").join(last, "exception_id", "left")
    reviewed = (F.col("exception_status") == "resolved") & F.col("decision").isNotNull()
    mode, validity = review_state(F.col("decision"), F.try_to_date(F.col("value")), F.col("status"), as_of)
    return joined.select(
        "subject_id",
        F.when(F.col("exception_id").isNull(), F.col("e.mode")).when(reviewed, mode).otherwise(F.lit("unknown")).alias("mode"),
        F.when(F.col("exception_id").isNull(), F.col("e.validity")).when(reviewed, validity).otherwise(F.lit("needs_review")).alias("validity"),
        F.when(F.col("exception_id").isNull(), "evaluation").when(reviewed, "review").otherwise("exception").alias("origin"),
    )


def review_state(decision: Column, value: Column, status: Column, as_of: Column) -> tuple[Column, Column]:
    """Mode and validity that a human decision gives."""
    mode = F.when(decision == "confirm_continuous", "continuous").when((decision != "mark_unknown") & value.isNotNull(), "fixed").otherwise("unknown")
    validity = (
        F.when(decision == "mark_unknown", "needs_review")
        .when(decision == "confirm_continuous", "active")
        .when(value.isNotNull(), F.when(value >= as_of, "active").otherwise("closed"))
        .otherwise("closed")
    )
    return mode, validity


def observe(exceptions: DataFrame, keys: list[str]) -> DataFrame:
    """Exceptions with the status that the log of observations gives them.

    Rows are observations (keys, input_fingerprint, observed, event_id). Equal
    fingerprints are one exception, seen from first to last; of a key's, the
    one seen last is open and the others are superseded.
    """
    seen = exceptions.groupBy(*keys, "input_fingerprint").agg(F.min("observed").alias("detected"), F.max("observed").alias("last_observed"), F.max(F.struct("observed", "event_id")).alias("_last"), F.count("*").alias("n_observed"))
    newest = F.max("_last").over(Window.partitionBy(*keys))
    return seen.withColumn("status", F.when(F.col("_last") == newest, "open").otherwise("superseded")).drop("_last")


def ages(exceptions: DataFrame, as_of: Column) -> DataFrame:
    """Age in local days of open exceptions (exception_id, status, detected)."""
    return exceptions.where(F.lower(F.trim("status")) == "open").where("detected is not null").select("exception_id", age_days(F.col("detected"), as_of).alias("age_days"))


def latency(exceptions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Days from detection to the last review: rows (exception_id, days)."""
    last = latest(reviews, ["exception_id"], F.col("reviewed"), F.col("seq"))
    return exceptions.join(last, "exception_id").where("detected is not null and reviewed is not null").select("exception_id", fractional_days(F.col("detected"), F.col("reviewed")).alias("days"))


def reopened(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose fingerprint is not among those of earlier resolved rows of their key, of which there is one.

    rows: (keys, detected, observed, seq, input_fingerprint, status).
    """
    before = lambda *by: Window.partitionBy(*by).orderBy("detected", "observed", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # Running counts, so that no row holds what came before it.
    solved = F.count_if(F.lower(F.trim("status")) == "resolved")
    said = rows.where("trim(input_fingerprint) <> ''").withColumns({"_any": solved.over(before(*keys)), "_same": solved.over(before(*keys, "input_fingerprint"))})
    return said.where("_any > 0 and _same = 0").drop("_any", "_same")


def prevented(exceptions: DataFrame, reviews: DataFrame, as_of: Column) -> DataFrame:
    """Exceptions on deadlines that looked active before and aren't after review."""
    last = latest(reviews, ["exception_id"], F.col("reviewed"), F.col("seq")).select("exception_id", "decision", "corrected")
    joined = exceptions.where(F.lower(F.trim("field_path")) == "deadline").join(last, "exception_id", "left")
    day = F.try_to_date(F.col("produced"))
    looked = F.coalesce(day >= as_of, F.lower(F.trim("produced")).isin(*OPEN))
    final = F.try_to_date(F.when(F.col("decision") == "correct", F.col("corrected")).otherwise(F.col("produced")))
    active = F.coalesce((F.lower(F.trim("status")) == "resolved") & F.when(F.col("decision") == "confirm_continuous", True).when(F.col("decision") == "mark_unknown", False).otherwise(final >= as_of), F.lit(False))
    return joined.where(looked & ~active).select("exception_id", "subject_id")


def counts(rows: DataFrame, key: str) -> DataFrame:
    """Rows by a normal form of a key; empty and null are unknown."""
    return rows.groupBy(F.coalesce(F.nullif(F.lower(F.trim(F.col(key))), F.lit("")), F.lit("unknown")).alias(key)).agg(F.count("*").alias("n"))


def counts_exploded(rows: DataFrame, key: str) -> DataFrame:
    """Rows by each distinct value of an array; a row without one counts as unknown."""
    values = F.array_distinct(F.filter(F.transform(F.coalesce(F.col(key), F.array()), lambda v: F.lower(F.trim(v))), lambda v: (v != "") & (v != "unknown")))
    return rows.select(F.explode(F.when(F.size(values) > 0, values).otherwise(F.array(F.lit("unknown")))).alias(key)).groupBy(key).agg(F.count("*").alias("n"))


def drift(profiles: DataFrame, items: DataFrame, as_of: Column, days: int = 90, least: int = 3) -> DataFrame:
    """Profiles (workspace, updated) that are so many days old with so many newer items (workspace, created)."""
    newer = items.join(profiles.select(F.col("workspace"), "updated"), "workspace").where("created > updated").groupBy("workspace").agg(F.count("*").alias("new_items"))
    out = profiles.join(newer, "workspace", "left").select("workspace", F.datediff(as_of, "updated").alias("days_since"), F.coalesce("new_items", F.lit(0)).alias("new_items"))
    return out.withColumn("stale", (F.col("days_since") >= days) & (F.col("new_items") >= least))


def days_remaining(deadline: Column, as_of: Column) -> tuple[Column, Column]:
    """Days to a deadline, and whether it has passed."""
    return F.datediff(deadline, as_of), deadline < as_of
