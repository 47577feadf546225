"""Coverage of sources: runs, editorial funnels, health, gaps, domains, deadlines of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestar.functions.ids import valid_hostname
from lodestar.functions.text import norm_ws
from lodestar.session import small

#: Days and approvals of an emerging domain, minutes after which a job is stuck, hours between runs of a channel that names none.
EMERGING_DAYS, EMERGING_LEAST, STUCK_MINUTES, INTERVAL_HOURS, UNASSIGNED = 90, 2, 90, 24, "__unassigned__"


def run_metrics(runs: DataFrame) -> DataFrame:
    """Per source_key: last start, last success, sums that stay null where nothing was observed, and the yield."""
    g = runs.groupBy("source_key").agg(
        F.max("started_at").alias("last_started"), F.max(F.when(F.col("status") == "succeeded", F.col("completed_at"))).alias("last_success"),
        F.sum("records_observed").alias("observed"), F.sum("records_emitted").alias("emitted"), F.sum("records_staged").alias("staged"), F.sum("error_count").alias("errors"))
    return g.withColumn("yield", F.try_divide(F.col("staged"), F.nullif(F.col("emitted"), F.lit(0))))


def approval_rate(approved: Column, rejected: Column) -> Column:
    """Approved of reviewed; null without reviews."""
    return F.try_divide(approved, approved + rejected)


def funnel(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Per key of a dimension, those without rows included, and __unassigned__: approved, rejected, pending, rate, mean review hours.

    rows: (key, status, created_at, reviewed_at). Reviews before creation don't
    count for the hours.
    """
    named = rows.join(small(keys.select(F.col(key).alias("_k"))), F.col(key) == F.col("_k"), "left").withColumn("_k", F.coalesce("_k", F.lit(UNASSIGNED)))
    hours = (F.unix_micros(F.col("reviewed_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(3_600_000_000.0)
    g = named.groupBy("_k").agg(F.count_if(F.col("status") == "promoted").alias("approved"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("status") == "pending").alias("pending"), F.avg(F.when(hours >= 0, hours)).alias("review_hours"))
    all_keys = keys.select(F.col(key).alias("_k")).unionByName(named.where(F.col("_k") == UNASSIGNED).select("_k").distinct())
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return all_keys.join(g, "_k", "left").select(F.col("_k").alias(key), zero("approved"), zero("rejected"), zero("pending"), approval_rate(F.coalesce("approved", F.lit(0)), F.coalesce("rejected", F.lit(0))).alias("approval_rate"), "review_hours")


def observable(observed: Column, staged: Column) -> Column:
    """Whether a run shows that it saw something."""
    return F.coalesce(observed > 0, F.lit(False)) | F.coalesce(staged > 0, F.lit(False))


def _hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3_600_000_000.0)


def _last_run(runs: DataFrame) -> DataFrame:
    place = Window.partitionBy("source_key").orderBy(F.desc_nulls_last("started_at"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(place)).where("_n = 1").select("source_key", F.col("status").alias("last_status"), F.col("completed_at").alias("last_completed"), observable(F.col("records_observed"), F.col("records_staged")).alias("last_seen"))


def channel_health(channels: DataFrame, runs: DataFrame, reference: Column) -> DataFrame:
    """Health of channels (source_key, enabled, interval_hours): disabled, failing, degraded, stale, healthy or unknown."""
    seen = observable(F.col("records_observed"), F.col("records_staged"))
    good = runs.groupBy("source_key").agg(F.max(F.when((F.col("status") == "succeeded") & seen, F.col("completed_at"))).alias("last_good"))
    j = channels.join(_last_run(runs), "source_key", "left").join(good, "source_key", "left")
    since, interval = _hours(reference, F.col("last_completed")), F.coalesce("interval_hours", F.lit(INTERVAL_HOURS))
    health = (
        F.when(~F.col("enabled"), "disabled").when(F.col("last_status").isNull(), "unknown").when(F.col("last_status") == "failed", "failing").when(F.col("last_status") == "partial", "degraded")
        .when(_hours(reference, F.col("last_good")) >= 2 * interval, "stale")
        .when((F.col("last_status") == "succeeded") & F.col("last_seen") & (since >= 0) & (since <= interval), "healthy").otherwise("unknown"))
    return j.select("source_key", health.alias("health"))


def gaps(channels: DataFrame, runs: DataFrame, discovered: DataFrame, families: DataFrame, reference: Column) -> DataFrame:
    """Gaps (source_key, signal): channels without a run, runs that show nothing, late ones, families without reviews, a queue."""
    j = channels.join(_last_run(runs), "source_key", "left")
    signal = lambda rows, name, key="source_key": rows.select(F.col(key).cast("string").alias("source_key"), F.lit(name).alias("signal"))
    ran = j.where("last_status IS NOT NULL")
    reviewed = discovered.where("status IN ('promoted', 'rejected')").select(F.col("family").alias("query_family"))
    pending = discovered.where("status = 'pending'").limit(1).select(F.lit(None).cast("string").alias("source_key"))
    return (
        signal(j.where("enabled AND last_status IS NULL"), "enabled_no_run")
        .unionByName(signal(ran.where("last_status IN ('succeeded', 'partial') AND NOT last_seen"), "ambiguous_run"))
        .unionByName(signal(ran.where("enabled").where(_hours(reference, F.col("last_completed")) > F.coalesce("interval_hours", F.lit(INTERVAL_HOURS))), "delayed"))
        .unionByName(signal(families.join(reviewed, "query_family", "left_anti"), "family_no_denominator", "query_family"))
        .unionByName(signal(pending, "pending_queue"))
    )


def emerging_domains(discovered: DataFrame, reference: Column, days: int = EMERGING_DAYS, least: int = EMERGING_LEAST) -> DataFrame:
    """Domains of promoted rows (domain, status, reviewed_at) of the last days: count, first, last, and whether there are enough."""
    some = discovered.where("status = 'promoted'").withColumn("domain", valid_hostname(F.col("domain"))).where("domain IS NOT NULL").where((F.col("reviewed_at") >= reference - F.expr(f"INTERVAL {days} DAYS")) & (F.col("reviewed_at") <= reference))
    return some.groupBy("domain").agg(F.count("*").alias("approvals"), F.min("reviewed_at").alias("first_approved"), F.max("reviewed_at").alias("last_approved")).withColumn("candidate", F.col("approvals") >= least)


def dead_man(tasks: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Tasks (task, sla_minutes) with their latest run and last success, late without one in time."""
    g = runs.groupBy("task").agg(F.max_by("run_id", F.struct("scheduled_at", "run_id")).alias("latest_run"), F.max(F.when(F.col("status").isin("succeeded", "partial"), F.col("completed_at"))).alias("last_success"))
    j = tasks.join(g, "task", "left")
    return j.select("task", "latest_run", "last_success", F.coalesce(_hours(now, F.col("last_success")) * 60 > F.col("sla_minutes"), F.lit(True)).alias("late"))


def classify_jobs(jobs: DataFrame, events: DataFrame, workers: DataFrame, now: Column, minutes: int = STUCK_MINUTES) -> DataFrame:
    """One row: jobs (job_id, status, worker_id) that are doing, stuck (started long ago without a heartbeat since) and failed."""
    started = events.where("type = 'started'").groupBy("job_id").agg(F.max("at").alias("started"))
    j = jobs.join(started, "job_id", "left").join(workers.select("worker_id", "last_heartbeat"), "worker_id", "left")
    old = F.coalesce(_hours(now, F.col("started")) * 60 > minutes, F.lit(False))
    silent = F.coalesce(_hours(now, F.col("last_heartbeat")) * 60 > minutes, F.lit(True))
    doing = F.col("status") == "doing"
    return j.agg(F.count_if(doing & ~(old & silent)).alias("doing"), F.count_if(doing & old & silent).alias("stuck"), F.count_if(F.col("status") == "failed").alias("failed"))


def incidents(observations: DataFrame) -> DataFrame:
    """Observations (fingerprint, at, active) that open an incident or end it: (fingerprint, at, transition)."""
    before = F.lag("active").over(Window.partitionBy("fingerprint").orderBy("at", "seq"))
    change = F.when(F.col("active") & ~F.coalesce(before, F.lit(False)), "open").when(~F.col("active") & F.coalesce(before, F.lit(False)), "recovered")
    return observations.withColumn("transition", change).where("transition IS NOT NULL").select("fingerprint", "at", "seq", "transition")


def bundle_diagnostics(bundles: DataFrame) -> DataFrame:
    """Per subject (subject, bundle_hash, role, has_lineage): versions, documents, and the share with lineage, null without documents."""
    return bundles.groupBy("subject").agg(F.countDistinct("bundle_hash").alias("versions"), F.count("role").alias("documents"), F.try_divide(F.count_if(F.col("has_lineage")), F.count("role")).alias("lineage_rate"), F.count_if(F.col("role") == "official").alias("official"))


def unknown_themes(rows: DataFrame, vocabulary: DataFrame, examples: int = 10) -> DataFrame:
    """Themes (source, example, themes joined by ;) outside a vocabulary (theme): count, sources and some examples in order."""
    one = rows.select("source", "example", F.explode(F.split("themes", ";")).alias("t")).withColumn("theme", F.lower(norm_ws(F.col("t")))).where("theme <> ''")
    other = one.join(small(vocabulary.select("theme")), "theme", "left_anti")
    totals = other.groupBy("theme").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"))
    # Only the first examples of a theme are gathered.
    first = F.row_number().over(Window.partitionBy("theme").orderBy("example"))
    shown = other.where("example is not null").select("theme", "example").distinct().withColumn("_n", first).where(F.col("_n") <= examples)
    told = shown.groupBy("theme").agg(F.array_sort(F.collect_list("example")).alias("examples"))
    return totals.join(told, "theme", "left").select("theme", "n", "n_sources", F.coalesce("examples", F.slice(F.array(F.lit("")), 1, 0)).alias("examples"))


def without_themes(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (id, themes) without a theme: the first ones, for a report."""
    return rows.where(norm_ws(F.col("themes")) == "").orderBy("id").limit(limit)


def clean_metrics(metrics: Column) -> Column:
    """Entries of a map that have a safe name and a finite number of zero or more."""
    return F.map_filter(metrics, lambda k, v: k.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v != F.lit(float("inf"))))


def start_runs(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Runs (batch, source_key) to open: those that aren't there; an existing one is never opened again."""
    return wanted.dropDuplicates(["batch", "source_key"]).join(runs.select("batch", "source_key"), ["batch", "source_key"], "left_anti").withColumn("status", F.lit("running"))


def finish_runs(runs: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs with their final status (run_id, final); one that has ended stays as it is."""
    j = runs.join(finished, "run_id", "left")
    return j.withColumn("status", F.when((F.col("status") == "running") & F.col("final").isNotNull(), F.col("final")).otherwise(F.col("status"))).drop("final")


def overall_status(stages: Column, last: str) -> Column:
    """failed if any stage failed, done if the last is, else running."""
    failed = F.exists(F.map_values(stages), lambda s: s == "failed")
    return F.when(failed, "failed").when(F.try_element_at(stages, F.lit(last)) == "done", "completed").otherwise("running")
