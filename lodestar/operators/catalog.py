"""Catalog listings, sessions and job queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestar.functions.dates import civil_day
from lodestar.session import few

#: Sections of an outline at most.
MOST_SECTIONS = 1000


def related_names(edges: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """Sorted distinct names of the targets of each source: (src, names)."""
    named = edges.where(F.col("type") == kind).join(entities.select(F.col("id").alias("dst"), "name"), "dst")
    return named.groupBy("src").agg(F.array_sort(F.collect_set("name")).alias("names"))


def list_calls(entities: DataFrame, status: str | None, theme: Column | None, limit: int) -> DataFrame:
    """Calls (id, title, status, themes) with open ones first, then by title; a listing has a limit."""
    rows = entities if status is None else entities.where(F.col("status") == status)
    rows = rows if theme is None else rows.where(theme)
    return rows.orderBy(F.col("status") != "ABERTA", F.lower("title"), "id").limit(limit)


def resolve_native(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """Ids of references: equal, else the only one that ends in :ref; null if there are several."""
    exact = refs.join(entities.select("id"), F.col("ref") == F.col("id")).select("ref", "id")
    suffix = entities.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("id", ":"))), lambda k: F.array_join(F.slice(F.split("id", ":"), k, 99), ":"))).alias("ref")).where("ref <> id")
    only = refs.join(suffix, "ref").groupBy("ref").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("ref", F.col("id").alias("sid"))
    return refs.join(exact, "ref", "left").join(only, "ref", "left").select("ref", F.coalesce("id", "sid").alias("id"))


def union_kinds(**kinds: DataFrame) -> DataFrame:
    """Rows of several kinds with a kind column; columns that one lacks are null."""
    out = None
    for kind, rows in kinds.items():
        named = rows.withColumn("kind", F.lit(kind))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def stats(entities: DataFrame) -> DataFrame:
    """Rows (what, value, n): entities by kind and by status, distinct themes and sources."""
    by = lambda c: entities.groupBy(F.coalesce(F.col(c), F.lit("")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("what"), "value", "n")
    themes = entities.select(F.explode("themes").alias("t")).agg(F.countDistinct("t").alias("n")).select(F.lit("themes").alias("what"), F.lit("").alias("value"), "n")
    sources = entities.agg(F.countDistinct("source").alias("n")).select(F.lit("sources").alias("what"), F.lit("").alias("value"), "n")
    return by("kind").unionByName(by("status")).unionByName(themes).unionByName(sources)


def cards(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entities with a wanted id."""
    return entities.join(wanted.select("id"), "id", "left_semi")


def titles(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Trimmed titles of wanted ids; blank ones are left out."""
    return cards(entities, wanted).select("id", F.trim("title").alias("title")).where("title <> ''")


def search_items(items: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Items (title, kind, archived, created) that aren't archived and have a text in their title, newest first."""
    pattern = "%" + query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    rows = items.where("archived IS NULL").where(F.col("title").ilike(pattern))
    return (rows if kind is None else rows.where(F.col("kind") == kind)).orderBy(F.desc("created"), "id")


def applications(log: DataFrame, sessions: DataFrame, cards_: DataFrame, as_of: Column) -> DataFrame:
    """Applications (application, session, card) with days left and progress in per cent, newest first."""
    j = log.join(sessions.select("session", "filled", "outline"), "session", "left").join(cards_.select("card", "title", "deadline"), "card", "left")
    progress = F.bround(F.try_divide(F.lit(100.0) * F.col("filled"), F.nullif(F.col("outline"), F.lit(0)))).cast("int")
    return j.select("application", "title", F.datediff("deadline", civil_day(as_of)).alias("days_left"), F.coalesce(progress, F.lit(0)).alias("progress"), "updated").orderBy(F.desc("updated"), "application")


def sessions_with_turns(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions with their turns, two rows a turn."""
    counted = turns.groupBy("session").agg(F.count("*").alias("n"))
    return sessions.join(counted, "session", "left").withColumn("turn_count", F.floor(F.coalesce("n", F.lit(0)) / 2)).drop("n")


def next_turn(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """The turn after the last of each session, 1 for a new one."""
    last = turns.groupBy("session").agg(F.max("turn").alias("last"))
    return sessions.join(last, "session", "left").select("session", (F.coalesce("last", F.lit(0)) + 1).alias("next_turn"))


def stale_threads(rows: DataFrame, now: Column, days: int) -> DataFrame:
    """Threads (thread, at) without a row for some days."""
    return rows.groupBy("thread").agg(F.max("at").alias("last")).where(F.col("last") < now - F.expr(f"INTERVAL {days} DAYS"))


def purge(rows: DataFrame, stale: DataFrame) -> DataFrame:
    """Rows of threads that aren't stale."""
    return rows.join(stale.select("thread"), "thread", "left_anti")


def active_insights(insights: DataFrame, limit: int = 6) -> DataFrame:
    """Insights in force, the highest and newest first: a report of a few."""
    return insights.where("deactivated_at IS NULL").orderBy(F.desc("level"), F.desc("created"), "id").limit(limit)


def outcomes(log: DataFrame, terminal: tuple[str, ...], limit: int) -> DataFrame:
    """Applications that have ended, newest first."""
    return log.where(F.col("status").isin(*terminal)).orderBy(F.desc("updated"), "id").limit(limit)


def new_generation(insights: DataFrame, made: DataFrame, now: Column) -> DataFrame:
    """Insights with those of level 2 put out of force and new ones in their place."""
    old = insights.withColumn("deactivated_at", F.when((F.col("level") == 2) & F.col("deactivated_at").isNull(), now).otherwise(F.col("deactivated_at")))
    return old.unionByName(made)


def checklist(proposals: DataFrame, outline: DataFrame, shallow: int = 200) -> DataFrame:
    """Sections of an outline (section) in Markdown proposals (proposal, text): empty, shallow or adequate, and a score of 0 to 100."""
    parts = proposals.select("proposal", F.explode(F.split("text", r"(?m)^(?=#{1,6}[ \t])")).alias("p"))
    parsed = parts.select("proposal", F.lower(F.trim(F.regexp_extract("p", r"^#{1,6}[ \t]+([^\n]*)", 1))).alias("section"), F.length(F.trim(F.regexp_replace(F.regexp_extract("p", r"(?s)^[^\n]*\n(.*)$", 1), r"\[[^\]]*\]|_{3,}|\s+", " "))).alias("n"))
    grid = proposals.select("proposal").join(few(outline.select(F.lower("section").alias("section")), MOST_SECTIONS))
    j = grid.join(parsed.groupBy("proposal", "section").agg(F.max("n").alias("n")), ["proposal", "section"], "left")
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "empty").when(F.col("n") < shallow, "shallow").otherwise("adequate")
    worth = F.when(F.col("state") == "adequate", 1.0).when(F.col("state") == "shallow", 0.5).otherwise(0.0)
    return j.withColumn("state", state).withColumn("score", F.floor(100 * F.avg(worth).over(Window.partitionBy("proposal")))).select("proposal", "section", "state", "score")


def intent(text: Column, rules: list[tuple[str, str]], fallback: str) -> Column:
    """The first intent whose pattern a message has."""
    out = F.lit(fallback)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def usage(payload: Column) -> dict[str, Column]:
    """Token counts of a provider's JSON, by either naming; what is absent is null, not zero."""
    pick = lambda *paths: F.coalesce(*[F.get_json_object(payload, p).try_cast("long") for p in paths])
    return {"input_tokens": pick("$.input_tokens", "$.prompt_tokens"), "output_tokens": pick("$.output_tokens", "$.completion_tokens"), "cached_tokens": pick("$.cached_tokens", "$.prompt_tokens_details.cached_tokens")}


def playbook(layers: DataFrame) -> DataFrame:
    """Sections of layers (section, layer, text) joined in order of layer."""
    one = F.array_sort(F.collect_list(F.struct("layer", "text")))
    return layers.groupBy("section").agg(F.array_join(F.transform(one, lambda x: x["text"]), "\n\n").alias("text"))


def fetch_job(jobs: DataFrame, now: Column) -> DataFrame:
    """The next job (job_id, status, priority, lock, due): to do, due, and without a running or earlier job of its lock."""
    waiting = jobs.where("status = 'todo'")
    blocking = jobs.where("status IN ('todo', 'doing')").select(F.col("lock").alias("l"), F.col("job_id").alias("j"), F.col("status").alias("s"))
    held = waiting.join(blocking, (F.col("lock") == F.col("l")) & ((F.col("s") == "doing") | (F.col("j") < F.col("job_id"))), "left_anti")
    return held.where(F.col("due").isNull() | (F.col("due") <= now)).orderBy(F.desc("priority"), "job_id").limit(1)


def defer_jobs(jobs: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """New jobs with ids after the last one."""
    last = jobs.agg(F.coalesce(F.max("job_id"), F.lit(0)).alias("last"))
    return new.join(F.broadcast(last)).withColumn("job_id", F.col("last") + F.row_number().over(Window.orderBy(*order))).drop("last")


def defer_periodic(deferred: DataFrame, new: DataFrame) -> DataFrame:
    """Deferrals (task, periodic, at) that weren't made and are newer than the last of their task."""
    last = deferred.groupBy("task", "periodic").agg(F.max("at").alias("last"))
    return new.dropDuplicates(["task", "periodic", "at"]).join(last, ["task", "periodic"], "left").where(F.col("last").isNull() | (F.col("at") > F.col("last"))).drop("last")


def finish_job(status: Column, attempts: Column, final: Column) -> tuple[Column, Column]:
    """Status and attempts of a job that ends: only one that is doing counts an attempt; ended ones stay."""
    live = status.isin("todo", "doing")
    return F.when(live, final).otherwise(status), F.when(status == "doing", attempts + 1).otherwise(attempts)


def cancel_job(status: Column, abort: Column) -> Column:
    """cancelled if it waits, aborting if it runs and may be stopped."""
    return F.when(status == "todo", "cancelled").when((status == "doing") & abort, "aborting").otherwise(status)


def retry_job(status: Column, attempts: Column) -> tuple[Column, Column]:
    """A running or failed job as waiting again, with one attempt more."""
    again = status.isin("doing", "failed")
    return F.when(again, "todo").otherwise(status), F.when(again, attempts + 1).otherwise(attempts)


def live_workers(workers: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Workers whose last heartbeat isn't too old."""
    return workers.where(F.col("last_heartbeat") >= now - F.expr(f"INTERVAL {seconds} SECONDS"))


def transitions(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows (key, status) whose status is not that of the row before, nulls alike; the first row of a key is one."""
    place = Window.partitionBy(key).orderBy(*order)
    told = rows.withColumns({"_before": F.lag("status").over(place), "_n": F.row_number().over(place)})
    return told.where((F.col("_n") == 1) | ~F.col("status").eqNullSafe(F.col("_before"))).withColumn("from_status", F.col("_before")).drop("_before", "_n")


def save_turn(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Outcome of turns (session, request, version, payload) against sessions (session, version, last_request, last_payload)."""
    j = turns.join(sessions.withColumnsRenamed({"version": "_v", "last_request": "_r", "last_payload": "_p"}), "session", "left")
    return j.select("session", "request", F.when((F.col("request") == F.col("_r")) & F.col("payload").eqNullSafe(F.col("_p")), "replayed").when(F.col("version").eqNullSafe(F.col("_v")), "saved").otherwise("conflict").alias("outcome"))


def bump_if_changed(old: Column, new: Column, stamp: Column, now: Column) -> Column:
    """The stamp of a profile, renewed only if it changed."""
    return F.when(~new.eqNullSafe(old), now).otherwise(stamp)


def job_report(jobs: DataFrame, events: DataFrame, workers: DataFrame) -> DataFrame:
    """Jobs with first and last start, last end and the worker's heartbeat."""
    e = events.groupBy("job_id").agg(F.min(F.when(F.col("type") == "started", F.col("at"))).alias("first_started"), F.max(F.when(F.col("type") == "started", F.col("at"))).alias("last_started"), F.max(F.when(F.col("type").isin("succeeded", "failed"), F.col("at"))).alias("last_ended"))
    return jobs.join(e, "job_id", "left").join(workers.select("worker_id", "last_heartbeat"), "worker_id", "left")
