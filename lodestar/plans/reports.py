"""Queries on coverage, quality, scores, catalogs and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestar.operators import catalog as C, coverage as V, metrics as M, validity as T
from lodestar.operators.nearest import nearest
from lodestar.registry import REGISTRY, table
from lodestar.session import small

NOW = "2024-01-31 00:00:00"


def now():
    return F.to_timestamp(F.lit(NOW))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key, start = F.col("event_id"), F.col("ts").cast("timestamp")
    status = F.when(key % 5 == 0, "failed").when(key % 7 == 0, "partial").when(key % 11 == 0, "running").otherwise("succeeded")
    return e.select(
        key.alias("run_id"), F.col("event_type").alias("source_key"), status.alias("status"), start.alias("started_at"),
        F.when(status != "running", start + F.expr("INTERVAL 30 MINUTES")).alias("completed_at"), F.when(key % 3 > 0, key % 10).alias("records_observed"),
        F.when(F.col("event_type") != "error", key % 6).alias("records_emitted"), F.when(key % 4 > 0, key % 2).alias("records_staged"), (key % 13 == 0).cast("long").alias("error_count"))


RUNS_SQL = """
runs AS (SELECT event_id AS run_id, event_type AS source_key, CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'partial' WHEN event_id % 11 = 0 THEN 'running' ELSE 'succeeded' END AS status,
  ts AS started_at, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 > 0 THEN ts + INTERVAL 30 MINUTES END AS completed_at,
  CASE WHEN event_id % 3 > 0 THEN event_id % 10 END AS observed, CASE WHEN event_type <> 'error' THEN event_id % 6 END AS emitted, CASE WHEN event_id % 4 > 0 THEN event_id % 2 END AS staged, CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS errors FROM events),
seen AS (SELECT *, coalesce(observed > 0, false) OR coalesce(staged > 0, false) AS seen FROM runs),
lastr AS (SELECT source_key, status AS last_status, completed_at AS last_completed, seen AS last_seen FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY started_at DESC NULLS LAST, run_id DESC) AS n FROM seen) WHERE n = 1),
good AS (SELECT source_key, max(completed_at) FILTER (status = 'succeeded' AND seen) AS last_good FROM seen GROUP BY 1),
ch AS (SELECT * FROM (VALUES ('view', true, 24), ('click', true, 1), ('signup', true, 500), ('error', false, 24), ('purchase', true, 2), ('never', true, 24)) t(source_key, enabled, interval_hours))
"""


def _channels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("view", True, 24), ("click", True, 1), ("signup", True, 500), ("error", False, 24), ("purchase", True, 2), ("never", True, 24)], "source_key string, enabled boolean, interval_hours int")


@REGISTRY.add("channel_runs", f"WITH {RUNS_SQL} SELECT source_key, max(started_at) AS last_started, max(completed_at) FILTER (status = 'succeeded') AS last_success, sum(observed)::BIGINT AS observed, sum(emitted)::BIGINT AS emitted, sum(staged)::BIGINT AS staged, sum(errors)::BIGINT AS errors, round(sum(staged) / nullif(sum(emitted), 0), 6) AS yield FROM runs GROUP BY 1")
def channel_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metrics of every channel."""
    return V.run_metrics(_runs(spark, sf_dir)).withColumn("yield", F.round("yield", 6)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_started", "last_success")})


@REGISTRY.add(
    "channel_health",
    f"""WITH {RUNS_SQL} SELECT ch.source_key, CASE WHEN NOT enabled THEN 'disabled' WHEN last_status IS NULL THEN 'unknown' WHEN last_status = 'failed' THEN 'failing' WHEN last_status = 'partial' THEN 'degraded'
      WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_good) >= 2 * interval_hours * 3600000000 THEN 'stale'
      WHEN last_status = 'succeeded' AND last_seen AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_completed) BETWEEN 0 AND interval_hours * 3600000000 THEN 'healthy' ELSE 'unknown' END AS health
    FROM ch LEFT JOIN lastr USING (source_key) LEFT JOIN good USING (source_key)""",
)
def channel_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of every channel."""
    return V.channel_health(_channels(spark), _runs(spark, sf_dir), now())


def _discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, key = table(spark, sf_dir, "events"), F.col("event_id")
    status = F.when(key % 3 == 0, "promoted").when(key % 3 == 1, "rejected").otherwise("pending")
    made = F.col("ts").cast("timestamp")
    hosts = F.concat(F.when(key % 50 == 0, "bad host").otherwise(F.concat(F.lit("H"), (F.col("user_id") % 20).cast("string"), F.lit(".Example.org"))))
    return e.where("event_type <> 'signup'").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("channel"), (key % 4).cast("string").alias("family"), status.alias("status"), made.alias("created_at"), F.when(key % 3 < 2, made + F.make_dt_interval(F.lit(0), (key % 48 - 2).cast("int"))).alias("reviewed_at"), hosts.alias("domain"))


DISCOVERED_SQL = """
disc AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS channel, (event_id % 4)::VARCHAR AS family, CASE event_id % 3 WHEN 0 THEN 'promoted' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, ts AS created_at,
  CASE WHEN event_id % 3 < 2 THEN ts + to_hours((event_id % 48 - 2)::INT) END AS reviewed_at, CASE WHEN event_id % 50 > 0 THEN 'h' || (user_id % 20) || '.example.org' END AS domain FROM events WHERE event_type <> 'signup')
"""


@REGISTRY.add(
    "coverage_gaps",
    f"""WITH {RUNS_SQL}, {DISCOVERED_SQL}, j AS (SELECT * FROM ch LEFT JOIN lastr USING (source_key))
    SELECT source_key, 'enabled_no_run' AS signal FROM j WHERE enabled AND last_status IS NULL
    UNION ALL SELECT source_key, 'ambiguous_run' FROM j WHERE last_status IN ('succeeded', 'partial') AND NOT last_seen
    UNION ALL SELECT source_key, 'delayed' FROM j WHERE enabled AND last_status IS NOT NULL AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_completed) > interval_hours * 3600000000
    UNION ALL SELECT f, 'family_no_denominator' FROM (VALUES ('0'), ('1'), ('none')) t(f) WHERE f NOT IN (SELECT family FROM disc WHERE status IN ('promoted', 'rejected'))
    UNION ALL SELECT NULL, 'pending_queue' WHERE EXISTS (SELECT 1 FROM disc WHERE status = 'pending')""",
)
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of channels, families and the queue."""
    families = spark.createDataFrame([("0",), ("1",), ("none",)], "query_family string")
    return V.gaps(_channels(spark), _runs(spark, sf_dir), _discovered(spark, sf_dir), families, now())


def _funnel_sql(key: str, keys: str) -> str:
    return f"""WITH {DISCOVERED_SQL}, k AS (SELECT * FROM (VALUES {keys}) t({key})),
    n AS (SELECT coalesce(k.{key}, '__unassigned__') AS {key}, status, (epoch_us(reviewed_at) - epoch_us(created_at)) / 3600000000.0 AS h FROM disc LEFT JOIN k USING ({key})),
    g AS (SELECT {key}, count(*) FILTER (status = 'promoted') AS approved, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'pending') AS pending, avg(h) FILTER (h >= 0) AS review_hours FROM n GROUP BY 1)
    SELECT {key}, coalesce(approved, 0) AS approved, coalesce(rejected, 0) AS rejected, coalesce(pending, 0) AS pending, round(coalesce(approved, 0) / nullif(coalesce(approved, 0) + coalesce(rejected, 0), 0), 6) AS approval_rate, round(review_hours, 6) AS review_hours
    FROM (SELECT {key} FROM k UNION SELECT {key} FROM g) LEFT JOIN g USING ({key})"""


def _funnel(spark: SparkSession, sf_dir: str, key: str, values: list[str]) -> DataFrame:
    got = V.funnel(_discovered(spark, sf_dir), spark.createDataFrame([(v,) for v in values], f"{key} string"), key)
    return got.withColumns({c: F.round(c, 6) for c in ("approval_rate", "review_hours")})


@REGISTRY.add("editorial_funnel", _funnel_sql("channel", "('view'), ('click'), ('never')"))
def editorial_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of every channel, with and without rows."""
    return _funnel(spark, sf_dir, "channel", ["view", "click", "never"])


@REGISTRY.add("family_funnel", _funnel_sql("family", "('0'), ('1'), ('none')"))
def family_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of every family of searches."""
    return _funnel(spark, sf_dir, "family", ["0", "1", "none"])


@REGISTRY.add(
    "emerging_domains",
    f"""WITH {DISCOVERED_SQL} SELECT domain, count(*) AS approvals, min(reviewed_at) AS first_approved, max(reviewed_at) AS last_approved, count(*) >= 2 AS candidate FROM disc
    WHERE status = 'promoted' AND domain IS NOT NULL AND reviewed_at >= TIMESTAMP '{NOW}' - INTERVAL 10 DAYS AND reviewed_at <= TIMESTAMP '{NOW}' GROUP BY 1""",
)
def emerging_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains with approvals in the last ten days."""
    return V.emerging_domains(_discovered(spark, sf_dir), now(), 10).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_approved", "last_approved")})


@REGISTRY.add(
    "deadman",
    f"""WITH {RUNS_SQL}, t AS (SELECT * FROM (VALUES ('view', 60), ('click', 100000), ('never', 60)) t(task, sla)),
    g AS (SELECT source_key AS task, arg_max(run_id, (started_at, run_id)) AS latest_run, max(completed_at) FILTER (status IN ('succeeded', 'partial')) AS last_success FROM runs GROUP BY 1)
    SELECT task, latest_run, last_success, coalesce((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_success)) / 60000000.0 > sla, true) AS late FROM t LEFT JOIN g USING (task)""",
)
def deadman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that have had no success in time."""
    tasks = spark.createDataFrame([("view", 60), ("click", 100000), ("never", 60)], "task string, sla_minutes int")
    runs = _runs(spark, sf_dir).withColumnsRenamed({"source_key": "task", "started_at": "scheduled_at"})
    return V.dead_man(tasks, runs, now()).withColumn("last_success", F.col("last_success").cast("timestamp_ntz"))


@REGISTRY.add(
    "stuck_jobs",
    f"""WITH jobs AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'doing' WHEN 'F' THEN 'failed' ELSE 'todo' END AS status, o_custkey AS worker_id FROM orders),
    st AS (SELECT user_id * 4 AS job_id, max(ts) AS started FROM events WHERE event_type = 'view' GROUP BY 1), w AS (SELECT user_id AS worker_id, max(ts) AS hb FROM events WHERE event_type = 'click' GROUP BY 1),
    j AS (SELECT status, coalesce(epoch_us(TIMESTAMP '{NOW}') - epoch_us(started) > 5400000000, false) AS old, coalesce(epoch_us(TIMESTAMP '{NOW}') - epoch_us(hb) > 5400000000, true) AS silent FROM jobs LEFT JOIN st USING (job_id) LEFT JOIN w USING (worker_id))
    SELECT count(*) FILTER (status = 'doing' AND NOT (old AND silent)) AS doing, count(*) FILTER (status = 'doing' AND old AND silent) AS stuck, count(*) FILTER (status = 'failed') AS failed FROM j""",
)
def stuck_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by what they are doing."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "doing").when(F.col("o_orderstatus") == "F", "failed").otherwise("todo").alias("status"), F.col("o_custkey").alias("worker_id"))
    events = e.select((F.col("user_id") * 4).alias("job_id"), F.when(F.col("event_type") == "view", "started").otherwise("other").alias("type"), "at")
    workers = e.where("event_type = 'click'").groupBy(F.col("user_id").alias("worker_id")).agg(F.max("at").alias("last_heartbeat"))
    return V.classify_jobs(jobs, events, workers, now())


@REGISTRY.add(
    "incident_transitions",
    """WITH o AS (SELECT event_type AS fingerprint, event_id AS seq, ts AS at_, value > 50 AS active, lag(value > 50) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before_ FROM events)
    SELECT fingerprint, seq, CASE WHEN active THEN 'open' ELSE 'recovered' END AS transition FROM o WHERE active <> coalesce(before_, false)""",
)
def incident_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where incidents open and end."""
    obs = table(spark, sf_dir, "events").select(F.col("event_type").alias("fingerprint"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), (F.col("value") > 50).alias("active"))
    return V.incidents(obs).drop("at")


@REGISTRY.add(
    "exception_age",
    f"SELECT event_id AS exception_id, greatest(datediff('day', (ts - INTERVAL 3 HOURS)::DATE, DATE '2024-01-20'), 0)::INT AS age_days FROM events WHERE event_type IN ('view', 'error')",
)
def exception_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of open exceptions in local days; the zone has no summer time in 2024."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("exception_id"), F.when(F.col("event_type").isin("view", "error"), " Open").otherwise("resolved").alias("status"), F.col("ts").cast("timestamp").alias("detected"))
    return T.ages(e, F.to_date(F.lit("2024-01-20")))


@REGISTRY.add(
    "review_latency",
    """WITH r AS (SELECT user_id AS exception_id, arg_max(ts, (ts, event_id)) AS reviewed FROM events WHERE event_type = 'click' GROUP BY 1), x AS (SELECT user_id AS exception_id, min(ts) AS detected FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT exception_id, round(greatest((epoch_us(reviewed) - epoch_us(detected)) / 86400000000.0, 0), 6) AS days FROM x JOIN r USING (exception_id)""",
)
def review_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from the first view of a user to the last click."""
    e = table(spark, sf_dir, "events")
    exceptions = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("exception_id")).agg(F.min(F.col("ts").cast("timestamp")).alias("detected"))
    reviews = e.where("event_type = 'click'").select(F.col("user_id").alias("exception_id"), F.col("ts").cast("timestamp").alias("reviewed"), F.col("event_id").alias("seq"))
    return T.latency(exceptions, reviews).withColumn("days", F.round("days", 6))


@REGISTRY.add(
    "reopened",
    """WITH r AS (SELECT user_id, event_id, ts, (event_id % 5)::VARCHAR AS fp, event_type = 'purchase' AS solved FROM events)
    SELECT a.event_id FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE b.user_id = a.user_id AND (b.ts, b.event_id) < (a.ts, a.event_id) AND b.solved)
      AND NOT EXISTS (SELECT 1 FROM r b WHERE b.user_id = a.user_id AND (b.ts, b.event_id) < (a.ts, a.event_id) AND b.solved AND b.fp = a.fp)""",
)
def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions that come again in a new form after one was resolved."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("detected"), F.col("event_id").alias("observed"), F.col("event_id").alias("seq"), (F.col("event_id") % 5).cast("string").alias("input_fingerprint"), F.when(F.col("event_type") == "purchase", "resolved").otherwise("open").alias("status"))
    return T.reopened(rows, ["user_id"]).select("event_id")


@REGISTRY.add(
    "exception_scd",
    """WITH g AS (SELECT user_id, (event_id % 3)::VARCHAR AS input_fingerprint, count(*) AS n_observed, max((ts, event_id)) AS l FROM events GROUP BY 1, 2)
    SELECT user_id, input_fingerprint, n_observed, CASE WHEN l = max(l) OVER (PARTITION BY user_id) THEN 'open' ELSE 'superseded' END AS status FROM g""",
)
def exception_scd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions of users: the last seen is open, the others superseded."""
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3).cast("string").alias("input_fingerprint"), F.col("ts").alias("observed"), "event_id")
    return T.observe(rows, ["user_id"]).select("user_id", "input_fingerprint", "n_observed", "status")


@REGISTRY.add("quality_counts", "SELECT coalesce(nullif(lower(trim(CASE WHEN event_id % 10 > 0 THEN ' ' || upper(event_type) END)), ''), 'unknown') AS kind, count(*) AS n FROM events GROUP BY 1")
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the normal form of a key."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 > 0, F.concat(F.lit(" "), F.upper("event_type"))).alias("kind"))
    return T.counts(rows, "kind")


@REGISTRY.add("quality_source_counts", "SELECT s AS source, count(*) AS n FROM (SELECT unnest(CASE WHEN p_size % 5 = 0 THEN ['unknown'] ELSE list_distinct(string_split(lower(p_type), ' ')) END) AS s FROM part) GROUP BY 1")
def quality_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by each distinct source they have."""
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 5 > 0, F.split("p_type", " ")).alias("source"))
    return T.counts_exploded(rows, "source")


@REGISTRY.add(
    "profile_drift",
    """WITH p AS (SELECT c_custkey AS workspace, DATE '1993-01-01' + (c_custkey % 1500)::INT AS updated FROM customer), n AS (SELECT workspace, count(*) AS k FROM p JOIN orders ON o_custkey = workspace WHERE o_orderdate::DATE > updated GROUP BY 1)
    SELECT workspace, datediff('day', updated, DATE '1995-01-01')::INT AS days_since, coalesce(k, 0) AS new_items, datediff('day', updated, DATE '1995-01-01') >= 90 AND coalesce(k, 0) >= 3 AS stale FROM p LEFT JOIN n USING (workspace)""",
)
def profile_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles that are old and have seen new items."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("workspace"), F.date_add(F.to_date(F.lit("1993-01-01")), (F.col("c_custkey") % 1500).cast("int")).alias("updated"))
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("workspace"), F.to_date("o_orderdate").alias("created"))
    return T.drift(people, items, F.to_date(F.lit("1995-01-01")))


@REGISTRY.add(
    "theme_lint",
    """WITH t AS (SELECT p_brand AS source, p_name AS example, unnest(string_split(lower(p_type), ' ')) AS theme FROM part)
    SELECT theme, count(*) AS n, count(DISTINCT source) AS n_sources, array_to_string(list_slice(list_sort(list(DISTINCT example)), 1, 10), '|') AS examples FROM t WHERE theme NOT IN ('steel', 'brass') GROUP BY 1""",
)
def theme_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes outside the vocabulary."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.col("p_name").alias("example"), F.regexp_replace("p_type", " ", "; ").alias("themes"))
    lint = V.unknown_themes(rows, spark.createDataFrame([("steel",), ("brass",)], "theme string"))
    return lint.withColumn("examples", F.array_join("examples", "|"))


def _ranking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The 20 nearest of each vector whose id is divisible by 20, with hit for its own label, and how many others have that label."""
    e = table(spark, sf_dir, "embeddings")
    base = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = nearest(base.where("id % 20 = 0"), base, 20, same=True).select(F.col("src").alias("query"), F.col("dst").alias("id"), F.col("weight").alias("score"))
    labels = e.select(F.col("vec_id").alias("id"), "label")
    marked = near.join(labels, "id").join(labels.select(F.col("id").alias("query"), F.col("label").alias("wanted")), "query")
    ranking = marked.select("query", "id", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")).alias("rank"), "score", F.coalesce(F.col("label") == F.col("wanted"), F.lit(False)).alias("hit"))
    sizes = small(labels.groupBy("label").agg((F.count("*") - 1).alias("n_relevant")))
    return ranking, labels.where("id % 20 = 0").join(sizes, "label").where("n_relevant > 0").select(F.col("id").alias("query"), "n_relevant")


RANKING_SQL = """
q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q, label AS wanted FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT query, vec_id AS id, label = wanted AS rel, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS score FROM embeddings, q WHERE vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM p QUALIFY rank <= 20),
nr AS (SELECT query, count(*) FILTER (rel) AS n FROM p GROUP BY 1)
"""


@REGISTRY.add(
    "retrieval_metrics",
    f"""WITH {RANKING_SQL} SELECT query, round(avg(rel::INT) FILTER (rank <= 10), 6) AS precision, round(count(*) FILTER (rank <= 10 AND rel) / any_value(n), 6) AS recall, bool_or(rank <= 10 AND rel) AS hit, round(coalesce(1.0 / min(rank) FILTER (rel), 0), 6) AS reciprocal_rank,
      round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10 AND rel), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= any_value(nr.n)), 6) AS ndcg FROM r JOIN nr USING (query) GROUP BY query, nr.n""",
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of dense rankings, a query for each id that is divisible by 20; vectors of a query's label are relevant."""
    ranking, relevant = _ranking(spark, sf_dir)
    got = M.rank_scores(ranking, relevant, 10)
    return got.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "reciprocal_rank", "ndcg")})


@REGISTRY.add(
    "ndcg3",
    f"""WITH {RANKING_SQL}, e AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY id) AS place FROM r WHERE rank <= 8),
    i AS (SELECT query, sum((9 - place) / log2(place + 1)) AS ideal FROM e WHERE place <= 3 GROUP BY 1), d AS (SELECT r.query, sum((9 - place) / log2(rank + 1)) AS dcg FROM r JOIN e USING (query, id) WHERE rank <= 3 GROUP BY 1)
    SELECT query, round(coalesce(dcg, 0) / ideal, 3) AS ndcg FROM i LEFT JOIN d USING (query)""",
)
def ndcg3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded NDCG of rankings against one by id."""
    ranking, _ = _ranking(spark, sf_dir)
    few = ranking.where("rank <= 8")
    expected = few.select("query", "id", F.row_number().over(Window.partitionBy("query").orderBy("id")).alias("rank"))
    return M.graded_ndcg(few, expected)


@REGISTRY.add("false_positives", f"WITH {RANKING_SQL} SELECT query, count(*) FILTER (rank <= 8 AND score >= 0.25 AND NOT rel) AS false_positives FROM r GROUP BY 1")
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irrelevant vectors among the shown ones."""
    ranking, _ = _ranking(spark, sf_dir)
    return M.false_positives(ranking, ranking.where("not hit"), 8, 0.25)


@REGISTRY.add("unjudged", f"WITH {RANKING_SQL} SELECT query, count(*) FILTER (rank <= 8 AND NOT rel) AS unjudged FROM r GROUP BY 1")
def unjudged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown vectors that no judgement is for."""
    ranking, _ = _ranking(spark, sf_dir)
    return M.unjudged(ranking, ranking.where("hit"), 8)


@REGISTRY.add("latency_percentiles", "SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and percentiles by interpolation."""
    return M.latencies(table(spark, sf_dir, "events"), "value").select(*[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95")])


@REGISTRY.add(
    "size_distribution",
    """WITH s AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) AS k, count(*) OVER () AS n FROM documents)
    SELECT any_value(n) AS n, quantile_cont(v, 0.5) AS median, min(v) FILTER (k = round_even(0.95 * (n - 1), 0) + 1) AS p95, max(v) AS max, round(avg((v > 5000)::INT), 6) AS oversize, round(avg((v < 300)::INT), 6) AS orphan FROM s""",
)
def size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of documents as chunks."""
    return M.size_distribution(table(spark, sf_dir, "documents"), "n_chars", 5000, 300)


@REGISTRY.add(
    "class_metrics",
    """WITH r AS (SELECT d.lang AS kind, CASE WHEN l.quality = 1 THEN 'in_scope' ELSE 'out_of_scope' END AS want, CASE WHEN d.n_chars % 11 = 0 THEN NULL WHEN d.n_chars % 7 = 0 THEN 'needs_review' WHEN d.n_chars > 400 THEN 'in_scope' ELSE 'out_of_scope' END AS got FROM labels l JOIN documents d USING (doc_id)),
    g AS (SELECT kind, count(*) AS cases, count(*) FILTER (got = want) AS correct, count(*) FILTER (got <> want) AS divergent, count(*) FILTER (got IS NULL) AS errors, count(*) FILTER (want = 'in_scope' AND got = want) AS tp,
      count(*) FILTER (want = 'in_scope' AND got IS NOT NULL) AS sem, count(*) FILTER (want = 'in_scope') AS ins, count(*) FILTER (want <> 'in_scope' AND got = 'in_scope') AS fp, count(*) FILTER (got = 'needs_review') AS review FROM r GROUP BY 1)
    SELECT kind, cases, correct, divergent, errors, round(correct / nullif(cases - errors, 0), 4) AS agreement, round(tp / nullif(sem, 0), 4) AS semantic_recall, round(tp / nullif(ins, 0), 4) AS end_to_end_recall, round(tp / nullif(tp + fp, 0), 4) AS precision, round(review / nullif(cases - errors, 0), 4) AS review_rate FROM g""",
)
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of decisions with labels, by language."""
    n = F.col("n_chars")
    got = F.when(n % 11 == 0, None).when(n % 7 == 0, "needs_review").when(n > 400, "in_scope").otherwise("out_of_scope")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("case"), F.col("lang").alias("kind"), F.when(F.col("quality") == 1, "in_scope").otherwise("out_of_scope").alias("want"), got.alias("got"))
    return M.decisions(rows)


@REGISTRY.add(
    "code_metrics",
    """WITH c AS (SELECT p_partkey AS k, p_size % 6 = 0 AS err, list_distinct(string_split(lower(p_type), ' ')) AS want, list_distinct(string_split(lower(p_type || ' ' || p_brand), ' ')[2:]) AS got FROM part),
    w AS (SELECT k, err, unnest(want) AS code FROM c), g AS (SELECT k, unnest(got) AS code FROM c WHERE NOT err),
    j AS (SELECT coalesce(w.code, g.code) AS code, w.k AS wk, g.k AS gk, coalesce(err, false) AS err FROM w FULL JOIN g ON w.k = g.k AND w.code = g.code),
    s AS (SELECT code, count(*) FILTER (wk IS NOT NULL AND gk IS NOT NULL) AS tp, count(*) FILTER (wk IS NULL) AS fp, count(*) FILTER (wk IS NOT NULL AND gk IS NULL AND NOT err) AS fn, count(*) FILTER (wk IS NOT NULL AND err) AS missed FROM j GROUP BY 1)
    SELECT code, tp, fp, fn, missed, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS semantic_recall, round(tp / nullif(tp + fn + missed, 0), 4) AS end_to_end_recall FROM s""",
)
def code_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each code of parts."""
    words = lambda *c: F.array_distinct(F.split(F.lower(F.concat_ws(" ", *c)), " "))
    got = F.split(F.lower(F.concat_ws(" ", "p_type", "p_brand")), " ")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case"), words("p_type").alias("want"), F.when(F.col("p_size") % 6 > 0, F.array_distinct(F.slice(got, 2, 99))).alias("got"))
    return M.code_scores(rows)


@REGISTRY.add("score_means", "SELECT event_type AS name, round_even(avg(value), 4) AS mean FROM events GROUP BY 1")
def score_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each score."""
    return M.means(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value"))


@REGISTRY.add(
    "catalog_stats",
    """WITH e AS (SELECT 'customer' AS kind, c_mktsegment AS status, [lower(c_mktsegment)] AS themes, 'c' AS source FROM customer UNION ALL SELECT 'supplier', NULL, NULL, 's' FROM supplier)
    SELECT 'kind' AS what, kind AS value, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'status', coalesce(status, ''), count(*) FROM e GROUP BY 2 UNION ALL SELECT 'themes', '', count(DISTINCT t) FROM (SELECT unnest(themes) AS t FROM e) UNION ALL SELECT 'sources', '', count(DISTINCT source) FROM e""",
)
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two kinds of entities."""
    a = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("status"), F.array(F.lower("c_mktsegment")).alias("themes"), F.lit("c").alias("source"))
    return C.stats(C.union_kinds(customer=a, supplier=table(spark, sf_dir, "supplier").select(F.lit("s").alias("source"))))


@REGISTRY.add("catalog_list", "SELECT o_orderkey AS id, o_orderpriority AS title, CASE o_orderstatus WHEN 'O' THEN 'ABERTA' ELSE 'ENCERRADA' END AS status FROM orders ORDER BY o_orderstatus <> 'O', lower(o_orderpriority), o_orderkey LIMIT 200")
def catalog_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first calls, open ones first."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "O", "ABERTA").otherwise("ENCERRADA").alias("status"))
    return C.list_calls(rows, None, None, 200)


@REGISTRY.add("related_names", "SELECT l_suppkey AS src, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS names FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def related_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct brands that every supplier delivers."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("brand").alias("type"))
    return C.related_names(edges, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name")), "brand").select("src", F.array_join("names", ",").alias("names"))


@REGISTRY.add(
    "native_resolve",
    """WITH e AS (SELECT 'a:' || (c_custkey % 100) || ':' || c_nationkey AS id, c_custkey FROM customer), i AS (SELECT DISTINCT id FROM e),
    refs AS (SELECT DISTINCT r AS ref FROM (SELECT id AS r FROM i UNION ALL SELECT n_nationkey::VARCHAR FROM nation UNION ALL SELECT regexp_replace(id, '^a:', '') FROM i UNION ALL SELECT 'nothing')),
    s AS (SELECT ref, count(*) AS n, min(id) AS sid FROM refs JOIN i ON ends_with(id, ':' || ref) GROUP BY 1)
    SELECT ref, CASE WHEN ref IN (SELECT id FROM i) THEN ref WHEN n = 1 THEN sid END AS id FROM refs LEFT JOIN s USING (ref)""",
)
def native_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as ids: equal, or the only one with that end."""
    people = table(spark, sf_dir, "customer")
    ids = people.select(F.concat_ws(":", F.lit("a"), (F.col("c_custkey") % 100).cast("string"), F.col("c_nationkey").cast("string")).alias("id")).distinct()
    refs = ids.select(F.col("id").alias("ref")).union(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string"))).union(ids.select(F.regexp_replace("id", "^a:", ""))).union(spark.createDataFrame([("nothing",)], "ref string")).distinct()
    return C.resolve_native(refs, ids)


@REGISTRY.add("turn_stats", "SELECT conv_id AS session, count(*) // 2 AS turn_count FROM conversations GROUP BY 1")
def turn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of every conversation, two rows each."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn")
    return C.sessions_with_turns(turns.select("session").distinct(), turns)


@REGISTRY.add("next_turn", "SELECT c AS session, coalesce(max(turn), 0) + 1 AS next_turn FROM (SELECT DISTINCT conv_id AS c FROM conversations UNION SELECT -1) LEFT JOIN conversations ON conv_id = c GROUP BY 1")
def next_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next turn of every conversation, and of a new one."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn")
    return C.next_turn(turns.select("session").distinct().union(spark.range(-1, 0).select("id")), turns)


@REGISTRY.add("purge_stale", "SELECT count(*) AS kept FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3 DAYS)")
def purge_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stay when threads without a row for three days go."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), F.col("ts").cast("timestamp").alias("at"))
    return C.purge(rows, C.stale_threads(rows, now(), 3)).agg(F.count("*").alias("kept"))


@REGISTRY.add(
    "queue_fetch",
    """WITH j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'todo' WHEN 'P' THEN 'doing' ELSE 'done' END AS status, o_orderpriority AS priority, o_custkey AS lock, o_orderdate AS due FROM orders)
    SELECT job_id, priority FROM j a WHERE status = 'todo' AND due <= TIMESTAMP '1997-01-01' AND NOT EXISTS (SELECT 1 FROM j b WHERE b.lock = a.lock AND (b.status = 'doing' OR (b.status = 'todo' AND b.job_id < a.job_id))) ORDER BY priority DESC, job_id LIMIT 1""",
)
def queue_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next job to do."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "todo").when(F.col("o_orderstatus") == "P", "doing").otherwise("done").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("lock"), F.col("o_orderdate").cast("timestamp").alias("due"))
    return C.fetch_job(jobs, F.to_timestamp(F.lit("1997-01-01 00:00:00"))).select("job_id", "priority")


@REGISTRY.add(
    "status_transition",
    """SELECT event_id, from_status FROM (SELECT event_id, event_type, lag(event_type) OVER w AS from_status, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM from_status""",
)
def status_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type is not that of the user's event before."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("status"))
    return C.transitions(rows, "user_id", "ts", "event_id").select("event_id", "from_status")


@REGISTRY.add("title_search", "SELECT doc_id AS id FROM documents WHERE doc_id % 5 > 0 AND text ILIKE '%the%'")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that aren't archived with a word in their title, which is a document's text here."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.when(F.col("doc_id") % 5 == 0, "yes").alias("archived"), F.col("doc_id").alias("created"), F.lit("doc").alias("kind"))
    return C.search_items(items, "THE").select("id")


@REGISTRY.add(
    "intent_route",
    "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'the') THEN 'find' WHEN regexp_matches(lower(text), 'a') THEN 'explain' ELSE 'chat' END AS intent FROM conversations",
)
def intent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent of every turn by keywords in order."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.intent(F.lower("text"), [("find", "the"), ("explain", "a")], "chat").alias("intent"))


@REGISTRY.add("usage_totals", "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS input_tokens, NULL::BIGINT AS output_tokens FROM events GROUP BY 1")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sums by type; what no row has stays null."""
    named = F.regexp_replace("props", '"k"', '"prompt_tokens"')
    u = table(spark, sf_dir, "events").select("event_type", *[c.alias(n) for n, c in C.usage(named).items()])
    return u.groupBy("event_type").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
