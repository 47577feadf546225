"""Shared-folder tables, skew-proof lookups and components of a graph.

Intermediate tables are Parquet in the folder that the cluster names in
``spark.checkpoint.dir``, so a lost executor costs a re-read, not a re-run.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Keys that `attach` joins by broadcast: the heaviest ones, a fixed number.
HOT_KEYS = 256
#: Rows up to which a lookup table is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 50_000


#: Scratch paths of this process that `clear` deletes.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set and the master is local."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `clear` deletes it."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> int:
    """Delete what operators have left in the shared folder; how many paths.

    Results read those tables, so call it when they are written or no longer
    needed.
    """
    gone = len(_made)
    while _made:
        remove(spark, _made.pop())
    return gone


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._lodestar_path = path
    return again


def release(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._lodestar_path)
        if table._lodestar_path in _made:
            _made.remove(table._lodestar_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through the file system that Spark uses for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def bounded(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if it has at most so many rows.

    The table must be materialized: its rows are counted, from file footers.
    Beyond the bound the join shuffles both sides.
    """
    return F.broadcast(table) if table.count() <= rows else table.hint("merge")


def attach(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join left with right on key, where right has one row per key (how: inner, left or left_semi).

    right[weight] is the number of left rows of that key. Up to rows rows
    (BROADCAST_ROWS by default), right is broadcast. Beyond, its HOT_KEYS heaviest keys are, whatever
    share of the rows they hold, and the others are shuffled, none of them
    with over 1 / HOT_KEYS of the rows. Every way is exact. right must be
    materialized, since it is read more than once; left should be. Null keys
    must be replaced before.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    keys = [key] if isinstance(key, str) else key
    if right.count() <= rows:
        return left.join(F.broadcast(right), keys, how)
    hot = right.orderBy(F.desc(weight), *keys).limit(HOT_KEYS)
    cold = right.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    few = left.join(F.broadcast(hot), keys, "left_semi" if how == "left_semi" else "inner")
    many = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys, how)
    return few.select(*few.columns).unionByName(many.select(*few.columns))


def _neighbours_least(edges: DataFrame) -> DataFrame:
    """Rows (u, m, n) per u of edges (u, v): the least v and how many edges u has."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, root).

    root is the smallest node of the component. Large-star and small-star steps
    alternate until the edges stay the same; each is an aggregate of minima and
    one join, in which nodes with many edges are no task of their own, and
    every round is written to the shared folder. Nodes without an edge don't
    appear. Raises after so many rounds without an end, which would take a
    component beyond 2**rounds nodes.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    before = None
    for _ in range(rounds):
        # Few edges have few nodes, which are broadcast; of more, the nodes with most edges are.
        many = now.count() > BROADCAST_ROWS
        keep = (lambda table: materialize(table, "least")) if many else F.broadcast
        meet = (lambda rows, least: attach(rows, least, "u", "n", rows=HOT_KEYS)) if many else (lambda rows, least: rows.join(least, "u"))
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(_neighbours_least(both).withColumn("m", F.least("u", "m")))
        large = meet(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")
        lower = keep(_neighbours_least(large))
        small = meet(large, lower).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(lower.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialize(small, "small")
        release(large, now, *((least, lower) if many else ()))
        # A star forest is a fixed point, and the only kind: its state sums stay.
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = after
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
