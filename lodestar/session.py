"""Session settings shared by tests, the bench and scripts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(app: str = "lodestar", cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session with the settings that a cluster would set in its defaults.

    Shuffle partitions start at the number of cores; adaptive execution
    coalesces or splits them at run time.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows up to which a table is broadcast.
BROADCAST_ROWS = 50_000


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if it has at most so many rows; beyond, joins shuffle."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table.hint("merge")


def against(left: DataFrame, right: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """All rows of left with all rows of right, which are a query's.

    Up to so many rows, right is broadcast. Beyond, it is dealt to blocks of
    about that size, and left's rows, in parts, meet one block after another by
    a join on block and part, so that no task holds more of either.
    """
    n = right.count()
    if n <= rows:
        return left.join(F.broadcast(right))
    blocks, parts = -(-n // rows), max(1, -(-left.count() // rows))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda table, k: F.pmod(F.xxhash64(*table.columns), F.lit(k)).cast("int")
    a = left.withColumn("__part", dealt(left, parts)).withColumn("__block", every(blocks))
    b = right.withColumn("__block", dealt(right, blocks)).withColumn("__part", every(parts))
    return a.join(b.hint("merge"), ["__block", "__part"]).drop("__block", "__part")


def few(table: DataFrame, rows: int = 1) -> DataFrame:
    """The table, marked for broadcast; an error if it has more than so many rows, as a query or a rule table hasn't."""
    if table.limit(rows + 1).count() > rows:
        raise ValueError(f"a table of {rows} rows at most has more")
    return F.broadcast(table)


#: Tables of this process that `clear` deletes.
_made: list[str] = []
#: Keys that `attach` joins by broadcast where it shuffles: the heaviest ones, a fixed number.
HOT_KEYS = 256


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, which `clear` deletes.

    The folder is the session's; one of its own only where none is named, as
    in tests.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        folder = context.getCheckpointDir()
    _made.append(f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written as a table to the checkpoint folder and read again, so that plans of loops stay short."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._lodestar_path = path
    return again


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path through the file system that Spark uses for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Delete tables of `cut_lineage` that nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, table._lodestar_path)
        if table._lodestar_path in _made:
            _made.remove(table._lodestar_path)


def clear(spark: SparkSession) -> int:
    """Delete what operators have left in the checkpoint folder; how many tables.

    Results read those tables, so call it when they are written or no longer
    needed.
    """
    gone = len(_made)
    while _made:
        delete(spark, _made.pop())
    return gone


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of left with right, a written table of one row for each key; no null keys.

    right[weight] is as large as the key's rows in left are many. Up to so
    many rows, right is broadcast. Beyond, its HOT_KEYS heaviest keys are,
    whatever share of the rows they hold, and all others are shuffled.
    """
    if right.count() <= rows:
        return left.join(F.broadcast(right), key)
    hot = F.broadcast(right.orderBy(F.desc(weight), key).limit(HOT_KEYS))
    few = left.join(hot, key)
    many = left.join(hot.select(key), key, "left_anti").join(right.join(hot.select(key), key, "left_anti").hint("merge"), key)
    return few.unionByName(many.select(*few.columns))
