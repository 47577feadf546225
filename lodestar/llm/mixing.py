"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash. A source that is to give r times its size gives
floor(r) whole copies, and once more the documents whose hash lies below a
threshold. The threshold is found by histograms: words are summed by source
and hash prefix, the prefix in which the budget ends is the boundary bucket,
and only its documents are summed again by a longer prefix. Documents are then
kept by comparing hashes; nothing is sorted. Thresholds are nested: a larger
budget keeps a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestar.llm.common import attach, bounded, materialize, release

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its size.
MAX_REPEATS = 3
#: Lengths of the hash prefixes, in hexadecimal digits; the last is the whole hash.
PREFIXES = (3, 6, 9, 12, 16)
#: Words are runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, text: Column) -> Column:
    """16 hexadecimal digits that depend on the row alone, so reruns agree."""
    return F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))), 1, 16)


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their weight by rank in code-point order, null last; no task sees them all."""
    spark = sources.sparkSession
    dealt = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "ranked")
    starts, at = [], 0
    for row in sorted(dealt.groupBy("part").count().collect()):  # one row per partition
        starts.append((row.part, at))
        at += row["count"]
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    before = F.broadcast(spark.createDataFrame(starts, "part int, before long"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("before") + F.col("within"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    return dealt.withColumn("within", within).join(before, "part").select(*sources.columns, weight.alias("w"))


def targets(sources: DataFrame) -> DataFrame:
    """The rows of sources (source, source_size and others) with their target.

    Targets share the sum of all sizes by weight; one above MAX_REPEATS times
    its source's size stops there, and the excess is reshared by weight until
    none is above. Each round is one aggregate; a round without a new stop is
    the last.
    """
    ranked = materialize(_ranked(sources), "weights")
    total = int(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    full = F.col("source_size") * MAX_REPEATS
    share, stopped = 0.0, -1
    while True:
        above = (F.lit(share) * F.col("w") > full) if stopped >= 0 else F.lit(False)
        n, filled, weight = ranked.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, full)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0))).first()
        if n == stopped or not weight:
            break
        share, stopped = (total - int(filled)) / int(weight), n
    above = F.lit(share) * F.col("w") > full
    return ranked.select(*sources.columns, F.when(above, full.cast("double")).otherwise(F.lit(share) * F.col("w")).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (source, copies, below, extra): one more copy if hash < below, or if hash = below and extra.

    The first document (or documents of equal hash) that would pass the budget
    is taken if that ends nearer to it than stopping short.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    now = wanted.select("source", "n", F.floor(ratio).alias("copies"), (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("budget"))
    now = materialize(now.withColumns({"prefix": F.lit(""), "spent": F.lit(0).cast("long"), "inside": F.lit(0).cast("long")}), "bounds")
    for length in PREFIXES:
        narrow = now.select(_key(F.col("source")).alias("key"), F.col("prefix").alias("p"), "n")
        inside = attach(sized, narrow, "key", "n").where(F.substring("hash", 1, F.length("p")) == F.col("p"))
        histogram = inside.groupBy("source", F.substring("hash", 1, length).alias("bucket")).agg(F.sum("size").alias("words"))
        summed = histogram.join(bounded(now.withColumnRenamed("source", "s")), _same(F.col("source"), F.col("s")))
        # At most 16 ** 3 buckets of a source: the prefix of the round before is the same for all.
        to_here = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        summed = summed.withColumn("end", F.col("spent") + to_here).where("end > budget")
        first = summed.groupBy("source").agg(F.min(F.struct("bucket", "end", "words")).alias("x"))
        first = first.select(F.col("source").alias("s"), "x.*")
        after = now.join(bounded(materialize(first, "first")), _same(F.col("source"), F.col("s")), "left")
        after = after.select("source", "n", "copies", "budget", F.coalesce("bucket", F.lit("g")).alias("prefix"), F.coalesce(F.col("end") - F.col("words"), "spent").alias("spent"), F.coalesce("words", F.lit(0)).alias("inside"))
        after = materialize(after, "bounds")
        release(now)
        now = after
    nearer = F.col("spent") + F.col("inside") - F.col("budget") < F.col("budget") - F.col("spent")
    return now.select("source", "copies", F.col("prefix").alias("below"), (nearer & (F.col("inside") > 0)).alias("extra"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Tables of documents (doc_id, source, key, size, hash) and of sources (key, source_size, n, target, copies, below, extra)."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _key(F.col(source_col)).alias("key"), n_words(F.col(text_col)).alias("size"), doc_hash(F.col(id_col), F.col(text_col)).alias("hash"))
    sized = materialize(narrow, "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    wanted = materialize(targets(sources), "targets")
    cut = materialize(_thresholds(sized, wanted), "thresholds").withColumnRenamed("source", "s")
    planned = wanted.join(bounded(cut), _same(F.col("source"), F.col("s"))).withColumn("key", _key(F.col("source"))).drop("s", "source")
    return sized, materialize(planned, "plan")


def _copies() -> Column:
    more = (F.col("hash") < F.col("below")) | ((F.col("hash") == F.col("below")) & F.col("extra"))
    return F.least(F.col("copies") + F.when(more, 1).otherwise(0), F.lit(MAX_REPEATS)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row (doc_id, size, source_size, target, taken) per document.

    taken is the number of words that the mix takes of the document: its size
    times its copies, at most MAX_REPEATS. A null source is a source of its
    own, last in rank; a null text has size 0; rows of equal id and text are
    taken alike. A source without words has target 0. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    sized, sources = plan(docs, id_col, text_col, source_col)
    joined = attach(sized, sources, "key", "n")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents, each repeated as often as the mix takes it; columns stay as they are."""
    _, sources = plan(docs, id_col, text_col, source_col)
    sources = sources.select(*[F.col(c).alias(f"__mix_{c}") for c in ("key", "n", "copies", "below", "extra")])
    digest = doc_hash(F.col(id_col), F.col(text_col))
    more = (digest < F.col("__mix_below")) | ((digest == F.col("__mix_below")) & F.col("__mix_extra"))
    copies = F.least(F.col("__mix_copies") + F.when(more, 1).otherwise(0), F.lit(MAX_REPEATS)).cast("int")
    joined = attach(docs.withColumn("__mix_key", _key(F.col(source_col))), sources, "__mix_key", "__mix_n")
    repeated = joined.withColumn("__mix_times", copies).where("__mix_times > 0").withColumn("__mix_k", F.explode(F.sequence(F.lit(1), F.col("__mix_times"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB SQL of `mix` over the table documents.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 16) AS hash
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source
), tot AS (SELECT sum(source_size) AS t, sum(w) AS ws FROM src
), ordered AS (
  SELECT *, row_number() OVER o AS k, coalesce(sum(3 * source_size) OVER p, 0) AS filled, coalesce(sum(w) OVER p, 0) AS used
  FROM src WINDOW o AS (ORDER BY source_size / w, source IS NULL, source),
                  p AS (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), share AS (
  SELECT ((t - filled)::DOUBLE / (ws - used)) AS share FROM ordered, tot
  WHERE (t - filled)::DOUBLE / (ws - used) * w <= 3 * source_size ORDER BY k LIMIT 1
), goal AS (
  SELECT source, source_size, CASE WHEN share * w > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE share * w END AS target
  FROM src, share
), cut AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM goal
), run AS (
  SELECT d.doc_id, d.size, c.source_size, c.target, c.copies, c.target - c.copies * c.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.hash) AS peers
  FROM sized d JOIN cut c ON d.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN upto <= budget OR (upto - peers <= budget AND upto - budget < budget - (upto - peers)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
