"""Scans and snapshots of raw records: JSON, JSON lines, XML, pages, and keyed blobs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lodestar.session import small

#: One structured block of a document.
BLOCK = T.StructType([
    T.StructField("idx", T.IntegerType()), T.StructField("doc", T.StringType()), T.StructField("page", T.IntegerType()),
    T.StructField("section_path", T.ArrayType(T.StringType())), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()),
])
#: The sidecar of a structured document.
SIDECAR = T.StructType([
    T.StructField("silver_version", T.StringType()), T.StructField("prompt_version", T.StringType()), T.StructField("source_hash", T.StringType()),
    T.StructField("n_blocks", T.IntegerType()), T.StructField("n_pages_total", T.IntegerType()), T.StructField("n_pages_failed", T.IntegerType()),
])


def fingerprint(url: Column, title: Column, body: Column, *more: Column) -> Column:
    """What of a raw record makes it another one: its address, title, the start of its body, and some fields."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in (url, title, F.substring(body, 1, 800), *more)]))


def snapshot_hash(records: DataFrame, one: Column) -> DataFrame:
    """One row: a hash of all records' fingerprints, whatever their order, without gathering them.

    The sum of 64-bit halves of the MD5 values, and their count.
    """
    half = lambda k: F.sum(F.conv(F.substring(one, k, 8), 16, 10).cast("decimal(38,0)"))
    return records.agg(F.md5(F.concat_ws("|", F.count("*").cast("string"), *[half(k).cast("string") for k in (1, 9, 17, 25)])).alias("snapshot_hash"))


def write_snapshot(records: DataFrame, one: Column, path: str) -> bool:
    """Append a JSON snapshot unless the last one has the same hash; whether it was written."""
    spark = records.sparkSession
    now = snapshot_hash(records, one).first()[0]
    ledger = f"{path}/_ledger"
    try:
        last = spark.read.schema("seq long, snapshot_hash string").json(ledger).orderBy(F.desc("seq")).first()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        last = None
    if last is not None and last.snapshot_hash == now:
        return False
    seq = 1 if last is None else last.seq + 1
    records.write.mode("overwrite").json(f"{path}/snapshot={seq:08d}")
    spark.createDataFrame([(seq, now)], "seq long, snapshot_hash string").coalesce(1).write.mode("append").json(ledger)
    return True


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Multi-line JSON records with their file; malformed ones as nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_path"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of structured documents from JSON lines."""
    return spark.read.schema(BLOCK).json(path)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Sidecars of structured documents."""
    return spark.read.schema(SIDECAR).option("multiLine", True).json(path)


def read_articles(spark: SparkSession, path: str, tag: str = "article") -> DataFrame:
    """Articles of XML files, attributes with an underscore before their name."""
    return spark.read.format("xml").option("rowTag", tag).load(path)


def latest_snapshot(records: DataFrame, key: str = "file") -> DataFrame:
    """Records of the last file."""
    last = records.agg(F.max(key).alias("_last"))
    return records.join(F.broadcast(last), F.col(key) == F.col("_last")).drop("_last")


def newest_per_key(records: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of records with a key, the one that is last by some columns; an additive union in which later files win."""
    place = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(o) for o in order])
    return records.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")


def native_id(source: Column, record_id: Column, url: Column, url_hash: Column) -> Column:
    """Native id by source: its own, from the address, or the page's hash."""
    from_url = F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"/(\d+)/?(?:[?#].*)?$", 1), F.lit(""))
    return F.when(source == "web", url_hash).when(source == "html", from_url).otherwise(record_id.cast("string"))


def distinct_natives(*sources: DataFrame) -> DataFrame:
    """Distinct (source, native) of all sources; rows without a native id are left out."""
    out = sources[0].select("source", "native")
    for other in sources[1:]:
        out = out.unionByName(other.select("source", "native"))
    return out.where("native is not null").distinct()


def describe(bronze: DataFrame, blocks: DataFrame) -> DataFrame:
    """Title and deadline of raw records (key, title, deadline): the first heading stands in for a title; no guess for a deadline."""
    first = blocks.where("kind = 'heading'").groupBy("key").agg(F.min_by("text", "idx").alias("heading"))
    return bronze.join(first, "key", "left").select("key", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "heading").alias("name"), F.try_to_date("deadline", "dd/MM/yyyy").alias("deadline"))


def audience(names: Column) -> Column:
    """Names of an array of structs, joined."""
    return F.array_join(F.filter(F.transform(names, lambda n: F.trim(n["name"])), lambda n: n != ""), ", ")


def status_of(raw: Column) -> Column:
    """A status as upper case with underscores."""
    return F.regexp_replace(F.upper(F.trim(raw)), r"\s+", "_")


def require(records: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records that have all fields, and those that lack one, with the names of what they lack."""
    lacking = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "", F.lit(f)) for f in fields]))
    marked = records.withColumn("lacking", lacking)
    return marked.where(F.size("lacking") == 0).drop("lacking"), marked.where(F.size("lacking") > 0)


def gazette_candidates(articles: DataFrame, drop_types: list[str], drop_orgs: list[str], drop_title: str, keep: str, orgs: list[str] | None = None) -> DataFrame:
    """Articles (type, org, title, body) that may be calls: not of some types or bodies or titles, with a word that must be there."""
    text = F.concat_ws(" ", "title", "body")
    out = articles.where(~F.lower("type").isin(*map(str.lower, drop_types))).where(~F.coalesce(F.col("title"), F.lit("")).rlike(drop_title)).where(text.rlike(keep))
    for org in drop_orgs:
        out = out.where(~F.coalesce(F.col("org"), F.lit("")).startswith(org))
    if orgs is not None:
        within = F.lit(False)
        for org in orgs:
            within = within | F.contains("org", F.lit(org))
        out = out.where(F.coalesce(within, F.lit(False)))
    return out


def daily_feed(articles: DataFrame) -> DataFrame:
    """Articles (day, section_order, url) of working days, each address once, the first section's."""
    return newest_per_key(articles.where(F.weekday("day") < 5).withColumn("_first", -F.col("section_order")), ["url"], "_first", "day").drop("_first")


def version_info(stem: Column) -> tuple[Column, Column]:
    """Family and recency of a file name; a null family means that the file has no versions.

    Questions and answers: a thousand a version, and a date as yyyymmdd. Calls,
    rules and annexes: a date, and 100,000,000 for each numbered correction or
    half of that for one without a number.
    """
    s = F.lower(stem)
    tokens = F.filter(F.split(s, r"[_\s\-.]+"), lambda t: t != "")
    has = lambda word: F.array_contains(tokens, word)
    number = lambda text: F.coalesce(F.nullif(text, F.lit("")).try_cast("long"), F.lit(0).cast("long"))
    stamp = lambda pattern: number(F.regexp_extract(s, pattern, 3)) * 10000 + number(F.regexp_extract(s, pattern, 2)) * 100 + number(F.regexp_extract(s, pattern, 1))
    faq = (F.get(tokens, F.lit(0)) == "faq") | (has("perguntas") & has("frequentes"))
    after = F.get(tokens, (F.array_position(tokens, "anexo")).cast("int"))
    annex = F.when(after.rlike(r"^\d+$"), after).otherwise("geral")
    family = F.when(faq, "__faq__").when(has("regulamento"), "__regulamento__").when(has("anexo"), F.concat(F.lit("__anexo_"), annex, F.lit("__"))).when(has("edital"), "__edital__")
    corrected = number(F.regexp_extract(s, r"(?:^|[_\s\-])(\d+)(?:[ªº°])?[_\s\-]*rerratifica", 1))
    correction = F.when(corrected > 0, corrected * 100_000_000).when(F.exists(tokens, lambda t: F.contains(t, F.lit("rerratificad"))), 50_000_000).otherwise(0)
    recency = F.when(faq, number(F.regexp_extract(s, r"vers[aã]o[_\s\-]*(\d+)", 1)) * 1000 + stamp(r"(\d{2})[_\s\-]?(\d{2})[_\s\-]?(\d{4})"))
    return family, F.when(family.isNull(), 0).otherwise(F.coalesce(recency, stamp(r"(?<!\d)(\d{2})[_.\s\-](\d{2})[_.\s\-](\d{4})(?!\d)") + correction)).cast("long")


def mark_versions(files: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Files (group_key, name) with family, recency and authority: the newest of a family is in force, others superseded.

    Of equal recency the first name wins; overrides (name, authority) win over all.
    """
    family, recency = version_info(F.regexp_replace("name", r"\.[A-Za-z0-9]+$", ""))
    marked = files.withColumns({"family": family, "recency": recency})
    place = F.row_number().over(Window.partitionBy("group_key", "family").orderBy(F.desc("recency"), "name"))
    marked = marked.withColumn("authority", F.when(F.col("family").isNull() | (place == 1), "vigente").otherwise("superseded"))
    if overrides is not None:
        marked = marked.join(small(overrides.select("name", F.col("authority").alias("_by_hand"))), "name", "left").withColumn("authority", F.coalesce("_by_hand", "authority")).drop("_by_hand")
    return marked


def active_documents(documents: DataFrame) -> DataFrame:
    """Documents that aren't superseded."""
    return documents.where(F.coalesce(F.col("authority"), F.lit("vigente")) != "superseded")


def normative_documents(links: DataFrame) -> DataFrame:
    """Links (page, anchor, url) as the call and its amendments, in order of composition.

    The base names a call, is no boilerplate and no amendment; complete ones
    come first, then the newest year in its name.
    """
    a = F.lower(F.coalesce(F.col("anchor"), F.lit("")))
    amends = a.rlike("retifica|aditivo|altera|prorroga")
    year = F.coalesce(F.nullif(F.regexp_extract(F.concat_ws(" ", "anchor", "url"), r"(20\d{2})", 1), F.lit("")).try_cast("int"), F.lit(0))
    told = links.withColumns({"is_amendment": amends, "is_base": a.rlike("edital") & ~amends & ~a.rlike("resultado|minuta|modelo"), "complete": a.rlike("completo"), "recency": year})
    base = Window.partitionBy("page").orderBy(F.desc("complete"), F.desc("recency"), "url")
    bases = told.where("is_base").withColumn("_n", F.row_number().over(base)).where("_n = 1").drop("_n").withColumn("composition_order", F.lit(0))
    later = told.where("is_amendment").withColumn("composition_order", F.row_number().over(Window.partitionBy("page").orderBy("recency", "url")))
    return bases.unionByName(later).select("page", "url", "composition_order", "is_amendment")


def load_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Rows (key, blob) of a store of JSON by key."""
    return spark.read.schema("key string, blob string").parquet(path)


def save_blob(spark: SparkSession, path: str, key: str, blob: str) -> None:
    """Write a blob under its key, in place of what was there."""
    row = spark.createDataFrame([(blob, key)], "blob string, key string")
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules (file, key, rule as JSON) of the YAML blocks in Markdown files; a later block of a file wins over an earlier one.

    Blocks that aren't a mapping are left out. A file of rules is written by
    hand, so one is a row.
    """

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("rule", T.StringType())])))
    def rules(texts: pd.Series) -> pd.Series:
        import yaml

        def of(text):
            merged = {}
            for block in re.findall(r"```yaml\n(.*?)```", text or "", re.S):
                found = yaml.safe_load(block)
                merged |= found if isinstance(found, dict) else {}
            return [{"key": str(k), "rule": json.dumps(v, ensure_ascii=False, default=str)} for k, v in merged.items()]

        return pd.Series([of(text) for text in texts])

    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value")
    return files.select("file", F.explode(rules("value")).alias("r")).select("file", "r.key", "r.rule")


def dimension(spark: SparkSession, rows: list[tuple], schema: str, column: str, allowed: set[str]) -> DataFrame:
    """A small table of rules, with its vocabulary checked."""
    out = spark.createDataFrame(rows, schema)
    bad = out.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).select(column).first()
    if bad:
        raise ValueError(f"{column} has {bad[0]!r}, which is none of {sorted(allowed)}")
    return out
