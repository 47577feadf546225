"""Queries over pages and raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.functions.ids import norm_url
from lodestar.registry import REGISTRY, table
from lodestar.session import shared_path
from lodestar.sources import archives as A, bronze as B, ledger as L, web as W

NORM_SQL = "lower(regexp_replace(regexp_replace({u}, '#.*$', ''), '/+$', ''))"
#: Addresses of every shape, beside those of the pages.
_SHAPES = ["a.b/c", "", "//Host/p/", "mailto:x@y", "HTTP:/x", "https:", "x:y?utm_a=1&b=2#f", "a?b", "http://H.org?gclid=1", "file:///tmp/", "ftp://u@H:21//a//", "?q", "1a:b", "http://h/a?B=1&&UTM_x=2"]
_PARTS_SQL = "regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?', ['s', 'h', 'p', 'q'])"
_NORMAL_SQL = """CASE WHEN x.s <> '' THEN lower(x.s) || ':' ELSE '' END
  || CASE WHEN x.h <> '' THEN '//' || lower(x.h) WHEN starts_with(path, '//') OR (lower(x.s) IN ('http', 'https', 'ftp', 'file') AND (path = '' OR starts_with(path, '/'))) THEN '//' ELSE '' END
  || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END"""
_Q_SQL = "list_filter(string_split(x.q, '&'), lambda kv: kv <> '' AND NOT regexp_matches(lower(kv), '^(utm_|fbclid|gclid|mc_cid|mc_eid)'))"
_HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


@REGISTRY.add(
    "url_identity",
    f"""WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT -1 - i, [{", ".join(f"'{u}'" for u in _SHAPES)}][i + 1] FROM range({len(_SHAPES)}) t(i))
    SELECT page_id, {NORM_SQL.format(u='url')} AS norm, normal, substr(sha1(normal), 1, 12) AS url_hash, nullif({_HOST_SQL}, '') AS host,
      regexp_matches({_HOST_SQL}, '(^|\\.)(instagram|facebook|linkedin|x|twitter|youtube|tiktok)\\.com$') AS social, regexp_matches({_HOST_SQL}, '(^|\\.)(finep\\.gov|fapesp)\\.br$') AS dedicated
    FROM (SELECT page_id, url, {_NORMAL_SQL} AS normal FROM (SELECT page_id, url, x, rtrim(x.p, '/') AS path, {_Q_SQL} AS q FROM (SELECT page_id, url, {_PARTS_SQL} AS x FROM u)))""",
)
def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of every page's address, and of addresses of every shape."""
    shapes = spark.createDataFrame([(-1 - k, u) for k, u in enumerate(_SHAPES)], "page_id long, url string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url").unionByName(shapes)
    return pages.select("page_id", *[c.alias(n) for n, c in W.identity(F.col("url")).items()])


@REGISTRY.add("page_title", """SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&quot;', '"'), '&lt;', '<'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages""")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title of every page."""
    return table(spark, sf_dir, "pages").select("page_id", W.title(F.col("html"), F.col("url")).alias("title"))


@REGISTRY.add(
    "html_plain_text",
    """
    SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ') AS text FROM (
      SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?is)<nav\\b.*?</nav>', ' ', 'g'), '(?is)<footer\\b.*?</footer>', ' ', 'g'),
          '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(p|div|h[1-6]|li|ul|ol|tr|table|article|section|br)\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM pages)
    """,
)
def html_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of every page by the fallback rules."""
    return table(spark, sf_dir, "pages").select("page_id", W.plain_text(F.col("html")).alias("text"))


@REGISTRY.add(
    "hub_links",
    f"""WITH l AS (SELECT page_id, url, unnest(h) AS href, unnest(range(len(h)))::INT AS place FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']([^"'']+)["'']', 1) AS h FROM pages)),
    a AS (SELECT *, CASE WHEN regexp_matches(href, '^(?i)https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || href END AS ab FROM l),
    n AS (SELECT page_id, place, {NORM_SQL.format(u='ab')} AS norm, row_number() OVER (PARTITION BY page_id, {NORM_SQL.format(u='ab')} ORDER BY place) AS k FROM a WHERE ab IS NOT NULL)
    SELECT page_id, norm, place FROM n WHERE k = 1""",
)
def hub_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links of every page, by their ledger form."""
    found = W.links(table(spark, sf_dir, "pages")).where("absolute is not null").withColumn("norm", norm_url(F.col("absolute")))
    return B.newest_per_key(found.withColumn("first", -F.col("place")), ["page_id", "norm"], "first").select("page_id", "norm", "place")


@REGISTRY.add(
    "ledger_dedup",
    f"""SELECT page_id, norm FROM (SELECT page_id, {NORM_SQL.format(u='url')} AS norm FROM pages WHERE page_id % 2 = 1)
    WHERE norm NOT IN (SELECT {NORM_SQL.format(u='url')} FROM pages WHERE page_id % 2 = 0)""",
)
def ledger_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd pages whose address no even page has."""
    pages = table(spark, sf_dir, "pages")
    ledger = pages.where("page_id % 2 = 0").select(norm_url(F.col("url")).alias("norm"))  # the two halves are ledger and candidates
    return W.fresh_only(pages.where("page_id % 2 = 1").select("page_id", "url"), ledger).select("page_id", "norm")


@REGISTRY.add(
    "ttl_reject",
    f"""WITH p AS (SELECT page_id, {NORM_SQL.format(u='url')} AS norm FROM pages),
    r AS (SELECT p.norm, e.ts FROM p JOIN events e ON e.event_id = p.page_id)
    SELECT page_id, norm FROM p WHERE norm NOT IN (SELECT norm FROM r WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAYS)""",
)
def ttl_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that weren't rejected within ten days."""
    pages = table(spark, sf_dir, "pages").select("page_id", norm_url(F.col("url")).alias("norm"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("page_id"), F.col("ts").cast("timestamp").cast("string").alias("rejected_at"))
    return W.not_rejected(pages, pages.join(events, "page_id"), F.to_timestamp(F.lit("2024-01-31 00:00:00")), 10).select("page_id", "norm")


@REGISTRY.add(
    "channel_budget",
    "SELECT event_type AS channel, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) JOIN (VALUES ('view', 5), ('click', 3), ('error', 0)) b(t, budget) ON t = event_type WHERE n <= budget",
)
def channel_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First candidates of each channel within its budget."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), F.col("event_id").alias("seq"))
    return W.within_budget(events, spark.createDataFrame([("view", 5), ("click", 3), ("error", 0)], "channel string, budget int"))


@REGISTRY.add(
    "snapshot_dedup",
    "SELECT source, lang, max_by(doc_id, (n_chars, doc_id)) AS doc_id FROM documents GROUP BY 1, 2",
)
def snapshot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source and language, the record that is last."""
    return B.newest_per_key(table(spark, sf_dir, "documents"), ["source", "lang"], "n_chars", "doc_id").select("source", "lang", "doc_id")


@REGISTRY.add("snapshot_latest", "SELECT doc_id FROM documents WHERE source = (SELECT max(source) FROM documents)")
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the last snapshot, with sources as its files."""
    return B.latest_snapshot(table(spark, sf_dir, "documents"), "source").select("doc_id")


@REGISTRY.add("distinct_natives", "SELECT DISTINCT 'customer' AS source, c_nationkey::VARCHAR AS native FROM customer UNION SELECT 'supplier', s_nationkey::VARCHAR FROM supplier")
def distinct_natives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids of two sources."""
    side = lambda name, key: table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.col(key).cast("string").alias("native"))
    return B.distinct_natives(side("customer", "c_nationkey"), side("supplier", "s_nationkey"))


_FILES_SQL = """
f AS (SELECT o_custkey AS group_key, o_orderkey, o_orderdate, CASE o_orderkey % 4 WHEN 0 THEN 'edital_' || strftime(o_orderdate, '%d_%m_%Y') WHEN 1 THEN 'FAQ-versao-' || (o_orderkey % 9) WHEN 2 THEN 'anexo_' || (o_orderkey % 3) || '_' || (1 + o_orderkey % 5) || 'a-rerratificacao' ELSE 'outro_' || o_orderkey END || '.pdf' AS name FROM orders),
v AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN '__edital__' WHEN 1 THEN '__faq__' WHEN 2 THEN '__anexo_' || (o_orderkey % 3) || '__' END AS family,
      CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d')::BIGINT WHEN 1 THEN (o_orderkey % 9) * 1000 ELSE 0 END AS recency FROM f)
"""


@REGISTRY.add(
    "latest_version",
    f"WITH {_FILES_SQL} SELECT o_orderkey, coalesce(family, '') AS family, recency, CASE WHEN family IS NULL OR row_number() OVER (PARTITION BY group_key, family ORDER BY recency DESC, name, o_orderkey) = 1 THEN 'vigente' ELSE 'superseded' END AS authority FROM v",
)
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family, recency and authority of file names made from orders."""
    key = F.col("o_orderkey")
    name = (
        F.when(key % 4 == 0, F.concat(F.lit("edital_"), F.date_format("o_orderdate", "dd_MM_yyyy")))
        .when(key % 4 == 1, F.concat(F.lit("FAQ-versao-"), (key % 9).cast("string")))
        .when(key % 4 == 2, F.concat(F.lit("anexo_"), (key % 3).cast("string"), F.lit("_"), (1 + key % 5).cast("string"), F.lit("a-rerratificacao")))
        .otherwise(F.concat(F.lit("outro_"), key.cast("string")))
    )
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_key"), "o_orderkey", F.concat(name, F.lit(".pdf")).alias("name"))
    # Equal names are told apart by the order's key.
    marked = B.mark_versions(files.withColumn("name", F.concat(F.regexp_replace("name", r"\.pdf$", ""), F.lit("."), F.lpad(key.cast("string"), 12, "0"))))
    return marked.select("o_orderkey", F.coalesce("family", F.lit("")).alias("family"), "recency", "authority")


@REGISTRY.add(
    "archive_articles",
    "SELECT doc_id, coalesce(source, '') AS org, coalesce(lang, '') AS type, sha256(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]|<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS body_sha256 FROM documents",
)
def archive_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an article of zip archives, read back from them."""
    # Characters that XML has no place for become spaces.
    plain = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    escaped = lambda c: F.replace(F.replace(F.replace(plain(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    article = F.format_string('<xml><article idMateria="%s" artType="%s" artCategory="%s"><body><Texto>%s</Texto></body></article></xml>', "doc_id", escaped("lang"), escaped("source"), escaped("text"))
    entries = table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".xml")).alias("entry"), article.cast("binary").alias("content"))
    folder = shared_path(spark, "archives")
    A.write_archives(entries, f"{folder}/zip").write.parquet(f"{folder}/listing")
    read = A.read_gazette(spark, spark.read.parquet(f"{folder}/listing").select("archive", "length"))
    return read.select(F.col("native").cast("long").alias("doc_id"), "org", "type", F.sha2("body", 256).alias("body_sha256"))


@REGISTRY.add(
    "ledger_buckets",
    f"""SELECT page_id, norm FROM (SELECT page_id, {NORM_SQL.format(u='url')} AS norm FROM pages WHERE page_id % 2 = 1)
    WHERE norm NOT IN (SELECT {NORM_SQL.format(u='url')} FROM pages WHERE page_id % 2 = 0)""",
)
def ledger_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd pages whose address a ledger in buckets doesn't have, to which even pages were appended in two runs."""
    pages = table(spark, sf_dir, "pages").withColumn("norm", norm_url(F.col("url"))).select("page_id", "norm")
    ledger = L.BucketedLedger(spark, shared_path(spark, "ledger"))
    for run in (0, 2):
        ledger.append(pages.where(F.col("page_id") % 4 == run))
    return ledger.fresh(pages.where("page_id % 2 = 1"))
