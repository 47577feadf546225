"""Queries over gates, ledgers, overlays and fields: operators that settle one row or one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.functions.text import word_tokens
from lodestar.operators import coverage as V, generations as N, gold as O, matching as M, metrics as X, silver as S, validity as T
from lodestar.registry import REGISTRY, table
from lodestar.session import shared_path
from lodestar.sources import bronze as B
from lodestar.sources.versions import VersionedTable

_WORDS = "[x FOR x IN regexp_extract_all({t}, '[^ \\t\\n\\r\\f\\v]+')]"


def _words(column: str):
    return F.filter(F.split(column, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


@REGISTRY.add(
    "agency_split",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'MAKER|' || p_brand WHEN p_size % 3 = 1 THEN 'MAKER|' || p_brand || '|FAPs' ELSE p_brand END AS agencies FROM part""",
)
def agency_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agencies that a text joins, by their canonical names."""
    n = F.col("p_size") % 3
    text = F.when(n == 0, F.concat(F.lit(" Fábrica / "), "p_brand")).when(n == 1, F.concat(F.lit("fabrica; "), "p_brand", F.lit(" e FAPs"))).otherwise(F.concat(F.lit(" ;"), F.col("p_brand"), F.lit(" / ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(O.split_agencies(text, {"fabrica": "MAKER"}), "|").alias("agencies"))


@REGISTRY.add(
    "mechanism_and_format",
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'subvencao' WHEN 1 THEN 'bolsa' WHEN 2 THEN 'equity' WHEN 3 THEN 'subvencao' END AS mechanism,
      CASE WHEN p_type = 'STEEL' THEN 'aco' ELSE lower(p_type) || '_fase' END AS format, CASE p_size % 4 WHEN 0 THEN 'SP' WHEN 1 THEN 'RJ' WHEN 2 THEN 'MG' END AS state FROM part""",
)
def mechanism_and_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mechanism, format and state that texts of parts make plain."""
    said = F.get(F.split(F.lit("Subvenção econômica|Uma BOLSA|por Equity|Recurso não-reembolsável|outro"), r"\|"), (F.col("p_size") % 5).cast("int"))
    address = F.get(F.split(F.lit("Rua A, São Paulo, SP |Av. RJ 10 XX|MG - SP, Rua B, MG|sem estado"), r"\|"), (F.col("p_size") % 4).cast("int"))
    form = F.when(F.col("p_type") == "STEEL", F.lit(" Aço ")).otherwise(F.concat("p_type", F.lit("-Fase")))
    return table(spark, sf_dir, "part").select("p_partkey", O.mechanism_of(said).alias("mechanism"), O.format_of(form, {"aco": "aco"}).alias("format"), O.state_of(address).alias("state"))


@REGISTRY.add(
    "programme_tokens",
    """WITH t AS (SELECT p_partkey AS id, unnest(list_distinct(regexp_extract_all(lower(p_name || ' unique' || p_partkey), '[a-z0-9]{6,}'))) AS token FROM part),
    u AS (SELECT token, min(id) AS id FROM t GROUP BY 1 HAVING count(DISTINCT id) = 1),
    w AS (SELECT o_orderkey AS key, unnest(['about', 'unique' || o_custkey, 'unique' || (o_custkey + 1)]) AS token, unnest([1, 2, 3]) AS place FROM orders)
    SELECT o_orderkey AS key, programme FROM orders LEFT JOIN (SELECT key, arg_min(id, place) AS programme FROM w JOIN u USING (token) GROUP BY 1) d ON d.key = o_orderkey""",
)
def programme_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programme that the first telling token of a title names; tokens of several programmes tell nothing."""
    programmes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" Unique"), F.col("p_partkey").cast("string")).alias("name"))
    titles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("About UNIQUE"), F.col("o_custkey").cast("string"), F.lit(", únique"), (F.col("o_custkey") + 1).cast("string")).alias("title"))
    return O.detect_programme(titles, O.unique_tokens(programmes, [])).select("key", "programme")


@REGISTRY.add(
    "ticket_range",
    "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS low, CASE WHEN c_custkey % 3 > 0 THEN c_custkey::DOUBLE END AS high FROM customer",
)
def ticket_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and most money; negative numbers and words are none."""
    low, high = O.ticket(F.col("c_acctbal").cast("string"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey").cast("string")).otherwise("muito"))
    return table(spark, sf_dir, "customer").select("c_custkey", low.alias("low"), high.alias("high"))


@REGISTRY.add(
    "evidence_gate",
    f"""WITH w AS (SELECT doc_id, source, {_WORDS.format(t='text')} AS ws FROM documents)
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN 0 ELSE 1 END AS n_quotes, len(ws) > 0 AND ws[1] = source AS title_only, len(ws) > 1 AS grounded, false AS apart FROM w""",
)
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that hold a text's first word, whether they are its title only, and grounding of its first two words."""
    words = _words("text")
    first = F.get(words, F.lit(0))
    items = F.when(first.isNotNull(), F.array(first)).otherwise(F.array(F.lit("not there")))
    quotes = F.when(first.isNotNull(), F.array(F.concat(F.lit("  "), first, F.lit(" ")), first, F.lit(""))).otherwise(F.array(F.lit("other")))
    pair = F.when(F.size(words) > 1, F.concat_ws("\n  ", first, F.get(words, F.lit(1))))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(S.evidence_quotes(items, quotes)).alias("n_quotes"), F.coalesce(S.title_only(first, F.array(F.array(F.concat(F.col("source"), F.lit(" "))))), F.lit(False)).alias("title_only"),
        S.grounded(F.col("text"), pair).alias("grounded"), S.grounded(F.col("text"), F.lit(" ")).alias("apart"))


@REGISTRY.add(
    "evidence_codes",
    """WITH p AS (SELECT p_partkey, [p_type, p_brand] AS e, CASE WHEN p_size % 3 = 0 THEN [p_brand, p_type] WHEN p_size % 3 = 1 THEN [p_brand] ELSE [p_brand, p_type, 'x'] END AS c, CASE WHEN p_size % 2 = 0 THEN ['y'] ELSE [p_brand] END AS m FROM part)
    SELECT p_partkey, p_size % 3 = 0 AND p_size % 2 = 0 AS holds FROM p JOIN part USING (p_partkey)""",
)
def evidence_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether evidence is for just the confirmed codes and none of them is missing."""
    n = F.col("p_size")
    confirmed = F.when(n % 3 == 0, F.array("p_brand", "p_type")).when(n % 3 == 1, F.array("p_brand")).otherwise(F.array("p_brand", "p_type", F.lit("x")))
    missing = F.when(n % 2 == 0, F.array(F.lit("y"))).otherwise(F.array("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", S.evidence_contract(F.array("p_type", "p_brand"), confirmed, missing).alias("holds"))


@REGISTRY.add(
    "coerced_values",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey::VARCHAR END AS whole, CASE WHEN o_orderkey % 4 = 0 THEN 'not_a_integer' END AS why, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS said FROM orders""",
)
def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of two forms, whole numbers and texts in their normal form, with a reason for what is none."""
    key = F.col("o_orderkey")
    day, _ = S.coerce(F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")), "date")
    whole, why = S.coerce(F.when(key % 4 > 0, key.cast("string")).otherwise("some"), "integer")
    said, _ = S.coerce(F.when(key % 5 > 0, F.concat(F.lit(" \n"), "o_orderpriority", F.lit("  "))).otherwise(" "), "text")
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), whole.alias("whole"), why.alias("why"), said.alias("said"))


@REGISTRY.add(
    "section_carry",
    """WITH l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT - 1 AS idx, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS s FROM orders)
    SELECT o_orderkey, idx, last_value(s IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY idx) AS section FROM l""",
)
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as blocks with a running number and the last open section."""
    blocks = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", F.array("o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("section_path"))
    numbered = S.renumber(blocks, ["o_custkey"], "o_orderdate", "o_orderkey").withColumn("page", F.lit(1))
    return S.carry_sections(numbered, ["o_custkey"]).select("o_orderkey", "idx", F.get("section_path", F.lit(0)).alias("section"))


@REGISTRY.add(
    "index_mismatch",
    """WITH d AS (SELECT o_custkey AS subject, count(*) AS n_chunks FROM orders GROUP BY 1), h AS (SELECT o_custkey AS subject, count(*) AS n FROM orders WHERE o_orderkey % 11 > 0 GROUP BY 1)
    SELECT subject, n_chunks FROM d LEFT JOIN h USING (subject) WHERE coalesce(n, 0) <> n_chunks OR subject % 7 = 0""",
)
def index_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose index lacks an order or is of another content."""
    orders = table(spark, sf_dir, "orders").withColumn("subject", F.col("o_custkey"))
    desired = orders.groupBy("subject").agg(F.count("*").alias("n_chunks")).withColumn("content_hash", F.lit("h"))
    indexed = orders.where("o_orderkey % 11 > 0").select("subject", F.when(F.col("subject") % 7 == 0, "old").otherwise("h").alias("content_hash"))  # one in eleven isn't indexed
    return S.index_mismatch(desired, indexed).select("subject", "n_chunks")


@REGISTRY.add(
    "chunk_changes",
    """WITH d AS (SELECT l_partkey AS k, l_returnflag AS text, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT l_partkey AS k, l_returnflag AS text, count(*) AS n FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1, 2),
    x AS (SELECT p_partkey AS k, 'gone' AS text FROM part WHERE p_size % 10 = 0)
    SELECT k, text, 'add' AS what, d.n - coalesce(c.n, 0) AS n FROM d LEFT JOIN c USING (k, text) WHERE d.n > coalesce(c.n, 0) UNION ALL SELECT k, text, 'drop', 1 FROM x""",
)
def chunk_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to add to an index and to drop from it, repeated rows counted, made-up rows left alone."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("text"), "l_linenumber")
    part = table(spark, sf_dir, "part")
    stored = rows.where("l_linenumber <> 2").select("k", "text", F.lit("profile").alias("origin"))  # second lines aren't indexed yet
    extra = part.where("p_size % 10 = 0").select(F.col("p_partkey").alias("k"), F.lit("gone").alias("text"), F.lit("profile").alias("origin"))
    made_up = part.select(F.col("p_partkey").alias("k"), F.lit("made up").alias("text"), F.lit("hyde").alias("origin"))
    add, drop = S.multiset_changes(rows.select("k", "text"), stored.unionByName(extra).unionByName(made_up))
    return add.withColumn("what", F.lit("add")).unionByName(drop.withColumn("what", F.lit("drop"))).groupBy("k", "text", "what").agg(F.count("*").alias("n"))


@REGISTRY.add("cold_start", "SELECT doc_id, n_chars < 280 AND doc_id % 2 = 0 AS cold FROM documents")
def cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles that say so little that a made-up document should stand in."""
    return table(spark, sf_dir, "documents").select("doc_id", S.wants_made_up(F.col("doc_id") % 2, F.col("n_chars")).alias("cold"))


@REGISTRY.add(
    "append_only",
    """WITH s AS (SELECT DISTINCT user_id, event_type FROM events WHERE value < 40), n AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE value >= 40 GROUP BY 1, 2)
    SELECT n.* FROM n LEFT JOIN s USING (user_id, event_type) WHERE s.user_id IS NULL""",
)
def append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts to append: those whose key isn't stored, each once; repeated ones are no error."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    made = VersionedTable(spark, shared_path(spark, "attempts"), ["user_id", "event_type"])
    made.append(rows.where("value < 40"), "event_id")
    made.append(rows.where("value >= 40"), "event_id")
    return made.read().where("value >= 40").select("user_id", "event_type", "event_id")


@REGISTRY.add(
    "append_conflicts",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 6 = 0 AND o_orderstatus <> 'F' OR o_orderkey % 10 = 0 AND o_orderkey % 6 > 0)""",
)
def append_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have a stored key with another payload; null is a payload."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    key = F.col("o_orderkey")
    stored = rows.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(key % 6 == 0, "F").when(key % 10 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))  # even keys are stored
    return O.conflicts(stored, rows, ["o_orderkey"], ["o_orderstatus"])


@REGISTRY.add(
    "latest_bundle",
    """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC NULLS LAST, event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1""",
)
def latest_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last complete bundle of every user."""
    return T.latest(table(spark, sf_dir, "events").where("event_type <> 'error'"), ["user_id"], F.col("ts"), F.col("value"), F.col("event_id")).select("user_id", "event_id")


@REGISTRY.add(
    "public_paths",
    "SELECT p_partkey, array_to_string(list_sort(list_filter(['public.name', 'public.price', 'private.cost'], lambda p: starts_with(p, 'public.') AND (p <> 'public.price' OR p_size % 2 = 0))), ',') AS paths FROM part",
)
def public_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of provenance that may be shown: public ones that can be cited."""
    fact = lambda citable: F.struct(F.lit("stated").alias("state"), citable.alias("citable"))
    made = F.create_map(F.lit("public.price"), fact(F.col("p_size") % 2 == 0), F.lit("public.name"), fact(F.lit(True)), F.lit("private.cost"), fact(F.lit(True)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(O.public_provenance(made, r"^public\."))), ",").alias("paths"))


@REGISTRY.add(
    "backfill",
    """SELECT o_orderkey, 'status' AS path, o_orderstatus AS value FROM orders WHERE o_orderkey % 3 > 0 AND (o_orderkey % 5 > 0 OR o_orderstatus = 'O')""",
)
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that were derived again as they are stored, for paths without provenance yet."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    again = orders.select("o_orderkey", F.lit("status").alias("path"), F.col("o_orderstatus").alias("value"))
    stored = again.withColumn("value", F.when(key % 5 == 0, "O").otherwise(F.col("value")))
    return O.backfill(again, stored, again.where("o_orderkey % 3 = 0"), ["o_orderkey", "path"])  # a third has provenance


@REGISTRY.add(
    "chunk_anchor",
    """WITH r AS (SELECT source, text, count(*) AS n, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2)
    SELECT d.doc_id AS chunk, r.doc_id AS idx FROM documents d JOIN r USING (source, text) WHERE n = 1""",
)
def chunk_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of stored chunks whose text just one repacked chunk of the source has."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("entity"), "doc_id", "text").where("entity IS NOT NULL AND text IS NOT NULL")
    stored = docs.withColumnRenamed("doc_id", "chunk")
    return O.chunk_coordinates(stored, docs.select("entity", "text", F.lit("d").alias("doc"), F.col("doc_id").alias("idx"))).select("chunk", "idx")


@REGISTRY.add("trial_sample", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 3")
def trial_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three rows of each kind: a trial run's sample."""
    return O.sample_by_kind(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], "event_id", 3)


@REGISTRY.add(
    "review_overlay",
    """WITH r AS (SELECT user_id AS claim_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1)
    SELECT c_custkey AS claim_id, CASE last WHEN 'error' THEN 'unknown' WHEN 'click' THEN 'stated' WHEN 'purchase' THEN 'stated' ELSE 'inferred' END AS state,
      CASE last WHEN 'error' THEN NULL WHEN 'purchase' THEN 'new' ELSE c_mktsegment END AS value FROM customer LEFT JOIN r ON claim_id = c_custkey""",
)
def review_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the decision of their last review over them."""
    claims = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("claim_id"), F.lit("inferred").alias("state"), F.col("c_mktsegment").alias("value"))
    kind = F.col("event_type")
    decision = F.when(kind == "error", "mark_unknown").when(kind == "click", "confirm").when(kind == "purchase", "correct").otherwise("defer")
    reviews = table(spark, sf_dir, "events").select(F.col("user_id").alias("claim_id"), decision.alias("decision"), F.lit("new").alias("corrected"), F.struct("ts", "event_id").alias("created"))
    return O.review_overlay(claims, reviews)


@REGISTRY.add(
    "field_gaps",
    """WITH f AS (SELECT o_custkey, o_orderpriority AS field, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1)
    SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN list_contains(list(field) FILTER (o_orderstatus <> 'F'), '1-URGENT') THEN [] ELSE ['1-URGENT'] END, coalesce(list(field) FILTER (o_orderstatus = 'F'), [])))), ',') AS gaps FROM f GROUP BY 1""",
)
def field_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that customers lack: one that all should have, and those whose claims aren't settled."""
    one = T.latest(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], -F.col("o_orderkey"))
    states = F.collect_list(F.struct(F.col("o_orderpriority").alias("field"), F.when(F.col("o_orderstatus") == "F", "unknown").when(F.col("o_orderstatus") == "O", "stated").otherwise("inferred").alias("state")))
    return one.groupBy("o_custkey").agg(states.alias("states")).select("o_custkey", F.array_join(O.gaps(F.array(F.lit("1-URGENT")), F.col("states")), ",").alias("gaps"))


@REGISTRY.add("family_values", "SELECT c_custkey AS subject, CASE WHEN c_custkey % 3 = 0 THEN 'new' WHEN c_custkey % 2 = 0 THEN 'old' END AS value FROM customer")
def family_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of an active family where it has one, else the legacy ones."""
    subjects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"))
    adaptive = subjects.where("subject % 3 = 0").withColumn("value", F.lit("new"))  # a third has a new value
    legacy = subjects.where("subject % 2 = 0").withColumn("value", F.lit("old"))  # half have an old one
    return O.family_or_legacy(subjects, adaptive, legacy, True)


@REGISTRY.add(
    "inferred_sectors",
    "SELECT doc_id, array_to_string(list_filter(['The', 'És', 'Ein'], lambda s: contains(lower(strip_accents(text)), lower(strip_accents(s)))), ',') AS sectors FROM documents",
)
def inferred_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that occur in a document, without accents and in lower case."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(M.infer_sectors(F.col("text"), ["The", "És", "Ein"]), ",").alias("sectors"))


@REGISTRY.add(
    "cached_verdicts",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 6 > 0 THEN o_orderstatus END AS verdict FROM orders""",
)
def cached_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts that a cache has for the same inputs; the rest is to be judged."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    wanted = orders.select("o_orderkey", M.verdict_hash(key, F.round("o_totalprice", 2)).alias("input_hash"))
    cache = orders.where("o_orderkey % 2 = 0").select("o_orderkey", M.verdict_hash(key, F.round(F.when(key % 6 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), 2)).alias("input_hash"), F.col("o_orderstatus").alias("verdict"))  # half are cached, a sixth for other inputs
    hits, misses = M.cached(wanted, cache, ["o_orderkey", "input_hash"])
    return hits.select("o_orderkey", "verdict").unionByName(misses.select("o_orderkey", F.lit(None).cast("string").alias("verdict")))


@REGISTRY.add(
    "match_paths",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'parceria' WHEN 1 THEN 'programa' WHEN 2 THEN 'credito' END AS path, CASE WHEN p_size % 4 = 0 OR p_size % 3 = 0 OR p_size % 5 = 0 THEN 'possibilidade' WHEN p_size % 5 = 1 THEN 'candidatura_viavel' ELSE 'lacunas' END AS status,
      CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'R$ 1,000 – R$ ' || format('{:,}', 1000 + p_partkey) WHEN p_size % 3 = 0 THEN 'até R$ ' || format('{:,}', 1000 + p_partkey) WHEN p_size % 2 = 0 THEN 'a partir de R$ 1,000' END AS money FROM part""",
)
def match_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, status and money of parts as entities."""
    n = F.col("p_size")
    kind = F.when(n % 4 == 0, "ict").when(n % 4 == 1, "programa").otherwise("edital")
    text = F.when(n % 4 == 2, "Linha de Crédito").otherwise("outro")
    project = M.has_project(F.lit(" "), F.when(n % 3 > 0, F.col("p_name")))
    status = F.when(n % 5 == 1, "elegivel").when(n % 5 > 1, "nao_verificada")
    money = M.money_range(F.when(n % 2 == 0, F.lit(1000.0)), F.when(n % 3 == 0, 1000.0 + F.col("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", M.path_kind(kind, text).alias("path"), M.path_status(kind, project, status).alias("status"), money.alias("money"))


@REGISTRY.add("partners", "SELECT p_partkey AS id FROM part WHERE list_has_any(string_split(lower(p_name), ' '), ['ring', 'small']) ORDER BY 1 LIMIT 4")
def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four centres that share a theme."""
    return M.partners(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower("p_name"), " ").alias("themes")), F.array(F.lit("ring"), F.lit("small"))).select("id")


@REGISTRY.add("match_snapshot", "SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS squares FROM embeddings")
def match_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared vectors, kept as a table under the value of a probe; the second call takes what the first has stored."""
    rows = table(spark, sf_dir, "embeddings")
    store = VersionedTable(spark, shared_path(spark, "snapshot"), ["vec_id"])
    probe = M.freshness(table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "updated"), rows)
    squares = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    for _ in range(2):
        kept = M.snapshot(store, probe, lambda: rows.select("vec_id", "label", F.round(squares, 6).alias("squares")))
    return kept


@REGISTRY.add("freshness", "SELECT (SELECT count(*) FROM orders) AS n, (SELECT max(o_orderdate) FROM orders) AS newest, (SELECT count(*) FROM embeddings) AS n_chunks")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row that changes when a snapshot is out of date."""
    return M.freshness(table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "updated"), table(spark, sf_dir, "embeddings"))


@REGISTRY.add(
    "section_coverage",
    "SELECT round(avg((trim(coalesce(CASE WHEN doc_id % 4 > 0 THEN source ELSE ' ' END, '')) <> '')::INT), 6) AS covered, count(DISTINCT CASE WHEN doc_id % 4 > 0 THEN source END) AS sections FROM documents",
)
def section_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents with a section, and distinct sections."""
    return X.section_coverage(table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 > 0, F.col("source")).otherwise(" ").alias("section")))


@REGISTRY.add(
    "boundary_alignment",
    """WITH l AS (SELECT doc_id, text, ls, len(ls) AS n FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents))
    SELECT doc_id, len([i FOR i IN range(1, n + 1) IF regexp_matches(ls[i], '^[A-E]') AND (i = 1 OR regexp_matches(ls[i - 1], '^[ \\t]*$'))]) AS at_blank, len([i FOR i IN range(1, n + 1) IF regexp_matches(ls[i], '^[A-E]')]) AS headers FROM l""",
)
def boundary_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin like a header: at the start or after a blank line, and all."""
    at_blank, headers = X.boundary_alignment(F.col("text"), "[A-E]")
    return table(spark, sf_dir, "documents").select("doc_id", at_blank.cast("long").alias("at_blank"), headers.cast("long").alias("headers"))


@REGISTRY.add(
    "multiset_recall",
    """WITH e AS (SELECT l_partkey, l_returnflag AS v, count(*) AS want, count(*) FILTER (l_linenumber % 2 = 1) AS got FROM lineitem GROUP BY 1, 2) SELECT l_partkey, round(sum(least(want, got)) / sum(want), 6) AS recall FROM e GROUP BY 1""",
)
def multiset_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the flags of a part's lines that its odd lines have, counted."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("value"), "l_linenumber")
    return X.multiset_recall(rows.where("l_linenumber % 2 = 1"), rows, ["l_partkey"])


@REGISTRY.add(
    "prefix_recall",
    """WITH e AS (SELECT l_suppkey AS k, p_name || ' ' || p_type AS t, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey), w AS (SELECT k, t, row_number() OVER () AS i FROM e WHERE l_linenumber = 1),
    h AS (SELECT w.k, i, max(coalesce(contains(lower(o.t), lower(substr(w.t, 1, 30))), false)::INT) AS hit FROM w LEFT JOIN (SELECT DISTINCT k, t FROM e WHERE l_linenumber = 2) o ON o.k = w.k GROUP BY 1, 2)
    SELECT k, round(avg(hit), 6) AS recall FROM h GROUP BY 1""",
)
def prefix_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of headings whose start is in one of a supplier's other headings."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("k"), F.concat_ws(" ", "p_name", "p_type").alias("text"), "l_linenumber")
    return X.prefix_recall(lines.where("l_linenumber = 2").select("k", "text"), lines.where("l_linenumber = 1").select("k", "text"), "k").withColumn("recall", F.round("recall", 6))


@REGISTRY.add(
    "field_presence",
    """WITH r AS (SELECT o_orderpriority AS field, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS got, CASE WHEN o_orderkey % 4 > 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END END AS want FROM orders)
    SELECT field, round(avg(((got IS NULL) = (want IS NULL))::INT), 6) AS presence, round(avg((got = want)::INT), 6) AS value FROM r GROUP BY 1""",
)
def field_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two extractions on what is there, and on its value."""
    key = F.col("o_orderkey")
    want = F.when(key % 4 > 0, F.when(key % 5 == 0, "F").otherwise(F.col("o_orderstatus")))
    return X.presence(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("field"), F.when(key % 3 > 0, F.col("o_orderstatus")).alias("got"), want.alias("want")))


@REGISTRY.add(
    "faithfulness",
    f"""WITH w AS (SELECT doc_id, {_WORDS.format(t='text')} AS ws FROM documents) SELECT doc_id, len(ws) > 2 AND NOT doc_id % 3 = 0 AS faithful FROM w""",
)
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether evidence, here the second and third word, is in its text however spaced and in any case."""
    words = _words("text")
    quote = F.when(F.size(words) > 2, F.concat(F.lower(F.concat_ws("\t\n", F.get(words, F.lit(1)), F.get(words, F.lit(2)))), F.when(F.col("doc_id") % 3 == 0, F.lit(" §§")).otherwise("")))
    return table(spark, sf_dir, "documents").select("doc_id", X.faithful(quote, F.col("text")).alias("faithful"))


@REGISTRY.add(
    "opportunity_guard",
    """SELECT l.doc_id, CASE WHEN quality = 1 AND n_chars <= 400 AND n_chars % 11 > 0 THEN 0 ELSE 1 END AS kept FROM labels l JOIN documents d USING (doc_id)""",
)
def opportunity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 only where a true opportunity is lost."""
    n = F.col("n_chars")
    got = F.when(n % 11 > 0, F.when(n > 400, "in_scope").otherwise("out_of_scope"))
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", X.opportunity_guard(F.when(F.col("quality") == 1, "in_scope").otherwise("out_of_scope"), got).alias("kept"))


@REGISTRY.add(
    "gold_recall",
    """WITH g AS (SELECT item_id AS query, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS g FROM benchmark),
    r AS (SELECT i.item_id AS query, list_intersect(g, list_distinct(regexp_extract_all(lower(d.text), '[\\p{L}\\p{N}_]+'))) AS hit FROM benchmark i JOIN g ON query = item_id JOIN documents d ON d.doc_id IN (i.item_id, i.item_id + 1, i.item_id + 2))
    SELECT query, round(coalesce((SELECT count(DISTINCT w) FROM (SELECT unnest(hit) AS w FROM r WHERE r.query = g.query)), 0) / nullif(len(g), 0), 4) AS recall, round(coalesce((SELECT max(len(hit)) FROM r WHERE r.query = g.query), 0) / nullif(len(g), 0), 4) AS best_chunk_recall FROM g""",
)
def gold_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a benchmark item's words in three documents together, and in the best of them."""
    gold = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    ranked = gold.select("query", F.posexplode(F.array(*[F.col("query") + k for k in range(3)])).alias("place", "doc_id")).join(table(spark, sf_dir, "documents"), "doc_id")
    return X.gold_recall(ranked.select("query", (F.col("place") + 1).alias("rank"), "text"), gold, 3)


@REGISTRY.add(
    "expected_places",
    "SELECT doc_id, source = 'src1' AND (doc_id % 2 = 0 OR lang = 'de') AS found, doc_id % 7 = 0 AND source = 'src1' AS first FROM documents",
)
def expected_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a hit is where it is expected, with and without a section, and whether the first is."""
    want = F.when(F.col("doc_id") % 2 > 0, "de")
    docs = table(spark, sf_dir, "documents").select("doc_id", X.matches_expected(F.col("source"), F.col("lang"), F.lit("src1"), want).alias("found"), "source")
    first = X.top1(docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("query"), F.lit(1).alias("rank"), F.col("source").alias("id")), docs.select(F.col("doc_id").alias("query"), F.lit(1).alias("rank"), F.lit("src1").alias("id")))  # one in seven has a hit
    return docs.join(first, F.col("doc_id") == F.col("query")).select("doc_id", "found", F.col("top1").alias("first"))


@REGISTRY.add(
    "daily_feed",
    """WITH a AS (SELECT event_id, ts::DATE AS day, user_id % 50 AS u, event_type FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5) SELECT u AS url, arg_min(event_id, (event_type, day, event_id)) AS event_id FROM (SELECT u, event_type, event_id, -epoch(day)::BIGINT AS day FROM a) GROUP BY 1""",
)
def daily_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of working days, each address once, the first section's."""
    kinds = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
    order = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()])
    rows = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), (F.col("user_id") % 50).alias("url"), order.alias("section_order"))
    # Of one section and day, the earliest event: a section's order within a day is that of its events.
    once = T.latest(rows, ["url", "section_order", "day"], -F.col("event_id"))
    return B.daily_feed(once).select("url", "event_id")


@REGISTRY.add(
    "gazette_candidates",
    """SELECT doc_id FROM documents WHERE lang NOT IN ('de') AND NOT coalesce(source = 'src2', false) AND NOT regexp_matches(coalesce(string_split(text, chr(10))[1], ''), '^The ') AND regexp_matches(concat_ws(' ', string_split(text, chr(10))[1], text), '(?i)and|est')""",
)
def gazette_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles that may be calls: not of some types, bodies or titles, with a word that must be there."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.upper("lang").alias("type"), F.when(F.col("source") == "src2", "Poder X").otherwise(F.col("source")).alias("org"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("text").alias("body"))
    return B.gazette_candidates(rows, ["DE"], ["Poder"], "^The ", "(?i)and|est").select("doc_id")


@REGISTRY.add(
    "required_fields",
    "SELECT o_orderkey, array_to_string(list_concat(CASE WHEN o_orderkey % 5 = 0 THEN ['name'] ELSE [] END, CASE WHEN o_orderkey % 7 = 0 THEN ['url'] ELSE [] END), ',') AS lacking FROM orders",
)
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What records lack of what they must have."""
    key = F.col("o_orderkey")
    good, bad = B.require(table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 5 == 0, " ").otherwise("n").alias("name"), F.when(key % 7 > 0, "u").alias("url")), ["name", "url"])
    return good.select("o_orderkey", F.lit("").alias("lacking")).unionByName(bad.select("o_orderkey", F.array_join("lacking", ",").alias("lacking")))


@REGISTRY.add(
    "described_records",
    """WITH h AS (SELECT l_orderkey AS key, arg_min('H' || l_partkey, l_linenumber) AS heading FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_returnflag DESC) AS n FROM lineitem) WHERE l_returnflag = 'R' AND n = 1 GROUP BY 1)
    SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 > 0 THEN 'Title' ELSE heading END AS name, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate::DATE END AS deadline, CASE WHEN o_orderstatus = 'F' THEN 'EM_ANALISE' ELSE o_orderstatus END AS status FROM orders LEFT JOIN h ON key = o_orderkey""",
)
def described_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, deadlines and statuses of raw records; the first heading stands in for a title."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    bronze = orders.select(key.alias("key"), F.when(key % 3 > 0, " Title ").otherwise(" ").alias("title"), F.when(key % 4 > 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("soon").alias("deadline"))
    lines = T.latest(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], -F.col("l_partkey"), F.col("l_returnflag"))
    blocks = lines.select(F.col("l_orderkey").alias("key"), F.when(F.col("l_returnflag") == "R", "heading").otherwise("paragraph").alias("kind"), F.concat(F.lit("H"), F.col("l_partkey").cast("string")).alias("text"), F.col("l_linenumber").alias("idx"))
    status = orders.select(key.alias("key"), B.status_of(F.when(F.col("o_orderstatus") == "F", " em  analise ").otherwise(F.col("o_orderstatus"))).alias("status"))
    return B.describe(bronze, blocks).join(status, "key").select("key", "name", "deadline", "status")


@REGISTRY.add(
    "run_transitions",
    """SELECT event_id AS run_id, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'succeeded' WHEN event_type = 'view' THEN 'running' ELSE event_type END AS status FROM events""",
)
def run_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their final status; one that has ended stays as it is."""
    events = table(spark, sf_dir, "events")
    runs = events.select(F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")).alias("status"))
    return V.finish_runs(runs, events.where("event_id % 2 = 0").select(F.col("event_id").alias("run_id"), F.lit("succeeded").alias("final")))  # half report an end


@REGISTRY.add(
    "stage_status",
    """SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'failed' WHEN bool_or(o_orderpriority = '5-LOW') THEN 'completed' ELSE 'running' END AS status FROM orders GROUP BY 1""",
)
def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall status of customers whose orders are stages."""
    one = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.when(F.max(F.col("o_orderstatus") == "P"), "failed").otherwise("done").alias("state"))
    stages = one.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "state"))).alias("stages"))
    return stages.select("o_custkey", V.overall_status(F.col("stages"), "5-LOW").alias("status"))


@REGISTRY.add("shared_words", "SELECT conv_id, count(DISTINCT w) AS n_words FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM conversations) GROUP BY 1")
def shared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of every conversation."""
    words = table(spark, sf_dir, "conversations").select("conv_id", F.explode(word_tokens(F.col("text"))).alias("w"))
    return words.groupBy("conv_id").agg(F.countDistinct("w").alias("n_words"))


_LEDGER_SQL = """
l AS (SELECT o_custkey AS family, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'healthy' WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'healthy' WHEN o_orderkey % 3 = 1 THEN 'failed' ELSE 'building' END AS status FROM orders)
"""


@REGISTRY.add("generation_ledger", f"WITH {_LEDGER_SQL} SELECT family, id, status, status = 'healthy' AND id = max(id) FILTER (status = 'healthy') OVER (PARTITION BY family) AS is_current FROM l")
def generation_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations of every family after those that were building have ended, with the one that readers see."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "healthy").when(F.col("o_orderstatus") == "P", "failed").otherwise("building")
    ledger = orders.select(F.col("o_custkey").alias("family"), key.alias("id"), status.alias("status"), F.lit("").alias("error"))
    ended = orders.where("o_orderkey % 3 < 2").select(key.alias("id"), F.when(key % 3 == 0, "healthy").otherwise("failed").alias("final"), F.lit("e").alias("error"))  # a third are building still
    made = VersionedTable(spark, shared_path(spark, "generations"), ["family", "id"], ["family"])
    made.overwrite(N.publish(ledger, ["family"]))
    made.update(lambda rows: N.publish(N.finish(rows, ended), ["family"]))
    return made.read().drop("error")


@REGISTRY.add("generation_violations", "SELECT o_custkey AS family, count(*) AS n_current FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1 HAVING count(*) > 1 OR count(*) FILTER (o_orderstatus <> 'F') > 0")
def generation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families whose current generation is not one, or not healthy."""
    ledger = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("family"), F.when(F.col("o_orderstatus") == "F", "healthy").otherwise("failed").alias("status"), (F.col("o_orderkey") % 4 == 0).alias("is_current"))
    return N.violations(ledger, ["family"])


@REGISTRY.add(
    "extraction_states",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'complete' WHEN o_orderkey % 7 = 1 THEN 'partial' WHEN o_orderkey % 5 = 0 THEN 'unavailable' WHEN o_orderkey % 4 = 0 THEN 'failed' WHEN o_orderkey % 3 > 0 THEN 'partial' ELSE 'complete' END AS status, o_orderkey % 7 < 2 AS reused FROM orders""",
)
def extraction_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every extraction, and whether one of the same inputs was taken again."""
    key = F.col("o_orderkey")
    cached = F.when(key % 7 == 0, "complete").when(key % 7 == 1, "partial").when(key % 7 == 2, "failed")
    made = N.extraction_state(cached, key % 5, key % 3, key % 4 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("e")).select("o_orderkey", "e.status", "e.reused")
