"""Queries over structured text, chunks, tags, upserts, evidence and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.functions.ids import listed_hash
from lodestar.functions.text import slugify, trigram_overlap, word_tokens
from lodestar.operators import eligibility as E, gold as O, silver as S
from lodestar.registry import REGISTRY, table
from lodestar.session import few, shared_path
from lodestar.sources.versions import VersionedTable

_FOLD_SQL = """
WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g')) <> '') AS ps FROM documents),
f(doc_id, k, done, now) AS (
  SELECT doc_id, 0, []::VARCHAR[], '' FROM p
  UNION ALL SELECT f.doc_id, k + 1, CASE WHEN now <> '' AND len(now) + len(ps[k + 1]) + 2 > {most} THEN list_append(done, now) ELSE done END,
         CASE WHEN now = '' OR len(now) + len(ps[k + 1]) + 2 > {most} THEN ps[k + 1] ELSE now || chr(10) || chr(10) || ps[k + 1] END
  FROM f JOIN p USING (doc_id) WHERE k < len(ps))
SELECT f.doc_id, len(done) + CASE WHEN now <> '' THEN 1 ELSE 0 END AS n_units, md5(array_to_string(list_append(done, now), '|')) AS digest FROM f JOIN p USING (doc_id) WHERE k = len(ps)
"""


@REGISTRY.add("split_units", _FOLD_SQL.format(most=600))
def split_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are made paragraphs, as units of up to 600 characters."""
    units = S.split_units(F.regexp_replace("text", "\n", "\n\n"), 600)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(units).cast("long").alias("n_units"), F.md5(F.array_join(units, "|")).alias("digest"))


@REGISTRY.add(
    "pack_chunks",
    """
    WITH RECURSIVE p AS (SELECT doc_id, list_filter([trim(regexp_replace(l, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) FOR l IN string_split(text, chr(10))], lambda l: l <> '') AS ps FROM documents),
    f(doc_id, k, done, now, n) AS (
      SELECT doc_id, 0, []::VARCHAR[], '', 0 FROM p
      UNION ALL SELECT f.doc_id, k + 1, CASE WHEN k > 0 AND n + len(ps[k + 1]) > 1200 THEN list_append(done, now) ELSE done END,
             CASE WHEN k = 0 OR n + len(ps[k + 1]) > 1200 THEN ps[k + 1] ELSE now || chr(10) || ps[k + 1] END,
             CASE WHEN k = 0 OR n + len(ps[k + 1]) > 1200 THEN len(ps[k + 1]) + 1 ELSE n + len(ps[k + 1]) + 1 END
      FROM f JOIN p USING (doc_id) WHERE k < len(ps))
    SELECT f.doc_id, len(c) AS n_chunks, md5(array_to_string(c, '|')) AS digest FROM (SELECT f.doc_id, list_slice(CASE WHEN k > 0 THEN list_append(done, now) ELSE done END, 1, 60) AS c FROM f JOIN p USING (doc_id) WHERE k = len(ps)) f
    """,
)
def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as match chunks of their lines."""
    made = S.match_chunks(F.split("text", "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(made).cast("long").alias("n_chunks"), F.md5(F.array_join(made, "|")).alias("digest"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return lines.select("doc_id", "idx", F.col("source").alias("doc"), (F.col("idx") / 4).cast("int").alias("page"), F.array(F.concat(F.lit("S"), (F.col("idx") / 3).cast("int").cast("string"))).alias("section_path"), F.when(F.col("idx") % 9 == 8, "signature").otherwise("paragraph").alias("kind"), "text")


_SPACE = "'[ \\t\\n\\r\\f\\v]+'"
_NORM = f"trim(regexp_replace({{t}}, {_SPACE}, ' ', 'g'))"
_FLAGS = """regexp_matches(text, '\\|\\s*-{3,}\\s*\\|') AS has_table, regexp_matches(text, '\\b\\d{2}/\\d{2}/\\d{4}\\b') AS has_date, regexp_matches(text, '(?i)R\\$\\s*[\\d.,]+|\\bmilhões\\b|\\bbilhões\\b') AS has_money,
  regexp_matches(text, '(?i)\\belegív|\\bproponente|\\bexecutora|\\bcoexecutora|\\bICT\\b|\\bCNPJ\\b') AS has_eligibility, regexp_matches(text, '(?i)\\bnota\\b|\\bpeso\\b|\\bcrit[ée]rio|\\bpontua|\\bclassifica') AS has_criteria"""
_TOKENS = f"floor(len(regexp_extract_all({{t}}, '[^ \\t\\n\\r\\f\\v]+')) * 1.3::DOUBLE)"
_CHUNKS_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, source AS doc, unnest(range(len(s)))::INT AS idx, unnest(s) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents)),
p AS MATERIALIZED (SELECT doc_id, doc, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k, 'S' || (idx // 3) AS section, idx // 4 AS page, regexp_replace(line, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS piece, {_TOKENS.format(t='line')} AS n
  FROM l WHERE idx % 9 <> 8 AND {_NORM.format(t='line')} <> ''),
r AS (SELECT doc_id, k, section, n AS total, 1 AS g FROM p WHERE k = 1
  UNION ALL SELECT p.doc_id, p.k, p.section, CASE WHEN p.section = r.section AND r.total + p.n <= 800 THEN r.total + p.n ELSE p.n END, CASE WHEN p.section = r.section AND r.total + p.n <= 800 THEN g ELSE g + 1 END FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k + 1),
gs AS (SELECT doc_id, g, any_value(doc) AS doc, any_value(p.section) AS section, min(page) AS lo, max(page) AS hi, string_agg(piece, chr(10) || chr(10) ORDER BY k) AS body FROM r JOIN p USING (doc_id, k) GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN {_TOKENS.format(t='body')} < 80 AND section = lag(section) OVER w THEN 0 ELSE 1 END AS opens FROM gs WINDOW w AS (PARTITION BY doc_id ORDER BY g)),
c AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY g)::INT - 1 AS chunk_index FROM f),
m AS (SELECT doc_id, chunk_index, any_value(doc) AS doc, any_value(section) AS section, min(lo) AS lo, max(hi) AS hi, string_agg(body, chr(10) || chr(10) ORDER BY g) AS body FROM c GROUP BY 1, 2),
t AS (SELECT *, array_to_string(list_slice(regexp_extract_all(lag(body) OVER (PARTITION BY doc_id ORDER BY chunk_index), '[^ \t\n\r\f\v]+'), -115, -1), ' ') AS tail FROM m),
x AS (SELECT *, CASE WHEN coalesce(tail, '') <> '' THEN '[…] ' || tail || chr(10) || chr(10) || body ELSE body END AS text FROM t)
SELECT doc_id, chunk_index, text, section, CASE WHEN lo = hi THEN 'p.' || lo ELSE 'p.' || lo || '-' || hi END AS page_range, doc AS source_file, {_FLAGS} FROM x
"""


@REGISTRY.add("rag_chunks", _CHUNKS_SQL)
def rag_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval chunks of documents whose lines are blocks."""
    return S.chunks(_blocks(spark, sf_dir), ["doc_id"])


@REGISTRY.add(
    "section_class",
    """
    SELECT doc_id, k AS idx, CASE WHEN k % 9 = 8 THEN 'boilerplate' WHEN regexp_matches(lower(strip_accents(l)), '^the ') THEN 'eligibility' WHEN regexp_matches(lower(strip_accents(l)), '^e') THEN 'boilerplate' ELSE 'thematic' END AS class
    FROM (SELECT doc_id, unnest(s) AS l, unnest(range(len(s)))::INT AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
    """,
)
def section_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every line as a section title."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    kind = F.when(F.col("idx") % 9 == 8, "signature").otherwise("paragraph")
    return lines.select("doc_id", "idx", S.section_class(F.array("line"), kind, "^the ", "^e").alias("class"))


@REGISTRY.add("content_hash", "SELECT source, md5(array_to_string(list_sort(list(md5(doc_id::VARCHAR || chr(31) || text))), '|')) AS source_hash, count(*) AS n_documents FROM documents GROUP BY source")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of each source's documents."""
    return listed_hash(table(spark, sf_dir, "documents"), ["source"], F.col("doc_id"), F.col("text"))


@REGISTRY.add("stale_gate", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def stale_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to build again: not built yet, or of another hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("v1").alias("version"), F.md5("text").alias("source_hash"))
    built = docs.where("doc_id % 5 <> 0").withColumn("source_hash", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("source_hash")))  # a fifth isn't built, a seventh is old
    return S.stale(docs, built, ["doc_id"], ["version", "source_hash"]).select("doc_id")


@REGISTRY.add(
    "merge_claims",
    """
    WITH c AS (SELECT user_id::VARCHAR AS field, event_id AS batch, CASE event_type WHEN 'view' THEN 'absent' WHEN 'click' THEN 'stated' WHEN 'signup' THEN 'inferred' WHEN 'error' THEN 'unknown' ELSE 'absent' END AS state, (event_id % 3)::VARCHAR AS value FROM events),
    g AS (SELECT field, count(DISTINCT value) FILTER (state = 'stated') AS s, count(DISTINCT value) FILTER (state = 'inferred') AS i, count(*) FILTER (state = 'unknown') AS u,
      arg_min(value, batch) FILTER (state = 'stated') AS sv, arg_min(value, batch) FILTER (state = 'inferred') AS iv FROM c GROUP BY field)
    SELECT field, CASE WHEN s = 1 THEN 'stated' WHEN s > 1 OR u > 0 THEN 'unknown' WHEN i = 1 THEN 'inferred' WHEN i > 1 THEN 'unknown' ELSE 'absent' END AS state,
      CASE WHEN s = 1 THEN sv WHEN s = 0 AND u = 0 AND i = 1 THEN iv END AS value FROM g
    """,
)
def merge_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of several batches as one of each field."""
    kind = F.col("event_type")
    state = F.when(kind == "click", "stated").when(kind == "signup", "inferred").when(kind == "error", "unknown").otherwise("absent")
    claims = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("field"), F.col("event_id").alias("batch"), state.alias("state"), (F.col("event_id") % 3).cast("string").alias("value"))
    return S.merge_claims(claims)


@REGISTRY.add(
    "degraded_documents",
    "SELECT o_custkey, count(*) AS pages, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 = 0) AS failed_pages FROM orders GROUP BY 1 HAVING failed_pages >= 0.2 * count(*)",
)
def degraded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents with a fifth of failed pages or more."""
    return S.degraded(table(spark, sf_dir, "orders").withColumn("failed", (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0)), ["o_custkey"])


#: Tags of every class that is no tag, and some that are.
_TAGS = ["programa", "Consultoria", "gestão", "serviços", "LGPD", "marco civil", "MRL", "plano TRL 5", "lei complementar 123", "decreto-lei 1", "medida provisória 2", "Lei do Bem", "lei nº 14.133", "tecnologia assistiva", "saúde digital", "P&D", "nível de maturidade tecnológica", "Technology Readiness Level", "control", "portaria no. 7", "leis", "trl", "inteligência artificial", "P"]
_PLAIN_SQL = "lower(strip_accents(x))"
_TAGS_SQL = f"""
WITH raw AS (SELECT p_partkey AS id, string_split(p_name || ' ' || p_type, ' ') AS ws FROM part UNION ALL SELECT -1, [{", ".join(f"'{t}'" for t in _TAGS)}]),
n AS (SELECT id, [CASE WHEN w = 'steel' THEN 'metal' WHEN NOT contains(w, ' ') AND len(w) > 4 AND ends_with(w, 's') AND NOT regexp_matches(w, '(ais|eis|ois|uis|ns)$') THEN w[1:len(w) - 1] ELSE w END FOR w IN [lower(w) FOR w IN ws] IF len(w) >= 2] AS ts FROM raw),
kept AS (SELECT id, [x FOR x IN ts IF NOT regexp_matches(x, '(?i)\\b(trl|mrl|crl|irl)\\b|technology readiness|n[íi]vel de maturidade tecnol[óo]g')
    AND NOT regexp_matches(x, '(?i)\\b(lgpd|lei geral de prote[çc][ãa]o de dados|marco civil)\\b|\\b(lei(\\s+complementar)?|decreto(-lei)?|portaria|medida provis[óo]ria|emenda constitucional)\\b[\\sºª°no.\\-]*\\d')
    AND NOT list_contains([{", ".join(f"'{w}'" for w in O.GENERIC_TAGS)}], {_PLAIN_SQL})] AS ts FROM n)
SELECT id, array_to_string([x FOR x, i IN ts IF list_position(ts, x) = i], ',') AS tags FROM kept
"""


@REGISTRY.add("tag_normalize", _TAGS_SQL)
def tag_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of every part in their normal form, and those of a row with every class that is no tag."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("raw"))
    rows = parts.unionByName(spark.createDataFrame([(-1, _TAGS)], "id long, raw array<string>"))
    return rows.select("id", F.array_join(O.normalize_tags(F.col("raw"), {"steel": "metal"}), ",").alias("tags"))


#: Lists of constraints, valid ones and one for each reason that others aren't.
_CONSTRAINTS = [
    [("porte", "in", ["ME", " media "]), ("idade_empresa_meses", "lte", ["24"])], [("idade_empresa_meses", "gte", ["-1"])], [("idade_empresa_meses", "gte", ["1.5"])], [("trl", "in", ["3", "4.0"]), ("sede_uf", "not_in", ["sp"])],
    [("trl", "gte", ["12"])], [("porte", "lte", ["me"])], [("outro", "in", ["x"])], [("cnae", "in", [" 62.01 "]), ("parceria", "exige", [" ICT"])], [("faturamento", "lte", ["1", "2"])], [("faturamento", "lte", ["4800000.5"])],
    [("forma_juridica", "in", ["fundacao"])], [("sede_uf", "in", [])], [("cnae", "in", [" "])], [], [("trl", "lte", ["x"])], [("porte", "in", ["me"]), ("trl", "gte", ["0"]), ("outro", "in", ["x"])],
]
_CONSTRAINTS_SQL = """
SELECT * FROM (VALUES (0, 'porte in me,media;idade_empresa_meses lte 24', NULL), (1, NULL, 'company age is negative'), (2, NULL, 'constraint numeric value must be an integer'), (3, 'trl in 3,4;sede_uf not_in SP', NULL),
  (4, NULL, 'trl is outside 1..9'), (5, NULL, 'constraint outside the authoritative vocabulary'), (6, NULL, 'constraint outside the authoritative vocabulary'), (7, 'cnae in 62.01;parceria exige ict', NULL), (8, NULL, 'constraint numeric value is invalid'), (9, 'faturamento lte 4800000.5', NULL),
  (10, NULL, 'constraint enum value is outside the schema'), (11, NULL, 'constraint value is empty'), (12, NULL, 'constraint value is empty'), (13, '', NULL), (14, NULL, 'constraint numeric value is invalid'), (15, NULL, 'trl is outside 1..9')) t(id, constraints, reason)
UNION ALL SELECT 1000 + p_partkey, CASE WHEN p_size BETWEEN 1 AND 9 THEN 'trl gte ' || p_size || ';idade_empresa_meses lte ' || p_partkey END, CASE WHEN p_size NOT BETWEEN 1 AND 9 THEN 'trl is outside 1..9' END FROM part
"""


@REGISTRY.add("constraint_lists", _CONSTRAINTS_SQL)
def constraint_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of constraints in normal form, or the reason against them: those of every part, and one of every kind."""
    made = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(o).alias("op"), F.array(F.col(c).cast("string")).alias("values")) for k, o, c in (("trl", "gte", "p_size"), ("idade_empresa_meses", "lte", "p_partkey"))])
    parts = table(spark, sf_dir, "part").select((1000 + F.col("p_partkey")).alias("id"), made.alias("c"))
    literal = spark.createDataFrame(list(enumerate(_CONSTRAINTS)), "id long, c array<struct<kind:string,op:string,values:array<string>>>")
    shaped, why = E.coerce_constraints(F.col("c"))
    said = F.array_join(F.transform(shaped, lambda c: F.concat_ws(" ", c["kind"], c["op"], F.array_join(c["values"], ","))), ";")
    return parts.unionByName(literal).select("id", said.alias("constraints"), why.alias("reason"))


@REGISTRY.add(
    "sector_normalize",
    "SELECT p_partkey, CASE WHEN p_type ILIKE '%steel%' AND p_type ILIKE '%promo%' THEN 'Metal,Energia,Saúde' WHEN p_type ILIKE '%steel%' THEN 'Metal,Energia' WHEN p_type ILIKE '%promo%' THEN 'Saúde' ELSE 'Multissetorial' END AS sectors FROM part",
)
def sector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors of every part from the words of its type."""
    words = F.split(F.lower("p_type"), " ")
    raw = F.concat(F.filter(words, lambda w: w == "steel"), F.filter(words, lambda w: F.contains(w, F.lit("promo"))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(O.normalize_sectors(raw, ["Metal", "Energia", "Saúde"], {"steel": ["Metal", "Energia"], "promo": ["Saúde"]}), ",").alias("sectors"))


@REGISTRY.add("slugs", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' – Ação/' || p_brand), '[^a-z0-9áçã]+', '-', 'g'), 'ação', 'acao') AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of part names."""
    return table(spark, sf_dir, "part").select("p_partkey", slugify(F.concat(F.col("p_name"), F.lit(" – Ação/"), F.col("p_brand"))).alias("slug"))


@REGISTRY.add("call_status", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CASE WHEN o_orderdate::DATE >= DATE '1996-06-30' THEN 'aberta' ELSE 'encerrada' END WHEN o_orderstatus = 'O' THEN 'aberta' WHEN o_orderstatus = 'F' THEN 'encerrada' ELSE '' END AS status FROM orders")
def call_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every order as a call, from its deadline or what it says."""
    said = F.when(F.col("o_orderstatus") == "O", " aberto ").when(F.col("o_orderstatus") == "F", "Fechada")
    deadline = F.when(F.col("o_orderkey") % 3 > 0, F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(O.call_status(said, deadline, F.to_date(F.lit("1996-06-30"))), F.lit("")).alias("status"))


@REGISTRY.add(
    "upsert_merge",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS name, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN '{"n":1}' ELSE CASE WHEN c_custkey % 5 = 0 THEN '{}' ELSE '{"o":1}' END END AS provenance FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 4 > 0""",
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored customers with new ones in their place; empty provenance keeps what is stored."""
    key = F.col("c_custkey")
    people = table(spark, sf_dir, "customer")
    stored = people.where("c_custkey % 4 > 0 OR c_custkey % 3 = 0").select("c_custkey", F.lit("old").alias("name"), F.when(key % 5 == 0, "{}").otherwise('{"o":1}').alias("provenance"))
    new = people.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("name"), F.when(key % 2 == 0, '{"n":1}').otherwise("{}").alias("provenance"))
    made = VersionedTable(spark, shared_path(spark, "people"), ["c_custkey"])
    made.overwrite(stored)
    made.upsert(new, ["provenance"])
    return made.read()


@REGISTRY.add("insert_ignore", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that aren't stored yet, each once."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return O.insert_new(pairs.where("l_returnflag = 'R'"), pairs, ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey")


@REGISTRY.add(
    "snapshot_diff",
    """
    WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 10 > 0),
    b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 9 > 0)
    SELECT k, 'missing' AS kind, '' AS field FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'extra', '' FROM b WHERE k NOT IN (SELECT k FROM a)
    UNION ALL SELECT k, 'field', 's' FROM a JOIN b USING (k) WHERE a.s IS DISTINCT FROM b.s UNION ALL SELECT k, 'field', 'p' FROM a JOIN b USING (k) WHERE a.p IS DISTINCT FROM b.p
    """,
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two snapshots of orders."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    later = o.where("k % 9 > 0").select("k", F.when(F.col("k") % 6 != 0, F.col("s")).alias("s"), F.when(F.col("k") % 4 == 0, F.col("p") + 1).otherwise(F.col("p")).alias("p"))
    return O.diff(o.where("k % 10 > 0"), later, ["k"], ["s", "p"])  # keys that one snapshot lacks


@REGISTRY.add("snapshot_equal", "SELECT count(*) AS rows_a, count(*) AS rows_b, true AS equal FROM part")
def snapshot_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two copies of a table in another order are equal."""
    part = table(spark, sf_dir, "part")
    return O.same_content(part, part.repartition(7, "p_size"))


@REGISTRY.add(
    "quote_resolve",
    """
    WITH b AS (SELECT source AS subject, doc_id AS doc, k::INT AS idx, l AS text FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents)),
    q AS (SELECT DISTINCT subject || '/' || item_id AS quote_id, subject, i.t AS quote FROM (SELECT item_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM benchmark) i, (SELECT DISTINCT subject FROM b)),
    f AS (SELECT quote_id, doc, idx FROM q JOIN b USING (subject) WHERE contains(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), quote)),
    g AS (SELECT quote_id, count(DISTINCT doc) AS docs, count(DISTINCT idx // 4) AS pages, count(*) AS n, min(doc) AS d, max(idx // 4) AS p FROM f GROUP BY 1)
    SELECT quote_id, CASE WHEN docs = 1 AND pages = 1 THEN 'exact' WHEN docs = 1 THEN 'document_only' ELSE 'unresolved' END AS quality, CASE WHEN docs = 1 THEN d END AS doc, CASE WHEN docs = 1 AND pages = 1 THEN p END AS page, coalesce(n, 0) AS n_candidates FROM q LEFT JOIN g USING (quote_id)
    """,
)
def quote_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where benchmark items stand in each source's documents, a line at a time."""
    blocks = table(spark, sf_dir, "documents").select(F.col("source").alias("subject"), F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("idx", "text")).withColumn("page", (F.col("idx") / 4).cast("int"))
    sources = table(spark, sf_dir, "documents").agg(F.collect_set("source").alias("subjects"))  # a name for each source, few by nature
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    quotes = items.join(few(sources)).select("item_id", "quote", F.explode("subjects").alias("subject"))
    return O.resolve_quotes(quotes.select(F.concat_ws("/", "subject", F.col("item_id").cast("string")).alias("quote_id"), "subject", "quote"), blocks)


@REGISTRY.add(
    "claim_resolution",
    """
    WITH c AS (SELECT o_custkey AS subject, o_orderstatus AS value, o_orderpriority = '1-URGENT' AS official FROM orders),
    v AS (SELECT subject, value, bool_or(official) AS has, bool_or(NOT official) AS lacks FROM c GROUP BY 1, 2),
    n AS (SELECT subject, count(*) AS n, min(value) AS lone FROM v GROUP BY 1),
    w AS (SELECT a.subject, a.value FROM v a JOIN n USING (subject) WHERE n > 1 AND a.has AND (SELECT bool_and(NOT b.has) FROM v b WHERE b.subject = a.subject AND b.value <> a.value)),
    x AS (SELECT subject, count(*) AS k, min(value) AS value FROM w GROUP BY 1)
    SELECT subject, 'status' AS field, CASE WHEN n = 1 OR k = 1 THEN 'stated' ELSE 'conflicting' END AS state, CASE WHEN n = 1 THEN lone WHEN k = 1 THEN value END AS value FROM n LEFT JOIN x USING (subject)
    """,
)
def claim_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses that orders claim of customers, urgent ones as official."""
    claims = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("document"), F.lit(None).cast("long").alias("amends"), F.lit("opportunity").alias("page_role"), (F.col("o_orderpriority") == "1-URGENT").alias("official"))
    return O.resolve_claims(claims)


@REGISTRY.add(
    "trigram_overlap",
    """
    WITH d AS (SELECT doc_id, d.text AS a, b.text AS b FROM documents d JOIN benchmark b ON item_id = doc_id),
    t AS (SELECT doc_id, list_distinct([substr(a, i, 3) FOR i IN range(1, greatest(len(a) - 1, 1))]) AS ta, list_distinct([substr(b, i, 3) FOR i IN range(1, greatest(len(b) - 1, 1))]) AS tb FROM d)
    SELECT doc_id, round(CASE WHEN len(tb) = 0 THEN 0 ELSE len(list_intersect(ta, tb)) / len(tb) END, 6) AS overlap FROM t
    """,
)
def trigram_overlap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a benchmark item's trigrams that the document of its number has."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("item"))
    pairs = table(spark, sf_dir, "documents").select("doc_id", "text").join(items, "doc_id")
    return pairs.select("doc_id", F.round(trigram_overlap(F.col("text"), F.col("item")), 6).alias("overlap"))


@REGISTRY.add(
    "token_recall",
    """
    WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS g FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM documents)
    SELECT item_id, doc_id, round(len(list_intersect(g, t)) / len(g), 4) AS recall FROM b JOIN d ON doc_id = item_id
    """,
)
def token_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a benchmark item's words that the document of the same number has."""
    gold = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(word_tokens(F.col("text"))).alias("g"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(word_tokens(F.col("text"))).alias("t"))
    return gold.join(docs, F.col("doc_id") == F.col("item_id")).select("item_id", "doc_id", F.round(F.size(F.array_intersect("g", "t")) / F.size("g"), 4).alias("recall"))
