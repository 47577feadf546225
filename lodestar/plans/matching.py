"""Eligibility, validity and match queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.operators import eligibility as E, matching as M, validity as V
from lodestar.registry import REGISTRY, table

AS_OF = "1996-06-30"


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as profiles: a state from the nation, a size from the segment, numbers from the balance."""
    states = F.split(F.lit("SP RJ BA PE AM PR SC DF SE MG"), " ")
    uf = F.get(states, (F.col("c_nationkey") % 11).cast("int"))  # one in eleven has none
    size = F.get(F.split(F.lit("MEI|Micro|média|Grande empresa|"), "\\|"), (F.col("c_custkey") % 5).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", uf.alias("uf"), size.alias("size"), F.col("c_acctbal").alias("revenue"), (F.col("c_custkey") % 12).alias("trl"), F.when(F.col("c_custkey") % 3 == 0, "startup").when(F.col("c_custkey") % 3 == 1, "Associação").alias("legal_form"))


def _constraints(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "sede_uf", "in", ["NE", "sp"]), (1, "porte", "in", ["me", "Média"]), (2, "faturamento", "lte", ["5000"]), (2, "trl", "gte", ["4"]),
        (3, "forma_juridica", "in", ["empresa"]), (3, "sede_uf", "not_in", ["SE"]), (4, "parceria", "exige", ["ict"]), (5, None, None, None), (6, "trl", "in", ["3", "4", "5"]),
    ]
    return spark.createDataFrame(rows, "opportunity int, kind string, op string, values array<string>")


_PROFILE_SQL = """
p AS (
  SELECT c_custkey, (['SP','RJ','BA','PE','AM','PR','SC','DF','SE','MG'])[1 + c_nationkey % 11] AS uf,
         nullif((['mei','me','media','grande',''])[1 + c_custkey % 5], '') AS size, c_acctbal AS revenue, c_custkey % 12 AS trl,
         CASE c_custkey % 3 WHEN 0 THEN 'startup' WHEN 1 THEN 'associacao' END AS legal_form
  FROM customer
), v AS (
  SELECT c_custkey, 1 AS opportunity, 'sede_uf' AS kind, CASE WHEN uf IS NULL THEN 'unknown' WHEN uf IN ('AL','BA','CE','MA','PB','PE','PI','RN','SE','SP') THEN 'sat' ELSE 'unsat' END AS v FROM p
  UNION ALL SELECT c_custkey, 1, 'porte', CASE WHEN size IS NULL THEN 'unknown' WHEN size IN ('me','media') THEN 'sat' ELSE 'unsat' END FROM p
  UNION ALL SELECT c_custkey, 2, 'faturamento', CASE WHEN revenue IS NULL THEN 'unknown' WHEN revenue <= 5000 THEN 'sat' ELSE 'unsat' END FROM p
  UNION ALL SELECT c_custkey, 2, 'trl', CASE WHEN trl >= 4 THEN 'sat' ELSE 'unsat' END FROM p
  UNION ALL SELECT c_custkey, 3, 'forma_juridica', CASE WHEN legal_form IS NULL THEN 'unknown' WHEN legal_form IN ('empresa','startup','ltda','sa','eireli','me','epp') THEN 'sat' ELSE 'unsat' END FROM p
  UNION ALL SELECT c_custkey, 3, 'sede_uf', CASE WHEN uf IS NULL THEN 'unknown' WHEN uf = 'SE' THEN 'unsat' ELSE 'sat' END FROM p
  UNION ALL SELECT c_custkey, 4, 'parceria', 'unknown' FROM p
  UNION ALL SELECT c_custkey, 5, NULL, 'sat' FROM p
  UNION ALL SELECT c_custkey, 6, 'trl', CASE WHEN trl IN (3,4,5) THEN 'sat' ELSE 'unsat' END FROM p
)
"""


@REGISTRY.add(
    "eligibility_verdict",
    f"""WITH {_PROFILE_SQL}
    SELECT c_custkey, opportunity, CASE WHEN bool_or(v = 'unsat') THEN 'inelegivel' WHEN bool_or(v = 'unknown') THEN 'nao_verificada' ELSE 'elegivel' END AS status,
           count(*) FILTER (v = 'unsat') AS n_unsat, count(*) FILTER (v = 'unknown') AS n_unknown,
           coalesce(array_to_string(list_sort(list_distinct(list(kind) FILTER (v = 'unsat'))), ','), '') AS unsat_kinds
    FROM v GROUP BY c_custkey, opportunity""",
)
def eligibility_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every company under every opportunity's constraints."""
    profile = {name: F.col(name) for name in ("uf", "size", "revenue", "trl", "legal_form")}
    rows = _companies(spark, sf_dir).join(F.broadcast(_constraints(spark)))  # six opportunities
    judged = E.judge(rows, profile, ["c_custkey", "opportunity"])
    return judged.withColumn("unsat_kinds", F.array_join("unsat_kinds", ",")).drop("unsat", "unknown")


@REGISTRY.add(
    "eligibility_reasons",
    f"""WITH {_PROFILE_SQL}, said AS (SELECT *, CASE kind WHEN 'sede_uf' THEN 'Informe a UF da sede para confirmar a elegibilidade.' WHEN 'porte' THEN 'Informe o porte da empresa para verificar este requisito.'
      WHEN 'faturamento' THEN 'O faturamento anual precisa estar dentro do limite do edital.' WHEN 'forma_juridica' THEN 'A empresa precisa informar natureza jurídica para verificar este requisito.' WHEN 'parceria' THEN 'É necessário ter parceria com uma ICT.'
      WHEN 'trl' THEN CASE opportunity WHEN 2 THEN 'O nível de maturidade tecnológica precisa atingir o mínimo do edital.' ELSE 'A empresa precisa informar nível de maturidade tecnológica para verificar este requisito.' END END AS why FROM v)
    SELECT c_custkey, opportunity, coalesce(string_agg(why, '|' ORDER BY why) FILTER (v = 'unsat'), '') AS unsat, coalesce(string_agg(why, '|' ORDER BY why) FILTER (v = 'unknown'), '') AS unknown FROM said GROUP BY 1, 2""",
)
def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What excludes every company under every opportunity, and what its profile lacks."""
    profile = {name: F.col(name) for name in ("uf", "size", "revenue", "trl", "legal_form")}
    judged = E.judge(_companies(spark, sf_dir).join(F.broadcast(_constraints(spark))), profile, ["c_custkey", "opportunity"])  # six opportunities
    return judged.select("c_custkey", "opportunity", F.array_join("unsat", "|").alias("unsat"), F.array_join("unknown", "|").alias("unknown"))


@REGISTRY.add(
    "eligibility_trail",
    f"WITH {_PROFILE_SQL} SELECT c_custkey, kind, v AS verdict FROM v WHERE opportunity = 3",
)
def eligibility_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of each rule of one opportunity."""
    profile = {name: F.col(name) for name in ("uf", "size", "revenue", "trl", "legal_form")}
    rows = _companies(spark, sf_dir).join(F.broadcast(_constraints(spark).where("opportunity = 3")))
    return E.trail(rows, profile, ["c_custkey"]).select("c_custkey", F.explode("evaluations").alias("e")).select("c_custkey", "e.kind", "e.verdict")


@REGISTRY.add(
    "counterpart_minimum",
    """
    WITH p AS (SELECT c_custkey, (['SP','RJ','BA','PE','AM','PR','SC','DF','SE','MG'])[1 + c_nationkey % 11] AS state, CASE WHEN c_custkey % 2 = 0 THEN 'me' ELSE 'grande' END AS size FROM customer),
    r AS (SELECT *, CASE WHEN state IN ('AM') THEN 'N' WHEN state IN ('BA','PE','SE') THEN 'NE' WHEN state = 'DF' THEN 'CO' WHEN state IN ('SP','RJ','MG') THEN 'SUDESTE' WHEN state IN ('PR','SC') THEN 'S' END AS region FROM p)
    SELECT c_custkey, region, CASE WHEN region IS NULL THEN NULL WHEN size = 'me' AND region IN ('N','NE') THEN 5 WHEN size = 'me' THEN 10 WHEN region = 'S' THEN 40 ELSE 50 END AS percent FROM r
    """,
)
def counterpart_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least counterpart of companies: by size and region, else by size."""
    rules = spark.createDataFrame([("me", "N", 5), ("me", "NE", 5), ("me", None, 10), ("grande", "S", 40), ("grande", None, 50)], "size string, region string, percent int")
    people = _companies(spark, sf_dir).select("c_custkey", F.col("uf").alias("state"), F.when(F.col("c_custkey") % 2 == 0, "me").otherwise("grande").alias("size"))
    return E.minimum_share(people, rules).select("c_custkey", "region", "percent")


_SUBJECTS_SQL = f"""
s AS (SELECT o_orderkey AS subject_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate::DATE END AS deadline,
             CASE o_orderstatus WHEN 'O' THEN ' Aberta' WHEN 'F' THEN 'encerrada' END AS status, o_orderkey % 7 = 0 AS flows, DATE '{AS_OF}' AS as_of FROM orders),
e AS (SELECT *, CASE WHEN deadline IS NOT NULL AND flows THEN 'unknown/needs_review/temporal_status_conflict'
    WHEN status = 'encerrada' AND flows THEN 'unknown/needs_review/temporal_status_conflict'
    WHEN deadline >= as_of AND status = 'encerrada' THEN 'fixed/needs_review/temporal_status_conflict'
    WHEN deadline < as_of AND status = ' Aberta' THEN 'fixed/needs_review/temporal_status_conflict'
    WHEN deadline >= as_of THEN 'fixed/active/' WHEN deadline < as_of THEN 'fixed/closed/' WHEN flows THEN 'continuous/active/'
    WHEN status = 'encerrada' THEN 'unknown/closed/' WHEN status = ' Aberta' THEN 'unknown/needs_review/temporal_status_without_basis'
    ELSE 'unknown/needs_review/critical_fact_missing' END AS v FROM s)
"""


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", " Aberta").when(F.col("o_orderstatus") == "F", "encerrada")
    return o.select(F.col("o_orderkey").alias("subject_id"), F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate")).alias("deadline"), status.alias("status"), (F.col("o_orderkey") % 7 == 0).alias("continuous"))


def _as_of() -> object:
    return F.to_date(F.lit(AS_OF))


@REGISTRY.add("temporal_validity", f"WITH {_SUBJECTS_SQL} SELECT subject_id, string_split(v, '/')[1] AS mode, string_split(v, '/')[2] AS validity, string_split(v, '/')[3] AS issue FROM e")
def temporal_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode, validity and issue of every order as a call."""
    told = _subjects(spark, sf_dir).select("subject_id", V.evaluate(F.col("deadline"), F.col("status"), _as_of(), F.col("continuous")).alias("e"))
    return told.select("subject_id", "e.mode", "e.validity", F.coalesce("e.issue", F.lit("")).alias("issue"))


@REGISTRY.add("temporal_exceptions", f"WITH {_SUBJECTS_SQL} SELECT string_split(v, '/')[3] AS issue, count(*) AS n FROM e WHERE string_split(v, '/')[3] <> '' GROUP BY 1")
def temporal_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose evaluation has an issue, by issue."""
    return V.exceptions_of(_subjects(spark, sf_dir), _as_of()).groupBy("issue").agg(F.count("*").alias("n"))


@REGISTRY.add(
    "temporal_read_model",
    f"""WITH {_SUBJECTS_SQL},
    x AS (SELECT subject_id, CASE WHEN subject_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS xs FROM e WHERE string_split(v, '/')[3] <> ''),
    r AS (SELECT subject_id, CASE subject_id % 4 WHEN 0 THEN 'mark_unknown' WHEN 1 THEN 'confirm_continuous' WHEN 2 THEN 'correct' ELSE 'confirm' END AS decision,
                 CASE WHEN subject_id % 8 = 2 THEN DATE '1999-01-01' WHEN subject_id % 4 = 2 THEN DATE '1990-01-01' END AS value FROM x WHERE xs = 'resolved')
    SELECT e.subject_id,
      CASE WHEN x.subject_id IS NULL THEN string_split(v, '/')[1] WHEN r.subject_id IS NULL THEN 'unknown' WHEN decision = 'confirm_continuous' THEN 'continuous' WHEN decision <> 'mark_unknown' AND value IS NOT NULL THEN 'fixed' ELSE 'unknown' END AS mode,
      CASE WHEN x.subject_id IS NULL THEN string_split(v, '/')[2] WHEN r.subject_id IS NULL THEN 'needs_review' WHEN decision = 'mark_unknown' THEN 'needs_review' WHEN decision = 'confirm_continuous' THEN 'active'
           WHEN value >= as_of THEN 'active' ELSE 'closed' END AS validity,
      CASE WHEN x.subject_id IS NULL THEN 'evaluation' WHEN r.subject_id IS NULL THEN 'exception' ELSE 'review' END AS origin
    FROM e LEFT JOIN x USING (subject_id) LEFT JOIN r USING (subject_id)""",
)
def temporal_read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public validity of calls after exceptions and reviews."""
    subjects = _subjects(spark, sf_dir)
    found = V.exceptions_of(subjects, _as_of())
    exceptions = found.select(F.col("subject_id").alias("exception_id"), "subject_id", "input_fingerprint", F.when(F.col("subject_id") % 3 == 0, "resolved").otherwise("open").alias("status"), F.lit(1).alias("last_observed"))
    old = exceptions.select((-F.col("exception_id")).alias("exception_id"), "subject_id", "input_fingerprint", F.lit("superseded").alias("status"), F.lit(2).alias("last_observed"))
    key = F.col("exception_id")
    decision = F.when(key % 4 == 0, "mark_unknown").when(key % 4 == 1, "confirm_continuous").when(key % 4 == 2, "correct").otherwise("confirm")
    value = F.when(key % 8 == 2, "1999-01-01").when(key % 4 == 2, "1990-01-01")
    reviews = exceptions.where("status = 'resolved'").select(F.lit(2).alias("review_id"), "exception_id", decision.alias("decision"), value.alias("value"), F.lit(20).alias("created"))
    earlier = reviews.select(F.lit(1).alias("review_id"), "exception_id", F.lit("mark_unknown").alias("decision"), F.lit(None).cast("string").alias("value"), F.lit(10).alias("created"))
    return V.read_models(subjects, exceptions.unionByName(old), reviews.unionByName(earlier), _as_of())


_PAIRS_SQL = """
c AS (SELECT vec_id AS company_chunk, embedding::DOUBLE[] AS cv, CASE WHEN vec_id % 60 = 0 THEN 'hyde' ELSE 'profile' END AS origin FROM embeddings WHERE vec_id % 20 = 0),
pairs AS (SELECT label AS entity, company_chunk, origin, vec_id AS entity_chunk, round(list_cosine_similarity(cv, embedding::DOUBLE[]), 9) AS similarity FROM embeddings, c WHERE vec_id % 20 > 0),
aff AS (SELECT entity, avg(s) AS affinity, max(s) AS best FROM (SELECT entity, company_chunk, max(similarity) AS s FROM pairs GROUP BY 1, 2) GROUP BY 1)
"""


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The profile's chunks, and those of entities."""
    e = table(spark, sf_dir, "embeddings")
    company = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("company_chunk"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 60 == 0, "hyde").otherwise("profile").alias("origin"))
    return company, e.where("vec_id % 20 > 0").select(F.col("label").alias("entity"), F.col("vec_id").alias("entity_chunk"), F.col("embedding").alias("vector"))


@REGISTRY.add("maxsim_affinity", f"WITH {_PAIRS_SQL} SELECT entity, round(affinity, 6) AS affinity, round(best, 6) AS best FROM aff")
def maxsim_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late-interaction affinity of every entity with a profile, the chunks whose id is divisible by 20."""
    return M.affinities(*_chunks(spark, sf_dir)).select("entity", F.round("affinity", 6).alias("affinity"), F.round("best", 6).alias("best"))


@REGISTRY.add(
    "maxsim_excerpts",
    f"""WITH {_PAIRS_SQL}, one AS (SELECT *, row_number() OVER (PARTITION BY entity, entity_chunk ORDER BY similarity DESC, company_chunk) AS n FROM pairs WHERE origin <> 'hyde'),
    best AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY similarity DESC, entity_chunk)::INT AS place FROM one WHERE n = 1)
    SELECT entity, entity_chunk, company_chunk, round(similarity, 6) AS similarity, place FROM best WHERE place <= 3""",
)
def maxsim_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best pairs of every entity."""
    return M.best_excerpts(*_chunks(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@REGISTRY.add(
    "match_funnel",
    f"""WITH {_PAIRS_SQL},
    ent AS (SELECT o_orderkey AS entity, CASE WHEN o_orderdate::DATE >= DATE '1992-06-01' THEN 'active' ELSE 'closed' END AS validity, CASE WHEN o_orderkey = 4 THEN 'inelegivel' ELSE 'elegivel' END AS status, o_orderkey % 2 = 0 AS same FROM orders)
    SELECT entity, round(CASE WHEN same THEN least(affinity * 1.1, 1.0) ELSE affinity END, 6) AS score, status FROM aff JOIN ent USING (entity)
    WHERE validity = 'active' AND status <> 'inelegivel' AND round(CASE WHEN same THEN least(affinity * 1.1, 1.0) ELSE affinity END, 9) >= 0.3
    ORDER BY round(CASE WHEN same THEN least(affinity * 1.1, 1.0) ELSE affinity END, 9) DESC, entity LIMIT 8""",
)
def match_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Living, eligible entities by boosted affinity over a floor; the vectors here are far apart, so it is lower."""
    key = F.col("o_orderkey")
    entities = table(spark, sf_dir, "orders").select(
        key.cast("int").alias("entity"), F.when(F.to_date("o_orderdate") >= "1992-06-01", "active").otherwise("closed").alias("validity"),
        F.when(key == 4, "inelegivel").otherwise("elegivel").alias("status"), F.array(F.when(key % 2 == 0, "Saúde").otherwise("Energia")).alias("sectors"))
    best = M.funnel_of(entities, *_chunks(spark, sf_dir), F.array(F.lit("Saúde")), floor=0.3)
    return best.select("entity", F.round("score", 6).alias("score"), "status")


@REGISTRY.add(
    "structural_boost",
    """
    WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, max(l_discount) AS weight FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2),
    both_ways AS (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e)
    SELECT dst AS entity, round(max(1 + 0.05 * weight), 6) AS factor FROM both_ways WHERE src <= 5 AND dst > 5 GROUP BY 1
    """,
)
def structural_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of the neighbours of six seeds."""
    edges = table(spark, sf_dir, "lineitem").where("l_partkey <> l_suppkey").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.max("l_discount").alias("weight")).withColumn("type", F.lit("similar_a"))
    factors = M.structural_factors(edges, spark.range(0, 6).select(F.col("id").alias("entity")))
    return factors.select("entity", F.round("factor", 6).alias("factor"))


@REGISTRY.add(
    "verdict_reorder",
    "SELECT o_custkey AS company, o_orderkey AS entity, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 2 ELSE 1 END, o_orderkey)::INT AS new_place FROM orders",
)
def verdict_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of every company with high verdicts first and low ones last."""
    shown = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.col("o_orderkey").alias("entity"), F.col("o_orderkey").alias("place"), F.when(F.col("o_orderstatus") == "F", "alta").when(F.col("o_orderstatus") == "O", "baixa").otherwise("media").alias("verdict"))
    return M.reorder_by_verdict(shown, ["company"]).select("company", "entity", "new_place")
