"""Ranked retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.functions.text import STOPWORDS, content_flags, or_query, query_flags, search_tokens
from lodestar.functions.vectors import cosine
from lodestar.operators import retrieval as R, text_index as T
from lodestar.registry import REGISTRY, table
from lodestar.session import exists

_TOKENS = "list_filter(regexp_extract_all(lower({t}), '[a-záéíóúâêîôûãõç]+'), lambda w: len(w) >= 3 AND NOT list_contains([{s}], w))"
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def tokens_sql(column: str) -> str:
    return _TOKENS.format(t=column, s=STOP)


#: Common tables of the SQL of BM25: bm(id, score) of documents for the text of benchmark item 0.
BM25_SQL = f"""
own AS (SELECT doc_id AS id, {tokens_sql("text")} AS words FROM documents),
totals AS (SELECT count(*) AS n, avg(len(words)) AS mean_length FROM own),
idfs AS (SELECT word, ln(n - df + 0.5) - ln(df + 0.5) AS idf
         FROM (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS word FROM own) GROUP BY word), totals),
floors AS (SELECT avg(idf) * 0.25 AS floor FROM idfs),
asked AS (SELECT word, count(*) AS times FROM (SELECT unnest({tokens_sql("text")}) AS word FROM benchmark WHERE item_id = 0) GROUP BY word),
weights AS (SELECT word, times, CASE WHEN idf < 0 THEN floor ELSE idf END AS idf FROM asked JOIN idfs USING (word), floors),
tfs AS (SELECT id, length, word, count(*) AS tf FROM (SELECT id, len(words) AS length, unnest(words) AS word FROM own) GROUP BY id, length, word),
bm AS (SELECT id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean_length))), 9) AS score
       FROM tfs JOIN weights USING (word), totals GROUP BY id HAVING score > 0)
"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("item_id = 0").select("text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id <> 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


@REGISTRY.add(
    "dense_topk",
    """
    SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
    WHERE e.vec_id <> 0
    ORDER BY similarity DESC, e.vec_id LIMIT 20
    """,
)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors nearest to vector 0 by exact cosine, ties by id."""
    query = F.broadcast(query_vector(spark, sf_dir))
    scored = vectors(spark, sf_dir).join(query).select(F.col("id").alias("vec_id"), "label", F.round(cosine(F.col("vector"), F.col("q")), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "vec_id").limit(20)


@REGISTRY.add("bm25_topk", f"WITH {BM25_SQL} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents with the best Okapi score for the first benchmark item."""
    best = R.top_k(R.bm25(corpus(spark, sf_dir), question(spark, sf_dir)))
    return best.select("id", F.round("score", 6).alias("score"))


#: Indexes of this process by session and folder: the queries of one folder share one.
_indexes: dict[tuple[str, str], T.TextIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> T.TextIndex:
    """The index of all documents, written by the first query that asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes or not exists(spark, _indexes[key].path):
        _indexes[key] = T.build(corpus(spark, sf_dir))
    return _indexes[key]


@REGISTRY.add("bm25_indexed", f"WITH {BM25_SQL} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents with the best Okapi score for the first benchmark item, from postings."""
    best = R.top_k(T.bm25(text_index(spark, sf_dir), question(spark, sf_dir)))
    return best.select("id", F.round("score", 6).alias("score"))


@REGISTRY.add("fts_topk")
def fts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents with the best full-text score for the first benchmark item, from postings of stems."""
    return R.top_k(T.full_text(text_index(spark, sf_dir), question(spark, sf_dir)))


@REGISTRY.add(
    "postings",
    f"""
    WITH w AS (SELECT doc_id AS id, [x FOR x IN regexp_extract_all(lower(text), '[a-záéíóúâêîôûãõç]+')] AS words FROM documents),
    p AS (SELECT id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w)
    SELECT id, word, count(*)::INTEGER AS tf, min(place)::INTEGER AS first_place, sum(place)::BIGINT AS places FROM p WHERE len(word) >= 3 AND NOT list_contains([{STOP}], word) GROUP BY 1, 2
    """,
)
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of all documents: how often and where each has a word."""
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda t, p: t + p)
    return text_index(spark, sf_dir).postings.select("id", "word", "tf", F.col("positions")[0].alias("first_place"), total.alias("places"))


@REGISTRY.add("search_tokens", f"SELECT doc_id, len(w) AS n_tokens, array_to_string(list_slice(list_distinct_ordered, 1, 8), ' | ') AS or_query FROM (SELECT doc_id, w, [x FOR x, i IN w IF list_position(w, x) = i] AS list_distinct_ordered FROM (SELECT doc_id, {tokens_sql('text')} AS w FROM documents))")
def tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search tokens of every document, and its first terms as an OR query."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(search_tokens(F.col("text"))).cast("long").alias("n_tokens"), or_query(F.col("text")).alias("or_query"))


_RANKS_SQL = f"""
WITH {BM25_SQL},
sparse AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm QUALIFY r <= 20),
dense AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, vec_id) AS r
          FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE vec_id <> 0 QUALIFY r <= 20),
fused AS (SELECT id, coalesce(0.5 / (60 + d.r), 0) + coalesce(0.5 / (60 + s.r), 0) AS score FROM dense d FULL JOIN sparse s USING (id))
"""


@REGISTRY.add("rrf_hybrid", _RANKS_SQL + "SELECT id, round(score, 9) AS score FROM fused")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of the dense and the BM25 ranking."""
    near = R.dense(vectors(spark, sf_dir), query_vector(spark, sf_dir))
    said = R.top_k(R.bm25(corpus(spark, sf_dir), question(spark, sf_dir)))
    return R.fuse(near, said).select("id", F.round("score", 9).alias("score"))


@REGISTRY.add(
    "hybrid_retrieve",
    _RANKS_SQL
    + """, marked AS (
      SELECT f.id, d.source AS source_file, f.score * CASE WHEN contains(d.text, 'the') AND d.n_chars > 1000 THEN 1.2 ELSE 1 END AS score
      FROM fused f JOIN documents d ON d.doc_id = f.id JOIN embeddings e ON e.vec_id = f.id
    ), few AS (SELECT *, row_number() OVER (PARTITION BY coalesce(source_file, '__unknown__') ORDER BY score DESC, id) AS n FROM marked)
    SELECT id, source_file, round(score, 9) AS score FROM few WHERE n <= 2 ORDER BY few.score DESC, id LIMIT 5
    """,
)
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole hybrid retrieval over documents that have a vector."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_file"), (F.contains("text", F.lit("the")) & (F.col("n_chars") > 1000)).alias("flag"))
    near = R.dense(vectors(spark, sf_dir), query_vector(spark, sf_dir))
    said = R.top_k(R.bm25(corpus(spark, sf_dir), question(spark, sf_dir)))
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    fused = R.fuse(near, said).join(docs, "id").join(known, "id", "left_semi")
    return R.diversify(R.boost(fused, ["flag"]), 5).select("id", "source_file", F.round("score", 9).alias("score"))


_FLAGS_SQL = """
SELECT doc_id, regexp_matches(text, '\\|\\s*-{3,}\\s*\\|') AS has_table, regexp_matches(text, '\\b\\d{2}/\\d{2}/\\d{4}\\b') AS has_date,
       regexp_matches(text, '(?i)R\\$\\s*[\\d.,]+|\\bmilhões\\b|\\bbilhões\\b') AS has_money,
       regexp_matches(text, '(?i)\\belegív|\\bproponente|\\bexecutora|\\bcoexecutora|\\bICT\\b|\\bCNPJ\\b') AS has_eligibility,
       regexp_matches(text, '(?i)\\bnota\\b|\\bpeso\\b|\\bcrit[ée]rio|\\bpontua|\\bclassifica') AS has_criteria
FROM documents
"""


@REGISTRY.add("content_flags", _FLAGS_SQL)
def content_flags_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document seems to contain; null of a document without a text."""
    return table(spark, sf_dir, "documents").select("doc_id", *[F.when(F.col("text").isNotNull(), c).alias(n) for n, c in content_flags(F.col("text")).items()])


@REGISTRY.add(
    "query_flags",
    """
    SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\bnota\\b|\\bpeso\\b|\\bcrit[ée]rio|\\bpontua|\\bavalia|\\bclassifica|\\bjulgament') THEN 1 ELSE 0 END
      + CASE WHEN regexp_matches(text, '(?i)\\bprazo|\\bdata\\b|\\bquando\\b|\\bcronograma|\\bvigên|\\bvigenc|\\bencerr|\\bdeadline') THEN 1 ELSE 0 END
      + CASE WHEN regexp_matches(text, '(?i)\\bvalor|\\bquanto\\b|\\brecursos?\\b|\\borçament|\\borcament|\\bfinanc|\\bmilhõ|\\bmilho[e]?s|\\bbilhõ|\\bcontrapartida|\\bverba|\\bcusto') THEN 1 ELSE 0 END
      + CASE WHEN regexp_matches(text, '(?i)\\belegív|\\belegiv|\\bproponente|\\bexecutora|\\bcoexecutora|\\bhabilita|\\bquem\\s+pode\\b|\\bICT\\b|\\bCNPJ\\b') THEN 1 ELSE 0 END AS n_flags
    FROM conversations
    """,
)
def query_flags_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many intents every turn of a conversation shows."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(query_flags(F.col("text"))).alias("n_flags"))


@REGISTRY.add(
    "metadata_boost",
    """SELECT doc_id AS id, round(n_chars * CASE WHEN contains(text, 'a') OR lang = 'de' THEN 1.2 ELSE 1 END::DOUBLE, 6) AS score FROM documents""",
)
def metadata_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores raised once where any wanted flag holds."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.contains("text", F.lit("a")).alias("f1"), (F.col("lang") == "de").alias("f2"))
    return R.boost(docs, ["f1", "f2"]).select("id", F.round("score", 6).alias("score"))


@REGISTRY.add(
    "diversify_by_source",
    """
    SELECT doc_id AS id, source AS source_file, n_chars AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY coalesce(source, '__unknown__') ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 2
    ORDER BY n_chars DESC, doc_id LIMIT 25
    """,
)
def diversify_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest documents, at most two of a source."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_file"), F.col("n_chars").alias("score"))
    return R.diversify(docs, 25)


@REGISTRY.add(
    "rerank_pool",
    """
    WITH ranked AS (SELECT doc_id AS id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 40)
    SELECT id, row_number() OVER (ORDER BY rank > 20, CASE WHEN rank <= 20 THEN -((id * 7919) % 101) END, rank) AS rank FROM ranked
    """,
)
def rerank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 reordered by another score, the tail behind them as it was."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    ranked = R.top_k(docs, 40).select("id", F.col("rank").cast("long").alias("rank"))
    return R.rerank(ranked, ranked.select("id", (F.col("id") * 7919 % 101).cast("double").alias("rescore"))).select("id", F.col("rank").cast("long").alias("rank"))


@REGISTRY.add(
    "library_score",
    """
    WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
    items AS (
      SELECT e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS cosine, v.ts, 1 + v.user_id % 10 AS importance
      FROM embeddings e JOIN events v ON v.event_id = e.vec_id, q WHERE e.vec_id <> 0
    ), near AS (SELECT * FROM items ORDER BY cosine DESC, id LIMIT 50)
    SELECT id, round(score, 6) AS score FROM (
      SELECT id, 0.3 * exp(-days / 90.0) + 0.2 * (importance / 10.0) * exp(-days / 30.0) + 0.5 * cosine AS score
      FROM (SELECT *, (epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(ts)) / 86400000000.0 AS days FROM near)) s
    ORDER BY s.score DESC, id LIMIT 10
    """,
)
def library_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best library items by cosine, recency and importance, in two steps."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("updated"), (1 + F.col("user_id") % 10).alias("importance"))
    near = vectors(spark, sf_dir).join(F.broadcast(query_vector(spark, sf_dir))).select("id", cosine(F.col("vector"), F.col("q")).alias("cosine"))
    items = near.join(events, "id").withColumn("referenced", F.col("updated"))
    best = R.library_score(items, F.to_timestamp(F.lit("2024-03-01 00:00:00")), 0.3, 0.2, 0.5, 10)
    return best.select("id", F.round("score", 6).alias("score"))


@REGISTRY.add(
    "tag_neighbors",
    """
    WITH items AS (SELECT p_partkey AS id, p_name AS name, list_distinct(string_split(lower(p_type || ' ' || p_brand), ' ')) AS tags FROM part),
    a AS (SELECT id AS anchor, tags AS asked FROM items WHERE id = 1)
    SELECT id, name, len(list_intersect(tags, asked))::INT AS n_shared FROM items, a
    WHERE id <> anchor AND len(list_intersect(tags, asked)) > 0 ORDER BY n_shared DESC, lower(name), id LIMIT 15
    """,
)
def tag_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share most tags with part 1."""
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_type", "p_brand")), " ")).alias("tags"))
    return R.related_by_tags(items, items.where("id = 1"))


@REGISTRY.add(
    "theme_match",
    """
    SELECT p_partkey, contains(lower(p_type), 'steel brass') OR len(list_filter(string_split(lower(p_type), ' '), lambda w: len(w) >= 4 AND (contains(w, 'steel') OR contains('steel', w) OR contains(w, 'brass') OR contains('brass', w)))) > 0 AS fits
    FROM part
    """,
)
def theme_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose themes fit a search."""
    return table(spark, sf_dir, "part").select("p_partkey", R.theme_match(F.lit("Steel brass"), F.array("p_type")).alias("fits"))
