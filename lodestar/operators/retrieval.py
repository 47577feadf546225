"""Ranked retrieval: BM25, exact dense search, fusion, boosts and diversity.

Every ranking has a total order: scores first, then the id.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestar.functions.text import fold, search_tokens, word_tokens
from lodestar.functions.vectors import cosine
from lodestar.session import cut_lineage, few

#: Candidates of an arm, the constant of fusion, boost of a fitting flag, hits of one source, BM25's two parameters.
CANDIDATES, FUSION, BOOST, PER_SOURCE, K1, B = 20, 60, 1.2, 2, 1.5, 0.75
#: What the word that tells a document's length starts with; no token has it.
LENGTH = "\0"
#: Shares and half-lives of the library score.
RECENCY_DAYS, REFERENCE_DAYS = 90.0, 30.0


def bm25(docs: DataFrame, query: DataFrame, tokens=search_tokens) -> DataFrame:
    """Rows (id, score) of the documents (id, text) with a positive Okapi score for the query (one row: text).

    Scores are rounded to nine places, so that sums in another order tie alike.
    Query words count as often as they occur. Words that over half of the
    documents have get a quarter of the mean weight of all words. Documents
    are read twice: once for the statistics, an aggregate by word that is
    combined before the shuffle and written as a table of the vocabulary, and
    once for scores, where only words of the query leave a document.
    """
    spark = docs.sparkSession
    rows = query.select(tokens(F.col("text"))).limit(2).collect()  # one query
    if len(rows) > 1:
        raise ValueError("a query is one row")
    asked = Counter(rows[0][0] if rows else [])
    # Each document has a word more, which says how long it is.
    words = tokens(F.col("text"))
    own = F.concat(F.array_distinct("words"), F.array(F.concat(F.lit(LENGTH), F.size("words").cast("string"))))
    vocabulary = cut_lineage(docs.select(words.alias("words")).select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("df")))
    is_length = F.col("word").startswith(LENGTH)
    lengths = vocabulary.where(is_length).select("df", F.substring("word", len(LENGTH) + 1, 20).cast("long").alias("length"))
    totals = F.broadcast(lengths.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), (F.sum(F.col("df") * F.col("length")) / F.sum("df")).alias("mean_length")))
    idf = vocabulary.where(~is_length).join(totals).select("word", "n", "mean_length", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"))
    floor = F.broadcast(idf.agg((F.avg("idf") * 0.25).alias("floor")))
    wanted = F.broadcast(spark.createDataFrame(sorted(asked.items()), "word string, times long"))
    weights = idf.join(wanted, "word").join(floor).select("word", "times", "n", "mean_length", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))
    sized = docs.select("id", words.alias("words")).select("id", F.size("words").alias("length"), F.filter("words", lambda w: w.isin(*asked)).alias("hits"))
    found = sized.select("id", "length", F.explode("hits").alias("word")).groupBy("id", "length", "word").agg(F.count("*").alias("tf")).join(F.broadcast(weights), "word")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return found.groupBy("id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")


def top_k(scored: DataFrame, k: int = CANDIDATES, score: str = "score", key: str = "id") -> DataFrame:
    """The k best rows with their rank from 1; ties by key."""
    best = scored.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def dense(chunks: DataFrame, query: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The k chunks (id, vector) nearest to the query (one row: q) by exact cosine."""
    scored = chunks.where("vector is not null").join(few(query)).select("id", cosine(F.col("vector"), F.col("q")).alias("score"))
    return top_k(scored.where("score is not null"), k)


def fuse(first: DataFrame, second: DataFrame, first_weight: float = 0.5, second_weight: float = 0.5) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (id, rank): rows (id, score)."""
    a = first.select("id", F.col("rank").alias("r1"))
    b = second.select("id", F.col("rank").alias("r2"))
    share = lambda w, r: F.coalesce(F.lit(w) / (FUSION + F.col(r)), F.lit(0.0))
    return a.join(b, "id", "full").select("id", (share(first_weight, "r1") + share(second_weight, "r2")).alias("score"))


def boost(scored: DataFrame, wanted: list[str], factor: float = BOOST) -> DataFrame:
    """Scores times a factor, once, for rows with any wanted flag; flags that are null don't count."""
    fits = F.lit(False)
    for flag in wanted:
        fits = fits | F.coalesce(F.col(flag), F.lit(False))
    return scored.withColumn("score", F.when(fits, F.col("score") * factor).otherwise(F.col("score")))


def diversify(ranked: DataFrame, k: int, per_source: int = PER_SOURCE) -> DataFrame:
    """The k best rows with at most so many of one source_file; no source is a source. May be fewer than k."""
    order = Window.partitionBy(F.coalesce(F.nullif(F.col("source_file"), F.lit("")), F.lit("__unknown__"))).orderBy(F.desc("score"), "id")
    if per_source > 0:
        ranked = ranked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_source).drop("_n")
    return ranked.orderBy(F.desc("score"), "id").limit(k)


def rerank(ranked: DataFrame, scores: DataFrame | None, pool: int = CANDIDATES) -> DataFrame:
    """Rows (id, rank) with the first pool reordered by other scores (id, rescore); the tail stays behind.

    Without scores, as when the scorer is not there, the order stays.
    """
    if scores is None:
        return ranked
    # Ranks are 1, 2, ...: the pool has as many rows as its name says, and what is behind it stays as it is.
    inside = ranked.where(F.col("rank") <= pool).join(scores, "id", "left")
    order = Window.orderBy(-F.coalesce("rescore", F.lit(float("-inf"))), "rank")
    return inside.withColumn("rank", F.row_number().over(order)).select(*ranked.columns).unionByName(ranked.where(F.col("rank") > pool))


def lexical_score(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a model that scores pairs: share of the query's words in a text."""
    asked = F.array_distinct(word_tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, word_tokens(text))), F.size(asked)), F.lit(0.0))


def section_family(section: Column) -> Column:
    """First number of the last numbered part of a section path; null without one."""
    numbers = F.regexp_extract_all(F.coalesce(section, F.lit("")), F.lit(r"(?:^|>\s*)(\d+)(?:\.\d+)*[.)]?\s"), F.lit(1))
    return F.try_element_at(numbers, F.lit(-1))


def expand_sections(selected: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """The best hit's section family in document order, then the other hits, limit rows in all.

    selected: (id, score, rank); chunks: (id, source_file, section, chunk_index).
    """
    named = chunks.withColumn("family", section_family(F.col("section")))
    anchor = selected.where("rank = 1").join(named, "id").select(F.col("id").alias("anchor"), F.col("source_file").alias("a_file"), F.col("family").alias("a_family"), F.col("score").alias("a_score"))
    kin = named.join(few(anchor), named.source_file.eqNullSafe(F.col("a_file")) & (named.family == F.col("a_family")))
    kin = kin.select("id", F.when(F.col("id") == F.col("anchor"), F.col("a_score")).otherwise(F.lit(0.0)).alias("score"), F.lit(0).alias("part"), F.col("chunk_index").cast("long").alias("place"))
    rest = selected.join(kin.select("id"), "id", "left_anti").select("id", "score", F.lit(1).alias("part"), F.col("rank").cast("long").alias("place"))
    return kin.unionByName(rest).orderBy("part", "place", "id").limit(limit)


def library_score(items: DataFrame, as_of: Column, alpha: float, beta: float, gamma: float, k: int, first: int = 50) -> DataFrame:
    """The k best of the first items by cosine, by recency, importance and cosine.

    items: (id, cosine, updated, referenced, importance). Two steps, since the
    first bounds what the second can return.
    """
    days = lambda c: (F.unix_micros(as_of) - F.unix_micros(F.col(c))) / F.lit(86_400_000_000.0)
    near = items.orderBy(F.desc("cosine"), "id").limit(first)
    recency = F.lit(alpha) * F.exp(-days("updated") / RECENCY_DAYS)
    weight = F.lit(beta) * (F.col("importance") / 10.0) * F.exp(-days("referenced") / REFERENCE_DAYS)
    return near.withColumn("score", recency + weight + F.lit(gamma) * F.col("cosine")).orderBy(F.desc("score"), "id").limit(k)


def related_by_tags(items: DataFrame, anchor: DataFrame, limit: int = 15) -> DataFrame:
    """Items (id, name, tags) that share tags with an anchor (one row: id, tags), most shared first, then by name."""
    one = few(anchor.select(F.col("id").alias("anchor"), F.col("tags").alias("asked")))
    shared = items.join(one, (items.id != F.col("anchor")) & F.arrays_overlap("tags", "asked"))
    return shared.select("id", "name", F.size(F.array_intersect("tags", "asked")).alias("n_shared")).orderBy(F.desc("n_shared"), F.lower("name"), "id").limit(limit)


def theme_match(needle: Column, themes: Column) -> Column:
    """Whether themes fit a search: none asked, themes that are for every sector only, a part of a theme, or a shared token of four letters."""
    wanted = fold(needle)
    lowered = F.transform(themes, fold)
    every = (F.size(lowered) > 0) & F.forall(lowered, lambda t: t == "multissetorial")
    long_tokens = lambda t: F.filter(F.split(t, "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    either = F.exists(lowered, lambda t: F.exists(long_tokens(t), lambda a: F.exists(long_tokens(wanted), lambda b: F.contains(a, b) | F.contains(b, a))))
    return (wanted == "") | every | F.exists(lowered, lambda t: F.contains(t, wanted)) | either


def hybrid(chunks: DataFrame, query: DataFrame, query_vector: DataFrame, wanted: list[str], k: int = 5, sparse_weight: float = 0.5) -> DataFrame:
    """Dense and BM25 arms, fused, boosted and diversified: the k best (id, source_file, score).

    chunks: (id, text, vector, source_file and the flags that are wanted).
    """
    near = dense(chunks, query_vector)
    said = top_k(bm25(chunks.select("id", "text"), query))
    fused = fuse(near, said, 1 - sparse_weight, sparse_weight).join(chunks.select("id", "source_file", *wanted), "id")
    return diversify(boost(fused, wanted), k).select("id", "source_file", "score")


def coverage_outline(hits: DataFrame) -> DataFrame:
    """Distinct section groups of ranked hits (rank, section), in order of their first hit; groups are the first two levels."""
    group = F.array_join(F.slice(F.split(F.coalesce("section", F.lit("")), " > "), 1, 2), " > ")
    return hits.groupBy(group.alias("section_group")).agg(F.min("rank").alias("first_rank"), F.count("*").alias("n_hits"))
