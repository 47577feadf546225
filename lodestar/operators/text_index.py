"""An inverted index of a table of texts, and two rankings that read nothing but postings.

Postings are written once, as packs of a word's postings in some documents,
dealt by a hash of the stem and sorted within each file, so a query's words
lead to few folders and, by the statistics of their row groups, to few pages of
them. A posting holds the word's places and the length of its document; what
else a ranking needs is one row of totals.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestar.functions.stems import stem
from lodestar.functions.text import LETTERS, STOPWORDS, letter_tokens, search_tokens
from lodestar.operators.retrieval import B, K1
from lodestar.session import shared_path, small

#: Folders that stems are dealt to, and characters of the documents of a pack.
BUCKETS, PACK = 16, 8_000_000
#: A word's postings in some documents: how many, their total of places, documents, ends of their places, lengths, and places.
_PACK = "word string, n int, total long, ids array<long>, ends array<int>, lengths array<int>, places array<int>"
#: Weight of a word without a class, places of a word that count, the sum that no number of places exceeds, terms of a query.
WEIGHT, PLACES, LIMIT, TERMS = 0.1, 255, 1.64493406685, 8


@dataclass(frozen=True)
class TextIndex:
    """A path's postings (bucket, stem, word, id, tf, positions, length), and the number of documents, their mean length and the least weight of a word."""

    path: str
    postings: DataFrame
    documents: int
    mean_length: float
    floor: float


def _bucket(stems: Column) -> Column:
    return F.pmod(F.xxhash64(stems), F.lit(BUCKETS)).cast("int")


def _idf(n: int, df: Column) -> Column:
    return F.ln(F.lit(n) - df + 0.5) - F.ln(df + 0.5)


def _packs(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """Rows of _PACK, one for each word of some documents."""
    find, words, many = re.compile(LETTERS).findall, [], []
    for text in texts:
        found = find(text)
        words += found
        many.append(len(found))
    told = pa.array(words, pa.string()).dictionary_encode()
    stop = set(STOPWORDS)
    wanted = np.array([len(w) >= 3 and w not in stop for w in told.dictionary.to_pylist()], bool)
    many = np.array(many, np.int64)
    doc = np.repeat(np.arange(len(many)), many)
    place = np.arange(1, len(doc) + 1) - np.repeat(np.cumsum(many) - many, many)
    code = told.indices.to_numpy(zero_copy_only=False)
    kept = wanted[code] if len(code) else np.zeros(0, bool)
    code, doc, place = code[kept], doc[kept], place[kept]
    length = np.bincount(doc, minlength=len(many))
    order = np.lexsort((doc, code))
    code, doc, place = code[order], doc[order], place[order]
    firsts = lambda *keys: np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])) if len(keys[0]) else np.zeros(0, np.int64)
    at = firsts(code, doc)
    ends = np.append(at, len(code))
    code, doc = code[at], doc[at]
    start = firsts(code)
    stops = np.append(start, len(code))
    places = np.diff(ends[stops])
    lists = lambda stops, values: pa.ListArray.from_arrays(pa.array(stops, pa.int32()), values)
    own = [told.dictionary.take(pa.array(code[start])), pa.array(np.diff(stops), pa.int32()), pa.array(places, pa.int64())]
    within = pa.array(ends[1:] - np.repeat(ends[stops[:-1]], np.diff(stops)), pa.int32())
    own += [lists(stops, ids.take(pa.array(doc))), lists(stops, within), lists(stops, pa.array(length[doc], pa.int32())), lists(ends[stops], pa.array(place, pa.int32()))]
    return pa.RecordBatch.from_arrays(own, ["word", "n", "total", "ids", "ends", "lengths", "places"])


def _packed(docs: DataFrame) -> DataFrame:
    """Rows of _PACK of documents (id, text) that have an id each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start, size = batch["text"].to_pylist(), 0, 0
            for k, text in enumerate(texts, 1):
                size += len(text)
                if size >= PACK or k == len(texts):
                    made = _packs(batch["id"].slice(start, k - start), texts[start:k])
                    start, size = k, 0
                    for first in range(0, len(made), 10_000):
                        yield made.slice(first, 10_000)

    told = docs.select(F.col("id").cast("long").alias("id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return told.mapInArrow(run, _PACK)


def _merged(docs: DataFrame) -> DataFrame:
    """Rows of _PACK of documents (id, text), a posting each, where several rows of one id are one document."""
    told = docs.select("id", letter_tokens(F.col("text")).alias("all")).select("id", F.posexplode("all").alias("place", "word"))
    kept = told.where((F.length("word") >= 3) & ~F.col("word").isin(*STOPWORDS))
    placed = kept.groupBy("id", "word").agg(F.sort_array(F.collect_list(F.col("place") + 1)).alias("positions"))
    lengths = docs.groupBy("id").agg(F.sum(F.size(search_tokens(F.col("text")))).alias("length"))
    rows = placed.join(lengths, placed["id"].eqNullSafe(lengths["id"])).select(placed["id"], "word", "positions", "length")
    tf = F.size("positions")
    one = [F.array(F.col("id").cast("long")).alias("ids"), F.array(tf).alias("ends"), F.array(F.col("length").cast("int")).alias("lengths"), F.col("positions").alias("places")]
    return rows.select("word", F.lit(1).alias("n"), tf.cast("long").alias("total"), *one)


def build(docs: DataFrame, path: str | None = None, files: int | None = None) -> TextIndex:
    """Write the index of documents (id, text) to a path of the shared folder, or to one that is given.

    Words are those of `search_tokens`; places count all runs of letters from
    1. Rows of one id are one document; a null text has no words, but is a
    document. A task packs the postings that a word has in some documents into
    a row, and writes its packs, sorted, to a file of each folder, so that no
    posting is shuffled (but those of repeated ids). files: how many files a
    folder has at most, as many as shuffle partitions by default.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "postings")
    ids = docs.groupBy("id").agg(F.count("*").alias("times"))
    documents, repeated = ids.agg(F.count("*"), F.coalesce(F.sum((F.col("times") > 1).cast("int")), F.lit(0))).first()
    if repeated:
        twice = small(ids.where("times > 1").select(F.col("id").alias("twice")))
        again = F.col("id").eqNullSafe(F.col("twice"))
        packs = _packed(docs.join(twice, again, "left_anti")).unionByName(_merged(docs.join(twice, again, "left_semi")))
    else:
        packs = _packed(docs)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = packs.withColumn("stem", stem(F.col("word"))).withColumn("bucket", _bucket(F.col("stem")))
    dealt.coalesce(files).sortWithinPartitions("bucket", "stem", "word").write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    return read(spark, path, documents)


def read(spark: SparkSession, path: str, documents: int) -> TextIndex:
    """The index at a path, of so many documents."""
    packs = spark.read.schema(f"stem string, {_PACK}, bucket int").parquet(path)
    each = packs.select("*", F.posexplode("ids").alias("k", "id"))
    before = F.when(F.col("k") > 0, F.get("ends", F.col("k") - 1)).otherwise(0)
    tf = F.get("ends", "k") - before
    postings = each.select("stem", "word", "id", tf.alias("tf"), F.slice("places", before + 1, tf).alias("positions"), F.get("lengths", "k").cast("long").alias("length"), "bucket")
    words = packs.groupBy("word").agg(F.sum("n").alias("df"), F.sum("total").alias("tf"))
    total, idf = words.agg(F.sum("tf"), F.avg(_idf(documents, F.col("df")))).first()
    return TextIndex(path, postings, documents, (total or 0) / max(1, documents), 0.25 * (idf or 0.0))


def _asked(query: DataFrame) -> list[tuple[str, str]]:
    """Words of the query's one row with their stems, in order."""
    words = search_tokens(F.col("text"))
    rows = query.select(F.transform(words, lambda w: F.struct(w.alias("word"), stem(w).alias("stem"))).alias("terms")).limit(2).collect()
    if len(rows) > 1:
        raise ValueError("a query is one row")
    return [(r.word, r.stem) for r in rows[0].terms] if rows else []


def _of(index: TextIndex, stems: list[str]) -> DataFrame:
    """Postings of stems, by folder and by row group."""
    spark = index.postings.sparkSession
    buckets = [r[0] for r in spark.createDataFrame([(s,) for s in stems], "stem string").select(_bucket(F.col("stem"))).distinct().collect()] if stems else []
    return index.postings.where(F.col("bucket").isin(*sorted(buckets)) & F.col("stem").isin(*stems)) if stems else index.postings.limit(0)


def full_text(index: TextIndex, query: DataFrame, terms: int = TERMS) -> DataFrame:
    """Rows (id, score) of documents with any of the first terms of a query (one row: text), by how often they have each.

    A stem adds WEIGHT times the sum of 1 / j² for its first, second, j-th
    place, PLACES at most, over LIMIT; the sum is divided by the number of
    stems asked for. Scores are rounded to nine places. Words of one stem are
    one term.
    """
    first = list(dict.fromkeys(_asked(query)))[:terms]
    stems = sorted({s for _, s in first})
    found = _of(index, stems).groupBy("id", "stem").agg(F.sum("tf").alias("tf"))
    places = F.sequence(F.lit(1), F.least(F.col("tf"), F.lit(PLACES)).cast("int"))
    worth = F.aggregate(places, F.lit(0.0), lambda total, j: total + 1.0 / (j * j))
    return found.groupBy("id").agg(F.round(F.sum(F.lit(WEIGHT) * worth / LIMIT) / max(1, len(stems)), 9).alias("score"))


def bm25(index: TextIndex, query: DataFrame) -> DataFrame:
    """Rows (id, score) of documents with a positive Okapi score for a query (one row: text), as `retrieval.bm25` defines it."""
    asked = Counter(_asked(query))
    held = _of(index, sorted({s for _, s in asked})).where(F.col("word").isin(*sorted({w for w, _ in asked}))).select("word", "id", "tf", "length")
    spark, n = held.sparkSession, index.documents
    times = spark.createDataFrame(sorted((w, k) for (w, _), k in asked.items()), "word string, times long")
    weights = held.groupBy("word").agg(F.count("*").alias("df")).join(F.broadcast(times), "word").withColumn("idf", _idf(n, F.col("df")))
    weights = weights.select("word", "times", F.when(F.col("idf") < 0, F.lit(index.floor)).otherwise(F.col("idf")).alias("idf"))
    share = F.col("length") / F.lit(index.mean_length if index.mean_length > 0 else math.nan)
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * share))
    return held.join(F.broadcast(weights), "word").groupBy("id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
