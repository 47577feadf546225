"""How filters overlap: what each removes, alone and in every order.

One pass scans the bytes of the texts' Arrow buffers. Byte classes (space,
capital, symbol, first byte of a character) are looked up for whole slices at
once and summed by prefix sums, of which a text takes the difference at its
ends. Words are hashed by prefix sums as well; a text's hashes are sorted, and
words that share a hash are compared byte by byte, so distinct words are
counted exactly. The filters that a text fails become the bits of a mask.

A text's copies meet by its digest; all but the smallest id of a digest fail
the last filter. From there on masks are counted, not documents: a part has 32
masks at most, and what an order of filters does to a mask is a fixed table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.llm.common import bounded, materialize, release

#: Kept texts have so many words at least, distinct words in per cent of words, and capitals in per cent of characters at most.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
#: Fixed value: symbols that no kept text has.
SYMBOLS = "#$%&*|"
FILTERS = "ABCDE"
#: Bytes of text whose classes and hashes are held at a time.
CHUNK = 1 << 20

_SPACE, _CAPITAL, _SYMBOL, _FIRST = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] |= _SPACE
_CLASS[ord("A") : ord("Z") + 1] |= _CAPITAL
_CLASS[[ord(c) for c in SYMBOLS]] |= _SYMBOL
_CLASS[:0x80] |= _FIRST
_CLASS[0xC0:] |= _FIRST

#: Odd multipliers of the words' hashes: of each place, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of a base from 0 to n, modulo 2**64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, CHUNK), _powers(pow(_BASE, -1, 1 << 64), CHUNK)


def class_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Capitals, symbols and characters of each text, by prefix sums of byte classes that go on from slice to slice."""
    out = []
    for bit in (_CAPITAL, _SYMBOL, _FIRST):
        at_offset, seen = np.zeros(len(offsets), np.int64), 0
        for start in range(0, len(data), CHUNK):
            sums = np.cumsum((_CLASS[data[start : start + CHUNK]] & bit) != 0, dtype=np.int32)
            inside = slice(*np.searchsorted(offsets, (start + 1, start + len(sums) + 1)))
            at_offset[inside] = seen + sums[offsets[inside] - start - 1]
            seen += int(sums[-1])
        out.append(np.diff(at_offset))
    return tuple(out)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last; words end with their text."""
    starts, ends, last = [], [], False
    for start in range(0, len(data), CHUNK):
        word = (_CLASS[data[start : start + CHUNK]] & _SPACE) == 0
        before, begins = np.concatenate(([last], word[:-1])), np.zeros(len(word), bool)
        begins[offsets[slice(*np.searchsorted(offsets, (start, start + len(word))))] - start] = True
        starts.append(np.flatnonzero(word & (begins | ~before)) + start)
        ends.append(np.flatnonzero(before & (begins | ~word)) + start)
        last = bool(word[-1])
    ends.append(np.full(int(last), len(data)))
    return np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate(ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, by prefix sums over slices of whole words; one that is longer than a slice has a digest's first bytes."""
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    k = 0
    while k < len(starts):
        # As many words as a slice has room for.
        stop = int(np.searchsorted(ends, starts[k] + CHUNK, "right"))
        if stop == k:
            out[k] = int.from_bytes(hashlib.sha256(data[starts[k] : ends[k]]).digest()[:8], "little")
            k += 1
            continue
        low, high = int(starts[k]), int(ends[stop - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * _UP[: high - low], out=sums[1:])
        first = starts[k:stop] - low
        value = (sums[ends[k:stop] - low] - sums[first]) * _DOWN[first]
        value ^= value >> np.uint64(32)
        value = (value + lengths[k:stop].astype(np.uint64)) * _MIX
        out[k:stop] = value ^ (value >> np.uint64(29))
        k = stop
    return out


def _same(data: np.ndarray, one: np.ndarray, other: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether pairs of words of equal lengths have the same bytes."""
    same = np.ones(len(one), bool)
    ends = np.cumsum(lengths)
    k = 0
    while k < len(one):
        stop = max(k + 1, int(np.searchsorted(ends, ends[k] - lengths[k] + CHUNK, "right")))
        if stop == k + 1:
            same[k] = data[one[k] : one[k] + lengths[k]].tobytes() == data[other[k] : other[k] + lengths[k]].tobytes()
        else:
            many = lengths[k:stop]
            firsts = ends[k:stop] - many - (ends[k] - lengths[k])
            shift = np.arange(int(many.sum())) - np.repeat(firsts, many)
            differ = data[np.repeat(one[k:stop], many) + shift] != data[np.repeat(other[k:stop], many) + shift]
            same[k:stop] = np.add.reduceat(differ, firsts, dtype=np.int64) == 0
        k = stop
    return same


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first_word: np.ndarray) -> np.ndarray:
    """Distinct words of each text; text t has the words from first_word[t] to first_word[t + 1]."""
    n_words = np.diff(first_word)
    hashes, text_of = word_hashes(data, starts, ends), np.repeat(np.arange(len(n_words)), n_words)
    order = np.empty(len(hashes), np.int64)
    for a, b in zip(first_word[:-1].tolist(), first_word[1:].tolist()):
        order[a:b] = a + np.argsort(hashes[a:b], kind="stable")
    again = np.flatnonzero((hashes[order[1:]] == hashes[order[:-1]]) & (text_of[1:] == text_of[:-1]))
    out = n_words - np.bincount(text_of[again], minlength=len(n_words))
    one, other = order[again], order[again + 1]
    lengths = ends - starts
    equal = lengths[one] == lengths[other]
    equal[equal] = _same(data, starts[one[equal]], starts[other[equal]], lengths[one[equal]])
    # Different words that share a hash: the words of that text are compared themselves.
    for t in np.unique(text_of[again[~equal]]).tolist():
        out[t] = len({data[a:b].tobytes() for a, b in zip(starts[first_word[t] : first_word[t + 1]].tolist(), ends[first_word[t] : first_word[t + 1]].tolist())})
    return out


def _groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with a slice's bytes together, or one longer text."""
    k, n = 0, len(offsets) - 1
    while k < n:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK, "right")) - 1)
        yield k, stop
        k = stop


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row per document: doc_id, part, n_words, n_distinct, n_capitals, n_symbols, n_chars (long), digest (binary).

    Words are maximal runs without white space, as they are written; digest is
    the text's SHA-256. A null text is an empty one, and a null part too. Texts
    are measured whole; repeated rows each give a row; other columns are
    ignored.
    """
    names = ["doc_id", "part", "n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars", "digest"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_string())
            if not len(texts):
                continue
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            digests = []
            for k, stop in _groups(offsets):
                data, inner = whole[offsets[k] : offsets[stop]], offsets[k : stop + 1] - offsets[k]
                starts, ends = word_bounds(data, inner)
                first_word = np.searchsorted(starts, inner)
                found = (np.diff(first_word), distinct_words(data, starts, ends, first_word), *class_counts(data, inner))
                for column, values in zip(columns, found):
                    column.append(values)
                digests += [hashlib.sha256(data[a:b]).digest() for a, b in zip(inner[:-1].tolist(), inner[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(np.concatenate(c).astype(np.int64)) for c in columns), pa.array(digests, pa.binary())], names)

    kept = (F.col(f"`{id_col}`").cast("long").alias("doc_id"), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((part_col, "part"), (text_col, "text"))))
    return docs.select(*kept).mapInArrow(run, "doc_id long, part string, n_words long, n_distinct long, n_capitals long, n_symbols long, n_chars long, digest binary")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", min_words: int = MIN_WORDS, min_distinct: int = MIN_DISTINCT, max_capitals: int = MAX_CAPITALS) -> DataFrame:
    """A row per document: doc_id, part and mask (int), whose bit k says that the document fails filter k.

    A too few words, B too few distinct words, C too many capitals, D a
    symbol, E a smaller id has the same text. Rows without an id are nobody's
    copy and have none; rows that share an id aren't each other's copies.
    """
    measured = materialize(measure(docs, id_col, text_col, part_col), "measured")
    # Of each text the smallest id: looked up by both, so that copies of one text are no one key.
    firsts = measured.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = measured.where("doc_id is not null").join(firsts, ["digest", "doc_id"], "left")
    rows = known.unionByName(measured.where("doc_id is null").withColumn("first", F.lit(True)))
    fails = (
        F.col("n_words") < min_words,
        100 * F.col("n_distinct") < min_distinct * F.col("n_words"),
        100 * F.col("n_capitals") > max_capitals * F.col("n_chars"),
        F.col("n_symbols") > 0,
        F.col("first").isNull(),
    )
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails[1:], 1)), fails[0].cast("int"))
    return rows.select("doc_id", "part", mask.alias("mask"))


def outcomes(spark: SparkSession) -> DataFrame:
    """What each order of the filters does to each mask, step by step: a fixed table of 32 x 600 rows.

    share is how many of all orders let the step's filter remove the mask: of
    the filters that it fails, each comes first in as many.
    """
    rows = []
    for mask in range(1 << len(FILTERS)):
        failed = mask.bit_count()
        for order in permutations(FILTERS):
            gone = False
            for step, name in enumerate(order, 1):
                fails = bool(mask >> FILTERS.index(name) & 1)
                removed = fails and not gone
                rows.append((mask, "".join(order), step, int(not gone and not fails), int(removed), int(fails and gone), int(fails and failed == 1), 120 // failed if fails else 0))
                gone = gone or fails
    return spark.createDataFrame(rows, "mask int, filter_order string, step int, stays long, goes long, late long, alone long, share long")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", quality_col: str = "quality", toxic_col: str = "toxic", **limits: int) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    Every part has a row for each of the 120 orders of the five filters of
    `failures` and each of the five steps. kept: documents left after the
    step; removed: by it; redundant: failing its filter, but removed before;
    unique_fails: failing its filter only; good_lost, toxic_lost: removed and
    labelled so (1 in some label row of the id); shapley: removed by its
    filter, summed over all orders. A null part is the empty one. An empty
    table has no parts and no rows; limits are those of `failures`.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *(F.coalesce(F.col(f"`{c}`") == 1, F.lit(False)).cast("long").alias(n) for c, n in ((quality_col, "good"), (toxic_col, "toxic"))))
    marks = materialize(marks.where("doc_id is not null and (good = 1 or toxic = 1)").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")), "marks")
    failed = materialize(failures(docs, id_col, text_col, part_col, **limits), "failed")
    known = failed.where("doc_id is not null").join(bounded(marks), "doc_id", "left")
    rows = known.unionByName(failed.where("doc_id is null").withColumns({"good": F.lit(None).cast("long"), "toxic": F.lit(None).cast("long")}))
    masks = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    steps = materialize(masks, "masks").join(F.broadcast(outcomes(spark)), "mask")
    return steps.groupBy("part", "filter_order", "step").agg(
        F.sum(F.col("n") * F.col("stays")).alias("kept"),
        F.sum(F.col("n") * F.col("goes")).alias("removed"),
        F.sum(F.col("n") * F.col("late")).alias("redundant"),
        F.sum(F.col("n") * F.col("alone")).alias("unique_fails"),
        F.sum(F.col("good") * F.col("goes")).alias("good_lost"),
        F.sum(F.col("toxic") * F.col("goes")).alias("toxic_lost"),
        F.sum(F.col("n") * F.col("share")).alias("shapley"),
    )


#: DuckDB SQL of `audit` over the tables documents and labels.
AUDIT_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, len(w) < {MIN_WORDS} AS a, 100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(text) AS c,
         regexp_matches(text, '[{SYMBOLS}]') AS d, coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e FROM t
), g AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN g USING (doc_id) GROUP BY ALL
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT p.l || q.l || r.l || s.l || u.l AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
  FROM x p, x q, x r, x s, x u WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND (p.bit | q.bit | r.bit | s.bit | u.bit) = 31
), k AS (
  SELECT filter_order, step, bits[step] AS bit, list_sum(list_concat([0], bits[1:step - 1])) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)
), c AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN (mask & (earlier | bit)::INT) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN (mask & bit) > 0 AND (mask & earlier::INT) = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN (mask & bit) > 0 AND (mask & earlier::INT) > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN (mask & bit) > 0 AND (mask & earlier::INT) = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN (mask & bit) > 0 AND (mask & earlier::INT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, k GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM c
"""
