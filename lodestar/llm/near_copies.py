"""Near copies by the Jaccard similarity of word shingles.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Some such texts differ in 5 to 11 bits of a 64-bit
SimHash (14 pairs of the driver's two smallest tables), too many for blocks of
bits, so pairs meet by MinHash: BANDS keys of ROWS minima each. A pair at 0.8 shares a
key with a probability of 1 - (1 - 0.8 ** ROWS) ** BANDS, over 0.9998, and
every pair that meets is verified by its whole sets.

Texts that share no key leave the search before their sets are sent. A key
that many share is dealt out as pairs of tiles of bounded size, each of which
returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.common import HOT_KEYS, attach, bounded, components, materialize, release

#: Words of a shingle.
WORDS = 5
#: Keys of a text and minima of a key.
BANDS, ROWS = 12, 3
#: Texts in a tile of a key that many share.
TILE = 256
#: Factors and masks of the hash orders that minima are taken in.
_FACTORS, _MASKS = np.random.default_rng(20_250_102).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Hashes of the five-word shingles of a text in UTF-8, without repeats, in rising order.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space;
    a shorter text is one shingle, and one without words has none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-WORDS])).tolist()
    stops = (ends[WORDS - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(starts)))


def keys(found: np.ndarray) -> list[int]:
    """The BANDS keys of a set of shingles, as signed longs; none of an empty set."""
    if not len(found):
        return []
    least = np.array([((found ^ m) * f).min() for f, m in zip(_FACTORS, _MASKS)], np.uint64).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(least)]


def similar(common: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes with so many common members have a Jaccard similarity of 0.8 or more."""
    return 9 * common >= 4 * (size + sizes)


def forest(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (a, b) with the same components as all similar pairs of the sets."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], sizes.cumsum()[:-1]))
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    root, out = np.array(np.unique(ids, return_inverse=True)[1]), []
    for i, size in enumerate(sizes.tolist()):
        if (root == root[0]).all():
            break
        mark = np.zeros(len(values), bool)
        mark[codes[starts[i] : starts[i] + size]] = True
        common = np.add.reduceat(mark[codes], starts, dtype=np.int64)
        for j in np.flatnonzero(similar(common, size, sizes) & (root != root[i])).tolist():
            if root[j] != root[i]:
                out.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
    return out


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the groups of (t, k, i, j), whose rows arrive sorted."""

    def out(ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = forest(ids, sets) if len(ids) > 1 else []
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    last, ids, sets = None, [], []
    for batch in batches:
        for *group, text_id, found in zip(*(c.to_pylist() for c in batch.columns)):
            if group != last:
                yield from out(ids, sets)
                last, ids, sets = group, [], []
            ids.append(text_id)
            sets.append(np.frombuffer(found, np.uint64))
    yield from out(ids, sets)


def _with_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [keys(shingles(t.as_py())) for t in batch.column(2).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["digest", "doc_id", "keys"])


def _with_shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t.as_py()).tobytes() for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["text_id", "found"])


def links(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """Rows (a, b) of text ids with the same components as the near copies.

    texts has (digest, text), keyed a row (text_id, digest, keys) per text.
    """
    every = keyed.select("text_id", F.posexplode("keys").alias("t", "k"))
    shared = materialize(every.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = materialize(attach(every, shared, ["t", "k"], "n", rows=HOT_KEYS), "met")
    wanted = bounded(materialize(keyed.select("text_id", "digest").join(met.select("text_id").distinct(), "text_id"), "wanted"))
    some = texts.join(wanted, "digest").select("text_id", "text").mapInArrow(_with_shingles, "text_id long, found binary")
    sets = materialize(some.groupBy("text_id").agg(F.first("found").alias("found")), "sets")
    tiled = met.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).withColumn("mine", F.pmod("text_id", F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("t", "k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "text_id")
    dealt = tiled.join(sets, "text_id").select("t", "k", "i", "j", "text_id", "found")
    dealt = dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return dealt.mapInArrow(_links, "a long, b long").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each component of them, the text with the smallest id.

    Columns stay as they are. docs must be materialized, since it is read more
    than once. Equal texts stay or go together; null texts and texts without
    words have no near copies. An empty table gives an empty result.
    """
    digest = F.unhex(F.sha2(F.col(text_col), 256))  # tells texts apart at any number of them, as 64 bits don't
    texts = docs.select(digest.alias("digest"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    keyed = texts.mapInArrow(_with_keys, "digest binary, doc_id long, keys array<long>")
    keyed = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    # Numbers of texts, which are the same wherever the written table is read.
    keyed = materialize(keyed.withColumn("text_id", F.monotonically_increasing_id()), "keyed")
    roots = materialize(components(links(texts.select("digest", "text"), keyed)), "roots")
    named = roots.join(keyed.select("text_id", "doc_id", "digest"), roots.node == F.col("text_id"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    kept = named.groupBy("root").agg(F.min(order).alias("kept")).select("kept.digest")
    gone = materialize(named.join(kept, "digest", "left_anti").select(F.col("digest").alias("__gone")), "gone")
    release(keyed, roots)
    return docs.join(bounded(gone), digest == F.col("__gone"), "left_anti")
