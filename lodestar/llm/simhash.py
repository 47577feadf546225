"""Near duplicates by SimHash fingerprints.

Method: fingerprints are cut into six blocks of bits. Two fingerprints that
differ in at most three bits differ in at most three blocks, so they agree on
at least three: each fingerprint is keyed once for each of the 20 choices of
three blocks, rows are joined on those keys of 32 bits or so, and the Hamming
distance of what meets is verified.

Exact copies are one row before any join. Fingerprints of a key that many share
are keyed again by the same rule within the bits that the key leaves open, so
that only those meet which agree on half of these too. Groups are dealt out as
pairs of tiles of bounded size, and each tile pair returns a spanning forest of
its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.common import HOT_KEYS, attach, components, materialize, release

#: Fingerprints that differ in so many bits or fewer are linked.
MAX_BITS = 3
#: Widths of the blocks, from the lowest bit.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints in a tile of a key that many share, and fingerprints of a key beyond which they are keyed again.
TILE, MANY = 512, 1 << 14
#: Shingles hashed at once, which bounds memory on long texts.
CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of a text in UTF-8, as an unsigned integer.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space;
    shingles are three words in a row, with repeats, or the whole sequence if
    it is shorter. A bit is set if it is set in over half the XXH64 values
    (seed 42). Without words the fingerprint is zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= 3:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-3])).tolist()
    stops = (ends[2:] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, fp) per document; fp is the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(within: int = (1 << 64) - 1, widths: tuple[int, ...] = BLOCKS) -> list[int]:
    """Masks of the choices of blocks: runs of so many of the bits within, in order."""
    bits = [b for b in range(64) if within >> b & 1]
    blocks, at = [], 0
    for width in widths:
        blocks.append(sum(1 << b for b in bits[at : at + width]))
        at += width
    return [sum(chosen) for chosen in combinations(blocks, len(widths) - MAX_BITS)]


def _open_masks(mask: int) -> list[int]:
    """Masks within the bits that a mask leaves open, in six blocks of a like width."""
    left = 64 - mask.bit_count()
    return _masks(~mask & (1 << 64) - 1, tuple(left // 6 + (k < left % 6) for k in range(6)))


def _forest(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) from each fingerprint to the root of its tree, in each run of equal group.

    Trees are the components of the close pairs of a group; there are fewer
    links than fingerprints, however many pairs are close.
    """
    lows, highs, n = [], [], len(fps)
    for step in range(1, n):
        same = np.flatnonzero(group[:-step] == group[step:])
        if not len(same):
            break
        close = same[np.bitwise_count(fps[same] ^ fps[same + step]) <= MAX_BITS]
        lows.append(close)
        highs.append(close + step)
    low = np.concatenate(lows) if lows else np.empty(0, np.int64)
    high = np.concatenate(highs) if highs else np.empty(0, np.int64)
    root = np.arange(n)
    while len(low):
        # Hang the larger root of each link under the smaller; keep what joined two trees.
        x, y = root[low], root[high]
        apart = x != y
        low, high, x, y = low[apart], high[apart], x[apart], y[apart]
        if not len(low):
            break
        under = np.arange(n)
        np.minimum.at(under, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = under[under]
            if (further == under).all():
                break
            under = further
        root = under[root]
    hung = np.flatnonzero(root != np.arange(n))
    return fps[hung].view(np.int64), fps[root[hung]].view(np.int64)


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the groups of (t, k, i, j), whose rows arrive sorted."""
    rest: pa.Table | None = None

    def out(table: pa.Table) -> pa.RecordBatch:
        keys = np.column_stack([table.column(c).to_numpy() for c in ("t", "k", "i", "j")])
        new = np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))
        a, b = _forest(table.column("fp").to_numpy().view(np.uint64), np.cumsum(new))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        keys = np.column_stack([table.column(c).to_numpy() for c in ("t", "k", "i", "j")])
        last = int(np.argmax((keys == keys[-1]).all(1)))  # the last group may go on in the next batch
        if last:
            yield out(table.slice(0, last).combine_chunks())
        rest = table.slice(last)
    if rest is not None:
        yield out(rest.combine_chunks())


def groups(distinct: DataFrame) -> DataFrame:
    """Rows (t, k, i, j, fp): each two of distinct fingerprints (fp) within MAX_BITS share a (t, k, i, j), a pair of tiles."""
    masks = _masks()
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)])).alias("x")).select("x.t", "x.k", "fp")
    met, many = _shared(keyed)
    if many:
        # Keys of half the open bits, told apart by t from the first ones.
        inner = [F.array(*[F.struct(F.lit(len(masks) * (t + 1) + s).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m | o))).alias("k")) for s, o in enumerate(_open_masks(m))]) for t, m in enumerate(masks)]
        again = met.where(F.col("n") > MANY).withColumn("x", F.explode(F.element_at(F.array(*inner), F.col("t") + 1))).select("x.t", "x.k", "fp")
        met = met.where(F.col("n") <= MANY).unionByName(_shared(again)[0])
    met = met.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select("t", "k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")


def links(distinct: DataFrame) -> DataFrame:
    """Rows (a, b) with the same components as the pairs of distinct fingerprints (fp) within MAX_BITS.

    A link joins a fingerprint to the root of its tree in one group, so the
    two may be further apart than MAX_BITS, with close ones between them.
    """
    sorted_ = groups(distinct).repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return sorted_.mapInArrow(_links, "a long, b long").distinct()


def _shared(keyed: DataFrame) -> tuple[DataFrame, bool]:
    """The rows (t, k, fp) of keys that several have, with their number n; whether over MANY have one."""
    shared = materialize(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = attach(keyed, shared, ["t", "k"], "n", rows=HOT_KEYS).select("t", "k", "fp", "n")
    return met, not shared.where(F.col("n") > MANY).isEmpty()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, fingerprint, component_id) per document.

    component_id is the smallest doc_id reachable over links of at most
    MAX_BITS bits, the document's own included; the whole graph of distinct
    fingerprints is searched, with no cap. Repeated rows each return a row; a
    null or empty text has the fingerprint zero; documents with a null doc_id
    get the smallest id of the rest of their component, null if there is
    none. Other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    fps, roots = classes(docs, id_col, text_col)
    joined = attach(fps, roots, "fp", "n")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tables (doc_id, fp) and (fp, n, root, component_id), the second with a row per fingerprint.

    root tells components apart even where ids are repeated or null.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    named = materialize(named, "named")
    out = materialize(attach(rooted, named, "root", "size").select("fp", "n", "root", "component_id"), "classes")
    release(distinct, rooted, named)
    return fps, out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near duplicates: of each component, the one with the smallest id.

    Columns stay as they are. Where several rows have that id, one of them
    stays: of those with the smallest fingerprint, any one (they are equal for
    this operator).
    """
    fps, named = classes(docs, id_col, text_col)
    own = attach(fps, named, "fp", "n").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = own.groupBy("root").agg(F.min("doc_id").alias("__kept_id"), F.min("fp").alias("__kept_fp")).drop("root")
    # Documents are shuffled by id at every size: what stays is a share of the rows, too many to broadcast.
    chosen = materialize(chosen, "chosen")
    repeated = materialize(fps.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "repeated_ids")
    hot = materialize(repeated.orderBy(F.desc("n"), "doc_id").limit(HOT_KEYS).select(F.col("doc_id").alias("__hot_id")), "hot_ids")
    same_id, is_hot = docs[id_col].eqNullSafe(F.col("__kept_id")), docs[id_col].eqNullSafe(F.col("__hot_id"))
    if repeated.isEmpty():
        return docs.join(chosen.hint("merge"), same_id, "left_semi")
    few = chosen.join(F.broadcast(hot), F.col("__kept_id").eqNullSafe(F.col("__hot_id")), "left_semi")
    rows = docs.join(F.broadcast(few), same_id, "left_semi").union(docs.join(F.broadcast(hot), is_hot, "left_anti").join(chosen.hint("merge"), same_id, "left_semi"))
    # Repeated ids: tell their rows apart by the fingerprint, then keep one.
    marked = materialize(rows.withColumn("__row_id", F.monotonically_increasing_id()), "repeated")
    again = fingerprints(marked.select("__row_id", text_col), "__row_id", text_col).withColumnsRenamed({"doc_id": "__row_id", "fp": "__fp"})
    told = marked.select("__row_id", id_col).join(again, "__row_id")
    told = told.join(chosen.hint("merge"), told[id_col].eqNullSafe(F.col("__kept_id")) & (F.col("__fp") == F.col("__kept_fp")), "left_semi")
    one = told.groupBy(id_col, "__fp").agg(F.min("__row_id").alias("__row_id")).select("__row_id")
    return marked.join(one, "__row_id", "left_semi").select(*docs.columns)
