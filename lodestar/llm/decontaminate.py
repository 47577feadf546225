"""Benchmark decontamination by edit distance.

A document is contaminated by an item if some run of its words is within
floor(MAX_EDITS * n) word edits of the item's n words. Both texts are
lower-cased and punctuation separates words.

Method: texts are embedded by CGK random walks, which map edit distance to
Hamming distance: at each step a walk emits the word under its pointer, and a
random bit of (step, word) moves the pointer or not. Bit-sampling LSH takes
SAMPLED steps of a walk as a key. WALKS independent walks start at every word of
a document; an item has keys(n) keys, of walks from anchors spread over all its
words, so wherever the edits are, some walks run through words without any. A
common key proposes the item-sized window that the anchor tells. How many keys
an item has costs a document nothing, and a walk's key covers three to four
words, so the cost depends little on the number of items.

Windows are verified: at least n - k of their words must be the item's, which k
edits can't undercut, and the exact edit distance of the item to any run of
words near the window must be within the limit.

Items are taken in blocks of bounded size, one after another: each is one pass
over the documents with the block's keys sent to the executors, and its keys
are given up before the next. Within a pass documents stay where they are:
nothing is shuffled but the resulting pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.common import bounded, materialize, scratch

#: Word edits per word of the item: similarity of 0.8 or more.
MAX_EDITS = 0.2
#: Walks from a word, steps of a walk at most, and steps of it in a key.
WALKS, REACH, SAMPLED = 8, 8, 6
#: Keys of an item, and words of an item for one key more.
KEYS, WORDS_A_KEY = 48, 4
#: Items and characters of a block.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
#: Words whose walks are taken at once, and words of windows compared at once; both bound memory.
STARTS, COMPARED = 1 << 18, 1 << 22
SEED = 20_250_101

#: Everything in ASCII but letters and digits separates words.
_WORD_CHARS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased, in UTF-8."""
    return (text or "").lower().encode().translate(_WORD_CHARS).split()


def limit(n: int) -> int:
    """Edits allowed for an item of n words."""
    return int(MAX_EDITS * n + 1e-9)


def best_match(item: list[int], words: list[int]) -> tuple[int, int]:
    """(edits, end): the least edit distance of item to any run of words, and the end of the first such run.

    Myers' bit-parallel algorithm; one step a word, however long the item.
    """
    m = len(item)
    where: dict[int, int] = {}
    for k, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << k
    full, high = (1 << m) - 1, 1 << m - 1
    vp, vn, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(words):
        eq = where.get(w, 0)
        d = ((eq & vp) + vp ^ vp) | eq | vn
        hp, hn = vn | ~(d | vp) & full, vp & d
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp, hn = hp << 1 & full, hn << 1 & full
        vp, vn = hn | ~(d | hp) & full, hp & d
        if score < best:
            best, end = score, j + 1
    return best, end


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(n: int) -> int:
    """Keys of an item of n words; the tests measure the recall at the edit limit."""
    return min(n * WALKS, KEYS + n // WORDS_A_KEY)


def least_moves(n: int) -> int:
    """Moves that a walk makes at least for a key of an item of n words that may be edited.

    A key of few words is common in any text. Evenly spread edits at the limit
    leave runs of at least one word more than this.
    """
    return 1 + (n >= 8) + (n >= 20)


def sampled_steps(reach: int) -> np.ndarray:
    """Steps (WALKS, SAMPLED at most) of walks of so many steps that make up the keys, in rising order.

    One step is drawn from each of SAMPLED equal parts of a walk.
    """
    edges = np.unique(np.arange(SAMPLED + 1) * reach // SAMPLED)
    return np.random.default_rng([SEED, reach]).integers(edges[:-1], edges[1:], (WALKS, len(edges) - 1))


@dataclass
class Block:
    """Items of a block with what the executors need of them."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    items: list[list[int]] = field(default_factory=list)
    ids: list[list[int]] = field(default_factory=list)
    reaches: list[int] = field(default_factory=list)
    moves: np.ndarray | None = None  # 8 random bits of each walk and word
    codes: np.ndarray | None = None  # a random number of each sampled step and word
    keys: np.ndarray | None = None  # in rising order, with the items and anchors that they are of
    owners: np.ndarray | None = None
    anchors: np.ndarray | None = None
    slots: np.ndarray | None = None  # which leading bits a key has
    members: np.ndarray | None = None  # which hashes a pair of item and word has

    def walk(self, words: np.ndarray, starts: np.ndarray, reach: int, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of walk r from each start, and the words where the walks end."""
        wanted, pointer = sampled_steps(reach)[r].tolist(), starts.copy()
        key = np.full(len(starts), _mix(np.array([reach * WALKS + r], np.uint64))[0])
        for j in range(wanted[-1] + 1):
            symbol = words[pointer]
            if j in wanted:
                key += self.codes[wanted.index(j)][symbol]
            if j < wanted[-1]:
                pointer += self.moves[r][symbol] >> j & 1
        return key, pointer


def _table(entries: int) -> np.ndarray:
    """An empty table of 16 slots or more for each entry; their number is a power of two."""
    return np.zeros(1 << max(16, (16 * entries).bit_length()), bool)


def _leading(key: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(65 - len(table).bit_length())).view(np.int64)


def _member(item: np.ndarray, word: np.ndarray, table: np.ndarray) -> np.ndarray:
    return _leading((item.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15), table)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each first on, so many as its size says, one range after another."""
    return np.repeat(first - (sizes.cumsum() - sizes), sizes) + np.arange(sizes.sum())


def build(items: list[tuple[int, str | None]]) -> Block:
    """The block of some items (item_id, text); equal items are searched once, those without words match nothing."""
    block, known = Block(), {}
    for item_id, text in items:
        ids = [block.vocabulary.setdefault(w, len(block.vocabulary) + 1) for w in words_of(text)]
        if ids:
            at = known.setdefault(tuple(ids), len(block.items))
            if at == len(block.items):
                block.items.append(ids)
                block.ids.append([])
            block.ids[at].append(item_id)
    symbols = np.arange(len(block.vocabulary) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    block.moves = np.stack([_mix(symbols + np.uint64(2 * r + 1)).astype(np.uint8) for r in range(WALKS)])
    block.codes = np.stack([_mix(symbols ^ np.uint64((s + 1) << 48)) for s in range(SAMPLED)])
    sizes = np.array([len(i) for i in block.items], np.int64)
    begins = (sizes + REACH).cumsum() - sizes - REACH
    words = np.zeros(int((sizes + REACH).sum()), np.int32)
    words[_ranges(begins, sizes)] = np.array([w for i in block.items for w in i], np.int32)
    block.members = _table(int(sizes.sum()))
    block.members[_member(np.repeat(np.arange(len(sizes)), sizes), words[_ranges(begins, sizes)], block.members)] = True
    block.reaches = sorted(set(np.minimum(sizes, REACH).tolist()))
    found = [_item_keys(block, words, np.flatnonzero(np.minimum(sizes, REACH) == reach), begins, sizes, reach) for reach in block.reaches]
    block.keys, block.owners, block.anchors = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, t) for t in (np.uint64, np.int32, np.int32))
    order = np.argsort(block.keys, kind="stable")
    block.keys, block.owners, block.anchors = block.keys[order], block.owners[order], block.anchors[order]
    block.slots = _table(len(order))
    block.slots[_leading(block.keys, block.slots)] = True
    return block


def _item_keys(block: Block, words: np.ndarray, mine: np.ndarray, begins: np.ndarray, sizes: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """Keys, items and anchors of items whose walks have this reach.

    Of all pairs of an anchor and a walk, keys(n) evenly spread ones count, if
    the walk stays in the item and makes least_moves(n). Items that have to occur unchanged need one
    key, that of the walk which gets furthest.
    """
    owner = np.repeat(mine, sizes[mine])
    anchor = _ranges(np.zeros(len(mine), np.int64), sizes[mine])
    n = sizes[owner]
    wanted, edits, least = (np.array([f(m) for m in range(int(sizes.max()) + 1)])[n] for f in (keys, limit, least_moves))
    out, furthest, best = [], np.full(len(owner), -1), np.zeros(len(owner), np.uint64)
    for r in range(WALKS):
        key, end = block.walk(words, begins[owner] + anchor, reach, r)
        moved = end - begins[owner] - anchor
        cell = anchor * WALKS + (r + 3 * anchor) % WALKS
        chosen = ((cell + 1) * wanted // (n * WALKS) > cell * wanted // (n * WALKS)) & (anchor + moved < n) & (moved >= least) & (edits > 0)
        out.append((key[chosen], owner[chosen], anchor[chosen]))
        further = (edits == 0) & (anchor == 0) & (moved > furthest)
        furthest[further], best[further] = moved[further], key[further]
    whole = furthest >= 0
    out.append((best[whole], owner[whole], anchor[whole]))
    key, owner, anchor = (np.concatenate(c) for c in zip(*out))
    return key, owner.astype(np.int32), anchor.astype(np.int32)


def search(block: Block, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
    """(text's position, item's position, edits, end word) of each contaminated pair."""
    get, parts, zeros = block.vocabulary.get, [], np.zeros(REACH, np.int32)
    for text in texts:
        words = words_of(text)
        parts += (np.fromiter(map(get, words, repeat(0)), np.int32, len(words)), zeros)
    if not parts or not block.items:
        return []
    flat = np.concatenate(parts)
    spans = np.array([len(p) + REACH for p in parts[::2]], np.int64)
    ends = spans.cumsum() - REACH
    begins = ends + REACH - spans
    sizes = np.array([len(i) for i in block.items], np.int64)
    edits = np.array([limit(int(n)) for n in sizes], np.int64)
    known, windows = np.flatnonzero(flat), []
    for at in range(0, len(known), STARTS):
        starts = known[at : at + STARTS]
        text = np.searchsorted(ends, starts, "right")
        proposed = [_propose(block, flat, starts, text, reach, r) for reach in block.reaches for r in range(WALKS)]
        text, item, start = (np.concatenate(c) for c in zip(*proposed))
        order = np.lexsort((start, item, text))
        text, item, start = text[order], item[order], start[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1])
        text, item, start = text[new], item[new], start[new]
        n, k = sizes[item], edits[item]
        low, high = np.maximum(begins[text], start - 2 * k - 1), np.minimum(ends[text], start + n + 2 * k + 1)
        held = _held(block, flat, item, low, high) >= n - k
        windows += zip(text[held].tolist(), item[held].tolist(), low[held].tolist(), high[held].tolist())
    by_pair: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for text, item, low, high in windows:
        by_pair.setdefault((text, item), []).append((low, high))
    out = []
    for (text, item), near in sorted(by_pair.items()):
        found = _verify(block.items[item], flat, int(begins[text]), sorted(near))
        if found:
            out.append((text, item, *found))
    return out


def _propose(block: Block, flat: np.ndarray, starts: np.ndarray, text: np.ndarray, reach: int, r: int) -> tuple[np.ndarray, ...]:
    """Texts, items and window starts where walk r of a text has a key of an item."""
    key, _ = block.walk(flat, starts, reach, r)
    some = np.flatnonzero(block.slots[_leading(key, block.slots)])
    low, high = np.searchsorted(block.keys, key[some], "left"), np.searchsorted(block.keys, key[some], "right")
    place = _ranges(low, high - low)
    hit = np.repeat(some, high - low)
    return text[hit], block.owners[place], starts[hit] - block.anchors[place]


def _held(block: Block, flat: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many words of each window (low to high) are the item's, at least; a few may be counted too many."""
    out, sizes = np.zeros(len(item), np.int64), np.maximum(high - low, 0)
    stops = sizes.cumsum()
    at = 0
    while at < len(item):
        stop = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + COMPARED, "right")))
        words = flat[_ranges(low[at:stop], sizes[at:stop])]
        owner = np.repeat(np.arange(at, stop), sizes[at:stop])
        same = block.members[_member(item[owner], words, block.members)] & (words > 0)
        out[at:stop] = np.bincount(owner[same] - at, minlength=stop - at)
        at = stop
    return out


def _verify(item: list[int], flat: np.ndarray, begin: int, windows: list[tuple[int, int]]) -> tuple[int, int] | None:
    """Least edits and end (in words of the text that begins there) in the windows, in rising order, if within the limit."""
    k, best, spans = limit(len(item)), None, [list(windows[0])]
    for low, high in windows[1:]:
        if low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    for low, high in spans:
        edits, stop = best_match(item, flat[low:high].tolist())
        if edits <= k and (best is None or edits < best[0]):
            best = edits, low - begin + stop
    return best


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of bounded size, in order of their id; one block at a time is on the driver."""
    block, chars = [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(row.text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((row.item_id, row.text))
        chars += len(row.text)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row (doc_id, item_id, edits, n_item_words, end_word) per document row and item that it contains.

    edits is the least edit distance found, end_word the end of that run in
    words of the document. Null and empty texts and items contain and match
    nothing; repeated rows of either side each give their pairs; items that
    share an id are searched one by one. An item of fewer than 1 / MAX_EDITS
    words has to occur unchanged. Other columns are ignored.
    """
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "pairs")
    schema = "doc_id long, item_id long, edits int, n_item_words int, end_word long"
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    spark.createDataFrame([], schema).write.parquet(path)
    for items in blocks(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(build(items))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                at = 0
                while at < len(ids):
                    some, size = [], 0
                    while at + len(some) < len(ids) and (not some or size < 1 << 22):
                        some.append(texts[at + len(some)].as_py())
                        size += len(some[-1])
                    rows = [(ids[at + t], i, e, len(block.items[k]), end) for t, k, e, end in search(block, some) for i in block.ids[k]]
                    at += len(some)
                    if rows:
                        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in schema.split(", ")])

        narrow.mapInArrow(run, schema).write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(schema).parquet(path)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that contain no item; columns stay as they are.

    Every document with a contaminated document's id goes, a null id included.
    """
    hits = contaminated(docs, benchmark, id_col, text_col, item_col, item_text_col)
    out = bounded(materialize(hits.select(F.col("doc_id").alias("__out_id")).distinct(), "contaminated"))
    return docs.join(out, docs[id_col].cast("long").eqNullSafe(F.col("__out_id")), "left_anti")
