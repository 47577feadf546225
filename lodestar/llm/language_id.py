"""Language identification by character models with Kneser-Ney smoothing.

A language's model is an interpolated Kneser-Ney model of the characters of
its words: runs of letters, lower-cased, between two edge marks. A character's
context is what precedes it in its word, up to ORDER - 1 characters, so a
word's log-probability is the same wherever it stands, and is computed once
for as long as a worker remembers the word. The language whose model has the
least cross-entropy in nats per character is predicted.

Counts are taken by Spark over every learning document: counts of the longest
grams are summed by key, and the continuation counts of shorter ones follow
from the distinct longer ones by grouping. All grams make the models. Of the
shorter lengths, as many as have at most MAX_GRAMS grams in all languages
together, they are in memory: two sorted arrays of 64-bit hashes, grams and
contexts, searched by bisection. What longer grams and contexts add to them is
a table. Joins with it give the log-probabilities of the characters, with
their contexts, that are learned from most often, which workers then hold; the
others of each text are sent to the same joins, and their sums added.

A score is a logistic function of the lead over the second best language,
fitted on words and texts of documents that a first model has not seen. A text
is accepted if its score and its cross-entropy are what those documents have.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm.common import attach, materialize, release
from lodestar.llm.quality_classifier import fit as fit_logistic

#: Characters of the longest gram.
ORDER = 5
#: Grams of all languages together that are in memory, at most; of longer grams so many log-probabilities are for each. The others are joined.
MAX_GRAMS, EACH = 1 << 18, 2
#: Grams that a worker sends to the joins at a time, about.
SENT = 1 << 16
#: Learning documents that the first model doesn't see, one in so many, and how many different ones calibrate at most.
ASIDE, MAX_CALIBRATION = 8, 2_000
#: Words of the spans that calibrate besides whole texts.
SPANS = (1, 2, 4, 8, 16)
#: Share of the calibrating texts whose cross-entropy acceptance allows, and the least score it allows.
QUANTILE, LEAST_SCORE = 0.999, 0.9
#: Characters that are held as words at a time; different words that a worker counts or remembers at most.
PIECE, REMEMBERED = 1 << 20, 300_000
#: What marks a word's ends; no letter.
EDGE = " "
UNDETERMINED = "und"

_WORDS = re.compile(r"[^\W\d_]+").findall
_BREAK = re.compile(r"[\W\d_]")
_SEED, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> Iterator[list[str]]:
    """The words of a text, in lists of about PIECE characters each; a text is cut where no word is."""
    text, start = text or "", 0
    while start < len(text):
        found = _BREAK.search(text, start + PIECE)
        stop = found.start() if found else len(text)
        if words := _WORDS(text[start:stop].lower()):
            yield words
        start = stop


def grams_of(words: dict[str, int]) -> Counter:
    """Counts of the longest grams of words with counts: a character and its whole context, or ORDER - 1 characters of it."""
    out: Counter = Counter()
    for word, n in words.items():
        padded = EDGE + word + EDGE
        for k in range(2, len(padded) + 1):
            out[padded[max(0, k - ORDER) : k]] += n
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, gram, n_first, n): counts of the longest grams in rows (lang, aside, text), without and with those set aside."""

    def sent(held: dict[tuple[str, bool], Counter]) -> pa.RecordBatch:
        rows = [(lang, gram, 0 if aside else n, n) for (lang, aside), words in held.items() for gram, n in grams_of(words).items()]
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["lang", "gram", "n_first", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, aside, text in zip(*batch.columns):
                counter = held[lang.as_py(), aside.as_py()]
                for words in words_of(text.as_py()):
                    counter.update(words)
                    if sum(map(len, held.values())) > REMEMBERED:
                        yield sent(held)
                        for other in held.values():
                            other.clear()
        yield sent(held)

    schema = "lang string, gram string, n_first long, n long"
    return docs.select("lang", "aside", "text").mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n_first").alias("n_first"), F.sum("n").alias("n"))


def adjusted_counts(counts: DataFrame) -> DataFrame:
    """Rows (lang, gram, n, total) for rows (lang, gram, n) of the longest grams.

    n is a longest gram's count, and of shorter grams the number of characters
    that occur before them; total is the sum of n over the grams of the same
    length that share all but the last character.
    """
    ends = F.transform(F.sequence(F.lit(1), F.char_length("gram")), lambda k: F.col("gram").substr(k, F.char_length("gram")))
    every = counts.select("lang", F.explode(ends).alias("gram")).distinct()
    shorter = every.where(F.char_length("gram") > 1).groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
    both = shorter.unionByName(counts.select("lang", "gram", "n"))
    # A gram's context has no more rows than the language has characters.
    context = F.expr("substring(gram, 1, char_length(gram) - 1)")
    totals = both.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"))
    return both.withColumn("context", context).join(totals, ["lang", "context"]).select("lang", "gram", "n", "total")


def extend(hashes: np.ndarray, characters: np.ndarray) -> np.ndarray:
    """Hashes of grams that are one character longer."""
    value = (hashes ^ characters.astype(np.uint64)) * _MIX
    return (value ^ (value >> np.uint64(31))) * _SEED


def find(sorted_hashes: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are there, by bisection, and the values of those."""
    if not len(sorted_hashes):
        return np.zeros(len(wanted), bool), np.zeros(0)
    at = np.searchsorted(sorted_hashes, wanted)
    at[at == len(sorted_hashes)] = 0
    found = sorted_hashes[at] == wanted
    return found, values[at[found]]


@dataclass
class Language:
    """A character model: log-probabilities of grams and log back-off weights of contexts, by sorted hashes.

    floor is the log-probability of a character that the language hasn't.
    """

    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_back: np.ndarray
    floor: float

    def log_probability(self, ending: list[np.ndarray], before: list[np.ndarray], depth: np.ndarray) -> np.ndarray:
        """Of each character in its context; ending[k] and before[k] are hashes of the k characters up to it and ahead of it, depth how many it may have ahead."""
        out, left = np.zeros(len(depth)), np.arange(len(depth))
        for k in range(min(ORDER, len(ending) - 1), 0, -1):
            # Only characters with so much ahead of them are looked up.
            fits = depth[left] >= k - 1
            asked, left = left[fits], left[~fits]
            found, value = find(self.grams, self.log_p, ending[k][asked])
            out[asked[found]] += value
            asked = asked[~found]
            if k > 1:
                known, weight = find(self.contexts, self.log_back, before[k - 1][asked])
                out[asked[known]] += weight
            left = np.concatenate((left, asked))
        out[left] += self.floor
        return out


def _hashes(codes: np.ndarray, longest: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the k characters that end at each place, and of the k that end before it."""
    ending = [np.full(len(codes), _SEED)]
    before = [ending[0]]
    for _ in range(longest):
        # What precedes the first place is never asked for.
        ending.append(extend(before[-1], codes))
        before.append(np.concatenate((_SEED[None], ending[-1][:-1])))
    return ending, before


def build(rows: pa.Table, alphabet: int, discounts: list[float]) -> Language:
    """The model of rows (gram, size, n, total) in order of sizes; discounts are by size, alphabet is the number of characters of all languages and one for others."""
    floor, empty = -math.log(alphabet), np.zeros(0, np.uint64)
    model = Language(empty, np.zeros(0), empty, np.zeros(0), floor)
    sizes, counts, totals = (rows[c].to_numpy().astype(np.float64) for c in ("size", "n", "total"))
    for size in range(1, ORDER + 1):
        start, stop = np.searchsorted(sizes, (size, size + 1))
        if start == stop:
            continue
        codes = _codes(rows["gram"].slice(start, stop - start)).reshape(-1, size)
        context, hashes = _fold(codes[:, :-1]), _fold(codes)
        share = np.maximum(counts[start:stop] - discounts[size], 0.0) / totals[start:stop]
        contexts, of = np.unique(context, return_inverse=True)
        back = np.maximum(1.0 - np.bincount(of, share), 1e-12)
        if size == 1:
            lower = np.full(len(codes), floor)
            model.floor = floor + math.log(back[0])
        else:
            # The last character after all but the first of its context, by the model of shorter grams.
            ending = [_fold(codes[:, size - k :]) for k in range(size)]
            before = [_fold(codes[:, size - 1 - k : size - 1]) for k in range(size - 1)]
            lower = model.log_probability(ending, before, np.full(len(codes), size - 2))
        log_p = np.log(share + back[of] * np.exp(lower))
        order = np.argsort(grams := np.concatenate((model.grams, hashes)))
        model.grams, model.log_p = grams[order], np.concatenate((model.log_p, log_p))[order]
        if size > 1:
            order = np.argsort(keys := np.concatenate((model.contexts, contexts)))
            model.contexts, model.log_back = keys[order], np.concatenate((model.log_back, np.log(back)))[order]
    return model


def _codes(grams: pa.ChunkedArray) -> np.ndarray:
    """The code points of all grams, one after another."""
    joined = pa.concat_arrays([c.cast(pa.large_string()) for c in grams.chunks])
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    return np.frombuffer(joined.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes().decode().encode("utf-32-le"), np.uint32)


def _fold(codes: np.ndarray) -> np.ndarray:
    """Hashes of grams given as rows of characters."""
    out = np.full(len(codes), _SEED)
    for k in range(codes.shape[1]):
        out = extend(out, codes[:, k])
    return out


@dataclass
class Models:
    """A model for each language, by name in order of code points.

    Memory holds the grams of up to depth characters. If there are longer
    ones, longer is their table, and often has rows of the log-probabilities
    of the most frequent grams, prices, by language.
    """

    names: list[str]
    models: list[Language]
    alphabet: int
    depth: int = ORDER
    longer: DataFrame | None = None
    often: dict[str, int] | None = None
    prices: list[np.ndarray] | None = None


def train(counts: DataFrame, max_grams: int = MAX_GRAMS) -> Models:
    """Models of rows (lang, gram, n); grams without a count don't take part.

    The driver gets the grams of at most max_grams in all, a row for each
    language and gram length, and EACH * max_grams log-probabilities at most;
    all other grams stay in a table.
    """
    counts = counts.where("n > 0")
    levels = materialize(adjusted_counts(counts), "levels")
    size = F.char_length("gram")
    stats = levels.groupBy("lang", size.alias("size")).agg(F.count("*").alias("many"), F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum((F.col("n") == 2).cast("long")).alias("twice")).toPandas()
    names = sorted(stats["lang"].unique())
    # Different characters: the grams of one.
    alphabet = 1 + levels.where(size == 1).select("gram").distinct().count()
    if not names:
        release(levels)
        return Models([], [], alphabet)
    depth = max((k for k in range(1, ORDER + 1) if stats.loc[stats["size"] <= k, "many"].sum() <= max_grams), default=0)
    discounts = {(r.lang, r.size): min(0.9, max(0.1, r.once / (r.once + 2 * r.twice))) if r.once and r.twice else 0.5 for r in stats.itertuples()}
    rows = levels.where(size <= depth).select("lang", "gram", size.alias("size"), "n", "total").orderBy("lang", "size", "gram").toArrow()
    # Of each language its stretch of rows.
    stretch = {r["lang"]: r["n_count"] for r in rows.group_by("lang").aggregate([("n", "count")]).to_pylist()}
    models, start = [], 0
    for name in names:
        many = stretch.get(name, 0)
        models.append(build(rows.slice(start, many), alphabet, [discounts.get((name, k), 0.5) for k in range(ORDER + 1)]))
        start += many
    made = Models(names, models, alphabet, depth)
    if depth < ORDER:
        made.longer = materialize(weights(levels.where(size > depth), names, discounts), "longer")
        found = priced(most(counts.groupBy("gram").agg(F.sum("n").alias("n")), EACH * max_grams // len(names)), made).select("gram", "log_p").toArrow()
        made.often = {gram: k for k, gram in enumerate(found["gram"].to_pylist())}
        values = found["log_p"].combine_chunks().flatten().to_numpy().reshape(-1, len(names))
        # The last row is that of other grams.
        made.prices = [np.append(values[:, k], 0.0) for k in range(len(names))]
    release(levels)
    return made


def most(counts: DataFrame, room: int) -> DataFrame:
    """Of rows (gram, n) those of at least a power of two, which are at most room."""
    tops = counts.agg(*(F.coalesce(F.sum((F.col("n") >= (1 << k)).cast("long")), F.lit(0)) for k in range(63))).first()
    return counts.where(F.col("n") >= (1 << next((k for k, top in enumerate(tops) if top <= room), 62)))


def weights(levels: DataFrame, names: list[str], discounts: dict[tuple[str, int], float]) -> DataFrame:
    """Rows (key, ahead, lang, value) of levels: a gram's share of its context, and, ahead of a character, a context's back-off weight; lang is a number."""
    spark, place = levels.sparkSession, {name: k for k, name in enumerate(names)}
    known = spark.createDataFrame([(name, int(size), place[name], d) for (name, size), d in discounts.items()], "name string, size int, place int, discount double")
    rows = levels.withColumnRenamed("lang", "name").withColumn("size", F.char_length("gram")).join(F.broadcast(known), ["name", "size"])
    shares = rows.select(F.col("gram").alias("key"), F.lit(False).alias("ahead"), F.col("place").alias("lang"), ((F.col("n") - F.col("discount")) / F.col("total")).alias("value"))
    # Each gram of a context leaves it one discount.
    contexts = rows.groupBy(F.expr("substring(gram, 1, size - 1)").alias("key"), F.lit(True).alias("ahead"), F.col("place").alias("lang"))
    return shares.unionByName(contexts.agg((F.first("discount") * F.count("*") / F.first("total")).alias("value")))


def priced(grams: DataFrame, models: Models) -> DataFrame:
    """Rows (gram, n) with log_p: of the last character after the others, by all languages."""
    spark, depth = grams.sparkSession, models.depth
    sent = spark.sparkContext.broadcast(models.models)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_pylist()
            sizes, out = np.array([len(g) for g in some]), np.zeros((len(some), len(sent.value)))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                codes = np.frombuffer("".join(some[k] for k in at).encode("utf-32-le"), np.uint32).reshape(-1, size)
                ending = [_fold(codes[:, size - k :]) for k in range(size + 1)]
                before = [_fold(codes[:, size - 1 - k : size - 1]) for k in range(size)]
                for k, model in enumerate(sent.value):
                    out[at, k] = np.exp(model.log_probability(ending, before, np.full(len(at), size - 1)))
            offsets = np.arange(len(some) + 1, dtype=np.int32) * out.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))], ["gram", "n", "p"])

    grams = grams.select("gram", "n")
    short = grams.mapInArrow(run, "gram string, n long, p array<double>").select("gram", "n", F.posexplode("p").alias("lang", "p"))
    size = F.char_length("gram")
    ends = grams.where(size > depth).select("gram", F.explode(F.sequence(F.lit(depth + 1), size)).alias("k"))
    ends = ends.select("gram", "k", F.col("gram").substr(size - F.col("k") + 1, F.col("k")).alias("end"))
    asked = ends.select("gram", "k", F.explode(F.array(F.struct(F.col("end").alias("key"), F.lit(False).alias("ahead")), F.struct(F.expr("substring(end, 1, k - 1)").alias("key"), F.lit(True).alias("ahead")))).alias("one"))
    found = asked.select("gram", "k", "one.key", "one.ahead").join(models.longer, ["key", "ahead"]).select("gram", "k", "ahead", "lang", "value")
    both = short.unionByName(found, allowMissingColumns=True).repartition("gram")
    longer = range(depth + 1, ORDER + 1)
    of = lambda k, ahead: F.max(F.when((F.col("k") == k) & (F.col("ahead") == ahead), F.col("value")))
    rows = both.groupBy("gram", "lang").agg(F.max("n").alias("n"), F.max("p").alias("p"), *(of(k, ahead).alias(f"{name}{k}") for k in longer for ahead, name in ((False, "share"), (True, "back"))))
    p = F.col("p")
    for k in longer:
        p = F.coalesce(f"share{k}", F.lit(0.0)) + F.coalesce(f"back{k}", F.lit(1.0)) * p
    by_lang = F.sort_array(F.collect_list(F.struct("lang", F.log(p).alias("log_p"))))
    return rows.groupBy("gram").agg(F.max("n").alias("n"), by_lang.getField("log_p").alias("log_p"))


class _Numbers(dict):
    """Words by number, which new ones get in order; new holds those that have no row yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Scorer:
    """Log-probabilities of texts by all languages, with the words that it remembers."""

    def __init__(self, models: Models) -> None:
        self.models = models.models
        self.often, self.prices = models.often, models.prices
        self.known = _Numbers()
        self.values, self.lacks = np.zeros((1024, len(self.models))), np.zeros(1024, bool)
        self.lacking: dict[int, list[str]] = {}

    def words(self, words: list[str]) -> np.ndarray:
        """A row of log-probabilities for each word."""
        padded = [EDGE + w + EDGE for w in words]
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(w) for w in padded], np.int64)
        starts = np.cumsum(sizes) - sizes
        depth = np.arange(len(codes)) - np.repeat(starts, sizes)
        ending, before = _hashes(codes, ORDER)
        asked = np.flatnonzero(depth > 0)
        ending, before, depth = [h[asked] for h in ending], [h[asked] for h in before], depth[asked]
        starts = starts - np.arange(len(starts))
        return np.stack([np.add.reduceat(m.log_probability(ending, before, depth), starts) for m in self.models], 1)

    def often_words(self, words: list[str]) -> tuple[np.ndarray, dict[int, list[str]]]:
        """A row for each word, of its frequent grams, and by place the others of words that have such."""
        padded = [EDGE + w + EDGE for w in words]
        grams = [w[max(0, k - ORDER) : k] for w in padded for k in range(2, len(w) + 1)]
        at = np.fromiter(map(self.often.get, grams, repeat(-1)), np.int64, len(grams))
        sizes = np.array([len(w) - 1 for w in padded], np.int64)
        starts = np.cumsum(sizes) - sizes
        lacking = np.flatnonzero(at < 0)
        others: dict[int, list[str]] = defaultdict(list)
        for k, word in zip(lacking.tolist(), (np.searchsorted(starts, lacking, "right") - 1).tolist()):
            others[word].append(grams[k])
        return np.stack([np.add.reduceat(p[at], starts) for p in self.prices], 1), others

    def numbers(self, words: Iterable[str]) -> np.ndarray:
        """Numbers of words, of which new ones are scored together."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.lacking.clear()
        scored = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64)
        if new := self.known.new:
            if (more := len(self.known) - len(self.values)) > 0:
                self.values = np.concatenate((self.values, np.zeros((more, len(self.models)))))
                self.lacks = np.concatenate((self.lacks, np.zeros(more, bool)))
            rows, others = (self.words(new), {}) if self.often is None else self.often_words(new)
            self.values[scored : scored + len(new)] = rows
            self.lacks[scored : scored + len(new)] = False
            for k, grams in others.items():
                self.lacks[scored + k] = True
                self.lacking[scored + k] = grams
            new.clear()
        return at

    def texts(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, int]]:
        """For each text its log-probabilities and how many characters they are of, edges included."""
        for found, chars, _ in self.parts(texts):
            yield found, chars

    def parts(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, int, dict[str, int]]]:
        """For each text also the grams that its log-probabilities lack, with counts."""
        held: list[tuple[int, list[str]]] = []
        sums: dict[int, np.ndarray] = {}
        others: dict[int, Counter] = defaultdict(Counter)
        chars: list[int] = []
        room = told = 0

        def settle() -> None:
            if held:
                at = self.numbers(chain.from_iterable(some for _, some in held))
                starts = np.cumsum([0, *(len(some) for _, some in held[:-1])])
                for (k, _), row in zip(held, np.add.reduceat(self.values[at], starts, axis=0)):
                    sums[k] = sums[k] + row if k in sums else row
                lacking = np.flatnonzero(self.lacks[at])
                for word, place in zip(at[lacking].tolist(), (np.searchsorted(starts, lacking, "right") - 1).tolist()):
                    others[held[place][0]].update(self.lacking[word])
            held.clear()

        for k, text in enumerate(texts):
            chars.append(0)
            for words in words_of(text):
                n = sum(map(len, words)) + len(words)
                chars[k] += n
                held.append((k, words))
                room += n
                if room > PIECE:
                    settle()
                    room = 0
            if not held:
                for j in range(told, k + 1):
                    yield sums.pop(j, None), chars[j], others.pop(j, {})
                told = k + 1
        settle()
        for j in range(told, len(chars)):
            yield sums.pop(j, None), chars[j], others.pop(j, {})


def scored(docs: DataFrame, models: Models) -> DataFrame:
    """Rows of docs with chars and log_p, by all languages, in place of text; log_p is null where no letter is."""
    sent = docs.sparkSession.sparkContext.broadcast(replace(models, longer=None))
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "row long, chars long, log_p array<double>, others array<struct<gram: string, n: bigint>>"])
    kinds = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.struct([("gram", pa.string()), ("n", pa.int64())])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)

        def made(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [*names, "row", "chars", "log_p", "others"])

        for batch in batches:
            rows, start, load = [], 0, 0
            texts = (t.as_py() for t in batch.column(len(names) + 1)) if sent.value.names else repeat(None, len(batch))
            for log_p, chars, others in scorer.parts(texts):
                rows.append((chars, log_p.tolist() if chars else None, [{"gram": g, "n": n} for g, n in others.items()]))
                load += len(others)
                if load > SENT:
                    yield made(batch.slice(start, len(rows)), rows)
                    rows, start, load = [], start + len(rows), 0
            if rows:
                yield made(batch.slice(start, len(rows)), rows)

    rows = docs.select(*names, F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, schema)
    if models.longer is None:
        return rows.select(*names, "chars", "log_p")
    rows = materialize(rows, "scored")
    others = rows.select("row", F.explode("others").alias("one")).select("row", "one.gram", F.col("one.n").alias("times"))
    seen = materialize(others.groupBy("gram").agg(F.count("*").alias("n")), "seen")
    prices = materialize(priced(seen, models), "prices")
    release(seen)
    # Sums of decimals don't depend on their order.
    each = attach(others, prices, "gram", "n").select("row", F.col("times").cast("decimal(12,0)").alias("times"), F.posexplode("log_p").alias("lang", "value"))
    sums = each.groupBy("row", "lang").agg(F.sum(F.col("value").cast("decimal(20,15)") * F.col("times")).cast("double").alias("sum"))
    sums = sums.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("lang", "sum"))).getField("sum").alias("sums"))
    log_p = F.when(F.col("sums").isNull(), F.col("log_p")).otherwise(F.zip_with("log_p", "sums", lambda a, b: a + b))
    return rows.join(sums, "row", "left").select(*names, "chars", log_p.alias("log_p"))


@dataclass
class Calibration:
    """How a lead makes a score, and which cross-entropies a language has: its mean, and variances between texts and of one character."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    entropy: dict[str, tuple[float, float, float]]
    widest: float

    def score(self, lead: float, chars: int) -> float:
        terms = sum(w * (x - m) / s for x, m, s, w in zip(evidence(lead, chars), self.mean, self.scale, self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + terms))))

    def usual(self, name: str, entropy: float, chars: int) -> bool:
        """Whether the language has texts of such a cross-entropy; one without calibrating texts has."""
        mean, between, within = self.entropy.get(name, (math.inf, 0.0, 1.0))
        return entropy <= mean + self.widest * math.sqrt(between + within / chars)


def evidence(lead: float, chars: int) -> tuple[float, float, float]:
    """What scores are a function of: the lead in all characters and in one, and how many they are."""
    return math.log1p(lead * chars), lead, math.log(chars)


def best(log_p: np.ndarray, chars: int, alphabet: int) -> tuple[int, float, float]:
    """The language of the least cross-entropy (of equal ones the first), that cross-entropy, and its lead; a single language leads over all characters alike."""
    entropy = -log_p / chars
    k = int(np.argmin(entropy))
    rest = np.delete(entropy, k)
    return k, float(entropy[k]), max(0.0, float((rest.min() if len(rest) else math.log(alphabet)) - entropy[k]))


def calibrate(docs: DataFrame, models: Models) -> Calibration:
    """Fit scores on rows (lang, aside, text): different texts set aside, the MAX_CALIBRATION of least hash, and a span of each length of theirs."""
    aside = docs.where("aside").withColumn("place", F.xxhash64("text"))
    last = aside.select("place").distinct().orderBy("place").limit(MAX_CALIBRATION).agg(F.max("place")).first()[0]
    names, alphabet = models.names, models.alphabet

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in names:
                    continue
                words = [w for some in words_of(text) for w in some]
                draw = random.Random(zlib.crc32(text.encode()))
                spans = [words, *(words[(k := draw.randrange(len(words) - n + 1)) : k + n] for n in SPANS if n < len(words))]
                rows += [(lang, k == 0, " ".join(span)) for k, span in enumerate(spans)]
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.string()))], ["lang", "whole", "text"])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, whole, chars, log_p in zip(*(c.to_pylist() for c in batch.columns)):
                if chars:
                    pick, entropy, lead = best(np.array(log_p), chars, alphabet)
                    rows.append((lang, names[pick] == lang, whole, entropy, lead, chars))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["lang", "right", "whole", "entropy", "lead", "chars"])

    found: list = []
    if last is not None and models.names:
        different = aside.where(F.col("place") <= last).groupBy("place").agg(F.min(F.struct("lang", "text")).alias("row")).select("row.lang", "row.text")
        spans = different.mapInArrow(cut, "lang string, whole boolean, text string")
        found = scored(spans, models).mapInArrow(judge, "lang string, right boolean, whole boolean, entropy double, lead double, chars long").collect()
    found.sort(key=tuple)
    # Without a lead a prediction may as well be wrong.
    x = np.array([evidence(r.lead, r.chars) for r in found] + [evidence(0.0, 1)] * 2)
    logistic = fit_logistic(x, np.array([float(r.right) for r in found] + [0.0, 1.0]))
    entropy, far = {}, [0.0]
    for name in models.names:
        rows = [r for r in found if r.lang == name and r.right]
        texts = [r.entropy for r in rows if r.whole]
        if len(texts) > 1:
            mean, between = float(np.mean(texts)), float(np.var(texts))
            within = max(float(np.mean([max(0.0, (r.entropy - mean) ** 2 - between) * r.chars for r in rows])), 1e-6)
            entropy[name] = (mean, between, within)
            far += [(r.entropy - mean) / math.sqrt(between + within / r.chars) for r in rows]
    return Calibration(logistic.mean, logistic.scale, logistic.weights, logistic.intercept, entropy, float(np.quantile(far, QUANTILE)))


def held_out(id_col: str) -> Column:
    """Whether a row is never learned from: the CRC-32 of its id as text leaves 2 when divided by 4. A null id is no text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 4 == 2


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_grams: int = MAX_GRAMS) -> tuple[Models, Calibration]:
    """Models of all documents that aren't held out and have a language, and their calibration; max_grams bounds memory, not the models."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    some = docs.where(~held_out(id_col) & F.col(f"`{lang_col}`").isNotNull())
    # Copies of a text are on the same side.
    rows = some.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), text.alias("text"), (F.pmod(F.xxhash64(text), F.lit(ASIDE)) == 0).alias("aside"))
    counts = materialize(gram_counts(rows), "grams")
    first = train(counts.select("lang", "gram", F.col("n_first").alias("n")), max_grams)
    calibration = calibrate(rows, first)
    if first.longer is not None:
        release(first.longer)
    models = train(counts.select("lang", "gram", "n"), max_grams)
    release(counts)
    return models, calibration


def identify(docs: DataFrame, models: Models, calibration: Calibration, id_col: str = "doc_id", text_col: str = "text", reject: bool = True) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score, cross_entropy (double), accepted (boolean).

    lang_pred is the language of the least cross-entropy; UNDETERMINED, with
    score 0, if the text is null or has no letter, or nothing was learned.
    Texts that aren't accepted are UNDETERMINED as well, unless reject is
    false; they keep their score. Texts are read whole; repeated rows each
    give a row; other columns are ignored.
    """
    names, alphabet = models.names, models.alphabet

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for chars, log_p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if not chars or not names:
                    rows.append((UNDETERMINED, 0.0, None, False))
                    continue
                k, entropy, lead = best(np.array(log_p), chars, alphabet)
                score = calibration.score(lead, chars)
                accepted = score >= LEAST_SCORE and calibration.usual(names[k], entropy, chars)
                rows.append((names[k] if accepted or not reject else UNDETERMINED, score, entropy, accepted))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return scored(rows, models).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, accepted boolean")
