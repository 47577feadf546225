"""Document quality by hierarchical empirical Bayes.

A logistic classifier gives each document evidence from its own text. Sites
add theirs: a document's quality is its label, if it has one, and the
classifier's probability otherwise. The mean quality of a host is shrunk toward
the global mean, and that of a path toward its host, the more so the fewer
documents they have. How strongly is estimated from the variance between and
within groups, by grouped sums. A document's log odds are those of its
classifier with the base rate replaced by the posterior that its path has by
all other documents: its own quality is taken out of every sum, so its text
counts once and its own label not at all.

The classifier is fitted on the driver on a bounded sample of labelled rows
(MAX_SAMPLE, chosen by hash). Everything else covers all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm.common import attach, bounded, materialize, release
from lodestar.llm.line_quality import SEPARATORS, SYMBOLS, repeated_words

#: Labelled rows that the classifier is fitted on, at most.
MAX_SAMPLE = 20_000
#: Ridge penalty of the fit, and the widest log odds of a group.
PENALTY, WIDEST = 1.0, 8.0
FEATURES = ("symbols", "separators", "capitals", "echoes", "repeats", "variety", "word_length", "length", "marks", "shouts", "digits")

_SEPARATORS = frozenset(s.encode() for s in SEPARATORS)
_DIGITS = b"0123456789"


def features(text: str | None) -> list[float]:
    """Shares and logarithms that describe a whole text; zeros for a text without words."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    return [
        sum(data.count(s.encode()) for s in SYMBOLS) / chars,
        sum(map(_SEPARATORS.__contains__, words)) / n,
        sum(map(bytes.isupper, words)) / n,
        sum(map(eq, words, words[1:])) / n,
        repeated_words(words) / n,
        math.log1p(len(set(words))) / math.log1p(n),
        math.log(chars / n),
        math.log1p(n) / 10,
        min(1.0, sum(map(data.count, (b".", b",", b"?", b"!"))) / n),
        data.count(b"!!") / n,
        sum(data.count(d.to_bytes()) for d in _DIGITS) / chars,
    ]


@dataclass(frozen=True)
class Classifier:
    """Weights over standardized features; base is the log odds of the fitted labels."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    base: float

    def logit(self) -> Column:
        terms = [(F.col(n) - m) / s * w for n, m, s, w in zip(FEATURES, self.mean, self.scale, self.weights)]
        return F.lit(self.intercept) + sum(terms[1:], terms[0])


def fit(rows: np.ndarray, labels: np.ndarray) -> Classifier:
    """Logistic regression by Newton steps; without both classes, one without evidence."""
    k = rows.shape[1]
    if not len(labels) or labels.min() == labels.max():
        return Classifier((0.0,) * k, (1.0,) * k, (0.0,) * k, 0.0, 0.0)
    mean, scale = rows.mean(0), rows.std(0)
    scale[scale < 1e-9] = 1.0
    x = np.column_stack(((rows - mean) / scale, np.ones(len(rows))))
    w, ridge = np.zeros(k + 1), np.diag([PENALTY] * k + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    rate = labels.mean()
    return Classifier(tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w[:-1])), float(w[-1]), float(np.log(rate / (1 - rate))))


def row_key(*columns: str) -> Column:
    """A hash that tells apart rows which share an id."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """Rows (doc_id, row_key, host, path, features), one pass over the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([features(t.as_py()) for t in batch.column(4)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array(found[:, k]) for k in range(len(FEATURES))]], ["doc_id", "row_key", "host", "path", *FEATURES])

    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        row_key(id_col, text_col, host_col, path_col).alias("row_key"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("\0")).alias("host"),
        F.coalesce(F.col(path_col).cast("string"), F.lit("\0")).alias("path"),
        F.col(text_col).cast("string").alias("text"),
    )
    return narrow.mapInArrow(run, "doc_id long, row_key long, host string, path string, " + ", ".join(f"{n} double" for n in FEATURES))


def _bound(p: Column) -> Column:
    low = 1 / (1 + math.exp(WIDEST))
    return F.greatest(F.lit(low), F.least(F.lit(1 - low), p))


def _log_odds(p: Column) -> Column:
    return F.ln(_bound(p) / (1 - _bound(p)))


def _strength(n: float, square: float, groups: float, squares_between: float, squares: float) -> float:
    """Documents that a group's parent weighs as much as, by the moments of a one-way layout.

    n: all documents; square: sum of squared group sizes over n; groups: their
    number; squares_between, squares: sums of squares between and in total.
    """
    if groups < 2 or n <= groups:
        return 1e12
    within = max(squares - squares_between, 0.0) / (n - groups)
    between = (squares_between / (groups - 1) - within) / ((n - square) / (groups - 1))
    return 1e12 if between <= 1e-12 else max(within, 1e-6) / between


@dataclass(frozen=True)
class Levels:
    """The top of the hierarchy: all documents, their summed quality, and what hosts and paths are shrunk by."""

    n: float
    s: float
    of_host: float
    of_path: float

    def prior(self, own: Column | float = 0.0, one: int = 1) -> Column:
        """Posterior quality of a path (columns n, s, hn, hs) without a document of this quality; of all with one = 0."""
        rest = self.n - one
        mean = (F.lit(self.s) - own) / rest if rest > 0 else F.lit(0.5)
        of_host = (F.col("hs") - own + self.of_host * mean) / (F.col("hn") - one + self.of_host)
        return (F.col("s") - own + self.of_path * of_host) / (F.col("n") - one + self.of_path)


def sites(valued: DataFrame) -> tuple[DataFrame, Levels]:
    """Rows (site, host, path, n, s, hn, hs) per path with counts and sums of its own and its host's, for rows (host, path, value)."""
    paths = materialize(valued.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")), "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "hosts")
    total = paths.agg(F.sum("n"), F.sum("s"), F.sum("q"), F.count("*"), F.sum(F.col("s") * F.col("s") / F.col("n")), F.sum(F.col("n") * F.col("n").cast("double"))).first()
    by_host = hosts.agg(F.count("*"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")), F.sum(F.col("hn") * F.col("hn").cast("double"))).first()
    n, s, q, n_paths, path_squares, path_sizes = (float(x or 0) for x in total)
    n_hosts, host_squares, host_sizes = (float(x or 0) for x in by_host)
    squares = s * s / n if n else 0.0
    of_host = _strength(n, host_sizes / n if n else 0, n_hosts, host_squares - squares, q - squares)
    of_path = _strength(n, path_sizes / n if n else 0, n_paths - n_hosts + 1, path_squares - host_squares, q - host_squares)
    joined = attach(paths, hosts, "host", "hn").withColumn("site", _site())
    out = materialize(joined.select("site", "host", "path", "n", "s", "hn", "hs"), "sites")
    release(paths, hosts)
    return out, Levels(n, s, of_host, of_path)


def _site() -> Column:
    return F.to_json(F.struct("host", "path"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """A row per document: doc_id, row_key, evidence, site_prior, log_odds (double), kept (boolean).

    labels has the same id column and label_col of 0 and 1; null labels count
    as none, of labels that disagree the mean counts. Null hosts and paths are
    sites of their own; a text without words has features of zero. If labels
    lack one of the classes, there is no evidence and every document is kept.
    A table of one document has a prior of a half. Repeated rows each give a
    row; other columns are ignored.
    """
    table = materialize(measured(docs, id_col, text_col, host_col, path_col), "features")
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("label is not null and doc_id is not null")
    marks = materialize(marks.groupBy("doc_id").agg(F.avg("label").alias("label")), "marks")
    labelled = table.join(bounded(marks), "doc_id")
    # A hash threshold first, so that tasks send no more than the sample and a fifth together, however many they are.
    share = min(1.0, 1.2 * MAX_SAMPLE / max(1, labelled.count()))
    place = F.xxhash64("doc_id", "row_key")
    some = labelled.where(F.pmod(place, F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    sample = some.orderBy(place).limit(MAX_SAMPLE).select(*FEATURES, "label").toPandas()
    model = fit(sample[list(FEATURES)].to_numpy(np.float64), (sample["label"].to_numpy(np.float64) >= 0.5).astype(np.float64))
    evidence = table.select("doc_id", "row_key", "host", "path", model.logit().alias("logit"))
    # Rows without an id have no label; kept apart, they are no single key of the join.
    known = evidence.where("doc_id is not null").join(bounded(marks), "doc_id", "left")
    rows = known.unionByName(evidence.where("doc_id is null").withColumn("label", F.lit(None).cast("double")))
    probability = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("logit")))))
    valued = materialize(rows.withColumn("value", F.coalesce("label", probability)).drop("label"), "valued")
    release(table, marks)
    known, levels = sites(valued)
    joined = attach(valued.withColumn("site", _site()), known.drop("host", "path"), "site", "n")
    prior = levels.prior(F.col("value"))
    log_odds = F.col("logit") - F.lit(model.base) + _log_odds(prior)
    out = joined.select("doc_id", "row_key", F.col("logit").alias("evidence"), prior.alias("site_prior"), log_odds.alias("log_odds"))
    return out.withColumn("kept", F.lit(True) if not any(model.weights) else F.col("log_odds") >= 0)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """The documents that `classify` keeps; columns stay as they are."""
    judged = classify(docs, labels, id_col, text_col, host_col, path_col, label_col)
    rejected = judged.where("not kept").select(F.col("doc_id").alias("__out_id"), F.col("row_key").alias("__out_key")).distinct()
    rejected = bounded(materialize(rejected, "rejected"))
    same = docs[id_col].cast("long").eqNullSafe(F.col("__out_id")) & (row_key(id_col, text_col, host_col, path_col) == F.col("__out_key"))
    return docs.join(rejected, same, "left_anti")
