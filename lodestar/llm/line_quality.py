"""Line-first cleaning: rules judge each line, then documents that lose too much go.

A line fails if one of these holds (lines without a word are neither kept nor
counted):

punctuation  no word of it ends in a terminal mark
navigation   separators are a fifth of its words or more
symbols      symbol characters are over a tenth of its word characters
shouting     five words or more, over half of them in capitals
repetition   eight words or more, a third or fewer of them distinct
boilerplate  it has one of the phrases below, or equals an earlier line

Failing lines are removed. The document is kept if the words of removed lines
are at most MAX_LOST per cent of its words and no base measure rejects it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words in removed lines that a kept document may have, in per cent.
MAX_LOST = 30
#: Kept documents have so many words at least.
MIN_WORDS = 50
#: Kept documents have so many per cent of their words in repeated windows at most.
MAX_REPEATED = 50
#: Symbol characters, terminal marks, separators and phrases.
SYMBOLS = "#*$%&|<>"
TERMINAL = ".!?…。！？"
SEPARATORS = ("|", "»", "›", "•", "·", "/", "-", "–", ">", "<")
PHRASES = ("all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "lorem ipsum", "click here", "skip to content")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ENDED = re.compile(f"[{TERMINAL}][\"'”’»)]*(?=[\\x20\\x09-\\x0D]|$)")
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)))
_SPACES = " \t\n\x0b\x0c\r"


def repeated_words(words: list[str]) -> int:
    """Words in three-word windows that occur twice or more, the first included."""
    if len(words) < 4:
        return 0
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    _, pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    windows = pair[:-1] * len(known) + ids[2:]
    distinct, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    if len(distinct) == len(windows):
        return 0
    again = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[again + k] = True
    return int(covered.sum())


def failed_rule(line: str, words: list[str]) -> str | None:
    """The first rule that a line with words fails, but for equality to earlier lines."""
    n = len(words)
    if not _ENDED.search(line):
        return "punctuation"
    separators = sum(map(SEPARATORS.__contains__, words))
    if separators and 5 * separators >= n:
        return "navigation"
    if 10 * sum(map(line.count, SYMBOLS)) > sum(map(len, words)):
        return "symbols"
    if n >= 5 and 2 * sum(map(str.isupper, words)) > n:
        return "shouting"
    if n >= 8 and 3 * len(set(words)) <= n:
        return "repetition"
    if _PHRASE.search(line.lower()):
        return "boilerplate"
    return None


def judge(text: str | None) -> tuple[int, int, int, int, int, int, list[str]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost words, lines that stay)."""
    text = text or ""
    seen: set[str] = set()
    stay, all_words, duplicates, lost = [], [], 0, 0
    for line in text.split("\n"):
        words = _WORD.findall(line)
        if not words:
            continue
        all_words += words
        if line in seen:
            duplicates += 1
            lost += len(words)
            continue
        seen.add(line)
        if failed_rule(line, words):
            lost += len(words)
        else:
            stay.append(line)
    chars = len(text) - sum(map(text.count, _SPACES))
    return len(all_words), chars, sum(map(text.count, SYMBOLS)), duplicates, repeated_words(all_words), lost, stay


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """A row per document: doc_id, the base measures, the verdicts and the cleaned text.

    Columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lost_words (long), base_failed, kept (boolean), clean_text (the lines
    that stay, whole documents alike; null without with_text). A null text is
    an empty one: it has no words and fails the base. Repeated rows each give
    a row; other columns are ignored. Texts are judged whole.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lost_words long, base_failed boolean, kept boolean, clean_text string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                *measures, stay = judge(text.as_py())
                n, repeated, lost = measures[0], measures[4], measures[5]
                failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
                rows.append((*measures, failed, not failed and 100 * lost <= MAX_LOST * n, "\n".join(stay) if with_text else None))
            columns = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _quoted(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: DuckDB SQL of the digest of `clean_lines` over the table documents.
DIGEST_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT r, k, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w,
         row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS again
  FROM (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM (SELECT r, string_split(text, chr(10)) AS lines FROM d))
), j AS (
  SELECT r, again, len(w) AS n,
         again OR NOT regexp_matches(line, '[{TERMINAL}]["''”’»)]*([\x20\x09-\x0D]|$)')
         OR (len(list_filter(w, lambda x: x IN ({_quoted(SEPARATORS)}))) > 0 AND 5 * len(list_filter(w, lambda x: x IN ({_quoted(SEPARATORS)}))) >= len(w))
         OR 10 * length(regexp_replace(line, '[^{SYMBOLS}]', '', 'g')) > length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))
         OR (len(w) >= 5 AND 2 * len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) > len(w))
         OR (len(w) >= 8 AND 3 * len(list_distinct(w)) <= len(w))
         OR regexp_matches(lower(line), '{"|".join(PHRASES)}') AS fails
  FROM l WHERE len(w) > 0
), lines AS (
  SELECT r, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(n) FILTER (fails), 0) AS lost FROM j GROUP BY r
), p AS (
  SELECT r, k, words[k] || ' ' || words[k + 1] || ' ' || words[k + 2] AS g
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 1, 1))) AS k FROM d)
), twice AS (
  SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS c FROM p) WHERE c > 1
), cover AS (
  SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, unnest([k, k + 1, k + 2]) AS pos FROM twice) GROUP BY r
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN lines USING (r) LEFT JOIN cover USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * lost <= {MAX_LOST} * n_words AS kept
FROM m
"""
