"""Fill-in-the-middle: cut each text in three and set the middle last.

Texts are cut by code points, but stored as UTF-8. Runs of characters of the
same width in bytes (the character's class) tell where a code point lies
without reading the text again: a run is stored as its first byte and the code
points before it, so a cut is found by a binary search for its run, and its
byte is that of the run and the width times what is left. One set of runs
serves all texts of a batch.

Where a text is cut, and in which form it is written, follows from a digest of
its id, so reruns and retries agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: What opens the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Per cent of texts that stay plain, and of the others that come suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes whose classes are held at a time.
CHUNK = 1 << 20

#: Width in bytes of the character that a byte begins; 0 for bytes within one.
_WIDTH = np.repeat(np.array([1, 0, 2, 3, 4], np.uint8), [128, 64, 32, 16, 16])


class Runs:
    """Maximal runs of code points of one width in a buffer of UTF-8.

    Of run r, first[r] is its first byte, before[r] the code points ahead of
    it and width[r] the bytes of each of its code points.
    """

    def __init__(self, data: np.ndarray) -> None:
        first, before, width, seen, last = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.ones(1, np.int64)], 0, 1
        for start in range(0, len(data), CHUNK):
            kinds = _WIDTH[data[start : start + CHUNK]]
            begins = np.flatnonzero(kinds)
            kinds = kinds[begins]
            turns = np.flatnonzero(np.diff(kinds, prepend=np.uint8(last)))
            first.append(begins[turns] + start)
            before.append(turns + seen)
            width.append(kinds[turns].astype(np.int64))
            seen += len(begins)
            last = int(kinds[-1]) if len(kinds) else last
        self.first, self.before, self.width = map(np.concatenate, (first, before, width))

    def points_at(self, byte: np.ndarray) -> np.ndarray:
        """Code points that lie before bytes which begin one."""
        run = np.searchsorted(self.first, byte, "right") - 1
        return self.before[run] + (byte - self.first[run]) // self.width[run]

    def byte_at(self, point: np.ndarray) -> np.ndarray:
        """The byte at which a code point begins."""
        # Of runs without a code point, as the first can be, the last one is it.
        run = np.searchsorted(self.before, point, "right") - 1
        return self.first[run] + (point - self.before[run]) * self.width[run]


def _draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers below 2**32 that follow from the id; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _pick(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """A row per document: doc_id, n, form, prefix_chars, middle_chars (long), output (string).

    n is the text's code points. form is plain, psm (prefix, suffix, middle)
    or spm (suffix, prefix, middle); plain texts are their own output and have
    null lengths. plain and suffix_first are per cent of texts, by a digest of
    seed and id, in which each of the two cuts falls on any of the n + 1
    places alike. A text that holds one of the marks stays plain, so that
    every output can be turned back (`restored`). A null text is an empty one
    and plain; a null id draws by the seed alone. Repeated rows each give a
    row; other columns are ignored. Texts are cut whole.
    """
    holds = "|".join(map(re.escape, marks))
    opening = [pa.array([m.encode()], pa.binary()) for m in marks]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            if not len(texts):
                continue
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
            runs = Runs(data)
            begins = runs.points_at(offsets)
            n = np.diff(begins)
            h1, h2, h3, h4 = (_pick(batch.column(k)) for k in range(2, 6))
            one, two = h1 % (n + 1), h2 % (n + 1)
            lower, upper = np.minimum(one, two), np.maximum(one, two)
            stays = (n == 0) | (h3 % 100 >= 100 - plain) | _pick(pc.match_substring_regex(texts, holds))
            spm = h4 % 100 < suffix_first
            cuts = runs.byte_at(np.stack((begins[:-1] + lower, begins[:-1] + upper)))
            first, second, end = cuts[0], cuts[1], offsets[1:]
            # Slices of the batch, in the order in which a form has them.
            whole = texts.buffers()[2] or pa.py_buffer(b"")
            pieces = (_slices(whole, offsets[:-1], first), _slices(whole, second, end), _slices(whole, first, second))
            psm = pc.binary_join_element_wise(opening[0][0], pieces[0], opening[1][0], pieces[1], opening[2][0], pieces[2], pa.scalar(b"", pa.binary()))
            other = pc.binary_join_element_wise(opening[1][0], pieces[1], opening[0][0], pieces[0], opening[2][0], pieces[2], pa.scalar(b"", pa.binary()))
            del pieces
            output = pc.if_else(pa.array(stays), texts.cast(pa.binary()), pc.if_else(pa.array(spm), other, psm))
            form = np.where(stays, "plain", np.where(spm, "spm", "psm"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(form, pa.string()), pa.array(lower, mask=stays), pa.array(upper - lower, mask=stays), output.cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(_draws(id_col, seed))))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _slices(data: pa.Buffer, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte strings of a buffer, from start to end each."""
    view = memoryview(data)
    return pa.array([view[a:b] for a, b in zip(start.tolist(), end.tolist())], pa.binary())


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of `transform` was made of, from the output and its form alone."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks))
    # A text has no mark in it, and none arises where two parts meet, since a mark's first character is nowhere else in it.
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame) -> DataFrame:
    """`transform` with the digests of its outputs, and of the texts that outputs turn back into, in place of outputs."""
    made = transform(docs)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: DuckDB SQL of `digests` over the table documents.
DIGEST_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), h AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS e FROM d
), f AS (
  SELECT doc_id, text, n, least(a, b) AS lo, greatest(a, b) AS hi,
         CASE WHEN n = 0 OR c >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, substring(text, 1, lo) AS prefix, substring(text, lo + 1, hi - lo) AS middle, substring(text, hi + 1) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
