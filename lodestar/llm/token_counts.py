"""Token counts of a unigram vocabulary, by a Viterbi pass that keeps counts only.

An Aho-Corasick automaton finds the vocabulary's pieces that end at each
character. For each end the pass carries the best score of the text up to it
and the number of tokens on that path; no path is stored.

Tie rules are those of unigram tokenizers: starts are tried from left to right
and a later one wins only by a strictly larger score, so of equal scores the
longest last piece stays. A character that is no piece can be an unknown of
ten below the least score; a run of unknowns is one token or, with byte
pieces, one for each of its bytes.

Texts are cut before white space where no piece of the vocabulary crosses such
a cut; the parts are then counted once each, since the best path of a text is
the best paths of its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

#: What an unknown character scores below the least piece.
UNKNOWN_PENALTY = 10.0
#: Counted parts that a worker remembers at most; beyond, it forgets them all.
REMEMBERED = 500_000
#: Characters of a part beyond which its count isn't remembered.
LONGEST = 100
NEVER = float("-inf")
SPACE = "▁"


class Counter:
    """Counts tokens of texts by the pieces and scores of a model file's contents."""

    def __init__(self, model: bytes) -> None:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = processor.normalize
        self.automaton, least = ahocorasick.Automaton(), 0.0
        pieces = []
        byte_pieces = 0
        for i in range(processor.get_piece_size()):
            score, piece = processor.get_score(i), processor.id_to_piece(i)
            least = min(least, score)
            byte_pieces += processor.is_byte(i)
            if not (processor.is_unknown(i) or processor.is_control(i) or processor.is_byte(i) or processor.is_unused(i)):
                pieces.append(piece)
                self.automaton.add_word(piece, (len(piece), score))
        self.longest = max(map(len, pieces), default=1)
        self.automaton.make_automaton()
        self.unknown, self.by_bytes = least - UNKNOWN_PENALTY, byte_pieces == 256
        crossing = re.compile(f"[^{SPACE}]{SPACE}")
        self.parts = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall if SPACE in pieces and not any(map(crossing.search, pieces)) else None
        self.known: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        """Tokens on the best path of a normalized text; as many ends are held as the longest piece has characters, and one."""
        held, unknown, by_bytes = self.longest + 1, self.unknown, self.by_bytes
        score, count, whole = [0.0] * held, [0] * held, [False] * held
        # Matches come by their last character, of one character the longest first.
        matches, done = iter(self.automaton.iter(text)), (-1, (0, 0.0))
        last, (length, worth) = next(matches, done)
        before = here = 0
        for at, character in enumerate(text):
            best, tokens, single = NEVER, 0, False
            while last == at:
                start = (at + 1 - length) % held
                found = score[start] + worth
                if found > best:
                    best, tokens = found, count[start] + 1
                single = length == 1
                last, (length, worth) = next(matches, done)
            here = (at + 1) % held
            whole[here] = False
            if not single and score[before] + unknown > best:
                best = score[before] + unknown
                tokens = count[before] + (len(character.encode()) if by_bytes else not whole[before])
                whole[here] = True
            score[here], count[here] = best, tokens
            before = here
        return count[here]

    def count(self, text: str | None) -> int:
        """Tokens of a text; 0 for null."""
        if not text:
            return 0
        text = self.normalize(text)
        if self.parts is None:
            return self.viterbi(text)
        known, total = self.known, 0
        for part in self.parts(text):
            if len(part) > LONGEST:
                total += self.viterbi(part)
                continue
            tokens = known.get(part)
            if tokens is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                tokens = known[part] = self.viterbi(part)
            total += tokens
        return total


_counters: dict[int, Counter] = {}


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, n_tokens) per document.

    model_file is a SentencePiece model that the driver can read; its pieces
    and scores are the unigram vocabulary, whatever algorithm made them. Null
    and empty texts have no tokens; texts are counted whole; repeated rows
    each give a row; other columns are ignored.
    """
    with open(model_file, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        key = hash(model)
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(model)
        counter = _counters[key]
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
