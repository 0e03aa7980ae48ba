"""Token counts by a unigram vocabulary: count-only Viterbi.

An Aho-Corasick automaton lists the vocabulary's matches in a piece of text;
dynamic programming over end positions carries the best score and its number of
tokens, and no back pointers. Ties are decided as the tokenizers library does: a
later candidate must be strictly better, and candidates come by start position,
so the earliest start (the longest token) wins. A character that no token
covers alone may be unknown, at the lowest score less 10; it counts as one token
for each of its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .session import others, schema_of

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 250_000


@dataclass(frozen=True)
class UnigramVocabulary:
    """Tokens and their scores; byte tokens (<0x00> to <0xFF>) and control tokens are not among them."""

    pieces: tuple[tuple[str, float], ...]

    @property
    def name(self) -> str:
        return hashlib.sha256(repr(self.pieces).encode()).hexdigest()


def read_vocabulary(path: str) -> UnigramVocabulary:
    """The normal pieces and scores of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return UnigramVocabulary(tuple((model.id_to_piece(i), float(model.get_score(i))) for i in ids))


class Counter:
    """Best score and number of tokens of texts."""

    def __init__(self, vocabulary: UnigramVocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        # Where no token crosses from other characters to a space mark, words can be solved one by one. Sums of
        # other than whole numbers would round differently, so that ties could be decided otherwise: whole texts then.
        exact = all(float(s).is_integer() for _, s in vocabulary.pieces)
        inner = regex.compile(f"[^{SPACE}]{SPACE}")
        self.words = None if not exact or any(inner.search(p) for p, _ in vocabulary.pieces) else regex.compile(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+").findall
        self._recent: dict[str, tuple[float, int]] = {}

    def solve(self, text: str) -> tuple[float, int]:
        n = len(text)
        best, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        matches: Iterator = iter(()) if self.empty else self.automaton.iter(text)
        pending = next(matches, None)
        for end in range(1, n + 1):
            score, number = float("-inf"), 0
            while pending is not None and pending[0] == end - 1:
                length, own = pending[1]
                candidate = best[end - length] + own
                if candidate > score:
                    score, number = candidate, count[end - length] + 1
                pending = next(matches, None)
            last = text[end - 1]
            if last not in self.single:
                candidate = best[end - 1] + self.unknown
                if candidate > score:
                    score, number = candidate, count[end - 1] + len(last.encode("utf-8", "surrogatepass"))
            best[end], count[end] = score, number
        return best[n], count[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """Number of tokens and score of a text, a space put before it; a null or empty one has none."""
        if not text:
            return 0, 0.0
        text = SPACE + text.replace(" ", SPACE)
        if self.words is None:
            score, number = self.solve(text)
            return number, score
        recent, total, number = self._recent, 0.0, 0
        for word in self.words(text):
            got = recent.get(word)
            if got is None:
                got = self.solve(word)
                if len(word) <= 64:
                    if len(recent) >= CACHE:
                        recent.clear()
                    recent[word] = got
            total += got[0]
            number += got[1]
        return number, total


_counters: dict[str, Counter] = {}


def counter(vocabulary: UnigramVocabulary) -> Counter:
    """This process's counter; kept from task to task."""
    name = vocabulary.name
    if name not in _counters:
        _counters[name] = Counter(vocabulary)
    return _counters[name]


def count_tokens(docs: DataFrame, vocabulary: UnigramVocabulary, column: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``token_score`` of each whole text (0 and 0 if null or empty; a blank text is counted like any other).

    Rows are counted one by one, repeated ones alike. Other columns pass; those of
    these names, in any case, are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file, not data
    names = others(docs, "n_tokens", "token_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(shared.value)
        for batch in batches:
            got = [own.count(t.as_py()) for t in batch.column(batch.schema.get_field_index(column))]
            n, scores = zip(*got) if got else ((), ())
            out = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n, pa.int64()), pa.array(scores, pa.float64())], [*names, "n_tokens", "token_score"])

    return docs.mapInArrow(run, schema_of(docs, names, "n_tokens long, token_score double"))
