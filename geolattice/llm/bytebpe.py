"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece's bytes exactly one token can come last in the
prefix's encoding. It is found from the shorter prefixes' last tokens: a token
that ends the prefix is the one if it may follow the last token of the rest, and
whether one token may follow another depends on these two alone. Storing the
last tokens makes appends exact and lets an edit re-encode only its
surroundings; the encoding is read off backwards.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .session import others, schema_of

CACHE, SEAMS = 500_000, 600_000
STATES, STATE_LENGTHS = 60_000, (8, 5)


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, of a file of base64 tokens and ranks."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge_all(piece: bytes, ranks: dict[bytes, int], below: float = float("inf")) -> list[bytes]:
    """Plain BPE: merge the neighbours of lowest rank, leftmost first, while that rank is under ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Vocabulary:
    """Ranks, and which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._ending = [0] * 256  # longest token that ends in each byte
        for token in ranks:
            self._ending[token[-1]] = max(self._ending[token[-1]], len(token))
        self._states: dict[bytes, list[int]] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._follows: dict[int, bool] = {}  # by a << 32 | b

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self._halves:
            text = self.tokens[token]
            parts = merge_all(text, self.ranks, token) if len(text) > 1 else [text]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes together is a, b.

        Merges are undone towards the seam, latest first. If at some time the two
        tokens at the seam have a merge of lower rank than what undoing them
        restores, BPE would have made that merge instead.
        """
        key = a << 32 | b
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) > SEAMS:
                self._follows.clear()
            known = self._follows[key] = self._clean_seam(a, b)
        return known

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of a piece, by the same steps as PrefixEncoder; last tokens of common beginnings are kept and appended to."""
        ranks, ending, known, states = self.ranks.get, self._ending, self._follows, self._states
        n, done, last = len(piece), 0, [-1]
        for k in STATE_LENGTHS:
            if n > k and (state := states.get(piece[:k])) is not None:
                done, last = k, state[:]
                break
        for to in range(done + 1, n + 1):
            token = None
            for at in range(max(0, to - ending[piece[to - 1]]), to):
                token = ranks(piece[at:to])
                if token is not None:
                    if not at:
                        break
                    follows = known.get(last[at] << 32 | token)
                    if follows if follows is not None else self.follows(last[at], token):
                        break
            if token is None:
                raise ValueError(f"byte {piece[to - 1]} is not in the vocabulary")
            last.append(token)
        for k in STATE_LENGTHS:
            if n > k > done:
                if len(states) > STATES:
                    states.clear()
                states[piece[:k]] = last[: k + 1]
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]

    def _clean_seam(self, a: int, b: int) -> bool:
        tokens, ranks = self.tokens, self.ranks
        limit = float("inf")  # merges at the seam of this rank or more come too late
        while True:
            merged = ranks.get(tokens[a] + tokens[b])
            if merged is not None and merged < limit:
                return False
            left, right = self.halves(a), self.halves(b)
            if left is None and right is None:
                return True
            # The later of the two merges goes first; at equal rank, the left one was made first.
            if right is None or left is not None and a > b:
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]  # a seam merge of b's own rank lies further left, so it would win


class PrefixEncoder:
    """The encoding of some bytes that grow or change; ``last[i]`` is the last token of the first i bytes' encoding."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary = vocabulary
        self.piece = b""
        self.last: list[int] = [-1]
        self.append(piece)

    def _next(self, to: int) -> int:
        v, piece, last = self.vocabulary, self.piece, self.last
        for at in range(max(0, to - v.longest), to):
            token = v.ranks.get(piece[at:to])
            if token is not None and (at == 0 or v.follows(last[at], token)):
                return token
        raise ValueError(f"byte {piece[to - 1]} is not in the vocabulary")

    def append(self, more: bytes) -> None:
        """Add bytes at the end; what is stored stays right."""
        start = len(self.piece)
        self.piece += more
        for to in range(start + 1, len(self.piece) + 1):
            self.last.append(self._next(to))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in the place of bytes start..end; returns how many prefixes were encoded anew.

        Behind the edit, once as many neighbouring prefixes as the longest token
        has bytes end in their old tokens, all later ones do.
        """
        old, tail = self.last, len(self.piece) - end
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last = old[: start + 1]
        same, done = 0, 0
        first_old = end + 1
        for to in range(start + 1, len(self.piece) + 1):
            token = self._next(to)
            self.last.append(token)
            done += 1
            before = to - len(new) + (end - start)
            if before >= first_old and to - len(self.vocabulary.tokens[token]) >= start + len(new) and old[before] == token:
                same += 1
                if same >= self.vocabulary.longest:
                    self.last.extend(old[before + 1 :])
                    break
            else:
                same = 0
        assert len(self.last) == len(self.piece) + 1 and tail >= 0
        return done

    def tokens(self) -> list[int]:
        out, at = [], len(self.piece)
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(self.vocabulary.tokens[token])
        return out[::-1]


class Codec:
    """Whole texts: each match of the pattern is encoded by itself; a match that is a token is that token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.find = regex.compile(pattern).findall
        self._recent = _Pieces(self.vocabulary)
        size = max(ranks.values(), default=0) + 1
        self._table = [b""] * size
        for token, rank in ranks.items():
            self._table[rank] = token

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        return b"".join(map(self._recent.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    """Ids of pieces, made when first asked for. Two generations: what is asked for again outlives what is not."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self._old: dict[str, bytes] = {}

    def age(self) -> None:
        self._old = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        old = self._old.get(piece)
        if old is not None:
            self[piece] = old
            return old
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        ids = [whole] if whole is not None else self.vocabulary.encode(data)
        out = np.array(ids, "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) > CACHE // 2:
                self.age()
            self[piece] = out
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(name: str, pattern: str, data: bytes) -> Codec:
    """This process's codec of a vocabulary; kept from task to task."""
    if (name, pattern) not in _codecs:
        _codecs[name, pattern] = Codec(load_ranks(data), pattern)
    return _codecs[name, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, column: str = "text", digests: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (tokens of each whole text, array<int>), or with digests of the round trip instead.

    ``vocabulary`` is the path of a rank file that the driver can read. A null
    text counts as empty and has no tokens. With ``digests``: n_tokens,
    ids_sha256 (of the ids as little-endian 32-bit integers) and decoded_sha256
    (of the bytes that decoding gives). Rows are handled one by one, whatever the
    other columns hold, repeated ones alike; columns of the same names, in any
    case, are replaced.
    """
    data = Path(vocabulary).read_bytes()
    name = hashlib.sha256(data).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(data)  # a vocabulary file, not data
    new = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digests else ["ids array<int>"]
    names = others(docs, *(x.split()[0] for x in new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, pattern, shared.value)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(column))
            out = [batch.column(batch.schema.get_field_index(c)) for c in names]
            if digests:
                rows = []
                for x in text:
                    ids = own.encode(x.as_py())
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
                n, one, two = zip(*rows) if rows else ((), (), ())
                out += [pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            else:
                ids = [np.frombuffer(own.encode(x.as_py()), "<i4") for x in text]
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, "<i4")]))))
            yield pa.RecordBatch.from_arrays(out, [*names, *(x.split()[0] for x in new)])

    return docs.mapInArrow(run, schema_of(docs, names, ", ".join(new)))


def decode_documents(docs: DataFrame, vocabulary: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """``docs`` with the text that the token ids stand for; null ids give an empty text, bytes that are no UTF-8 become U+FFFD."""
    data = Path(vocabulary).read_bytes()
    name = hashlib.sha256(data).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(data)
    names = others(docs, output)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, ".", shared.value)
        for batch in batches:
            texts = [own.decode(np.array(x.as_py() or [], "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(batch.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(texts, pa.string())], [*names, output])

    return docs.mapInArrow(run, schema_of(docs, names, f"`{output}` string"))
