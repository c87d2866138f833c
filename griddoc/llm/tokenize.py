"""Encoding of a corpus with a public byte-level BPE.

The merges are compiled into a transducer over bytes whose states are made when first met. A state is what is not yet
decided: the last token emitted and the pending bytes. Each pending position knows the last token of the encoding of
its prefix; a token may follow another if the two, merged as one string, come out as those two. A read byte adds a
position; what all positions that some longer token could still start from have in common is decided and emitted.
The pending bytes are thereby bounded by the longest token. Transitions are kept, so a byte costs one look-up.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and states kept per worker; beyond that the store is emptied, which changes the speed only.
KEPT = 200_000


class Transducer:
    """Byte-level BPE as a lazily determinised transducer."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.size = {i: len(t) for t, i in ranks.items()}
        self.bytes = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.open = {t[:k] for t in ranks for k in range(1, len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.number = {(None, b""): 0}
        self.states: list[tuple] = [(None, b"", ())]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.ends: list[tuple[int, ...] | None] = [()]

    def _merged(self, text: bytes) -> list[bytes]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, a: int | None, b: int) -> bool:
        if a is None:
            return True
        if (known := self.pairs.get((a, b))) is None:
            left, right = self.bytes[a], self.bytes[b]
            if len(self.pairs) > KEPT:
                self.pairs.clear()
            known = self.pairs[a, b] = self._merged(left + right) == [left, right]
        return known

    def _chain(self, last: tuple, end: int) -> list[int]:
        """Positions at which the tokens of the prefix of that length end, from the back to 0."""
        ends = [end]
        while end:
            end -= self.size[last[end - 1]]
            ends.append(end)
        return ends

    def _add(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        prev, pending, last = self.states[state]
        pending += bytes((byte,))
        n = len(pending)
        for i in range(max(0, n - self.longest), n):
            if (t := self.ids.get(pending[i:])) is not None and self._follows(last[i - 1] if i else prev, t):
                last += (t,)
                break
        ends = [self._chain(last, i) for i in range(n + 1) if i == n or pending[i:] in self.open]
        common = set(ends[0]).intersection(*ends[1:])
        cut = max(common)
        out = tuple(last[e - 1] for e in reversed(self._chain(last, cut)) if e)
        prev, pending, last = (out[-1] if out else prev), pending[cut:], last[cut:]
        if (to := self.number.get((prev, pending))) is None:
            to = self.number[prev, pending] = len(self.states)
            self.states.append((prev, pending, last))
            self.moves.append({})
            self.ends.append(None)
        self.moves[state][byte] = to, out
        return to, out

    def _forget(self, state: int) -> int:
        """Empty the stores but for one state; its new number."""
        kept = self.states[state]
        self._reset()
        if kept[:2] == (None, b""):
            return 0
        self.number[kept[:2]] = 1
        self.states.append(kept)
        self.moves.append({})
        self.ends.append(None)
        return 1

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece of the split text."""
        state, ids, moves = 0, [], self.moves
        for byte in piece:
            if len(self.states) > KEPT:
                state, moves = self._forget(state), self.moves
            state, out = moves[state].get(byte) or self._add(state, byte)
            if out:
                ids += out
        if (rest := self.ends[state]) is None:
            last = self.states[state][2]
            rest = self.ends[state] = tuple(last[e - 1] for e in reversed(self._chain(last, len(last))) if e)
        ids += rest
        return ids


class Encoder:
    """Split text, then the transducer; whole pieces met before are taken from a store."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.machine = Transducer(self.ranks)
        self.split = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        known = self.known
        for piece in self.split.findall(text):
            if (got := known.get(piece)) is None:
                got = self.machine.encode(piece.encode("utf-8", "surrogatepass"))
                if len(known) > KEPT:
                    known.clear()
                known[piece] = got
            ids += got
        return ids


class Utf8:
    """Incremental UTF-8: bytes in, text out; an ill-formed sequence gives U+FFFD once per maximal part."""

    def __init__(self) -> None:
        self.need, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.code, self.need, self.low, self.high = self.code << 6 | b & 0x3F, self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        rest, self.need = "�" if self.need else "", 0
        return rest


def stream_decode(ids: Iterable[int], tokens: dict[int, bytes]) -> Iterator[str]:
    """Text of a stream of ids, as soon as its characters are whole."""
    state = Utf8()
    for i in ids:
        if text := state.feed(tokens[i]):
            yield text
    if rest := state.close():
        yield rest


_loaded: dict[str, Encoder] = {}


def loaded(path: str) -> Encoder:
    """The encoder of that file, made once per worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row of docs; null and empty texts give an empty list. No special tokens are recognised or added.

    Repeated rows each give a row, an empty table none; other columns are ignored; texts of any length are encoded whole.
    """
    path = os.path.join(folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                ids = [encoder.encode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); an empty list gives an empty text, null ids null, an unknown id an error."""
    path = os.path.join(folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(path).machine.bytes
        for b in batches:
            texts = [None if x is None else "".join(stream_decode(x, tokens)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
