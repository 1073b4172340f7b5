"""Byte-level BPE: exact encoding in linear time, and decoding by an offset table.

A text is cut into pieces by the vocabulary's pattern. In a piece an Aho-Corasick automaton
over all tokens finds every token that occurs, and so the longest one at each place. The encoder takes the
longest token, and goes back to a shorter one, or to an earlier place, where a token can't stand
beside its neighbour. Two tokens can stand side by side if merging their joint bytes gives
just these two; the answers are kept in a table of pairs. As a sequence is the result of the merges if and only if all
neighbours are compatible, the first sequence that reaches the end is the exact encoding. Each place is left at
most once for good, so time is linear in the piece. Encoded pieces are kept in a bounded table.

Decoding copies each token's bytes from one array by its start and end.

Defined cases: a null text is encoded as an empty one, with no ids; equal texts get equal ids;
special tokens in a text become their ids; an empty table gives an empty result; other columns are passed
through, and a column that has the name of an output is replaced.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspan.llm.common import extended, small_batches

#: White space as the pattern's \s has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pieces that a worker remembers; then it starts anew.
KEPT_PIECES = 600_000


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, as character to byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranges(kinds: str, last: int) -> str:
    """The characters whose category begins with one of ``kinds``, as ranges of a character class."""
    inside = [unicodedata.category(chr(c))[0] in kinds for c in range(last + 1)]
    edges = np.flatnonzero(np.diff(np.array([False, *inside, False], dtype=np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _pattern(last: int) -> re.Pattern:
    letters, numbers = _ranges("L", last), _ranges("N", last)
    return re.compile(
        f" ?[{letters}]+| ?[{numbers}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


@lru_cache(maxsize=1)
def _every_pattern() -> re.Pattern:
    return _pattern(sys.maxunicode)


class Splitter:
    """Cuts texts into special tokens and the pieces of the pattern."""

    def __init__(self, special: list[str]):
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.wide = re.compile("[\U00010000-\U0010ffff]")
        self.common = _pattern(0xFFFF)

    def pieces(self, text: str) -> list[str]:
        return (_every_pattern() if self.wide.search(text) else self.common).findall(text)

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text's parts in order, each with whether it is a special token."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        yield text[at:], False


class Vocabulary:
    """Tokens, merges and special tokens of a vocabulary file of the tokenizers library."""

    def __init__(self, content: str):
        described = json.loads(content)
        to_byte = byte_characters()
        model = described["model"]
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        as_bytes = {name: bytes(to_byte[c] for c in name) for name in model["vocab"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        singles = [name for name, raw in as_bytes.items() if len(raw) == 1]
        #: Tokens by rank: single bytes, then the products of the merges in their order.
        order = {name: rank for rank, name in enumerate(singles)}
        halves = [(rank, rank) for rank in range(len(singles))]
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair = (order[left], order[right])
            rank = order.setdefault(left + right, len(halves))
            if rank == len(halves):
                halves.append(pair)
            self.merged.setdefault(pair, rank)
        self.halves = halves
        self.names = list(order)
        self.bytes = [as_bytes[name] for name in self.names]
        self.ids = [model["vocab"][name] for name in self.names]
        known = {model["vocab"][name]: raw for name, raw in as_bytes.items()}
        known |= {i: name.encode() for name, i in self.special.items()}
        self.size = max(known, default=-1) + 1
        spelled = [known.get(i, b"") for i in range(self.size)]
        self.blob = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.offsets = np.zeros(self.size + 1, dtype=np.int64)
        np.cumsum([len(s) for s in spelled], out=self.offsets[1:])

    def decode(self, ids: np.ndarray) -> bytes:
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.blob[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)].tobytes()


class _Pieces(dict):
    """Ids of pieces as little-endian 32-bit bytes; a piece that isn't there is encoded and kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        made = self[piece] = self.encode(piece)
        return made


class PieceEncoder:
    """Texts to ids, by an encoder of single pieces."""

    def __init__(self, special: dict[str, int], encode):
        self.splitter = Splitter(list(special))
        self.special = {name: np.array([i], "<u4").tobytes() for name, i in special.items()}
        self.known = _Pieces(encode)

    def encode(self, text: str) -> bytes:
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        lookup = self.known.__getitem__
        if not any(name in text for name in self.special):
            return b"".join(map(lookup, self.splitter.pieces(text)))
        return b"".join(
            self.special[part] if special else b"".join(map(lookup, self.splitter.pieces(part)))
            for part, special in self.splitter.parts(text)
        )


class BacktrackingEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.sizes = [len(raw) for raw in vocabulary.bytes]
        self.automaton = ahocorasick.Automaton()
        by_spelling = {}
        for rank, raw in enumerate(vocabulary.bytes):
            spelling = raw.decode("latin-1")
            by_spelling[spelling] = rank
            self.automaton.add_word(spelling, rank)
        self.automaton.make_automaton()
        #: The next shorter token that a token begins with, or -1.
        self.shorter = []
        for raw in vocabulary.bytes:
            spelling = raw.decode("latin-1")
            prefixes = (by_spelling.get(spelling[:n], -1) for n in range(len(spelling) - 1, 0, -1))
            self.shorter.append(next((p for p in prefixes if p >= 0), -1))
        self.compatible: dict[tuple[int, int], bool] = {}
        self.ids = np.array(vocabulary.ids, dtype="<u4")

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two tokens."""
        pair = (left, right)
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            known = self.compatible[pair] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Undoes merges from the latest, on the side of the border on which it was made, and looks for a merge
        across the border that would have come first. ``due`` is the rank of the merge undone last:
        a merge across of a smaller rank would have been made before."""
        due = sys.maxsize
        halves, merged = self.v.halves, self.v.merged
        while True:
            across = merged.get((left, right))
            if across is not None and across < due:
                return False
            split_left, split_right = halves[left] != (left, left), halves[right] != (right, right)
            if not split_left and not split_right:
                return True
            if split_left and (left > right or not split_right):
                due, left = left, halves[left][1]
            else:
                # Of equal ranks the left one is merged first, so a merge across of the same rank comes before.
                due, right = right + 1, halves[right][0]

    def piece(self, text: str) -> bytes:
        spelling = text.encode().decode("latin-1")
        end = len(spelling)
        longest = [-1] * (end + 1)
        size = [0] * (end + 1)
        sizes = self.sizes
        for last, rank in self.automaton.iter(spelling):
            start = last + 1 - sizes[rank]
            if sizes[rank] > size[start]:
                size[start], longest[start] = sizes[rank], rank
        open_places = bytearray(b"\x01") * (end + 1)
        made: list[int] = []
        at, token = 0, longest[0]
        while at < end:
            before = made[-1] if made else -1
            while token >= 0:
                if open_places[at + sizes[token]] and (before < 0 or self.fits(before, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                made.append(token)
                at += sizes[token]
                token = longest[at]
            else:
                open_places[at] = 0
                token = made.pop()
                at -= sizes[token]
        return self.ids[made].tobytes()


@lru_cache(maxsize=2)
def encoder(content: str) -> tuple[Vocabulary, PieceEncoder]:
    """Kept by each worker for its later tasks."""
    vocabulary = Vocabulary(content)
    return vocabulary, PieceEncoder(vocabulary.special, BacktrackingEncoder(vocabulary).piece)


def read_vocabulary(path: str) -> str:
    """The content of a vocabulary file on the driver: some MB at most, however large the corpus."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the ids as little-endian 32-bit bytes and, if named, the text decoded from them."""
    names = [ids] + ([decoded] if decoded else [])
    docs = docs.drop(*names)
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, pieces = encoder(content.value)
        for batch in small_batches(batches, 500):
            made = [pieces.encode(t or "") for t in batch.column(text).to_pylist()]
            columns = [*batch.columns, pa.array(made, pa.binary())]
            if decoded:
                back = [vocabulary.decode(np.frombuffer(m, "<u4").astype(np.int64)) for m in made]
                columns.append(pa.array([b.decode("utf-8", "replace") for b in back], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, extended(docs.schema, f"`{ids}` binary" + (f", `{decoded}` string" if decoded else "")))


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text that the ids (little-endian 32-bit bytes; null: none) stand for."""
    docs = docs.drop(decoded)
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = encoder(content.value)
        for batch in small_batches(batches, 500):
            given = [np.frombuffer(b or b"", "<u4").astype(np.int64) for b in batch.column(ids).to_pylist()]
            back = [vocabulary.decode(g).decode("utf-8", "replace") for g in given]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=[*batch.schema.names, decoded])

    return docs.mapInArrow(run, extended(docs.schema, f"`{decoded}` string"))


def n_tokens(ids: str = "ids"):
    return (F.octet_length(ids) / 4).cast("long")
