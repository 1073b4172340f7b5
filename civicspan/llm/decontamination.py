"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items go into one automaton whose states stand for the
word sequences that occur inside an item. A document's words run through it, and at each word it
knows the length of the longest sequence ending there that some item holds. Where that reaches the
window (or the whole of an item shorter than the window), the words are hit. A table of word pairs
passes over text whose neighbouring words are neighbours in no item.

The automaton is built from blocks of items of a bounded number of words; each block is
broadcast for itself and all documents run through it. With one block nothing is shuffled.

Defined cases: null and empty texts have no words and no hits; items without words are never
found; an item without an id is reported under an empty id; items with the same id count as one; equal
documents get equal results; empty tables give empty results or clean documents; other columns are passed
through, and a column that has the name of an output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspan.llm.common import extended, small_batches, text_key, unused, written

WINDOW = 10
#: Lower-cases A to Z and turns what is not in a word into spaces, byte by byte.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: The same words in an expression; letters in either case.
SQL_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
PAIR_BITS = 22
SPANS = "array<struct<first:bigint,stop:bigint>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class SuffixAutomaton:
    """All word sequences inside the items, and where whole windows and short items end."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.ids = _Ids()
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.names: list[str] = []
        sequences: list[tuple[int, list[int]]] = []
        number: dict[str, int] = {}
        for name, text in items:
            words = words_of(text)
            if words:
                item = number.setdefault(name, len(number))
                sequences.append((item, [self.ids.setdefault(w, len(self.ids)) for w in words]))
        self.names = list(number)
        for _, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._append(last, word)
        self.found: dict[int, set[int]] = {}
        for item, sequence in sequences:
            state = 0
            for at, word in enumerate(sequence, 1):
                state = self.next[state][word]
                if at >= window:
                    self.found.setdefault(self._cut(state), set()).add(item)
            if len(sequence) < window:
                self.found.setdefault(state, set()).add(item)
        shortest = min((len(s) for _, s in sequences), default=window)
        self.least = min(window, shortest)
        self.short_above = self._short_above()
        self.pairs = np.zeros(1 << PAIR_BITS, dtype=bool)
        for _, sequence in sequences:
            s = np.array(sequence, dtype=np.uint64)
            self.pairs[_pair_slot(s[:-1], s[1:])] = True

    def _append(self, last: int, word: int) -> int:
        """Extends the sequence that ends in ``last``; sequences of several items may share states."""
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        state = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at != -1:
            below = self.next[at][word]
            self.link[state] = below if self.length[below] == self.length[at] + 1 else self._split(at, word, below)
        return state

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, at: int, word: int, old: int) -> int:
        """The sequences of ``old`` that ``at`` and ``word`` end in, as a state of their own."""
        state = self._state(self.length[at] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = state
        while at != -1 and self.next[at].get(word) == old:
            self.next[at][word] = state
            at = self.link[at]
        return state

    def _cut(self, state: int) -> int:
        """The state that holds the last ``window`` words of ``state``."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _short_above(self) -> list[int]:
        """For each state the nearest one, itself included, that is a whole short item; -1 if there is none."""
        nearest = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            short = state in self.found and self.length[state] < self.window
            nearest[state] = state if short else nearest[self.link[state]]
        return nearest

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Start and end of the runs that are long enough and whose neighbours are neighbours in some item."""
        if not len(ids):
            return
        member = ids >= 0
        joined = member[:-1] & member[1:]
        as_unsigned = np.where(member, ids, 0).astype(np.uint64)
        joined &= self.pairs[_pair_slot(as_unsigned[:-1], as_unsigned[1:])]
        starts = np.flatnonzero(member & ~np.concatenate(([False], joined)))
        ends = np.flatnonzero(member & ~np.concatenate((joined, [False]))) + 1
        long_enough = ends - starts >= self.least
        yield from zip(starts[long_enough].tolist(), ends[long_enough].tolist(), strict=True)

    def match(self, ids: list[int], start: int, end: int, spans: list[list[int]], items: set[int]) -> None:
        """Runs the words from ``start`` to ``end`` through; merges hit spans into ``spans`` and adds the items."""
        state = length = 0
        for at in range(start, end):
            word = ids[at]
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(word, 0)
            length = length + 1 if state else 0
            longest = 0
            if length >= self.window:
                longest = self.window
                items |= self.found[self._cut(state)]
            short = self.short_above[state] if state else -1
            while short > 0:
                if self.length[short] <= length:
                    longest = max(longest, self.length[short])
                    items |= self.found[short]
                short = self.short_above[self.link[short]]
            if longest:
                first = at + 1 - longest
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append([first, at + 1])


def _pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def scan(automaton: SuffixAutomaton, texts: list[bytes]) -> list[tuple[int, list[list[int]], set[int]]]:
    """Number of words, hit spans of words and found items of each text."""
    of_texts = [words_of(t) for t in texts]
    results = [(len(words), [], set()) for words in of_texts]
    ids = [-1]
    begins = []
    lookup = automaton.ids.__getitem__
    for words in of_texts:
        begins.append(len(ids))
        ids.extend(map(lookup, words))
        ids.append(-1)
    owners = np.array(begins, dtype=np.int64)
    for start, end in automaton.candidates(np.array(ids, dtype=np.int64)):
        owner = int(np.searchsorted(owners, start, side="right")) - 1
        _, spans, items = results[owner]
        automaton.match(ids, start, end, spans, items)
    for begin, (_, spans, _) in zip(begins, results, strict=True):
        for span in spans:
            span[0] -= begin
            span[1] -= begin
    return results


def remove_spans(text: bytes, spans: list[list[int]]) -> bytes:
    """Without the words of the spans and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for first, end in spans:
        kept.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


def item_blocks(items: DataFrame, block_words: int, item: str, text: str) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about ``block_words`` words; one block at a time is on the driver."""
    rows = items.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )
    size = F.regexp_count(F.col("text").cast("string"), F.lit(SQL_WORD))
    blocks = -(-(rows.agg(F.sum(size)).first()[0] or 0) // block_words) or 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    for block in range(blocks):
        yield [(row["item"], bytes(row["text"])) for row in dealt.where(F.col("block") == block).collect()]


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item: str = "item_id",
    window: int = WINDOW,
    block_words: int = 200_000,
) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids, comma-joined) and ``spans``
    (first word of each hit span, and the word after it)."""
    names = ["n_words", "n_hit", "n_items", "items", "spans"]
    docs = docs.drop(*names)
    blocks = [
        docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, window))
        for block in item_blocks(items, block_words, item, text)
    ]
    if len(blocks) == 1:
        return _through(docs, blocks[0], text).withColumn("items", F.array_join("items", ","))
    (of_key,) = unused(docs.columns, "_key")
    keyed = docs.withColumn(of_key, text_key(F.col(text)))
    hits = None
    for block in blocks:
        hit = _through(docs.select(F.col(text)), block, text).where("n_hit > 0")
        part = written(hit.select(text_key(F.col(text)).alias(of_key), "items", "spans").distinct(), "block-hits")
        hits = part if hits is None else hits.unionByName(part)
    merged = hits.groupBy(of_key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        _united(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    counted = keyed.withColumn("n_words", F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SQL_WORD)))
    joined = counted.join(merged, of_key, "left")
    spans = F.coalesce("spans", F.array().cast(SPANS))
    size = F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s.getField("stop") - s.getField("first"))
    return joined.select(
        *docs.columns,
        F.col("n_words").cast("long").alias("n_words"),
        size.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"),
        spans.alias("spans"),
    )


def _united(spans: Column) -> Column:
    """Spans of several blocks, with overlapping and touching ones made one."""

    def add(done: Column, span: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last.getField("first").alias("first"), F.greatest(last.getField("stop"), span.getField("stop")).alias("stop"))
        touching = (F.size(done) > 0) & (span.getField("first") <= last.getField("stop"))
        others = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(touching, F.concat(others, F.array(longer))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), add)


def _through(docs: DataFrame, automaton, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sa = automaton.value
        for batch in small_batches(batches):
            texts = [(t or "").encode() for t in batch.column(text).to_pylist()]
            results = scan(sa, texts)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([n for n, _, _ in results], pa.int64()),
                    pa.array([sum(e - b for b, e in spans) for _, spans, _ in results], pa.int64()),
                    pa.array([len(found) for _, _, found in results], pa.int64()),
                    pa.array([sorted(sa.names[i] for i in found) for _, _, found in results], pa.list_(pa.string())),
                    pa.array([[{"first": a, "stop": b} for a, b in spans] for _, spans, _ in results], _SPANS),
                ],
                names=[*batch.schema.names, "n_words", "n_hit", "n_items", "items", "spans"],
            )

    added = "n_words long, n_hit long, n_items long, items array<string>, spans " + SPANS
    return docs.mapInArrow(run, extended(docs.schema, added))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item: str = "item_id",
    window: int = WINDOW,
    least_span: int = 1,
    most_coverage: float = 0.5,
    block_words: int = 200_000,
) -> DataFrame:
    """The documents without their hit spans of ``least_span`` words or more, and without those documents
    of which more than ``most_coverage`` was hit. Clean documents are returned as they are. Columns stay as they were."""
    outputs = [c for c in docs.columns if c in ("n_words", "n_hit", "n_items", "items", "spans")]
    aside = dict(zip(outputs, unused(docs.columns, *(f"own {c}" for c in outputs)), strict=True))
    docs = docs.withColumnsRenamed(aside)
    names = docs.columns
    found = find_contamination(docs, items, text, item, window, block_words)
    kept = found.where(F.col("n_hit") <= most_coverage * F.col("n_words")).select(*names, "n_hit", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            if not any(batch.column("n_hit").to_pylist()):
                yield batch.select(names)
                continue
            texts = batch.column(text).to_pylist()
            spans = [[[x["first"], x["stop"]] for x in s if x["stop"] - x["first"] >= least_span] for s in batch.column("spans").to_pylist()]
            cleaned = [remove_spans(t.encode(), s).decode() if s else t for t, s in zip(texts, spans, strict=True)]
            decoded = pa.array(cleaned, pa.string())
            columns = [decoded if name == text else batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(run, docs.schema).withColumnsRenamed({put: c for c, put in aside.items()})
