"""Short codes for vectors: each part of a vector is replaced by the number of its nearest codebook entry.

Entries become integers on a grid of ``1 / scale``, and a vector is cut into equal consecutive parts. Each part position has
a codebook, which starts from the vectors with the smallest ids and is improved in a few rounds: every part goes to its nearest
entry, and each entry moves to the mean of its parts, rounded down. Tasks only add up counts and sums for each entry.

The nearest entry is found with a geometric near-neighbour access tree over the codebook. A node picks
split points far from each other out of some that are offered, deals the other entries to the nearest one, and keeps for each split point and each child the range
of distances between the point and the child's entries. A query is measured against the split points. Where
its distance to one of them, less or plus the best distance so far, lies strictly outside a child's range, the whole child
is left out. Distances are square roots of integers: ranges are rounded outwards and query distances to the side that
keeps a child, and entries in question are compared by their integer squares, so that ties go to the lower number exactly.

Defined cases: rows whose vector is null, empty or has null, infinite or NaN entries are left out, and so are those of another
length than most have; if the length is no multiple of the number of parts, the first parts are one longer; fewer vectors than
entries make a smaller codebook; equal ids are ordered by their vectors, null ids come last; empty entries stay as they
are; an empty table gives an empty result; other columns are ignored. Grid values so large that a squared distance would not fit
a long raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspan.llm.common import small_batches
from civicspan.llm.whitening import matrix, on_grid, usual_length

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Split points of a node; a node of so many entries or fewer is a leaf.
DEGREE = 16
#: Integers below this are exact as doubles.
EXACT = 1 << 53


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between the integer rows of both, as longs."""
    largest = int(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    bound = 4 * largest * largest * a.shape[1]
    if bound >= 1 << 63:
        raise ValueError("vectors are too large for exact distances; scale them down first")
    if bound < EXACT:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)).astype(np.int64)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def _under(squares: np.ndarray) -> np.ndarray:
    """Distances that are not larger than the true ones."""
    return np.nextafter(np.sqrt(np.nextafter(squares.astype(np.float64), 0)), 0)


def _over(squares: np.ndarray) -> np.ndarray:
    """Distances that are not smaller than the true ones."""
    return np.nextafter(np.sqrt(np.nextafter(squares.astype(np.float64), np.inf)), np.inf)


@dataclass(frozen=True)
class Node:
    """``splits`` are entry numbers; ``low[c, s]`` and ``high[c, s]`` bound the distances between split point ``s`` and the
    entries of child ``c``. A leaf has no children."""

    splits: np.ndarray
    children: tuple[Node | None, ...] = ()
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def grow(points: np.ndarray, members: np.ndarray | None = None, degree: int = DEGREE) -> Node:
    """The tree over the entries ``members`` of ``points``."""
    members = np.arange(len(points)) if members is None else members
    if len(members) <= degree:
        return Node(members)
    own = points[members]
    offered = np.unique(np.linspace(0, len(members) - 1, 3 * degree).astype(np.int64))
    picked = [0]
    least = squared_distances(own[offered], own[:1])[:, 0]
    while len(picked) < degree and least.max() > 0:
        picked.append(int(offered[least.argmax()]))
        least = np.minimum(least, squared_distances(own[offered], own[picked[-1:]])[:, 0])
    if len(picked) == 1:  # all that were offered are equal
        far = int(squared_distances(own, own[:1])[:, 0].argmax())
        if (own[far] == own[0]).all():
            return Node(members[:1])  # all are: the first is the nearest to anything
        picked.append(far)
    apart = squared_distances(own, own[picked])
    home = apart.argmin(axis=1)
    home[picked] = -1
    children, low, high = [], [], []
    for c in range(len(picked)):
        inside = np.flatnonzero(home == c)
        children.append(grow(points, members[inside], degree) if len(inside) else None)
        low.append(_under(apart[inside]).min(axis=0) if len(inside) else np.zeros(len(picked)))
        high.append(_over(apart[inside]).max(axis=0) if len(inside) else np.zeros(len(picked)))
    return Node(members[picked], tuple(children), np.array(low), np.array(high))


class Search:
    """Nearest entries of many queries at once; ``measured`` counts the distances that were computed."""

    def __init__(self, points: np.ndarray, tree: Node):
        self.points, self.tree, self.measured = points, tree, 0

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest entry, the lower one of equally near ones, and the squared distance."""
        self.best = np.full(len(queries), np.iinfo(np.int64).max)
        self.entry = np.full(len(queries), len(self.points))
        self.queries = queries
        if len(queries) and len(self.points):
            self._visit(self.tree, np.arange(len(queries)))
        return self.entry, self.best

    def _measure(self, node: Node, rows: np.ndarray) -> np.ndarray:
        apart = squared_distances(self.queries[rows], self.points[node.splits])
        self.measured += apart.size
        order = np.argsort(node.splits)
        at = order[apart[:, order].argmin(axis=1)]  # the first of equal ones has the lowest number
        found, number = apart[np.arange(len(rows)), at], node.splits[at]
        better = (found < self.best[rows]) | ((found == self.best[rows]) & (number < self.entry[rows]))
        self.best[rows[better]], self.entry[rows[better]] = found[better], number[better]
        return apart

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        apart = self._measure(node, rows)
        if not node.children:
            return
        home = apart.argmin(axis=1)
        for c, child in enumerate(node.children):  # first where the best is likely, for a short reach
            here = np.flatnonzero(home == c)
            if child is not None and len(here):
                self._visit(child, rows[here])
        under, over = _under(apart), _over(apart)
        for c, child in enumerate(node.children):
            if child is None:
                continue
            reach = _over(self.best[rows])[:, None]
            beyond = np.nextafter(under - reach, -np.inf) > node.high[c]
            within = np.nextafter(over + reach, np.inf) < node.low[c]
            here = np.flatnonzero((home != c) & ~(beyond | within).any(axis=1))
            if len(here):
                self._visit(child, rows[here])


@dataclass(frozen=True)
class Codebooks:
    """The entries of each part, as integer rows."""

    parts: tuple[np.ndarray, ...]

    def cut(self, x: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([p.shape[1] for p in self.parts])
        return np.split(x, ends[:-1], axis=1)

    def searches(self) -> list[Search]:
        return [Search(p, grow(p)) for p in self.parts]

    def as_text(self) -> str:
        """All components by part, entry and position, with commas."""
        return ",".join(str(v) for p in self.parts for v in p.ravel().tolist())


def first_entries(vectors: DataFrame, parts: int, entries: int) -> Codebooks:
    """Codebooks of the vectors with the smallest ids; ``vectors`` has ``key`` and ``x``."""
    rows = vectors.orderBy(F.col("key").asc_nulls_last(), "x").limit(entries).collect()
    first = np.array([r["x"] for r in rows], np.int64)
    return Codebooks(tuple(np.array_split(first, parts, axis=1)))


def improved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: parts to their nearest entries, entries to the means of their parts, rounded down."""
    widest = max(p.shape[1] for p in books.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = books.searches()
        counts = [np.zeros(len(p), np.int64) for p in books.parts]
        sums = [np.zeros((len(p), widest), np.int64) for p in books.parts]
        for batch in small_batches(batches, 10_000):
            if batch.num_rows:
                for k, rows in enumerate(books.cut(matrix(batch.column("x"), np.int64))):
                    entry, _ = searches[k].nearest(rows)
                    counts[k] += np.bincount(entry, minlength=len(counts[k]))
                    np.add.at(sums[k][:, : rows.shape[1]], entry, rows)
        for k, count in enumerate(counts):
            used = np.flatnonzero(count)
            made = {"part": [k] * len(used), "entry": used.astype("i4"), "n": count[used], "sums": list(sums[k][used])}
            yield pa.RecordBatch.from_pydict(made, schema=pa.schema(
                [("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]
            ))

    each = vectors.select("x").mapInArrow(run, "part int, entry int, n long, sums array<bigint>")
    totals = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(widest)]
    moved = [p.copy() for p in books.parts]
    for row in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
        part = moved[row["part"]]
        part[row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(part.shape[1])]
    return Codebooks(tuple(moved))


def train(
    vectors: DataFrame,
    key: str = "vec_id",
    column: str = "embedding",
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> Codebooks | None:
    """The codebooks after some rounds over all whole vectors; None if there is none."""
    length = usual_length(vectors, column)
    if length is None:
        return None
    whole = on_grid(vectors, key, column, length, scale)
    books = first_entries(whole, min(parts, length), entries)
    for _ in range(rounds):
        books = improved(whole, books)
    return books


def encode(
    vectors: DataFrame, books: Codebooks | None, key: str = "vec_id", column: str = "embedding", also: str | None = None, scale: int = SCALE
) -> DataFrame:
    """``key, code, error`` of every whole vector, and ``also`` another column under that name.

    ``code`` has two hex digits a part, four if a codebook has more than 256 entries."""
    kept = {"key": vectors.schema[key].dataType.simpleString()}
    if also:
        kept["also"] = vectors.schema[also].dataType.simpleString()
    schema = ", ".join(f"{name} {kind}" for name, kind in kept.items()) + ", code string, error long"
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    length = sum(p.shape[1] for p in books.parts)
    digits = 2 if max(len(p) for p in books.parts) <= 256 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = books.searches()
        for batch in small_batches(batches, 10_000):
            if not batch.num_rows:
                continue
            found = [s.nearest(rows) for s, rows in zip(searches, books.cut(matrix(batch.column("x"), np.int64)), strict=True)]
            codes = np.stack([entry for entry, _ in found], axis=1).astype(">u1" if digits == 2 else ">u2")
            texts = [row.tobytes().hex() for row in codes]
            made = [*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(sum(e for _, e in found), pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=[*kept, "code", "error"])

    source = vectors.select(F.col(key).alias("key"), F.col(column).alias("vector"), *([F.col(also).alias("also")] if also else []))
    return on_grid(source, "key", "vector", length, scale, *list(kept)[1:]).mapInArrow(run, schema)


def decode(codes: DataFrame, books: Codebooks, code: str = "code", scale: int = SCALE) -> DataFrame:
    """The rows with ``vector``, the centres of the entries' grid cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = 2 if max(len(p) for p in books.parts) <= 256 else 4
        for batch in small_batches(batches):
            made = []
            for text in batch.column("code").to_pylist():
                numbers = np.frombuffer(bytes.fromhex(text), ">u1" if digits == 2 else ">u2")
                made.append((np.concatenate([p[n] for p, n in zip(books.parts, numbers, strict=True)]) + 0.5) / scale)
            yield pa.RecordBatch.from_arrays([batch.column("code"), pa.array(made, pa.list_(pa.float64()))], names=["code", "vector"])

    return codes.select(F.col(code).alias("code")).distinct().mapInArrow(run, "code string, vector array<double>")
