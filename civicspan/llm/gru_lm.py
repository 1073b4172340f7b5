"""A gated recurrent language model in numpy, trained and applied by Spark tasks.

The words of all training documents are counted. Words that occur often enough are known to the
network by number, at most ``head_words`` of them; the commonest of these have weights of their own. The output is
factored by class: first the class of the next word, then the word within the class. Classes of common
words have a softmax over their words; the others, bands of known words by frequency and one class for all rarer words
with a place for unseen ones, share out their probability by the words' counts. So the model is a
distribution over all words, and every count of the corpus is in it.

Training is a local descent in each partition, by truncated backpropagation through windows of
``window`` words with the state carried from window to window, followed by the mean of all partitions' weights. Each round
uses another part of the training documents, and together the rounds use all of them once. Scoring carries the
state through the complete document. A document's rare words are looked up in the table of counts by a join.

Defined cases: a null or empty text has no words and one token, its end; a null id counts as an empty
one when documents are held out; equal texts get equal scores; an empty table, or one without training documents, gives
results by the untrained model; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspan.llm.common import small_batches, written

#: The end of a document among words, none of which has a space.
END = b" "
ADDED = 0.1
LONGEST_HEAD_WORD = 64
FLUSH_WORDS = 300_000
COMMON_CLASSES, CLASS_WORDS, BANDS = 24, 42, 7
HIDDEN, LANES, WINDOW = 16, 256, 32
#: Scoring learns nothing, so that wider steps change no result.
SCORING_LANES = 1024
#: Words that are packed into lanes at a time.
PACKED_WORDS = 4_000_000


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return text.lower().split()


def words_in(texts: pa.Array) -> pa.Array:
    """The same words of many texts, as lists, and empty ones where a text begins or ends with white space."""
    return pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))).cast(pa.list_(pa.binary()))


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all texts, ends included; each task sums what it has seen before rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, ends = [], 0, 0
        for batch in small_batches(batches):
            counted = words_in(batch.column(0)).flatten().value_counts()
            held.append(pa.table({"word": counted.field("values"), "n": counted.field("counts")}))
            rows, ends = rows + len(counted), ends + batch.num_rows
            if rows > 2 * FLUSH_WORDS:
                held = [summed(held)]
                rows = held[0].num_rows
                if rows > FLUSH_WORDS:
                    yield from typed(held[0])
                    held, rows = [], 0
        if ends:
            if held:
                yield from typed(summed(held))
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"])

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def typed(counts: pa.Table) -> list[pa.RecordBatch]:
        counted = counts.filter(pc.greater(pc.binary_length(counts["word"]), 0))
        return counted.combine_chunks().to_batches()

    partial = docs.select(text).mapInArrow(run, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """The known words by falling count, and sums over all counted words."""

    words: list[bytes]
    counts: np.ndarray
    least: int
    tokens: int
    distinct: int

    def __post_init__(self):
        end = self.words.index(END) if END in self.words else -1
        if end < 0:
            self.words.append(END)
            self.counts = np.append(self.counts, 0)
        common = COMMON_CLASSES * CLASS_WORDS
        rest = len(self.words) - common
        rank = np.arange(len(self.words))
        band = (np.log1p(np.maximum(rank - common, 0)) / math.log1p(max(rest, 1)) * BANDS).astype(int)
        classes = np.where(rank < common, rank // CLASS_WORDS, COMMON_CLASSES + np.minimum(band, BANDS - 1))
        self.classes = classes.astype(np.int32)
        self.within = np.where(rank < common, rank % CLASS_WORDS, 0).astype(np.int32)
        weights = self.counts + ADDED
        self.mass = np.bincount(self.classes, weights, COMMON_CLASSES + BANDS + 1)
        #: All words that aren't known, and one place for those that were never counted.
        self.mass[-1] = (self.tokens - self.counts.sum()) + ADDED * (self.distinct - np.count_nonzero(self.counts) + 1)
        self.log_share = np.log(weights) - np.log(self.mass[self.classes])
        #: Numbers by which the network reads words: common words, then one for each other class, then the start.
        self.inputs = np.where(rank < common, rank, common + self.classes - COMMON_CLASSES).astype(np.int32)

    n_classes = COMMON_CLASSES + BANDS + 1
    rare = n_classes - 1
    rare_input = COMMON_CLASSES * CLASS_WORDS + BANDS
    start_input = rare_input + 1


def lexicon(counts: DataFrame, head_words: int) -> Lexicon:
    """Known are the words whose count is at least the smallest one that at most ``head_words`` words reach.

    The driver gets one row for each value of a count, and then the known words."""
    total = counts.agg(F.sum("n"), F.count("*")).first()
    short = counts.where((F.octet_length("word") <= LONGEST_HEAD_WORD) | (F.col("word") == F.lit(END)))
    reached, least = 0, 1
    for row in sorted(short.groupBy("n").agg(F.count("*").alias("words")).collect(), reverse=True):
        if reached + row["words"] > head_words:
            least = row["n"] + 1
            break
        reached += row["words"]
    known = short.where(F.col("n") >= least).collect()
    known.sort(key=lambda row: (-row["n"], bytes(row["word"])))
    words = [bytes(row["word"]) for row in known]
    return Lexicon(words, np.array([row["n"] for row in known], dtype=np.int64), least, total[0] or 0, total[1])


def first_weights(lex: Lexicon, seed: int = 1) -> dict[str, np.ndarray]:
    """Small random weights; the biases give the counted frequencies."""
    rng = np.random.default_rng(seed)
    shares = np.zeros((COMMON_CLASSES, CLASS_WORDS))
    shares[:] = -30.0
    common = min(len(lex.words), COMMON_CLASSES * CLASS_WORDS)
    shares[lex.classes[:common], lex.within[:common]] = lex.log_share[:common]
    made = {
        "input": rng.normal(0, 0.1, (lex.start_input + 1, 3 * HIDDEN)),
        "state": rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)),
        "class": rng.normal(0, 0.01, (HIDDEN, lex.n_classes)),
        "class_bias": np.log(np.maximum(lex.mass, 1e-9) / max(lex.mass.sum(), 1e-9)),
        "word": rng.normal(0, 0.01, (COMMON_CLASSES, HIDDEN, CLASS_WORDS)),
        "word_bias": shares,
    }
    return {name: value.astype(np.float32) for name, value in made.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place of ``x``."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _odds(logits: np.ndarray, rows: np.ndarray, chosen: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray]:
    """The natural log probability of the chosen column of each row, and, to learn, all probabilities (in place of the logits).

    Logits stay far from overflow, as states lie between -1 and 1; the bound only makes sure."""
    np.minimum(logits, 60, out=logits)
    picked = logits[rows, chosen]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    if learn:
        logits /= total[:, None]
    return picked - np.log(total), logits


class Network:
    """The recurrent network with its output layers, over lanes of words in windows."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.2):
        self.w = {name: value.copy() for name, value in weights.items()}
        self.rate = rate
        self.squares = {name: np.full_like(value, 1e-3) for name, value in self.w.items()}

    def forward(self, reads: np.ndarray, begins: np.ndarray, state: np.ndarray):
        """States after each step of a window; ``begins`` marks the steps before which a lane's state is cleared."""
        steps, lanes = reads.shape
        given = self.w["input"][reads]
        u = self.w["state"]
        h = np.empty((steps + 1, lanes, HIDDEN), np.float32)
        gates = np.empty((steps, lanes, 2 * HIDDEN), np.float32)
        fresh = np.empty((steps, lanes, HIDDEN), np.float32)
        recurrent = np.empty((steps, lanes, HIDDEN), np.float32)
        h[0] = state
        before = np.empty((steps, lanes, HIDDEN), np.float32)
        goes_on = (~begins).astype(np.float32)[:, :, None]
        pushed, moved = np.empty((lanes, 3 * HIDDEN), np.float32), np.empty((lanes, HIDDEN), np.float32)
        for t in range(steps):
            np.multiply(h[t], goes_on[t], out=before[t])
            np.matmul(before[t], u, out=pushed)
            _sigmoid(np.add(given[t, :, : 2 * HIDDEN], pushed[:, : 2 * HIDDEN], out=gates[t]))
            recurrent[t] = pushed[:, 2 * HIDDEN :]
            np.multiply(gates[t, :, HIDDEN:], recurrent[t], out=moved)
            moved += given[t, :, 2 * HIDDEN :]
            np.tanh(moved, out=fresh[t])
            np.subtract(before[t], fresh[t], out=moved)
            moved *= gates[t, :, :HIDDEN]
            np.add(fresh[t], moved, out=h[t + 1])
        return h[1:], (before, gates, fresh, recurrent)

    def outputs(self, h: np.ndarray, classes: np.ndarray, within: np.ndarray, learn: bool):
        """Natural log probability of each class and, for common words, of the word in it; and the gradient for ``h``."""
        rows = np.arange(len(h))
        chosen, odds = _odds(h @ self.w["class"] + self.w["class_bias"], rows, classes, learn)
        score = chosen.astype(np.float64)
        slopes, back = {}, None
        if learn:
            odds[rows, classes] -= 1
            slopes["class"], slopes["class_bias"] = h.T @ odds, odds.sum(axis=0)
            back = odds @ self.w["class"].T
            slopes["word"], slopes["word_bias"] = np.zeros_like(self.w["word"]), np.zeros_like(self.w["word_bias"])
        order = np.argsort(classes.astype(np.int8), kind="stable")
        edges = np.searchsorted(classes[order], np.arange(COMMON_CLASSES + 1))
        common = order[: edges[-1]]
        owns, insides, gained = h[common], within[common], np.empty(len(common), np.float32)
        sent = np.empty_like(owns) if learn else None
        for c in range(COMMON_CLASSES):
            a, b = edges[c], edges[c + 1]
            if a == b:
                continue
            own, inside = owns[a:b], insides[a:b]
            logits = own @ self.w["word"][c]
            logits += self.w["word_bias"][c]
            gained[a:b], odds = _odds(logits, rows[: b - a], inside, learn)
            if learn:
                odds[rows[: b - a], inside] -= 1
                slopes["word"][c], slopes["word_bias"][c] = own.T @ odds, odds.sum(axis=0)
                np.matmul(odds, self.w["word"][c].T, out=sent[a:b])
        score[common] += gained
        if learn:
            back[common] += sent
        return score, slopes, back

    def backward(self, reads: np.ndarray, begins: np.ndarray, kept, back: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of a window; nothing flows back before its first step."""
        before, gates, fresh, recurrent = kept
        steps, lanes, _ = back.shape
        u_t = self.w["state"].T.copy()
        pushes = np.empty((steps, lanes, 3 * HIDDEN), np.float32)
        inputs = np.empty((steps, lanes, 3 * HIDDEN), np.float32)
        carry = np.zeros((lanes, HIDDEN), np.float32)
        keep, reset = gates[:, :, :HIDDEN].copy(), gates[:, :, HIDDEN:]
        to_fresh, to_keep = fresh * fresh, before - fresh
        left = 1 - keep
        np.subtract(1, to_fresh, out=to_fresh)
        to_fresh *= left
        to_keep *= keep
        to_keep *= left
        turns = np.empty((steps, lanes, 2, HIDDEN), np.float32)
        np.multiply(recurrent, reset, out=turns[:, :, 0])
        turns[:, :, 0] *= 1 - reset
        turns[:, :, 1] = reset
        goes_on = (~begins).astype(np.float32)[:, :, None]
        d, d_fresh, kept_on = (np.empty((lanes, HIDDEN), np.float32) for _ in range(3))
        halves = pushes.reshape(steps, lanes, 3, HIDDEN)
        for t in range(steps - 1, -1, -1):
            np.add(back[t], carry, out=d)
            np.multiply(d, to_fresh[t], out=d_fresh)
            np.multiply(d, to_keep[t], out=halves[t, :, 0])
            np.multiply(d_fresh[:, None], turns[t], out=halves[t, :, 1:])
            inputs[t, :, 2 * HIDDEN :] = d_fresh
            np.multiply(d, keep[t], out=kept_on)
            np.matmul(pushes[t], u_t, out=carry)
            np.add(kept_on, carry, out=carry)
            carry *= goes_on[t]
        inputs[:, :, : 2 * HIDDEN] = pushes[:, :, : 2 * HIDDEN]
        flat = reads.ravel().astype(np.int16)  # so that the sort is by digits
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        ids = ordered[first]
        slopes = {"state": before.reshape(-1, HIDDEN).T @ pushes.reshape(-1, 3 * HIDDEN)}
        self._input_slope = ids, np.add.reduceat(inputs.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
        return slopes

    def descend(self, slopes: dict[str, np.ndarray]) -> None:
        """Steps of Adagrad, with clipped gradients."""
        for name, slope in slopes.items():
            slope = np.clip(slope / LANES, -1, 1)
            self.squares[name] += slope * slope
            self.w[name] -= self.rate * slope / np.sqrt(self.squares[name])
        ids, slope = self._input_slope
        slope = np.clip(slope / LANES, -1, 1)
        self.squares["input"][ids] += slope * slope
        self.w["input"][ids] -= self.rate * slope / np.sqrt(self.squares["input"][ids])

    def run(self, documents: list[np.ndarray], lex: Lexicon, learn: bool) -> np.ndarray:
        """Natural log probability of each document, given as numbers of known words (-1: rare), without
        its rare words' shares in their class. Documents are packed into lanes, the longest first, and lanes that have
        ended are left out of later windows."""
        scores = np.zeros(len(documents))
        order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        lanes: list[list[int]] = [[] for _ in range(min(LANES if learn else SCORING_LANES, len(documents)))]
        sizes = np.zeros(len(lanes), dtype=np.int64)
        for i in order:
            lane = int(sizes.argmin())
            lanes[lane].append(i)
            sizes[lane] += len(documents[i])
        by_size = np.argsort(-sizes, kind="stable")
        sizes = sizes[by_size]
        if not len(sizes):
            return scores
        packed = [i for lane in by_size for i in lanes[lane]]
        flat = np.concatenate([documents[i] for i in packed])
        owner = np.repeat(np.array(packed, dtype=np.int32), [len(documents[i]) for i in packed])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        known = flat >= 0
        classes, within, reads = lex.classes[flat], lex.within[flat], lex.inputs[flat]
        classes[~known], within[~known], reads[~known] = lex.rare, 0, lex.rare_input
        first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(flat) else np.zeros(0, bool)
        reads[1:] = reads[:-1].copy()
        reads[first] = lex.start_input
        bands = known & (classes >= COMMON_CLASSES)
        np.add.at(scores, owner[bands], lex.log_share[flat[bands]])
        state = np.zeros((len(sizes), HIDDEN), np.float32)
        at = 0
        while at < sizes[0]:
            active = int(np.searchsorted(-sizes, -at, side="left"))
            window = WINDOW if learn else WINDOW * max(1, SCORING_LANES // active)
            length = np.minimum(sizes[:active] - at, window)
            steps = int(length.max())
            places = starts[:active] + at + np.arange(steps)[:, None]
            inside = np.arange(steps)[:, None] < length
            whole = bool((length == steps).all())
            places = places if whole else np.where(inside, places, 0)
            read = reads[places] if whole else np.where(inside, reads[places], lex.start_input)
            begin = first[places] if whole else first[places] & inside
            h, kept = self.forward(read, begin, state[:active])
            state[:active] = h[-1]
            took = places.ravel() if whole else places[inside]
            score, slopes, back = self.outputs(h.reshape(-1, HIDDEN) if whole else h[inside], classes[took], within[took], learn)
            scores += np.bincount(owner[took], score, len(scores))
            at += window
            if learn:
                if whole:
                    full = back.reshape(h.shape)
                else:
                    full = np.zeros(h.shape, np.float32)
                    full[inside] = back
                slopes |= self.backward(read, begin, kept, full)
                self.descend(slopes)
        return scores


def numbered(docs: DataFrame, lex, rounds: int, key: str, text: str) -> DataFrame:
    """A row of each document, written: ``row, doc_id, held, part, n_tokens, n_known, known_logs, ids, rare, times``.

    Texts are cut into words here only; training and scoring read ``ids``, the numbers of the known words (-1: rare) as
    little-endian 32-bit bytes. ``rare`` has the other words and ``times`` how often each occurs."""
    held, part = held_out(F.col(key)), F.pmod(F.xxhash64(key), F.lit(rounds)).cast("int")
    rows = docs.select(F.col(key).alias("doc_id"), held.alias("held"), part.alias("part"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon_ = lex.value
        known_words, end = pa.array(lexicon_.words, pa.binary()), lexicon_.words.index(END)
        logs, seen = np.log10(lexicon_.counts + ADDED), lexicon_.counts > 0
        row = TaskContext.get().partitionId() << 33
        for batch in small_batches(batches, 2000):
            made, rare, known = [], [], []
            lists = words_in(batch.column("text"))
            words = lists.flatten()
            ids = pc.index_in(words, known_words).fill_null(-1).to_numpy()
            filled = pc.binary_length(words).to_numpy() > 0
            ends = np.concatenate(([0], np.cumsum(filled)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            ids, others = ids[filled], iter(words.filter(pa.array(filled & (ids < 0))).to_pylist())
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                made.append(np.append(ids[a:b], np.int32(end)))
                inside = made[-1] >= 0
                many = len(inside) - np.count_nonzero(inside)
                rare.append(Counter(islice(others, many)))
                known.append(made[-1][inside] if many else made[-1])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + n), pa.int64()),
                    *(batch.column(c) for c in ("doc_id", "held", "part")),
                    pa.array([len(ids) for ids in made], pa.int64()),
                    pa.array([int(seen[k].sum()) for k in known], pa.int64()),
                    pa.array([float(logs[k].sum()) for k in known], pa.float64()),
                    pa.array([ids.tobytes() for ids in made], pa.binary()),
                    pa.array([list(r) for r in rare], pa.list_(pa.binary())),
                    pa.array([list(r.values()) for r in rare], pa.list_(pa.int64())),
                ],
                names=["row", "doc_id", "held", "part", "n_tokens", "n_known", "known_logs", "ids", "rare", "times"],
            )
            row += n

    return written(
        rows.mapInArrow(
            run,
            f"row long, doc_id {kind.simpleString()}, held boolean, part int, n_tokens long, n_known long, known_logs double, "
            "ids binary, rare array<binary>, times array<long>",
        ),
        "numbered",
    )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in small_batches(batches):
        for ids in batch.column("ids").to_pylist():
            yield np.frombuffer(ids, "<i4")


def _packs(documents: Iterator, size) -> Iterator[list]:
    """Lists of documents of about ``PACKED_WORDS`` words together."""
    pack, words = [], 0
    for document in documents:
        pack.append(document)
        words += size(document)
        if words >= PACKED_WORDS:
            yield pack
            pack, words = [], 0
    if pack:
        yield pack


def train_round(docs: DataFrame, lex, weights: dict[str, np.ndarray], rate: float) -> dict[str, np.ndarray]:
    """The mean of the weights that all partitions of numbered documents reach from the same start, weighed by their words.

    Weights are averaged by Spark, in two steps and in parts; the driver gets one set of weights.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(shared.value, rate)
        words = 0
        for pack in _packs(_documents(batches), len):
            network.run(pack, lex.value, learn=True)
            words += sum(map(len, pack))
        if words:
            names = list(network.w)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array([TaskContext.get().partitionId() % 32] * len(names), pa.int32()),
                    pa.array([float(words)] * len(names), pa.float64()),
                    pa.array([network.w[n].astype("<f8").tobytes() for n in names], pa.binary()),
                ],
                names=["name", "part", "words", "value"],
            )

    def mean(by: tuple, frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, value, part = 0.0, None, 0
        for frame in frames:
            for row in frame.to_pylist():
                scaled = np.frombuffer(row["value"], "<f8") * row["words"]
                value = scaled if value is None else value + scaled
                total, part = total + row["words"], row["part"]
        made = [[by[0].as_py()], [part], [total], [(value / total).tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(m, t) for m, t in zip(made, kinds, strict=True)], names=columns)

    kinds, columns = [pa.string(), pa.int32(), pa.float64(), pa.binary()], ["name", "part", "words", "value"]
    schema = "name string, part int, words double, value binary"
    trained = docs.select("ids").mapInArrow(run, schema)
    means = trained.groupBy("name", "part").applyInArrow(mean, schema).groupBy("name").applyInArrow(mean, schema)
    result = dict(weights)
    for row in means.collect():
        result[row["name"]] = np.frombuffer(row["value"], "<f8").astype(np.float32).reshape(weights[row["name"]].shape)
    return result


def train(documents: DataFrame, lex, rounds: int = 3, rate: float = 0.2) -> dict[str, np.ndarray]:
    """Weights after ``rounds`` rounds over numbered documents, each over another part of those that aren't held out."""
    weights = first_weights(lex.value)
    for i in range(rounds):
        weights = train_round(documents.where(~F.col("held") & (F.col("part") == i)), lex, weights, rate)
    return weights


def score_documents(docs: DataFrame, head_words: int = 1 << 18, rounds: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``base_score`` is by counts only: the sum of ``log10((c + 0.1) / (N + 0.1 * (V + 1)))``.
    """
    context = docs.sparkSession.sparkContext
    counts = written(count_words(docs.where(~held_out(F.col(key))), text), "word-counts")
    head = lexicon(counts, head_words)
    lex = context.broadcast(head)
    documents = numbered(docs, lex, rounds, key, text)
    weights = context.broadcast(train(documents, lex, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(weights.value)

        def rows():
            for batch in small_batches(batches):
                for row, ids in zip(batch.column("row").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                    yield row, np.frombuffer(ids, "<i4")

        for pack in _packs(rows(), lambda r: len(r[1])):
            scores = network.run([ids for _, ids in pack], lex.value, learn=False) / math.log(10)
            made = [pa.array([row for row, _ in pack], pa.int64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(made, names=["row", "partial"])

    scored = documents.select("row", "ids").mapInArrow(run, "row long, partial double")
    rare = documents.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", "r.rare", "r.times")
    others = counts.where((F.col("n") < head.least) | (F.octet_length("word") > LONGEST_HEAD_WORD)).where(F.col("word") != F.lit(END))
    n = F.coalesce("n", F.lit(0))
    found = rare.join(others, rare["rare"] == others["word"], "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(n + ADDED)).alias("rare_logs"),
        F.sum("times").alias("n_rare"),
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    whole = math.log10(head.tokens + ADDED * (head.distinct + 1))
    in_class = math.log10(head.mass[-1])
    zero = F.lit(0.0)
    logs = F.coalesce("rare_logs", zero)
    each = documents.select("row", "doc_id", "held", "n_tokens", "n_known", "known_logs").join(scored, "row")
    return each.join(found, "row", "left").select(
        "doc_id",
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(head.tokens).cast("long").alias("train_tokens"),
        (F.col("known_logs") + logs - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("partial") + logs - F.coalesce("n_rare", F.lit(0)) * in_class).alias("score"),
    )
