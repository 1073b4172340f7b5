"""Near duplicates by Order MinHash.

A text's words are cut into shingles of three, and each shingle is labelled with the number of its
earlier occurrences. Each of several hash functions picks the two smallest labelled shingles; a sketch
is both, in the order in which the text has them. Two texts agree in a sketch more often the
smaller their edit distance is, as moved passages change the order. In short texts few shingles outlive an
edit: they also get sketches of one shingle of two words each.

Equal texts are one node from the start. Nodes that agree in a sketch meet in its bucket, and are compared
with a hub, one of the bucket's nodes, before what is left is compared all with all. A pair is a link if a banded alignment of the
words, bit-parallel, finds an edit similarity ``1 - edits / longer`` of at least 0.8. First each node is compared with
the hub that it meets most often, and the components of all links are formed. Then buckets that still hold
several components choose hubs of the first and of the last component, and all their nodes of other components are
compared with them, until that finds few further links.

Hubs may leave pairs of other classes in buckets of many texts that share a passage. Their texts are sketched anew by what they have beside
the hub (``own_keys``), and meet in finer buckets, to which the same is done. So each of these steps' rows are
as many as nodes times sketches. Last, all pairs that share a bucket and are of different classes yet are
compared (``rest_pairs``), so that hubs lose no link of a bucket. Like every search by sketches this finds a linked pair with a probability, which is
measured by length and similarity (README) and grows with the sketches.

Defined cases: null and empty texts are equal and form one class; texts without words match only equal texts;
texts of fewer than three words are one shingle; equal rows and ties have the same class; a class without any
id has a null id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspan.llm.common import bucketed, small_batches, text_key, unused, written
from civicspan.llm.decontamination import words_of

SHINGLE = 5
#: Words in a shingle of the sketches, of which an edit changes as many.
NARROW = 3
SKETCHES = 48
#: Texts of at most so many words also get sketches of one shingle of two words.
SHORT = 64
LONE_SKETCHES = 16
#: Sketches of the words, and of the shingles of two words, that a text has beside a hub.
OWN_WORDS, OWN_PAIRS = 24, 16
#: How often buckets that hubs have left in several classes are made finer.
FINER = 1
#: Nodes that are compared with one hub in a task.
NODES_A_TASK = 500
#: Places into which words are counted, to tell pairs that cannot be links.
BAG = 512
#: What pairs meet in, how many rows of it are read at a time at least, and how many pairs are handed on at a time.
CELL = ("key", "low_block", "high_block")
ROWS_AT_ONCE, PAIRS_AT_ONCE = 10_000, 100_000
#: Hubs are gone through again while at least such a share of the pairs with them are links; what they leave is compared all with all.
LINKED = 0.25
#: Pairs and edges that one task gets at least, and the tasks there are at least, so that small steps aren't dealt over all shuffle partitions.
PAIRS_A_TASK, EDGES_A_TASK, LEAST_TASKS = 1000, 50_000, 24
SIMILARITY = 0.8
KEPT_WORDS = 500_000
#: Hashed words times sketches that are worked on at a time.
AT_ONCE = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        made = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return made


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def labelled_shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash of each shingle and the number of its earlier occurrences, in the order of the text."""
    n = max(len(words) - size + 1, 1)
    size = min(size, len(words))
    made = np.zeros(n, np.uint64)
    for j in range(size):
        made = made * ODD + words[j : j + n]
    made = _mix(made)
    order = np.argsort(made, kind="stable")
    ordered = made[order]
    again = np.concatenate(([False], ordered[1:] == ordered[:-1]))
    if again.any():
        place = np.arange(n)
        first = np.maximum.accumulate(np.where(again, 0, place))
        label = np.empty(n, np.uint64)
        label[order] = (place - first).astype(np.uint64)
        made = np.where(label > 0, _mix(made + label * ODD), made)
    return made


def sketch(shingles: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """One 64-bit number for each hash function, from its two smallest shingles in text order."""
    n = len(shingles)
    seeds = _mix(np.arange(1, 2 * sketches + 1, dtype=np.uint64) * ODD)
    keys = np.empty(sketches, np.uint64)
    step = max(1, AT_ONCE // n)
    for a in range(0, sketches, step):
        b = min(a + step, sketches)
        values = (shingles[None, :] ^ seeds[a:b, None]) * (seeds[sketches + a : sketches + b, None] | np.uint64(1))
        rows = np.arange(b - a)
        least = values.argmin(axis=1)
        values[rows, least] = np.uint64(0xFFFFFFFFFFFFFFFF)
        next_least = values.argmin(axis=1) if n > 1 else least
        before, after = np.minimum(least, next_least), np.maximum(least, next_least)
        keys[a:b] = _mix(_mix(shingles[before] + seeds[a:b]) * ODD + shingles[after])
    return keys


def lone_sketch(shingles: np.ndarray, sketches: int = LONE_SKETCHES) -> np.ndarray:
    """One 64-bit number for each hash function, from its smallest shingle."""
    seeds = _mix(np.arange(1, 2 * sketches + 1, dtype=np.uint64) * ODD + np.uint64(1))
    values = (shingles[None, :] ^ seeds[:sketches, None]) * (seeds[sketches:, None] | np.uint64(1))
    return _mix(shingles[values.argmin(axis=1)] + seeds[:sketches])


def keys_of(words: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """All sketches of a text."""
    keys = sketch(labelled_shingles(words, NARROW), sketches)
    return np.concatenate((keys, lone_sketch(labelled_shingles(words, 2)))) if len(words) <= SHORT else keys


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and substitutions turn ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    same = a == b[: len(a)]
    start = len(a) if same.all() else int(np.argmin(same))
    a, b = a[start:], b[start:]
    same = a[::-1] == b[::-1][: len(a)]
    tail = len(a) if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(b) <= most:
        return True
    if not most or not _bags_within(a, b, most):
        return False
    rows, columns = a.tolist(), b.tolist()
    return (_banded(rows, columns, most) if len(rows) > most else _whole(rows, columns)) <= most


def _bags_within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Each edit changes at most one word of the longer text: too many words without a partner rule a pair out."""
    values, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    in_a = np.bincount(inverse[: len(a)], minlength=len(values))
    in_b = np.bincount(inverse[len(a) :], minlength=len(values))
    return len(b) - int(np.minimum(in_a, in_b).sum()) <= most


def _places(rows: list[int]) -> dict[int, int]:
    places: dict[int, int] = {}
    for at, word in enumerate(rows):
        places[word] = places.get(word, 0) | 1 << at
    return places


def _whole(rows: list[int], columns: list[int]) -> int:
    """Edit distance, one column a step: bit i says how cell i + 1 differs from the one above."""
    if not rows:
        return len(columns)
    places, full, last = _places(rows), (1 << len(rows)) - 1, 1 << (len(rows) - 1)
    up, down, distance = full, 0, len(rows)
    for word in columns:
        equal = places.get(word, 0)
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        right_up, right_down = down | (full & ~(diagonal | up)), diagonal & up
        distance += (right_up & last > 0) - (right_down & last > 0)
        right_up = (right_up << 1 | 1) & full
        right_down = (right_down << 1) & full
        up, down = right_down | (full & ~(diagonal | right_up)), diagonal & right_up
    return distance


def _banded(rows: list[int], columns: list[int], most: int) -> int:
    """The same over the band of cells at most ``most`` off the diagonal; exact up to ``most``.

    The band moves down a row with each column, so that its last bit first follows the diagonal that
    begins ``most`` rows down, and then, at the last row, moves to the right.
    """
    places = _places(rows)
    width = 2 * most + 1
    full = (1 << width) - 1
    up, down = full & ~((1 << most) - 1), 0
    distance, edge, bottom = most, 1 << (width - 1), 1 << (width - 2)
    hopeless = 2 * most + len(columns) - len(rows)
    for column, word in enumerate(columns):
        equal = places.get(word, 0)
        first = column - most
        equal = (equal >> first if first >= 0 else equal << -first) & full
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        right_up, right_down = down | (full & ~(diagonal | up)), diagonal & up
        if column < len(rows) - most:
            distance += not diagonal & edge
        else:
            distance += (right_up & bottom > 0) - (right_down & bottom > 0)
            bottom >>= 1
        if distance > hopeless:
            return most + 1
        up, down = right_down | (full & ~((diagonal >> 1) | right_up)), (diagonal >> 1) & right_up
    return distance


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    return bool(longer) and edits_within(a, b, int((1 - least) * longer + 1e-9))


def _dealt(frame: DataFrame, rows: int, each: int) -> DataFrame:
    """In no more tasks than so many rows are worth; shuffle partitions that are read together stay whole."""
    return frame.coalesce(max(LEAST_TASKS, rows // each + 1))


def _node(text: Column) -> Column:
    return F.unhex(F.substring(text_key(text), 1, 32))


def _row_key(key: Column, text: Column) -> Column:
    """Stands for a row's id and text together, so that copies of a text are spread over the keys."""
    return _node(F.concat_ws("\u0000", F.coalesce(key.cast("string"), F.lit("null")), text))


def nodes_of(docs: DataFrame, key: str, text: str, sketches: int) -> DataFrame:
    """A row of each distinct text: ``node``, its least id, the key of the row with that id, its number of words,
    their 32-bit hashes and its sketches."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(_node(whole).alias("node"), F.col(key).alias("doc_id"), whole.alias("text"))
    distinct = rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("text").alias("text"))
    distinct = distinct.withColumn("row_key", _row_key(F.col("least_id"), F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            hashed = [word_hashes(t.encode()) for t in batch.column("text").to_pylist()]
            keys = [keys_of(h, sketches).view(np.int64) if len(h) else None for h in hashed]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    batch.column("least_id"),
                    batch.column("row_key"),
                    pa.array([len(h) for h in hashed], pa.int64()),
                    pa.array([(h >> np.uint64(32)).astype("<u4").tobytes() for h in hashed], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["node", "least_id", "row_key", "n", "words", "keys"],
            )

    kind = docs.schema[key].dataType.simpleString()
    made = distinct.mapInArrow(run, f"node binary, least_id {kind}, row_key binary, n long, words binary, keys array<bigint>")
    return bucketed(made, "nodes", "node")


def buckets_of(nodes: DataFrame) -> DataFrame:
    """``key, node, n`` of the buckets that hold several nodes."""
    each = nodes.select("node", "n", F.explode("keys").alias("key"))
    several = each.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    return written(each.join(several, "key"), "buckets")


def _placed(nodes: DataFrame, classes: DataFrame | None) -> DataFrame:
    """With the nodes' classes; a node without links is its own."""
    if classes is None:
        return nodes.withColumn("class", F.col("node"))
    return nodes.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))


def _salts(size: str) -> Column:
    """In how many tasks the nodes that are compared with a bucket's hub are dealt."""
    return (1 + F.floor(F.col(size) / NODES_A_TASK)).cast("int")


def live_buckets(buckets: DataFrame, classes: DataFrame | None) -> DataFrame:
    """``key, node, n, class, low, high, salts`` of the buckets that hold several classes: ``low`` and ``high`` are the first
    node of the first class and the last one of the last. ``salts`` is larger for large buckets.

    Buckets of one class are left out for good, so that later turns read what is left."""
    placed = _placed(buckets.select("key", "node", "n"), classes)
    of = F.struct("class", "node", "n")
    hubs = placed.groupBy("key").agg(F.min(of).alias("low"), F.max(of).alias("high"), F.count("*").alias("size"))
    split = hubs.where(F.col("low.class") != F.col("high.class")).select("key", "low", "high", _salts("size").alias("salts"))
    return placed.join(split, "key")


def hub_pairs(live: DataFrame, least: float, first: bool) -> DataFrame:
    """Pairs of a ``node`` and the ``hub`` of one of its buckets, from different classes ``under < over`` and of
    similar length; ``a < b`` are both.

    At first each node gets only the one low hub that it meets most often, then all low and high ones."""
    met, of_high = (live.select("node", "n", "class", F.col(c).alias("hub"), "salts") for c in ("low", "high"))
    if not first:
        met = met.unionByName(of_high)
    fit = F.least("n", "hub.n") >= F.lit(least) * F.greatest("n", "hub.n")
    pairs = met.where((F.col("class") != F.col("hub.class")) & fit).select("node", "class", "hub.node", "hub.class", "salts")
    pairs = pairs.toDF("node", "class", "hub", "hub_class", "salts")
    if first:
        often = pairs.groupBy("node", "class", "hub", "hub_class").agg(F.count("*").alias("times"), F.max("salts").alias("salts"))
        best = F.max_by(F.struct("hub", "hub_class", "salts"), F.struct("times", "hub")).alias("best")
        pairs = often.groupBy("node", "class").agg(best).select("node", "class", "best.*")
    return pairs.select(
        "node",
        "hub",
        "salts",
        F.least("node", "hub").alias("a"),
        F.greatest("node", "hub").alias("b"),
        F.least("class", "hub_class").alias("under"),
        F.greatest("class", "hub_class").alias("over"),
    ).dropDuplicates(["a", "b"])


def with_words(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """The columns, and the words of each pair's node and hub, ``words`` and ``hub_words``.

    A hub's words are sent to as many tasks as its largest bucket is dealt over, so that no task gets all nodes of a hub."""
    words = nodes.select("node", "words")
    hubs = pairs.groupBy(F.col("hub").alias("node")).agg(F.max("salts").alias("salts")).join(words, "node")
    salted = hubs.select(
        F.col("node").alias("hub"), F.col("words").alias("hub_words"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).join(words, "node")
    return dealt.join(salted, ["hub", "salt"]).select(*columns, "words", "hub_words")


def common_words(nodes: DataFrame) -> np.ndarray:
    """Words that a twentieth of all nodes have, in order. They only come last when a text is sketched.

    These are at most twenty times as many as a text has different words on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            each = [np.unique(np.frombuffer(words, "<u4")) for words in batch.column("words").to_pylist()]
            values, counts = np.unique(np.concatenate([*each, np.empty(0, "<u4")]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "nodes"])

    worded = nodes.where("n > 0").select("words")
    counted = worded.mapInArrow(run, "word long, nodes long").groupBy("word").agg(F.sum("nodes").alias("nodes"))
    often = counted.where(20 * F.col("nodes") > worded.count() + 20).collect()
    return np.array(sorted(r["word"] for r in often), "<u4")


def own_keys(words: np.ndarray, hub: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """Sketches of what a text has and the hub does not: of its labelled words, and of its shingles of two words.

    What all texts around a hub share, such as a passage, is taken away, so that the rest tells which of them are near each
    other. Of a hub of quite another length, nothing is."""
    made = []
    for size, sketches in ((1, OWN_WORDS), (2, OWN_PAIRS)):
        shingles = labelled_shingles(words.astype(np.uint64), size)
        often = np.isin(words, common)[: len(shingles)]
        if size == 2:
            often = often & np.append(often[1:], often[-1:])
        if min(len(words), len(hub)) >= least * max(len(words), len(hub)):
            own = ~np.isin(shingles, labelled_shingles(hub.astype(np.uint64), size))
            shingles, often = (shingles[own], often[own]) if own.any() else (shingles, often)
        shingles = shingles[~often] if not often.all() else shingles
        made.append(_mix(lone_sketch(shingles, sketches) + np.uint64(size)))
    return np.concatenate(made)


def finer_buckets(live: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """New buckets, as ``buckets_of``, for nodes that their buckets' hubs have left in several classes.

    Such a node goes with the hub that it meets in most of these buckets, and gets sketches of what it has beside that hub.
    Rows are as many for each node, however many nodes a bucket holds."""
    rest = live.where((F.col("node") != F.col("low.node")) & (F.col("node") != F.col("high.node")))
    several = rest.groupBy("key").agg(F.min("class").alias("first"), F.max("class").alias("last")).where("first < last").select("key")
    met = rest.join(several, "key").groupBy("node", F.col("low.node").alias("hub"))
    often = met.agg(F.count("*").alias("times"), F.max("salts").alias("salts"))
    home = often.groupBy("node").agg(F.max_by(F.struct("hub", "salts"), F.struct("times", "hub")).alias("home"))
    home = written(home.select("node", "home.*"), "homes")
    common = common_words(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("hub", "words", "hub_words")), strict=True)
            keys, lengths = [], []
            for hub, words, hub_words in rows:
                made = own_keys(np.frombuffer(words, "<u4"), np.frombuffer(hub_words, "<u4"), common, least)
                keys.append(_mix(made + np.frombuffer(hub[:8], "<u8")).view(np.int64))
                lengths.append(len(words) // 4)
            columns = [batch.column("node"), pa.array(lengths, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "keys"])

    met = _dealt(with_words(home, nodes, "node", "hub"), home.count(), PAIRS_A_TASK)
    made = met.mapInArrow(run, "node binary, n long, keys array<bigint>")
    return buckets_of(written(made, "own-keys"))


def bags_of(nodes: DataFrame) -> DataFrame:
    """``node, bag``: how many of the node's words fall into each of ``BAG`` places, 127 if more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            counts = [np.bincount(np.frombuffer(w, "<u4") % BAG, minlength=BAG) for w in batch.column("words").to_pylist()]
            bags = pa.array([np.minimum(c, 127).astype(np.int8) for c in counts], pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), bags], names=["node", "bag"])

    return nodes.select("node", "words").mapInArrow(run, "node binary, bag array<tinyint>")


def near_bags(n: str, other_n: str, bag: str, other_bag: str, least: float) -> Column:
    """Whether two bags allow the similarity: each edit changes at most one word of the longer text, so that no link is lost.

    Two bags share half of what their words are together without what they differ by. Capped counts differ by less at most."""
    apart = F.aggregate(F.zip_with(bag, other_bag, lambda x, y: F.abs(x - y)), F.lit(0), lambda total, x: total + x)
    longer = F.greatest(n, other_n)
    return longer - (F.col(n) + F.col(other_n) - apart) / 2 <= F.lit(1 - least) * longer + F.lit(1e-9)


def _cells_end(batch: pa.RecordBatch) -> np.ndarray:
    """For each row of sorted cells, the row behind the last one of its cell."""
    columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in CELL]
    edge = np.zeros(batch.num_rows, bool)
    edge[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    starts = np.append(np.flatnonzero(edge), batch.num_rows)
    return starts[np.cumsum(edge)]


def cell_pairs(batch: pa.RecordBatch, least: float) -> Iterator[pa.RecordBatch]:
    """``node, hub, under, over, salts`` of the pairs of a cell's rows that may be links; cells are whole and in order.

    All rows meet the row that is 1, 2, ... behind them at a time, as long as that is of their cell."""
    bags = batch.column("bag").flatten().to_numpy(zero_copy_only=False).reshape(-1, BAG)
    n, salts, block, low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "salts", "block", "low_block", "high_block"))
    node, group = (np.array([*batch.column(c).to_pylist(), None], object)[:-1] for c in ("node", "class"))
    number = batch.column("class").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    end, rows, found, held = _cells_end(batch), np.arange(batch.num_rows), [], 0
    #: A row of the first block meets all blocks, one of another only those that its cell is for.
    once = low == high
    for behind in range(1, batch.num_rows):
        rows = rows[rows + behind < end[rows]]
        if not len(rows):
            break
        others = rows + behind
        short, long = np.minimum(n[rows], n[others]), np.maximum(n[rows], n[others])
        apt = (number[rows] != number[others]) & (once[rows] | (block[rows] != block[others])) & (short >= least * long)
        a, b, short, long = rows[apt], others[apt], short[apt], long[apt]
        apart = np.abs(bags[a] - bags[b]).sum(axis=1, dtype=np.int32)
        near = long - (short + long - apart) / 2 <= (1 - least) * long + 1e-9
        if near.any():
            found.append((a[near], b[near]))
            held += len(found[-1][0])
        if held >= PAIRS_AT_ONCE:
            yield _pair_rows(found, node, group, salts)
            found, held = [], 0
    if found:
        yield _pair_rows(found, node, group, salts)


def _pair_rows(found: list, node: np.ndarray, group: np.ndarray, salts: np.ndarray) -> pa.RecordBatch:
    a, b = (np.concatenate(side) for side in zip(*found, strict=True))
    swap, turned = node[a] > node[b], group[a] > group[b]
    columns = [np.where(swap, node[b], node[a]), np.where(swap, node[a], node[b])]
    columns += [np.where(turned, group[b], group[a]), np.where(turned, group[a], group[b])]
    made = [pa.array(c, pa.binary()) for c in columns] + [pa.array(salts[a], pa.int32())]
    return pa.RecordBatch.from_arrays(made, names=["node", "hub", "under", "over", "salts"])


def rest_pairs(live: DataFrame, nodes: DataFrame, tested: DataFrame, least: float) -> DataFrame:
    """What ``hub_pairs`` has left out: all other pairs of nodes of one bucket, from different classes, that may be links.

    A bucket's nodes are dealt into blocks of some ``NODES_A_TASK``, and each two blocks, or one with itself, are a cell. Cells are
    sorted within their tasks and read as a stream, so a task holds one cell and a little more. All pairs
    are looked at in their cell, with the nodes' bags; rows are made of those alone that may be links."""
    bags = written(bags_of(nodes.join(live.select("node").distinct(), "node", "left_semi")), "bags")
    side = live.select("key", "node", "n", "class", "salts").join(bags, "node")
    each = side.withColumn("block", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    cells = each.withColumns({"low_block": F.least("block", "other"), "high_block": F.greatest("block", "other")}).drop("other")
    dealt = cells.repartition(*CELL).sortWithinPartitions(*CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS_AT_ONCE:
                whole = pa.concat_batches(held)
                last = int(np.searchsorted(_cells_end(whole), whole.num_rows))
                yield from cell_pairs(whole.slice(0, last), least)
                held = [whole.slice(last)]
        if held:
            yield from cell_pairs(pa.concat_batches(held), least)

    met = dealt.mapInArrow(run, "node binary, hub binary, under binary, over binary, salts int")
    pairs = met.groupBy("node", "hub").agg(F.max("salts").alias("salts"), F.first("under").alias("under"), F.first("over").alias("over"))
    pairs = pairs.join(tested.select(F.col("a").alias("node"), F.col("b").alias("hub")), ["node", "hub"], "left_anti")
    return written(pairs, "rest")


def verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The classes of the pairs whose alignment reaches the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            left, right = batch.column("words").to_pylist(), batch.column("hub_words").to_pylist()
            linked = [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), least) for x, y in zip(left, right, strict=True)]
            yield batch.select(["under", "over"]).filter(pa.array(linked, pa.bool_()))

    met = _dealt(with_words(pairs, nodes, "under", "over"), pairs.count(), PAIRS_A_TASK)
    return met.mapInArrow(run, "under binary, over binary")


def are_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge downwards, to a node that has none: then these are the classes."""
    downwards = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    upwards = edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    nodes = downwards.unionByName(upwards).groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.agg(F.count_if(F.col("down") + F.col("up") > 1)).first()[0] == 0


def components(links: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``node, class`` for nodes with links; the class is the least node that is reached.

    ``classes`` are those of earlier links; the links then lie between classes, and only these are worked on before
    the members follow. Large and small stars in turn: every node's larger neighbours are tied to the least of its
    neighbours, then all smaller ones are, until only stars are left. Hot nodes are grouped by partial minima only.
    """
    edges = written(links.select(F.col("over").alias("a"), F.col("under").alias("b")).distinct(), "links")
    many = edges.count()

    def few(frame: DataFrame) -> DataFrame:
        return _dealt(frame, many, EDGES_A_TASK)

    while not are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = few(both.where("b > a").join(least, "a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = few(large.distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = few(large.join(least, "a").where("b != m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = few(least).select("a", F.col("m").alias("b"))
        edges = written(few(small.unionByName(own).distinct()), "stars")
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("class"))
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct()
    found = members.unionByName(tops)
    if classes is not None:
        moved = found.select(F.col("node").alias("class"), F.col("class").alias("into"))
        every = classes.unionByName(found.select("node", F.col("node").alias("class")))
        found = every.join(moved, "class", "left").select("node", F.coalesce("into", "class").alias("class")).distinct()
    return written(found, "classes")


def link(
    buckets: DataFrame, nodes: DataFrame, classes: DataFrame | None, tested: DataFrame | None, least: float
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The buckets that hold several classes yet, the classes, and the pairs tested so far, after the hubs have found few more links.

    Classes may have grown together since the buckets were looked at; ``link_rest`` looks again and finds what the hubs have left."""
    live, found_many = buckets, True
    first = classes is None  # later steps have few nodes, and no best hubs
    while found_many:  # until a turn over all hubs finds little
        live = live_buckets(buckets, None) if first else written(live_buckets(live, classes), "live")
        pairs = hub_pairs(live, least, first)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        tried = pairs.select("a", "b")
        tested = tried if tested is None else tested.unionByName(tried)
        found = written(verified(pairs, nodes, least), "found")
        n_found = found.count()
        found_many = first or n_found > LINKED * tried.count()
        if n_found:
            classes = components(found, classes)
        live, first = (buckets, False) if first else (live, False)
    return live, classes, tested


def link_rest(
    lives: list[DataFrame], nodes: DataFrame, classes: DataFrame | None, tested: DataFrame, least: float
) -> DataFrame | None:
    """The classes after every pair is compared that meets in a bucket and is of different classes yet."""
    live = written(reduce(DataFrame.unionByName, [live_buckets(one, classes) for one in lives]), "rest-live")
    found = written(verified(rest_pairs(live, nodes, tested, least), nodes, least), "rest-found")
    return classes if found.isEmpty() else components(found, classes)


def leads(docs: DataFrame, key: str, text: str, least: float, sketches: int) -> DataFrame:
    """``node, class_id, row_key`` of every distinct text: the least id of its class, and the row that has it."""
    nodes = nodes_of(docs, key, text, sketches)
    live, classes, tested = link(buckets_of(nodes), nodes, None, None, least)
    lives = [live]
    for _ in range(FINER):
        finer = finer_buckets(live, nodes, least)
        if finer.isEmpty():
            break
        live, classes, tested = link(finer, nodes, classes, tested, least)
        lives.append(live)
    classes = link_rest(lives, nodes, classes, tested, least)
    ids = nodes.select("node", "least_id", "row_key")
    ids = _placed(ids, classes)
    order = F.struct(F.col("least_id").isNull(), F.col("least_id"), F.col("node"))
    lead = ids.groupBy("class").agg(F.min("least_id").alias("class_id"), F.min_by("row_key", order).alias("row_key"))
    return ids.select("node", "class").join(lead, "class").select("node", "class_id", "row_key")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, sketches: int = SKETCHES
) -> DataFrame:
    """``doc_id, class_id`` of every row; ``class_id`` is the least id of its class."""
    of_node = leads(docs, key, text, least, sketches).select("node", "class_id")
    rows = docs.select(F.col(key).alias("doc_id"), _node(F.coalesce(F.col(text), F.lit(""))).alias("node"))
    return rows.join(of_node, "node").select("doc_id", "class_id")


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, sketches: int = SKETCHES
) -> DataFrame:
    """One row of each class, with all its columns: that with the least id, or of rows without id one with the
    least text hash. Of rows with the same id and text one stays."""
    (row,) = unused(docs.columns, "_row")
    kept = leads(docs, key, text, least, sketches).select(F.col("row_key").alias(row)).distinct()
    keyed = docs.withColumn(row, _row_key(F.col(key), F.coalesce(F.col(text), F.lit(""))))
    return keyed.join(kept, row, "left_semi").dropDuplicates([row]).select(docs.columns)
