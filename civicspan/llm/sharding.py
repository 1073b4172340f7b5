"""Balanced label propagation: documents that share text go to the same shard, and all shards hold
equally many rows.

Rows with equal texts form one unit. Units are linked through the lines they share, in star form:
a line is a node, so a line in a third of all documents has as many edges as documents, never
their square. Each round every line takes the shard that most of its rows are in, and every unit
wants the shard that its lines prefer, a line counting by the inverse of its rows. Wishes are
granted, best gain first, as far as the wanted shard's quota allows. Row counts of the shards differ by at
most one: units larger than half a shard fill the first shards one after the other, the labels of all others are the numbers of the
shards that are left, and only what a label has beyond its shard's room moves to shards that have room left, texts without links
first. Lines of fewer than ``least_line`` characters (20) make no link: they say little of what two texts have in common.

Defined cases: a null text counts as eight bytes and has crc32 0, as the empty one; null and empty texts are one
unit; equal rows get different slots; units larger than a shard fill shards of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspan.llm.common import written

#: Parts into which a unit's rows are dealt, so that a unit of a third of all rows isn't one task's.
PARTS = 128
#: Units are numbered in ranges of hashes: so many for each label, and one more for each so many rows.
RANGES, ROWS_A_RANGE = 64, 2_000_000
#: A gain is a share, told apart to this many steps; hashes tell equal gains apart.
GAIN_STEPS, TIE_STEPS = 32, 64
LEAST_LINE = 20


def prepare(docs: DataFrame, key: str = "doc_id", text: str = "text", least_line: int = LEAST_LINE) -> DataFrame:
    """A row of each document without its text: id, size, crc32, its unit, and the hashes of its lines."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.length(line) >= least_line)
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(whole) + 8).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(whole, F.octet_length(whole)).alias("unit"),
        F.array_distinct(F.transform(lines, lambda line: F.xxhash64(line))).alias("lines"),
    )


def units_and_edges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``unit, n`` and ``unit, line, n, weight`` for lines that several units share."""
    units = rows.groupBy("unit").agg(F.count("*").alias("n"), F.max("lines").alias("lines"))
    units = written(units, "units")
    pairs = units.select("unit", "n", F.explode("lines").alias("line"))
    shared = pairs.groupBy("line").agg(F.count("*").alias("units"), F.sum("n").alias("rows")).where("units > 1")
    # A table, so that a line in very many units is a skewed side that Spark splits.
    shared = written(shared, "shared-lines")
    edges = pairs.join(shared, "line").select("unit", "line", "n", (1.0 / F.col("rows")).alias("weight"))
    return units.select("unit", "n"), written(edges, "edges")


def _begin(shard: int, total: int, shards: int) -> int:
    """The first row of a shard, if all rows are in a line."""
    return -(-shard * total // shards)


@dataclass(frozen=True)
class Room:
    """``free`` gives for each shard that large units leave room in how many rows they leave; ``large`` is the rows of these units."""

    total: int
    large: int
    shards: int

    @property
    def free(self) -> dict[int, int]:
        ends = {k: (_begin(k, self.total, self.shards), _begin(k + 1, self.total, self.shards)) for k in range(self.shards)}
        left = {k: end - max(begin, self.large) for k, (begin, end) in ends.items()}
        return {k: n for k, n in left.items() if n > 0}


def first_labels(units: DataFrame, shards: int) -> tuple[DataFrame, Room]:
    """Labels by hash, the number of a shard, as often as the shard has room; and the room. A unit larger than half a shard gets the
    label -1 and stays out of the rounds."""
    total = units.agg(F.sum("n")).first()[0] or 0
    is_large = F.col("n") * 2 * shards > total
    room = Room(total, units.where(is_large).agg(F.sum("n")).first()[0] or 0, shards)
    ends = list(accumulate(room.free.values()))
    place = F.pmod(F.xxhash64("unit", F.lit(1)), F.lit(max(total - room.large, 1)))
    passed = F.size(F.filter(F.array(*[F.lit(end).cast("long") for end in ends or [1]]), lambda end: end <= place))
    label = F.get(F.array(*[F.lit(k) for k in room.free or [0]]), passed)
    return units.withColumn("label", F.when(is_large, -1).otherwise(label).cast("int")), room


def propagate(labels: DataFrame, edges: DataFrame, room: Room, turn: int = 0, slack: float = 0.05) -> DataFrame:
    """One round, the number ``turn``: ``unit, n, label`` after the moves that the quotas allow.

    What is broadcast has at most one row a shard and step of gain.
    """
    movable = labels.where("label >= 0").drop("n")
    placed = edges.join(movable, "unit")
    votes = placed.groupBy("line", "label").agg(F.sum("n").alias("votes"))
    # Of equally many votes all lines favour the same shard, another one each round: what two units share agrees.
    favour = F.xxhash64("label", F.lit(turn))
    preferred = votes.groupBy("line").agg(
        F.max_by("label", F.struct("votes", favour)).alias("wish"), F.sum("votes").alias("all_votes"), F.max("votes").alias("most")
    )
    # A table, so that a line in very many units is a skewed side that Spark splits.
    preferred = written(preferred.select("line", "wish", (F.col("most") / F.col("all_votes")).alias("share")), "wishes")
    pull = placed.join(preferred, "line")
    by_wish = pull.groupBy("unit", "label", "wish").agg(F.sum(F.col("weight") * F.col("share")).alias("pull"))
    best = by_wish.groupBy("unit", "label").agg(
        F.max_by("wish", F.struct("pull", F.xxhash64("wish", F.lit(turn)))).alias("wish"),
        F.max("pull").alias("best"),
        F.coalesce(F.sum(F.when(F.col("wish") == F.col("label"), F.col("pull"))), F.lit(0.0)).alias("stay"),
        F.sum("pull").alias("all"),
    )
    gain = (F.col("best") - F.col("stay")) / F.col("all")
    step = F.least(F.floor(gain * GAIN_STEPS), F.lit(GAIN_STEPS - 1)) * TIE_STEPS
    tie = F.pmod(F.xxhash64("unit", F.lit(2)), F.lit(TIE_STEPS))
    wishes = best.where((F.col("wish") != F.col("label")) & (gain > 0)).select("unit", "wish", (step + tie).alias("rank"))
    # A table, so that the sums and the moves don't work the wishes out anew.
    now = written(labels.where("label >= 0").join(wishes, "unit", "left"), "asked")

    sizes = now.groupBy("label").agg(F.sum("n").alias("size"))
    asked = now.where("wish is not null").groupBy("label", "wish", "rank").agg(F.sum("n").alias("n"))
    plan = _grant(sizes.collect(), asked.collect(), room.free, slack)  # at most shards ** 2 * steps rows
    granted = labels.sparkSession.createDataFrame(plan, "label int, wish int, least long")
    moved = now.join(F.broadcast(granted), ["label", "wish"], "left").select(
        "unit", "n", F.when(F.col("rank") >= F.col("least"), F.col("wish")).otherwise(F.col("label")).cast("int").alias("label")
    )
    return moved.unionByName(labels.where("label < 0"))


def _grant(sizes: list, asked: list, free: dict[int, int], slack: float) -> list[tuple[int, int, int]]:
    """For each pair of shards the least rank that may move: best ranks first, while the target keeps its quota."""
    size = dict.fromkeys(free, 0)
    size.update({row["label"]: row["size"] for row in sizes})
    quota = {label: n * (1 + slack) for label, n in free.items()}
    least: dict[tuple[int, int], int] = {}
    waiting = sorted(asked, key=lambda row: (-row["rank"], row["label"], row["wish"]))
    closed: set[tuple[int, int]] = set()
    progress = True
    while progress:  # a shard that gave rows away may take some that were turned down
        progress, turned_down = False, []
        blocked = set(closed)
        for row in waiting:
            pair = (row["label"], row["wish"])
            if pair in blocked or size[row["wish"]] + row["n"] > quota[row["wish"]]:
                blocked.add(pair)
                turned_down.append(row)
                continue
            size[row["label"]] -= row["n"]
            size[row["wish"]] += row["n"]
            least[pair] = row["rank"]
            progress = True
        waiting = turned_down
    return [(a, b, rank) for (a, b), rank in least.items()]


def cut_weight(labels: DataFrame, edges: DataFrame) -> float:
    """The share of line-to-unit weight that isn't in its line's main shard."""
    placed = edges.join(labels.select("unit", "label"), "unit").groupBy("line", "label").agg(F.sum("weight").alias("w"))
    totals = placed.groupBy("line").agg(F.max("w").alias("main"), F.sum("w").alias("all"))
    row = totals.agg(F.sum("main").alias("main"), F.sum("all").alias("all")).first()
    return 1.0 - row["main"] / row["all"] if row["all"] else 0.0


def lay_out(rows: DataFrame, labels: DataFrame, edges: DataFrame, room: Room) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: rows in the shards of their labels, what is too much in others.

    Positions in a label are counted in three steps, each over bounded groups: a row among the rows of its part of
    a unit, a unit's part among a range of units of a label, the ranges among the label's.
    """
    part = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(PARTS)).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", "unit", part.alias("part"))
    counts = rows.groupBy("unit", "part").agg(F.count("*").alias("rows"))
    ranges = RANGES + room.total // ROWS_A_RANGE
    spread = F.pmod(F.xxhash64("unit", F.lit(3)), F.lit(ranges)).cast("int")
    # What has copies or links comes first in a label, far from the rows that may have to leave it.
    linked = edges.select("unit").distinct().withColumn("linked", F.lit(True))
    held = (F.col("n") > 1) | F.col("linked").isNotNull()
    placed = counts.join(labels.join(linked, "unit", "left"), "unit")
    placed = placed.withColumn("range", F.when(held, spread).otherwise(spread + ranges)).drop("n", "linked")
    # Within a large unit the parts differ, so that the order inside a range is by unit and part.
    placed = written(placed, "places")
    filled = placed.groupBy("label", "range").agg(F.sum("rows").alias("rows")).orderBy("label", "range")
    offsets, size = [], {}
    for row in filled.collect():  # at most (shards + 1) * 2 * ranges rows
        before = size.get(row["label"], 0)
        offsets.append((row["label"], row["range"], before))
        size[row["label"]] = before + row["rows"]
    spark = rows.sparkSession
    starts = F.broadcast(spark.createDataFrame(offsets or [(0, 0, 0)], "label int, range int, range_start long"))
    before = Window.partitionBy("label", "range").orderBy("unit", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.withColumn("inside", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    parts = parts.join(starts, ["label", "range"]).select(
        "unit", "part", "label", (F.col("range_start") + F.col("inside")).alias("start")
    )
    order = Window.partitionBy("unit", "part").orderBy("doc_id")
    numbered = rows.withColumn("row", F.row_number().over(order) - 1).join(parts, ["unit", "part"])
    at = numbered.withColumn("position", F.col("start") + F.col("row"))

    total, shards, free = room.total, room.shards, room.free
    first = {k: max(_begin(k, total, shards), room.large) - _begin(k, total, shards) for k in free}
    keeps = [(k, n, first[k]) for k, n in free.items()]
    too_many = [max(size.get(k, 0) - n, 0) for k, n in free.items()]
    too_few = [max(n - size.get(k, 0), 0) for k, n in free.items()]
    outs = [sum(too_many[:i]) for i in range(len(keeps))]
    ins = [(sum(too_few[:i]), sum(too_few[: i + 1]), k, first[k] + size.get(k, 0)) for i, k in enumerate(free) if too_few[i]]
    plan = [(k, n, slot, out) for (k, n, slot), out in zip(keeps, outs, strict=True)] + [(-1, total, 0, 0)]
    known = F.broadcast(spark.createDataFrame(plan, "label int, room long, first_slot long, surplus_start long"))
    at = at.join(known, "label")
    gaps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(("a", "b", "shard", "slot"), g, strict=True)]) for g in ins or [(0, 0, 0, 0)]])
    surplus = F.col("surplus_start") + F.col("position") - F.col("room")
    gap = F.get(F.filter(gaps, lambda g: (g["a"] <= surplus) & (surplus < g["b"])), F.lit(0))
    of_large = F.expr(f"position * {shards}L div {max(total, 1)}L")
    shard = F.when(F.col("label") < 0, of_large).when(F.col("position") < F.col("room"), F.col("label")).otherwise(gap["shard"])
    slot = (
        F.when(F.col("label") < 0, F.col("position") - F.expr(f"(position * {shards}L div {max(total, 1)}L * {total}L + {shards - 1}) div {shards}"))
        .when(F.col("position") < F.col("room"), F.col("first_slot") + F.col("position"))
        .otherwise(gap["slot"] + surplus - gap["a"])
    )
    return at.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def balanced_shards(docs: DataFrame, shards: int = 24, rounds: int = 3, least_line: int = LEAST_LINE) -> DataFrame:
    rows = written(prepare(docs, least_line=least_line), "shard-rows")
    units, edges = units_and_edges(rows)
    labels, room = first_labels(units, shards)
    labels = written(labels, "labels")
    for turn in range(rounds):
        labels = written(propagate(labels, edges, room, turn), "labels")
    return lay_out(rows, labels, edges, room)
